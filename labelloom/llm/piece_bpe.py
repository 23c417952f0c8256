"""Merges of a sentencepiece vocabulary in rounds over flat arrays, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm.common import blocks, keyed

SPACE_MARK = "▁"
NEVER = np.iinfo(np.int32).max
#: Characters of a text that are encoded at a time; longer texts are cut before a space.
MOST_CHARS = 2_000_000
#: A place to cut a text: a space after something else.
CUT = re.compile(r"(?<=[^ ▁]) ")


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start ... start + length - 1 of every range, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class PieceBpe:
    """Encoder and decoder of a sentencepiece BPE vocabulary with byte fallback and no normalisation.

    Symbols start as characters. A pair of adjacent symbols may be joined if their strings
    together are a piece; its rank is that of the piece's score, the best first, of equal
    ones the leftmost. Two characters that stand side by side in no piece are never joined
    over, so they part words, which are encoded on their own, each distinct one once.

    A round finds the least rank in each word and joins all its occurrences that don't
    overlap, from the left. That is what joining one by one gives if every piece comes from
    joins of no later rank than its own, as then no join opens an earlier one; the
    constructor checks it. Otherwise, and for ranks that pieces share, a round joins the
    leftmost occurrence of a word only.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, trained, kinds = model.normalizer_spec, model.trainer_spec, model.SentencePiece
        plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        known = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        if trained.model_type != trained.BPE or not trained.byte_fallback or not plain or trained.treat_whitespace_as_suffix or any(p.type not in known for p in model.pieces):
            raise ValueError("only BPE vocabularies with byte fallback, a space in front and no normalisation are supported")
        self.size = len(model.pieces)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        special = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.begin, self.end = special[trained.bos_piece], special[trained.eos_piece]
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.is_control = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.byte_ids = np.zeros(256, dtype=np.int64)
        # offset table: piece i is blob[offsets[i] : offsets[i] + lengths[i]]
        shown: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                shown.append(bytes([value]))
            else:
                shown.append(b"" if p.type == kinds.CONTROL else (trained.unk_surface if p.type == kinds.UNKNOWN else p.piece.replace(SPACE_MARK, " ")).encode())
        self.lengths = np.array([len(s) for s in shown], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.spaced = np.array([s[:1] == b" " for s in shown]) & ~self.is_byte & ~self.is_control
        self.spaced[list(special.values())] = False

        # a character is its piece, or size + code where it is none
        letters = {c for piece in self.ids for c in piece}
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for c in letters & self.ids.keys():
            self.symbol[ord(c)] = self.ids[c]
        scores = {i: model.pieces[i].score for p, i in self.ids.items() if len(p) > 1}
        place = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        counts = np.bincount([place[s] for s in scores.values()], minlength=len(place))
        self.shared = np.append(counts > 1, False)
        self.together = False
        self._join(place, scores)
        self._borders()
        self.together = self._consistent(scores, place)

    def _join(self, place: dict[float, int], scores: dict[int, float]) -> None:
        """Sorted pairs of symbols with their rank and the piece they make."""
        number = lambda s: self.ids.get(s, self.size + ord(s) if len(s) == 1 else -1)
        pairs = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = number(piece[:k]), number(piece[k:])
                if a >= 0 and b >= 0:
                    pairs.append((a << 32 | b, place[scores[i]], i))
        pairs.sort()
        self.pairs, self.ranks, self.made = (np.array(column, dtype=kind) for column, kind in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))

    def _borders(self) -> None:
        """Which characters stand side by side in a piece, as a matrix over classes of characters."""
        beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        inside = sorted({c for pair in beside for c in pair})
        self.kind = np.zeros(0x110000, dtype=np.int32)
        self.kind[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.beside = np.zeros((len(inside) + 1, len(inside) + 1), dtype=bool)
        for a, b in beside:
            self.beside[self.kind[ord(a)], self.kind[ord(b)]] = True
        self.cuts = not any(a != SPACE_MARK and b == SPACE_MARK for a, b in beside)
        # runs of the mark alone, if they join after all else, begin with the longest piece of marks
        # once there are that many: joins are from the left, so what follows has no part in it
        pure = {i for p, i in self.ids.items() if len(p) > 1 and set(p) == {SPACE_MARK}}
        longest = max((len(p) for p, i in self.ids.items() if i in pure), default=0)
        last = set(self.made[self.ranks == len(self.shared) - 2].tolist())
        mixed = any(SPACE_MARK * 2 in p and i not in pure for p, i in self.ids.items())
        whole = longest > 0 and len(self._rounds(self._codes(SPACE_MARK * longest), np.array([longest]))[0]) == 1
        self.longest_run = longest if whole and last == pure and not mixed else 0

    def _consistent(self, scores: dict[int, float], place: dict[float, int]) -> bool:
        """Whether each piece of an own rank comes out whole, from joins of no later rank."""
        names = [(p, i) for p, i in self.ids.items() if len(p) > 1 and not self.shared[place[scores[i]]]]
        symbols, counts, worst = self._rounds(self._codes("".join(p for p, _ in names)), np.array([len(p) for p, _ in names]))
        own = np.array([place[scores[i]] for _, i in names])
        return bool((counts == 1).all() and (symbols == [i for _, i in names]).all() and (worst <= own).all())

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols, NEVER where they make none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = self.pairs[at] == key
        return np.where(found, self.ranks[at], NEVER).astype(np.int32), self.made[at]

    def _rounds(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words, which have *sizes* characters each, one after another.

        Returns the symbols left of all words, their number in each word and the latest rank joined in it.
        """
        words = len(sizes)
        symbol, word = self.symbol[codes], np.repeat(np.arange(words), sizes)
        last = np.zeros(len(symbol), dtype=bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.full(len(symbol), NEVER, dtype=np.int32)
        made = np.zeros(len(symbol), dtype=np.int32)
        inner = np.flatnonzero(~last)
        rank[inner], made[inner] = self._lookup(symbol[inner], symbol[inner + 1])
        worst = np.full(words, -1, dtype=np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbol)))
            open_words = least < NEVER
            if not open_words.all():
                stay = np.repeat(open_words, lengths)
                done.append((word[~stay], symbol[~stay]))
                symbol, word, last, rank, made = (x[stay] for x in (symbol, word, last, rank, made))
                least, lengths = least[open_words], lengths[open_words]
                if not len(symbol):
                    break
                starts = np.cumsum(lengths) - lengths
            worst[word[starts]] = np.maximum(worst[word[starts]], least)
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            # of adjacent hits every other one, from the left; one hit only where joins may open earlier ones
            fresh = np.concatenate([[True], np.diff(hits) > 1])
            parity = np.arange(len(hits)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            take = parity % 2 == 0
            owner = word[hits]
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            take &= first | (~self.shared[rank[hits]] & self.together)
            hits = hits[take]
            symbol[hits] = made[hits]
            last[hits] = last[hits + 1]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # places after the gone ones are taken out
            symbol, word, last, rank, made = (x[keep] for x in (symbol, word, last, rank, made))
            changed = np.union1d(at, at[(at > 0)] - 1)
            changed = changed[~last[changed]]
            rank[at[last[at]]] = NEVER
            rank[changed], made[changed] = self._lookup(symbol[changed], symbol[changed + 1])
        owners = np.concatenate([w for w, _ in done]) if done else np.zeros(0, dtype=np.int64)
        symbols = np.concatenate([s for _, s in done]) if done else np.zeros(0, dtype=np.int32)
        return symbols[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=words), worst

    def _starts(self, codes: np.ndarray, part_starts: np.ndarray) -> np.ndarray:
        """Where words begin."""
        kind = self.kind[codes]
        begins = np.ones(len(codes), dtype=bool)
        begins[1:] = ~self.beside[kind[:-1], kind[1:]]
        begins[part_starts] = True
        if self.longest_run:
            # the first runs of the longest piece of a run of marks are that piece, whatever follows the run
            mark = codes == ord(SPACE_MARK)
            inside = mark & ~begins
            inside[1:] &= mark[:-1]
            place = np.arange(len(codes))
            since = place - np.maximum.accumulate(np.where(~inside, place, 0))
            begins |= inside & (since % self.longest_run == 0)
        return np.flatnonzero(begins)

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of a text that are encoded on their own, with the space in front."""
        if not text:
            return
        at, text = 0, " " + text
        while self.cuts and len(text) - at > MOST_CHARS:
            cut = CUT.search(text, at + MOST_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()].replace(" ", SPACE_MARK)
            at = cut.start()
        yield text[at:].replace(" ", SPACE_MARK)

    def encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts of texts, without begin and end."""
        parts_codes = self._codes("".join(parts))
        if not len(parts_codes):
            return [np.zeros(0, dtype=np.int64) for _ in parts]
        part_ends = np.cumsum([len(p) for p in parts])
        part_starts = part_ends - [len(p) for p in parts]
        starts = self._starts(parts_codes, part_starts)
        # distinct words, as slices of the bytes
        width = 1 + (parts_codes > 0x7F) + (parts_codes > 0x7FF) + (parts_codes > 0xFFFF)
        before = np.concatenate([[0], np.cumsum(width)])
        borders = np.append(before[starts], before[-1])
        data = pa.py_buffer("".join(parts).encode("utf-8", "surrogatepass"))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(borders.astype(np.int64)), data]).dictionary_encode()
        which = words.indices.to_numpy()
        sample = np.zeros(len(words.dictionary), dtype=np.int64)
        sample[which[::-1]] = np.arange(len(which))[::-1]
        word_sizes = np.diff(np.append(starts, len(parts_codes)))
        sizes = word_sizes[sample]
        symbols, counts, _ = self._rounds(parts_codes[spread_ranges(starts[sample], sizes)], sizes)
        ids, counts = self._with_bytes(symbols, counts)
        firsts = np.cumsum(counts) - counts
        flat = ids[spread_ranges(firsts[which], counts[which])]
        ends = np.cumsum(counts[which])
        last_words = np.searchsorted(starts, part_ends, side="left")
        return np.split(flat, ends[last_words - 1][:-1]) if len(parts) > 1 else [flat]

    def _with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols; characters that are no piece become their bytes."""
        odd = symbols >= self.size
        if not odd.any():
            return symbols.astype(np.int64), counts
        code, back = np.unique(symbols[odd] - self.size, return_inverse=True)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in code]
        width = np.array([len(s) for s in spelled])
        bytes_of = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        each = np.ones(len(symbols), dtype=np.int64)
        each[odd] = width[back]
        out = np.repeat(symbols.astype(np.int64), each)
        out[np.repeat(odd, each)] = bytes_of[spread_ranges((np.cumsum(width) - width)[back], width[back])]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, weights=each, minlength=len(counts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with begin and end."""
        cut = [list(self._parts(t)) for t in texts]
        flat = [p for parts in cut for p in parts]
        found: list[np.ndarray] = []
        at = size = 0
        for i, part in enumerate(flat):
            size += len(part)
            if size >= MOST_CHARS or i + 1 == len(flat):
                found += self.encode_parts(flat[at : i + 1])
                at, size = i + 1, 0
        rest = iter(found)
        begin, end = np.array([self.begin]), np.array([self.end])
        return [np.concatenate([begin, *(next(rest) for _ in parts), end]) for parts in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of a sequence of ids in UTF-8, gathered from the offset table at once.

        The space in front goes. Bytes that are no UTF-8 become U+FFFD each.
        """
        texts = ids[~self.is_control[ids]]
        drop = int(len(texts) > 0 and self.spaced[texts[0]])
        data = self.blob[spread_ranges(self.offsets[ids], self.lengths[ids])].tobytes()[drop:]
        try:
            data.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)[drop:]
        # a control piece parts runs of bytes, which are decoded each
        parted = len(ids) > 2 and self.is_control[ids[1:-1]].any()
        return self._decode_broken(ids)[drop:] if parted else data

    def _decode_broken(self, ids: np.ndarray) -> bytes:
        """Text in which some run of bytes is no UTF-8."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + width]).decode().encode())
                    except UnicodeDecodeError:
                        continue
                    at += width
                    break
                else:
                    out.append("�".encode())
                    at += 1
            run.clear()

        for i in ids.tolist():
            piece = self.blob[self.offsets[i] : self.offsets[i] + self.lengths[i]].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                flush()
                out.append(piece)
        flush()
        return b"".join(out)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceBpe:
    """The encoder of a vocabulary file, built once per Python worker."""
    return PieceBpe(path)


def piece_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Equal to the sentencepiece library with the vocabulary file *path*, which every executor
    must see, with begin and end ids and without sampling. The digests are over the ids as
    little-endian unsigned 32-bit numbers and over the decoded text. Null and empty texts
    have the begin and the end only. Texts are encoded in blocks, and very long ones in parts
    cut before a space, which bounds the memory of a worker; a text of one endless word is
    one part. Repeated rows get equal results; extra columns are ignored. There is no shuffle.
    """
    rows = keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_encoder(path)
        for batch in batches:
            for block in blocks(batch):
                found = bpe.encode(block.column("text").to_pylist())
                columns = [
                    block.column("doc_id"),
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in found], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in found], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(encode, schema)
