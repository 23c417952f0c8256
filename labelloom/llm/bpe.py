"""Byte-pair encoding by longest matches with backtracking, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from labelloom.llm.common import blocks, keyed

#: Entries of the caches of a Python worker; a full cache is emptied.
MOST_CHUNKS = 600_000
MOST_PAIRS = 1_000_000

#: The pattern that splits text before the merges (fixed value of the vocabulary).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Encoder and decoder of a byte-level vocabulary in the JSON format of the tokenizers library.

    Encoding never merges step by step. An Aho-Corasick automaton over all tokens gives
    the tokens that start at each byte of a piece. From the left the longest is taken
    that is compatible with the token before it; where none is, the last token is
    given up for its next shorter alternative. Positions found to lead nowhere are
    marked, so each is entered once per token and the time is linear. Two tokens are
    compatible if the merges never join something across their border. Then every
    adjacent pair is compatible only in the sequence that the merges produce.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        to_byte = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab, merges = config["model"]["vocab"], config["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            tokens[i] = raw(token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            tokens[i] = token.encode()
        # offset table: token i is blob[offsets[i] : offsets[i] + lengths[i]]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.decimals = [str(i) for i in range(size)]

        self.join: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, joined)
        self.parts: dict[int, tuple[int, int, int]] = {}  # joined -> (rank, left, right)
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.join.setdefault((a, b), (rank, c))
            self.parts.setdefault(c, (rank, a, b))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in self.special and (len(tokens[i]) == 1 or i in self.parts):
                self.automaton.add_word(tokens[i].decode("latin-1"), (len(tokens[i]), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.pattern = regex.compile(PIECE)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """A token and its parts along one edge, each with the rank at which it joins its whole."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.parts[token][0]
            token = self.parts[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether *left* and *right* stay apart when their bytes are merged together."""
        known = self.pairs.get((left, right))
        if known is None:
            # a join across the border happens if it comes before both parts are joined
            # inwards; of equal ranks the one further left comes first
            known = not any(
                (a, b) in self.join and self.join[a, b][0] < a_until and self.join[a, b][0] <= b_until
                for a, a_until in self.spine(left, 2) for b, b_until in self.spine(right, 1)
            )
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a piece."""
        n = len(piece)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(piece.decode("latin-1")):
            starting[end + 1 - match[0]].append(match)  # ends ascend, so matches do
        ids: list[int] = []
        tried: list[int] = []  # alternatives left at each token, as an index below its list
        dead = bytearray(n + 1)
        at, choice = 0, len(starting[0]) - 1
        while at < n:
            options = starting[at]
            while choice >= 0:
                length, token = options[choice]
                if not dead[at + length] and (not ids or self.compatible(ids[-1], token)):
                    break
                choice -= 1
            if choice >= 0:
                ids.append(token)
                tried.append(choice)
                at += length
                choice = len(starting[at]) - 1 if at < n else -1
            else:
                dead[at] = 1
                at -= int(self.lengths[ids.pop()])
                choice = tried.pop() - 1
        return ids

    def encode_part(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian 32-bit numbers."""
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return np.array(ids, dtype="<u4").tobytes()

    def encode_plain(self, text: str) -> bytes:
        """The same, over parts that begin at a space before a word; these are cached.

        A piece always begins at a space that is followed by something else than white
        space, so the parts between such spaces are encoded on their own.
        """
        if not text:
            return b""
        tight = not any(x in text for x in ("  ", " \n", " \t", " \r", " \v", " \f", "\x1c", "\x1d", "\x1e", "\x1f")) and text[-1] != " " and text.isascii()
        first, *later = text.split(" ") if tight else re.split(r" (?=\S)", text)
        for cache, parts, space in ((self.first, [first], ""), (self.later, later, " ")):
            if len(cache) >= MOST_CHUNKS:
                cache.clear()
            for part in set(parts).difference(cache):
                cache[part] = self.encode_part(space + part)
        return self.first[first] + b"".join(map(self.later.__getitem__, later))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the strings of special tokens become their ids."""
        if not self.special or not any(s in text for s in self.special):
            return np.frombuffer(self.encode_plain(text), dtype="<u4")
        parts = [
            np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self.encode_plain(p)
            for p in self.specials.split(text)
        ]
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, gathered from the offset table at once."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)].tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(others)}}


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, built once per Python worker."""
    return ByteBpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Equal to the tokenizers library with the vocabulary file *path*, which every
    executor must see: no special tokens are added, but their strings in a text are
    encoded as such. The digests are over the decimal ids joined by commas and over the
    decoded text; invalid sequences decode to U+FFFD. Null and empty texts have no
    tokens. Rows are encoded one by one, so repeated rows get equal results; extra
    columns are ignored. Memory per worker: one block of texts and bounded caches.
    """
    rows = keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for block in blocks(batch):
                out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                kept = []
                for text in block.column("text").to_pylist():
                    ids = bpe.encode(text)
                    decoded = bpe.decode(ids).decode("utf-8", "replace").encode("utf-8")
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids.tolist())).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                columns = [block.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.string()), strict=True))]
                names = ["doc_id", *out]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(encode, schema)
