"""Language-model scores: words under a smoothed unigram, texts under a subword lattice."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import blocks, joined_bytes, keyed, segment_hashes, word_spans
from labelloom.session import materialize

#: The most frequent words are sent to all tasks: at most this many, 24 bytes each.
MOST_SHARED = 500_000
#: Distinct words that a task holds before it passes its counts on.
MOST_HELD = 1_000_000
#: Training ends when a step raises the log-likelihood of a training token by less than this.
SETTLED = 0.01
#: Weight, in pieces, of the vocabulary's own scores against the counts.
PRIOR_PIECES = 1000.0
#: Words of one length that are worked on together.
CHUNK = 32_768
SPACE = 0x20  # stands for the mark of a word's beginning; no word holds it

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Vocabulary:
    """Pieces of a sentencepiece vocabulary with its scores, as a trie over bytes.

    Every byte is a piece too (the vocabulary's byte fallback), so all words have a
    segmentation. The scores of the file order the pieces; as prior probabilities they
    are read as ranks of a Zipf law.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            piece = bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            if piece.rfind(b" ") <= 0 and piece:
                scores[piece] = max(scores.get(piece, -1e18), -1e6 if model.is_byte(i) else model.get_score(i))
        for byte in range(256):
            scores.setdefault(bytes([byte]), -1e6)
        ranked = sorted(scores, key=lambda p: (-scores[p], p))
        self.pieces = len(ranked)
        weight = 1 / (np.arange(self.pieces) + 20.0)
        self.prior = np.log(weight / weight.sum())
        nodes: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, piece in enumerate(ranked):
            node = 0
            for byte in piece:
                if byte not in nodes[node]:
                    nodes[node][byte] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                node = nodes[node][byte]
            ends[node] = k
        self.child = np.zeros((len(nodes), 256), dtype=np.int32)
        for node, children in enumerate(nodes):
            for byte, other in children.items():
                self.child[node, byte] = other
        self.end = np.array(ends, dtype=np.int32)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, built once per Python worker."""
    return Vocabulary(path)


def word_matrices(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length: which they are, and their bytes after the mark, one row each."""
    lengths = ends - begins
    order = np.argsort(lengths, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(lengths[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, dtype=np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        n = int(lengths[order[low]])
        step = max(1, min(CHUNK, 4_000_000 // n))
        for at in range(low, high, step):
            some = order[at : min(high, at + step)]
            rows = np.full((len(some), n + 1), SPACE, dtype=np.uint8)
            rows[:, 1:] = data[begins[some][:, None] + np.arange(n)]
            yield some, rows


def lattice(rows: np.ndarray, vocab: Vocabulary, logs: np.ndarray, edges: list | None = None) -> np.ndarray:
    """Log-probability of each prefix of each word, over all its segmentations (forward recursion).

    *edges* gets what the backward recursion needs: (start, end, words, pieces).
    """
    count, n = rows.shape
    forward = np.full((n + 1, count), -np.inf)
    forward[0] = 0.0
    everyone = np.arange(count)
    for start in range(n):
        node, who = np.zeros(count, dtype=np.int32), everyone
        for end in range(start + 1, n + 1):
            node = vocab.child[node, rows[who, end - 1]]
            going = node > 0
            if not going.all():
                node, who = node[going], who[going]
            if not len(who):
                break
            piece = vocab.end[node]
            full = piece >= 0
            at, piece = (who, piece) if full.all() else (who[full], piece[full])
            if len(at):
                forward[end, at] = np.logaddexp(forward[end, at], forward[start, at] + logs[piece])
                if edges is not None:
                    edges.append((start, end, at, piece))
    return forward


def expected_pieces(rows: np.ndarray, weights: np.ndarray, vocab: Vocabulary, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected number of each piece in the words, each counted *weights* times, and their log-likelihood."""
    edges: list = []
    forward = lattice(rows, vocab, logs, edges)
    backward = np.full(forward.shape, -np.inf)
    backward[-1] = 0.0
    total, out = forward[-1], np.zeros(vocab.pieces)
    for start, end, at, piece in reversed(edges):
        inner = logs[piece] + backward[end, at]
        out += np.bincount(piece, weights=weights[at] * np.exp(forward[start, at] + inner - total[at]), minlength=vocab.pieces)
        backward[start, at] = np.logaddexp(backward[start, at], inner)
    return out, float((weights * total).sum())


def word_logs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, vocab: Vocabulary, logs: np.ndarray) -> np.ndarray:
    """Marginal log-probability of each word."""
    out = np.zeros(len(begins))
    for some, rows in word_matrices(data, begins, ends):
        out[some] = lattice(rows, vocab, logs)[-1]
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their numbers in training texts and in all texts, summed over the task."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []

    def merge() -> None:
        keys = np.concatenate([h[0] for h in held])
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([h[i] for h in held])).astype(np.int64) for i in (1, 2)]
        words = np.concatenate([np.array(h[3], dtype=object) for h in held])
        held[:] = [(keys[first], *sums, words[first].tolist())]

    def flush() -> Iterator[pa.RecordBatch]:
        _, train, every, words = held[0]
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[at : at + 50_000], pa.binary()), pa.array(train[at : at + 50_000]), pa.array(every[at : at + 50_000])], names=["word", "train", "every"]
            )
        held.clear()

    for batch in batches:
        for block in blocks(batch):
            data, starts = joined_bytes(block.column("text"))
            data = LOWER[data]
            begins, ends = word_spans(data)
            if not len(begins):
                continue
            owner = np.searchsorted(starts, begins, side="right") - 1
            learned = block.column("learned").to_numpy(zero_copy_only=False).astype(np.float64)[owner]
            keys, first, inverse = np.unique(segment_hashes(data, begins, ends), return_index=True, return_inverse=True)
            raw = data.tobytes()
            words = [raw[b:e] for b, e in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
            held.append((keys, np.bincount(inverse, weights=learned), np.bincount(inverse).astype(np.float64), words))
            if len(held) >= 6:
                merge()
                if len(held[0][0]) > MOST_HELD:
                    yield from flush()
    if held:
        merge()
        yield from flush()


def packed_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of words with their begins and ends."""
    parts = words.to_pylist()
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return data, np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(parts) else ends, ends


class PieceModel:
    """Log-probabilities of the pieces and of the end of a text."""

    def __init__(self, logs: np.ndarray, end: float):
        self.logs, self.end = logs, end


def learn_pieces(words: DataFrame, texts: int, path: str) -> PieceModel:
    """Piece probabilities by expectation-maximisation over all training words (word, train).

    The start is the prior of the vocabulary. A step sends one number per piece of the
    vocabulary to the driver. Steps end when the likelihood has settled; it never falls but
    for the prior's part, so they do end.
    """
    vocab = vocabulary(path)
    logs, end, before = vocab.prior, 0.0, -np.inf
    while True:
        shared = words.sparkSession.sparkContext.broadcast(logs)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # behind the pieces: the log-likelihood and the number of words
            known = vocabulary(path)
            total = np.zeros(known.pieces + 2)
            for batch in batches:
                data, begins, ends = packed_words(batch.column("word"))
                weights = batch.column("train").to_numpy(zero_copy_only=False).astype(np.float64)
                for some, rows in word_matrices(data, begins, ends):
                    pieces, likelihood = expected_pieces(rows, weights[some], known, shared.value)
                    total[:-2] += pieces
                    total[-2:] += likelihood, weights[some].sum()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        counts = np.zeros(vocab.pieces + 2)
        for row in words.where("train > 0").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[row["piece"]] = row["n"]
        (likelihood, seen), counts = counts[-2:], counts[:-2] + PRIOR_PIECES * np.exp(vocab.prior)
        total = counts.sum() + texts + 0.5
        logs, end = np.log(counts / total), float(np.log((texts + 0.5) / total))
        if likelihood - before < SETTLED * max(seen, 1.0):
            return PieceModel(logs, end)
        before = likelihood


def score_texts(docs: DataFrame, learned, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    *learned* is a column that tells the rows to learn from. Letters A-Z are lowered;
    the tokens of a text are its words and one end. base_score is the sum over the
    tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))), where c is the number of the token
    in the training rows, N the number of all and V of the distinct ones there. score is
    log10 of the probability of the text as a sequence of pieces and an end, summed over
    all segmentations of its words into pieces of the vocabulary file *path*; the piece
    probabilities are learned from all training words.

    The counts of all words are gathered by Spark. The MOST_SHARED most frequent words go
    to all tasks; pairs of a rarer word and a document meet in a shuffle by word, where
    no word has many rows, and come back as sums per document. Null and empty texts
    consist of the end; a null in *learned* counts as false; without training rows
    N = V = 0. Repeated rows count and are scored each; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col, F.coalesce(learned, F.lit(False)).alias("learned"))
    kind = dict(rows.dtypes)["doc_id"]
    words = materialize(
        rows.select("text", "learned").mapInArrow(count_words, "word binary, train long, every long")
        .groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every")),
        "lm-words",
    )
    texts = rows.where("learned").count()
    sums = words.agg(F.sum("train"), F.sum((F.col("train") > 0).cast("long"))).first()
    tokens, distinct = (sums[0] or 0) + texts, (sums[1] or 0) + (texts > 0)
    model = spark.sparkContext.broadcast(learn_pieces(words, texts, path))

    # the least frequency whose words are few enough
    sizes = words.groupBy(F.least("every", F.lit(100_000)).alias("f")).count().collect()
    least, room = 100_001, MOST_SHARED
    for row in sorted(sizes, key=lambda r: -r["f"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["f"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            data, begins, ends = packed_words(batch.column("word"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment_hashes(data, begins, ends).view(np.int64)), batch.column("train"), pa.array(word_logs(data, begins, ends, vocab, model.value.logs))],
                names=["h", "c", "logp"],
            )

    common = words.where(F.col("every") >= least).mapInArrow(weigh, "h long, c long, logp double").toPandas().sort_values("h")
    shared = spark.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("h", "c", "logp")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, logs = vocabulary(path), model.value.logs
        known_h, known_c, known_log = shared.value
        known_base = np.log10(known_c + 0.5)
        for batch in batches:
            for block in blocks(batch):
                n = block.num_rows
                data, starts = joined_bytes(block.column("text"))
                data = LOWER[data]
                begins, ends = word_spans(data)
                owner = np.searchsorted(starts, begins, side="right") - 1
                h, first, inverse = np.unique(segment_hashes(data, begins, ends).view(np.int64), return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known_h, h), max(len(known_h) - 1, 0))
                common_word = known_h[at] == h if len(known_h) else np.zeros(len(h), dtype=bool)
                logp, base, found = np.zeros(len(h)), np.zeros(len(h)), np.zeros(len(h))
                logp[common_word] = known_log[at[common_word]]
                base[common_word] = known_base[at[common_word]]
                found[common_word] = known_c[at[common_word]] > 0
                rare = ~common_word
                logp[rare] = word_logs(data, begins[first[rare]], ends[first[rare]], vocab, logs)
                sums = [np.bincount(owner, weights=v[inverse], minlength=n) for v in (logp, base, found)]
                mine = rare[inverse]
                pairs, times = np.unique(owner[mine] * np.int64(max(len(h), 1)) + inverse[mine], return_counts=True)
                offsets = np.searchsorted(pairs // max(len(h), 1), np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (h[pairs % max(len(h), 1)], times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("learned"), pa.array(np.bincount(owner, minlength=n)), *(pa.array(s) for s in sums), *lists],
                    names=["doc_id", "learned", "words", "logp", "base", "known", "rare", "times"],
                )

    texts_scored = materialize(
        rows.mapInArrow(score, f"doc_id {kind}, learned boolean, words long, logp double, base double, known double, rare array<long>, times array<int>")
        .withColumn("row", F.monotonically_increasing_id()),
        "lm-texts",
    )
    pairs = texts_scored.select("row", "learned", F.explode(F.arrays_zip("rare", "times")).alias("p")).select(
        F.col("p.rare").alias("h"), "row", F.when(F.col("learned"), F.col("p.times")).otherwise(-F.col("p.times")).alias("n")
    )
    # a rare word has fewer than *least* tokens, so its window is short
    counted = pairs.withColumn("c", F.expr("sum(greatest(n, 0)) OVER (PARTITION BY h)"))
    rest = counted.groupBy("row").agg(
        F.sum(F.abs("n") * F.log10(F.col("c") + 0.5)).alias("rest_base"), F.sum(F.when(F.col("c") > 0, F.abs("n")).otherwise(0)).alias("rest_known")
    )
    ends = texts
    below = float(np.log10(tokens + 0.5 * (distinct + 1)))
    n_tokens = F.col("words") + 1
    return texts_scored.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id",
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) + float(np.log10(ends + 0.5)) - n_tokens * below).alias("base_score"),
        ((F.col("logp") + float(model.value.end)) / float(np.log(10))).alias("score"),
    )
