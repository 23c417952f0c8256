"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over all words of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import blocks, keyed, mixed, segment_hashes
from labelloom.session import materialize

#: The classifier is fitted on at most this many labelled rows (those first in a hashed order).
SAMPLE_ROWS = 3_000
PART = 5
NEIGHBOURS = 31
#: A term's idf is multiplied by (chi / (chi + MIDDLE_CHI))^2 + LEAST_FACTOR of its chi-square with the label.
MIDDLE_CHI = 30.0
LEAST_FACTOR = 0.01
#: Examples that share one largest weight per term.
BLOCK = 32
#: Terms of more than this share of the examples are multiplied block by block, others have postings.
HEAD_SHARE = 0.1
#: Queries that are searched for at a time.
QUERIES = 64
THRESHOLD = 0.3
PART_FACTORS = mixed(np.arange(1, PART + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def word_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of lower-cased texts in a row, and first letter and text of each word (a run of letters)."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
    for v in np.flatnonzero(np.bincount(codes)).tolist():
        kinds[v] = (c := chr(v)).isalnum() and not c.isdecimal()
    letter = kinds[codes]
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    owners = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return codes[letter], np.cumsum(letter)[starts] - 1, owners


def distinct_words(letters: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word among the distinct ones, and first letter and length of these."""
    lengths = np.diff(np.append(firsts, len(letters)))
    width = 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(width)])[np.append(firsts, len(letters))]
    data = pa.py_buffer(letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
    words = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(offsets.astype(np.int64)), data]).dictionary_encode()
    which = words.indices.to_numpy()
    sample = np.zeros(len(words.dictionary), dtype=np.int64)
    sample[which[::-1]] = np.arange(len(which))[::-1]
    return which, firsts[sample], lengths[sample]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start ... start + length - 1 of every range, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms (64-bit hashes) of distinct words, owner word of each, and the word and text of each occurrence.

    The terms of a word are the word itself and its parts of PART letters, each once.
    """
    letters, firsts, owners = word_runs(texts)
    if not len(firsts):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    which, starts, lengths = distinct_words(letters, firsts)
    at = ranges(starts, lengths)
    own = letters[at].astype(np.uint64)
    ends = np.cumsum(lengths)
    # whole words: hashed over the four bytes of each letter
    data = np.ascontiguousarray(letters[at].astype("<u4")).view(np.uint8)
    whole = segment_hashes(data, (ends - lengths) * 4, ends * 4)
    parts = np.maximum(lengths - PART + 1, 0)
    begin = ranges(ends - lengths, parts)
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(begin), dtype=np.uint64)
        for j in range(PART):
            hashes += own[begin + j] * PART_FACTORS[j]
    word = np.concatenate([np.arange(len(starts)), np.repeat(np.arange(len(starts)), parts)])
    terms = np.concatenate([whole, mixed(hashes)])
    order = np.lexsort((terms, word))
    word, terms = word[order], terms[order]
    first = np.concatenate([[True], (word[1:] != word[:-1]) | (terms[1:] != terms[:-1])])
    return terms[first], word[first], which, owners


def text_vectors(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers and counts of the terms of each text that are in the sorted *table*; numbers ascend within a text."""
    terms, word, which, owners = term_counts(texts)
    at = np.minimum(np.searchsorted(table, terms), max(len(table) - 1, 0))
    known = table[at] == terms if len(table) else np.zeros(len(terms), dtype=bool)
    at, word = at[known], word[known]
    words = int(which.max()) + 1 if len(which) else 0
    number = np.bincount(word, minlength=words)
    firsts = np.cumsum(number) - number
    # a word that occurs often in a text is taken once, with its count
    pair, times = np.unique(owners * max(words, 1) + which, return_counts=True)
    text, word = np.divmod(pair, max(words, 1))
    found = at[ranges(firsts[word], number[word])]
    key = np.repeat(text, number[word]) * max(len(table), 1) + found
    order = np.argsort(key, kind="stable")
    key, each = key[order], np.repeat(times, number[word])[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    counts = np.add.reduceat(each, first) if len(first) else np.zeros(0, dtype=np.int64)
    text, found = np.divmod(key[first], max(len(table), 1))
    return np.searchsorted(text, np.arange(len(texts) + 1)), found, counts


def known_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a labelled sample (label, text), sorted, and the factor of each by its label.

    The sample bounds their number. Factors are above 0, so that every term counts.
    Copies of a text count once for them, as all their words would look alike.
    """
    sample = sample.select("label", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                label = np.array(block.column("label").to_pylist(), dtype=np.int64)
                terms, word, which, owners = term_counts(block.column("text").to_pylist())
                table, number = np.unique(terms, return_inverse=True)
                amount = np.bincount(word, minlength=int(which.max(initial=-1)) + 1)
                firsts = np.cumsum(amount) - amount
                pair = np.unique(owners * max(len(amount), 1) + which)
                text, word = np.divmod(pair, max(len(amount), 1))
                at = number[ranges(firsts[word], amount[word])]
                key = np.unique(np.repeat(text, amount[word]) * max(len(table), 1) + at)
                text, at = np.divmod(key, max(len(table), 1))
                n = np.bincount(at, minlength=len(table))
                toxic = np.bincount(at, weights=label[text], minlength=len(table)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(table.view(np.int64)), pa.array(n), pa.array(toxic)], names=["term", "n", "toxic"])

    total = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    counted = sample.mapInArrow(count, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    terms = counted.column("term").to_numpy().view(np.uint64)
    n, toxic = (counted.column(c).to_numpy().astype(np.float64) for c in ("n", "toxic"))
    base = (total["toxic"] or 0) / max(total["n"], 1)
    chi = (toxic - n * base) ** 2 / np.maximum(n * base * (1 - base), 1e-300) if 0 < base < 1 else np.zeros(len(n))
    order = np.argsort(terms)
    return terms[order], ((chi / (chi + MIDDLE_CHI)) ** 2 + LEAST_FACTOR)[order]


def document_frequencies(rows: DataFrame, table: Broadcast, terms: int) -> tuple[int, np.ndarray]:
    """Number of texts, and of those with each term of the table, summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 1, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch):
                _, found, _ = text_vectors(block.column("text").to_pylist(), table.value)
                total[:-1] += np.bincount(found, minlength=terms)
                total[-1] += block.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    counted = rows.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms + 1)
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return int(out[-1]), out[:-1]


class BlockMaxIndex:
    """Inverted index of unit vectors with the largest weight of each frequent term in each block of vectors.

    Rare terms have postings, which are added up first. Frequent terms, whose weights are
    small, are kept as a matrix in blocks of BLOCK vectors, ordered so that a block holds like
    ones, with the largest weight of each term in the block as a byte, rounded up, and the
    greatest length of their parts of the vectors. Both bound what a block's frequent terms
    can add to a cosine. A block is read for a query only if its best sum and that bound reach
    the k-th best sum so far. So results are exact, in double precision.
    """

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray, number: int):
        lengths = np.asarray(lengths, dtype=np.int64)
        self.size = len(lengths)
        owner = np.repeat(np.arange(self.size), lengths)
        frequent = np.flatnonzero(np.bincount(terms, minlength=number) > HEAD_SHARE * self.size)
        self.head = np.full(number, -1, dtype=np.int64)
        self.head[frequent] = np.arange(len(frequent))
        in_head = self.head[terms] >= 0
        # like vectors share their heaviest frequent term
        leading = np.full(self.size, -1)
        order = np.lexsort((weights[in_head], owner[in_head]))
        leading[owner[in_head][order]] = terms[in_head][order]  # the last one written is the heaviest
        self.original = np.argsort(leading, kind="stable")
        self.place = np.empty(self.size, dtype=np.int64)
        self.place[self.original] = np.arange(self.size)
        owner = self.place[owner]
        self.blocks = -(-self.size // BLOCK)
        self.matrix = np.zeros((self.blocks * BLOCK, len(frequent)))
        self.matrix[owner[in_head], self.head[terms[in_head]]] = weights[in_head]
        shaped = self.matrix.reshape(self.blocks, BLOCK, len(frequent))
        self.most = np.ceil(np.minimum(shaped.max(axis=1), 1.0) * 255).astype(np.uint8)
        self.longest = np.sqrt((shaped**2).sum(axis=2)).max(axis=1, initial=0.0)
        rare = np.flatnonzero(~in_head)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        self.postings, self.values = owner[rare], weights[rare]
        self.pointer = np.searchsorted(terms[rare], np.arange(number + 1))
        self.read = self.asked = 0  # blocks read for a query, and blocks times queries

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k vectors of highest cosine above 0, ties to the lower number, and their cosines."""
        return self.nearest_of(np.array([0, len(terms)]), terms, weights, k)[0]

    def nearest_of(
        self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` for several queries; *without* has a vector for each that is left out."""
        out = []
        for low in range(0, len(starts) - 1, QUERIES):
            some = starts[low : low + QUERIES + 1]
            part = slice(some[0], some[-1])
            out += self._nearest(some - some[0], terms[part], weights[part], k, None if without is None else self.place[without[low : low + QUERIES]])
        return out

    def _nearest(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        queries, width = len(starts) - 1, self.blocks * BLOCK
        if not self.size:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * queries
        owner = np.repeat(np.arange(queries), np.diff(starts))
        column = self.head[terms]
        rare = column < 0
        low, lengths = self.pointer[terms[rare]], self.pointer[terms[rare] + 1] - self.pointer[terms[rare]]
        read = ranges(low, lengths)
        at = self.postings[read] + np.repeat(owner[rare] * width, lengths)
        scores = np.bincount(at, self.values[read] * np.repeat(weights[rare], lengths), queries * width).astype(np.float64).reshape(queries, width)
        asked = np.zeros((queries, self.matrix.shape[1]))
        asked[owner[~rare], column[~rare]] = weights[~rare]
        if without is not None:
            scores[np.arange(queries), without] = -np.inf
        bound = np.minimum(asked @ (self.most.T / 255.0), np.sqrt((asked**2).sum(axis=1))[:, None] * self.longest)
        reach = scores.reshape(queries, self.blocks, BLOCK).max(axis=2) + bound + 1e-9
        done = np.zeros((queries, self.blocks), dtype=bool)
        self.asked += done.size
        # the blocks that reach highest first, which raises the k-th best sum for the others
        order = np.argsort(-reach, axis=1, kind="stable")
        first = min(self.blocks, max(1, -(-2 * k // BLOCK)))
        for wanted in (order[:, :first], order[:, first:]):
            kth = np.partition(scores, width - k, axis=1)[:, width - k] if k < width else np.full(queries, -np.inf)
            need = np.zeros((queries, self.blocks), dtype=bool)
            np.put_along_axis(need, wanted, True, axis=1)
            need &= reach >= np.maximum(kth, 1e-300)[:, None]
            for b in np.flatnonzero(need.any(axis=0)).tolist():
                rows = np.flatnonzero(need[:, b])
                scores[rows, b * BLOCK : (b + 1) * BLOCK] += asked[rows] @ self.matrix[b * BLOCK : (b + 1) * BLOCK].T
            done |= need
        self.read += int(done.sum())
        # unread blocks hold none of the best
        scores[~np.repeat(done, BLOCK, axis=1)] = -np.inf
        kth = np.partition(scores, width - k, axis=1)[:, width - k] if k < width else np.full(queries, -np.inf)
        out = []
        for i in range(queries):
            some = np.flatnonzero(scores[i] >= max(kth[i] - 1e-9, 1e-300))
            some = some[some < self.size]
            cosine, number = np.round(scores[i][some], 12), self.original[some]
            top = np.lexsort((number, -cosine))[:k]
            out.append((number[top], cosine[top]))
        return out


def unit_weights(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Weights (1 + log count) * factor of the vectors, each of length 1."""
    weights = (1 + np.log(counts)) * factor[terms]
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    norm = np.sqrt(np.bincount(owner, weights**2, len(starts) - 1))
    return weights / np.maximum(norm[owner], 1e-300)


def merged_examples(lengths: list[int], terms: np.ndarray, counts: np.ndarray, ids: list, labels: list[int]) -> dict:
    """Examples with equal vectors as one, with votes, toxic votes and one id (those without a term too)."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    found: dict[bytes, list] = {}
    which = []
    for i in range(len(lengths)):
        key = np.concatenate([terms[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]]]).tobytes()
        votes = found.setdefault(key, [len(found), 0, 0, ids[i], i])
        votes[1] += 1
        votes[2] += labels[i]
        which.append(votes[0])
    rows = [v[4] for v in found.values()]
    own = np.diff(starts)[rows]
    read = ranges(starts[rows], own)
    return {
        "lengths": own, "terms": terms[read], "counts": counts[read], "which": np.array(which, dtype=np.int64),
        "votes": np.array([v[1] for v in found.values()], dtype=np.float64), "toxic": np.array([v[2] for v in found.values()], dtype=np.float64),
        "ids": [v[3] for v in found.values()],
    }


def vote(at: np.ndarray, cosine: np.ndarray, votes: np.ndarray, toxic: np.ndarray) -> float:
    """Share of toxic votes of the nearest examples *at*, weighted by the square of their cosine to the nearest one's."""
    weight = (cosine / cosine[:1]) ** 2
    # merged examples fill as many of the places as they are
    before = np.cumsum(votes[at]) - votes[at]
    number = np.clip(NEIGHBOURS - before, 0, votes[at])
    return float((weight * number * toxic[at] / votes[at]).sum() / (weight * number).sum())


def calibration(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone map of raw votes to rates of label 1: knots and values.

    Isotonic regression by sorting and pooling; each pool has one more row of the common
    rate, so that small ones don't reach 0 or 1. Values between pools are interpolated.
    """
    values, back = np.unique(raw, return_inverse=True)
    n = np.bincount(back, weights)
    toxic = np.bincount(back, weights * labels)
    rate = toxic.sum() / n.sum()
    pools: list[list[float]] = []  # rows, toxic rows, sum of raw votes
    for v, a, b in zip(values.tolist(), n.tolist(), toxic.tolist(), strict=True):
        pools.append([a, b, a * v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    knots = np.array([p[2] / p[0] for p in pools])
    smooth = np.array([(p[1] + rate) / (p[0] + 1) for p in pools])
    return knots, np.maximum.accumulate(smooth)


def index_of(model: Broadcast) -> dict:
    """The model of a broadcast with its index, built once per Python worker."""
    parts = model.value
    if "index" not in parts:
        starts = np.concatenate([[0], np.cumsum(parts["lengths"])])
        weights = unit_weights(starts, parts["terms"], parts["counts"], parts["factor"])
        parts["index"] = BlockMaxIndex(parts["lengths"], parts["terms"], weights, len(parts["factor"]))
    return parts


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "label", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The labels (with their id) that `score_toxicity` learns from: at most *sample_rows*, first in a hashed order.

    So their texts can be looked up by a join that broadcasts these few rows, without a shuffle of texts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.orderBy(F.xxhash64(F.lit(7), id_col), id_col, label_col).limit(sample_rows)


def score_toxicity(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Toxicity of every document: doc_id, score, predicted, raw and evidence.

    *labelled* holds ids, texts and labels (1: toxic). Terms and examples come from at
    most *sample_rows* of its rows, the bound of everything that reaches the driver. All
    their words and word parts count, more where they tell much about the label, and
    document frequencies come from all documents. raw is the share of toxic votes of the
    NEIGHBOURS nearest examples by exact cosine, weighted by its square relative to the
    nearest one's. score is raw mapped to the rate of label 1 among the examples themselves,
    each voted on by the other ones. evidence lists the nearest (id, cosine, share of toxic
    votes). A text without any word known to the sample (null and empty ones too) gets the
    common rate, without evidence. Rows with a null label or id are not learned from; repeated
    rows are scored each; without labels all scores are 0.5. Extra columns are ignored. Terms
    are told apart by 64-bit hashes.
    """
    rows = keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    known = keyed(labelled, id_col, text_col, F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    context = docs.sparkSession.sparkContext
    first = known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id", "text").limit(sample_rows)
    sample = materialize(first.repartition(context.defaultParallelism), "toxic-sample")
    terms, factor = known_terms(sample)
    table = context.broadcast(terms)  # the terms of at most sample_rows texts

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                starts, found, counts = text_vectors(block.column("text").to_pylist(), table.value)
                offsets = pa.array(starts.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (found, counts)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("label"), *lists], names=["doc_id", "label", "terms", "counts"])

    n_docs, frequency = document_frequencies(rows, table, len(terms))
    factor = factor * (np.log((1 + n_docs) / (1 + frequency)) + 0.1)
    vectors = sample.select("doc_id", "label", "text").mapInArrow(extract, f"doc_id {kind}, label int, terms array<int>, counts array<int>").toArrow().combine_chunks()
    vectors = vectors.sort_by("doc_id")
    lists = [vectors.column(c).combine_chunks() for c in ("terms", "counts")]
    flat = [(v.flatten() if len(v) else pa.array([], pa.int32())).to_numpy().astype(np.int64) for v in lists]
    labels = vectors.column("label").to_numpy().astype(np.int64)
    model = merged_examples([len(v) for v in lists[0].to_pylist()], *flat, vectors.column("doc_id").to_pylist(), labels.tolist())
    model["factor"] = factor
    model = context.broadcast(model)  # the vectors of at most sample_rows texts, a few bytes per term
    rate = (labels.sum() + 0.5) / (len(labels) + 1)

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = index_of(model)
        index, starts = parts["index"], np.concatenate([[0], np.cumsum(parts["lengths"])])
        weights = unit_weights(starts, parts["terms"], parts["counts"], parts["factor"])
        for batch in batches:
            i = batch.column("i").to_numpy()
            lengths = parts["lengths"][i]
            read = ranges(starts[i], lengths)
            near = index.nearest_of(np.concatenate([[0], np.cumsum(lengths)]), parts["terms"][read], weights[read], NEIGHBOURS, without=i)
            raw = [vote(at, cosine, parts["votes"], parts["toxic"]) if len(at) else None for at, cosine in near]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(raw, pa.float64())], names=["i", "raw"])

    examples = docs.sparkSession.range(len(model.value["ids"])).withColumnRenamed("id", "i").repartition(context.defaultParallelism)
    voted = examples.mapInArrow(leave_one_out, "i long, raw double").where("raw is not null").toArrow() if len(labels) else None
    if voted is not None and voted.num_rows:
        i = voted.column("i").to_numpy()
        n = model.value["votes"][i]
        knots, values = calibration(voted.column("raw").to_numpy(), model.value["toxic"][i] / n, n)
    else:
        knots, values = np.array([0.0]), np.array([rate])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = index_of(model)
        for batch in batches:
            for block in blocks(batch):
                starts, found, counts = text_vectors(block.column("text").to_pylist(), table.value)
                weights = unit_weights(starts, found, counts, parts["factor"])
                # equal vectors are searched for once
                keys = [found[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                number: dict[bytes, int] = {}
                which = np.array([number.setdefault(key, len(number)) for key in keys], dtype=np.int64)
                single = np.zeros(len(number), dtype=np.int64)
                single[which[::-1]] = np.arange(len(which))[::-1]
                lengths = np.diff(starts)[single]
                read = ranges(starts[single], lengths)
                near = parts["index"].nearest_of(np.concatenate([[0], np.cumsum(lengths)]), found[read], weights[read], NEIGHBOURS)
                results = []
                for at, cosine in near:
                    raw = vote(at, cosine, parts["votes"], parts["toxic"]) if len(at) else None
                    share = parts["toxic"][at[:5]] / parts["votes"][at[:5]]
                    listed = [{"doc_id": parts["ids"][j], "cosine": float(c), "toxic": float(t)} for j, c, t in zip(at[:5].tolist(), cosine[:5], share, strict=True)]
                    results.append((min(max(float(rate if raw is None else np.interp(raw, knots, values)), 0.0), 1.0), raw, listed))
                scores, raws, evidence = ([results[j][c] for j in which.tolist()] for c in range(3))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(raws, pa.float64()),
                     pa.array(evidence, pa.list_(pa.struct([("doc_id", block.schema.field("doc_id").type), ("cosine", pa.float64()), ("toxic", pa.float64())])))],
                    names=["doc_id", "score", "predicted", "raw", "evidence"],
                )

    return rows.mapInArrow(score, f"doc_id {kind}, score double, predicted int, raw double, evidence array<struct<doc_id:{kind},cosine:double,toxic:double>>")
