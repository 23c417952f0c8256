"""Language identification: scripts narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import blocks, keyed

#: Hashed letter triples per language: bounds the model at 2^16 numbers a language.
BUCKETS = 1 << 16
#: Natural-log penalty for a change of language between two words.
SWITCH = 12.0
#: Natural-log penalty of a language that isn't written in a word's script.
WRONG_SCRIPT = 25.0
#: A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 1e-3
SMOOTHING = 0.5

# Code point ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "burmese": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS)


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (0 if it is no letter or mark), and its script.

    Marks may go on a word but are no letters.
    """
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
    script = np.full(0x110000, OTHER, dtype=np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            script[low : high + 1] = k
    return lower, script


@lru_cache(maxsize=1)
def marks() -> np.ndarray:
    """Which code points are marks."""
    return np.array([unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)], dtype=bool)


class Words:
    """The words (runs of letters) of some texts: where they are and the hashed triples around each letter."""

    def __init__(self, texts: list[str]):
        lower, scripts = letters()
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        small = lower[points]
        inside = small > 0
        mark = marks()[points]
        if mark.any():  # a run of marks alone is no word
            runs = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
            bare = np.flatnonzero(np.add.reduceat(inside & ~mark, runs[0::2], dtype=np.int64) == 0)
            change = np.zeros(len(points) + 1, dtype=np.int64)
            change[runs[0::2][bare]] += 1
            change[runs[1::2][bare]] -= 1
            inside &= np.cumsum(change)[:-1] == 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.begins, self.ends = edges[0::2], edges[1::2]
        self.owner = np.searchsorted(self.starts, self.begins, side="right") - 1
        self.script = scripts[points[self.begins]] if len(self.begins) else np.zeros(0, dtype=np.uint8)
        at = np.flatnonzero(inside)
        padded = np.concatenate([[0], small, [0]]).astype(np.uint64)
        with np.errstate(over="ignore"):
            triple = (padded[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (padded[at + 2] * np.uint64(0x165667B19E3779F9))
            triple = (triple ^ (triple >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.triples = (triple >> np.uint64(48)).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.ends - self.begins)[:-1]]) if len(self.begins) else np.zeros(0, dtype=np.int64)
        self.letter_script = scripts[points[at]]
        self.letter_owner = np.repeat(self.owner, self.ends - self.begins)


def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of triples (kind 0) and of scripts (kind 1) by language, summed over the partition."""
    triples: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for block in blocks(batch):
            words = Words(block.column("text").to_pylist())
            langs = np.array(block.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                mine = (langs == lang)[words.letter_owner]
                triples.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                scripts.setdefault(lang, np.zeros(OTHER + 1, dtype=np.int64))
                triples[lang] += np.bincount(words.triples[mine], minlength=BUCKETS)
                scripts[lang] += np.bincount(words.letter_script[mine], minlength=OTHER + 1)
    for kind, tables in ((0, triples), (1, scripts)):
        for lang, counts in tables.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at), pa.array(counts[at])],
                names=["lang", "kind", "bucket", "n"],
            )


class LanguageModel:
    """Triple log-probabilities and script candidates of each language, in order of name."""

    def __init__(self, langs: list[str], triples: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = triples.sum(axis=1, keepdims=True)
        # bucket by language, so that one lookup gives all languages
        self.logs = np.ascontiguousarray(np.log((triples + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.written = (share >= SCRIPT_SHARE).T  # script by language
        self.common = int(np.argmax(total[:, 0])) if langs else -1


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Model from all rows with a language. Counts are summed per partition, then by Spark.

    The driver gets at most BUCKETS numbers per language.
    """
    rows = keyed(docs, id_col, text_col, F.col(lang_col).alias("lang")).where("lang is not null").select("lang", "text")
    counted = rows.mapInArrow(count_triples, "lang string, kind int, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    langs = sorted(found["lang"].unique())
    triples, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), OTHER + 1))
    place = {lang: k for k, lang in enumerate(langs)}
    which = found["lang"].map(place).to_numpy(dtype=np.int64)
    for kind, table in ((0, triples), (1, scripts)):
        mine = (found["kind"] == kind).to_numpy()
        table[which[mine], found["bucket"].to_numpy()[mine]] = found["n"].to_numpy()[mine]
    return LanguageModel(langs, triples, scripts)


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. Document d has the words starts[d] : starts[d + 1].

    All documents advance together, the long ones alone at the end.
    """
    counts = np.diff(starts)
    order = np.argsort(-counts, kind="stable")
    first, counts = starts[:-1][order], counts[order]
    active = np.searchsorted(-counts, -np.arange(int(counts[0]) if len(counts) else 0), side="left")
    stays = np.zeros(scores.shape, dtype=bool)
    before = np.zeros(len(scores), dtype=np.int16)
    value = np.zeros((len(counts), scores.shape[1]), dtype=np.float32)
    for t, k in enumerate(active):
        at = first[:k] + t
        best = value[:k].max(axis=1)
        before[at] = value[:k].argmax(axis=1)
        changed = (best - penalty)[:, None] if t else best[:, None]
        stays[at] = value[:k] >= changed
        value[:k] = np.maximum(value[:k], changed) - best[:, None] + scores[at]
    labels = np.zeros(len(scores), dtype=np.int16)
    label = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at, now = first[:k] + t, label[:k]
        labels[at] = now
        label[:k] = np.where(stays[at, now], now, before[at])
    return labels


def label_words(words: Words, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each word, and whether its script told anything."""
    candidates = model.written[words.script]
    known = candidates.any(axis=1)
    scores = np.add.reduceat(model.logs[words.triples], words.firsts, axis=0)
    scores = np.where(known[:, None], scores - scores.max(axis=1, keepdims=True) - WRONG_SCRIPT * ~candidates, 0).astype(np.float32)
    starts = np.searchsorted(words.owner, np.arange(len(words.starts)))
    return viterbi(scores, starts, SWITCH), known


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and spans of every document: doc_id, lang_pred, score, spans.

    spans lists the runs of words of one language (start and end in characters, lang);
    lang_pred is the language with most letters in them, the first by name of equals;
    score is its share of the letters. A text without a letter (null and empty ones
    too) is `und` with score 0 and no span, and so is every text if nothing was learned.
    A word in a script that no learned language uses says nothing: a text of only such
    words gets the language with most training letters, at score 0. Rows are judged one
    by one, extra columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS numbers a language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_model = shared.value
        langs = np.array([*known_model.langs, "und"], dtype=object)
        count = len(known_model.langs)
        for batch in batches:
            for block in blocks(batch):
                words, n = Words(block.column("text").to_pylist()), block.num_rows
                spans: list[list[dict]] = [[] for _ in range(n)]
                best, score = np.full(n, count), np.zeros(n)
                if count and len(words.begins):
                    labels, told = label_words(words, known_model)
                    size = (words.ends - words.begins).astype(np.float64)
                    weight = np.bincount(words.owner * count + labels, weights=size * told, minlength=n * count).reshape(n, count)
                    total = np.bincount(words.owner, weights=size, minlength=n)
                    best = np.where(total > 0, np.where(weight.max(axis=1) > 0, weight.argmax(axis=1), known_model.common), count)
                    score = weight.max(axis=1) / np.maximum(total, 1)
                    new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (words.owner[1:] != words.owner[:-1])]))
                    last = np.concatenate([new[1:], [len(labels)]]) - 1
                    base = words.starts[words.owner[new]]
                    for d, s, e, l in zip(words.owner[new].tolist(), (words.begins[new] - base).tolist(), (words.ends[last] - base).tolist(), labels[new].tolist(), strict=True):
                        spans[d].append({"start": s, "end": e, "lang": langs[l]})
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array(langs[best].tolist(), pa.string()), pa.array(score, pa.float64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")
