"""Quality rules: counts of words and symbols, and the share of a text that repeats itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import blocks, joined_bytes, keyed, mixed, segment_hashes, word_spans

#: Share of the characters of words that may lie in n-grams found twice or more, by n.
NGRAM_LIMITS = {5: 0.30, 8: 0.25, 12: 0.20}
#: Share of the characters that may lie in lines equal to another line.
LINE_LIMIT = 0.40
LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, line_share double, " + ", ".join(f"share_{n} double" for n in NGRAM_LIMITS) + ", kept boolean"
)


def repeated(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their document."""
    keys = mixed(values + mixed(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Words inside a marked window of n words; windows are marked at their first word."""
    change = np.zeros(len(windows) + n, dtype=np.int32)
    at = np.flatnonzero(windows)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change[: len(windows)]) > 0


def window_hashes(words: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Polynomial hash of the n words from each position."""
    out, factor = np.zeros(len(at), dtype=np.uint64), np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * factor + words[at + j]
    return out


def measure(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """All figures for the texts in *data*, text d being data[starts[d] : starts[d + 1] - 1]."""
    docs = len(starts) - 1
    per_doc = lambda owner, weights=None: np.bincount(owner, weights=weights, minlength=docs)[:docs]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True

    begins, ends = word_spans(data)
    owner = np.searchsorted(starts, begins, side="right") - 1
    chars = heads[ends] - heads[begins]
    words = segment_hashes(data, begins, ends)

    breaks = np.flatnonzero(data == 10)
    line_begins = np.concatenate([[0], breaks[:-1] + 1])
    first_word = np.searchsorted(begins, line_begins)
    filled = first_word < np.searchsorted(begins, breaks)
    line_begins, line_ends = line_begins[filled], breaks[filled]
    line_owner = np.searchsorted(starts, line_begins, side="right") - 1
    lines = segment_hashes(data, line_begins, line_ends)
    again = repeated(line_owner, lines)
    distinct = np.unique(mixed(lines[again] + mixed(line_owner[again].astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    word_sums = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_sums[np.searchsorted(begins, line_ends)] - word_sums[np.searchsorted(begins, line_begins)]

    windows = np.zeros(len(words), dtype=bool)
    at = np.flatnonzero(owner[:-2] == owner[2:]) if len(words) > 2 else np.zeros(0, dtype=np.int64)
    windows[at[repeated(owner[at], window_hashes(words, 3, at))]] = True
    out = {
        "n_words": per_doc(owner), "word_chars": per_doc(owner, chars), "n_symbols": per_doc(np.searchsorted(starts, np.flatnonzero(symbol[data]), side="right") - 1),
        "n_dup_lines": per_doc(line_owner[again]) - per_doc(line_owner[again][distinct]),
        "n_repeat_words": per_doc(owner, covered(windows, 3)),
    }
    total = np.maximum(out["word_chars"], 1)
    out["line_share"] = per_doc(line_owner[again], line_chars[again]) / total
    for n in NGRAM_LIMITS:
        # a repeated n-gram begins and ends with a repeated window of three words
        longer = np.zeros(len(words), dtype=bool)
        if len(words) >= n:
            at = np.flatnonzero(windows[: len(words) - n + 1] & windows[n - 3 : len(words) - 2] & (owner[: len(words) - n + 1] == owner[n - 1 :]))
            longer[at[repeated(owner[at], window_hashes(words, n, at))]] = True
        out[f"share_{n}"] = per_doc(owner, chars * covered(longer, n)) / total
    return out


def rate_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            found = measure(*joined_bytes(block.column("text")))
            whole = {k: found[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            failed = (whole["n_words"] < LEAST_WORDS) | (100 * whole["n_repeat_words"] > 50 * whole["n_words"])
            shares = {k: found[k].astype(np.float64) for k in ["line_share", *(f"share_{n}" for n in NGRAM_LIMITS)]}
            fine = (shares["line_share"] <= LINE_LIMIT) & ~failed
            for n, most in NGRAM_LIMITS.items():
                fine &= shares[f"share_{n}"] <= most
            columns = {"doc_id": block.column("doc_id"), **whole, "base_failed": failed, **shares, "kept": fine}
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict for every document.

    Words are runs of other bytes than ASCII white space. n_symbols counts the
    characters of SYMBOLS; n_dup_lines the lines with a word that equal an earlier line;
    n_repeat_words the words inside three-word windows found twice or more; line_share
    and share_n the share of the characters of words inside lines, and inside n-grams,
    found twice or more. Repeats are found by 64-bit rolling hashes.

    base_failed: fewer than LEAST_WORDS words or over half of them repeated. kept: not
    base_failed, and no share above its limit. Null and empty texts have no words and
    are not kept. Each row is judged alone, so repeated rows get equal figures; extra
    columns are ignored. Work is cut into blocks of whole texts of bounded size.
    """
    rows = keyed(docs, id_col, text_col)
    return rows.mapInArrow(rate_texts, SCHEMA.format(id=dict(rows.dtypes)["doc_id"]))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = names[docs.columns.index(text_col)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                texts = pa.RecordBatch.from_arrays([pa.array(range(block.num_rows)), block.column(at).fill_null("")], names=["doc_id", "text"])
                verdict = pa.concat_arrays([b.column("kept") for b in rate_texts(iter([texts]))])
                yield block.filter(verdict)

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
