"""Token ids in Arrow files of equal-length sequences with masks, and random access to them."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import blocks, keyed
from labelloom.session import materialize, scratch_path

#: Ids per sequence, and sequences per record batch of a file.
SEQUENCE = 2048
BATCH = 256
#: Entries of the word cache of a Python worker; a full cache is emptied.
MOST_WORDS = 600_000

LETTERS_SIGNS = re.compile(rb"([a-z]+)([!-/:-@\[-`{-~]+)")


@lru_cache(maxsize=2)
def word_encoder(path: str):
    """Encodes texts word by word, as no id of the vocabulary spans ASCII white space."""
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(path), {}
    tokenizer.no_truncation()
    tokenizer.no_padding()
    size = tokenizer.get_vocab_size(with_added_tokens=True)

    closing = np.zeros(size, dtype=bool)  # the last token of a piece
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        closing[i] = token.endswith("</w>")

    def learn(words: list[bytes]) -> None:
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            for word, found in zip(some, tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                known[word] = array("I", found.ids).tobytes()

    def learn_pieces(pieces: list[bytes]) -> None:
        """Pieces are encoded many at a time, as each ends with a closing token."""
        groups = [pieces[at : at + 500] for at in range(0, len(pieces), 500)]
        found = tokenizer.encode_batch_fast([b" ".join(g).decode("ascii") for g in groups], add_special_tokens=False)
        for group, ids in zip(groups, (np.array(f.ids, dtype="<u4") for f in found), strict=True):
            ends = 4 * (np.flatnonzero(closing[ids]) + 1)
            if len(ends) != len(group):
                learn(group)
                continue
            raw, start = ids.tobytes(), 0
            for piece, end in zip(group, ends.tolist(), strict=True):
                known[piece] = raw[start:end]
                start = end

    def encode(texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if len(known) >= MOST_WORDS:
            known.clear()
        raw = [text.encode("utf-8", "surrogatepass") for text in texts]
        # the vocabulary is of lower case, but for the strings of special tokens
        split = [(text if b"<|" in text else text.lower()).split() for text in raw]
        pieces, parts, others = set(), [], []
        for word in set().union(*split).difference(known):
            if word.isalpha() and word.islower():
                pieces.add(word)
            elif m := LETTERS_SIGNS.fullmatch(word):
                # letters and the signs after them are pieces of their own
                parts.append((word, *m.groups()))
                pieces.update(m.groups())
            else:
                others.append(word)
        learn_pieces(list(pieces.difference(known)))
        for word, letters, signs in parts:
            known[word] = known[letters] + known[signs]
        learn(others)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    return encode, size


def file_schema(kind: pa.DataType, sequence: int) -> pa.Schema:
    """Schema of a token file: sequences of ids, padded with 0, and which places are filled."""
    return pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class SequenceWriter:
    """Packs a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, kind: pa.DataType, sequence: int, batch: int):
        self.schema, self.kind, self.sequence, self.step = file_schema(kind, sequence), kind, sequence, sequence * batch
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.step:
            ids = np.concatenate(self.rest)
            whole = len(ids) // self.step * self.step
            for at in range(0, whole, self.step):
                self.write(ids[at : at + self.step])
            self.rest, self.held = [ids[whole:]], len(ids) - whole

    def write(self, ids: np.ndarray) -> None:
        filled, rows = len(ids), -(-len(ids) // self.sequence)
        padded = np.zeros(rows * self.sequence, dtype=ids.dtype)
        padded[:filled] = ids
        mask = np.arange(len(padded)) < filled
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.sequence) for v in (padded, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.written += filled

    def close(self) -> None:
        if self.held:
            self.write(np.concatenate(self.rest))
        self.writer.close()


class TokenFile:
    """Random access to the ids of one file, by position in its stream, without copying whole batches.

    A local file is mapped into memory; batches of other stores are read when needed.
    """

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.kind = self.reader.schema.field("ids").type.value_type.to_pandas_dtype()
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def batch(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.last = (k, self.reader.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.last[1]

    def sequence_at(self, row: int) -> np.ndarray:
        """One sequence, as a view of the file."""
        return self.batch(row // self.rows)[row % self.rows * self.sequence :][: self.sequence]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a position; a view unless they lie in several batches."""
        step, parts = self.rows * self.sequence, []
        while n:
            ids = self.batch(start // step)[start % step :][:n]
            parts.append(ids)
            start, n = start + len(ids), n - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=self.kind)

    def close(self) -> None:
        self.source.close()


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, sequence: int = SEQUENCE, batch: int = BATCH,
) -> DataFrame:
    """Encode all documents into token files below *path*; returns their index.

    Documents are dealt out by ranges of ascending id; each range becomes one Arrow file
    of fixed-size lists: its ids in order, end_id after each document, packed without
    gaps into equal sequences, the last one padded and masked. Ids are stored as 16-bit
    numbers if the vocabulary allows. A file appears under its name when it is whole; a
    repeated task writes another one, and the index names only files whose rows it holds
    (others below *path* belong to no row). Rows of one id, and those without, are in the
    order of a hash of their texts, so reruns agree. *path* is a URI that all executors reach.

    The index, itself written to the shared folder, has a row per document: doc_id, file,
    position (in the file), n_tokens (with the end), start (ids of all documents before
    it, null ids first). Null and empty texts hold just the end; repeated rows are stored
    each; extra columns are ignored; an empty table gives an empty index.
    """
    rows = keyed(docs, id_col, text_col)
    kind_of_id = dict(rows.dtypes)["doc_id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = word_encoder(vocabulary)
        kind, dtype = (pa.uint16(), np.uint16) if size <= 1 << 16 else (pa.uint32(), np.uint32)
        part = TaskContext.get().partitionId()
        # each attempt writes a file of its own; the index names the one whose rows it holds
        own = f"ids-{part:06d}-{TaskContext.get().taskAttemptId()}.arrow"
        name = f"{path}/{own}"
        writer = sink = None
        position = 0
        for rows_of in batches:
            for block in blocks(rows_of):
                if writer is None:
                    system, place = fs.FileSystem.from_uri(path)
                    system.create_dir(place, recursive=True)
                    partial = f"{place}/.{own}"
                    sink = system.open_output_stream(partial)
                    writer = SequenceWriter(sink, kind, sequence, batch)
                ids = [np.append(np.frombuffer(x, dtype="<u4"), np.uint32(end_id)).astype(dtype) for x in encode(block.column("text").to_pylist())]
                counts = np.array([len(x) for x in ids], dtype=np.int64)
                writer.add(np.concatenate(ids))
                starts = position + np.cumsum(counts) - counts
                position += int(counts.sum())
                n = block.num_rows
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array([name] * n, pa.string()), pa.array(np.full(n, part, dtype=np.int64)), pa.array(starts), pa.array(counts)],
                    names=["doc_id", "file", "part", "position", "n_tokens"],
                )
        if writer is not None:
            writer.close()
            sink.close()
            system.move(partial, f"{place}/{own}")

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    index = materialize(ordered.mapInArrow(write, f"doc_id {kind_of_id}, file string, part long, position long, n_tokens long"), "token-index")
    # one row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    return index.join(files, "part").select("doc_id", "file", "position", "n_tokens", (F.col("before") + F.col("position")).alias("start"))


def read_token_files(index: DataFrame) -> DataFrame:
    """Checksum of the stored ids of each row of an index, read back from the files.

    Adds ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit numbers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for rows in batches:
            sums = []
            for path, position, n in zip(rows.column("file").to_pylist(), rows.column("position").to_pylist(), rows.column("n_tokens").to_pylist(), strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, TokenFile(path)
                sums.append(zlib.crc32(file.ids(position, n).astype("<u4").tobytes()))
            yield rows.append_column("ids_crc32", pa.array(sums, pa.int64()))
        if file is not None:
            file.last = (-1, np.zeros(0))
            file.close()

    return index.mapInArrow(read, index.schema.simpleString()[7:-1] + ",ids_crc32:bigint")


def token_folder(spark) -> str:
    """A fresh folder for token files in the shared folder, as a URI."""
    path = scratch_path(spark, "token-files")
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path
