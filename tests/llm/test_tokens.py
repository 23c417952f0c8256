import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from labelloom.llm.bpe import ByteBpe, bpe_encode
from labelloom.llm.token_files import TokenFile, read_token_files, token_folder, write_token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def test_encoder_equals_library(library):
    bpe, draw = ByteBpe(BYTES), random.Random(5)
    letters = "abcdeehinorst  \n\t'lrevd.,0123éßñ　\x1c\u0085ſ漢🙂́ÀΣ<|>endoftext"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(3000)]
    texts += ["a" * 2000, "ab" * 900, "  " * 200, "<|endoftext|> <|endoftext|>", " \n x", "x \n  y "]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        found = bpe.encode(text)
        assert found.tolist() == ids, text
        assert bpe.decode(found).decode() == text


def test_decode_of_broken_sequences(library):
    bpe, draw = ByteBpe(BYTES), random.Random(6)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(draw.randrange(20))]
        assert bpe.decode(np.array(ids, dtype=np.int64)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_bpe_encode(awkward, nothing, library):
    found = bpe_encode(awkward, BYTES).collect()
    expected = Counter()
    for r in awkward.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in found) == expected
    assert bpe_encode(nothing, BYTES).count() == 0


@pytest.mark.parametrize(("sequence", "batch"), [(2048, 256), (7, 3)])
def test_token_files(spark, awkward, nothing, sequence, batch):
    library = Tokenizer.from_file(WORDS)
    index = write_token_files(awkward, token_folder(spark), WORDS, sequence=sequence, batch=batch)
    rows = sorted(read_token_files(index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in awkward.collect()), key=lambda i: (i is not None, i or 0))
    encoded = Counter()
    for r in awkward.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        encoded[r.doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == encoded
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    for path in {r.file for r in rows}:
        mine = [r for r in rows if r.file == path]
        file = TokenFile(path)
        table = file.reader.read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), sequence)
        assert sum(sum(m) for m in table["mask"].to_pylist()) == sum(r.n_tokens for r in mine)
        assert file.sequence_at(0).tolist() == table["ids"][0].as_py()
    assert read_token_files(write_token_files(nothing, token_folder(spark), WORDS)).count() == 0


def test_token_files_keep_the_order_of_one_id(spark):
    """Rows of one id, or without, get the same places however they arrive; a second run leaves the first one's files alone."""
    rows = [(5 if i % 3 else None, " ".join(["word"] * (i % 11)) + f" {i}") for i in range(60)]
    folder, runs = token_folder(spark), []
    for n, order in ((1, rows), (4, rows[::-1])):
        index = write_token_files(spark.createDataFrame(order, "doc_id long, text string").repartition(n), folder, WORDS, sequence=16, batch=4)
        runs.append((index, sorted((r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(index).collect())))
    assert runs[0][1] == runs[1][1]
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(runs[0][0]).collect()) == runs[0][1]
    files = [{r.file for r in index.select("file").distinct().collect()} for index, _ in runs]
    assert not files[0] & files[1]
