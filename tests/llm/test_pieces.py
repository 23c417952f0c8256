import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from labelloom.llm import piece_bpe
from labelloom.llm.piece_bpe import PieceBpe, piece_encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abcdeehinorst  \n\t'lrevd.,0123éßñ　\x1c\u0085ſ漢🙂́ÀΣ<|>endoftext▁▁<s>の한"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def bpe():
    return PieceBpe(PATH)


def odd_texts() -> list[str]:
    draw = random.Random(5)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(60))) for _ in range(2000)]
    texts += ["a" * 2000, "ab" * 900, " " * 200, " " * 16 + "é漢", " " * 15 + "x", "🙂" * 40, " ", " a", "▁", "▁▁ ▁", "<s>", "\0x", ""]
    texts += [" " * k + "the" + " " * k + "🙂" for k in range(1, 70)]
    texts.append("".join(draw.choice("abcdefghijklmnop") for _ in range(20_000)))
    return texts


def test_encoder_equals_library(bpe, library):
    assert bpe.together and bpe.longest_run == 16
    texts = odd_texts()
    expected = library.encode(texts, add_bos=True, add_eos=True)
    for text, found, ids in zip(texts, bpe.encode(texts), expected, strict=True):
        assert found.tolist() == ids, text
        assert bpe.decode(found).decode() == library.decode(ids)


def test_one_join_at_a_time(bpe, library, monkeypatch):
    monkeypatch.setattr(bpe, "together", False)
    monkeypatch.setattr(bpe, "longest_run", 0)
    texts = odd_texts()[:400] + [" " * 40 + "x"]
    assert [f.tolist() for f in bpe.encode(texts)] == library.encode(texts, add_bos=True, add_eos=True)


def test_long_texts_in_parts(bpe, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MOST_CHARS", 50)
    texts = odd_texts()
    assert [f.tolist() for f in bpe.encode(texts)] == library.encode(texts, add_bos=True, add_eos=True)


def test_decode_of_broken_sequences(bpe, library):
    draw = random.Random(6)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(300), draw.randrange(32000), 259, 28705, 0, 1, 2]) for _ in range(draw.randrange(9))]
        assert bpe.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids), ids


def test_piece_encode(awkward, nothing, library):
    found = piece_encode(awkward, PATH).collect()
    expected = Counter()
    for r in awkward.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        packed = np.array(ids, dtype="<u4").tobytes()
        expected[r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in found) == expected
    assert piece_encode(nothing, PATH).count() == 0
