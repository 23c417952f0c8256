import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from labelloom.llm import language_id, lm_scoring
from labelloom.llm.language_id import identify, train
from labelloom.llm.lm_scoring import Vocabulary, expected_pieces, lattice, score_texts, word_logs
from labelloom.llm.queries import QUERIES
from labelloom.llm.toxicity import NEIGHBOURS, BlockMaxIndex, calibration, score_toxicity, term_counts, text_vectors
from tests.llm.conftest import words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(1)
    starts = np.array([0, 5, 5, 6, 10])
    scores = draw.normal(size=(10, 3)).astype(np.float32)
    labels = language_id.viterbi(scores, starts, 0.8)

    def value(path, base):
        return sum(scores[base + t, k] for t, k in enumerate(path)) - 0.8 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    def paths(n):
        return [(*p, k) for p in paths(n - 1) for k in range(3)] if n else [()]

    for a, b in zip(starts[:-1], starts[1:], strict=True):
        best = max(value(p, a) for p in paths(b - a)) if b > a else 0
        assert value(tuple(labels[a:b]), a) == pytest.approx(best, abs=1e-5)


def test_languages_and_spans(spark, awkward, nothing):
    english = ["the cat and the dog were in the house with that thing " * 3] * 5
    german = ["der Hund und die Katze sind nicht in dem Haus mit einer Sache " * 3] * 5
    russian = ["кошка и собака были в том доме с этой вещью " * 3] * 5
    known = [(i, t, lang) for lang, texts in (("en", english), ("de", german), ("ru", russian)) for i, t in enumerate(texts)] + [(9, "nothing", None)]
    model = train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    mixed_text = english[0] + german[0] + russian[0]
    tests = [(1, english[0]), (2, german[0]), (3, "Собака!"), (4, mixed_text), (5, "123 ..."), (6, None), (7, "漢字"), (8, ""), (10, "\u0301 \u0308\u0301!"), (11, "e\u0301 \u0301 the dog")]
    found = {r.doc_id: r for r in identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 5, 6, 8)] == ["en", "de", "ru", "und", "und", "und"]
    assert [s.lang for s in found[4].spans] == ["en", "de", "ru"] and found[4].spans[1].start == len(english[0])
    assert (found[10].lang_pred, found[10].score, found[10].spans) == ("und", 0, []) and found[11].lang_pred == "en"
    assert found[5].score == 0 and found[6].spans == [] and found[7].lang_pred in model.langs and found[7].score == 0
    everything = identify(awkward, model).collect()
    assert len(everything) == awkward.count() and all(0 <= r.score <= 1 for r in everything)
    assert identify(nothing, model).count() == 0
    assert {r.lang_pred for r in identify(awkward, train(nothing)).collect()} == {"und"}


def test_language_of_held_out_rows(spark, small):
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    row = QUERIES["op7_language_id"](spark, small).join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert row[0] > 0.97


def test_block_max_index_is_exact():
    draw = random.Random(3)
    vectors = []
    for _ in range(400):
        some = {draw.randrange(30): draw.random() for _ in range(draw.randrange(1, 6))}
        norm = math.sqrt(sum(w * w for w in some.values()))
        vectors.append([(t, w / norm) for t, w in sorted(some.items())])
    flat = lambda some, i, kind: np.array([e[i] for v in some for e in v], dtype=kind)
    index = BlockMaxIndex([len(v) for v in vectors], flat(vectors, 0, np.int64), flat(vectors, 1, np.float64), 30)
    asked = [*vectors[:150], []]
    starts = np.concatenate([[0], np.cumsum([len(v) for v in asked])])
    plain = index.nearest_of(starts, flat(asked, 0, np.int64), flat(asked, 1, np.float64), 10)
    others = index.nearest_of(starts[:-1], flat(asked, 0, np.int64), flat(asked, 1, np.float64), 10, without=np.arange(150))
    assert index.read < index.asked
    for left, results in ((False, plain[:-1]), (True, others)):
        for i, (q, (at, cosine)) in enumerate(zip(vectors, results)):
            every = [sum(w * dict(v).get(t, 0) for t, w in q) for v in vectors]
            best = sorted((j for j in range(400) if every[j] > 0 and not (left and i == j)), key=lambda j: (-round(every[j], 12), j))[:10]
            assert at.tolist() == best and cosine == pytest.approx([every[j] for j in best])
    assert len(plain[-1][0]) == 0
    few = BlockMaxIndex([1, 1], np.array([0, 1]), np.array([1.0, 1.0]), 2)
    assert few.nearest(np.array([0]), np.array([1.0]), 10)[0].tolist() == [0]


def test_calibration_pools_and_rises():
    draw = np.random.default_rng(5)
    raw = np.round(draw.random(300), 2)
    labels, weights = (draw.random(300) < raw).astype(float), draw.integers(1, 4, 300).astype(float)
    knots, values = calibration(raw, labels, weights)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all() and 0 < values[0] and values[-1] < 1
    # of all rising maps the pooled one has the least squared error: compare with min-max of means
    order = np.unique(raw)
    n = np.array([weights[raw == v].sum() for v in order])
    t = np.array([(weights * labels)[raw == v].sum() for v in order])
    exact = [max(min(t[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(order))) for i in range(k + 1)) for k in range(len(order))]
    rate = t.sum() / n.sum()
    pools = [np.isclose(exact, want) for want in np.unique(np.round(exact, 12))]
    smooth = [(t[p].sum() + rate) / (n[p].sum() + 1) for p in pools]
    assert knots == pytest.approx([(order * n)[p].sum() / n[p].sum() for p in pools])
    assert values == pytest.approx(np.maximum.accumulate(smooth))


def test_toxicity(spark, awkward, nothing):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = words(i, 30) + ([draw.choice(["idiot", "stupid***", "Moron,"]) for _ in range(2)] if toxic else [])
        draw.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labelled = table.where("doc_id % 8 < 6").unionByName(spark.createDataFrame([(900, "idiot", None), (None, "x", 1)], table.schema))
    found = {r.doc_id: r for r in score_toxicity(table.drop("label"), labelled).collect()}
    right = [(found[i].predicted == label) for i, _, label in rows]
    assert sum(right) / len(right) > 0.97
    assert found[0].evidence[0].cosine > 0.5 and found[0].evidence[0].toxic == 1 and found[1].evidence[0].toxic == 0
    odd = score_toxicity(awkward, labelled).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert score_toxicity(nothing, labelled).count() == 0
    assert {r.score for r in score_toxicity(awkward, nothing.withColumn("label", F.lit(1))).collect()} == {0.5}


def toxicity_terms(text):
    """Words and their parts of five letters, each once per word."""
    return Counter(f for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for f in {"|" + w, *(w[i : i + 5] for i in range(len(w) - 4))})


def test_terms_of_texts(awkward):
    texts = [r.text or "" for r in awkward.collect()]
    table = np.sort(np.unique(np.concatenate([term_counts([t])[0] for t in texts])))
    starts, terms, counts = text_vectors(texts, table)
    for i, text in enumerate(texts):
        part = slice(starts[i], starts[i + 1])
        assert (np.diff(terms[part]) > 0).all() and sorted(counts[part].tolist()) == sorted(toxicity_terms(text).values())
    assert text_vectors(["", ""], table)[0].tolist() == [0, 0, 0] and text_vectors([], table)[0].tolist() == [0]


def test_votes_by_brute_force(spark):
    draw = random.Random(9)
    rows = []
    for i in range(90):
        text = words(i % 70, 12) + [draw.choice(["vilezz", "foulzz", "finezz"])]
        rows.append((i, " ".join(text), int(text[-1] != "finezz" and draw.random() < 0.8)))
    asked = [(1000 + i, " ".join(words(200 + i, 6) + words(i, 6) + ["vilezz"] * (i % 2))) for i in range(20)]
    found = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string, label int")).collect()}
    docs = [toxicity_terms(t) for _, t in asked]
    distinct = {(label, t) for _, t, label in rows}
    known, toxic = Counter(f for _, t in distinct for f in toxicity_terms(t)), Counter(f for label, t in distinct if label for f in toxicity_terms(t))
    base = sum(label for label, _ in distinct) / len(distinct)

    def factor(f):
        chi = (toxic[f] - known[f] * base) ** 2 / (known[f] * base * (1 - base))
        return (math.log((1 + len(docs)) / (1 + sum(f in d for d in docs))) + 0.1) * ((chi / (chi + 30)) ** 2 + 0.01)

    factors = {f: factor(f) for f in known}

    def unit(text):
        v = {f: (1 + math.log(c)) * factors[f] for f, c in toxicity_terms(text).items() if f in factors}
        return {f: w / math.sqrt(sum(x * x for x in v.values())) for f, w in v.items()}

    examples: dict = {}
    for _, text, label in rows:
        examples.setdefault(text, []).append(label)
    vectors = [(unit(text), labels) for text, labels in examples.items()]

    def raw(mine, others):
        near = sorted(((round(sum(w * o.get(f, 0) for f, w in mine.items()), 12), n) for n, (o, _) in enumerate(others)), key=lambda e: (-e[0], e[1]))
        near = [(c, others[n][1]) for c, n in near if c > 0]
        places, above, below = NEIGHBOURS, 0.0, 0.0
        for cosine, labels in near:
            n = min(places, len(labels))
            weight = (cosine / near[0][0]) ** 2 * n
            places, above, below = places - n, above + weight * sum(labels) / len(labels), below + weight
        return above / below

    own = [raw(v, vectors[:i] + vectors[i + 1 :]) for i, (v, _) in enumerate(vectors)]
    knots, values = calibration(np.array(own), np.array([sum(x) / len(x) for _, x in vectors]), np.array([float(len(x)) for _, x in vectors]))
    for i, text in asked:
        want = raw(unit(text), vectors)
        assert found[i].raw == pytest.approx(want, abs=1e-9)
        assert found[i].score == pytest.approx(np.interp(want, knots, values), abs=1e-6)


def test_toxicity_has_neighbours_for_all_texts(spark, awkward, nothing):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        text = words(i, 30) + ([draw.choice(["idiot", "stupid***", "Moron,"]) for _ in range(2)] if i % 4 == 0 else [])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    table = spark.createDataFrame([*rows, (500, "12 ...", 0), (501, None, 0)], "doc_id long, text string, label int")
    learned = table.where("doc_id % 16 < 12")
    found = {r.doc_id: r for r in score_toxicity(table.drop("label"), learned).collect()}
    held = [(found[i], label) for i, _, label in rows if i % 16 >= 12]
    assert sum(r.predicted == label for r, label in held) / len(held) > 0.97
    assert all(len(found[i].evidence) == 5 for i, *_ in rows) and found[500].evidence == found[501].evidence == []
    clean = [r for r, label in held if not label]
    assert sum(e.toxic == 0 for r in clean for e in r.evidence) > 4 * len(clean)
    odd = score_toxicity(awkward, learned).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert score_toxicity(nothing, learned).count() == 0
    assert {r.score for r in score_toxicity(awkward, nothing.withColumn("label", F.lit(1))).collect()} == {0.5}


def test_toxicity_weighs_all_words(spark):
    texts = [(i, " ".join(words(i, 20)), i % 2) for i in range(60)]
    # a toxic word of two labelled rows, and clean words of one
    texts += [(100, "zzyzxvile", 1), (101, "zzyzxvile zzyzxvile", 1), (102, "quuxgentle", 0)]
    labelled = spark.createDataFrame(texts, "doc_id long, text string, label int")
    asked = [(1, "zzyzxvile"), (2, "quuxgentle!"), (3, texts[7][1]), (4, "qqqqqqqq"), (5, "zzyzxvile " + texts[8][1])]
    found = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), labelled).collect()}
    assert found[1].evidence[0].doc_id == 100 and found[1].predicted == 1 and found[1].evidence[0].toxic == 1
    assert found[2].evidence[0].doc_id == 102 and found[2].evidence[0].toxic == 0
    assert found[3].evidence[0].doc_id == 7 and found[3].evidence[0].cosine == pytest.approx(1)
    # cosines by the definition, over all terms of the texts
    docs = [toxicity_terms(t) for _, t in asked]
    idf = lambda f: math.log((1 + len(docs)) / (1 + sum(f in d for d in docs))) + 0.1
    known = Counter(f for _, t, _ in texts for f in toxicity_terms(t))
    toxic = Counter(f for _, t, label in texts if label for f in toxicity_terms(t))
    base = sum(label for *_, label in texts) / len(texts)

    def factor(f):
        chi = (toxic[f] - known[f] * base) ** 2 / (known[f] * base * (1 - base))
        return idf(f) * ((chi / (chi + 30)) ** 2 + 0.01)

    def unit(text):
        v = {f: (1 + math.log(c)) * factor(f) for f, c in toxicity_terms(text).items() if f in known}
        return {f: w / math.sqrt(sum(x * x for x in v.values())) for f, w in v.items()}

    mine = unit(asked[4][1])
    every = sorted(((-round(sum(w * other.get(f, 0) for f, w in mine.items()), 9), i) for i, t, _ in texts for other in [unit(t)]))
    assert [(e.doc_id, -round(e.cosine, 9)) for e in found[5].evidence] == [(i, c) for c, i in every[:5]]


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PIECES)


def marginal(word, vocab, logs):
    text = b" " + word

    def piece(part):
        node = 0
        for byte in part:
            node = vocab.child[node, byte]
            if not node:
                return -1
        return vocab.end[node]

    @lru_cache(None)
    def rest(i):
        if i == len(text):
            return 0.0
        return np.logaddexp.reduce([logs[p] + rest(j) for j in range(i + 1, len(text) + 1) if (p := piece(text[i:j])) >= 0])

    return rest(0)


def test_lattice_equals_recursion(vocab):
    some = [b"the", b"running", b"x" * 25, "étrange漢".encode(), b"\xff\x00", b"a"]
    ends = np.cumsum([len(w) for w in some])
    data = np.frombuffer(b"".join(some), dtype=np.uint8)
    found = word_logs(data, np.concatenate([[0], ends[:-1]]), ends, vocab, vocab.prior)
    assert found == pytest.approx([marginal(w, vocab, vocab.prior) for w in some])


def test_expected_pieces_cover_the_bytes(vocab):
    rows = np.array([list(b" running"), list(b" bananas")], dtype=np.uint8)
    counts, likelihood = expected_pieces(rows, np.array([2.0, 1.0]), vocab, vocab.prior)
    forward = lattice(rows, vocab, vocab.prior)[-1]
    assert likelihood == pytest.approx(2 * forward[0] + forward[1])
    lengths = np.zeros(vocab.pieces)
    stack = [(0, 0)]
    while stack:
        node, depth = stack.pop()
        if vocab.end[node] >= 0:
            lengths[vocab.end[node]] = depth
        stack += [(c, depth + 1) for c in vocab.child[node][vocab.child[node] > 0]]
    assert (counts * lengths).sum() == pytest.approx(3 * 8)
    assert lattice(rows, vocab, vocab.prior)[-1].shape == (2,)


@pytest.mark.parametrize("shared", [500_000, 20])
def test_scores_of_texts(awkward, nothing, monkeypatch, shared):
    monkeypatch.setattr(lm_scoring, "MOST_SHARED", shared)
    rows = awkward.collect()
    learned = [r for r in rows if r.doc_id is not None and r.doc_id % 3]
    counts = Counter(w for r in learned for w in WORD.findall((r.text or "").translate(LOWER)))
    total, distinct = sum(counts.values()) + len(learned), len(counts) + 1
    below = math.log10(total + 0.5 * (distinct + 1))
    expected = Counter()
    for r in rows:
        mine = WORD.findall((r.text or "").translate(LOWER))
        base = sum(math.log10(counts[w] + 0.5) for w in mine) + math.log10(len(learned) + 0.5) - (len(mine) + 1) * below
        expected[r.doc_id, len(mine) + 1, sum(counts[w] > 0 for w in mine) + 1, total, round(base, 4)] += 1
    found = score_texts(awkward, F.col("doc_id") % 3 != 0, PIECES).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    empty = {r.score for r in found if r.n_tokens == 1}
    assert len(empty) == 1 and max(r.score for r in found) == empty.pop()
    if shared > 20:
        assert score_texts(nothing, F.lit(True), PIECES).count() == 0
