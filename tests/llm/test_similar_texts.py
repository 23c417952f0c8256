import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import jaccard_join, suffix_dedup
from labelloom.llm.components import components
from labelloom.llm.jaccard_join import drop_near_duplicates, near_duplicates
from labelloom.llm.suffix_dedup import extents, repeated_spans, sampled
from labelloom.session import materialize
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute_links(rows):
    """(class, copy, links) by position, comparing all pairs of sets."""
    sets = [shingle_set(t) for _, t in rows]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    members = defaultdict(list)
    for (i, _), s in zip(rows, sets, strict=True):
        members[s].append(i)
    members.pop(frozenset(), None)
    links = {a: [b for b in members if b != a and 5 * len(a & b) >= 4 * len(a | b)] for a in members}
    root = {}
    for a in members:
        if a not in root:
            found, todo = {a}, [a]
            while todo:
                for b in links[todo.pop()]:
                    if b not in found:
                        found.add(b)
                        todo.append(b)
            for b in found:
                root[b] = least(i for c in found for i in members[c])
    return [(i, root.get(s, i), least(members[s]) if s else i, len(links.get(s, ())), len(s)) for (i, _), s in zip(rows, sets, strict=True)]


def near_texts(seed, groups, copies, n=80):
    """Groups of texts that differ by a few words, around the threshold."""
    draw, out = random.Random(seed), []
    for g in range(groups):
        base = words(100 * seed + g, n)
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randrange(4)):
                text[draw.randrange(n)] = "w" + str(draw.randrange(10**6))
            out.append(" ".join(text))
    return out


def check_links(df, **how):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = Counter((r.doc_id, r.class_id, r.copy_id, r.n_links, r.n_shingles) for r in near_duplicates(df, **how).collect())
    assert found == Counter(brute_links(rows))


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    check_links(awkward)
    assert near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("brute_sets", [1500, 6])
def test_near_duplicates_equal_brute_force_also_when_buckets_split(spark, brute_sets):
    passage = " ".join(words(9, 70))
    texts = near_texts(1, 6, 12) + [passage + " " + " ".join(words(50 + i, 40)) for i in range(25)]
    check_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), brute_sets=brute_sets)


def test_drop_near_duplicates_keeps_one_of_each_class(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    stay = {(i, t or "") for (i, t), (_, c, *_) in zip(rows, brute_links(rows), strict=True) if i == c}
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter(stay)
    assert drop_near_duplicates(nothing).count() == 0


def test_overlaps_of_many_sets():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 900, 200).astype(np.uint64)) for _ in range(130)]
    found = jaccard_join.overlaps(sets)
    for i in range(0, 130, 17):
        for j in range(130):
            if i != j:
                assert found[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_overlap_rows_of_large_buckets(monkeypatch):
    draw = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([[7], draw.integers(0, 900, 60), draw.integers(0, 12, 5)]).astype(np.uint64)) for _ in range(70)] + [np.zeros(0, dtype=np.uint64)]
    whole = jaccard_join.overlaps(sets)
    monkeypatch.setattr(jaccard_join, "ROWS", 16)
    found = np.concatenate([rows for _, rows in jaccard_join.overlap_rows(sets)])
    np.fill_diagonal(whole, 0)
    np.fill_diagonal(found, 0)
    assert (found == whole).all()


def test_drop_near_duplicates_keeps_one_also_with_null_and_repeated_ids(spark):
    base, other = words(21, 120), words(22, 120)
    near = [base, base[:60] + ["changed"] + base[61:], base[:-1]]
    same = [other, other[:60] + ["changed"] + other[61:], other[:-1]]
    rows = [(None, " ".join(t)) for t in near] + [(7, " ".join(t)) for t in same] + [(8, " ".join(same[0])), (None, ""), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = drop_near_duplicates(table).collect()
    assert Counter((r.doc_id, r.text == "") for r in kept) == {(None, False): 1, (7, False): 1, (None, True): 1, (3, True): 1}
    assert all((r.doc_id, r.text) in rows for r in kept)


def test_components_have_no_bound_of_rounds(spark, monkeypatch):
    monkeypatch.setattr("labelloom.llm.components.MOST_ROUNDS", 1, raising=False)
    draw = random.Random(9)
    nodes = draw.sample(range(1000), 40)
    found = components(spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long")).collect()
    assert {r.node: r.root for r in found} == dict.fromkeys(nodes, min(nodes))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 201), (200, 202), (203, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, **dict.fromkeys(range(200, 204), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows, length):
    places = Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = Counter()
    for i, t in rows:
        marked = np.zeros(len(t) + 1, dtype=int)
        for p in range(len(t) - length + 1):
            if places[t[p : p + length]] > 1:
                marked[p] += 1
                marked[p + length] -= 1
        gone = np.cumsum(marked)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        out[i, len(t), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans] += 1
    return out


def check_spans(df, length=400, **how):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    found = repeated_spans(df, length=length, **how).collect()
    mine = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, tuple((s.start, s.end) for s in r.spans)) for r in found)
    assert mine == brute_spans(rows, length)


def test_repeated_spans_of_awkward_rows(awkward, nothing):
    check_spans(awkward)
    assert repeated_spans(nothing).count() == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_repeated_spans_equal_brute_force_also_when_groups_split(spark, most):
    draw = random.Random(8)
    passages = ["".join(draw.choice("abc ") for _ in range(draw.randrange(30, 90))) for _ in range(6)]
    texts = []
    for i in range(60):
        text = "".join(draw.choice("abcdef ") for _ in range(draw.randrange(60)))
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            text += p[draw.randrange(10) :] + "".join(draw.choice("abcdef ") for _ in range(draw.randrange(30)))
        texts.append((i, text))
    check_spans(spark.createDataFrame(texts, "doc_id long, text string"), length=40, gram=8, most=most)


SPLIT_SMALL_JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
}


def test_rows_of_a_start_that_many_texts_share_are_joined_in_several_tasks(spark, monkeypatch):
    draw = random.Random(6)
    some = lambda n: "".join(draw.choice("abcdef ") for _ in range(n))
    passage = some(36)
    df = spark.createDataFrame([(i, some(60) + passage + some(60)) for i in range(400)], "doc_id long, text string").repartition(6)
    first = {}

    def kept(made, name):
        out = materialize(made, name)
        first.setdefault(name, out)
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", kept)
    before = {c: spark.conf.get(c, None) for c in SPLIT_SMALL_JOINS}
    for c, v in SPLIT_SMALL_JOINS.items():
        spark.conf.set(c, v)
    try:
        check_spans(df, length=40, gram=8, most=100)
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    for name in ("suffixes-met", "suffix-halves"):
        rows = first[name].select("h", F.input_file_name().alias("file")).groupBy("h").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).orderBy(F.desc("n")).first()
        assert rows.n >= 300
        assert rows.files > 1, name


def test_every_window_holds_a_sampled_suffix():
    draw = np.random.default_rng(4)
    data = np.concatenate([draw.integers(97, 100, 700), [10], draw.integers(97, 100, 20), [10], np.full(300, 97), [10]]).astype(np.uint8)
    starts = np.array([0, 701, 722, 1023])
    at, _ = sampled(data, starts, 40, 8)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        for p in range(a, b - 1 - 40 + 1):
            assert ((at >= p) & (at + 8 <= p + 40)).any()


def test_extents_equal_all_pairs():
    draw = random.Random(2)
    for _ in range(200):
        n = draw.randrange(2, 9)
        lefts = ["".join(draw.choice("ab") for _ in range(draw.randrange(9))).encode() for _ in range(n)]
        rights = ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 9))).encode() for _ in range(n)]
        before, after = extents(lefts, rights, 7)
        for i in range(n):
            reach = [(0, 0)]
            for j in range(n):
                left = suffix_dedup.common(lefts[i][::-1], lefts[j][::-1])
                right = suffix_dedup.common(rights[i], rights[j])
                if i != j and left + right >= 7:
                    reach.append((left, right))
            assert (before[i], after[i]) == (max(x for x, _ in reach), max(y for _, y in reach))
