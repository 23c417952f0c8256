import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelloom.llm.prefix_trie import prefix_trie
from labelloom.llm.whitening import components, moments, plane_products, whiten

TURNS = "conv_id long, turn long, role string, text string, name string, depth int, words string, part string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(rows: list[tuple]) -> dict[int, list[tuple]]:
    """Rebuilt conversations by id, one by one."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain_trie(rows: list[tuple]) -> Counter:
    """Rows of the trie from the sets of members of all beginnings."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(turns_of(rows).items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(key[:-1] for key in members if key)
    leaves, saved = Counter(), Counter()
    for key, convs in members.items():
        words = len([w for w in key[-1][1].translate({c: " " for c in range(9, 14)}).split(" ") if w]) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(convs) - 1) * words
    return Counter(
        (convs[0], len(key), members[key[:-1]][0] if key else None, len(convs), children[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, ends[key])).encode()).hexdigest())
        for key, convs in members.items()
    )


def conversations(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    texts = ["one two", "one  two three", "", None, "a b\tc", " "]
    rows = []
    for c in [*range(70), *range(5000, 5030), 2**40]:
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9, 9, 17])):
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(texts[:2] if turn < 6 else texts)))
    rows += [(7, None, "user", "null turn"), (7, None, "user", "null turn"), (8, 3, "user", "tie"), (8, 3, None, None), (None, 1, "user", "no conversation"), (None, None, None, None)]
    rows += [(21, t, "user", f"deep {t}") for t in range(100, 160)]
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_prefix_trie(spark, partitions):
    rows = conversations(3)
    frame = spark.createDataFrame([(*r, "n", 1, "w", "p") for r in rows], TURNS).repartition(partitions)
    found = Counter(tuple(r[f] for f in FIELDS) for r in prefix_trie(frame).collect())
    assert found == plain_trie(rows)


def test_prefix_trie_of_equal_and_of_no_conversations(spark):
    rows = [(c, t, "user", "same words") for c in range(3000) for t in range(3)]
    found = Counter(tuple(r[f] for f in FIELDS) for r in prefix_trie(spark.createDataFrame([(*r, "n", 1, "w", "p") for r in rows], TURNS)).collect())
    assert found == plain_trie(rows)
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int, x string, n long, component string"


def vectors(dims: int, rows: int, seed: int, scale: float = 1.0) -> list[tuple]:
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(rows, dims)) @ draw.normal(size=(dims, dims)) * scale
    return [(i, row.tolist(), 0, "x", 1, "c") for i, row in enumerate(base)]


@pytest.mark.parametrize(("scale", "offset"), [(1.0, 0.0), (1e-3, -5.0), (1e12, 1e12)])
def test_whiten(spark, scale, offset):
    rows = [(i, [v + offset for v in x], *rest) for i, x, *rest in vectors(6, 700, 1, scale)]
    rows += [rows[3], (9000, rows[4][1], 1, None, None, None), (None, rows[5][1], 1, None, None, None)]
    odd = [(9001, None), (9002, []), (9003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9004, [math.nan] * 6), (9005, [math.inf] + [0.0] * 5), (9006, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + [(i, v, None, None, None, None) for i, v in odd], VECTORS).repartition(3)
    found = whiten(frame).collect()

    exact = [(r[0], [math.floor(v * 256.0) for v in r[1]]) for r in rows]
    fit = sorted({tuple(x) for _, x in exact})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    # covariance from Python integers, as the check of the bit planes
    covariance = np.array([[(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j]) / n**2 for j in range(6)] for i in range(6)])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    deviations = Counter()
    for i, x in exact:
        total = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        for k in range(4):
            deviations[i, k + 1, n, total if total < 2**63 else None] += 1
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in found) == deviations
    places = {i: x for i, x in exact if i is not None}
    for k in range(4):
        mine = {r.vec_id: r for r in found if r.component == k + 1}
        expected = {i: sum((v - s / n) * a for v, s, a in zip(x, sums, axes[:, k], strict=True)) / math.sqrt(values[k]) for i, x in places.items()}
        sign = 1 if mine[0].whitened * expected[0] > 0 else -1
        assert max(abs(mine[i].whitened - sign * e) for i, e in expected.items()) < 1e-6
        assert mine[0].explained == pytest.approx(values[k] / values.sum(), rel=1e-6)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-6


def test_moments_are_exact(spark):
    draw = np.random.default_rng(2)
    for low, high, rows in [(0, 2, 64), (-300, 300, 1000), (-(2**62), 2**62, 70), (5, 6, 3), (-(2**63), 2**63 - 1, 9)]:
        x = draw.integers(low, high, size=(rows, 5), endpoint=False)
        exact = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)]
        assert plane_products(x) == exact
        n, sums, products = moments(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(2))
        assert (n, sums, products) == (rows, [sum(map(int, c)) for c in x.T], exact)


def test_whiten_without_variance(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i % 2), 0.0], 0, "x", 1, "c") for i in range(10)], VECTORS)
    found = whiten(frame).collect()
    assert len(found) == 30
    assert all((r.whitened is None and r.explained == 0) if r.component > 1 else abs(abs(r.whitened) - 1) < 1e-12 for r in found)
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "x", 1, "c")], VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, None, 0.0)] * 2
    for empty in ([], [(1, None, 0, "x", 1, "c")]):
        assert whiten(spark.createDataFrame(empty, VECTORS)).count() == 0
    values, shares, _ = components(2, [0, 0], [[2, 0], [0, 0]], 4)
    assert values.tolist() == [1.0, 0.0] and shares.tolist() == [1.0, 0.0]
