import hashlib
import re
from collections import Counter, defaultdict

import pytest

from labelloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from labelloom.llm.mixing import MOST_COPIES, mix_sources, mixed_documents

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def normal(text):
    return SPACES.sub(" ", text or "")


def test_exact_duplicates(awkward):
    rows = awkward.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    found = exact_duplicates(awkward).collect()
    assert len(found) == len(rows)
    expected = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            expected[i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_drop_exact_duplicates_keeps_columns(awkward, nothing):
    kept = drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({normal(r.text) for r in awkward.collect()})
    assert drop_exact_duplicates(nothing).count() == 0 and exact_duplicates(nothing).count() == 0


def targets(sizes, weights=(1, 2, 3)):
    """Water filling source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        for s in full or list(open_):
            done[s] = 3.0 * sizes[s] if full else level * weight[s]
            left -= done[s]
            open_.discard(s)
    return done


def test_mix_sources(spark, awkward, nothing):
    mixed = mix_sources(awkward)
    rows = mixed.collect()
    assert len(rows) == awkward.count() and set(awkward.columns) <= set(mixed.columns)
    sizes = Counter()
    for r in awkward.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    goal = targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.copies <= MOST_COPIES and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert sorted(map(str, mix_sources(awkward).select("doc_id", "text", "copies").collect())) == sorted(map(str, mixed.select("doc_id", "text", "copies").collect()))
    repeated = mixed_documents(awkward)
    assert repeated.columns == awkward.columns and repeated.count() == sum(r.copies for r in rows)
    # columns named like those of the mix (here: size) come out as they were
    assert set(map(tuple, repeated.collect())) <= set(map(tuple, awkward.collect()))
    assert mix_sources(nothing).count() == 0 and mixed_documents(nothing).count() == 0


def test_mix_meets_targets_with_capped_sources(spark):
    docs = [(i, "w " * (1 + i * 7 % 90), "big" if i % 20 else f"small{i % 3}") for i in range(1200)]
    rows = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
