import re
from collections import Counter

from labelloom.llm.quality_rules import LINE_LIMIT, NGRAM_LIMITS, keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    found = WORD.findall(text or "")
    seen, again = set(), 0
    lines = Counter(line for line in (text or "").split("\n") if WORD.search(line))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)

    def inside(n):
        grams = Counter(tuple(found[i : i + n]) for i in range(len(found) - n + 1))
        return {i + k for i in range(len(found) - n + 1) if grams[tuple(found[i : i + n])] > 1 for k in range(n)}

    chars = sum(map(len, found))
    failed = len(found) < 50 or 100 * len(inside(3)) > 50 * len(found)
    shares = {n: sum(len(found[i]) for i in inside(n)) / max(chars, 1) for n in NGRAM_LIMITS}
    line_share = sum(len("".join(WORD.findall(line))) * n for line, n in lines.items() if n > 1) / max(chars, 1)
    kept = not failed and line_share <= LINE_LIMIT and all(shares[n] <= most for n, most in NGRAM_LIMITS.items())
    return len(found), chars, sum(c in "#*$%&|<>" for c in text or ""), again, len(inside(3)), failed, round(line_share, 9), *(round(s, 9) for s in shares.values()), kept


def test_quality_rules(awkward, nothing):
    expected = Counter((r.doc_id, *figures(r.text)) for r in awkward.collect())
    found = quality_rules(awkward)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_share", *(f"share_{n}" for n in NGRAM_LIMITS), "kept"]
    assert Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in found.collect()) == expected
    assert quality_rules(nothing).count() == 0


def test_keep_good(awkward, nothing):
    kept = keep_good(awkward)
    assert kept.columns == awkward.columns
    assert Counter(map(str, kept.collect())) == Counter(str(r) for r in awkward.collect() if figures(r.text)[-1])
    assert keep_good(nothing).count() == 0
