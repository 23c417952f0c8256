import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, k1 string, row int, h double, kept string, n_words int, text_sha256 string"


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdehinorst") for _ in range(draw.randrange(1, 9))) for _ in range(n)]


def awkward_texts() -> list[str | None]:
    """Null, empty, blank, tiny, odd, very long, repeated and slightly changed texts."""
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    passage = " ".join(words(2, 110))
    return [
        None, "", " \n\t ", "x", "1 2 3 !", "a<|endoftext|>b  c", "É漢字 　mixed\r\nlines\n\nlines\nlines", "🙂" * 30,
        " ".join(base), " ".join(base), "  ".join(base), " ".join(near), "\n".join(["same line here"] * 40),
        " ".join(words(3, 30)) + " " + passage + " " + " ".join(words(4, 10)), passage + " " + " ".join(words(5, 50)),
        " ".join(words(6, 5000)), "z" * 3000, "ab" * 700, "Der Hund und die Katze привет мир και", "Stupid IDIOT*** text",
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with awkward texts, null ids and repeated rows, and columns whose names operators also use."""
    rows = []
    for i, text in enumerate(awkward_texts()):
        rows.append((i, text, None if i % 5 == 4 else "en", None if i % 7 == 6 else f"src{i % 3}", i, i * 2, "k", 1, 0.5, "yes", 3, "sha"))
    rows += [rows[8], rows[13], (None, "", None, None, None, None, None, None, None, None, None, None), (None, rows[8][1], "en", "src0", 1, 1, "k", 1, 0.5, "no", 3, "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
