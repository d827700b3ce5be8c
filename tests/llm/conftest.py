import random

import pytest

SCHEMA = "doc_id long, text string, source string, cell int, part int, copies int, node string, kept boolean, h long, its string"


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, and columns named like the operators' own."""
    r = random.Random(7)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    texts += [None, "", " \t\n", "é ü ß ñ", "a" * 3000, "Mixed CASE\nMixed CASE\nmixed case", "x\u00a0y \u2003 z", " ".join(r.choice(words) for _ in range(9000))]
    rows = [(i, t, ["s1", "s2", "s3", None][i % 4]) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "s1"), (3, texts[3], "s1"), (None, texts[5], None), (None, None, None), (900, texts[0], "s2"), (901, texts[0], "s9")]
    return spark.createDataFrame([(*x, 1, 2, 3, "n", True, 4, "i") for x in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
