import random

import pytest

CLASH = ("d", "row", "h", "v", "fp", "comp", "keep_id", "block", "size", "words", "shard", "taken", "_d")
WORDS = {"en": "the of and to in is that for it with".split(), "fr": "le la les des une est dans pour élu être".split(), "de": "der die das und nicht für über ist ein auf".split()}


@pytest.fixture(scope="session")
def plain_rows():
    """Small documents of three languages with copies, near copies, empty and null texts, repeated rows and null ids."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = rng.choice(sorted(WORDS))
        body = " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "ing", "é"]) for _ in range(rng.choice([3, 30, 120])))
        rows.append((i, body.capitalize() + ".", lang, f"src{i % 4}"))
    base = rows[7][1]
    rows += [(100, base, "en", "src0"), (101, base.replace(" ", "\t\n"), "en", "src0"), (102, base + " more words", None, "src1"), (103, "".join(c.upper() if c.isascii() else c for c in base), "en", "src1")]
    rows += [(104, "", "en", "src1"), (105, None, None, None), (106, " \n ", "en", None), (107, "12 34 --", "en", "src2"), (108, "x", "en", "src2"), (108, "x", "en", "src2")]
    rows += [(None, base, "en", "src3"), (None, "lonely text of no id", "en", "src3"), (-5, base, "en", "src3"), (109, "word " * 3000, "en", "src9")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, plain_rows):
    """The same as a table with extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in plain_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
