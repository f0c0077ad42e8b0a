from __future__ import annotations

import random

import pytest

CLASH = "score double, label int, n_words long, u1 long, place int, line string, `key` string, n long, token long, kept boolean, `a.b` string, cuts string, c0 string, text2 string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, long, repeated and non-ASCII texts; near and exact copies."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", " \n\t ", "one", "one two", "Ünïcode wörds ÀÉ straße", base, base, " ".join(near), base.upper(), words(rng, 30_000), "x" * 50_000, "a a a a a a", "line\nline\n\nline \n LINE", "\n", "\r\n\r\n",
        "###!!! $$$ 1 2 3", words(rng, 60) + "\nshared line", words(rng, 60) + "\nshared line", "don't <|endoftext|> I'LL",
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """doc_id, text and columns whose names operators might use; a null doc_id and a repeated row."""
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(None, "no id here"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    fields = [c.strip().rsplit(" ", 1) for c in CLASH.split(",")]
    return df.select("doc_id", "text", *(F.lit(None).cast(kind).alias(name.strip("`")) for name, kind in fields))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(18)] + [(None, 1, 1), (5, None, None), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
