import random

import pytest

WORDS = ["alpha", "Beta", "gamma", "déjà", "delta,", "eps", "zeta!", "eta", "θήτα", "iota", "kappa", "x1", "λ", "mu"]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("" if r.random() < 0.5 else str(r.randrange(60))) for _ in range(n))


def near(seed: int, n: int, edits: int, salt: int) -> str:
    w, r = text(seed, n).split(), random.Random(salt)
    for _ in range(edits):
        w[r.randrange(n)] = f"edit{salt}_{r.randrange(1000)}"
    return " ".join(w)


def corpus() -> list[tuple]:
    """doc_id, text, lang: copies, edited copies, shared passages, repeated rows, nulls and odd texts."""
    rows = [(i, text(i, 20 + 13 * i % 170), ("en", "fr", None)[i % 3]) for i in range(40)]
    rows += [(100 + i, text(7, 111), "en") for i in range(5)]
    rows += [(200 + i, near(900, 160, i % 9, i), "en") for i in range(60)]
    rows += [(300 + i, text(300 + i, 30) + "\n" + text(77, 60) + "  " + text(400 + i, 25), "fr") for i in range(6)]
    rows += [(400, None, "en"), (401, "", "en"), (402, " \n\t ", None), (403, "one", "en"), (404, "one two three", "en"), (405, "ONE two Three", "en"), (406, "!!! 123 ???", "en"), (407, "x", "fr"), (408, "\x1c\x85   a b", "en")]
    rows += [(500, "ab " * 400, "en"), (501, ("line of text again and again " * 3 + "\n") * 30, "en"), (502, text(5, 9000), "en"), (503, "z" * 3000, None)]
    return rows + [(1, text(1, 33), "fr"), (1, text(1, 33), "fr"), (None, text(2, 46), "en"), (None, None, None), (2**40, "'tis don't I'll ''s", "en"), (-5, text(11, 50), "en")]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    for name in ("block", "slice", "rank", "n", "cls", "kept", "size", "key", "ids", "score", "before", "source", "n_chars"):
        df = df.withColumn(name, F.lit(7).cast("long") if name == "n_chars" else F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
