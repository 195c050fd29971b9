import random

import pytest

SMALL = "/root/testdata/sf0.001"
#: columns that clash with names the operators use or return
EXTRA = ["id", "piece", "length", "n", "n_words", "h", "words", "kept", "row", "chunk", "text_", "lang_pred", "sequence_id"]


def frame(spark, rows, ids="long", extra=True):
    """documents-like frame of (doc_id, text) rows with clashing extra columns."""
    names = [f"`{c}` string" for c in EXTRA] if extra else []
    schema = ", ".join([f"doc_id {ids}", "text string", "lang string", "source string", *names])
    return spark.createDataFrame([(i, t, "en", None, *(["x"] * len(names))) for i, t in rows], schema)


def odd_rows():
    """Nulls, empties, ties, repeated rows, a long text, white space and symbols beyond ASCII."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "niño,", "été.", "x", "don't", "#tag", "$5", "A.B,", "12", "日本語"]
    base = " ".join(rng.choices(words, k=120))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, base), (6, base), (6, base), (7, base[:400] + " changed here " + base[414:]),
            (8, " ".join(rng.choices(words, k=6000))), (9, "a a a a a a a a a a a a a a a a a a a a a a a a"), (10, "tail  \n\n" + base[50:300] + "\n"),
            (11, "x" * 5000), (None, base[:200]), (None, None), (12, "éé éé " * 40), (13, "　wide space <|endoftext|> \x1c   end"),
            (14, "\n".join(["same line of text"] * 6)), (2**40, base.upper())]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))
