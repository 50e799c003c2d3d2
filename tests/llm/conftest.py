import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside, or return.
CLASHES = ["key", "score", "features", "stats", "sig", "slot", "n", "token", "tile", "media", "ids", "decoded", "kept", "predicted", "component_id", "html", "half", "y", "spans", "item"]


def passage(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "re", "ou", "th", "er", "ing", "st", "ble"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(8)
    base = passage(rng, 120)
    long = passage(rng, 60_000)
    near = base.split()
    near[50] = "changed"
    return [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, "   \n\t ", "en", "a", 6), (3, base, "en", "a", 1), (4, base, None, None, None), (5, " ".join(near), "fr", "b", 2),
        (6, "one two", "en", "a", 7), (7, "one two", "de", "b", 7), (8, long, "en", "a", len(long)), (9, long[: len(long) // 2] + passage(rng, 50), "en", "c", 1), (10, "é日本語 😀 ñ \0 zero", "es", "a", 1),
        (11, "12345 67 !! ##", None, "a", 3), (12, "x" * 300_000, "en", "a", 1), (13, base, "en", "a", 1), (13, base, "en", "a", 1), (None, base, "en", "a", 1), (None, None, "en", None, 1),
        (14, 'write to jo.doe@mail.example.com or +1 (640) 555-0953, card 4539 1488 0343 6467, host 10.0.0.255 "', "en", "a", 1), (15, " a b　c ▁d <s> </s> <unk>", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F

    return edge.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(16)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality long, toxic long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality long, toxic long")


@pytest.fixture(scope="session")
def benchmark(spark, edge_rows):
    words = edge_rows[3][1].split()
    return spark.createDataFrame([(0, " ".join(words[20:60])), (1, None), (2, ""), (3, "two words"), (4, "nothing like this is anywhere in these few documents at all")], "item_id long, text string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
