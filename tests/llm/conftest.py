import random

import pytest

#: Names that operators use inside, as columns of a table that aren't theirs to read.
CLASH = "id, key, chunk, kind, bucket, size, target, taken, fp, component, low, text_hash, score, label, features, other, k, hashes, row, first, n, data, shard, __none, __i, __h, __pipeline, no_id, own_id".split(", ")


@pytest.fixture(scope="session")
def odd_rows():
    """Rows of documents as they shouldn't be: nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, " \n\t ", "en", None), (None, "no id here at all", "en", "b"), (None, passage, None, "b"),
        (4, f"alpha {passage} omega", "en", "a"), (5, f"beta  {passage}\nend", "de", None), (5, f"beta  {passage}\nend", "de", None), (5, "another text with that id", "en", "c"),
        (6, long, "en", "c"), (7, f"{long} tail", "en", "c"), (8, "One", "en", "a"), (9, "one two", "en", "a"), (10, "ONE two", "en", "a"), (11, "  x  　 é <|endoftext|> y\x00z", "en", "d"),
        (12, "a\tb\x0bc\r\nd  e", "en", "d"), (13, "same words " * 50, "en", "d"), (14, "same words " * 50, "en", "d"), (-3, "negative id", "en", "d"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
