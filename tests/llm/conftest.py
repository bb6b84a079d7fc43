import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "ETA", "theta."]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 300)) for _ in range(20_000))
    line = "A line that is repeated in very many documents of this table."
    rows = [(i, f"{line}\n{' '.join(rng.choice(words) for _ in range(rng.randint(1, 60)))}", "en" if i % 2 else "de", f"s{i % 3}", i) for i in range(20)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t\n ", "en", "s1", 4), (103, long, "en", "s0", len(long)), (104, long + " tail", "en", None, 1)]
    rows += [(None, "no id here, only text", "de", "s2", 5), (105, "one", "de", "s2", 3), (106, "one", "de", "s2", 3), (107, "12 345 !!", None, "s1", 3)]
    rows += [rows[0], rows[0], (3, "another text for an id that is taken", "en", "s0", 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clashing(df, *names):
    """df with extra columns of the names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})
