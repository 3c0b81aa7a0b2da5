import pytest
from pyspark.sql import functions as F

from tradewind.llm import common

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, "one two three"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, PASSAGE + " then the first ending of its own"),
    (6, "another start " + PASSAGE + " another ending"),
    (6, "another start " + PASSAGE + " another ending"),  # a repeated row
    (7, "one two three"),  # a copy
    (8, LONG),
    (9, LONG + " with an end"),
    (None, PASSAGE),
    (11, "Größe Éé ñ   keep this 😀 <|endoftext|> ΑΣ ﬁ"),
    (12, "x" * 5_000),
    (13, "same same same same same same same same same same same same same same same"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, copies, a repeated row and columns with clashing names."""
    common.prepared(spark)
    rows = [(i, t, None if n % 3 == 0 else "en", "a" if n % 2 else None, -1) for n, (i, t) in enumerate(TEXTS)]
    names = ("fingerprint", "n_words", "removed", "kept", "id", "seed", "base", "spans", "size", "shard", "slot", "length", "node")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Makes a folder of tables from DataFrames by name."""

    def make(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return path

    return make
