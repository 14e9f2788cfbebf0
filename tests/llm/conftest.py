import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def awkward(spark, extra="source string, lang string"):
    """Nulls, empty texts, ties, repeated rows, a very long text, odd characters, clashing columns."""
    rows = [
        (1, "Hello World again and again.\nSame line here today ok\n", "a", "en"),
        (2, None, "a", None), (3, "", None, "en"), (4, "hello world AGAIN and again.\nSame line here today ok\n", "b", "en"),
        (5, "x" * 30_000 + " tail", "b", "fr"), (6, "12345 !!! ???", "c", "de"), (None, "no id at all", "c", "de"),
        (7, "naïve Ünïcode text andİ ΣΣ", "c", "fr"), (8, "Same line here today ok", "c", "en"),
        (8, "Same line here today ok", "c", "en"), (9, " \t\r\n ", None, None), (10, "<|endoftext|> x <|startoftext|>", "a", "en"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").selectExpr(
        "*", "1 AS copy", "2 AS score", "3 AS text_key", "4 AS row_id", "'q' AS n", "5L AS n_chars", "'s' AS count", "6 AS piece", "7 AS labels"
    )


@pytest.fixture(scope="session")
def odd(spark):
    return awkward(spark)
