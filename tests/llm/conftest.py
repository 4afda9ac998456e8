import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
CLASHING = ("key", "part", "fp", "score", "hash", "words", "n", "digest", "slots", "u", "v", "row", "token", "held_out", "base", "at", "size", "shard")


@pytest.fixture()
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture()
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977} runs{i % 31} far" for i in range(30_000))
    texts = [None, "", " ", "\n\n a  b c ᠎", "one", "one two", "é" * 50, "x" * 3000, long, "one two three four five six", "one two three four five six", "ONE TWO three four five six"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (3, texts[3]), (3, texts[3]), (5, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASHING}).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


@pytest.fixture()
def no_documents(documents):
    return documents.limit(0)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
