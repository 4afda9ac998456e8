"""Agreed prices: a CSV whose first three columns are distributor, item code and price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuadre.schemas import MONEY


def agreed_prices(df: DataFrame) -> DataFrame:
    """Typed prices from text columns by position.

    Codes stay text (``02904`` keeps its zero); ``N/A`` and empty codes are null.
    """
    first = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns[:3]]).toDF("distributor", "item_code", "price")
    code = F.trim("item_code")
    return first.select(
        "distributor",
        F.when(~code.isin("", "N/A"), code).alias("item_code"),
        F.trim("price").try_cast(MONEY).alias("agreed_price"),
    )


def read_agreed_prices(spark: SparkSession, path: str) -> DataFrame:
    return agreed_prices(spark.read.option("header", True).csv(path))
