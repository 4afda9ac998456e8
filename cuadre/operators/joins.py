"""Dimension joins that stay even when the key is mostly null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Copies of a dimension that the rows of one key are spread over.
COPIES = 32


def lookup(df: DataFrame, dim: DataFrame, key: str, row: str = "id", also: Sequence[str] = ()) -> DataFrame:
    """Left join of a dimension on a key that may be null in many rows.

    Null keys match nothing, so those rows are spread by a hash of ``row``
    instead of meeting in one partition.
    """
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(row), F.lit(4096))).otherwise(0)
    return (
        df.withColumn("_spread", spread)
        .join(dim.withColumn("_spread", F.lit(0).cast("bigint")), [key, *also, "_spread"], "left")
        .drop("_spread")
    )


def lookup_apart(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of a dimension on a key that many wide rows lack: these match nothing and are not moved at all.

    ``df`` is read once for each kind of row, with a filter on the key that Spark pushes down.
    """
    found = [F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema.fields if f.name != key]
    known = df.where(F.col(key).isNotNull()).join(dim, key, "left")
    return known.unionByName(df.where(F.col(key).isNull()).select("*", *found))


def lookup_hot(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of a small dimension on a key of which single values, or null, may be in most rows.

    The rows of one key meet :data:`COPIES` copies of its entry, told apart by a hash of the row.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    bigint = lambda n: F.lit(n).cast("bigint")
    copies = dim.withColumn("_spread", F.explode(F.sequence(bigint(0), bigint(COPIES - 1))))
    return df.withColumn("_spread", F.pmod(F.xxhash64(*plain), bigint(COPIES))).join(copies, [key, "_spread"], "left").drop("_spread")
