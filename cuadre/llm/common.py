"""What the operators share: written intermediate tables, free column names, ranks, salted look-ups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cuadre.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    A lost executor then costs a re-read of these files, never a replay of what made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_rank(df: DataFrame, group: str, part: str, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, without bringing a group together in one task.

    ``part`` splits every group into bounded pieces (the scan partition that made the row).
    Rows are numbered inside a piece; the pieces' counts, one row each, are summed up before.
    """
    counts = df.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, part, before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, part).orderBy(*order)) - 1
    return (
        df.withColumn("_inside", inside).join(starts, [group, part])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside")
    )


def salted_lookup(left: DataFrame, right: DataFrame, key: str, salt_by: Column, salts: int = 16) -> DataFrame:
    """Left join on ``key`` where one key may hold a large share of ``left``.

    ``right`` has one row for each key; it is repeated once for each salt, so the rows of a
    hot key spread over ``salts`` tasks. Spark counts the copies as one when it estimates sizes, so
    they are never left to it to broadcast through the driver.
    """
    salt = "_salt"
    spread = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.withColumn(salt, F.pmod(salt_by, F.lit(salts)).cast("int")).join(spread, [key, salt], "left").drop(salt)


def pylists(batches: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    """Columns of Arrow batches as Python lists."""
    for batch in batches:
        yield tuple(batch.column(n).to_pylist() for n in names)
