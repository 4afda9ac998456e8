"""Product catalogs as CSV: layout detection, vendor tag, distinct products; product master."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuadre.functions.text import strip

# Header names (trimmed, lower case) per layout, and vendors named in files.
LAYOUTS = [("code", "item"), ("items", "description")]
VENDORS = ["Bindi", "Bridor"]


def _find(columns: list[str], names: tuple[str, str]) -> tuple[str | None, str | None]:
    """The last column under each header name."""
    found = {c.strip().lower(): c for c in columns}
    return found.get(names[0]), found.get(names[1])


def detect_layout(columns: list[str]) -> tuple[str, str] | None:
    """(code column, name column), or None when the header fits no layout.

    The second layout is tried when either column of the first is missing, and
    fills in only what it finds.
    """
    code, item = _find(columns, LAYOUTS[0])
    if code is None or item is None:
        other = _find(columns, LAYOUTS[1])
        code, item = other[0] or code, other[1] or item
    return (code, item) if code is not None and item is not None else None


def vendor_tag(file_name: Column) -> Column:
    """The first known vendor contained in the file name, else ``Unknown``."""
    tag = F.lit("Unknown")
    for vendor in reversed(VENDORS):
        tag = F.when(F.contains(F.lower(file_name), F.lit(vendor.lower())), vendor).otherwise(tag)
    return tag


def _raw(spark: SparkSession, paths: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """All columns as text: codes keep their leading zeros, values their blanks."""
    return (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("pathGlobFilter", pattern).csv(paths)
    )


def file_headers(spark: SparkSession, path: str, pattern: str = "*.csv") -> dict[str, list[str]]:
    """First line -> the files that begin with it, in path order. One line per file reaches the driver."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("line"))
    found: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        found.setdefault(row["line"], []).append(unquote(row["file"]))
    return found


def read_catalog(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame | None:
    """Raw (code, item, file_name, vendor) rows of the catalog files of a folder.

    Each file is read by its own header; files whose header fits no layout are left
    out, and None is returned when that leaves none. Files with equal headers are one
    scan. Spark names repeated and empty headers apart, so they do no harm.
    """
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    frames = []
    for paths in file_headers(spark, path, pattern).values():
        raw = _raw(spark, paths)
        if (layout := detect_layout(raw.columns)) is not None:
            frames.append(raw.select(
                F.col(f"`{layout[0]}`").alias("code"), F.col(f"`{layout[1]}`").alias("item"),
                F.url_decode(name).alias("file_name"), vendor_tag(name).alias("vendor")))
    return reduce(DataFrame.unionByName, frames) if frames else None


def read_catalogs(spark: SparkSession, paths: list[tuple[str, str]]) -> DataFrame:
    """The union of several (folder, file pattern) groups; files without a known layout are left out."""
    frames = [f for f in (read_catalog(spark, p, g) for p, g in paths) if f is not None]
    if not frames:
        raise ValueError("no catalog with a known layout")
    return reduce(DataFrame.unionByName, frames)


def distinct_products(catalog: DataFrame) -> DataFrame:
    """Distinct raw (code, item) per vendor, then trimmed; rows without a name are dropped."""
    once = catalog.select("vendor", "code", "item").distinct()
    name = strip(F.col("item"))
    return once.select("vendor", strip(F.col("code")).alias("code"), name.alias("name")).where(
        F.coalesce(name, F.lit("")).isin("", "nan") == F.lit(False))


def product_master(df: DataFrame) -> DataFrame:
    """Master rows from ``SKU, Product Name, Category?, Unit?``; missing columns become null."""
    optional = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(F.col("SKU").cast("string").alias("master_sku"), F.col("Product Name").alias("master_name"),
                     optional("Category").alias("category"), optional("Unit").alias("unit"))


def read_product_master(spark: SparkSession, path: str) -> DataFrame:
    return product_master(spark.read.option("header", True).csv(path))
