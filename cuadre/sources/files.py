"""Invoice files: listing, acceptance, and which of them are new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuadre.functions.text import INVOICE_EXTENSIONS, file_extension, media_type


def list_files(spark: SparkSession, folders: list[str], extensions: list[str] | None = None) -> DataFrame:
    """Files directly in several folders with id, name, type, size and time, newest first.

    Contents are not read; the case of an extension does not matter.
    """
    wanted = [e.lower() for e in (extensions or INVOICE_EXTENSIONS)]

    def one(folder: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(folder)
        return files.where(file_extension(F.col("path")).isin(wanted)).select(
            F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"),
            F.when(file_extension(F.col("path")) == "pdf", "application/pdf").otherwise(media_type(F.col("path"))).alias("mime_type"),
            F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.lit(folder).alias("folder_id"))

    return reduce(DataFrame.unionByName, [one(f) for f in folders]).orderBy(F.col("modified_at").desc(), "id")


def new_files(listing: DataFrame, invoices: DataFrame) -> DataFrame:
    """Listed files that no invoice names as its source."""
    done = invoices.where(F.col("source_file_id").isNotNull()).select(F.col("source_file_id").alias("id"))
    return listing.join(done, "id", "left_anti")
