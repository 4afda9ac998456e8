"""A corpus pipeline: quality classifier, SimHash near-dedup, decontamination, secret redaction, packing.

Each stage works on all that its predecessor kept, and is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cuadre.llm import packing, quality, secret_scan, simhash, templates
from cuadre.llm.common import fresh, table, whole_text, written


def _identified(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a digest of doc_id and text, never null; equal only for repeated documents."""
    return docs.withColumn(name, F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), whole_text()).cast("binary"), 256))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Every row is judged for itself, repeated ones alike; a null text
    counts as empty and is judged too. An empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints (three-word shingles, at most two differing bits) stays: the
    one of the smallest doc_id (null last), then of the smallest digest; of repeated rows one. Texts that are null,
    empty or without words have one fingerprint and are one group. An empty table stays empty."""
    key = fresh(docs, "digest")
    marked = _identified(docs, key)
    prints = written(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("digest"), simhash.fingerprint_udf(whole_text()).alias("fp")), "stage-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = written(prints.groupBy("fp").agg(first.alias("first")), "stage-classes")
    kept = simhash.first_of_components(classes, "first").select(F.col("first.digest").alias(key))
    # rows with equal digests are repeated rows: the join has brought them together, one of them stays
    copy = fresh(marked, "copy")
    number = F.row_number().over(Window.partitionBy(key).orderBy(key))
    # what stays is about as large as the documents, so the join sorts and merges at every size
    return marked.join(written(kept, "stage-kept").hint("merge"), key).withColumn(copy, number).filter(F.col(copy) == 1).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold windows of a benchmark item, also with other numbers and names. Null and empty texts hold
    none and stay, as do repeated rows that hold none; with no benchmark items every row stays."""
    key = fresh(docs, "digest")
    marked = _identified(docs, key)
    hit = written(templates.contaminated(marked, table(spark, sf_dir, "benchmark"), key).select(key).distinct(), "stage-contaminated")
    # the contaminated documents have no size bound either: one plan for every size, no broadcast
    return marked.join(hit.hint("merge"), key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every row stays, a null text as null and an empty one as empty."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in sequences of 2,048 tokens. A null or empty text is one piece of
    its end id, repeated rows are packed each for itself, and an empty table gives no pieces."""
    return packing.pack(docs, keep_ids=False).drop("ids")


STAGES = [
    ("quality classifier", keep_good_quality),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: A learned classifier, byte-pair encoding and Markov models are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
