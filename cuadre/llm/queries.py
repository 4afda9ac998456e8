"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuadre.llm import alignment, checks, languages, maxent, neighbours, packing, quality, secret_scan, sharding, simhash, simple8b, spelling, templates, urls
from cuadre.llm.common import table
from cuadre.llm.registry import CHECKS, QUERIES, query
from cuadre.session import scratch_path

__all__ = ["CHECKS", "QUERIES"]


@query("op1_simple8b_output")
def op1_simple8b_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-segments")
    simple8b.write_segments(table(spark, sf_dir, "documents"), path)
    return simple8b.read_documents(spark, path)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


@query("op9_minimax_sharding")
def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op4_simhash_trie")
def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


@query("op2_host_reputation", checks.HOST_REPUTATION)
def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op10_template_decontamination")
def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_attention_quality")
def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_hilbert_neighbours")
def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query("op8_maxent_scoring")
def op8_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(table(spark, sf_dir, "documents"))


@query("op12_language_spans")
def op12_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.identify(docs, languages.train(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))
