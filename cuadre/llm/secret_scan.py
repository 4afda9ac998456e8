"""Secret scans: fixed patterns, and character Markov models for what they miss (operator 6).

Two first-order character models are trained from labelled samples: random strings against ordinary
identifiers. A long run of identifier characters outside the fixed patterns is a secret if the log
ratio of its two likelihoods passes a threshold. DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuadre.llm.common import fresh, whole_text

#: The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: What the models judge: runs of this many identifier characters at least.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What counts as an ordinary identifier where no fixed pattern matches in the text.
ORDINARY = r"[A-Za-z0-9_]{12,}"
#: Natural log of the likelihood ratio from which a run is a secret: a million to one.
THRESHOLD = math.log(1e6)
ALPHABET = 66
SMOOTHING = 0.5
SEEDS = 3000

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, group: int, keep) -> Column:
    """Leftmost non-overlapping matches that pass ``keep`` of the group, as (start, kind, end)."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["before"])
        end = start + F.coalesce(F.length(part["found"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        more = F.when(part["found"].isNotNull() & keep(part["value"]), F.concat(done["out"], F.array(span))).otherwise(done["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda done: done["out"])).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind; code points, end exclusive."""
    always = lambda value: F.lit(True)
    found = (
        _spans(text, ASSIGN, 0, 2, lambda value: F.length(value) >= ASSIGN_LEAST), _spans(text, ACCESS, 1, 0, always), _spans(text, HEX, 2, 0, always),
    )
    return F.array_sort(F.concat(*found))


def _pairs(text: Column) -> Column:
    """Codes of neighbouring characters of an ASCII string: first * 128 + second."""
    codes = F.transform(F.split(text, ""), F.ascii)
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * 128 + b)


def seed_samples(spark: SparkSession, n: int = SEEDS) -> DataFrame:
    """Labelled random strings made by rule from digests: hexadecimal, base64 and upper-case ones."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    kinds = (F.left(digest, F.lit(40)), base64, F.left(F.upper(F.regexp_replace(base64, "[+/]", "")), F.lit(20)))
    return spark.range(n).select(F.explode(F.array(*kinds)).alias("value"), F.lit(True).alias("random"))


def corpus_samples(texts: DataFrame) -> DataFrame:
    """Labelled samples of ``text``: values of the fixed patterns are random, and where none of them
    matches, long identifiers are ordinary."""
    text = F.col("text")
    secret = F.flatten(F.array(F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))))
    marked = text.rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    values = F.when(marked, F.transform(secret, lambda v: F.struct(v.alias("value"), F.lit(True).alias("random")))).otherwise(
        F.transform(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0)), lambda v: F.struct(v.alias("value"), F.lit(False).alias("random")))
    )
    # outer: else the optimizer derives a filter that searches the text a second time
    return texts.select(F.explode_outer(values).alias("s")).select("s.value", "s.random")


def train(samples: DataFrame) -> list[float]:
    """Log ratio log P(b | a, random) - log P(b | a, ordinary) at a * 128 + b.

    ``samples``: value (ASCII), random (boolean). Counts are summed by Spark; the driver gets at
    most 2 * 128 * 128 of them.
    """
    pairs = samples.filter(F.length("value") > 1).select("random", F.explode_outer(_pairs(F.col("value"))).alias("pair"))
    count: dict[bool, dict[int, int]] = {True: {}, False: {}}
    first: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in pairs.groupBy("random", "pair").count().collect():
        count[row["random"]][row["pair"]] = row["count"]
        before = row["pair"] // 128
        first[row["random"]][before] = first[row["random"]].get(before, 0) + row["count"]

    def log_p(label: bool, pair: int) -> float:
        return math.log((count[label].get(pair, 0) + SMOOTHING) / (first[label].get(pair // 128, 0) + SMOOTHING * ALPHABET))

    return [log_p(True, pair) - log_p(False, pair) for pair in range(128 * 128)]


def likelihood_ratio(value: Column, model: list[float]) -> Column:
    """Natural log of the likelihood ratio of an ASCII string under the models."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    return F.aggregate(_pairs(value), F.lit(0.0), lambda total, pair: total + F.get(table, pair))


def all_spans(text: Column, base: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Base spans and those that the models add where no base span lies."""
    judged = _spans(text, CANDIDATE, 3, 0, lambda value: likelihood_ratio(value, model) >= threshold)
    free = F.filter(judged, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(F.concat(base, free))


def span_text(spans: Column) -> Column:
    name = lambda kind: F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def model_for(docs: DataFrame) -> list[float]:
    """Models trained on the seeds and on all of ``docs`` (text)."""
    return train(corpus_samples(docs.select(whole_text().alias("text"))).union(seed_samples(docs.sparkSession)))


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``docs`` has ``doc_id`` and ``text`` (null: empty); other columns are ignored, repeated rows stay.
    ``spans`` lists kind:start:end of all spans, those of the models as ``random``. Without ``model``
    the models are trained on the seeds and the documents themselves.
    """
    model = model or model_for(docs)
    found = docs.select(F.col("doc_id"), whole_text().alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    spans = found.select("doc_id", "base", all_spans(F.col("text"), F.col("base"), model).alias("spans"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of the scan replaced by ``mark``; all columns stay, ``n_chars`` follows the text."""
    model = model or model_for(docs)
    base, spans, clean = fresh(docs, "base_spans"), fresh(docs, "all_spans"), fresh(docs, "clean_text")
    found = docs.withColumn(base, base_spans(whole_text())).withColumn(spans, all_spans(whole_text(), F.col(base), model))

    def step(done: Column, s: Column) -> Column:
        """Overlapping spans get one mark."""
        gap = F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])
        return F.when(s["start"] >= done["at"], F.struct(s["end"].alias("at"), F.concat(done["out"], gap, F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    text = F.when(F.size(spans) > 0, whole).otherwise(F.col("text"))
    out = found.withColumn(clean, text)
    changed = {"text": F.col(clean)} | ({"n_chars": F.when(F.size(spans) > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*docs.columns)
