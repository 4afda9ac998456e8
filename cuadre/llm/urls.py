"""URL filters with empirical-Bayes host reputation (operator 2), in DataFrame functions only.

A listed rule decides first; pages that rules decide are the labelled outcomes. Other pages are
judged by their host: the outcomes of its labelled pages, shrunk through beta-binomial priors to
the registered domain's, those to the suffix's and those to the rate of all. A host is blocked if
the upper bound of its posterior good rate is below ``least``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cuadre.llm.common import salted_lookup, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels below which registrations are made (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")


class Rule(NamedTuple):
    host: str
    path: str
    allow: bool


RULES = (
    Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False),
)
LEAST, DEVIATIONS = 0.5, 1.645


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where registrations are made below a second level."""
    two = rf"(?s)\.((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$"
    return F.coalesce(F.nullif(F.regexp_extract(host, two, 1), F.lit("")), F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it."""
    rest = F.left(host, F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) > F.length(suffix) + 1, F.concat_ws(".", F.substring_index(rest, ".", -1), suffix)).otherwise(host)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and whether it allows; null where none fits."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        allow = F.when(fits, F.lit(rule.allow)).otherwise(allow)
    return text, allow


def _strength(rows: DataFrame, parent: str) -> float:
    """Prior strength by moments: how much children's rates differ from ``parent`` beyond chance."""
    n = F.col("good") + F.col("bad")
    m = F.col(parent)
    labelled = rows.filter(n > 0)
    r = labelled.agg(
        F.sum(n * F.pow(F.col("good") / n - m, F.lit(2.0)) - m * (1 - m)).alias("over"), F.sum((n - 1) * m * (1 - m)).alias("scale"),
    ).first()
    share = r["over"] / r["scale"] if r["scale"] else 0.5
    return 1 / min(max(share, 0.001), 0.999) - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior good rate of every host: host, good, bad, mean, upper.

    ``outcomes`` has ``host`` and counts ``good`` and ``bad`` (0 where nothing is labelled), one row
    for each host. The driver reads one prior strength for each level.
    """
    suffix = suffix_of(F.col("host"))
    hosts = outcomes.select("host", "good", "bad", domain_of(F.col("host"), suffix).alias("domain"), suffix.alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    suffixes = written(domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "suffixes")
    total = suffixes.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    overall = ((total["g"] or 0) + 1) / ((total["g"] or 0) + (total["b"] or 0) + 2)

    def shrunk(rows: DataFrame) -> Column:
        k = _strength(rows, "prior")
        return (F.col("good") + k * F.col("prior")) / (F.col("good") + F.col("bad") + k)

    suffixes = suffixes.withColumn("prior", F.lit(overall))
    suffixes = suffixes.select("suffix", shrunk(suffixes).alias("prior"))
    domains = written(salted_lookup(domains, suffixes, "suffix", F.hash("domain")), "domains")
    domains = domains.select("domain", shrunk(domains).alias("prior"))
    hosts = written(salted_lookup(hosts.drop("suffix"), domains, "domain", F.hash("host")), "hosts")
    k = _strength(hosts, "prior")
    a, b = F.col("good") + k * F.col("prior"), F.col("bad") + k * (1 - F.col("prior"))
    mean = a / (a + b)
    upper = mean + DEVIATIONS * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return hosts.select("host", "good", "bad", mean.alias("mean"), upper.alias("upper"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = LEAST) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, and the host's labelled pages.

    ``pages`` has ``page_id`` and ``url``; other columns are ignored. A url that is null or has no
    ``://`` has an empty host and path, which is judged as a host of its own. Repeated pages count
    each. An empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, allow = ruled(F.col("host"), F.col("path"), rules)
    marked = written(parsed.select("page_id", "host", "path", rule.alias("rule"), allow.alias("allow")), "pages")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    outcomes = written(marked.groupBy("host").agg(count(F.col("allow")).alias("good"), count(~F.col("allow")).alias("bad")), "outcomes")
    known = reputation(outcomes).select("host", "good", "bad", (F.col("upper") >= least).alias("trusted"))
    verdict = F.when(F.coalesce("allow", "trusted"), F.lit("allow")).otherwise(F.lit("block"))
    return salted_lookup(marked, known, "host", F.xxhash64("page_id", "path")).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("good").alias("host_good"), F.col("bad").alias("host_bad")
    )
