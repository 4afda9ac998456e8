"""Checking SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from cuadre.llm.urls import DEVIATIONS, LEAST, LOWER, RULES, SECOND_LEVEL, UPPER


def _fits(rule) -> str:
    return f"((host = '{rule.host}' OR suffix(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


def _strength(rows: str) -> str:
    """Prior strength by moments over rows with good, bad and prior."""
    return f"""(SELECT 1 / least(greatest(coalesce(sum((good + bad) * pow(good / (good + bad) - prior, 2) - prior * (1 - prior))
      / nullif(sum((good + bad - 1) * prior * (1 - prior)), 0), 0.5), 0.001), 0.999) - 1 AS k FROM {rows} WHERE good + bad > 0)"""


_LONGEST = sorted(RULES, key=lambda r: -len(r.host + r.path))

HOST_REPUTATION = f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
marked AS (
  SELECT page_id, host, path, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r.host}{r.path}'" for r in _LONGEST)} END AS rule,
    CASE {' '.join(f"WHEN {_fits(r)} THEN {'true' if r.allow else 'false'}" for r in _LONGEST)} END AS allow FROM parsed),
outcomes AS (SELECT host, count(*) FILTER (allow) AS good, count(*) FILTER (NOT allow) AS bad FROM marked GROUP BY host),
split AS (
  SELECT *, CASE WHEN regexp_matches(host, '\\.({'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}}$') THEN regexp_extract(host, '\\.((?:{'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}})$', 1)
    ELSE string_split(host, '.')[-1] END AS suffix FROM outcomes),
named AS (
  SELECT *, CASE WHEN length(host) > length(suffix) + 1
    THEN concat(string_split(left(host, length(host) - length(suffix) - 1), '.')[-1], '.', suffix) ELSE host END AS domain FROM split),
overall AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(good), 0) + coalesce(sum(bad), 0) + 2) AS prior FROM named),
s1 AS (SELECT suffix, sum(good) AS good, sum(bad) AS bad, any_value(prior) AS prior FROM named, overall GROUP BY suffix),
s2 AS (SELECT suffix, (good + k * prior) / (good + bad + k) AS prior FROM s1, {_strength("s1")} x),
d1 AS (SELECT domain, suffix, sum(good) AS good, sum(bad) AS bad, any_value(s2.prior) AS prior FROM named JOIN s2 USING (suffix) GROUP BY domain, suffix),
d2 AS (SELECT domain, (good + k * prior) / (good + bad + k) AS prior FROM d1, {_strength("d1")} x),
h1 AS (SELECT host, good, bad, d2.prior FROM named JOIN d2 USING (domain)),
h2 AS (SELECT host, good, bad, good + k * prior AS a, bad + k * (1 - prior) AS b FROM h1, {_strength("h1")} x),
h3 AS (SELECT host, good, bad, a / (a + b) + {DEVIATIONS} * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) >= {LEAST} AS trusted FROM h2)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, trusted) THEN 'allow' ELSE 'block' END AS verdict, good AS host_good, bad AS host_bad
FROM marked JOIN h3 USING (host)"""
