"""Queries for name similarity, entity resolution, mappings and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuadre.functions.similarity import similarity_parts
from cuadre.operators import cluster, normalize, reports
from cuadre.plans.fixtures import view
from cuadre.plans.ingest_queries import CATALOG_SQL, read_catalogs
from cuadre.plans.registry import query
from cuadre.plans.report_queries import MAKERS_SQL
from cuadre.schemas import natural_id
from cuadre.session import cut

# ---- similarity in SQL, for checks -----------------------------------------


def _norm(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({column}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


# From ``pairs (a, b)`` (normalized, distinct, not empty) to ``scores (a, b, parts, score)``.
SCORES_SQL = """
words AS (SELECT *, list_sort(list_distinct(string_split(a, ' '))) AS ta, list_sort(list_distinct(string_split(b, ' '))) AS tb FROM pairs),
sets AS (SELECT *, array_to_string(list_sort(list_filter(ta, lambda t: list_contains(tb, t))), ' ') AS common,
    array_to_string(list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ') AS only_a,
    array_to_string(list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ') AS only_b,
    CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM words),
turned AS (SELECT a, b, s, l FROM sets UNION SELECT a, b, l, s FROM sets WHERE length(s) = length(l)),
windows AS (SELECT DISTINCT a, b, s AS x, unnest(list_concat(
    list_transform(range(1, length(l) - length(s) + 2), lambda i: substr(l, i, length(s))),
    list_concat(list_transform(range(1, length(s)), lambda i: substr(l, 1, i)),
                list_transform(range(1, length(s)), lambda i: right(l, i))))) AS y FROM turned),
jobs AS (
  SELECT a, b, 'ratio' AS kind, a AS x, b AS y FROM pairs
  UNION ALL SELECT a, b, 'sort', array_to_string(list_sort(string_split(a, ' ')), ' '), array_to_string(list_sort(string_split(b, ' ')), ' ') FROM pairs
  UNION ALL SELECT a, b, 'set', only_a, only_b FROM sets
  UNION ALL SELECT a, b, 'window', x, y FROM windows),
todo AS (SELECT DISTINCT x, y FROM jobs),
masks AS (SELECT x, c, CAST(sum(CAST(1 AS HUGEINT) << CAST(i - 1 AS INT)) AS HUGEINT) AS mask
  FROM (SELECT x, unnest(range(1, length(x) + 1)) AS i, unnest(string_split(x, '')) AS c FROM (SELECT DISTINCT x FROM todo WHERE x <> '') d) e
  GROUP BY x, c),
tables AS (SELECT x, map(list(c), list(mask)) AS m FROM masks GROUP BY x),
lcs AS (SELECT t.x, t.y, CASE WHEN t.x = '' OR t.y = '' THEN 0 ELSE length(t.x) - bit_count(list_reduce(
    list_transform(string_split(t.y, ''), lambda c: coalesce(m[c], CAST(0 AS HUGEINT))),
    lambda v, k: ((v + (v & k)) | (v & (((CAST(1 AS HUGEINT) << length(t.x)) - 1) - k))) & ((CAST(1 AS HUGEINT) << length(t.x)) - 1),
    (CAST(1 AS HUGEINT) << length(t.x)) - 1)) END AS n FROM todo t LEFT JOIN tables ON tables.x = t.x),
parts AS (SELECT a, b,
    max(CASE WHEN kind = 'ratio' THEN round_even(200.0::DOUBLE * n / (length(j.x) + length(j.y)), 0) END) AS ratio,
    max(CASE WHEN kind = 'window' THEN round_even(200.0::DOUBLE * n / (length(j.x) + length(j.y)), 0) END) AS partial_ratio,
    max(CASE WHEN kind = 'sort' THEN round_even(200.0::DOUBLE * n / (length(j.x) + length(j.y)), 0) END) AS token_sort,
    max(CASE WHEN kind = 'set' THEN n END) AS n_set
  FROM jobs j JOIN lcs ON lcs.x = j.x AND lcs.y = j.y GROUP BY a, b),
lengths AS (SELECT a, b, length(common) AS i, length(only_a) AS u, length(only_b) AS v, CASE WHEN common = '' THEN 0 ELSE 1 END AS g FROM sets),
scores AS (SELECT *, (2 * ratio + 2 * partial_ratio + 3 * token_sort + 3 * token_set) / 10 AS score FROM (
  SELECT p.a, p.b, ratio, partial_ratio, token_sort,
    CASE WHEN i > 0 AND (u = 0 OR v = 0) THEN 100.0::DOUBLE
         ELSE greatest(round_even(100.0::DOUBLE * (2 * (i + g) + 2 * n_set) / (2 * (i + g) + u + v), 0),
                       CASE WHEN i > 0 THEN round_even(200.0::DOUBLE * i / (2 * i + 1 + u), 0) ELSE 0 END,
                       CASE WHEN i > 0 THEN round_even(200.0::DOUBLE * i / (2 * i + 1 + v), 0) ELSE 0 END) END AS token_set
  FROM parts p JOIN lengths n ON n.a = p.a AND n.b = p.b) t)"""

_ALPHABET = " abcdefghijklmnopqrstuvwxyz0123456789"


def best_scores_sql(threshold: float, k: int, scoped: bool = False) -> str:
    """From ``pairs (a, b)`` (with ``scoped``: from ``scoped (scope, a, b)`` too) to ``scores (a, b, score)``: of every ``a`` (in every scope) all that reach the threshold and its ``k``-th best score.

    In stages, each by an upper bound of the score: shared characters (three bits for each character, the rest
    counted), then the parts without windows, then the windows of pairs that can still be among the best ``k``. A window
    as long as the shorter name holds all of the common subsequence but at most the difference of the lengths.
    Names up to 62 characters.
    """
    lcs = lambda x, y: f"""{x}.len - bit_count(list_reduce(list_transform({y}.codes, lambda c: {x}.masks[c]),
        lambda v, k: ((v + (v & k)) | (v & ({x}.ones - k))) & {x}.ones, {x}.ones))"""  # noqa: E731
    percent = lambda x, y: f"CASE WHEN {x}.len + {y}.len = 0 THEN 100.0 ELSE round_even(200.0::DOUBLE * ({lcs(x, y)}) / ({x}.len + {y}.len), 0) END"
    strings = lambda name, source: f"""{name} AS MATERIALIZED (SELECT n, length(n) AS len, (CAST(1 AS BIGINT) << length(n)) - 1 AS ones,
    list_transform(string_split('{_ALPHABET}', ''), lambda c: coalesce(list_sum(list_transform(list_filter(range(1, length(n) + 1),
        lambda i: n[i] = c), lambda i: CAST(1 AS BIGINT) << CAST(i - 1 AS INT))), 0)::BIGINT) AS masks,
    list_transform(range(1, length(n) + 1), lambda i: strpos('{_ALPHABET}', n[i])) AS codes FROM ({source}) d)"""  # noqa: E731
    ranked, key = ("scoped JOIN based USING (a, b)", "scope, a") if scoped else ("based", "a")
    return f"""
sized AS (SELECT n, length(n) AS len, list_sum(list_transform(range(0, {len(_ALPHABET)}), lambda i:
    ((CAST(1 AS HUGEINT) << CAST(least(length(n) - length(replace(n, substr('{_ALPHABET}', i + 1, 1), '')), 3) AS INT)) - 1) << CAST(3 * i AS INT)))::HUGEINT AS bits
  FROM (SELECT a AS n FROM pairs UNION SELECT b FROM pairs) d),
signed AS MATERIALIZED (SELECT n, len, bits, len - bit_count(bits) AS extra, list_sort(string_split(n, ' ')) AS words FROM sized),
near AS MATERIALIZED (SELECT a, b, shared, wa, wb FROM (
    SELECT a, b, x.len AS la, y.len AS lb, bit_count(x.bits & y.bits) + least(x.extra, y.extra) AS shared, x.words AS wa, y.words AS wb
    FROM pairs JOIN signed x ON x.n = a JOIN signed y ON y.n = b) c
  WHERE 100.0 * shared / (la + lb) + 40.0 * shared / (least(la, lb) + shared) + 30.5 >= {threshold}),
sets AS MATERIALIZED (SELECT a, b, array_to_string(wa, ' ') AS sort_a, array_to_string(wb, ' ') AS sort_b,
    array_to_string(list_sort(list_distinct(list_filter(wa, lambda t: list_contains(wb, t)))), ' ') AS common,
    array_to_string(list_sort(list_distinct(list_filter(wa, lambda t: NOT list_contains(wb, t)))), ' ') AS only_a,
    array_to_string(list_sort(list_distinct(list_filter(wb, lambda t: NOT list_contains(wa, t)))), ' ') AS only_b FROM near),
{strings("strs", "SELECT unnest([a, b, sort_a, sort_b, only_a, only_b]) AS n FROM sets UNION SELECT ''")},
parts AS MATERIALIZED (SELECT a, b, {percent("x", "y")} AS ratio, {percent("sx", "sy")} AS token_sort,
    greatest({lcs("x", "y")} - abs(x.len - y.len), 0) * 100.0::DOUBLE / least(x.len, y.len) AS least_partial,
    length(common) AS i, ux.len AS u, uy.len AS v, CASE WHEN common = '' THEN 0 ELSE 1 END AS g, {lcs("ux", "uy")} AS n_set
  FROM sets JOIN strs x ON x.n = a JOIN strs y ON y.n = b JOIN strs sx ON sx.n = sort_a JOIN strs sy ON sy.n = sort_b
  JOIN strs ux ON ux.n = only_a JOIN strs uy ON uy.n = only_b),
based AS MATERIALIZED (SELECT a, b, round_even(least_partial, 0) AS least_partial, 2 * ratio + 3 * token_sort + 3 * CASE WHEN i > 0 AND (u = 0 OR v = 0) THEN 100.0::DOUBLE
    ELSE greatest(round_even(100.0::DOUBLE * (2 * (i + g) + 2 * n_set) / (2 * (i + g) + u + v), 0),
                  CASE WHEN i > 0 THEN round_even(200.0::DOUBLE * i / (2 * i + 1 + u), 0) ELSE 0 END,
                  CASE WHEN i > 0 THEN round_even(200.0::DOUBLE * i / (2 * i + 1 + v), 0) ELSE 0 END) END AS base FROM parts),
kept AS MATERIALIZED (SELECT DISTINCT a, b, base FROM {ranked} JOIN (SELECT {key}, max(base + 2 * least_partial, {k}) AS tops FROM {ranked} GROUP BY {key}) t USING ({key})
  WHERE base + 200 >= {10 * threshold} AND base + 200 >= coalesce(tops[{k}], 0)),
turned AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM kept
  UNION SELECT a, b, b, a FROM kept WHERE length(a) = length(b)),
windows AS MATERIALIZED (SELECT DISTINCT a, b, s, unnest(list_concat(
    list_transform(range(1, length(l) - length(s) + 2), lambda i: substr(l, i, length(s))),
    list_concat(list_transform(range(1, length(s)), lambda i: substr(l, 1, i)),
                list_transform(range(1, length(s)), lambda i: right(l, i))))) AS w FROM turned),
{strings("cuts", "SELECT s AS n FROM windows UNION SELECT w FROM windows")},
best_window AS (SELECT a, b, max({percent("x", "y")}) AS partial FROM windows JOIN cuts x ON x.n = s JOIN cuts y ON y.n = w GROUP BY a, b),
scores AS (SELECT a, b, (base + 2 * partial) / 10 AS score FROM kept JOIN best_window USING (a, b) WHERE (base + 2 * partial) / 10 >= {threshold})"""


# each item name against the master name of its own part
_OWN_NAMES = f"""
names AS (SELECT DISTINCT i.vendor_product_name AS item_name, p.master_name FROM fx_items i JOIN fx_products p
  ON i.vendor_sku = CAST(p.id AS STRING)),
pairs AS (SELECT DISTINCT {_norm('item_name')} AS a, {_norm('master_name')} AS b FROM names)"""


def own_names(spark: SparkSession, sf: str) -> DataFrame:
    master = view(spark, sf, "fx_products").select(F.col("id").cast("string").alias("vendor_sku"), "master_name")
    pairs = view(spark, sf, "fx_items").join(master, "vendor_sku").select(
        F.col("vendor_product_name").alias("item_name"), "master_name").distinct()
    return pairs.withColumn("s", similarity_parts(F.col("item_name"), F.col("master_name"))).select("item_name", "master_name", "s.*")


def _part(name: str, part: str) -> None:
    @query(name, f"""WITH {_OWN_NAMES}, {SCORES_SQL}
SELECT item_name, master_name, {part} FROM names JOIN scores ON a = {_norm('item_name')} AND b = {_norm('master_name')}""")
    def run(spark, sf):
        return own_names(spark, sf).select("item_name", "master_name", part)


_part("sim_ratio", "ratio")
_part("sim_partial", "partial_ratio")
_part("sim_token_sort", "token_sort")
_part("sim_token_set", "token_set")
_part("similarity_scores", "score")

# ---- similar names ---------------------------------------------------------


@query("similar_products", f"""WITH asked AS (SELECT DISTINCT master_name AS name, {_norm('master_name')} AS a FROM fx_products),
sold AS (SELECT DISTINCT vendor_product_name AS product_name, vendor_id, {_norm('vendor_product_name')} AS b FROM fx_items),
pairs AS (SELECT x.a, y.b FROM (SELECT DISTINCT a FROM asked WHERE a <> '') x, (SELECT DISTINCT b FROM sold WHERE b <> '') y),
{best_scores_sql(70, 5)}
SELECT name, product_name, vendor_id, similarity_score, CAST(rank AS INT) AS rank FROM (
  SELECT name, product_name, vendor_id, score AS similarity_score,
    row_number() OVER (PARTITION BY name ORDER BY score DESC, product_name, vendor_id) AS rank
  FROM scores JOIN asked USING (a) JOIN sold USING (b)) r WHERE rank <= 5""")
def similar_products(spark, sf):
    """For every master product, the five most similar names on invoices."""
    asked = view(spark, sf, "fx_products").select(F.col("master_name").alias("name"))
    return normalize.similar_products(asked, view(spark, sf, "fx_items"))


_VENDOR_PAIRS = f"""
asked AS (SELECT DISTINCT v.name, CASE WHEN s_nationkey > 12 THEN v.nit END AS nit FROM fx_vendor_variants v JOIN supplier ON s_suppkey = v.id),
pairs AS (SELECT DISTINCT {_norm('q.name')} AS a, {_norm('v.name')} AS b FROM asked q, fx_vendor_variants v)"""


@query("similar_vendors", f"""WITH {_VENDOR_PAIRS}, {SCORES_SQL},
hits AS (SELECT q.name, q.nit, v.id AS vendor_id, v.name AS vendor_name, v.nit AS vendor_nit,
    CASE WHEN q.nit = v.nit THEN 100.0::DOUBLE ELSE score END AS similarity_score
  FROM asked q JOIN fx_vendor_variants v ON true JOIN scores ON a = {_norm('q.name')} AND b = {_norm('v.name')})
SELECT name, nit, vendor_id, vendor_name, vendor_nit, similarity_score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY name, nit ORDER BY similarity_score DESC, vendor_name, vendor_id) AS rank
  FROM hits WHERE similarity_score >= 70) r WHERE rank <= 5""")
def similar_vendors(spark, sf):
    vendors = view(spark, sf, "fx_vendor_variants")
    nations = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    asked = vendors.join(nations, "id").select("name", F.when(F.col("s_nationkey") > 12, F.col("nit")).alias("nit"))
    return normalize.similar_vendors(asked, vendors.select("id", "name", "nit"))


@query("similar_stores", f"""WITH asked AS (SELECT DISTINCT store_name AS name, {_norm('store_name')} AS a FROM fx_heads),
pool AS (SELECT id AS store_id, name AS store_name, code AS store_code, {_norm('name')} AS b FROM fx_stores),
pairs AS (SELECT x.a, y.b FROM (SELECT DISTINCT a FROM asked WHERE a <> '') x, (SELECT DISTINCT b FROM pool WHERE b <> '') y),
{best_scores_sql(70, 5)}
SELECT name, store_id, store_name, store_code, similarity_score, CAST(rank AS INT) AS rank FROM (
  SELECT name, store_id, store_name, store_code, score AS similarity_score,
    row_number() OVER (PARTITION BY name ORDER BY score DESC, store_name, store_id) AS rank
  FROM scores JOIN asked USING (a) JOIN pool USING (b)) r WHERE rank <= 5""")
def similar_stores(spark, sf):
    """For every store name that files give, the five most similar stores."""
    asked = view(spark, sf, "fx_heads").select(F.col("store_name").alias("name"))
    return normalize.similar_stores(asked, view(spark, sf, "fx_stores"))


# ---- mappings --------------------------------------------------------------

# reviewed names: all variants of the Bridor catalog (for every vendor) and the names of large orders (per vendor)
_MAPPINGS = """
mappings AS (
  SELECT DISTINCT concat('g-', vendor_product_name) AS id, vendor_product_name AS variant_name, CAST(NULL AS BIGINT) AS vendor_id,
    concat('n-', vendor_product_name) AS normalized_product_id,
    CASE WHEN contains(vendor_product_name, 'Bridor') THEN 'approved' ELSE 'pending' END AS status FROM fx_items
  WHERE contains(vendor_product_name, 'Bridor') OR contains(vendor_product_name, 'Lavazza')
  UNION ALL
  SELECT DISTINCT concat('v-', vendor_product_name, CAST(vendor_id AS STRING)), vendor_product_name, vendor_id,
    concat('v-', vendor_product_name), 'approved' FROM fx_items WHERE quantity > 40),
normalized AS (SELECT DISTINCT normalized_product_id AS id, variant_name AS normalized_name, status AS normalized_code, 'all' AS category
  FROM mappings)"""


def _mappings(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "fx_items").select(F.col("vendor_product_name").alias("variant_name"), "vendor_id", "quantity")
    general = items.where(F.col("variant_name").contains("Bridor") | F.col("variant_name").contains("Lavazza")).select("variant_name").distinct().select(
        F.concat(F.lit("g-"), "variant_name").alias("id"), "variant_name", F.lit(None).cast("bigint").alias("vendor_id"),
        F.concat(F.lit("n-"), "variant_name").alias("normalized_product_id"),
        F.when(F.col("variant_name").contains("Bridor"), "approved").otherwise("pending").alias("status"))
    own = items.where(F.col("quantity") > 40).select("variant_name", "vendor_id").distinct().select(
        F.concat(F.lit("v-"), "variant_name", "vendor_id").alias("id"), "variant_name", "vendor_id",
        F.concat(F.lit("v-"), "variant_name").alias("normalized_product_id"), F.lit("approved").alias("status"))
    return general.unionByName(own)


@query("normalized_lookup", f"""WITH {_MAPPINGS}
SELECT variant_name, vendor_id, normalized_product_id, normalized_name, normalized_code, category FROM (
  SELECT i.variant_name, i.vendor_id, coalesce(o.normalized_product_id, g.normalized_product_id) AS normalized_product_id
  FROM (SELECT DISTINCT vendor_product_name AS variant_name, vendor_id FROM fx_items) i
  LEFT JOIN mappings o ON o.variant_name = i.variant_name AND o.vendor_id = i.vendor_id AND o.status = 'approved'
  LEFT JOIN mappings g ON g.variant_name = i.variant_name AND g.vendor_id IS NULL AND g.status = 'approved') x
JOIN normalized n ON n.id = x.normalized_product_id""")
def normalized_lookup(spark, sf):
    mappings = _mappings(spark, sf)
    normalized = mappings.select(F.col("normalized_product_id").alias("id"), F.col("variant_name").alias("normalized_name"),
                                 F.col("status").alias("normalized_code"), F.lit("all").alias("category")).distinct()
    asked = view(spark, sf, "fx_items").select(F.col("vendor_product_name").alias("variant_name"), "vendor_id")
    return normalize.normalized_lookup(asked, mappings, normalized)


_UNMAPPED = f"""{_MAPPINGS},
unmapped AS (SELECT vendor_product_name, vendor_id, count(*) AS item_count FROM fx_items i WHERE NOT EXISTS (
  SELECT 1 FROM mappings m WHERE m.status = 'approved' AND m.variant_name = i.vendor_product_name
  AND (m.vendor_id IS NULL OR m.vendor_id = i.vendor_id)) GROUP BY 1, 2)"""


@query("unmapped_products", f"WITH {_UNMAPPED} SELECT * FROM unmapped")
def unmapped_products(spark, sf):
    return normalize.unmapped_products(view(spark, sf, "fx_items"), _mappings(spark, sf))


@query("normalization_suggestions", f"""WITH {_UNMAPPED},
todo AS (SELECT vendor_product_name AS variant_name, vendor_id, item_count, {_norm('vendor_product_name')} AS a FROM unmapped),
sold AS (SELECT DISTINCT vendor_product_name AS suggested_name, vendor_id, {_norm('vendor_product_name')} AS b FROM fx_items),
scoped AS (SELECT DISTINCT vendor_id AS scope, a, b FROM todo JOIN sold USING (vendor_id) WHERE a <> '' AND b <> '' AND a <> b),
pairs AS (SELECT DISTINCT a, b FROM scoped),
{best_scores_sql(70, 3, scoped=True)},
ranked AS (SELECT variant_name, vendor_id, item_count, suggested_name, score,
    row_number() OVER (PARTITION BY variant_name, vendor_id ORDER BY score DESC, suggested_name) AS rank,
    max(score) OVER (PARTITION BY variant_name, vendor_id) >= 95 AS auto_approve
  FROM todo JOIN sold USING (vendor_id) JOIN scores USING (a, b))
SELECT variant_name, vendor_id, v.name AS vendor_name, item_count, suggested_name, score AS similarity_score, CAST(rank AS INT) AS rank, auto_approve
FROM ranked LEFT JOIN fx_vendors v ON v.id = vendor_id WHERE rank <= 3""")
def normalization_suggestions(spark, sf):
    """The three most similar names of the same vendor for every product without mapping."""
    return normalize.normalization_suggestions(
        view(spark, sf, "fx_items"), view(spark, sf, "fx_vendors"), _mappings(spark, sf))


@query("mapping_rows", f"""WITH {_MAPPINGS}
SELECT variant_name, vendor_id, normalized_product_id, 'pending' AS status FROM mappings""")
def mapping_rows(spark, sf):
    requests = _mappings(spark, sf).drop("id", "status")
    return normalize.create_mappings(requests, ["variant_name", "vendor_id", "normalized_product_id"]).select(
        "variant_name", "vendor_id", "normalized_product_id", "status")


@query("normalized_entities", """
SELECT 'product' AS kind, master_name AS name, category FROM fx_products
UNION ALL SELECT 'vendor', name, nit FROM fx_vendors UNION ALL SELECT 'store', name, city FROM fx_stores""")
def normalized_entities(spark, sf):
    v = lambda n: view(spark, sf, n)
    products = normalize.create_normalized_products(v("fx_products").select(
        F.col("master_name").alias("normalized_name"), F.col("master_sku").alias("normalized_code"), "category"))
    vendors = normalize.create_normalized(v("fx_vendors").select(
        F.col("name").alias("normalized_name"), F.col("nit").alias("normalized_nit")), ["normalized_name", "normalized_nit"])
    stores = normalize.create_normalized(v("fx_stores").select(
        F.col("name").alias("normalized_name"), F.col("code").alias("normalized_code"), "city"), ["normalized_name", "normalized_code"])
    row = lambda df, kind, c: df.where(F.length("id") == 64).select(
        F.lit(kind).alias("kind"), F.col("normalized_name").alias("name"), F.col(c).alias("category"))
    return row(products, "product", "category").unionByName(row(vendors, "vendor", "normalized_nit")).unionByName(
        row(stores, "store", "city"))


@query("mapping_review", f"""WITH {_MAPPINGS}
SELECT m.id, m.variant_name, coalesce(d.status, m.status) AS status, d.reviewed_by, d.reviewed_at
FROM mappings m LEFT JOIN (
  SELECT mapping_id, max_by(status, reviewed_at) AS status, max_by(reviewed_by, reviewed_at) AS reviewed_by, max(reviewed_at) AS reviewed_at
  FROM (SELECT concat('g-', vendor_product_name) AS mapping_id, CASE WHEN quantity > 25 THEN 'approved' ELSE 'rejected' END AS status,
          concat('user ', CAST(vendor_id AS STRING)) AS reviewed_by, concat(id, '/', CAST(line_number AS STRING)) AS reviewed_at FROM fx_items) x
  GROUP BY 1) d ON d.mapping_id = m.id""")
def mapping_review(spark, sf):
    """A decision per invoice item; the last one per mapping counts."""
    decisions = view(spark, sf, "fx_items").select(
        F.concat(F.lit("g-"), "vendor_product_name").alias("mapping_id"),
        F.when(F.col("quantity") > 25, "approved").otherwise("rejected").alias("status"),
        F.concat(F.lit("user "), "vendor_id").alias("reviewed_by"), F.concat_ws("/", "id", "line_number").alias("reviewed_at"))
    return normalize.review_mappings(_mappings(spark, sf), decisions).select("id", "variant_name", "status", "reviewed_by", "reviewed_at")


# ---- catalog ---------------------------------------------------------------


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return reports.with_manufacturer(view(spark, sf, "fx_items"))


# names of items without product, and the best master product of each name
_OPEN = f"""{MAKERS_SQL},
named AS (SELECT i.*, coalesce(nullif(m.product_name_clean, ''), i.vendor_product_name) AS item_name FROM fx_items i
  JOIN makers m ON m.vendor_product_name = i.vendor_product_name),
todo AS (SELECT DISTINCT item_name, {_norm('item_name')} AS a FROM named WHERE product_id IS NULL AND item_name NOT IN ('', 'NULL')),
master AS (SELECT min(id) AS product_id, {_norm('master_name')} AS b FROM fx_products GROUP BY 2),
pairs AS (SELECT x.a, y.b FROM (SELECT DISTINCT a FROM todo WHERE a <> '') x, (SELECT b FROM master WHERE b <> '') y),
{best_scores_sql(80, 1)},
best AS (SELECT a, max(score) AS score, arg_min(product_id, (-score, product_id)) AS found FROM scores JOIN master USING (b) GROUP BY a),
mapped AS (SELECT item_name, found, score FROM todo JOIN best USING (a))"""


@query("catalog_map", f"""WITH {_OPEN}
SELECT n.id, coalesce(n.product_id, found) AS product_id, score AS match_score, matched
FROM named n LEFT JOIN mapped m ON m.item_name = n.item_name AND n.product_id IS NULL""")
def catalog_map(spark, sf):
    """Every item without product, with the best master product of at least 80."""
    items = _items(spark, sf)
    return normalize.map_items_to_catalog(items, view(spark, sf, "fx_products")).select(
        "id", "product_id", "match_score", "matched")


# a score above zero is a shared character
@query("mapping_stats", f"""WITH {_OPEN},
touched AS (SELECT DISTINCT item_name FROM todo JOIN signed x ON x.n = a WHERE EXISTS (
  SELECT 1 FROM master JOIN signed y ON y.n = b WHERE bit_count(x.bits & y.bits) > 0))
SELECT count(*) FILTER (m.score IS NOT NULL) AS mapped, count(*) FILTER (m.score IS NULL) AS not_mapped,
  count(*) FILTER (m.score IS NULL AND t.item_name IS NOT NULL) AS low_score
FROM named n LEFT JOIN mapped m ON m.item_name = n.item_name LEFT JOIN touched t ON t.item_name = n.item_name WHERE n.product_id IS NULL""")
def mapping_stats(spark, sf):
    items = cut(_items(spark, sf).select("product_id", "product_name_clean", "vendor_product_name"))
    scores = normalize.catalog_scores(items, view(spark, sf, "fx_products"), keep_low=True)
    return normalize.mapping_stats(items, scores)


@query("sku_mapping", f"""WITH {_OPEN},
known AS (SELECT vendor_id, vendor_sku, CAST(min(vendor_sku) AS BIGINT) AS sku FROM fx_items WHERE quantity > 30 AND vendor_sku IS NOT NULL GROUP BY 1, 2)
SELECT n.id, coalesce(n.product_id, sku, found) AS product_id, CASE WHEN n.product_id IS NOT NULL THEN 'given' WHEN sku IS NOT NULL THEN 'sku'
  WHEN found IS NOT NULL THEN 'fuzzy' ELSE 'manual_review' END AS mapping_source
FROM named n LEFT JOIN known k ON k.vendor_id = n.vendor_id AND k.vendor_sku = n.vendor_sku
LEFT JOIN mapped m ON m.item_name = n.item_name AND n.product_id IS NULL""")
def sku_mapping(spark, sf):
    """Vendor codes of large deliveries are mapped; other items go by name."""
    items = _items(spark, sf)
    mappings = view(spark, sf, "fx_items").where((F.col("quantity") > 30) & F.col("vendor_sku").isNotNull()).groupBy(
        "vendor_id", "vendor_sku").agg(F.min("vendor_sku").cast("bigint").alias("product_id"))
    return normalize.map_by_sku(items, mappings, view(spark, sf, "fx_products")).select("id", "product_id", "mapping_source")


_SPLIT = f"""{CATALOG_SQL},
listed AS (SELECT trim(code) AS code, trim(item) AS name, {_norm('item')} AS a FROM (SELECT DISTINCT code, item FROM catalog) c WHERE item IS NOT NULL),
pairs AS (SELECT x.a, y.b FROM (SELECT DISTINCT a FROM listed WHERE a <> '') x,
  (SELECT DISTINCT {_norm('vendor_product_name')} AS b FROM fx_items) y WHERE b <> ''),
{best_scores_sql(90, 1)},
split AS (SELECT *, a NOT IN (SELECT a FROM scores) AS is_new FROM listed)"""


@query("catalog_new_products", f"""WITH {_SPLIT}
SELECT sha256(concat_ws(chr(1), name, coalesce(code, chr(0)), 'Unknown')) AS id, name AS normalized_name, code AS normalized_code, 'Unknown' AS category,
  'From Unknown catalog' AS description, 'approved' AS status, 100.0::DOUBLE AS similarity_score FROM split WHERE is_new""")
def catalog_new_products(spark, sf):
    """Catalog rows that no invoice item resembles, as normalized products with mappings."""
    listed = catalog_rows(spark, sf)
    split = normalize.split_catalog(listed, view(spark, sf, "fx_items"))
    products, mappings = normalize.catalog_entities(cut(split))
    return products.join(mappings.select(F.col("normalized_product_id").alias("id"), "status", "similarity_score"), "id")


def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    from cuadre.sources.catalog import distinct_products

    return distinct_products(read_catalogs(spark, sf))


@query("catalog_stats", f"""WITH {_SPLIT}
SELECT count(*) FILTER (is_new) AS created, CAST(0 AS BIGINT) AS mapped,
  count(*) FILTER (NOT is_new) + (SELECT count(*) FROM (SELECT DISTINCT code, item FROM catalog) c WHERE coalesce(trim(item), '') IN ('', 'nan')) AS skipped
FROM split""")
def catalog_stats(spark, sf):
    raw = read_catalogs(spark, sf).select("vendor", "code", F.col("item").alias("name")).distinct()
    split = normalize.split_catalog(catalog_rows(spark, sf), view(spark, sf, "fx_items"))
    return normalize.catalog_stats(split, raw)


# ---- clusters --------------------------------------------------------------


# sequential first fit: walk the vendors in order and keep the list of leaders
_CLUSTERS = f"""
pairs AS (SELECT DISTINCT {_norm('x.name')} AS a, {_norm('y.name')} AS b FROM fx_vendor_variants x, fx_vendor_variants y),
{SCORES_SQL},
nodes AS (SELECT *, row_number() OVER (ORDER BY name, id) AS n, {_norm('name')} AS norm FROM fx_vendor_variants),
near AS (SELECT x.n, coalesce(list(y.n) FILTER (score >= 85), []) AS earlier
  FROM nodes x LEFT JOIN nodes y ON y.n < x.n LEFT JOIN scores ON a = x.norm AND b = y.norm GROUP BY x.n),
walk(n, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT near.n, CASE WHEN list_has_any(earlier, leaders) THEN leaders ELSE list_append(leaders, near.n) END
  FROM walk JOIN near ON near.n = walk.n + 1),
done AS (SELECT max_by(leaders, n) AS leaders FROM walk),
clusters AS (SELECT x.id, x.name, x.nit, l.id AS leader_id, l.name AS group_name, count(*) OVER (PARTITION BY l.n) AS members
  FROM nodes x JOIN near ON near.n = x.n CROSS JOIN done
  JOIN nodes l ON l.n = coalesce(list_min(list_intersect(earlier, leaders)), x.n))"""


@query("vendor_clusters", f"WITH RECURSIVE {_CLUSTERS} SELECT id, name, nit, leader_id, group_name, members FROM clusters")
def vendor_clusters(spark, sf):
    return cluster.vendor_clusters(view(spark, sf, "fx_vendor_variants").select("id", "name", "nit"))


@query("vendor_mappings", f"""WITH RECURSIVE {_CLUSTERS},
known AS (SELECT DISTINCT name, sha256(name) AS id FROM fx_vendor_variants WHERE length(name) < 16)
SELECT variant_name, variant_nit, normalized_name, reused, similarity_score, status FROM (
  SELECT c.name AS variant_name, c.nit AS variant_nit, group_name AS normalized_name, k.id IS NOT NULL AS reused,
    100.0::DOUBLE AS similarity_score, 'pending' AS status
  FROM clusters c LEFT JOIN known k ON k.name = group_name WHERE members > 1 AND length(c.name) >= 16) m""")
def vendor_mappings(spark, sf):
    """Mappings for duplicate vendors; the shortest names are normalized and mapped already."""
    vendors = view(spark, sf, "fx_vendor_variants").select("id", "name", "nit")
    short = vendors.where(F.length("name") < 16)
    known = short.select(F.col("name").alias("normalized_name"), natural_id("name").alias("id")).distinct()
    mapped = short.select(F.col("name").alias("variant_name"), F.col("nit").alias("variant_nit"))
    created, mappings = cluster.vendor_mappings(cut(cluster.vendor_clusters(vendors)), known, mapped)
    names = known.withColumn("reused", F.lit(True)).unionByName(
        created.select("normalized_name", "id", F.lit(False).alias("reused"))).withColumnRenamed("id", "normalized_vendor_id")
    return mappings.join(names, "normalized_vendor_id").select(
        "variant_name", "variant_nit", "normalized_name", "reused", "similarity_score", "status")


@query("store_backfill")
def store_backfill(spark, sf):
    """Store of every invoice after the names of the files were matched or made into stores."""
    heads = view(spark, sf, "fx_heads").select(
        F.col("invoice_id").alias("id"),
        F.when(F.col("store_as") == "given", F.to_json(F.struct(F.struct(F.col("store_name").alias("name")).alias("store")))).alias("structured_data"))
    invoices = view(spark, sf, "fx_invoices").select("id", "store_id").join(heads, "id")
    created, filled = normalize.backfill_stores(invoices, view(spark, sf, "fx_stores"))
    names = created.select(F.col("id").alias("store_id"), "code")
    return filled.join(names, "store_id", "left").select("id", "store_id", "code")
