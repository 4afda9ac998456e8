"""Queries for reports, lists, figures and scalar functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuadre.functions import text
from cuadre.operators import audits, reports
from cuadre.plans.fixtures import table, view
from cuadre.plans.registry import query
from cuadre.session import scratch_path
from cuadre.sources.sinks import write_report

# ---- the manufacturer rules in SQL, for checks -----------------------------

_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
MAKERS_SQL = rf"""
makers AS (
  SELECT vendor_product_name,
    CASE WHEN hit IS NOT NULL THEN regexp_extract(trim(parts[hit]), '^({_NAME})', 1)
         WHEN paren <> '' THEN paren WHEN dash_ok THEN dash END AS manufacturer_name,
    CASE WHEN hit IS NOT NULL THEN trim(array_to_string(parts[1:hit - 1], '|'))
         WHEN paren <> '' THEN trim(regexp_replace(vendor_product_name, '\s*\([^)]+\)\s*$', ''))
         WHEN dash_ok THEN trim(regexp_replace(vendor_product_name, '\s+-\s+({_NAME})\s*$', ''))
         ELSE trim(vendor_product_name) END AS product_name_clean,
    CASE WHEN hit IS NOT NULL THEN trim(parts[hit]) WHEN paren <> '' THEN paren WHEN dash_ok THEN dash END
      AS manufacturer_prefix
  FROM (SELECT *, dash <> '' AND lower(dash) NOT IN ('frozen','fresh','organic','whole','sliced','usa','italy') AS dash_ok
        FROM (SELECT vendor_product_name, parts,
                list_max(list_filter(range(1, len(parts) + 1),
                  lambda i: len(parts) > 1 AND regexp_matches(trim(parts[i]), '^{_NAME}'))) AS hit,
                regexp_extract(vendor_product_name, '\(({_NAME})\)\s*$', 1) AS paren,
                regexp_extract(vendor_product_name, '\s+-\s+({_NAME})\s*$', 1) AS dash
              FROM (SELECT DISTINCT vendor_product_name, string_split(vendor_product_name, '|') AS parts
                    FROM fx_items) a) b) c)"""

FACT_SQL = rf"""
{MAKERS_SQL},
fact AS (
  SELECT inv.processing_status AS status, coalesce(s.name, 'N/A') AS store, coalesce(s.code, 'N/A') AS store_code,
    strftime(invoice_date, '%Y-%m-%d') AS date, CAST(week(invoice_date) AS INT) AS week,
    monthname(invoice_date) AS month_name, CAST(month(invoice_date) AS INT) AS month,
    concat('Q', CAST(quarter(invoice_date) AS STRING)) AS quarter, CAST(year(invoice_date) AS INT) AS year,
    CAST(isoyear(invoice_date) AS INT) AS iso_year, v.name AS distributor,
    coalesce(m.manufacturer_name, '') AS manufacturer, invoice_number,
    concat(CAST(CAST(round_even(confidence_score * 100, 0) AS INT) AS STRING), '%') AS confidence,
    coalesce(p.master_sku, '') AS master_sku, i.vendor_sku AS item_code,
    coalesce(nullif(m.product_name_clean, ''), i.vendor_product_name) AS item_name,
    i.quantity AS cases_ordered, 1 AS units_per_case, i.quantity * 1 AS total_units, i.unit_price AS price_per_case,
    i.unit_price / 1 AS price_per_unit, i.line_total AS total_price, i.invoice_id, i.id AS item_id
  FROM fx_items i JOIN fx_invoices inv ON i.invoice_id = inv.id JOIN fx_vendors v ON inv.vendor_id = v.id
  JOIN makers m ON m.vendor_product_name = i.vendor_product_name
  LEFT JOIN fx_stores s ON inv.store_id = s.id LEFT JOIN fx_products p ON i.product_id = p.id),
alerts AS (
  SELECT fact.*, agreed_price, CASE WHEN price_per_case > agreed_price THEN '🔴 PRECIO ALTO' ELSE '' END AS alert
  FROM fact LEFT JOIN fx_agreed_prices a ON fact.distributor = a.distributor AND fact.item_code = a.item_code)"""

_FACT_COLUMNS = (
    "status, store, store_code, date, week, month_name, month, quarter, year, iso_year, distributor, manufacturer, "
    "invoice_number, confidence, master_sku, item_code, item_name, cases_ordered, units_per_case, total_units, "
    "price_per_case, price_per_unit, total_price, invoice_id, item_id")


def _fact_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [view(spark, sf, n) for n in ("fx_items", "fx_invoices", "fx_vendors", "fx_stores", "fx_products")]


def fact(spark: SparkSession, sf: str, to_filter: bool = False) -> DataFrame:
    return reports.invoice_fact(*_fact_tables(spark, sf), to_filter)


def alerted(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.fact_rows(*_fact_tables(spark, sf))
    return reports.fact_columns(reports.price_alerts(rows, view(spark, sf, "fx_agreed_prices")))


# ---- views -----------------------------------------------------------------


@query("invoices_detailed", """
SELECT i.id, i.invoice_number, i.invoice_date, i.total, i.processing_status, i.confidence_score, v.name AS vendor_name,
       v.nit AS vendor_nit, s.name AS store_name, s.code AS store_code, count(DISTINCT ii.id) AS items_count, i.created_at
FROM fx_invoices i LEFT JOIN fx_vendors v ON i.vendor_id = v.id LEFT JOIN fx_stores s ON i.store_id = s.id
LEFT JOIN fx_items ii ON i.id = ii.invoice_id
GROUP BY ALL""")
def invoices_detailed(spark, sf):
    v = lambda n: view(spark, sf, n)
    return reports.invoices_detailed(v("fx_invoices"), v("fx_vendors"), v("fx_stores"), v("fx_items"))


@query("items_detailed", """
SELECT ii.id, ii.invoice_id, i.invoice_number, ii.vendor_product_name, ii.vendor_sku, p.master_name AS product_name,
       p.master_sku AS product_sku, ii.quantity, ii.unit_price, ii.line_total, ii.matched, ii.line_number, i.invoice_date
FROM fx_items ii JOIN fx_invoices i ON ii.invoice_id = i.id LEFT JOIN fx_products p ON ii.product_id = p.id""")
def items_detailed(spark, sf):
    v = lambda n: view(spark, sf, n)
    return reports.items_detailed(v("fx_items"), v("fx_invoices"), v("fx_products"))


@query("processing_summary", """
SELECT CAST(created_at AS DATE) AS date, processing_status, count(*) AS count,
       round(avg(confidence_score), 8) AS avg_confidence, round(sum(total), 4) AS total_amount
FROM fx_invoices GROUP BY 1, 2""")
def processing_summary(spark, sf):
    return reports.processing_summary(view(spark, sf, "fx_invoices")).select(
        "date", "processing_status", "count", F.round("avg_confidence", 8).alias("avg_confidence"),
        F.round("total_amount", 4).alias("total_amount"))


# ---- the report ------------------------------------------------------------


@query("invoice_fact", f"WITH {FACT_SQL} SELECT {_FACT_COLUMNS} FROM fact")
def invoice_fact(spark, sf):
    return fact(spark, sf)


@query("price_join", f"""WITH {FACT_SQL}
SELECT item_id, distributor, item_code, price_per_case, agreed_price FROM alerts""")
def price_join(spark, sf):
    return reports.price_join(fact(spark, sf), view(spark, sf, "fx_agreed_prices")).select(
        "item_id", "distributor", "item_code", "price_per_case", "agreed_price")


@query("price_alerts", f"WITH {FACT_SQL} SELECT {_FACT_COLUMNS}, agreed_price, alert FROM alerts")
def price_alerts(spark, sf):
    return alerted(spark, sf)


@query("alert_count", f"""WITH {FACT_SQL}
SELECT count(*) FILTER (alert <> '') AS alerts, count(*) AS rows FROM alerts
WHERE regexp_matches(concat_ws('|', item_name, distributor, invoice_number), '(?i)ring.*supplier#0+1')""")
def alert_count(spark, sf):
    hay = alerted(spark, sf).withColumn("hay", F.concat_ws("|", "item_name", "distributor", "invoice_number"))
    return reports.alert_count(reports.row_search(hay, "ring.*supplier#0+1", ["hay"]))


@query("report_filter", f"""WITH {FACT_SQL}
SELECT * FROM fact WHERE status = 'processed' AND CAST(date AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def report_filter(spark, sf):
    return reports.report_filter(fact(spark, sf), reports.ALL, None, "processed", date(1996, 1, 1), date(1998, 12, 31))


@query("filter_options", f"""WITH {FACT_SQL}
SELECT DISTINCT 'distributor' AS filter, distributor AS option FROM fact
UNION ALL SELECT DISTINCT 'store', store FROM fact UNION ALL SELECT DISTINCT 'status', status FROM fact
UNION ALL SELECT 'distributor', 'Todos' UNION ALL SELECT 'store', 'Todos' UNION ALL SELECT 'status', 'Todos'
UNION ALL SELECT 'date_from', min(date) FROM fact UNION ALL SELECT 'date_to', max(date) FROM fact""")
def filter_options(spark, sf):
    return reports.filter_options(fact(spark, sf))


@query("report_metrics", f"""WITH {FACT_SQL}
SELECT count(*) AS total_items, round(sum(total_price), 2) AS total_amount, round(avg(price_per_case), 6) AS avg_case_price,
       count(DISTINCT invoice_number) AS unique_invoices, count(DISTINCT invoice_id) AS unique_invoice_ids FROM fact""")
def report_metrics(spark, sf):
    return reports.report_metrics(fact(spark, sf)).withColumns({
        "total_amount": F.round("total_amount", 2), "avg_case_price": F.round("avg_case_price", 6)})


@query("row_search", f"""WITH {FACT_SQL}
SELECT * FROM fact
WHERE {' OR '.join(f"coalesce(regexp_matches(CAST({c} AS STRING), '(?i)(bindi|tienda|q4).*'), false)"
                   for c in _FACT_COLUMNS.split(', '))}""")
def row_search(spark, sf):
    return reports.row_search(fact(spark, sf, to_filter=True), "(bindi|tienda|q4).*")


@query("report_export", f"""WITH {FACT_SQL}
SELECT year AS "Año", alert AS "Alerta", count(*) AS rows, count(agreed_price) AS priced FROM alerts GROUP BY ALL""")
def report_export(spark, sf):
    path = scratch_path(spark, "report")
    write_report(reports.report_sheet(alerted(spark, sf)), path, "parquet")
    back = spark.read.parquet(path)
    return back.groupBy("Año", F.col("`⚠️ Alerta`").alias("Alerta")).agg(
        F.count("*").alias("rows"), F.count("Precio Acordado").alias("priced"))


# ---- scalar functions ------------------------------------------------------


@query("name_normalize", r"""
SELECT DISTINCT vendor_product_name,
  trim(regexp_replace(regexp_replace(lower(vendor_product_name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS norm
FROM fx_items
UNION ALL SELECT DISTINCT text,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) FROM documents""")
def name_normalize(spark, sf):
    names = view(spark, sf, "fx_items").select("vendor_product_name").distinct()
    texts = table(spark, sf, "documents").select(F.col("text").alias("vendor_product_name")).distinct()
    return names.unionByName(texts).withColumn("norm", text.normalize_name(F.col("vendor_product_name")))


@query("manufacturer_extract", f"""WITH {MAKERS_SQL}
SELECT i.id, i.vendor_product_name, manufacturer_name, product_name_clean, manufacturer_prefix
FROM fx_items i JOIN makers m ON i.vendor_product_name = m.vendor_product_name""")
def manufacturer_extract(spark, sf):
    return reports.with_manufacturer(view(spark, sf, "fx_items")).select(
        "id", "vendor_product_name", "manufacturer_name", "product_name_clean", "manufacturer_prefix")


@query("effective_name", f"""WITH {MAKERS_SQL}
SELECT i.id, coalesce(nullif(product_name_clean, ''), i.vendor_product_name) AS item_name
FROM fx_items i JOIN makers m ON i.vendor_product_name = m.vendor_product_name""")
def effective_name(spark, sf):
    items = reports.with_manufacturer(view(spark, sf, "fx_items"))
    return items.select("id", text.effective_name(F.col("product_name_clean"), F.col("vendor_product_name")).alias("item_name"))


@query("date_parts", """
SELECT id, strftime(invoice_date, '%Y-%m-%d') AS date, CAST(week(invoice_date) AS INT) AS week,
  monthname(invoice_date) AS month_name, CAST(month(invoice_date) AS INT) AS month,
  concat('Q', CAST(quarter(invoice_date) AS STRING)) AS quarter, CAST(year(invoice_date) AS INT) AS year,
  CAST(isoyear(invoice_date) AS INT) AS iso_year FROM fx_invoices""")
def date_parts(spark, sf):
    parts = text.date_parts(F.col("invoice_date"))
    return view(spark, sf, "fx_invoices").select("id", *[c.alias(n) for n, c in parts.items()])


@query("unit_conversion", """
SELECT l_orderkey, l_partkey, p_size AS units_per_case, l_quantity * p_size AS total_units,
       l_extendedprice AS price_per_case, l_extendedprice / p_size AS price_per_unit
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def unit_conversion(spark, sf):
    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    units = reports.unit_columns(F.col("l_quantity"), F.col("l_extendedprice"), F.col("p_size"))
    return joined.select("l_orderkey", "l_partkey", *[c.alias(n) for n, c in units.items()])


@query("confidence_pct", """
SELECT id, concat(CAST(CAST(round_even(confidence_score * 100, 0) AS INT) AS STRING), '%') AS confidence FROM fx_invoices""")
def confidence_pct(spark, sf):
    return view(spark, sf, "fx_invoices").select("id", text.confidence_pct(F.col("confidence_score")).alias("confidence"))


_RESPONSES = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'max_tokens' WHEN 'view' THEN 'tool_use' ELSE 'end_turn' END AS stop_reason,
       CAST(floor(value * 40) AS INT) AS output_tokens FROM {events}"""


@query("ocr_confidence", f"""
SELECT event_id, round(greatest(0.0, least(1.0, 0.9
  + CASE stop_reason WHEN 'end_turn' THEN 0.05 WHEN 'max_tokens' THEN -0.1 ELSE 0.0 END
  + CASE WHEN output_tokens < 50 THEN -0.15 WHEN output_tokens > 3686.4 THEN -0.05 ELSE 0.0 END))::DOUBLE, 6) AS confidence
FROM ({_RESPONSES.format(events='events')}) r""")
def ocr_confidence(spark, sf):
    rows = spark.sql(_RESPONSES, events=table(spark, sf, "events"))
    return rows.select("event_id", F.round(text.ocr_confidence(F.col("stop_reason"), F.col("output_tokens")), 6).alias("confidence"))


@query("confidence_route", """
SELECT id, CASE WHEN confidence_score >= 0.95 THEN 'auto_approve' WHEN confidence_score < 0.75 THEN 'manual_review'
  ELSE 'standard' END AS route FROM fx_invoices""")
def confidence_route(spark, sf):
    return view(spark, sf, "fx_invoices").select("id", text.confidence_route(F.col("confidence_score")).alias("route"))


@query("text_guard", r"""
SELECT doc_id, length(regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) >= 10 AS usable FROM documents""")
def text_guard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.text_guard(F.col("text")).alias("usable"))


_NITS = """
SELECT c_custkey, CASE c_custkey % 5
  WHEN 0 THEN concat(CAST(900000000 + c_custkey AS STRING), '-', CAST(c_custkey % 10 AS STRING))
  WHEN 1 THEN CAST(900000000 + c_custkey AS STRING)
  WHEN 2 THEN concat(CAST(c_custkey AS STRING), '-1')
  WHEN 3 THEN concat('9', CAST(900000000 + c_custkey AS STRING), '-7') END AS nit FROM {customer}"""


@query("nit_valid", rf"""
SELECT c_custkey, nit, coalesce(regexp_matches(nit, '^\d{{9,10}}-\d$'), false) AS valid
FROM ({_NITS.format(customer='customer')}) n""")
def nit_valid(spark, sf):
    return spark.sql(_NITS, customer=table(spark, sf, "customer")).withColumn("valid", text.nit_valid(F.col("nit")))


# ---- lists -----------------------------------------------------------------


@query("invoice_list", """
SELECT p.*, v.name AS vendor_name, v.nit AS vendor_nit
FROM (SELECT * FROM fx_invoices WHERE processing_status = 'processed' AND invoice_date >= DATE '1996-01-01'
      AND invoice_date <= DATE '1999-12-31' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20) p
LEFT JOIN fx_vendors v ON p.vendor_id = v.id""")
def invoice_list(spark, sf):
    rows = reports.invoice_filter(view(spark, sf, "fx_invoices"), status="processed", date_from=date(1996, 1, 1),
                                  date_to=date(1999, 12, 31))
    return reports.invoice_page(rows, view(spark, sf, "fx_vendors"), page=2, page_size=20)


@query("invoice_list_deep", """
SELECT p.*, v.name AS vendor_name, v.nit AS vendor_nit
FROM (SELECT * FROM fx_invoices ORDER BY created_at, id LIMIT 5 OFFSET 4995) p LEFT JOIN fx_vendors v ON p.vendor_id = v.id""")
def invoice_list_deep(spark, sf):
    """Page 1,000 of all invoices, the oldest first."""
    return reports.invoice_page(view(spark, sf, "fx_invoices"), view(spark, sf, "fx_vendors"), page=1000, page_size=5, sort_order="asc")


@query("invoice_page_info", """
SELECT count(*) AS total, 2 AS page, 20 AS page_size, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
FROM fx_invoices WHERE processing_status = 'processed'""")
def invoice_page_info(spark, sf):
    rows = reports.invoice_filter(view(spark, sf, "fx_invoices"), status="processed")
    return reports.page_info(rows, page=2, page_size=20)


@query("invoice_search", """
SELECT i.* FROM fx_invoices i LEFT JOIN fx_vendors v ON i.vendor_id = v.id
WHERE store_id IS NOT NULL AND confidence_score >= 0.8
  AND (contains(lower(invoice_number), '77') OR coalesce(contains(lower(v.name), '77'), false))""")
def invoice_search(spark, sf):
    rows = view(spark, sf, "fx_invoices").where(F.col("store_id").isNotNull())
    return reports.invoice_filter(rows, view(spark, sf, "fx_vendors"), min_confidence=0.8, search="77")


@query("invoice_nested", """
SELECT i.id, v.name AS vendor_name, v.nit AS vendor_nit, s.name AS store_name, n.lines, n.names
FROM fx_invoices i LEFT JOIN fx_vendors v ON i.vendor_id = v.id LEFT JOIN fx_stores s ON i.store_id = s.id
LEFT JOIN (SELECT invoice_id, CAST(count(*) AS INT) AS lines,
             string_agg(concat(CAST(line_number AS STRING), ':', vendor_product_name), ';' ORDER BY line_number) AS names
           FROM fx_items GROUP BY 1) n ON n.invoice_id = i.id""")
def invoice_nested(spark, sf):
    v = lambda n: view(spark, sf, n)
    nested = reports.invoice_nested(v("fx_invoices"), v("fx_items"), v("fx_vendors"), v("fx_stores"))
    line = lambda x: F.concat(x["line_number"].cast("string"), F.lit(":"), x["vendor_product_name"])
    return nested.select(
        "id", F.col("vendor.name").alias("vendor_name"), F.col("vendor.nit").alias("vendor_nit"),
        F.col("store.name").alias("store_name"), F.size("items").alias("lines"),
        F.array_join(F.transform("items", line), ";").alias("names"))


# ---- figures ---------------------------------------------------------------


@query("product_frequency", """
SELECT vendor_product_name, vendor_id, count(*) AS item_count FROM fx_items GROUP BY 1, 2""")
def product_frequency(spark, sf):
    return reports.product_frequency(view(spark, sf, "fx_items"))


@query("processing_stats", """
SELECT count(*) AS total_invoices, count(*) FILTER (processing_status = 'processed') AS processed,
  count(*) FILTER (processing_status = 'pending') AS pending, count(*) FILTER (processing_status = 'error') AS errors,
  count(*) FILTER (processing_status = 'manual_review') AS manual_review, round(avg(confidence_score), 8) AS avg_confidence,
  round(count(*) FILTER (processing_status = 'processed') / (date_diff('second', min(created_at), max(created_at)) / 3600.0), 8)
    AS processing_rate_per_hour FROM fx_invoices""")
def processing_stats(spark, sf):
    return reports.processing_stats(view(spark, sf, "fx_invoices")).withColumns({
        "avg_confidence": F.round("avg_confidence", 8), "processing_rate_per_hour": F.round("processing_rate_per_hour", 8)})


@query("dashboard_metrics", """
SELECT count(*) FILTER (d = DATE '1998-06-17') AS today_processed,
  round(coalesce(sum(total) FILTER (d = DATE '1998-06-17'), 0), 4) AS today_total_amount,
  count(*) FILTER (d >= DATE '1998-06-15') AS week_processed,
  round(coalesce(sum(total) FILTER (d >= DATE '1998-06-15'), 0), 4) AS week_total_amount,
  count(*) FILTER (d >= DATE '1998-06-01') AS month_processed,
  round(coalesce(sum(total) FILTER (d >= DATE '1998-06-01'), 0), 4) AS month_total_amount
FROM (SELECT *, CAST(created_at AS DATE) AS d FROM fx_invoices) i
WHERE processing_status = 'processed' AND d <= DATE '1998-06-17'""")
def dashboard_metrics(spark, sf):
    out = reports.dashboard_metrics(view(spark, sf, "fx_invoices"), date(1998, 6, 17))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("amount")})


@query("top_vendors", """
SELECT t.vendor_id, t.invoices, t.amount, v.name AS vendor_name
FROM (SELECT vendor_id, count(*) AS invoices, round(sum(total), 4) AS amount FROM fx_invoices GROUP BY 1
      ORDER BY 3 DESC, 1 LIMIT 10) t LEFT JOIN fx_vendors v ON t.vendor_id = v.id""")
def top_vendors(spark, sf):
    return reports.top_vendors(view(spark, sf, "fx_invoices"), view(spark, sf, "fx_vendors")).withColumn(
        "amount", F.round("amount", 4))


@query("recent_errors", """
SELECT * FROM fx_log WHERE status = 'error' ORDER BY created_at DESC, id LIMIT 10""")
def recent_errors(spark, sf):
    return reports.recent_errors(view(spark, sf, "fx_log"))


@query("manufacturer_stats", f"""WITH {MAKERS_SQL}
SELECT count(*) AS processed, count(manufacturer_name) AS with_manufacturer,
  count(*) - count(manufacturer_name) AS without_manufacturer,
  count(*) FILTER (i.vendor_product_name IS NULL) AS errors
FROM fx_items i LEFT JOIN makers m ON i.vendor_product_name = m.vendor_product_name""")
def manufacturer_stats(spark, sf):
    return reports.manufacturer_stats(reports.with_manufacturer(view(spark, sf, "fx_items"), to_filter=True))


@query("manufacturer_list", f"""WITH {MAKERS_SQL}
SELECT manufacturer_name, count(*) AS items FROM fx_items i JOIN makers m ON i.vendor_product_name = m.vendor_product_name
WHERE manufacturer_name IS NOT NULL GROUP BY 1""")
def manufacturer_list(spark, sf):
    return reports.manufacturer_list(reports.with_manufacturer(view(spark, sf, "fx_items"), to_filter=True))


# ---- audits ----------------------------------------------------------------

_BILLED = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity,
       l_extendedprice * (1 - l_discount) / l_quantity AS unit_price, l_extendedprice AS line_total FROM {lineitem}"""


@query("line_total_check", f"""
SELECT *, NOT (abs(line_total - quantity * unit_price) > quantity * unit_price * 0.01::DOUBLE) AS line_total_ok
FROM ({_BILLED.format(lineitem='lineitem')}) b""")
def line_total_check(spark, sf):
    return audits.line_total_check(spark.sql(_BILLED, lineitem=table(spark, sf, "lineitem")))


_DUE = """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS invoice_date, CAST(l_shipdate AS DATE) AS due_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""


@query("due_date_check", f"""
SELECT *, coalesce(due_date >= invoice_date, true) AS due_date_ok
FROM ({_DUE.format(lineitem='lineitem', orders='orders')}) d""")
def due_date_check(spark, sf):
    return audits.due_date_check(spark.sql(_DUE, lineitem=table(spark, sf, "lineitem"), orders=table(spark, sf, "orders")))


_AMOUNTS = """
SELECT c_custkey, c_acctbal AS subtotal, c_acctbal - 3000 AS tax, c_acctbal - 1000 AS total,
       c_acctbal / 9000 AS confidence_score FROM {customer}"""


@query("range_checks", f"""
SELECT c_custkey, concat_ws(',', CASE WHEN NOT subtotal >= 0 THEN 'subtotal' END, CASE WHEN NOT tax >= 0 THEN 'tax' END,
  CASE WHEN NOT total > 0 THEN 'total' END,
  CASE WHEN NOT confidence_score BETWEEN 0 AND 1 THEN 'confidence_score' END) AS range_errors
FROM ({_AMOUNTS.format(customer='customer')}) a""")
def range_checks(spark, sf):
    rows = audits.invoice_range_checks(spark.sql(_AMOUNTS, customer=table(spark, sf, "customer")))
    return rows.select("c_custkey", F.array_join("range_errors", ",").alias("range_errors"))


@query("enum_checks", """
SELECT id, concat_ws(',', CASE WHEN event_type NOT IN ('uploaded','ocr_started','ocr_completed','ner_started',
  'ner_completed','normalized','validated','error') THEN 'event_type' END,
  CASE WHEN status NOT IN ('success','error','warning','info') THEN 'status' END) AS enum_errors FROM fx_log""")
def enum_checks(spark, sf):
    from cuadre.schemas import EVENT_TYPES, LOG_STATUSES

    rows = audits.enum_checks(view(spark, sf, "fx_log"), {"event_type": EVENT_TYPES, "status": LOG_STATUSES})
    return rows.select("id", F.array_join("enum_errors", ",").alias("enum_errors"))


@query("length_checks", f"""
SELECT c_custkey, concat_ws(',', CASE WHEN NOT coalesce(length(nit) BETWEEN 9 AND 20, false) THEN 'nit' END,
  CASE WHEN NOT coalesce(length(name) BETWEEN 1 AND 255, false) THEN 'name' END) AS length_errors
FROM (SELECT n.*, c_name AS name FROM ({_NITS.format(customer='customer')}) n JOIN customer USING (c_custkey)) x
UNION ALL
SELECT doc_id, concat_ws(',', CASE WHEN NOT coalesce(length(source) BETWEEN 9 AND 20, false) THEN 'nit' END,
  CASE WHEN NOT coalesce(length(text) BETWEEN 1 AND 255, false) THEN 'name' END) FROM documents""")
def length_checks(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    rows = spark.sql(_NITS, customer=table(spark, sf, "customer")).join(names, "c_custkey")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("c_custkey"), F.col("source").alias("nit"), F.col("text").alias("name"))
    limits = {"nit": audits.LENGTHS["nit"], "name": audits.LENGTHS["name"]}
    checked = audits.length_checks(rows.unionByName(docs), limits)
    return checked.select("c_custkey", F.array_join("length_errors", ",").alias("length_errors"))


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return audits.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphan_items", """
SELECT id, invoice_id FROM fx_items WHERE invoice_id NOT IN
  (SELECT id FROM fx_invoices WHERE processing_status <> 'pending')""")
def orphan_items(spark, sf):
    kept = view(spark, sf, "fx_invoices").where(F.col("processing_status") != "pending")
    return audits.orphans(view(spark, sf, "fx_items"), kept, "invoice_id").select("id", "invoice_id")


@query("cascade_delete", """
SELECT id, invoice_id FROM fx_items WHERE invoice_id NOT IN
  (SELECT id FROM fx_invoices WHERE processing_status = 'manual_review')""")
def cascade_delete(spark, sf):
    removed = view(spark, sf, "fx_invoices").where(F.col("processing_status") == "manual_review")
    return audits.cascade_delete(view(spark, sf, "fx_items"), removed, "invoice_id").select("id", "invoice_id")
