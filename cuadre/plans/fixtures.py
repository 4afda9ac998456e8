"""The driver's star-schema tables, reshaped as invoice tables.

The statements run on Spark and on the checking engine, so a query and its check
start from the same rows. Only the sums of the invoices are written out for Spark
(:func:`invoice_sums`), to say how they are distributed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

VIEWS: dict[str, str] = {
    "fx_vendors": """
SELECT s_suppkey AS id, s_name AS name,
       concat(CAST(900000000 + s_suppkey AS STRING), '-', CAST(s_suppkey % 10 AS STRING)) AS nit
FROM supplier""",
    "fx_stores": """
SELECT c_custkey AS id, c_name AS name, concat('C', CAST(c_custkey AS STRING)) AS code, n_name AS city
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fx_products": """
SELECT p_partkey AS id, concat('SKU-', CAST(p_partkey AS STRING)) AS master_sku,
       concat(p_name, ' ', p_brand, ' ', p_type) AS master_name, p_type AS category, 'case' AS unit
FROM part""",
    "fx_items": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(line_number AS STRING)) AS id,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS invoice_id,
       l_orderkey, l_suppkey AS vendor_id,
       CASE WHEN l_orderkey % 3 = 0 THEN l_partkey END AS product_id,
       CASE l_linenumber % 4
         WHEN 0 THEN concat(p_name, ' ', p_brand, ' ', p_type)
         WHEN 1 THEN concat(upper(p_name), ' ', p_brand, ' | Bindi Foods 500')
         WHEN 2 THEN concat(p_name, '  ', p_type, ' (Bridor)')
         ELSE concat(replace(p_name, 'e', ''), '/', p_brand, ' - Lavazza') END AS vendor_product_name,
       CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey AS STRING) END AS vendor_sku,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total,
       line_number, l_orderkey % 3 = 0 AS matched
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey
        ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax,
                 l_returnflag, l_linestatus) AS INT) AS line_number
      FROM lineitem) x
JOIN part ON l_partkey = p_partkey""",
    "fx_invoices": """
SELECT i.invoice_id AS id, concat('FAC-', CAST(o_orderkey AS STRING)) AS invoice_number, i.vendor_id,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS store_id,
       CAST(o_orderdate AS DATE) AS invoice_date,
       CAST(i.items_cents * CASE WHEN o_orderkey % 11 = 0 THEN 105 ELSE 100 END AS DOUBLE) / 10000 AS total,
       CAST(70 + o_orderkey % 30 AS DOUBLE) / 100 AS confidence_score,
       CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'pending' ELSE 'manual_review' END
         AS processing_status,
       CASE WHEN o_orderkey % 5 <> 0 THEN concat('file-', i.invoice_id) END AS source_file_id,
       o_orderdate AS created_at
FROM (SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS invoice_id,
             l_orderkey, l_suppkey AS vendor_id,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS items_cents
      FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY l_orderkey, l_suppkey) i
JOIN orders ON i.l_orderkey = o_orderkey""",
    "fx_agreed_prices": """
SELECT DISTINCT s_name AS distributor, CAST(l_partkey AS STRING) AS item_code, p_retailprice * 2 AS agreed_price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
WHERE p_partkey % 2 = 0 AND l_partkey % 10 <> 0""",
    "fx_log": """
SELECT event_id AS id, event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
       props AS details, ts AS created_at
FROM events""",
    "fx_vendor_variants": """
SELECT s_suppkey AS id, s_name AS raw_name,
       concat(CAST(900000000 + s_suppkey AS STRING), '-', CAST(s_suppkey % 10 AS STRING)) AS nit,
       CASE s_suppkey % 3
         WHEN 0 THEN concat(reverse(CAST(s_suppkey * 7919 AS STRING)), ' Foods SAS')
         WHEN 1 THEN concat(reverse(CAST((s_suppkey - 1) * 7919 AS STRING)), ' FOODS S.A.S')
         ELSE concat('Distribuidora ', substr(concat(CAST(900000000 + s_suppkey AS STRING), '-',
                     CAST(s_suppkey % 10 AS STRING)), 6, 4), ' Ltda') END AS name
FROM supplier""",
    "fx_lines": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS invoice_id, l_orderkey,
       l_suppkey AS vendor_id, line_number, p_name AS product_name,
       CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey AS STRING) END AS sku,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total,
       CASE l_orderkey % 13 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' WHEN 2 THEN 'word' WHEN 3 THEN 'quoted'
         ELSE 'number' END AS quantity_as
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey
        ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax,
                 l_returnflag, l_linestatus) AS INT) AS line_number
      FROM lineitem) x
JOIN part ON l_partkey = p_partkey""",
    "fx_heads": """
SELECT i.invoice_id, o_orderkey, i.vendor_id,
       CASE o_orderkey % 17 WHEN 3 THEN '' ELSE s_name END AS vendor_name,
       concat(CAST(900000000 + s_suppkey AS STRING), '-', CAST(s_suppkey % 10 AS STRING)) AS nit,
       CASE o_orderkey % 19 WHEN 4 THEN 'null' WHEN 5 THEN 'missing' ELSE 'given' END AS store_as,
       CASE o_orderkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) WHEN 2 THEN substr(c_name, 10)
         ELSE concat('Tienda ', n_name) END AS store_name,
       concat('FAC-', CAST(o_orderkey AS STRING)) AS invoice_number,
       CASE o_orderkey % 23 WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END
         AS invoice_date,
       CASE o_orderkey % 29 WHEN 0 THEN 0.0 ELSE CAST(i.items_cents AS DOUBLE) / 100 END AS subtotal,
       CASE o_orderkey % 31 WHEN 1 THEN 0.0
         ELSE CAST(i.items_cents * CASE WHEN o_orderkey % 11 = 0 THEN 105 ELSE 100 END AS DOUBLE) / 10000 END AS total,
       CASE o_orderkey % 37 WHEN 1 THEN NULL ELSE CAST(70 + o_orderkey % 30 AS DOUBLE) / 100 END AS confidence,
       o_orderstatus = 'O' AS sent_twice
FROM (SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS invoice_id,
             l_orderkey, l_suppkey AS vendor_id,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS items_cents
      FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY l_orderkey, l_suppkey) i
JOIN orders ON i.l_orderkey = o_orderkey
JOIN supplier ON i.vendor_id = s_suppkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey""",
    "fx_files": """
SELECT o_orderkey, concat('file-', CAST(o_orderkey AS STRING)) AS id,
       concat('scan ', CAST(o_orderkey AS STRING), '.', CASE o_orderkey % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'JPG'
         WHEN 2 THEN 'jpeg' WHEN 3 THEN 'png' WHEN 4 THEN 'webp' WHEN 5 THEN 'gif' ELSE 'docx' END) AS name,
       CAST(round(o_totalprice * 50) AS BIGINT) AS size, o_orderdate AS modified_at,
       concat('folder-', o_orderpriority) AS folder_id
FROM orders""",
}

# the sums that fx_invoices and fx_heads begin with, as they stand there
_SUMS = """(SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS invoice_id,
             l_orderkey, l_suppkey AS vendor_id,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS items_cents
      FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY l_orderkey, l_suppkey) i"""

_BASE = ["nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoice_sums(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The rows of ``_SUMS``. Lines are distributed by order alone, which serves the sums and the join with the orders after them."""
    lines = lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("bigint")
    return (
        lines.select("l_orderkey", "l_suppkey", "l_extendedprice").repartition("l_orderkey")
        .groupBy("l_orderkey", "l_suppkey").agg(cents.alias("items_cents"))
        .select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("invoice_id"),
                "l_orderkey", F.col("l_suppkey").alias("vendor_id"), "items_cents")
    )


def lines_by_order(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The rows of ``fx_lines``. Lines meet the parts first and are then distributed by order alone, which serves their
    numbering, what is grouped by invoice, and a join with the orders.

    All lines are numbered, also those without a part, which no row comes of; names of a part are gathered before, so that
    none is numbered twice.
    """
    order = re.search(r"ORDER BY (l_linenumber.*?)\) AS INT\)", VIEWS["fx_lines"], re.DOTALL)[1]
    names = part.groupBy("p_partkey").agg(F.collect_list(F.struct("p_name")).alias("names"))
    placed = lineitem.join(names, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey").repartition("l_orderkey")
    x = placed.selectExpr("*", f"CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {order}) AS INT) AS line_number")
    chosen = VIEWS["fx_lines"].split("\nFROM ")[0]
    return lineitem.sparkSession.sql(f"{chosen} FROM {{rows}}", rows=x.select("*", F.inline("names")).drop("names"))


def heads_with_lines(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """``fx_heads`` with the column ``lines`` of ``lines`` (l_orderkey, vendor_id, items_cents, lines), which has its sums.

    Customers and nations meet the orders first, so the lines are moved for the orders only.
    """
    n = {t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "supplier")}
    placed = n["orders"].join(n["customer"], F.col("o_custkey") == F.col("c_custkey")).join(n["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    sums = lines.withColumn("invoice_id", F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("vendor_id").cast("string")))
    chosen = VIEWS["fx_heads"].split("\nFROM ")[0]
    return spark.sql(f"{chosen}, i.lines FROM {{sums}} i JOIN {{placed}} ON i.l_orderkey = o_orderkey JOIN {{supplier}} ON i.vendor_id = s_suppkey",
                     sums=sums, placed=placed, supplier=n["supplier"])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One reshaped table as a lazy DataFrame."""
    sql = VIEWS[name]
    args = {t: table(spark, sf_dir, t) for t in _BASE if f" {t}" in sql or f"\n{t}" in sql}
    if _SUMS in sql:
        sql = sql.replace(_SUMS, "{sums} i")
        args["sums"] = invoice_sums(args["lineitem"], args["part"])
    for t in args:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    used = {t: df for t, df in args.items() if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def extraction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction files ``(file_id, extraction)``: one JSON text per invoice, some sent twice.

    Built from ``fx_heads`` and ``fx_lines``, with the traps those views describe. The lines are brought together by the
    columns that number them, and their sums taken there, so they are read once and meet the heads without an own join.
    """
    text = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    quantity = (
        F.when(F.col("quantity_as") == "missing", "")
        .when(F.col("quantity_as") == "null", ',"quantity":null')
        .when(F.col("quantity_as") == "word", ',"quantity":"x"')
        .when(F.col("quantity_as") == "quoted", F.concat(F.lit(',"quantity":"'), number("quantity"), F.lit('"')))
        .otherwise(F.concat(F.lit(',"quantity":'), number("quantity")))
    )
    line = F.concat(
        F.lit('{"product_name":'), text("product_name"), F.lit(',"sku":'), text("sku"), quantity,
        F.lit(',"unit_price":'), number("unit_price"), F.lit(',"line_total":'), number("line_total"), F.lit("}"))
    cents = F.sum(F.round(F.col("line_total") * 100).cast("bigint")).cast("bigint").alias("items_cents")
    lines = lines_by_order(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")).groupBy("l_orderkey", "vendor_id").agg(
        cents, F.array_sort(F.collect_list(F.struct("line_number", line.alias("json")))).alias("lines"))
    store = (
        F.when(F.col("store_as") == "null", ',"store":null').when(F.col("store_as") == "missing", "")
        .otherwise(F.concat(F.lit(',"store":{"name":'), text("store_name"), F.lit(',"address":null}')))
    )
    confidence = F.coalesce(F.concat(F.lit(',"confidence":'), F.col("confidence").cast("string")), F.lit(""))
    head = F.concat(
        F.lit('{"vendor":{"name":'), text("vendor_name"), F.lit(',"nit":'), text("nit"), F.lit("}"), store,
        F.lit(',"invoice_number":'), text("invoice_number"), F.lit(',"invoice_date":'), text("invoice_date"),
        F.lit(',"items":['), F.array_join(F.transform("lines", lambda x: x["json"]), ","), F.lit("]"),
        F.lit(',"subtotal":'), number("subtotal"), F.lit(',"total":'), number("total"), confidence, F.lit("}"))
    copies = F.when(F.col("sent_twice"), F.array(F.lit("a-"), F.lit("b-"))).otherwise(F.array(F.lit("a-")))
    texts = heads_with_lines(spark, sf_dir, lines).select(copies.alias("copies"), "invoice_id", head.alias("extraction"))
    return texts.select(F.explode("copies").alias("copy"), "invoice_id", "extraction").select(
        F.concat("copy", "invoice_id").alias("file_id"), "extraction")


def with_views(sql: str) -> str:
    """Prefix a check statement with the reshaped tables it names."""
    ctes = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in sql]
    if not ctes:
        return sql
    body = sql.lstrip()
    head = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    shaped = head + ",\n".join(ctes)
    if body.startswith("WITH "):
        return f"{shaped},\n{body.removeprefix(head).removeprefix('WITH ').lstrip()}"
    return f"{shaped}\n{body}"
