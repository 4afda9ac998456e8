"""Queries for file intake, extraction, validation, loading and streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuadre.functions import text
from cuadre.operators import cascade, extraction, load, normalize, reports, stores
from cuadre.operators.joins import lookup_hot
from cuadre.plans.fixtures import extraction_json, table, view
from cuadre.plans.registry import query
from cuadre.plans.report_queries import MAKERS_SQL
from cuadre.session import cut, kept, scratch_path
from cuadre.sources import catalog, files, prices
from cuadre.streaming import ingest as streams, keyed

# ---- files -----------------------------------------------------------------


@query("file_accept", r"""
SELECT id, name, size FROM fx_files
WHERE lower(regexp_extract(name, '\.([^./]+)$', 1)) IN ('pdf', 'jpg', 'jpeg', 'png') AND size <= 10485760""")
def file_accept(spark, sf):
    listing = view(spark, sf, "fx_files")
    return listing.where(text.file_accepted(F.col("name"), F.col("size"))).select("id", "name", "size")


@query("media_type", r"""
SELECT id, name, CASE lower(regexp_extract(name, '\.([^./]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg'
  WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'gif' THEN 'image/gif' END AS media_type FROM fx_files""")
def media_type(spark, sf):
    return view(spark, sf, "fx_files").select("id", "name", text.media_type(F.col("name")).alias("media_type"))


@query("new_files", """
SELECT id, name, folder_id FROM (SELECT concat('file-', CAST(o_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id, name, folder_id
  FROM fx_files JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l ON l_orderkey = o_orderkey) f
WHERE id NOT IN (SELECT source_file_id FROM fx_invoices WHERE source_file_id IS NOT NULL)""")
def new_files(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    listing = view(spark, sf, "fx_files").join(lines, "o_orderkey").select(
        F.concat_ws("-", F.lit("file"), "o_orderkey", "l_suppkey").alias("id"), "name", "folder_id")
    return files.new_files(listing, view(spark, sf, "fx_invoices"))


@query("file_listing", r"""
SELECT regexp_replace(folder_id, '[^A-Za-z0-9]', '-', 'g') AS folder, CAST(NULL AS STRING) AS mime_type, CAST(1 AS BIGINT) AS files,
  CAST(sum(octet_length(encode(id)) + 1) AS BIGINT) AS bytes FROM fx_files GROUP BY 1""")
def file_listing(spark, sf):
    """Files that Spark wrote, one in each folder, listed without reading them."""
    root = scratch_path(spark, "listing")
    rows = view(spark, sf, "fx_files").select("id", F.regexp_replace("folder_id", "[^A-Za-z0-9]", "-").alias("folder"))
    rows.repartition("folder").write.partitionBy("folder").text(root)
    listed = files.list_files(spark, [f"{root}/folder=*"], ["txt"])
    folder = F.regexp_extract("id", "/folder=([^/]+)/[^/]+$", 1)
    return listed.where(F.endswith("id", F.concat(F.lit("/"), "name"))).groupBy(folder.alias("folder"), "mime_type").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"))


# ---- catalogs and prices ---------------------------------------------------

def _write_catalogs(spark: SparkSession, sf: str) -> str:
    """Two catalog files per layout, written from ``part``, with blanks around the values."""
    folder = scratch_path(spark, "catalogs")
    part = table(spark, sf, "part")
    code = F.format_string("%06d", "p_partkey")
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    price = F.format_string("$%.2f", "p_retailprice")
    first = part.select(F.when(F.col("p_partkey") % 4 != 0, code).alias("Code"), F.when(F.col("p_size") > 3, F.concat(F.lit(" "), name, F.lit("  "))).alias("Item "),
                        F.col("p_type").alias("Group"), price.alias("Price per case ($)"))
    boxed = F.concat_ws(" ", "p_type", "p_name", "p_size", F.lit("Kg"), "p_brand")
    second = part.select(code.alias("Items"), boxed.alias("Description "), F.lit("#ERROR!").alias("Price "), price.alias("Price"))
    write = lambda df, sub: df.write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{sub}")
    write(first, "database")
    write(second, "sheet")
    return folder


def read_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    folder = _write_catalogs(spark, sf)
    return catalog.read_catalogs(spark, [(f"{folder}/database", "*.csv"), (f"{folder}/sheet", "*.csv")])


CATALOG_SQL = """
catalog AS (
  SELECT CASE WHEN p_partkey % 4 <> 0 THEN lpad(CAST(p_partkey AS STRING), 6, '0') END AS code,
         CASE WHEN p_size > 3 THEN concat(' ', p_name, ' ', p_brand, ' ', p_type, '  ') END AS item FROM part
  UNION ALL SELECT lpad(CAST(p_partkey AS STRING), 6, '0'), concat(p_type, ' ', p_name, ' ', CAST(p_size AS STRING), ' Kg ', p_brand) FROM part)"""


@query("catalog_scan", f"WITH {CATALOG_SQL} SELECT code, item FROM catalog")
def catalog_scan(spark, sf):
    return read_catalogs(spark, sf).select("code", "item")


@query("catalog_vendor_tag", """
SELECT concat(vendor_product_name, '.csv') AS file_name, CASE WHEN contains(lower(vendor_product_name), 'bindi') THEN 'Bindi'
  WHEN contains(lower(vendor_product_name), 'bridor') THEN 'Bridor' ELSE 'Unknown' END AS vendor, count(*) AS files
FROM fx_items GROUP BY 1, 2""")
def catalog_vendor_tag(spark, sf):
    names = view(spark, sf, "fx_items").select(F.concat("vendor_product_name", F.lit(".csv")).alias("file_name"))
    return names.groupBy("file_name", catalog.vendor_tag(F.col("file_name")).alias("vendor")).agg(F.count("*").alias("files"))


@query("catalog_distinct", f"""WITH {CATALOG_SQL}
SELECT 'Unknown' AS vendor, trim(code) AS code, trim(item) AS name FROM (SELECT DISTINCT code, item FROM catalog) c
WHERE item IS NOT NULL""")
def catalog_distinct(spark, sf):
    return catalog.distinct_products(read_catalogs(spark, sf))


@query("agreed_prices", """
SELECT s_name AS distributor, CASE WHEN l_partkey % 10 <> 0 THEN lpad(CAST(l_partkey AS STRING), 7, '0') END AS item_code,
       CAST(min(round(p_retailprice * 200)) AS DOUBLE) / 100 AS agreed_price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_name, l_partkey""")
def agreed_prices(spark, sf):
    """Prices written as CSV from the line items, then read by position."""
    path = scratch_path(spark, "prices")
    l, s, p = (table(spark, sf, n) for n in ("lineitem", "supplier", "part"))
    keys = l.select("l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(
        p, F.col("l_partkey") == F.col("p_partkey"))
    code = F.when(F.col("l_partkey") % 10 != 0, F.format_string("%07d", "l_partkey")).otherwise("N/A")
    keys.select(F.col("s_name").alias("Razón Social"), code.alias("Código Item"),
                F.format_string("%.2f", F.col("p_retailprice") * 2).alias("Precio Acordado por Case")
                ).write.option("header", True).csv(path)
    return prices.read_agreed_prices(spark, path).withColumn("agreed_price", F.col("agreed_price").cast("double"))


@query("product_master", """
SELECT concat('SKU-', CAST(p_partkey AS STRING)) AS master_sku, concat(p_name, ' ', p_brand) AS master_name,
       p_type AS category, CAST(NULL AS STRING) AS unit FROM part""")
def product_master(spark, sf):
    path = scratch_path(spark, "master")
    table(spark, sf, "part").select(
        F.concat(F.lit("SKU-"), "p_partkey").alias("SKU"), F.concat_ws(" ", "p_name", "p_brand").alias("Product Name"),
        F.col("p_type").alias("Category")).write.option("header", True).csv(path)
    return catalog.read_product_master(spark, path)


# ---- extraction ------------------------------------------------------------

# what the records of the extraction files should look like
RECORDS_SQL = """
good_lines AS (
  SELECT *, CASE quantity_as WHEN 'missing' THEN 0 ELSE quantity END AS kept_quantity
  FROM fx_lines WHERE quantity_as NOT IN ('null', 'word')),
sums AS (SELECT invoice_id, count(*) AS n, sum(line_total) AS items_sum FROM good_lines GROUP BY 1),
records AS (
  SELECT h.*, coalesce(n, 0) AS n, coalesce(items_sum, 0) AS items_sum,
    coalesce(abs(coalesce(items_sum, 0) - total) / nullif(total, 0) > 0.01::DOUBLE, false) AS off_total,
    try_cast(invoice_date AS DATE) AS day, concat(prefix, h.invoice_id) AS file_id,
    CASE WHEN store_as = 'given' THEN store_name END AS store,
    CASE WHEN store_as = 'null' THEN 'store_null' WHEN coalesce(n, 0) = 0 THEN 'no_items'
         WHEN invoice_date IS NOT NULL AND try_cast(invoice_date AS DATE) IS NULL THEN 'invoice_date_invalid'
         WHEN total <= 0 THEN 'total_invalid' WHEN invoice_date IS NULL THEN 'invoice_date_missing' END AS reject_reason
  FROM fx_heads h LEFT JOIN sums s ON s.invoice_id = h.invoice_id
  JOIN (SELECT 'a-' AS prefix UNION ALL SELECT 'b-') c ON prefix = 'a-' OR sent_twice),
scored AS (
  SELECT *, coalesce(confidence, 0.8::DOUBLE) * (CASE WHEN vendor_name = '' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN off_total THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) AS adjusted FROM records)"""


def records(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return extraction.parse_extractions(extraction_json(spark, sf), columns=columns or None)


@query("extraction_parse", f"""WITH {RECORDS_SQL}
SELECT file_id, vendor_name, nit, store, invoice_number, day AS invoice_date, nullif(subtotal, -1) AS subtotal, total,
       coalesce(confidence, 0.8) AS extracted_confidence FROM records""")
def extraction_parse(spark, sf):
    return records(spark, sf, "vendor", "store", "invoice_number", "invoice_date", "subtotal", "total", "extracted_confidence").select(
        "file_id", F.col("vendor.name").alias("vendor_name"), "vendor.nit", F.col("store.name").alias("store"),
        "invoice_number", "invoice_date", "subtotal", "total", "extracted_confidence")


@query("item_salvage", f"""WITH {RECORDS_SQL}
SELECT r.file_id, g.product_name, g.sku, CAST(g.kept_quantity AS DOUBLE) AS quantity, g.unit_price, g.line_total
FROM records r JOIN good_lines g ON r.invoice_id = g.invoice_id""")
def item_salvage(spark, sf):
    return records(spark, sf, "items").select("file_id", F.explode("items").alias("i")).select("file_id", "i.*")


@query("extraction_reject", f"""WITH {RECORDS_SQL} SELECT file_id, n AS items, reject_reason FROM records""")
def extraction_reject(spark, sf):
    return records(spark, sf, "items", "reject_reason").select("file_id", F.size("items").cast("bigint").alias("items"), "reject_reason")


@query("confidence_adjust", f"""WITH {RECORDS_SQL}
SELECT file_id, round(items_sum, 2) AS items_sum, round(adjusted, 6) AS confidence FROM scored""")
def confidence_adjust(spark, sf):
    return records(spark, sf, "items_sum", "confidence").select(
        "file_id", F.round("items_sum", 2).alias("items_sum"), F.round("confidence", 6).alias("confidence"))


@query("invoice_warnings", f"""WITH {RECORDS_SQL}
SELECT file_id, concat_ws(';', CASE WHEN vendor_name = '' THEN 'Vendor sin nombre' END, CASE WHEN n = 0 THEN 'Factura sin items' END,
  CASE WHEN total <= 0 THEN 'Total inválido' END, CASE WHEN off_total THEN 'Suma items != Total' END) AS warnings FROM records""")
def invoice_warnings(spark, sf):
    return extraction.invoice_warnings(records(spark, sf, "vendor", "invoice_number", "items", "items_sum", "total")).select("file_id", F.array_join("warnings", ";").alias("warnings"))


@query("invoice_validate", rf"""WITH {RECORDS_SQL}
SELECT file_id, errors, errors = '' AS is_valid FROM (
  SELECT file_id, concat_ws(';', CASE WHEN NOT regexp_matches(nit, '^\d{{9,10}}-\d$') THEN 'NIT inválido' END,
    CASE WHEN abs(date_diff('day', day, DATE '1998-06-30')) > 365 THEN 'Fecha de factura fuera de rango' END,
    CASE WHEN off_total THEN 'Discrepancia en total' END) AS errors FROM records WHERE reject_reason IS NULL) e""")
def invoice_validate(spark, sf):
    good = records(spark, sf, "vendor", "invoice_date", "items_sum", "total", "reject_reason").where(F.col("reject_reason").isNull())
    return extraction.validate_records(good, date(1998, 6, 30)).select(
        "file_id", F.array_join("errors", ";").alias("errors"), "is_valid")


# ---- loading ---------------------------------------------------------------

# vendors known before the batch: those with a processed invoice
_KNOWN = """
known AS (SELECT id, name, nit FROM fx_vendors WHERE id IN
  (SELECT vendor_id FROM fx_invoices WHERE processing_status = 'processed' AND created_at < TIMESTAMP '1995-01-03')),
batch AS (SELECT v.id, v.nit, concat(v.name, ' ', i.invoice_number) AS name, i.id AS seen
  FROM fx_invoices i JOIN fx_vendors v ON i.vendor_id = v.id)"""


def _known_vendors(spark: SparkSession, sf: str) -> DataFrame:
    early = view(spark, sf, "fx_invoices").where(
        (F.col("processing_status") == "processed") & (F.col("created_at") < F.lit("1995-01-03").cast("timestamp_ntz")))
    return view(spark, sf, "fx_vendors").join(early.select(F.col("vendor_id").alias("id")).distinct(), "id", "left_semi")


@query("vendor_upsert", f"""WITH {_KNOWN}
SELECT id, name, nit FROM known UNION ALL
SELECT id, name, nit FROM (SELECT *, row_number() OVER (PARTITION BY nit ORDER BY seen) AS r FROM batch
  WHERE nit NOT IN (SELECT nit FROM known)) b WHERE r = 1""")
def vendor_upsert(spark, sf):
    vendors = view(spark, sf, "fx_vendors").select(F.col("id").alias("vendor_id"), "nit", F.col("name").alias("vendor"))
    batch = view(spark, sf, "fx_invoices").join(vendors, "vendor_id").select(
        F.col("vendor_id").alias("id"), "nit", F.concat_ws(" ", "vendor", "invoice_number").alias("name"), F.col("id").alias("at"))
    return load.get_or_create_vendors(_known_vendors(spark, sf), batch, F.col("at"))


@query("seed_insert", """
SELECT concat('C', CAST(c_custkey AS STRING)) AS code, c_name AS name FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
UNION ALL
SELECT code, min(name) FROM (SELECT concat('C', CAST(o_custkey AS STRING)) AS code, concat('Tienda ', o_orderpriority) AS name FROM orders) s
WHERE code NOT IN (SELECT concat('C', CAST(c_custkey AS STRING)) FROM customer WHERE c_mktsegment <> 'HOUSEHOLD') GROUP BY 1""")
def seed_insert(spark, sf):
    """Stores of all segments but one, and a seed row per order: taken codes change nothing."""
    c = table(spark, sf, "customer")
    existing = c.where(F.col("c_mktsegment") != "HOUSEHOLD").select(F.concat(F.lit("C"), "c_custkey").alias("code"), F.col("c_name").alias("name"))
    seeds = table(spark, sf, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("code"), F.concat(F.lit("Tienda "), "o_orderpriority").alias("name"))
    return load.insert_if_absent(existing, seeds, ["code"], F.col("name"))


@query("invoice_dedupe", """
SELECT l_suppkey AS vendor_id, concat('FAC-', CAST(l_orderkey AS STRING)) AS invoice_number, min(file_id) AS file_id
FROM (SELECT l_suppkey, l_orderkey, concat(CAST(CAST(l_shipdate AS DATE) AS STRING), '/', CAST(l_partkey AS STRING)) AS file_id FROM lineitem) f
WHERE NOT EXISTS (SELECT 1 FROM fx_invoices i WHERE i.vendor_id = l_suppkey AND i.processing_status = 'processed'
                  AND i.invoice_number = concat('FAC-', CAST(l_orderkey AS STRING))) GROUP BY 1, 2""")
def invoice_dedupe(spark, sf):
    """One file per line item; the first file of an invoice wins, loaded invoices stay."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("vendor_id"), F.concat(F.lit("FAC-"), "l_orderkey").alias("invoice_number"),
        F.concat_ws("/", F.to_date("l_shipdate"), "l_partkey").alias("file_id"))
    loaded = view(spark, sf, "fx_invoices").where(F.col("processing_status") == "processed")
    return load.new_rows(loaded, lines, ["vendor_id", "invoice_number"], F.col("file_id"))


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    good = records(spark, sf).where(F.col("reject_reason").isNull())
    return good.withColumns({"vendor_id": F.col("vendor.nit"), "store_id": F.lit(None).cast("string"),
                             "invoice_id": F.col("file_id")})


@query("invoice_header", f"""WITH {RECORDS_SQL}
SELECT file_id AS source_file_id, invoice_number, nit AS vendor_id, day AS invoice_date, nullif(subtotal, 0) AS subtotal, total,
  round(adjusted, 6) AS confidence_score, 'processed' AS processing_status, vendor_name, store AS store_name, n AS items
FROM scored WHERE reject_reason IS NULL""")
def invoice_header(spark, sf):
    rows = load.invoice_headers(_accepted(spark, sf))
    read = lambda p: F.get_json_object("structured_data", p)
    return rows.select(
        "source_file_id", "invoice_number", "vendor_id", "invoice_date", "subtotal", "total",
        F.round("confidence_score", 6).alias("confidence_score"), "processing_status", read("$.vendor.name").alias("vendor_name"),
        read("$.store.name").alias("store_name"), F.json_array_length(read("$.items")).cast("bigint").alias("items"))


@query("invoice_items", f"""WITH {RECORDS_SQL}
SELECT file_id AS invoice_id, product_name AS vendor_product_name, sku AS vendor_sku, CAST(kept_quantity AS DOUBLE) AS quantity,
  unit_price, line_total, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS INT) AS line_number, false AS matched
FROM scored s JOIN good_lines g ON s.invoice_id = g.invoice_id WHERE reject_reason IS NULL""")
def invoice_items(spark, sf):
    return load.invoice_items(_accepted(spark, sf)).select(
        "invoice_id", "vendor_product_name", "vendor_sku", "quantity", "unit_price", "line_total", "line_number", "matched")


@query("manufacturer_dim", f"""WITH {MAKERS_SQL}
SELECT i.id, m.manufacturer_name, CASE manufacturer_name WHEN 'Lavazza' THEN 'known-1' ELSE manufacturer_name END AS manufacturer_key
FROM fx_items i JOIN makers m ON i.vendor_product_name = m.vendor_product_name""")
def manufacturer_dim(spark, sf):
    # read for the names and for the items: taken apart once
    items = kept(reports.with_manufacturer(view(spark, sf, "fx_items"), to_filter=True).select("id", "manufacturer_name"))
    known = spark.createDataFrame([("known-1", "Lavazza")], "id string, name string")
    dim, mapped = load.get_or_create_manufacturers(known, items)
    keys = dim.select(F.col("id").alias("manufacturer_id"),
                      F.when(F.col("id") == "known-1", F.col("id")).otherwise(F.col("name")).alias("manufacturer_key"))
    return lookup_hot(mapped, keys, "manufacturer_id").select("id", "manufacturer_name", "manufacturer_key")


@query("product_upsert", """
SELECT coalesce(p.master_sku, n.master_sku) AS master_sku, coalesce(n.master_name, p.master_name) AS master_name,
  CASE WHEN n.master_sku IS NULL THEN p.category ELSE n.category END AS category,
  n.master_sku IS NOT NULL AND (p.master_sku IS NULL OR n.master_name <> p.master_name OR n.category <> p.category) AS touched
FROM (SELECT * FROM fx_products WHERE category <> 'PROMO') p
FULL JOIN (SELECT master_sku, max_by(master_name, seen) AS master_name, max_by(category, seen) AS category
  FROM (SELECT concat('SKU-', CAST(l_partkey AS STRING)) AS master_sku, concat('Product ', l_returnflag, l_linestatus) AS master_name,
          l_returnflag AS category, concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING), l_returnflag, l_linestatus) AS seen FROM lineitem) b
  GROUP BY 1) n ON p.master_sku = n.master_sku""")
def product_upsert(spark, sf):
    products = view(spark, sf, "fx_products").where(F.col("category") != "PROMO").withColumn("id", F.col("id").cast("string"))
    batch = table(spark, sf, "lineitem").select(
        F.concat(F.lit("SKU-"), "l_partkey").alias("master_sku"),
        F.concat(F.lit("Product "), "l_returnflag", "l_linestatus").alias("master_name"), F.col("l_returnflag").alias("category"),
        F.concat(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey"), "l_returnflag", "l_linestatus").alias("at"))
    state = load.upsert_products(products, batch, F.col("at"), as_of=date(2024, 1, 1))
    return state.select("master_sku", "master_name", "category", F.col("updated_at").isNotNull().alias("touched"))


@query("manual_corrections", """
SELECT i.id, coalesce(c.total, i.total) AS total, coalesce(c.processing_status, i.processing_status) AS processing_status,
  coalesce(c.validated, false) AS validated, c.validated_by
FROM fx_invoices i LEFT JOIN (
  SELECT invoice_id, max_by(total, seen) AS total, max_by(processing_status, seen) AS processing_status, true AS validated,
    max_by(validated_by, seen) AS validated_by
  FROM (SELECT invoice_id, quantity AS total, CASE WHEN quantity > 25 THEN 'validated' ELSE processing_status END AS processing_status,
          concat('user ', CAST(line_number AS STRING)) AS validated_by, line_number AS seen
        FROM fx_items JOIN fx_invoices ON fx_items.invoice_id = fx_invoices.id WHERE processing_status = 'manual_review') r
  GROUP BY 1) c ON c.invoice_id = i.id""")
def manual_corrections(spark, sf):
    """A correction per item of the invoices under review; the last one counts."""
    invoices, items = view(spark, sf, "fx_invoices"), view(spark, sf, "fx_items")
    review = invoices.where(F.col("processing_status") == "manual_review").select(F.col("id").alias("invoice_id"), F.col("processing_status").alias("old"))
    requests = items.join(review, "invoice_id").select(
        "invoice_id", F.col("quantity").alias("total"),
        F.when(F.col("quantity") > 25, "validated").otherwise(F.col("old")).alias("processing_status"),
        F.lit(True).alias("validated"), F.concat(F.lit("user "), "line_number").alias("validated_by"), F.col("line_number").alias("at"))
    return load.apply_corrections(invoices, requests, ["total", "processing_status"], F.col("at")).select(
        "id", "total", "processing_status", "validated", "validated_by")


_INGEST_SQL = f"""WITH {RECORDS_SQL},
first AS (SELECT nit, invoice_number, min(file_id) AS file_id FROM records WHERE reject_reason IS NULL AND NOT EXISTS
  (SELECT 1 FROM fx_invoices i WHERE i.processing_status = 'processed' AND concat(CAST(900000000 + i.vendor_id AS STRING), '-', CAST(i.vendor_id % 10 AS STRING)) = records.nit
   AND i.invoice_number = records.invoice_number) GROUP BY 1, 2)
SELECT s.file_id, s.reject_reason, round(adjusted, 6) AS confidence,
  CASE WHEN s.reject_reason IS NOT NULL THEN 'rejected' WHEN f.file_id IS NOT NULL THEN 'processed' ELSE 'duplicate' END AS status
FROM scored s LEFT JOIN first f ON f.file_id = s.file_id"""


def _tables_before(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vendors, stores, and the invoices already loaded (the processed ones), keyed by tax number."""
    vendors = view(spark, sf, "fx_vendors").select(F.col("nit").alias("id"), "nit")
    stores_ = view(spark, sf, "fx_stores").select("id", "name")
    loaded = view(spark, sf, "fx_invoices").where(F.col("processing_status") == "processed").select(
        F.concat_ws("-", F.col("vendor_id") + 900000000, F.col("vendor_id") % 10).alias("vendor_id"), "invoice_number")
    return vendors, stores_, loaded


@query("ingest_pipeline", _INGEST_SQL)
def ingest_pipeline(spark, sf):
    vendors, stores_, loaded = _tables_before(spark, sf)
    result = load.ingest(extraction_json(spark, sf), vendors, stores_, loaded)
    return result.status.select("file_id", "reject_reason", F.round("confidence", 6).alias("confidence"), "status")


_ADDED = _INGEST_SQL[: _INGEST_SQL.index("SELECT s.file_id")]


def _added(spark, sf):
    vendors, stores_, loaded = _tables_before(spark, sf)
    return load.ingest(extraction_json(spark, sf), vendors, stores_, loaded)


@query("ingest_invoices", _ADDED + """
SELECT r.file_id, r.invoice_number, r.nit, r.day AS invoice_date, r.total FROM records r JOIN first f ON f.file_id = r.file_id""")
def ingest_invoices(spark, sf):
    """The invoice rows that a batch adds, with the tax number from their stored record."""
    rows = _added(spark, sf).invoices
    nit = F.get_json_object("structured_data", "$.vendor.nit")
    return rows.select(F.col("source_file_id").alias("file_id"), "invoice_number", nit.alias("nit"), "invoice_date", "total")


@query("ingest_items", _ADDED + """
SELECT r.file_id, CAST(row_number() OVER (PARTITION BY r.file_id ORDER BY g.line_number) AS INT) AS line_number, g.product_name,
  CAST(g.kept_quantity AS DOUBLE) AS quantity, g.line_total
FROM records r JOIN first f ON f.file_id = r.file_id JOIN good_lines g ON g.invoice_id = r.invoice_id""")
def ingest_items(spark, sf):
    """The item rows that a batch adds."""
    result = _added(spark, sf)
    invoices = result.invoices.select(F.col("id").alias("invoice_id"), F.col("source_file_id").alias("file_id"))
    return result.items.join(invoices, "invoice_id").select(
        "file_id", "line_number", F.col("vendor_product_name").alias("product_name"), "quantity", "line_total")


@query("ingest_vendors", _ADDED + """
SELECT sha256(nit) AS id, nit, arg_min(vendor_name, file_id) AS name FROM records
WHERE reject_reason IS NULL AND nit NOT IN (SELECT nit FROM fx_vendors WHERE id % 3 <> 0) GROUP BY nit""")
def ingest_vendors(spark, sf):
    """The vendors that a batch adds to two thirds of them, as its first file of each names them."""
    vendors, stores_, loaded = _tables_before(spark, sf)
    known = vendors.join(view(spark, sf, "fx_vendors").where("id % 3 <> 0").select("nit"), "nit", "left_semi")
    return load.ingest(extraction_json(spark, sf), known, stores_, loaded).vendors.select("id", "nit", "name")


# some product names get a maker, and every 41st order's text is too short to extract from
_MAKERS = """SELECT *, CASE WHEN suffix(product_name, 'd') THEN 'Bindi' WHEN suffix(product_name, 't') THEN 'Lavazza' END AS maker FROM good_lines"""


@query("ingest_manufacturers", _ADDED.replace("WHERE reject_reason IS NULL AND NOT EXISTS", "WHERE reject_reason IS NULL AND o_orderkey % 41 <> 0 AND NOT EXISTS") + f"""
SELECT maker AS name, CASE maker WHEN 'Bindi' THEN 'known' ELSE sha256(maker) END AS manufacturer_id, maker <> 'Bindi' AS is_new, count(*) AS items
FROM first f JOIN records r ON r.file_id = f.file_id JOIN ({_MAKERS}) g ON g.invoice_id = r.invoice_id WHERE maker IS NOT NULL GROUP BY 1""")
def ingest_manufacturers(spark, sf):
    """The ingest stream with manufacturers and source texts: whom it adds, and the items that name them."""
    named = F.regexp_replace("extraction", '("product_name":"[^"]*d)"', '$1 (Bindi)"')
    named = F.regexp_replace(named, '("product_name":"[^"]*t)"', '$1 - Lavazza"')
    order = F.regexp_extract("extraction", '"invoice_number":"FAC-([0-9]+)"', 1).cast("bigint")
    lines = extraction_json(spark, sf).select(F.to_json(F.struct(
        "file_id", F.lit("2024-01-01T00:00:00Z").alias("received_at"), named.alias("extraction"),
        F.when(order % 41 == 0, " short ").otherwise("a text long enough").alias("raw_ocr_text"))).alias("value"))
    path = _drop(spark, lines)
    known = spark.createDataFrame([("known", "Bindi")], "id string, name string")
    vendors, stores_, loaded = (cut(t) for t in _tables_before(spark, sf))
    root = scratch_path(spark, "tables")
    source = streams.read_extractions(spark, path, source_text=True)
    streams.stream_ingest(source, root, scratch_path(spark, "stream"), stores_, vendors, loaded, manufacturers=known).awaitTermination()
    added = spark.read.parquet(f"{root}/manufacturers").select("name", F.lit(True).alias("is_new"))
    items = spark.read.parquet(f"{root}/items").where("manufacturer_name IS NOT NULL")
    counted = items.groupBy(F.col("manufacturer_name").alias("name"), "manufacturer_id").agg(F.count("*").alias("items"))
    return counted.join(added, "name", "left").select("name", "manufacturer_id", F.coalesce("is_new", F.lit(False)).alias("is_new"), "items")


_EDGES = """
edges AS (
  SELECT concat('n', CAST(n_nationkey AS STRING)) AS child, concat('r', CAST(n_regionkey AS STRING)) AS parent FROM nation
  UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)) FROM supplier
  UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)) FROM customer
  UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), concat('c', CAST(o_custkey AS STRING)) FROM orders
  UNION ALL SELECT concat('l', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)), concat('o', CAST(l_orderkey AS STRING)) FROM lineitem
  UNION ALL SELECT concat('l', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)), concat('s', CAST(l_suppkey AS STRING)) FROM lineitem)"""


@query("cascade_removal", f"""WITH RECURSIVE {_EDGES},
gone(id) AS (SELECT 'r0' UNION SELECT child FROM edges JOIN gone ON parent = id),
kinds AS (SELECT unnest(['r', 'n', 's', 'c', 'o', 'l']) AS kind)
SELECT kind, count(DISTINCT id) AS removed FROM kinds LEFT JOIN gone ON left(id, 1) = kind GROUP BY 1""")
def cascade_removal(spark, sf):
    """Rows that go from every table when a region goes."""
    t = lambda n: table(spark, sf, n)
    tables = {
        "r": t("region").select(F.col("r_regionkey").cast("string").alias("id")),
        "n": t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("region")),
        "s": t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("nation")),
        "c": t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("nation")),
        "o": t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("customer")),
        "l": t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("order"),
                                  F.col("l_suppkey").cast("string").alias("supplier")),
    }
    keys = [cascade.ForeignKey(*k) for k in (("n", "region", "r"), ("s", "nation", "n"), ("c", "nation", "n"), ("o", "customer", "c"), ("l", "order", "o"), ("l", "supplier", "s"))]
    gone = cascade.closure(tables, keys, {"r": tables["r"].where("id = '0'")})
    counts = None
    for kind in tables:
        n = gone[kind].agg(F.lit(kind).alias("kind"), F.count("*").alias("removed")) if kind in gone else spark.createDataFrame([(kind, 0)], "kind string, removed bigint")
        counts = n if counts is None else counts.unionByName(n)
    return counts


@query("store_contains", """
SELECT q.name, (SELECT min(s.id) FROM fx_stores s WHERE contains(lower(s.name), lower(q.name))) AS store_id
FROM (SELECT DISTINCT store_name AS name FROM fx_heads) q""")
def store_contains(spark, sf):
    names = view(spark, sf, "fx_heads").select(F.col("store_name").alias("name"))
    return stores.find_stores(names, view(spark, sf, "fx_stores"))


@query("store_code", """
SELECT base, count(*) AS stores, count(DISTINCT code) AS codes FROM (
  SELECT translate(upper(substr(c_name, 1, 10)), ' -', '__') AS base, c_name AS code FROM customer
  UNION ALL SELECT translate(upper(substr(s_name, 1, 10)), ' -', '__'), s_name FROM supplier) x GROUP BY 1""")
def store_code(spark, sf):
    """Codes for stores named as customers and suppliers; many share a base, and all codes differ."""
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(
        table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    taken = view(spark, sf, "fx_stores").select("code")
    coded = normalize.store_codes(names, taken)
    base = F.regexp_replace("code", "_[0-9]+$", "")
    return coded.groupBy(base.alias("base")).agg(F.count("*").alias("stores"), F.countDistinct("code").alias("codes"))


# ---- streams ---------------------------------------------------------------


def _write_lines(spark: SparkSession, sf: str) -> str:
    """The extraction files as JSON lines, in several drops."""
    return _drop(spark, extraction_json(spark, sf).select(F.to_json(F.struct(
        "file_id", F.lit("2024-01-01T00:00:00Z").alias("received_at"), "extraction")).alias("value")))


def _drop(spark: SparkSession, lines: DataFrame) -> str:
    """Lines as compressed text files, each of so few lines that a task reads it whole."""
    path = scratch_path(spark, "drops")
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", 200_000).text(path)
    return path


@query("stream_ingest", _INGEST_SQL)
def stream_ingest(spark, sf):
    """The ingest as a stream over the files; equals the batch run whatever the drops."""
    source = streams.read_extractions(spark, _write_lines(spark, sf))
    vendors, stores_, loaded = (cut(t) for t in _tables_before(spark, sf))
    root, checkpoint = scratch_path(spark, "tables"), scratch_path(spark, "stream")
    streams.stream_ingest(source, root, checkpoint, stores_, vendors, loaded).awaitTermination()
    return spark.read.parquet(f"{root}/status").select(
        "file_id", "reject_reason", F.round("confidence", 6).alias("confidence"), "status")


@query("stream_ingest_keyed", _INGEST_SQL)
def stream_ingest_keyed(spark, sf):
    """The ingest as a stream that knows files and invoices by keyed state."""
    source = streams.read_extractions(spark, _write_lines(spark, sf))
    vendors, stores_, loaded = (cut(t) for t in _tables_before(spark, sf))
    root, checkpoint = scratch_path(spark, "tables"), scratch_path(spark, "stream")
    keyed.stream_ingest(source, root, checkpoint, stores_, vendors, loaded).awaitTermination()
    return spark.read.parquet(f"{root}/status").select(
        "file_id", "reject_reason", F.round("confidence", 6).alias("confidence"), "status")


@query("stream_dedupe", "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def stream_dedupe(spark, sf):
    """Every (user, event type) once, however often the stream carries it."""
    folder = scratch_path(spark, "events")
    table(spark, sf, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("file_id"), "user_id", "event_type",
        F.col("ts").cast("timestamp").alias("received_at")).write.parquet(folder)
    stream = spark.readStream.schema("file_id string, user_id bigint, event_type string, received_at timestamp").parquet(folder)
    out = scratch_path(spark, "deduped")
    streams.dedupe_files(stream, "60 days").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("kinds"))


_WINDOWS_SQL = """
SELECT date_trunc('hour', created_at) AS window_start, event_type, status, count(*) AS events FROM fx_log GROUP BY 1, 2, 3"""


@query("event_window_counts", _WINDOWS_SQL)
def event_window_counts(spark, sf):
    return streams.event_counts(view(spark, sf, "fx_log"))


@query("stream_event_counts", """
SELECT CAST(epoch(date_trunc('hour', created_at)) AS BIGINT) AS window_start, event_type, status, count(*) AS events
FROM fx_log GROUP BY 1, 2, 3""")
def stream_event_counts(spark, sf):
    """The same counts from a stream that is read to its end."""
    folder = scratch_path(spark, "log")
    view(spark, sf, "fx_log").withColumn("created_at", F.col("created_at").cast("timestamp")).write.parquet(folder)
    schema = "id bigint, event_type string, status string, details string, created_at timestamp"
    counts = streams.event_counts(spark.readStream.schema(schema).parquet(folder), delay="60 days")
    root = scratch_path(spark, "counts")
    streams.write_event_counts(counts, root, scratch_path(spark, "stream")).awaitTermination()
    return streams.read_event_counts(spark, root).withColumn("window_start", F.unix_seconds("window_start"))
