"""The function surface called from SQL text."""

from __future__ import annotations

from cuadre.functions import sql
from cuadre.plans.fixtures import extraction_json, view
from cuadre.plans.ingest_queries import RECORDS_SQL
from cuadre.plans.registry import query
from cuadre.plans.report_queries import MAKERS_SQL


@query("sql_normalize", r"""
SELECT id, trim(regexp_replace(regexp_replace(lower(vendor_product_name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS norm,
  upper(left(replace(replace(vendor_product_name, ' ', '_'), '-', '_'), 10)) AS code FROM fx_items""")
def sql_normalize(spark, sf):
    sql.register(spark)
    return spark.sql("SELECT id, cuadre_normalize_name(vendor_product_name) AS norm, cuadre_store_code_base(vendor_product_name) AS code FROM {items}",
                     items=view(spark, sf, "fx_items"))


@query("sql_manufacturer", f"""WITH {MAKERS_SQL}
SELECT i.id, manufacturer_name, product_name_clean, manufacturer_prefix
FROM fx_items i JOIN makers m ON i.vendor_product_name = m.vendor_product_name""")
def sql_manufacturer(spark, sf):
    sql.register(spark)
    return spark.sql("SELECT id, m.* FROM (SELECT id, cuadre_manufacturer(vendor_product_name) AS m FROM {items}) AS i", items=view(spark, sf, "fx_items"))


@query("sql_salvage", f"""WITH {RECORDS_SQL}
SELECT r.file_id, g.product_name, g.sku, CAST(g.kept_quantity AS DOUBLE) AS quantity, g.unit_price, g.line_total
FROM records r JOIN good_lines g ON r.invoice_id = g.invoice_id""")
def sql_salvage(spark, sf):
    sql.register(spark)
    return spark.sql("SELECT file_id, inline(items) FROM (SELECT file_id, cuadre_salvage_items(from_json(extraction, 'map<string,string>')['items']) AS items FROM {records}) r",
                     records=extraction_json(spark, sf))
