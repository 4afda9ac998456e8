from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from cuadre.operators import audits, joins, reports
from cuadre.sources import sinks


def test_price_alert_and_fan_out(spark):
    fact = spark.createDataFrame(
        [("D", "1", 10.0), ("D", "2", 11.0), ("D", "3", 11.0), ("D", None, 11.0)], "distributor string, item_code string, price_per_case double")
    agreed = spark.createDataFrame([("D", "1", 10.0), ("D", "2", 10.0), ("D", "2", 12.0), ("D", "3", None)],
                                   "distributor string, item_code string, agreed_price double")
    got = sorted((r.item_code or "", r.agreed_price or 0, r.alert) for r in reports.price_alerts(fact, agreed).collect())
    assert got == [("", 0, ""), ("1", 10.0, ""), ("2", 10.0, reports.HIGH_PRICE), ("2", 12.0, ""), ("3", 0, "")]
    deduped = reports.price_alerts(fact, agreed, dedupe=True)
    assert deduped.count() == 4
    assert reports.alert_count(deduped).first().alerts == 1


def tables(spark):
    vendors = spark.createDataFrame([("v", "Vendor", "1")], "id string, name string, nit string")
    stores = spark.createDataFrame([("s", "Store", "S1")], "id string, name string, code string")
    products = spark.createDataFrame([("p", "SKU-1")], "id string, master_sku string")
    invoices = spark.createDataFrame(
        [("i1", "N1", "v", "s", date(2024, 12, 30), Decimal("10.00"), Decimal("0.9250"), "processed"),
         ("i2", "N1", "v", None, date(2024, 1, 1), Decimal("5.00"), Decimal("0.5000"), "pending")],
        "id string, invoice_number string, vendor_id string, store_id string, invoice_date date, total decimal(15,2), "
        "confidence_score decimal(5,4), processing_status string")
    items = spark.createDataFrame(
        [("a", "i1", "p", "Bindi | 123", None, Decimal("2.000"), Decimal("4.00"), Decimal("8.00"), 1),
         ("b", "i1", None, "Coffee - Lavazza", "77", Decimal("1.000"), Decimal("2.00"), Decimal("2.00"), 2)],
        "id string, invoice_id string, product_id string, vendor_product_name string, vendor_sku string, quantity decimal(15,3), "
        "unit_price decimal(15,2), line_total decimal(15,2), line_number int")
    return vendors, stores, products, invoices, items


def test_fact_and_views(spark):
    vendors, stores, products, invoices, items = tables(spark)
    fact = reports.invoice_fact(reports.with_manufacturer(items), invoices, vendors, stores, products)
    rows = {r.item_id: r for r in fact.collect()}
    assert rows["a"].item_name == "Bindi | 123" and rows["a"].manufacturer == "Bindi" and rows["a"].item_code is None
    assert rows["b"].item_name == "Coffee" and rows["b"].master_sku == "" and rows["b"].confidence == "92%"
    assert (rows["a"].week, rows["a"].year, rows["a"].store) == (1, 2024, "Store")
    detailed = {r.id: r for r in reports.invoices_detailed(invoices, vendors, stores, items).collect()}
    assert detailed["i1"].items_count == 2 and detailed["i2"].items_count == 0 and detailed["i2"].store_name is None
    metrics = reports.report_metrics(fact).first()
    assert (metrics.total_items, metrics.total_amount, metrics.unique_invoices) == (2, Decimal("10.00"), 1)
    assert reports.row_search(fact, "lavAZZA").count() == 1
    options = [(r.filter, r.option) for r in reports.filter_options(fact).collect()]
    assert ("store", "Todos") in options and options.index(("store", "Todos")) < options.index(("store", "Store"))
    assert ("date_from", "2024-12-30") in options


def moved(df, column):
    """Shuffles of the plan that carry ``column``."""
    formatted = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = [b for b in formatted.split("\n\n") if ") Exchange" in b.split("\n")[0] and f"{column}#" in b.split("Input")[1].split("\n")[0]]
    return len(blocks)


def test_fact_moves_items_for_invoice_and_product_only(spark):
    vendors, stores, products, invoices, items = tables(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # the names are taken apart behind the joins; nothing wide meets vendors or stores
        fact = reports.invoice_fact(items, invoices, vendors, stores, products)
        assert moved(fact, "quantity") == 2 and moved(fact, "product_name_clean") == 0
        given = reports.invoice_fact(reports.with_manufacturer(items), invoices, vendors, stores, products)
        late = reports.invoice_fact(items, invoices, vendors, stores, products, to_filter=True)
        assert sorted(map(str, fact.collect())) == sorted(map(str, given.collect())) == sorted(map(str, late.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_alerts_of_rows_are_alerts_of_the_report(spark):
    given = tables(spark)
    vendors, stores, products, invoices, items = given
    agreed = spark.createDataFrame([("Vendor", "77", Decimal("1.00")), ("Vendor", "77", Decimal("3.00"))],
                                   "distributor string, item_code string, agreed_price decimal(15,2)")
    rows = reports.fact_rows(items, invoices, vendors, stores, products)
    assert len(rows.columns) < 18
    late = reports.fact_columns(reports.price_alerts(rows, agreed))
    whole = reports.price_alerts(reports.invoice_fact(items, invoices, vendors, stores, products), agreed)
    assert sorted(map(str, late.select(*whole.columns).collect())) == sorted(map(str, whole.collect())) and late.count() == 3


def test_lookup_apart_equals_a_left_join(spark):
    rows = spark.createDataFrame([(1, "p"), (2, None), (2, None), (3, "q"), (4, "zz")], "row int, key string")
    dim = spark.createDataFrame([("p", "one"), ("q", "two"), ("q", "three"), (None, "never")], "key string, name string")
    got = joins.lookup_apart(rows, dim, "key").select("row", "key", "name")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(dim, "key", "left").select("row", "key", "name").collect()))


def test_filter_options_sort_no_offers(spark):
    rows = [("A", "S", "ok", "2024-01-02"), ("B", None, "ok", "2024-01-01"), ("A", "S", None, None)]
    fact = spark.createDataFrame(rows, "distributor string, store string, status string, date string")
    got = [(r.filter, r.option) for r in reports.filter_options(fact).collect()]
    assert got == [("date_from", "2024-01-01"), ("date_to", "2024-01-02"), ("distributor", "Todos"), ("distributor", "A"), ("distributor", "B"),
                   ("status", "Todos"), ("status", "ok"), ("store", "Todos"), ("store", "S")]
    nothing = [(r.filter, r.option) for r in reports.filter_options(fact.select(*[F.lit(None).cast("string").alias(c) for c in fact.columns])).collect()]
    assert nothing == [("distributor", "Todos"), ("status", "Todos"), ("store", "Todos")]
    assert reports.filter_options(fact.limit(0)).count() == 0
    plan = reports.filter_options(fact)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.rindex("HashAggregate(keys=[filter")  # the rows meet a hash first


def test_nested_keeps_long_invoices_whole(spark):
    vendors, stores, _, invoices, items = tables(spark)
    rows = {r.id: r["items"] for r in reports.invoice_nested(invoices, items, vendors, stores).collect()}
    assert [i.line_number for i in rows["i1"]] == [1, 2] and rows["i2"] == []
    one = items.where("invoice_id = 'i1' AND line_number = 1")
    many = one.drop("line_number").withColumn("line_number", F.explode(F.sequence(F.lit(1), F.lit(10_001)))).select(*items.columns)
    whole = reports.invoice_nested(invoices, many, vendors, stores).where("id = 'i1'").collect()
    assert len(whole) == 1 and len(whole[0]["items"]) == 10_001


def test_page_and_filters(spark):
    vendors, *_, invoices, _ = tables(spark)
    page = reports.invoice_page(invoices, vendors, page=2, page_size=1, sort_by="invoice_date", sort_order="asc").collect()
    assert [(r.id, r.vendor_name) for r in page] == [("i1", "Vendor")]
    assert reports.page_info(invoices, 1, 20).first().pages == 1
    assert reports.invoice_filter(invoices, vendors, search="VEND").count() == 2
    assert reports.invoice_filter(invoices, vendors, search="n1", min_confidence=0.6).count() == 1
    assert reports.invoice_filter(invoices, date_to=date(2024, 1, 1)).count() == 1


def test_report_sheet_and_export(spark, tmp_path):
    vendors, stores, products, invoices, items = tables(spark)
    fact = reports.invoice_fact(reports.with_manufacturer(items), invoices, vendors, stores, products)
    agreed = spark.createDataFrame([("Vendor", "77", Decimal("1.00"))], "distributor string, item_code string, agreed_price decimal(15,2)")
    sheet = reports.report_sheet(reports.price_alerts(fact, agreed))
    assert sheet.columns[0] == "⚠️ Alerta" and sheet.columns.index("Precio Acordado") + 1 == sheet.columns.index("Precio por Case")
    sinks.write_report(sheet, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    files = list((tmp_path / "csv").glob("*/*.csv"))
    assert files and all(f.read_text().split("\n")[0].split(",") == sheet.columns for f in files)
    assert back.count() == 2 and back.where(F.col("`⚠️ Alerta`") == reports.HIGH_PRICE).count() == 1


def test_dashboard_with_log(spark):
    invoices = spark.createDataFrame(
        [("a", "processed", 10.0, "2024-05-15 10:00:00"), ("b", "processed", 5.0, "2024-05-13 10:00:00"),
         ("c", "processed", 1.0, "2024-05-02 10:00:00"), ("d", "pending", 9.0, "2024-05-15 10:00:00"),
         ("e", "processed", 9.0, "2024-05-16 10:00:00")], "id string, processing_status string, total double, created_at string"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    log = spark.createDataFrame([("a", "2024-05-15 10:00:00"), ("a", "2024-05-15 10:00:30"), ("b", "2024-05-15 10:00:00")],
                                "invoice_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    row = reports.dashboard_metrics(invoices, date(2024, 5, 15), log).first()
    assert (row.today_processed, row.week_processed, row.month_processed) == (1, 2, 3)
    assert (row.today_total_amount, row.month_total_amount, row.avg_processing_time_seconds) == (10.0, 16.0, 15.0)


def test_audits(spark):
    items = spark.createDataFrame([("a", Decimal(2), Decimal(10), Decimal("20.20")), ("b", Decimal(2), Decimal(10), Decimal("20.21")),
                                   ("c", Decimal(0), Decimal(-1), Decimal(0))],
                                  "id string, quantity decimal(15,3), unit_price decimal(15,2), line_total decimal(15,2)")
    assert {r.id: r.line_total_ok for r in audits.line_total_check(items).collect()}["a"]
    assert not {r.id: r.line_total_ok for r in audits.line_total_check(items).collect()}["b"]
    assert {r.id: r.range_errors for r in audits.item_range_checks(items).collect()}["c"] == ["quantity", "unit_price"]
    names = spark.createDataFrame([("", "123456789"), (None, "1"), ("x", "1" * 21)], "name string, nit string")
    limits = {k: audits.LENGTHS[k] for k in ("name", "nit")}
    assert [r.length_errors for r in audits.length_checks(names, limits).collect()] == [["name"], ["name", "nit"], ["nit"]]
    assert audits.duplicate_keys(names.unionByName(names), ["name", "nit"]).count() == 3
    parents = spark.createDataFrame([("p",)], "id string")
    children = spark.createDataFrame([("1", "p"), ("2", "q"), ("3", None)], "id string, parent string")
    assert [r.id for r in audits.orphans(children, parents, "parent").collect()] == ["2"]
    assert sorted(r.id for r in audits.cascade_delete(children, parents, "parent").collect()) == ["2", "3"]
