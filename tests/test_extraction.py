import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuadre.operators import extraction, load
from cuadre.session import work_dir

SAMPLE = {
    "vendor": {"name": "DISTRIBUIDORA ABC S.A.S", "nit": "900111111-1", "address": "Calle 10", "phone": None},
    "store": {"name": "Tienda Centro", "address": None},
    "invoice_number": "FAC-1", "invoice_date": "2026-05-08", "due_date": None,
    "items": [
        {"product_name": "Coca Cola 1.5L", "sku": None, "quantity": 24, "unit_price": 2500, "line_total": 60000},
        {"product_name": "Pepsi 1.5L", "sku": None, "quantity": 12, "unit_price": 2300, "line_total": 27600},
    ],
    "subtotal": 87600, "tax": 16644, "total": 104244, "confidence": 0.92,
}


def sample(**changes):
    record = {**SAMPLE, **changes}
    return {k: v for k, v in record.items() if v != "MISSING"}


@pytest.fixture()
def parse(spark):
    def run(*records):
        rows = [(f"f{i}", r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
        df = spark.createDataFrame(rows, "file_id string, extraction string")
        return extraction.parse_extractions(df)

    return run


def test_sample(parse):
    row = extraction.validate_records(extraction.invoice_warnings(parse(SAMPLE)), date(2026, 6, 1)).first()
    assert row.reject_reason is None and row.confidence == pytest.approx(0.828)
    assert row.warnings == ["Suma items != Total"]
    assert row.errors == ["Discrepancia en total"] and not row.is_valid
    assert (row.vendor.nit, row.store.name, row.invoice_date, row.due_date) == (
        "900111111-1", "Tienda Centro", date(2026, 5, 8), None)


def test_item_salvage(parse):
    item = {"product_name": "a", "unit_price": 1, "line_total": 2}
    items = [item, {**item, "quantity": None}, {**item, "quantity": "x"}, {**item, "quantity": "3"},
             {"quantity": 1, "unit_price": 1, "line_total": 1}, {**item, "product_name": None, "quantity": 1}]
    got = parse(sample(items=items)).first()["items"]
    assert [(i.product_name, i.quantity) for i in got] == [("a", 0.0), ("a", 3.0), ("", 1.0)]


@pytest.mark.parametrize("record, reason", [
    ("not json", "malformed"),
    (sample(vendor=None), "vendor_null"),
    (sample(vendor={"name": None, "nit": "1"}), "vendor_null"),
    (sample(vendor="MISSING"), None),
    (sample(store=None), "store_null"),
    (sample(store="MISSING"), None),
    (sample(items=[]), "no_items"),
    (sample(items="MISSING"), "no_items"),
    (sample(items=None), "no_items"),
    (sample(invoice_date="soon"), "invoice_date_invalid"),
    (sample(invoice_date="2026-02-30"), "invoice_date_invalid"),
    (sample(invoice_date=None), "invoice_date_missing"),
    (sample(invoice_date="MISSING"), "invoice_date_missing"),
    (sample(invoice_date="20260508"), None),
    (sample(due_date="x"), "due_date_invalid"),
    (sample(total=0), "total_invalid"),
    (sample(total=None), "total_invalid"),
    (sample(total="MISSING"), "total_invalid"),
    (sample(invoice_number=None), "invoice_number_null"),
    (sample(invoice_number="MISSING"), None),
    (sample(tax="abc"), "amount_invalid"),
    (sample(confidence=None), "confidence_invalid"),
    (sample(confidence=1.5), "confidence_invalid"),
    (sample(confidence="MISSING"), None),
])
def test_reject(parse, record, reason):
    assert parse(record).first()["reject_reason"] == reason


def test_confidence(parse):
    exact = {"total": 87600}
    got = [r["confidence"] for r in parse(
        sample(**exact), sample(**exact, confidence="MISSING"), sample(**exact, vendor={"nit": "1"}), sample(vendor="MISSING"),
    ).orderBy("file_id").collect()]
    assert got == pytest.approx([0.92, 0.8, 0.92 * 0.9, 0.92 * 0.81])


@pytest.fixture()
def tables(spark):
    vendors = spark.createDataFrame([("v1", "800000000-1")], "id string, nit string")
    stores = spark.createDataFrame([(2, "Gran TIENDA centro 2"), (1, "Tienda Centro"), (3, "Otra")], "id bigint, name string")
    invoices = spark.createDataFrame([("v1", "OLD-1")], "vendor_id string, invoice_number string")
    return vendors, stores, invoices


def test_ingest(spark, tables):
    old = {"name": "Vieja", "nit": "800000000-1"}
    records = [SAMPLE, SAMPLE, sample(items=SAMPLE["items"][:1]), sample(vendor=old, invoice_number="OLD-1"),
               sample(vendor=old, invoice_number="NEW-1", subtotal=0, store={"name": "100%"}), sample(total=0)]
    batch = spark.createDataFrame([(f"f{i}", json.dumps(r)) for i, r in enumerate(records)], "file_id string, extraction string")
    out = load.ingest(batch, *tables)
    status = {r.file_id: r.status for r in out.status.collect()}
    assert status == {"f0": "processed", "f1": "duplicate", "f2": "duplicate", "f3": "duplicate", "f4": "processed", "f5": "rejected"}
    assert [r.nit for r in out.vendors.collect()] == ["900111111-1"]
    headers = {r.source_file_id: r for r in out.invoices.collect()}
    assert headers.keys() == {"f0", "f4"}
    assert (headers["f0"].store_id, headers["f4"].store_id) == (1, None)
    assert headers["f4"].vendor_id == "v1" and headers["f4"].subtotal is None and headers["f4"].tax == 16644
    assert json.loads(headers["f0"].structured_data)["store"] == {"name": "Tienda Centro", "address": None}
    items = sorted((r.invoice_id, r.line_number, r.vendor_product_name) for r in out.items.collect())
    assert len(items) == 4
    # loaded again, nothing is added
    again = load.ingest(batch, tables[0].unionByName(out.vendors.select("id", "nit")), tables[1],
                        tables[2].unionByName(out.invoices.select("vendor_id", "invoice_number")))
    assert again.vendors.count() == again.invoices.count() == again.items.count() == 0


def test_null_and_equal_file_ids(spark, tables):
    """Records without a file id load each; of equal ids one does; ties are total."""
    a, b, c = sample(invoice_number="A"), sample(invoice_number="B"), sample(invoice_number="C")
    rows = [(None, a), (None, b), ("f", c), ("f", c), ("f", sample(invoice_number="C", total=SAMPLE["total"]))]
    batch = spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "file_id string, extraction string")
    makers = spark.createDataFrame([("m1", "Bindi")], "id string, name string")
    out = load.ingest(batch, *tables, makers)
    assert sorted(r.invoice_number for r in out.invoices.collect()) == ["A", "B", "C"]
    assert len({r.id for r in out.invoices.collect()}) == 3 and out.items.count() == 3 * len(out.items.where(F.col("invoice_id") == out.invoices.first().id).collect())
    assert sorted((str(r.file_id), r.status) for r in out.status.collect()) == [("None", "processed")] * 2 + [("f", "duplicate")] * 2 + [("f", "processed")]
    assert "manufacturer_id" in out.items.columns and "Bindi" not in {r.name for r in out.manufacturers.collect()}


def test_text_guard_and_source_columns(spark, tables):
    rows = [("a", json.dumps(sample(invoice_number="A")), "x" * 500, "/in/a.pdf"), ("b", json.dumps(sample(invoice_number="B")), "x", "/in/b.pdf"), ("c", json.dumps(sample(invoice_number="C")), None, None)]
    batch = spark.createDataFrame(rows, "file_id string, extraction string, raw_ocr_text string, source_file_path string")
    out = load.ingest(batch, *tables)
    assert [(r.source_file_path, len(r.raw_ocr_text)) for r in out.invoices.collect()] == [("/in/a.pdf", 500)]
    assert {r.file_id: r.reject_reason for r in out.status.collect()} == {"a": None, "b": "text_too_short", "c": "text_too_short"}


def test_the_texts_are_not_kept(spark, tables):
    """A load keeps on disk what its results need; the extraction texts it was parsed from are not part of that."""
    kept = Path(work_dir(spark))
    size = lambda: sum(f.stat().st_size for f in kept.rglob("*") if f.is_file())
    batch = spark.range(200).select(
        F.concat(F.lit("f"), "id").alias("file_id"),
        F.concat(F.lit('{"note":"'), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.sha2(F.concat("id", F.lit("/"), i), 512)), ""),
                 F.lit('",' + json.dumps(sample(invoice_number="N-"))[1:]), ).alias("extraction"))
    batch = batch.withColumn("extraction", F.regexp_replace("extraction", '"N-"', F.concat(F.lit('"N-'), "file_id", F.lit('"')))).cache()
    batch.count()
    before = size()
    out = load.ingest(batch, *tables)
    assert out.invoices.count() == 200 and out.status.where("status = 'processed'").count() == 200
    assert size() - before < 200 * 12800 / 4


def test_vendors_that_share_a_tax_number(spark, tables):
    """Known vendors of one tax number each get the invoice; one without an id keeps none; a vendor that is not known is made."""
    vendors = spark.createDataFrame([("v1", "1"), ("v2", "1"), (None, "2")], "id string, nit string")
    rows = [(f, json.dumps(sample(invoice_number=n, vendor={"name": f, "nit": t}))) for f, n, t in (("a", "A", "1"), ("b", "B", "2"), ("c", "C", "3"), ("d", "C", "3"))]
    out = load.ingest(spark.createDataFrame(rows, "file_id string, extraction string"), vendors, *tables[1:])
    made = [(r.nit, r.name, r.id) for r in out.vendors.collect()]
    assert [m[:2] for m in made] == [("3", "c")]
    assert sorted((r.source_file_id, str(r.vendor_id)) for r in out.invoices.collect()) == [("a", "v1"), ("a", "v2"), ("b", "None"), ("c", made[0][2])]
    assert sorted(r.status for r in out.status.where("file_id <> 'd'").collect()) == ["processed"] * 4


def test_arrival_decides(spark, tables):
    rows = [("a", "2024-01-02", sample(total=2.0)), ("b", "2024-01-01", sample(total=1.0)), ("0", None, sample(total=3.0))]
    batch = spark.createDataFrame([(i, t, json.dumps(r)) for i, t, r in rows], "file_id string, received_at string, extraction string").withColumn("received_at", F.col("received_at").cast("timestamp"))
    assert [r.source_file_id for r in load.ingest(batch, *tables).invoices.collect()] == ["b"]


def test_vendor_get_or_create(spark):
    vendors = spark.createDataFrame([("v1", "A", "1")], "id string, name string, nit string")
    batch = spark.createDataFrame([("A new", "1", 1), ("B late", "2", 3), ("B", "2", 2)], "name string, nit string, seen int")
    once = load.get_or_create_vendors(vendors, batch, F.col("seen"))
    assert {(r.name, r.nit) for r in once.collect()} == {("A", "1"), ("B", "2")}
    twice = load.get_or_create_vendors(once, batch, F.col("seen"))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_manufacturers(spark):
    dim = spark.createDataFrame([("m1", "Bindi")], "id string, name string")
    items = spark.createDataFrame([(1, "Bindi"), (2, "Bridor"), (3, None), (4, "Bridor")], "id int, manufacturer_name string")
    after, mapped = load.get_or_create_manufacturers(dim, items)
    assert {r.name for r in after.collect()} == {"Bindi", "Bridor"}
    ids = {r.id: r.manufacturer_id for r in mapped.collect()}
    assert ids[1] == "m1" and ids[2] == ids[4] and ids[3] is None


def test_manufacturers_of_one_name_are_spread_and_items_read_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    # one name and null in nearly all rows; a known name that comes twice, once without id
    dim = spark.createDataFrame([("m1", "Bindi"), ("m2", "Twice"), (None, "Twice"), ("m3", None)], "id string, name string")
    names = "CASE WHEN id = 7 THEN 'Twice' WHEN id % 3 = 0 THEN 'Bindi' WHEN id % 3 = 1 THEN 'New' END"
    items = spark.range(3000).selectExpr("id", f"{names} AS manufacturer_name").mapInPandas(count, "id long, manufacturer_name string")
    _, mapped = load.get_or_create_manufacturers(dim, items)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = mapped.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert made.value == 3000 and len(rows) == 3001
    by_name = {n: {r.manufacturer_id for r in rows if r.manufacturer_name == n} for n in ("Bindi", "New", "Twice", None)}
    assert by_name["Bindi"] == {"m1"} and by_name["Twice"] == {"m2", None} and by_name[None] == {None}
    assert len(by_name["New"]) == 1 and len(next(iter(by_name["New"]))) == 64
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < 900


def test_product_upsert(spark):
    products = spark.createDataFrame([("p1", "Old", "S1", "c", "u"), ("p2", "Same", "S2", "c", "u")],
                                     "id string, master_name string, master_sku string, category string, unit string")
    batch = spark.createDataFrame([("S1", "First", "c", None, 1), ("S1", "Last", "c", None, 2), ("S3", "New", None, "kg", 1)],
                                  "master_sku string, master_name string, category string, unit string, seen int")
    got = {r.master_sku: r for r in load.upsert_products(products, batch, F.col("seen"), date(2024, 1, 1)).collect()}
    assert (got["S1"].id, got["S1"].master_name, got["S1"].unit) == ("p1", "Last", None)
    assert got["S2"].updated_at is None and got["S1"].updated_at is not None
    assert got["S3"].master_name == "New" and got.keys() == {"S1", "S2", "S3"}


def test_corrections(spark):
    invoices = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "id string, total double, note string")
    asked = spark.createDataFrame([("a", True, "ana", 5.0, 1), ("a", True, "bo", None, 2)],
                                  "invoice_id string, validated boolean, validated_by string, total double, seen int")
    got = {r.id: r for r in load.apply_corrections(invoices, asked, ["total"], F.col("seen")).collect()}
    assert (got["a"].total, got["a"].validated, got["a"].validated_by) == (1.0, True, "bo")
    assert (got["b"].total, got["b"].validated, got["b"].validated_by) == (2.0, False, None)


ODD = [
    '{"vendor":{"name":"x","nit":"1"},"total":1,"total":2,"items":[{"product_name":"a"}]}', '[{"total":3,"vendor":{"name":"x"}}]',
    '{"items":[1,{"a":2}],"total":5}', '{"vendor":"{\\"name\\":\\"q\\"}","items":[null,{"quantity":"nan","line_total":1e2}],"total":NaN}',
    '{"total":1} x', '{"total":1', '  {"total":1,"store":{}}', "{}", "[]", "null", "", '{"vendor":null}', '{"vendor":{"name":null,"nit":"3"},"store":[1]}',
    '{"store":"x","items":"[{\\"product_name\\":\\"k\\"}]","vendor":{"name":"n","nit":"5","name":"m"},"confidence":null,"invoice_number":null}',
    '{"items":[{"quantity":1,"quantity":2}],"total":0.10000000000000000001,"invoice_number":1e5,"Vendor":{"name":"c"}}',
]


def test_one_pass_reads_as_a_map_of_texts(parse):
    """Each part read from its text in a map of the whole record, as the values are defined."""
    def text(record, column):
        return F.try_element_at(F.from_json(record, extraction.TEXT_MAP), F.lit(column))

    rows = parse(*ODD).select(
        "*", F.from_json("extraction", extraction.TEXT_MAP).alias("_all"),
        F.from_json(text("extraction", "vendor"), extraction.TEXT_MAP).alias("_v"),
        F.coalesce(F.size(F.filter(F.from_json(text("extraction", "items"), extraction.TEXT_MAPS), lambda i: F.lit(True))), F.lit(0)).alias("_n")).collect()
    for row in rows:
        whole = row["_all"] or {}
        vendor = row["_v"] or {}
        assert (row.reject_reason == "malformed") == (not whole), row.extraction
        assert row.items_found == max(row["_n"], 0), row.extraction
        assert row.vendor.nit == (vendor["nit"] if "nit" in vendor else ""), row.extraction
        assert row.invoice_number == (whole["invoice_number"] if "invoice_number" in whole else ""), row.extraction
    assert [rows[0].total, rows[1].reject_reason, rows[3].vendor.name] == [1.0, "malformed", "q"]


def test_a_record_is_read_in_one_pass(parse):
    """Vendor, store and items come from one typed read; texts read once more are those that need it."""
    plan = parse(SAMPLE)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json(StructField(invoice_number,StringType,true)" in plan and "StructField(items,ArrayType(MapType" in plan
