"""Pages by seeking against sorting the whole list; removals against a recursive walk."""

import random

import pytest
from pyspark.sql import functions as F

from cuadre.operators import cascade, paging
from cuadre.operators.cascade import ForeignKey


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # one date holds a third of the rows, some have none
    dates = [None if i % 17 == 0 else 77 if i % 3 == 0 else rng.randrange(400) for i in range(3000)]
    return spark.createDataFrame([(f"i{i:05d}", d) for i, d in enumerate(dates)], "id string, day int").cache()


@pytest.mark.parametrize("order", ["desc", "asc"])
def test_pages(rows, monkeypatch, order):
    monkeypatch.setattr(paging, "RANGES", 8)
    key = F.col("day").desc() if order == "desc" else F.col("day").asc()
    whole = [r["id"] for r in rows.orderBy(key, "id").collect()]
    for page, size in ((1, 20), (2, 20), (75, 20), (150, 20), (151, 20), (30, 100), (3001, 1), (3000, 1)):
        found, offset = paging.page_range(rows, (page - 1) * size, size, "day", order == "desc", small=150)
        assert [r["id"] for r in found.offset(offset).limit(size).collect()] == whole[(page - 1) * size : page * size]
        assert found.count() <= 150 + size
    assert [r["id"] for r in paging.seek_page(rows, 7, 30, "day", order).collect()] == whole[180:210]


def test_pages_of_rows_alike_and_none(spark):
    alike = spark.createDataFrame([("x", 1)] * 300, "id string, day int")
    found, offset = paging.page_range(alike, 200, 10, "day", True, small=50)
    assert found.offset(offset).limit(10).count() == 10
    assert paging.seek_page(alike.limit(0), 1, 10, "day").count() == 0


def test_rows_of_a_page_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(paging, "RANGES", 4)
    monkeypatch.setattr(paging.page_range, "__defaults__", ("id", 50))
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = spark.range(1000).selectExpr("concat('i', id) AS id", "CAST(id % 97 AS INT) AS day").mapInPandas(count, "id string, day int")
    assert paging.seek_page(rows, 20, 10, "day", "asc").count() == 10
    assert made.value == 1000


def plain(tables, keys, removed):
    gone = {t: set(ids) for t, ids in removed.items()}
    while True:
        more = {(k.child, r["id"]) for k in keys if k.action == "cascade" for r in tables[k.child] if r[k.column] in gone.get(k.parent, ())}
        more = {(t, i) for t, i in more if i not in gone.get(t, ())}
        if not more:
            return gone
        for t, i in more:
            gone.setdefault(t, set()).add(i)


def test_removal_over_cycles_and_chains(spark):
    rng = random.Random(8)
    keys = (ForeignKey("a", "b_id", "b"), ForeignKey("b", "a_id", "a"), ForeignKey("a", "boss", "a"), ForeignKey("c", "a_id", "a", "set null"), ForeignKey("d", "b_id", "b", "restrict"))
    pick = lambda: rng.choice([None, *range(40)])
    data = {
        "a": [{"id": i, "b_id": pick() if i % 4 else None, "boss": i - 1 if i % 9 else None} for i in range(40)],
        "b": [{"id": i, "a_id": pick() if i % 5 == 0 else None} for i in range(40)],
        "c": [{"id": i, "a_id": pick()} for i in range(40)], "d": [{"id": i, "b_id": pick()} for i in range(40)],
    }
    tables = {t: spark.createDataFrame([tuple(r.values()) for r in d], ", ".join(f"{c} int" for c in d[0])) for t, d in data.items()}
    gone = plain(data, keys, {"a": {4, 21}})
    left, forbidding = cascade.remove(tables, keys, {"a": spark.createDataFrame([(4,), (21,)], "id int")})
    for t in data:
        assert {r["id"] for r in left[t].collect()} == {r["id"] for r in data[t]} - gone.get(t, set())
    assert {(r["id"], r["a_id"]) for r in left["c"].collect()} == {(r["id"], None if r["a_id"] in gone["a"] else r["a_id"]) for r in data["c"]}
    assert {r["id"] for r in forbidding["d.b_id"].collect()} == {r["id"] for r in data["d"] if r["b_id"] in gone.get("b", ())}
    assert len(gone["a"]) > 2 and left["c"].columns == ["id", "a_id"]


def test_invoice_keys(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    tables = {
        "vendors": ids("v1", "v2"), "products": ids("p1", "p2"), "stores": ids("s1"),
        "invoices": spark.createDataFrame([("i1", "v1", "s1"), ("i2", "v2", None)], "id string, vendor_id string, store_id string"),
        "invoice_items": spark.createDataFrame([("x1", "i1", "p1"), ("x2", "i2", None)], "id string, invoice_id string, product_id string"),
        "product_mappings": spark.createDataFrame([("m1", "p1", "v1"), ("m2", "p2", "v2")], "id string, product_id string, vendor_id string"),
        "processing_log": spark.createDataFrame([("l1", "i1"), ("l2", None)], "id string, invoice_id string"),
    }
    left, forbidding = cascade.remove(tables, cascade.INVOICE_KEYS, {"invoices": ids("i1")})
    kept = lambda t: {r["id"] for r in left[t].collect()}
    assert kept("invoice_items") == {"x2"} and kept("processing_log") == {"l2"} and kept("product_mappings") == {"m1", "m2"}
    assert all(df.isEmpty() for df in forbidding.values())
    left, forbidding = cascade.remove(tables, cascade.INVOICE_KEYS, {"vendors": ids("v1")})
    assert kept("product_mappings") == {"m2"} and [r["id"] for r in forbidding["invoices.vendor_id"].collect()] == ["i1"]
