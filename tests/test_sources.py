from decimal import Decimal

import pytest

from cuadre.sources import catalog, files, prices

DATABASE = """Code,Item ,Group,Price per case ($),,Stores,Date,Week,Month,Week,Days
00256,  Tiramisu ,Cakes,$50.00,,A,1/1/26,1,Jan,1,Mon
00256,  Tiramisu ,Cakes,$51.00,,B,1/2/26,1,Jan,1,Tue
,,,,,C,1/3/26,1,Jan,1,Wed
,Loose,Cakes,,,,,,,,
"""
SHEET = """Items,Description ,Price ,Price Mark Up,Units,Price
0242,"Croissant, 
butter",#ERROR!,,10,$5
0243,nan,1,,10,$5
"""


def test_catalogs(spark, tmp_path):
    for name, body in (("Bindi 2026 - Products Database.csv", DATABASE), ("other BRIDOR - Product Sheet.csv", SHEET),
                       ("x - notes.csv", "a,b\n1,2\n")):
        (tmp_path / name).write_text(body)
    path = str(tmp_path)
    groups = [(path, "*Products Database*.csv"), (path, "*Product Sheet*.csv"), (path, "*notes*.csv")]
    raw = catalog.read_catalogs(spark, groups)
    assert raw.count() == 6
    got = {(r.vendor, r.code, r.name) for r in catalog.distinct_products(raw).collect()}
    assert got == {("Bindi", "00256", "Tiramisu"), ("Bindi", None, "Loose"), ("Bridor", "0242", "Croissant, \nbutter")}
    assert catalog.read_catalog(spark, path, "*notes*.csv") is None


def test_each_file_by_its_own_header(spark, tmp_path):
    for name, body in (("1.csv", "Code,Item ,Group\n1,Cake,g\n"), ("2.csv", "Price,Items,Description \n9,2,Pie\n"), ("3.csv", "foo,bar\n3,4\n")):
        (tmp_path / name).write_text(body)
    rows = catalog.read_catalogs(spark, [(str(tmp_path), "*.csv")]).collect()
    assert sorted((r.code, r.item) for r in rows) == [("1", "Cake"), ("2", "Pie")]


def test_layouts():
    assert catalog.detect_layout(["Code", "Item ", "Items"]) == ("Code", "Item ")
    assert catalog.detect_layout(["Items", "Description "]) == ("Items", "Description ")
    assert catalog.detect_layout(["Code", "Description"]) == ("Code", "Description")
    assert catalog.detect_layout(["CODE", "code ", "item"]) == ("code ", "item")
    assert catalog.detect_layout(["Price"]) is None


@pytest.mark.parametrize("name, vendor", [("Bindi x.csv", "Bindi"), ("a BRIDOR.csv", "Bridor"), ("bridor bindi.csv", "Bindi"), ("z.csv", "Unknown")])
def test_vendor_tag(column, name, vendor):
    assert column(lambda d: catalog.vendor_tag(d.a), [name]) == [vendor]


def test_agreed_prices(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Razón Social,Código Item,Precio\nA,1223,60.00\nA,02904,30\nB,N/A,2400\nB,7,x\n")
    got = [tuple(r) for r in prices.read_agreed_prices(spark, str(tmp_path / "p.csv")).collect()]
    assert got == [("A", "1223", Decimal("60.00")), ("A", "02904", Decimal("30.00")), ("B", None, Decimal("2400.00")), ("B", "7", None)]


def test_product_master(spark, tmp_path):
    (tmp_path / "m.csv").write_text("SKU,Product Name,Unit\n001,Cake,kg\n")
    assert tuple(catalog.read_product_master(spark, str(tmp_path / "m.csv")).first()) == ("001", "Cake", None, "kg")


def test_file_listing(spark, tmp_path):
    for folder, name in (("a", "x.PDF"), ("a", "y.png"), ("b", "z.jpeg"), ("b", "n.txt"), ("b", "w.Pdf"), ("b/sub", "v.pdf")):
        (tmp_path / folder).mkdir(exist_ok=True, parents=True)
        (tmp_path / folder / name).write_bytes(b"123")
    listed = files.list_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    rows = {r.name: r for r in listed.collect()}
    assert rows.keys() == {"x.PDF", "y.png", "z.jpeg", "w.Pdf"}, "any case, no subfolders"
    assert rows["x.PDF"].mime_type == "application/pdf" and rows["y.png"].mime_type == "image/png" and rows["y.png"].size == 3
    done = spark.createDataFrame([(rows["y.png"].id,), (None,)], "source_file_id string")
    assert {r.name for r in files.new_files(listed, done).collect()} == {"x.PDF", "z.jpeg", "w.Pdf"}
    times = [r.modified_at for r in listed.collect()]
    assert times == sorted(times, reverse=True)
