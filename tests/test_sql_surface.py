"""The SQL functions against the column functions, on odd values."""

import json

import pytest
from pyspark.sql import functions as F

from cuadre.functions import manufacturer, sql, text
from cuadre.operators import extraction

NAMES = [None, "", "  ", "Coca-Cola  1.5 L", "ñandú Ábc\u00a0x", "a|Kraft Foods 3", "x | Kraft | y", "|", "Tea (Lipton)", "Tea (Lipton Ice) ",
         "Beans - Goya", "Beans - Frozen", "Beans - Goya Foods Inc Usa", "Kraft", "a_b%c", "\x1cT\x1f", "it's \\ here"]


@pytest.fixture()
def session(spark):
    sql.register(spark)
    sql.register(spark)  # again, without harm
    return spark


def test_scalars(session):
    df = session.createDataFrame([(n,) for n in NAMES + ["900111111-1", "x.PDF", "dir.a/x", "a/b.jpeg", "long enough text"]], "name string")
    name = F.col("name")
    pairs = {
        "cuadre_strip(name)": text.strip(name), "cuadre_normalize_name(name)": text.normalize_name(name),
        "cuadre_effective_name(name, 'raw')": text.effective_name(name, F.lit("raw")), "cuadre_nit_valid(name)": text.nit_valid(name),
        "cuadre_text_guard(name)": text.text_guard(name), "cuadre_store_code_base(name)": text.store_code_base(name),
        "cuadre_file_extension(name)": text.file_extension(name), "cuadre_media_type(name)": text.media_type(name),
        "cuadre_file_accepted(name, 10485760)": text.file_accepted(name, F.lit(10485760)),
        "cuadre_confidence_pct(length(name) / 8)": text.confidence_pct(F.length(name) / 8),
        "cuadre_manufacturer(name)": manufacturer.extract_manufacturer(name),
    }
    rows = df.select(*[F.struct(F.expr(s).alias("sql"), c.alias("column")).alias(f"c{i}") for i, (s, c) in enumerate(pairs.items())]).collect()
    for i, call in enumerate(pairs):
        assert [r[i]["sql"] for r in rows] == [r[i]["column"] for r in rows], call


def test_salvage(session):
    item = {"product_name": "a", "unit_price": 1, "line_total": 2}
    lists = [[item, {**item, "quantity": None}, {**item, "quantity": "x"}, {**item, "quantity": " 3 "}], [], None, [None, {}], [{**item, "sku": "7", "quantity": "1e2"}]]
    rows = [(i, json.dumps({"items": x})) for i, x in enumerate(lists)] + [(9, "no json"), (10, None)]
    session.createDataFrame(rows, "id int, extraction string").createOrReplaceTempView("surface_records")
    got = session.sql("SELECT id, inline(items) FROM (SELECT id, cuadre_salvage_items(from_json(extraction, 'map<string,string>')['items']) AS items FROM surface_records) r")
    want = extraction.parse_extractions(session.table("surface_records"), columns=["items"]).select("id", F.inline("items"))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(want) and len(order(got)) == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
