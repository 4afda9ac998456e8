"""The sums of the invoices that are written out for Spark, against their statement."""

from datetime import datetime

from cuadre.plans import fixtures


def test_invoice_sums_equal_their_sql(spark):
    lineitem = spark.createDataFrame(
        [(1, 1, 5, 2.5), (1, 1, 6, 1.255), (1, 2, 5, None), (1, None, 5, 3.0), (None, 1, 5, 3.0), (2, 1, 99, 3.0), (3, 1, None, 3.0), (4, 1, 6, 3.0), (4, 1, 6, 3.0)],
        "l_orderkey long, l_suppkey long, l_partkey long, l_extendedprice double")
    part = spark.createDataFrame([(5,), (6,), (6,), (None,)], "p_partkey long")
    sql = fixtures._SUMS.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}")
    assert all(fixtures._SUMS in fixtures.VIEWS[v] for v in ("fx_invoices", "fx_heads"))
    plain = spark.sql(f"SELECT * FROM {sql}", lineitem=lineitem, part=part)
    sums = fixtures.invoice_sums(lineitem, part)
    assert sums.schema == plain.schema and sorted(map(str, sums.collect())) == sorted(map(str, plain.collect()))


def test_invoice_sums_meet_orders_without_another_shuffle(spark, tmp_path):
    tables = {
        "lineitem": "SELECT 1L AS l_orderkey, 1L AS l_suppkey, 5L AS l_partkey, 2.5D AS l_extendedprice",
        "part": "SELECT 5L AS p_partkey",
        "orders": "SELECT 1L AS o_orderkey, 3L AS o_custkey, TIMESTAMP '2024-01-01' AS o_orderdate, 'F' AS o_orderstatus"}
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        invoices = fixtures.view(spark, str(tmp_path), "fx_invoices")
        plan = invoices._jdf.queryExecution().executedPlan().toString()
        assert [r.id for r in invoices.collect()] == ["1-1"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 4  # lines and parts, lines by order, orders


def test_records_read_their_lines_once(spark, tmp_path):
    tables = {
        "lineitem": """SELECT 1L AS l_orderkey, 1L AS l_suppkey, n AS l_linenumber, 5L AS l_partkey, 2.0D AS l_quantity, n * 1.5D AS l_extendedprice,
            'x' AS l_shipdate, 0D AS l_discount, 0D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus FROM VALUES (2L), (1L), (1L) t(n)""",
        "part": "SELECT 5L AS p_partkey, 'bolt' AS p_name",
        "orders": "SELECT 1L AS o_orderkey, 3L AS o_custkey, '2024-01-01' AS o_orderdate, 'O' AS o_orderstatus",
        "supplier": "SELECT 1L AS s_suppkey, 'sup' AS s_name", "customer": "SELECT 3L AS c_custkey, 'cust' AS c_name, 7L AS c_nationkey",
        "nation": "SELECT 7L AS n_nationkey, 'land' AS n_name"}
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    records = fixtures.extraction_json(spark, str(tmp_path))
    rows = sorted(records.collect())
    assert [r.file_id for r in rows] == ["a-1-1", "b-1-1"] and rows[0].extraction == rows[1].extraction
    assert rows[0].extraction.count('"line_total":1.5') == 2 and '"line_total":3.0}],"subtotal":6.0' in rows[0].extraction
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [") == 6  # each table once


def _plain_lines(spark, lineitem, part):
    lineitem.createOrReplaceTempView("lines_lineitem")
    part.createOrReplaceTempView("lines_part")
    return spark.sql(fixtures.VIEWS["fx_lines"].replace("FROM lineitem", "FROM lines_lineitem").replace("JOIN part", "JOIN lines_part"))


def test_lines_by_order_equal_their_sql(spark):
    """Lines that come twice, lines without a part or an order, and parts that come twice, also with another name or none."""
    day = datetime(1996, 1, 2)
    line = lambda o, p, s, n, q=2.0: (o, p, s, n, q, 10.0 * (q or 1), 0.0, 0.1, "N", "O", day)
    rows = [line(1, 5, 7, 1), line(1, 5, 7, 1), line(1, 6, 7, 2), line(1, 99, 7, 3), line(1, 8, 7, 4), line(1, 9, 7, 5), line(2, 5, None, 1),
            line(None, 6, 7, 1), line(2, None, 8, 1), line(2, 10, 8, 2), line(2, 9, 8, 3, None), line(None, None, None, None)]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    part = spark.createDataFrame([(5, "five"), (6, "six"), (6, "six"), (8, None), (9, "nine"), (9, "ninth"), (10, "ten"), (None, "none")], "p_partkey long, p_name string")
    got, expected = fixtures.lines_by_order(lineitem, part), _plain_lines(spark, lineitem, part)
    assert got.columns == expected.columns
    rows_of = lambda df: sorted(map(repr, df.collect()))
    assert rows_of(got) == rows_of(expected) and len(rows_of(got)) == 13


def test_extraction_lines_are_moved_twice_only(spark):
    """For their parts and for their order; numbering, grouping by invoice and the heads need no other shuffle of them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.extraction_json(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("Exchange hashpartitioning(l_partkey") == 1
