import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import sequential
from cuadre.functions import similarity
from cuadre.functions.text import normalize_name
from cuadre.operators import cluster, fuzzy
from cuadre.session import cut

WORDS = "gold bag red widget foods sas s a brand12 brand1 economy small 1kg 500 bolt ring".split()


def random_names(rng, n, words=5):
    word = lambda: rng.choice(WORDS) if rng.random() < 0.8 else "".join(rng.choice("abcde1") for _ in range(rng.randint(1, 6)))
    return [" ".join(word() for _ in range(rng.randint(1, words))) for _ in range(n)]


@pytest.mark.parametrize("words, n", [(5, 800), (25, 60)])  # names within and beyond one machine word
def test_parts_equal_sequential(words, n):
    rng = random.Random(words)
    a, b = random_names(rng, n, words), random_names(rng, n, words)
    got = similarity._by_width(pd.Series(a), pd.Series(b), None)
    for i in range(n):
        assert tuple(got[p][i] for p in similarity._PARTS) == sequential.parts(a[i], b[i]), (a[i], b[i])


def test_golden_parts(column):
    rows = [("abc", "abd"), ("gold bag", "bag gold"), ("gold bag", "gold bag 1kg"), ("Café", "CAF"), ("x", None), ("--", "??")]
    got = column(lambda d: similarity.similarity_parts(d.a, d.b), rows, "a string, b string")
    assert got[0].ratio == 67
    assert (got[1].token_sort, got[1].token_set) == (100, 100)
    assert got[2].token_set == 100
    assert got[3].score == 100.0
    assert got[4] is None or got[4].score is None


def test_symmetric():
    rng = random.Random(3)
    a, b = random_names(rng, 500), random_names(rng, 500)
    one = similarity._by_width(pd.Series(a), pd.Series(b), None)["score"]
    two = similarity._by_width(pd.Series(b), pd.Series(a), None)["score"]
    assert (one == two).all() and (one >= 0).all() and (one <= 100).all()


def names_frame(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("norm", normalize_name(F.col("name")))
    return fuzzy.distinct_names(df)


def test_bounds_never_below_score(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "CHUNK_ROWS", 20)
    rng = random.Random(5)
    names = names_frame(spark, random_names(rng, 120) + random_names(rng, 20, 25) + ["aaaaaaaaaaaaaaaaaaaa", "zzzzzzzzzz", "1"])
    placed, cells = fuzzy._with_cells(names, F.broadcast)
    rows = (
        names.alias("l").join(placed.alias("r"), F.col("l.norm") <= F.col("r.norm"))
        .join(cells.alias("c"), (F.col("c.cell_len") == F.col("r.cell_len")) & (F.col("c.cell_digits") == F.col("r.cell_digits")))
        .select(F.col("l.norm").alias("a"), F.col("r.norm").alias("b"), similarity.score_bound("l", "r").alias("bound"),
                similarity.cell_bound("l", "c").alias("cell"))
        .toPandas()
    )
    score = similarity._by_width(rows["a"], rows["b"], None)["score"]
    assert (rows["bound"] >= score).all() and (rows["cell"] >= score).all()


@pytest.mark.parametrize("threshold, k", [(70, 5), (80, 1), (90, 1)])
def test_top_matches_equal_all_pairs(spark, monkeypatch, threshold, k):
    monkeypatch.setattr(fuzzy, "CHUNK_ROWS", 7)  # several chunks and salts even here
    monkeypatch.setattr(fuzzy, "SALT_ROWS", 11)
    rng = random.Random(threshold)
    queries, pool = random_names(rng, 60), random_names(rng, 150)
    found = fuzzy.top_matches(names_frame(spark, queries), names_frame(spark, pool), threshold, k).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["match"], r["score"]))
    for q in {sequential.norm(x) for x in queries}:
        scored = [(-sequential.score(q, p), p) for p in {sequential.norm(x) for x in pool}]
        best = sorted(s for s in scored if -s[0] >= threshold)[:k]
        assert got.get(q, []) == [(p, -s) for s, p in best]


def test_scoped_matches_stay_in_scope(spark):
    rows = [("v1", "gold bag"), ("v1", "gold bags"), ("v2", "gold bag"), ("v2", "red ring")]
    df = spark.createDataFrame(rows, "vendor string, norm string")
    names = fuzzy.distinct_names(df, "vendor")
    got = fuzzy.top_matches(names, names, 70, 3, scoped=True, include_self=False).collect()
    assert {(r["scope"], r["query"], r["match"]) for r in got} == {("v1", "gold bag", "gold bags"), ("v1", "gold bags", "gold bag")}


@pytest.mark.parametrize("broadcast", [0, 100])
def test_scoped_matches_equal_all_pairs(spark, monkeypatch, broadcast):
    """Scopes of one and of many chunks, scopes that only one side has, and null scopes; few scopes or many."""
    monkeypatch.setattr(fuzzy, "MAX_BROADCAST", broadcast)
    monkeypatch.setattr(fuzzy, "CHUNK_ROWS", 7)
    rng = random.Random(3)
    queries = [("a", n) for n in random_names(rng, 20)] + [("b", n) for n in random_names(rng, 4)] + [("x", "gold bag"), (None, "gold bag")]
    pool = [("a", n) for n in random_names(rng, 60)] + [("b", n) for n in random_names(rng, 6)] + [("y", "gold bag"), (None, "gold bag")]
    frame = lambda rows: fuzzy.distinct_names(spark.createDataFrame(rows, "vendor string, name string").withColumn("norm", normalize_name(F.col("name"))), "vendor")
    found = fuzzy.top_matches(frame(queries), frame(pool), 70, 3, scoped=True, include_self=False).collect()
    expected = set()
    for scope in "ab":
        texts = {sequential.norm(p) for s, p in pool if s == scope}
        for q in {sequential.norm(q) for s, q in queries if s == scope}:
            best = sorted((-sequential.score(q, p), p) for p in texts if p != q)
            expected |= {(scope, q, p, -s, i) for i, (s, p) in enumerate(best[:3], 1) if -s >= 70}
    assert {(r["scope"], r["query"], r["match"], r["score"], r["rank"]) for r in found} == expected and len(found) == len(expected)


def test_scoped_names_are_moved_once(spark):
    """Names meet the tables of scopes and cells where they are, and each other by one shuffle of either side."""
    rows = [(f"v{i % 3}", n) for i, n in enumerate(random_names(random.Random(2), 60))]
    names = cut(fuzzy.distinct_names(spark.createDataFrame(rows, "vendor string, norm string"), "vendor"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fuzzy.similar_pairs(names, names, 70, scoped=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2


def test_no_cross_join_in_plan(spark):
    names = cut(names_frame(spark, random_names(random.Random(1), 50)))
    plan = fuzzy.similar_pairs(names, names, 80)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("first, smallest, pairs", [(8192, 1024, 1_000_000), (16, 4, 10)])
def test_first_fit_equals_sequential(spark, monkeypatch, first, smallest, pairs):
    monkeypatch.setattr(cluster, "FIRST_BATCH", first)
    monkeypatch.setattr(cluster, "SMALLEST_BATCH", smallest)
    monkeypatch.setattr(cluster, "MAX_PAIRS", pairs)
    rng = random.Random(9)
    names = random_names(rng, 70) + ["Gold Bag", "GOLD BAG!", "---", "???"]
    rows = [(f"{i:03}", n) for i, n in enumerate(names)]
    got = cluster.first_fit(spark.createDataFrame(rows, "id string, name string"), 85).collect()
    assert {r["id"]: r["leader_id"] for r in got} == sequential.first_fit(rows, 85)


def test_first_fit_is_not_connected_components(spark):
    # a~b and b~c but not a~c
    a, b, c = "abcdefgh", "abcdefghij klm", "efghij klm nop"
    names = sorted([a, b, c])
    t = min(sequential.score(a, b), sequential.score(b, c))
    assert sequential.score(a, c) < t
    rows = [(str(i), n) for i, n in enumerate(names)]
    got = cluster.first_fit(spark.createDataFrame(rows, "id string, name string"), t).collect()
    assert {r["name"]: names[int(r["leader_id"])] for r in got} == {a: a, b: a, c: c}
