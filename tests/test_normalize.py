import random

import sequential
from pyspark.sql import functions as F
from test_similarity import random_names

from cuadre.operators import cluster, normalize, stores


def test_similar_products_and_vendor_scope(spark):
    items = spark.createDataFrame([("Gold Bag 1kg", 1), ("Gold Bag 1kg", 2), ("GOLD-BAG 1kg", 1), ("Bolt", 1)],
                                  "vendor_product_name string, vendor_id int")
    asked = spark.createDataFrame([("gold bag 1kg",)], "name string")
    got = [(r.product_name, r.vendor_id) for r in normalize.similar_products(asked, items, k=2).orderBy("rank").collect()]
    assert got == [("Gold Bag 1kg", 1), ("Gold Bag 1kg", 2)]
    one = normalize.similar_products(asked, items, vendor_id=2).collect()
    assert [(r.product_name, r.vendor_id) for r in one] == [("Gold Bag 1kg", 2)]


def test_similar_products_equal_all_pairs(spark):
    rng = random.Random(4)
    sold = sorted({(n, rng.randint(1, 3)) for n in random_names(rng, 120)})
    asked = sorted(set(random_names(rng, 25)))
    got = normalize.similar_products(
        spark.createDataFrame([(n,) for n in asked], "name string"),
        spark.createDataFrame(sold, "vendor_product_name string, vendor_id int")).collect()
    found = {n: [] for n in asked}
    for r in sorted(got, key=lambda r: (r.name, r.rank)):
        found[r.name].append((r.product_name, r.vendor_id, r.similarity_score))
    for name in asked:
        scored = sorted((-sequential.score(name, n), n, v) for n, v in sold)
        assert found[name] == [(n, v, -s) for s, n, v in scored if -s >= 70][:5]


def test_similar_vendors_by_number(spark):
    vendors = spark.createDataFrame([(1, "Alpha Foods", "9-1"), (2, "Zeta", "9-2"), (3, "Alpha Food", "9-3")], "id int, name string, nit string")
    asked = spark.createDataFrame([("Alpha Foods", "9-2"), ("Alpha Foods", None)], "name string, nit string")
    rows = normalize.similar_vendors(asked, vendors, k=2).collect()
    by = lambda nit: [(r.vendor_id, r.similarity_score) for r in sorted(rows, key=lambda r: r["rank"]) if r.nit == nit]
    assert by("9-2") == [(1, 100.0), (2, 100.0)]
    assert [v for v, _ in by(None)] == [1, 3]


def mappings(spark):
    rows = [("m1", "a", None, "n1", "approved"), ("m2", "a", 7, "n2", "approved"), ("m3", "b", None, "n3", "pending")]
    return spark.createDataFrame(rows, "id string, variant_name string, vendor_id int, normalized_product_id string, status string")


def test_lookup_prefers_own_vendor(spark):
    normalized = spark.createDataFrame([(f"n{i}", f"N{i}", None, None) for i in (1, 2, 3)],
                                       "id string, normalized_name string, normalized_code string, category string")
    asked = spark.createDataFrame([("a", 7), ("a", 8), ("b", 7), ("c", 7)], "variant_name string, vendor_id int")
    got = {(r.variant_name, r.vendor_id): r.normalized_name for r in normalize.normalized_lookup(asked, mappings(spark), normalized).collect()}
    assert got == {("a", 7): "N2", ("a", 8): "N1"}


def test_suggestions(spark):
    items = spark.createDataFrame([("a", 1), ("gold bag", 1), ("gold bag", 1), ("gold bags", 1), ("gold bags", 2), ("x", 2)],
                                  "vendor_product_name string, vendor_id int")
    vendors = spark.createDataFrame([(1, "V1"), (2, "V2")], "id int, name string")
    got = normalize.normalization_suggestions(items, vendors, mappings(spark)).collect()
    assert {(r.variant_name, r.vendor_id, r.suggested_name, r.item_count) for r in got} == {
        ("gold bag", 1, "gold bags", 2), ("gold bags", 1, "gold bag", 1)}
    assert not any(r.auto_approve != (r.similarity_score >= 95) for r in got)
    own = normalize.normalization_suggestions(items, vendors, mappings(spark), include_self=True)
    assert own.where(F.col("rank") == 1).where(~F.col("auto_approve")).count() == 0
    nested = normalize.nested_suggestions(own).where("variant_name = 'gold bag'").first()
    assert [s.product_name for s in nested.suggestions] == ["gold bag", "gold bags"]


def test_catalog_map(spark):
    products = spark.createDataFrame([(1, "Gold Bag Large", "s1"), (2, "GOLD BAG LARGE", "s2"), (3, "Red Ring", "s3")],
                                     "id int, master_name string, master_sku string")
    items = spark.createDataFrame(
        [("a", None, "gold bag large", "x"), ("b", None, "", "Red Rings"), ("c", 9, None, "gold bag large"), ("d", None, None, "NULL"),
         ("e", None, None, "quite other")], "id string, product_id int, product_name_clean string, vendor_product_name string")
    got = {r.id: r.product_id for r in normalize.map_items_to_catalog(items, products).collect()}
    assert got == {"a": 1, "b": 3, "c": 9, "d": None, "e": None}
    scores = normalize.catalog_scores(items, products, keep_low=True)
    stats = normalize.mapping_stats(items, scores).first()
    assert (stats.mapped, stats.not_mapped, stats.low_score) == (2, 2, 1)


def test_map_by_sku(spark):
    products = spark.createDataFrame([(1, "Gold Bag"), (2, "Red Ring")], "id int, master_name string")
    skus = spark.createDataFrame([(7, "k1", 2)], "vendor_id int, vendor_sku string, product_id int")
    items = spark.createDataFrame([("a", 7, "k1", None, "Gold Bag"), ("b", 8, "k1", None, "Gold Bag"), ("c", 7, None, None, "zzz"), ("d", 7, None, 5, "q")],
                                  "id string, vendor_id int, vendor_sku string, product_id int, vendor_product_name string"
                                  ).withColumn("product_name_clean", F.lit(None).cast("string"))
    got = {r.id: (r.product_id, r.mapping_source) for r in normalize.map_by_sku(items, skus, products).collect()}
    assert got == {"a": (2, "sku"), "b": (1, "fuzzy"), "c": (None, "manual_review"), "d": (5, "given")}


def test_catalog_split(spark):
    listed = spark.createDataFrame([("1", "Gold Bag", "Bindi"), ("2", "Brand New Thing", "Bindi")], "code string, name string, vendor string")
    items = spark.createDataFrame([("gold  BAG",)], "vendor_product_name string")
    split = normalize.split_catalog(listed, items)
    assert {r.code: r.is_new for r in split.collect()} == {"1": False, "2": True}
    products, maps = normalize.catalog_entities(split)
    p, m = products.first(), maps.first()
    assert (p.category, p.description) == ("Bindi", "From Bindi catalog")
    assert (m.status, m.similarity_score, m.vendor_id, m.normalized_product_id) == ("approved", 100.0, None, p.id)
    stats = normalize.catalog_stats(split, listed.unionByName(listed.limit(1).withColumn("name", F.lit(None).cast("string")))).first()
    assert (stats.created, stats.mapped, stats.skipped) == (1, 0, 2)


def test_review_latest_wins(spark):
    decisions = spark.createDataFrame([("m3", "approved", "ana", 1), ("m3", "rejected", "bo", 2)],
                                      "mapping_id string, status string, reviewed_by string, reviewed_at int")
    got = {r.id: (r.status, r.reviewed_by) for r in normalize.review_mappings(mappings(spark), decisions).collect()}
    assert got == {"m1": ("approved", None), "m2": ("approved", None), "m3": ("rejected", "bo")}


def test_vendor_mappings(spark):
    vendors = spark.createDataFrame([("1", "Alpha Foods SAS", "n1"), ("2", "ALPHA FOODS S.A.S", "n2"), ("3", "Zeta", "n3"),
                                     ("4", "Alpha Foods S A S", None)], "id string, name string, nit string")
    groups = cluster.vendor_clusters(vendors)
    none = spark.createDataFrame([], "id string, normalized_name string")
    taken = spark.createDataFrame([("Alpha Foods SAS", "n1")], "variant_name string, variant_nit string")
    created, new = cluster.vendor_mappings(groups, none, taken)
    assert [(r.normalized_name, r.category) for r in created.collect()] == [("ALPHA FOODS S.A.S", "Auto-detected duplicate")]
    assert {(r.variant_name, r.variant_nit) for r in new.collect()} == {("ALPHA FOODS S.A.S", "n2"), ("Alpha Foods S A S", "UNKNOWN")}
    again, more = cluster.vendor_mappings(groups, created.select("id", "normalized_name"), taken.unionByName(new.select("variant_name", "variant_nit")))
    assert again.count() == more.count() == 0


def sequential_codes(names, taken):
    """Any order of the names gives the same set of codes per base."""
    used, bases = set(taken), {n[:10].upper().replace(" ", "_").replace("-", "_") for n in names}
    out = {}
    for base in sorted(bases):
        wanted = [n for n in names if n[:10].upper().replace(" ", "_").replace("-", "_") == base]
        codes, i = [], 0
        while len(codes) < len(wanted):
            code = base if i == 0 else f"{base}_{i}"
            if code not in used and (i == 0 or code not in bases):
                codes.append(code)
            i += 1
        out[base] = set(codes)
    return out


def test_store_codes(spark):
    names = ["Tienda Norte-2", "Tienda Norte-3", "Tienda Norte-4", "A B", "A-B", "a b", "A B 1", "Solo"]
    taken = ["TIENDA_NOR", "TIENDA_NOR_2", "SOLO_1", "OTHER"]
    got = {}
    coded = normalize.store_codes(spark.createDataFrame([(n,) for n in names], "name string"),
                                  spark.createDataFrame([(c,) for c in taken], "code string")).collect()
    assert len(coded) == len(names) and len({r.code for r in coded} | set(taken)) == len(names) + len(taken)
    for r in coded:
        got.setdefault(r.name[:10].upper().replace(" ", "_").replace("-", "_"), set()).add(r.code)
    assert got == sequential_codes(names, taken)


def test_find_stores(spark, monkeypatch):
    monkeypatch.setattr(stores, "POSTING_ROWS", 3)
    monkeypatch.setattr(stores, "PROBE_ROWS", 2)
    rng = random.Random(2)
    pool = [(i, n.title()) for i, n in enumerate(random_names(rng, 80) + ["50% Off_Shop"])]
    wanted = sorted({n[rng.randint(0, 3) : rng.randint(4, 12)].upper() for _, n in pool} | {"A", "go", "%", "_", "f_s", "nowhere", ""})
    got = stores.find_stores(spark.createDataFrame([(n,) for n in [*wanted, None]], "name string"),
                             spark.createDataFrame(pool, "id int, name string")).collect()
    expected = {n: min((i for i, s in pool if n and n.lower() in s.lower()), default=None) for n in wanted}
    assert {r.name: r.store_id for r in got} == expected


def test_backfill(spark):
    shops = spark.createDataFrame([("s1", "Tienda Centro", "TIENDA_CEN")], "id string, name string, code string")
    data = lambda name: '{"store":{"name":"%s","address":"x"}}' % name
    invoices = spark.createDataFrame(
        [("1", None, data("TIENDA CENTRO")), ("2", None, data("Mercado Sur")), ("3", None, data("Mercado  Sur!")), ("4", "s9", data("q")),
         ("5", None, None), ("6", None, data("Tienda Cen-Verde Bosque Alto"))], "id string, store_id string, structured_data string")
    created, filled = normalize.backfill_stores(invoices, shops)
    codes = {r.name: r.code for r in created.collect()}
    assert codes == {"Mercado  Sur!": "MERCADO__S", "Tienda Cen-Verde Bosque Alto": "TIENDA_CEN_1"}
    got = {r.id: r.store_id for r in filled.collect()}
    assert got["1"] == "s1" and got["2"] == got["3"] and got["2"] and got["4"] == "s9" and got["5"] is None and got["6"]
