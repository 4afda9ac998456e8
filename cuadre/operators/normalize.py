"""Entity resolution: similar names, master mappings, suggestions, catalog matching.

All fuzzy steps run on distinct normalized names through
:func:`cuadre.operators.fuzzy.top_matches`; raw rows join back by name.
Names that normalize to nothing match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuadre.functions.text import effective_name, normalize_name, once, store_code_base, strip
from cuadre.operators.fuzzy import distinct_names, top_matches
from cuadre.operators.load import _one_per_key
from cuadre.schemas import natural_id
from cuadre.session import cut, kept


def _first_k(df: DataFrame, per: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows per key; Spark limits each input partition before it shuffles."""
    spot = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(spot)).where(F.col("rank") <= k)


def _expand(matches: DataFrame, members: DataFrame, k: int, scope: list[str], order: list[str]) -> DataFrame:
    """Matched names back to pool rows, best ``k`` rows per query.

    A name contributes at most its first ``k`` rows (ties sort by ``order``), so a
    name that many rows share is cut before the join without changing the result.
    """
    few = _first_k(members, [*scope, "norm"], order, k).drop("rank")
    joined = matches.drop("rank", "tie").withColumnRenamed("match", "norm").join(few.hint("merge"), [*scope, "norm"])
    return _first_k(joined, [*scope, "query"], [F.desc("score"), *order], k)


# ---- similar products, vendors, stores -----------------------------------


def similar_products(
    queries: DataFrame, items: DataFrame, threshold: float = 70, k: int = 5, vendor_id=None
) -> DataFrame:
    """Per query name (column ``name``), the best ``k`` (product name, vendor) pairs of the items."""
    if vendor_id is not None:
        items = items.where(F.col("vendor_id") == vendor_id)
    sold = cut(
        items.select(F.col("vendor_product_name").alias("product_name"), "vendor_id").distinct()
        .withColumn("norm", normalize_name(F.col("product_name")))
    )
    asked = cut(queries.select("name", normalize_name(F.col("name")).alias("norm")).distinct())
    matches = top_matches(cut(distinct_names(asked)), cut(distinct_names(sold, tie=F.col("product_name"))), threshold, k)
    found = _expand(matches.drop("scope"), sold, k, [], ["product_name", "vendor_id"])
    return found.join(asked.withColumnRenamed("norm", "query"), "query").select(
        "name", "product_name", "vendor_id", F.col("score").alias("similarity_score"), "rank")


def similar_vendors(queries: DataFrame, vendors: DataFrame, threshold: float = 70, k: int = 5) -> DataFrame:
    """Per query (``name``, optional ``nit``), the best ``k`` vendors.

    An equal tax number scores 100 whatever the name.
    """
    if "nit" not in queries.columns:
        queries = queries.withColumn("nit", F.lit(None).cast("string"))
    asked = cut(queries.select("name", "nit", normalize_name(F.col("name")).alias("norm")).distinct())
    pool = cut(vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"),
                              F.col("nit").alias("vendor_nit"), normalize_name(F.col("name")).alias("norm")))
    same = asked.where(F.col("nit") != "").join(pool.drop("norm"), F.col("nit") == F.col("vendor_nit")).select(
        "name", "nit", "vendor_id", "vendor_name", "vendor_nit", F.lit(100.0).alias("score"))
    # k per name is enough: a row found by number only moves up
    matches = top_matches(cut(distinct_names(asked)), cut(distinct_names(pool, tie=F.col("vendor_name"))), threshold, k)
    by_name = (
        _expand(matches.drop("scope"), pool, k, [], ["vendor_name", "vendor_id"]).drop("rank", "norm")
        .join(asked.withColumnRenamed("norm", "query"), "query")
        .select("name", "nit", "vendor_id", "vendor_name", "vendor_nit", "score")
    )
    both = same.unionByName(by_name).groupBy("name", "nit", "vendor_id", "vendor_name", "vendor_nit").agg(
        F.max("score").alias("similarity_score"))
    return _first_k(both, ["name", "nit"], [F.desc("similarity_score"), "vendor_name", "vendor_id"], k)


def similar_stores(queries: DataFrame, stores: DataFrame, threshold: float = 70, k: int = 5) -> DataFrame:
    """Per query name, the best ``k`` stores."""
    asked = cut(queries.select("name", normalize_name(F.col("name")).alias("norm")).distinct())
    extra = [c for c in ("code", "address") if c in stores.columns]
    pool = cut(stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"),
                             *[F.col(c).alias(f"store_{c}") for c in extra], normalize_name(F.col("name")).alias("norm")))
    matches = top_matches(cut(distinct_names(asked)), cut(distinct_names(pool, tie=F.col("store_name"))), threshold, k)
    found = _expand(matches.drop("scope"), pool, k, [], ["store_name", "store_id"])
    return found.join(asked.withColumnRenamed("norm", "query"), "query").select(
        "name", "store_id", "store_name", *[f"store_{c}" for c in extra], F.col("score").alias("similarity_score"), "rank")


# ---- mappings ------------------------------------------------------------


def _approved(mappings: DataFrame) -> DataFrame:
    return mappings.where(F.col("status") == "approved")


def normalized_lookup(variants: DataFrame, mappings: DataFrame, normalized: DataFrame) -> DataFrame:
    """Approved master product per (``variant_name``, ``vendor_id``); unmapped variants are left out.

    A mapping without vendor holds for every vendor; one of the vendor itself
    goes first, then the lowest mapping id.
    """
    asked = variants.select("variant_name", "vendor_id").distinct()
    known = _approved(mappings).select("variant_name", F.col("vendor_id").alias("_vendor"), F.col("id").alias("mapping_id"),
                                       "normalized_product_id")
    own = known.where(F.col("_vendor").isNotNull()).withColumnRenamed("_vendor", "vendor_id")
    general = known.where(F.col("_vendor").isNull()).drop("_vendor")
    first = lambda df, key: df.groupBy(*key).agg(F.min(F.struct("mapping_id", "normalized_product_id")).alias("hit"))
    hits = (
        asked.join(first(own, ["variant_name", "vendor_id"]).withColumnRenamed("hit", "own"), ["variant_name", "vendor_id"], "left")
        .join(first(general, ["variant_name"]).withColumnRenamed("hit", "general"), "variant_name", "left")
        .withColumn("hit", F.coalesce("own", "general")).where(F.col("hit").isNotNull())
    )
    names = normalized.select(F.col("id").alias("normalized_product_id"), "normalized_name", "normalized_code", "category")
    return hits.select("variant_name", "vendor_id", "hit.normalized_product_id").join(names, "normalized_product_id")


def unmapped_products(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """(product name, vendor) with its count, where no approved mapping applies."""
    from cuadre.operators.reports import product_frequency

    known = _approved(mappings)
    own = known.where(F.col("vendor_id").isNotNull()).select(F.col("variant_name").alias("vendor_product_name"), "vendor_id")
    general = known.where(F.col("vendor_id").isNull()).select(F.col("variant_name").alias("vendor_product_name"))
    return (
        product_frequency(items)
        .join(own, ["vendor_product_name", "vendor_id"], "left_anti")
        .join(general, "vendor_product_name", "left_anti")
    )


def normalization_suggestions(
    items: DataFrame, vendors: DataFrame, mappings: DataFrame, auto_approve: float = 95, threshold: float = 70,
    k: int = 3, include_self: bool = False, max_products: int | None = None,
) -> DataFrame:
    """For each unmapped (product, vendor): its count and best ``k`` similar names of the same vendor.

    One row per suggestion; ``auto_approve`` tells whether the best one reaches
    the limit. By default a product does not suggest itself. ``max_products``
    keeps the most frequent products only.
    """
    todo = unmapped_products(items, mappings)
    if max_products is not None:
        todo = todo.orderBy(F.desc("item_count"), "vendor_product_name", "vendor_id").limit(max_products)
    todo = kept(todo.withColumn("norm", normalize_name(F.col("vendor_product_name"))))
    sold = kept(items.select("vendor_product_name", "vendor_id").distinct()
                .withColumn("norm", normalize_name(F.col("vendor_product_name"))))
    matches = top_matches(
        kept(distinct_names(todo, "vendor_id")), kept(distinct_names(sold, "vendor_id", F.col("vendor_product_name"))),
        threshold, k, scoped=True, include_self=include_self,
    ).withColumnRenamed("scope", "vendor_id")
    pool = sold.withColumnRenamed("vendor_product_name", "suggested_name")
    found = _expand(matches, pool, k, ["vendor_id"], ["suggested_name"])
    # the best of a name is known where its matches are together
    best = F.max("score").over(Window.partitionBy("vendor_id", "query"))
    found = found.withColumn("auto_approve", best >= auto_approve).drop("norm").withColumnRenamed("query", "norm")
    names = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    return (
        todo.withColumnRenamed("vendor_product_name", "variant_name").hint("merge").join(found, ["vendor_id", "norm"])
        .join(names, "vendor_id", "left")
        .select("variant_name", "vendor_id", "vendor_name", "item_count", "suggested_name",
                F.col("score").alias("similarity_score"), "rank", "auto_approve")
    )


def nested_suggestions(suggestions: DataFrame) -> DataFrame:
    """One row per product with its (at most k) suggestions as an array."""
    entry = F.struct("rank", F.col("suggested_name").alias("product_name"), "similarity_score")
    return suggestions.groupBy("variant_name", "vendor_id", "vendor_name", "item_count", "auto_approve").agg(
        F.array_sort(F.collect_list(entry)).alias("suggestions"))


# ---- items to the master catalog -----------------------------------------


#: The smallest score above zero: scores are rounded to one decimal.
LOWEST = 0.1


def catalog_scores(items: DataFrame, products: DataFrame, threshold: float = 80, keep_low: bool = False) -> DataFrame:
    """Best master product per distinct item name: (item_name, product_id, score).

    Items without product take part, unless their name is empty or ``NULL``. Ties
    go to the lowest product id. ``keep_low`` also reports best scores below the
    threshold.
    """
    open_items = items.where(F.col("product_id").isNull()).select("product_name_clean", "vendor_product_name")
    name = effective_name(F.col("product_name_clean"), F.col("vendor_product_name"))
    todo = cut(
        once(open_items, {"item_name": name}, drop=("product_name_clean", "vendor_product_name"))
        .where((F.col("item_name") != "") & (F.col("item_name") != "NULL")).distinct()
        .withColumn("norm", normalize_name(F.col("item_name")))
    )
    catalog = products.select(F.col("id"), normalize_name(F.col("master_name")).alias("norm"))
    best = top_matches(cut(distinct_names(todo)), cut(distinct_names(catalog, tie=F.col("id"))), LOWEST if keep_low else threshold)
    return todo.join(best.select(F.col("query").alias("norm"), F.col("tie").alias("product_id"), "score"), "norm", "left").select(
        "item_name", "product_id", "score")


def map_items_to_catalog(items: DataFrame, products: DataFrame, threshold: float = 80) -> DataFrame:
    """Items with ``product_id`` filled from the best master product at or above the threshold.

    ``matched`` stays as it is.
    """
    found = catalog_scores(items, products, threshold).select("item_name", F.col("product_id").alias("_found"), "score")
    name = effective_name(F.col("product_name_clean"), F.col("vendor_product_name"))
    open_items = items.withColumn("item_name", F.when(F.col("product_id").isNull(), name))
    return (
        open_items.join(found, "item_name", "left")
        .withColumn("product_id", F.coalesce("product_id", "_found"))
        .select(*items.columns, F.col("score").alias("match_score"))
    )


def mapping_stats(items: DataFrame, scores: DataFrame, threshold: float = 80) -> DataFrame:
    """Open items that got a product and that did not, with those of a low, non-zero score."""
    name = effective_name(F.col("product_name_clean"), F.col("vendor_product_name"))
    open_items = items.where(F.col("product_id").isNull()).select(name.alias("item_name"))
    joined = open_items.join(scores.select("item_name", "score"), "item_name", "left")
    return joined.agg(
        F.count_if(F.col("score") >= threshold).alias("mapped"),
        F.count_if(F.coalesce(F.col("score") < threshold, F.lit(True))).alias("not_mapped"),
        F.count_if((F.col("score") > 0) & (F.col("score") < threshold)).alias("low_score"),
    )


def map_by_sku(items: DataFrame, product_mappings: DataFrame, products: DataFrame, threshold: float = 80) -> DataFrame:
    """Product per item: vendor SKU first, then the catalog match; the rest is for manual review.

    ``mapping_source`` is ``sku``, ``fuzzy``, ``given`` or ``manual_review``.
    """
    exact = product_mappings.select("vendor_id", "vendor_sku", F.col("product_id").alias("_sku"))
    by_sku = items.join(exact, ["vendor_id", "vendor_sku"], "left").withColumn("_given", F.col("product_id"))
    tried = by_sku.withColumn("product_id", F.coalesce("product_id", "_sku"))
    mapped = map_items_to_catalog(tried, products, threshold)
    source = (
        F.when(F.col("_given").isNotNull(), "given").when(F.col("_sku").isNotNull(), "sku")
        .when(F.col("product_id").isNotNull(), "fuzzy").otherwise("manual_review")
    )
    return mapped.withColumn("mapping_source", source).select(*items.columns, "mapping_source")


# ---- catalog to normalized products --------------------------------------


def split_catalog(catalog: DataFrame, items: DataFrame, threshold: float = 90) -> DataFrame:
    """Catalog rows (code, name, vendor) with ``is_new``: no invoice item reaches the threshold."""
    rows = cut(catalog.withColumn("norm", normalize_name(F.col("name"))))
    sold = items.select(normalize_name(F.col("vendor_product_name")).alias("norm"))
    seen = top_matches(cut(distinct_names(rows)), cut(distinct_names(sold)), threshold, 1)
    hit = seen.select(F.col("query").alias("norm"), F.lit(True).alias("_seen"))
    return rows.join(hit, "norm", "left").select(*catalog.columns, F.col("_seen").isNull().alias("is_new"))


def catalog_stats(split: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Created, mapped (always 0) and skipped rows; ``listed`` also counts rows without a name."""
    created = F.count_if("is_new")
    skipped = F.count_if(~F.col("is_new"))
    if listed is not None:
        blank = listed.agg(F.count_if(F.coalesce(strip(F.col("name")), F.lit("")).isin("", "nan"))).scalar()
        skipped = skipped + blank
    return split.agg(created.alias("created"), F.lit(0).cast("bigint").alias("mapped"), skipped.alias("skipped"))


def catalog_entities(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalized products and approved mappings of the new catalog rows."""
    new = split.where("is_new")
    entities = create_normalized_products(new.select(
        F.col("name").alias("normalized_name"), F.col("code").alias("normalized_code"), F.col("vendor").alias("category"),
        F.concat(F.lit("From "), "vendor", F.lit(" catalog")).alias("description")))
    mappings = create_mappings(
        entities.select(F.col("normalized_name").alias("variant_name"), F.lit(None).cast("string").alias("vendor_id"),
                        F.col("id").alias("normalized_product_id"), F.lit(100.0).alias("similarity_score"),
                        F.lit("approved").alias("status")),
        key=["variant_name", "normalized_product_id"])
    return entities, mappings


def create_normalized_products(requests: DataFrame) -> DataFrame:
    """Normalized product rows from requests; the id is a hash of code, name and category."""
    return requests.withColumn("id", natural_id("normalized_name", "normalized_code", "category"))


def create_normalized(requests: DataFrame, key: list[str]) -> DataFrame:
    """Normalized vendor or store rows from requests."""
    return requests.withColumn("id", natural_id(*key))


def create_mappings(requests: DataFrame, key: list[str]) -> DataFrame:
    """Mapping rows from requests; status ``pending`` unless given."""
    if "status" not in requests.columns:
        requests = requests.withColumn("status", F.lit("pending"))
    return requests.withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("id", natural_id(*key))


def review_mappings(mappings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mappings after approve/reject decisions (mapping_id, status, reviewed_by, reviewed_at).

    The latest decision per mapping counts.
    """
    last = _one_per_key(decisions, ["mapping_id"], F.col("reviewed_at"), last=True)
    joined = mappings.alias("m").join(last.alias("d"), F.col("m.id") == F.col("d.mapping_id"), "left")
    kept = [F.col(f"m.{c}") for c in mappings.columns if c not in ("status", "reviewed_by", "reviewed_at")]
    old = lambda c, t: F.col(f"m.{c}") if c in mappings.columns else F.lit(None).cast(t)
    return joined.select(
        *kept, F.coalesce("d.status", "m.status").alias("status"),
        F.coalesce(F.col("d.reviewed_by"), old("reviewed_by", "string")).alias("reviewed_by"),
        F.coalesce(F.col("d.reviewed_at"), old("reviewed_at", decisions.schema["reviewed_at"].dataType.simpleString())).alias("reviewed_at"))


# ---- stores for invoices that have none -----------------------------------


def _dealt(df: DataFrame, per: str, bucket: Column, order: str) -> DataFrame:
    """``pos`` 0, 1, 2, ... per key, in (bucket, order).

    Dealt in two steps, a count per bucket and places inside it, so a key that
    holds a large part of the rows is never sorted in one task.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(per, "_bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy(per).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(per, "_bucket").orderBy(order)) - 1
    return df.join(sizes.withColumn("before", before).drop("n"), [per, "_bucket"]).withColumn(
        "pos", F.col("before") + place).drop("before", "_bucket")


_CODES_PER_BUCKET = 4096


def store_codes(new_names: DataFrame, taken: DataFrame) -> DataFrame:
    """Unique codes for new stores (``name`` -> ``code``).

    The first store of a base gets the base itself, if free, and further ones the
    lowest free of ``_1``, ``_2``, ...
    """
    coded = new_names.select("name").distinct().withColumn("base", store_code_base(F.col("name")))
    asked = _dealt(coded, "base", F.pmod(F.xxhash64("name"), F.lit(1024)), "name")

    # codes in use as (base, number), 0 for the bare base; a base asked for now is kept for its own first store
    bases = coded.groupBy("base").agg(F.count("*").alias("wanted"))
    used = taken.select("code").distinct()
    bare = used.join(bases, F.col("code") == F.col("base"), "left_semi").select(
        F.col("code").alias("base"), F.lit(0).cast("bigint").alias("number"))
    base, number = (F.regexp_extract("code", r"^(.*)_([1-9][0-9]{0,9})$", i) for i in (1, 2))
    numbered = (
        used.unionByName(bases.select(F.col("base").alias("code"))).distinct()
        .select(base.alias("base"), F.nullif(number, F.lit("")).cast("bigint").alias("number"))
        .where(F.col("number").isNotNull()).join(bases, "base", "left_semi")
    )
    busy = bare.unionByName(numbered)

    # among the first (wanted + busy) numbers at least ``wanted`` are free
    held = busy.groupBy("base").agg(F.count("*").alias("held"))
    last = F.col("wanted") + F.coalesce("held", F.lit(0)) - 1
    size = F.lit(_CODES_PER_BUCKET).cast("bigint")
    runs = bases.join(held, "base", "left").select(
        "base", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / size))).alias("run"))
    numbers = runs.select("base", F.explode(F.sequence(
        F.col("run") * size, F.least(F.col("last"), F.col("run") * size + size - 1))).alias("number"))
    free = _dealt(numbers.join(busy, ["base", "number"], "left_anti"), "base", F.floor(F.col("number") / size), "number")

    code = F.when(F.col("number") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("number").cast("string")))
    return asked.join(free, ["base", "pos"]).select("name", code.alias("code"))


def backfill_stores(invoices: DataFrame, stores: DataFrame, threshold: float = 80) -> tuple[DataFrame, DataFrame]:
    """Stores for invoices without one, from the store name in ``structured_data``.

    Returns the stores to create and the invoices with ``store_id`` filled. Names
    go to the best existing store at or above the threshold (lowest id on ties);
    the others are grouped by :func:`cuadre.operators.cluster.first_fit` and each
    group's leader becomes a store.
    """
    from cuadre.operators.cluster import first_fit

    path = lambda p: F.get_json_object("structured_data", p)
    named = invoices.where(F.col("store_id").isNull()).select(
        "id", F.nullif(path("$.store.name"), F.lit("")).alias("name"), path("$.store.address").alias("address"))
    named = cut(named.where(F.col("name").isNotNull()))
    names = cut(named.groupBy("name").agg(F.min("address").alias("address"))
                .withColumn("norm", normalize_name(F.col("name"))))
    pool = stores.select("id", normalize_name(F.col("name")).alias("norm"))
    best = cut(top_matches(cut(distinct_names(names)), cut(distinct_names(pool, tie=F.col("id"))), threshold))
    known = names.join(best.select(F.col("query").alias("norm"), F.col("tie").alias("store_id")), "norm").select("name", "store_id")
    left = cut(names.join(best.select(F.col("query").alias("norm")), "norm", "left_anti"))
    groups = first_fit(left.select(F.col("name").alias("id"), "name"), threshold)
    leaders = groups.where(F.col("id") == F.col("leader_id")).select(F.col("id").alias("name"))
    created = cut(
        store_codes(leaders, stores).join(left.select("name", "address"), "name")
        .withColumn("id", natural_id("code").cast(stores.schema["id"].dataType)
                    if stores.schema["id"].dataType.simpleString() == "string" else F.xxhash64("code"))
    )
    made = groups.select(F.col("id").alias("name"), "leader_id").join(
        created.select(F.col("name").alias("leader_id"), F.col("id").alias("store_id")), "leader_id").select("name", "store_id")
    chosen = named.select("id", "name").join(known.unionByName(made), "name").select("id", F.col("store_id").alias("_store"))
    filled = invoices.join(chosen, "id", "left").withColumn("store_id", F.coalesce("store_id", "_store")).select(*invoices.columns)
    return created, filled
