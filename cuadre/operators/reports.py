"""Invoice views, the flat report, price alerts, pages and summary figures.

Dimension joins carry no broadcast hint: Spark broadcasts a side only when its
size is known to be under ``spark.sql.autoBroadcastJoinThreshold`` (AQE checks
again at run time) and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from cuadre.functions.manufacturer import extract_manufacturer, manufacturer_row
from cuadre.functions.text import confidence_pct, date_parts, effective_name
from cuadre.operators.joins import lookup, lookup_apart
from cuadre.operators.paging import seek_page

ALL = "Todos"
HIGH_PRICE = "🔴 PRECIO ALTO"

# Headings of the report, in sheet order.
REPORT_HEADINGS = {
    "alert": "⚠️ Alerta", "status": "Estado", "store": "Tienda", "store_code": "Código Tienda", "date": "Fecha",
    "week": "Semana", "month_name": "Mes", "quarter": "Quarter", "year": "Año", "invoice_number": "Invoice #",
    "distributor": "Distribuidor", "manufacturer": "Fabricante", "master_sku": "Master SKU",
    "item_code": "Código Item", "item_name": "Nombre Item", "cases_ordered": "Cases Ordered",
    "units_per_case": "Unidades por Case", "total_units": "Unidades Totales", "agreed_price": "Precio Acordado",
    "price_per_case": "Precio por Case", "price_per_unit": "Precio por Unidad", "total_price": "Precio Total",
    "confidence": "Confidence",
}


# ---- views ---------------------------------------------------------------


def invoices_detailed(invoices: DataFrame, vendors: DataFrame, stores: DataFrame, items: DataFrame) -> DataFrame:
    """Invoices with vendor, store and number of items (0 when there are none)."""
    counts = items.groupBy(F.col("invoice_id").alias("id")).agg(F.countDistinct("id").alias("items_count"))
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"), F.col("nit").alias("vendor_nit"))
    s = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.col("code").alias("store_code"))
    kept = [c for c in ("id", "invoice_number", "invoice_date", "total", "processing_status", "confidence_score",
                        "validated") if c in invoices.columns]
    stamps = [c for c in ("created_at", "updated_at") if c in invoices.columns]
    return (
        lookup(invoices.join(v, "vendor_id", "left"), s, "store_id")
        .join(counts, "id", "left")
        .select(*kept, "vendor_name", "vendor_nit", "store_name", "store_code",
                F.coalesce("items_count", F.lit(0).cast("bigint")).alias("items_count"), *stamps)
    )


def items_detailed(items: DataFrame, invoices: DataFrame, products: DataFrame) -> DataFrame:
    """Items with invoice number and mapped product."""
    i = invoices.select(F.col("id").alias("invoice_id"), "invoice_number", "invoice_date")
    p = products.select(F.col("id").alias("product_id"), F.col("master_name").alias("product_name"),
                        F.col("master_sku").alias("product_sku"))
    return (
        lookup(items.join(i, "invoice_id"), p, "product_id")
        .select("id", "invoice_id", "invoice_number", "vendor_product_name", "vendor_sku", "product_name",
                "product_sku", "quantity", "unit_price", "line_total", "matched", "line_number", "invoice_date")
    )


def processing_summary(invoices: DataFrame) -> DataFrame:
    """Per day and status: count, mean confidence, total amount."""
    return invoices.groupBy(F.to_date("created_at").alias("date"), "processing_status").agg(
        F.count("*").alias("count"),
        F.avg(F.col("confidence_score").cast("double")).alias("avg_confidence"),
        F.sum("total").alias("total_amount"),
    )


# ---- the flat report -----------------------------------------------------

_MAKER = ("manufacturer_name", "product_name_clean")


def unit_columns(quantity: Column, case_price: Column, units_per_case: Column | None = None) -> dict[str, Column]:
    """Units and unit price from cases (one unit per case unless given)."""
    units = units_per_case if units_per_case is not None else F.lit(1)
    return {
        "units_per_case": units,
        "total_units": quantity * units,
        "price_per_case": case_price,
        "price_per_unit": case_price / units,
    }


def with_manufacturer(items: DataFrame, name: str = "vendor_product_name", to_filter: bool = False) -> DataFrame:
    """Items with ``manufacturer_name``, ``product_name_clean`` and ``manufacturer_prefix``.

    As it is, the extraction is dropped where its columns are not read. Pass
    ``to_filter`` when later steps filter on them: it is then computed once per
    row, and always.
    """
    if to_filter:
        return items.select("*", F.inline(manufacturer_row(F.col(name))))
    return items.withColumn("_maker", extract_manufacturer(F.col(name))).select(*items.columns, "_maker.*")


def fact_rows(items: DataFrame, invoices: DataFrame, vendors: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """The joins of :func:`invoice_fact`: one row per item with what :func:`fact_columns` shows, and no more.

    Vendor and store meet the invoices, and only items with a product meet the products, so
    that a whole item moves once for its invoice and once at most for its product.
    """
    i = invoices.select(F.col("id").alias("invoice_id"), "invoice_number", "invoice_date", "processing_status",
                        "confidence_score", "store_id", F.col("vendor_id").alias("invoice_vendor"))
    v = vendors.select(F.col("id").alias("invoice_vendor"), F.col("name").alias("distributor"))
    s = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.col("code").alias("code"))
    p = products.select(F.col("id").alias("product_id"), "master_sku")
    heads = lookup(i.join(v, "invoice_vendor"), s, "store_id", "invoice_id").drop("invoice_vendor", "store_id")
    lines = items.select(F.col("id").alias("item_id"), "invoice_id", "product_id", "vendor_product_name", F.col("vendor_sku").alias("item_code"),
                         "quantity", F.col("unit_price").alias("price_per_case"), "line_total", *[c for c in _MAKER if c in items.columns])
    return lookup_apart(lines, p, "product_id").drop("product_id").join(heads, "invoice_id")


def fact_columns(rows: DataFrame, to_filter: bool = False) -> DataFrame:
    """The flat report from :func:`fact_rows`; columns that joined them since, as agreed prices, follow.

    Without ``manufacturer_name`` and ``product_name_clean`` these are extracted here, ``to_filter`` as for
    :func:`with_manufacturer`.
    """
    more = [c for c in rows.columns if c in ("agreed_price", "alert")]
    parts = date_parts(F.col("invoice_date"))
    units = unit_columns(F.col("quantity"), F.col("price_per_case"))
    if not set(_MAKER) <= set(rows.columns):
        rows = with_manufacturer(rows.drop(*_MAKER), to_filter=to_filter)
    return rows.select(
        F.col("processing_status").alias("status"),
        F.coalesce("store_name", F.lit("N/A")).alias("store"),
        F.coalesce("code", F.lit("N/A")).alias("store_code"),
        *[c.alias(n) for n, c in parts.items()],
        "distributor",
        F.coalesce("manufacturer_name", F.lit("")).alias("manufacturer"),
        "invoice_number",
        confidence_pct(F.col("confidence_score")).alias("confidence"),
        F.coalesce("master_sku", F.lit("")).alias("master_sku"),
        "item_code",
        effective_name(F.col("product_name_clean"), F.col("vendor_product_name")).alias("item_name"),
        F.col("quantity").alias("cases_ordered"),
        *[c.alias(n) for n, c in units.items()],
        F.col("line_total").alias("total_price"),
        "invoice_id",
        "item_id",
        *more,
    )


def invoice_fact(
    items: DataFrame, invoices: DataFrame, vendors: DataFrame, stores: DataFrame, products: DataFrame, to_filter: bool = False
) -> DataFrame:
    """One flat row per invoice item, as the report shows it.

    ``items`` may carry ``manufacturer_name`` and ``product_name_clean``; else they are
    extracted behind the joins. Items need an invoice and a vendor; store, manufacturer and
    product are optional. A null item code stays null.
    """
    return fact_columns(fact_rows(items, invoices, vendors, stores, products), to_filter)


def report_filter(
    fact: DataFrame,
    distributor: str | None = None,
    store: str | None = None,
    status: str | None = None,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    """Equality filters and an inclusive date range; ``None`` or ``Todos`` means all."""
    for column, wanted in (("distributor", distributor), ("store", store), ("status", status)):
        if wanted not in (None, ALL):
            fact = fact.where(F.col(column) == wanted)
    if date_from is not None:
        fact = fact.where(F.to_date("date") >= F.lit(date_from))
    if date_to is not None:
        fact = fact.where(F.to_date("date") <= F.lit(date_to))
    return fact


def filter_options(fact: DataFrame) -> DataFrame:
    """Pick-lists: (filter, position, option), plus the first and last date.

    One pass over the rows: each offers its values, which the map side keeps distinct by hash (a minimum
    of texts would sort every offer). The entry for all, the first and the last date are told from those left.
    """
    names = ("distributor", "store", "status")
    offers = [F.struct(F.lit(n).alias("filter"), F.col(n).alias("option")) for n in (*names, "date")]
    seen = fact.select(F.explode(F.array(*offers)).alias("o")).select("o.*").distinct()
    entry = lambda name, option: F.struct(F.lit(name).alias("filter"), option.alias("option"))
    kinds = [F.when(F.col("filter") == n, F.array(entry(n, F.col("option")), entry(n, F.lit(ALL)))) for n in names]
    dates = F.array(entry("date_from", F.col("option")), entry("date_to", F.col("option")))
    listed = seen.select(F.explode(F.coalesce(*kinds, dates)).alias("e")).select("e.*").where(F.col("option").isNotNull())
    span = ("date_from", "date_to")
    found = listed.groupBy("filter", F.when(~F.col("filter").isin(*span), F.col("option")).alias("listed")).agg(
        F.min("option").alias("first"), F.max("option").alias("last"))
    return found.select("filter", F.when(F.col("filter") == "date_to", F.col("last")).otherwise(F.col("first")).alias("option")).orderBy(
        "filter", F.col("option") != ALL, "option")


def report_metrics(fact: DataFrame) -> DataFrame:
    """Items, amount, mean case price and distinct invoice numbers.

    The same number from two vendors counts once; ``unique_invoice_ids`` tells them apart.
    """
    return fact.agg(
        F.count("*").alias("total_items"),
        F.sum("total_price").alias("total_amount"),
        F.avg("price_per_case").alias("avg_case_price"),
        F.countDistinct("invoice_number").alias("unique_invoices"),
        F.countDistinct("invoice_id").alias("unique_invoice_ids"),
    )


def row_search(df: DataFrame, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column, as text, matches the regular expression, ignoring case."""
    hit = F.lit(False)
    for name in columns or df.columns:
        hit = hit | F.coalesce(F.col(name).cast("string").rlike(f"(?i){pattern}"), F.lit(False))
    return df.where(hit)


def price_join(fact: DataFrame, agreed: DataFrame) -> DataFrame:
    """Left join of agreed prices on (distributor, item code); duplicate prices fan out."""
    known = agreed.select("distributor", "item_code", "agreed_price")
    row = "item_id" if "item_id" in fact.columns else "distributor"
    return lookup(fact, known, "item_code", row, ["distributor"])


def alert_text(case_price: Column, agreed_price: Column) -> Column:
    return F.when(case_price > agreed_price, HIGH_PRICE).otherwise("")


def price_alerts(fact: DataFrame, agreed: DataFrame, dedupe: bool = False) -> DataFrame:
    """The report with agreed price and alert. ``dedupe`` takes the lowest price per key.

    Given :func:`fact_rows`, the join moves these narrow rows, and :func:`fact_columns` makes the report of the result.
    """
    if dedupe:
        agreed = agreed.groupBy("distributor", "item_code").agg(F.min("agreed_price").alias("agreed_price"))
    return price_join(fact, agreed).withColumn("alert", alert_text(F.col("price_per_case"), F.col("agreed_price")))


def alert_count(alerted: DataFrame) -> DataFrame:
    return alerted.agg(F.count_if(F.col("alert") == HIGH_PRICE).alias("alerts"), F.count("*").alias("rows"))


def report_sheet(alerted: DataFrame) -> DataFrame:
    """The report under its headings, in sheet order."""
    return alerted.select(*[F.col(c).alias(h) for c, h in REPORT_HEADINGS.items() if c in alerted.columns])


# ---- invoice lists -------------------------------------------------------


def invoice_filter(
    invoices: DataFrame,
    vendors: DataFrame | None = None,
    vendor_id=None, store_id=None, status: str | None = None,
    date_from: date | None = None, date_to: date | None = None,
    validated: bool | None = None, min_confidence: float | None = None, search: str | None = None,
) -> DataFrame:
    """Invoices that pass every given filter; ``search`` looks in number and vendor name."""
    for column, wanted in (("vendor_id", vendor_id), ("store_id", store_id), ("processing_status", status),
                           ("validated", validated)):
        if wanted is not None:
            invoices = invoices.where(F.col(column) == wanted)
    if date_from is not None:
        invoices = invoices.where(F.col("invoice_date") >= F.lit(date_from))
    if date_to is not None:
        invoices = invoices.where(F.col("invoice_date") <= F.lit(date_to))
    if min_confidence is not None:
        invoices = invoices.where(F.col("confidence_score") >= min_confidence)
    if search is not None:
        names = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("_vendor"))
        needle = F.lit(search.lower())
        invoices = invoices.join(names, "vendor_id", "left").where(
            F.contains(F.lower("invoice_number"), needle)
            | F.coalesce(F.contains(F.lower("_vendor"), needle), F.lit(False))
        ).drop("_vendor")
    return invoices


def invoice_page(
    invoices: DataFrame, vendors: DataFrame, page: int = 1, page_size: int = 20,
    sort_by: str = "created_at", sort_order: str = "desc",
) -> DataFrame:
    """One page of invoices with vendor name and tax number; ties sort by id.

    Later pages are found by counting ranges of the sort key, see :mod:`cuadre.operators.paging`.
    """
    if page < 1 or not 1 <= page_size <= 100 or sort_order not in ("asc", "desc"):
        raise ValueError("page >= 1, page_size 1..100, sort_order asc or desc")
    key = F.col(sort_by).desc() if sort_order == "desc" else F.col(sort_by).asc()
    if page == 1:
        rows = invoices.orderBy(key, "id").limit(page_size)
    else:
        rows = seek_page(invoices, page, page_size, sort_by, sort_order)
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"),
                       F.col("nit").alias("vendor_nit"))
    return rows.join(v, "vendor_id", "left").orderBy(key, "id")


def page_info(invoices: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    total = F.count("*")
    return invoices.agg(total.alias("total"), F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
                        F.ceil(total / page_size).alias("pages"))


def invoice_nested(invoices: DataFrame, items: DataFrame, vendors: DataFrame, stores: DataFrame) -> DataFrame:
    """One row per invoice with vendor and store structs and all its items by line number."""
    item = F.struct("line_number", *[c for c in items.columns if c not in ("line_number", "invoice_id")])
    lists = items.groupBy(F.col("invoice_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    v = vendors.select(F.col("id").alias("vendor_id"), F.struct("name", "nit").alias("vendor"))
    s = stores.select(F.col("id").alias("store_id"), F.struct("name", "code").alias("store"))
    return (
        lookup(invoices.join(v, "vendor_id", "left"), s, "store_id").join(lists, "id", "left")
        .withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))
    )


# ---- figures -------------------------------------------------------------


def product_frequency(items: DataFrame) -> DataFrame:
    """How often each vendor sells each product name."""
    return items.groupBy("vendor_product_name", "vendor_id").agg(F.count("*").alias("item_count"))


def processing_stats(invoices: DataFrame) -> DataFrame:
    """Counts by state, mean confidence, invoices per hour over the covered time."""
    state = lambda s: F.count_if(F.col("processing_status") == s)
    span = (F.unix_seconds(F.max("created_at").cast("timestamp")) - F.unix_seconds(F.min("created_at").cast("timestamp"))) / 3600.0
    return invoices.agg(
        F.count("*").alias("total_invoices"), state("processed").alias("processed"), state("pending").alias("pending"),
        state("error").alias("errors"), state("manual_review").alias("manual_review"),
        F.avg(F.col("confidence_score").cast("double")).alias("avg_confidence"),
        (state("processed") / F.nullif(span, F.lit(0.0))).alias("processing_rate_per_hour"),
    )


def dashboard_metrics(invoices: DataFrame, as_of: date, log: DataFrame | None = None) -> DataFrame:
    """Processed invoices and amounts for the day, ISO week and month of ``as_of``.

    The week and the month run up to ``as_of``. With ``log`` (invoice_id,
    created_at) also the mean time between an invoice's first and last event.
    """
    day, today = F.to_date("created_at"), F.lit(as_of)
    until = (F.col("processing_status") == "processed") & (day <= today)
    spans = {"today": day == today, "week": day >= F.trunc(today, "week"), "month": day >= F.trunc(today, "month")}
    columns = []
    for name, inside in spans.items():
        columns.append(F.count_if(until & inside).alias(f"{name}_processed"))
        columns.append(F.coalesce(F.sum(F.when(until & inside, F.col("total"))), F.lit(0)).alias(f"{name}_total_amount"))
    metrics = invoices.where(day.between(F.least(F.trunc(today, "week"), F.trunc(today, "month")), today)).agg(*columns)
    if log is None:
        return metrics
    seconds = F.unix_seconds(F.max("created_at")) - F.unix_seconds(F.min("created_at"))
    times = log.groupBy("invoice_id").agg(seconds.alias("s")).agg(F.avg("s").alias("avg_processing_time_seconds"))
    return metrics.withColumn("avg_processing_time_seconds", times.scalar())


def top_vendors(invoices: DataFrame, vendors: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` vendors with the highest invoiced amount."""
    sums = invoices.groupBy("vendor_id").agg(F.count("*").alias("invoices"), F.sum("total").alias("amount"))
    best = sums.orderBy(F.round("amount", 4).desc(), "vendor_id").limit(k)
    return best.join(vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name")), "vendor_id", "left")


def recent_errors(log: DataFrame, k: int = 10) -> DataFrame:
    return log.where(F.col("status") == "error").orderBy(F.desc("created_at"), "id").limit(k)


def manufacturer_stats(extracted: DataFrame) -> DataFrame:
    """Items processed, with and without a manufacturer, and without a name."""
    named = F.col("manufacturer_name").isNotNull()
    blank = F.col("vendor_product_name").isNull()
    return extracted.agg(
        F.count("*").alias("processed"), F.count_if(named).alias("with_manufacturer"),
        F.count_if(~named).alias("without_manufacturer"), F.count_if(blank).alias("errors"),
    )


def manufacturer_list(extracted: DataFrame) -> DataFrame:
    """Manufacturers by name with their number of items."""
    return (
        extracted.where(F.col("manufacturer_name").isNotNull())
        .groupBy("manufacturer_name").agg(F.count("*").alias("items")).orderBy("manufacturer_name")
    )
