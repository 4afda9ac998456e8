"""From extraction JSON to typed, salvaged, scored and checked invoice records."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from cuadre.functions.text import NUMBER, nit_valid, once, text_guard
from cuadre.schemas import ITEM, TEXT_MAP, TEXT_MAPS

TOTAL_TOLERANCE = 0.01
#: Top-level values read as text, and the parts read as maps; one pass over the text reads them all.
VALUES = ("invoice_number", "invoice_date", "due_date", "subtotal", "tax", "total", "confidence")
PARTS = {"vendor": TEXT_MAP, "store": TEXT_MAP, "items": TEXT_MAPS}
#: Columns made without looking at the items.
HEAD = frozenset(("vendor", "store", "extracted_confidence", *VALUES)) - {"confidence"}


def _value(record: Column, key: str) -> Column:
    return F.try_element_at(record, F.lit(key))


def _has(record: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(record, key), F.lit(False))


def _null_key(record: Column, key: str) -> Column:
    """The key is there and its value is null."""
    return _has(record, key) & _value(record, key).isNull()


def _text(value: Column, has: Column) -> Column:
    """The value, null when null, ``''`` when the key is missing."""
    return F.coalesce(value, F.when(~has, ""))


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def _number_or(value: Column, has: Column, missing: float) -> Column:
    return F.coalesce(_number(value), F.when(~has, missing))


def _day(text: Column) -> Column:
    """ISO date (or the date of an ISO timestamp); null when it is none."""
    long = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(text, 1, 10).try_cast("date"))
    dashed = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.coalesce(long, F.when(text.rlike(r"^\d{8}$"), dashed.try_cast("date")))


def salvage_items(items: Column) -> Column:
    """Typed items from an array of string maps.

    A missing quantity, price or total is 0 and a missing name is ``''``; an item
    with an explicit null or a non-number there is dropped, as is one that is null itself.
    """
    typed = F.transform(F.filter(items, lambda i: i.isNotNull()), lambda i: F.struct(
        _text(_value(i, "product_name"), _has(i, "product_name")).alias("product_name"),
        _value(i, "sku").alias("sku"),
        *[_number_or(_value(i, n), _has(i, n), 0.0).alias(n) for n in ("quantity", "unit_price", "line_total")],
    ))
    required = ("product_name", "quantity", "unit_price", "line_total")

    def usable(i: Column) -> Column:
        ok = i[required[0]].isNotNull()
        for name in required[1:]:
            ok = ok & i[name].isNotNull()
        return ok

    return F.filter(typed, usable).cast(ITEM)


def items_sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, i: total + i["line_total"])


def _off_total(total: str = "total") -> Column:
    return F.abs(F.col("items_sum") - F.col(total)) / F.nullif(F.col(total), F.lit(0.0)) > TOTAL_TOLERANCE


def _read(df: DataFrame, column: str, parts: dict[str, DataType]) -> DataFrame:
    """``df`` with ``_k`` (keys), the texts of ``VALUES``, the maps of ``parts`` and ``_r``, the last where one pass does not do.

    A typed read gives the last value of a repeated key and null for a part that is null or no map, and takes a list of
    records for its first; such texts are read as a map of texts ``_r`` and each part from its text.
    """
    schema = StructType([*(StructField(n, StringType()) for n in VALUES), *(StructField(n, t) for n, t in parts.items())])
    keys, read = F.col("_k"), F.col("_f")
    plain = (F.size(keys) > 0) & (F.size(F.array_distinct(keys)) == F.size(keys))
    for part in parts:
        plain = plain & (read[part].isNotNull() | ~F.array_contains(keys, part))
    if "items" in parts:
        plain = plain & ~F.coalesce(F.exists(read["items"], lambda i: i.isNull()), F.lit(False))
    one_pass = df.withColumns({"_k": F.json_object_keys(column), "_f": F.from_json(column, schema)})
    mapped = one_pass.withColumn("_plain", F.coalesce(plain, F.lit(False))).withColumn(
        "_r", F.when(~F.col("_plain"), F.from_json(column, TEXT_MAP)))
    r, whole = F.col("_r"), F.col("_plain")
    either = lambda n, other: F.when(whole, read[n]).otherwise(other).alias(f"_{n}")
    return mapped.select(
        *df.columns, "_r", F.when(whole, keys).otherwise(F.map_keys(r)).alias("_k"), *[either(n, _value(r, n)) for n in VALUES],
        *[either(n, F.from_json(_value(r, n), t)) for n, t in parts.items()])


def parse_extractions(df: DataFrame, column: str = "extraction", columns: Iterable[str] | None = None) -> DataFrame:
    """Typed record columns, ``confidence`` after adjustment, and ``reject_reason``.

    ``reject_reason`` is null for a usable record and otherwise names the first
    rule it fails. With ``columns`` only these are made, and only what they need is parsed.
    """
    columns = None if columns is None else list(columns)
    parts = PARTS if columns is None or not HEAD.issuperset(columns) else {n: t for n, t in PARTS.items() if n != "items"}
    read = _read(df, column, parts)
    r, v, s = F.col("_r"), F.col("_vendor"), F.col("_store")
    value = lambda key: F.col(f"_{key}")
    has = lambda key: F.coalesce(F.array_contains("_k", key), F.lit(False))
    found_items = F.coalesce(F.col("_items"), F.array().cast(TEXT_MAPS)) if "items" in parts else F.array().cast(TEXT_MAPS)
    typed = read.select(
        *df.columns, "_r", "_k", v, *[value(n) for n in VALUES],
        F.struct(*[_text(_value(v, n), _has(v, n)).alias(n) for n in ("name", "nit")], _value(v, "address").alias("address"),
                 _value(v, "phone").alias("phone")).alias("vendor"),
        F.struct(_value(s, "name").alias("name"), _value(s, "address").alias("address")).alias("store"),
        _text(value("invoice_number"), has("invoice_number")).alias("invoice_number"),
        _day(value("invoice_date")).alias("invoice_date"),
        _day(value("due_date")).alias("due_date"),
        F.size(found_items).alias("items_found"),
        salvage_items(found_items).alias("items"),
        _number(value("subtotal")).alias("subtotal"),
        _number(value("tax")).alias("tax"),
        _number_or(value("total"), has("total"), 0.0).alias("total"),
        _number_or(value("confidence"), has("confidence"), 0.8).alias("extracted_confidence"),
    ).withColumn("items_sum", items_sum(F.col("items")))

    incomplete = (F.coalesce(F.col("vendor.name"), F.lit("")) == "") | (F.coalesce(F.col("vendor.nit"), F.lit("")) == "")
    scored = typed.withColumn(
        "confidence",
        F.col("extracted_confidence")
        * F.when(incomplete, 0.9).otherwise(1.0)
        * F.when(_off_total(), 0.9).otherwise(1.0),
    )

    given = lambda key: F.coalesce(value(key), F.lit("")) != ""
    bad_amount = lambda key: value(key).isNotNull() & F.col(key).isNull()
    reason = (
        F.when(F.coalesce(F.size("_k"), F.lit(0)) <= 0, "malformed")
        # a part that is null has been read as a map of texts
        .when(_null_key(r, "vendor") | _null_key(v, "name") | _null_key(v, "nit"), "vendor_null")
        .when(_null_key(r, "store"), "store_null")
        .when(F.size("items") == 0, "no_items")
        .when(given("invoice_date") & F.col("invoice_date").isNull(), "invoice_date_invalid")
        .when(given("due_date") & F.col("due_date").isNull(), "due_date_invalid")
        .when(F.col("total").isNull() | (F.col("total") <= 0), "total_invalid")
        .when(F.col("invoice_date").isNull(), "invoice_date_missing")
        .when(F.col("invoice_number").isNull(), "invoice_number_null")
        .when(bad_amount("subtotal") | bad_amount("tax"), "amount_invalid")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence_invalid")
    )
    helpers = ("_r", "_k", "_vendor", *(f"_{n}" for n in VALUES))
    found = [c for c in scored.columns if c not in (*df.columns, *helpers)]
    made = {**{c: F.col(c) for c in found}, "reject_reason": reason}
    chosen = made if columns is None else {c: made[c] for c in columns}
    return once(scored.select(*df.columns, *helpers, *found), chosen, drop=(*helpers, *found))


def invoice_warnings(records: DataFrame) -> DataFrame:
    """``warnings``: what is missing or does not add up. They do not block loading."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # The warning texts.
    return records.withColumn("warnings", F.array_compact(F.array(
        F.when(empty("vendor.name"), "Vendor sin nombre"),
        F.when(empty("vendor.nit"), "Vendor sin NIT"),
        F.when(empty("invoice_number"), "Sin número de factura"),
        F.when(F.size("items") == 0, "Factura sin items"),
        F.when(F.col("total") <= 0, "Total inválido"),
        F.when(_off_total(), "Suma items != Total"),
    )))


def validate_records(records: DataFrame, as_of: date, max_days: int = 365) -> DataFrame:
    """``is_valid`` and ``errors`` under the business rules (tax number, date range, total)."""
    errors = F.array_compact(F.array(
        F.when(~nit_valid(F.col("vendor.nit")), "NIT inválido"),
        F.when(F.abs(F.datediff(F.lit(as_of), "invoice_date")) > max_days, "Fecha de factura fuera de rango"),
        F.when(_off_total(), "Discrepancia en total"),
    ))
    return records.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def accept_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is long enough to be worth extracting."""
    return df.where(text_guard(F.col(column)))
