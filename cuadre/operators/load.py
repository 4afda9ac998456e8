"""Loading without duplicates: get-or-create, first-wins inserts, upserts, corrections.

Each function takes the current table and a batch and returns the rows to add
or the new state. Batches are reduced with aggregates (map-side partial), not
per-key sorts, so one hot key does not land whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cuadre.functions.manufacturer import manufacturer_row
from cuadre.functions.text import text_guard
from cuadre.operators.extraction import invoice_warnings, parse_extractions
from cuadre.operators.joins import lookup, lookup_hot
from cuadre.operators.stores import find_stores
from cuadre.schemas import natural_id
from cuadre.session import kept


#: Number of a row of a batch, so that equal file ids and null ones stay apart.
ROW = "_row_number"
#: True for a record that is known to be the first of its invoice, where the caller has found that out.
FIRST = "_first"


def _one_per_key(df: DataFrame, key: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of every key under ``order``."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    pick = F.max_by if last else F.min_by
    return df.groupBy(*key).agg(pick(F.struct(*rest), order).alias("_row")).select(*key, "_row.*").select(*df.columns)


def new_rows(table: DataFrame, incoming: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Rows to insert: first of each key in the batch, and no key the table has."""
    return _one_per_key(incoming, key, order).join(table.select(*key), list(key), "left_anti").select(*incoming.columns)


def insert_if_absent(table: DataFrame, incoming: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The table plus the rows whose key it lacks; conflicts change nothing."""
    return table.unionByName(new_rows(table, incoming, key, order).select(*table.columns))


def get_or_create_vendors(vendors: DataFrame, batch: DataFrame, order: Column) -> DataFrame:
    """Vendors after the batch, by exact tax number. Existing rows stay as they are."""
    incoming = batch.withColumn("id", natural_id("nit").cast(vendors.schema["id"].dataType)) if "id" not in batch.columns else batch
    return insert_if_absent(vendors, incoming, ["nit"], order)


def get_or_create_manufacturers(manufacturers: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manufacturers after the batch (exact name) and the items with ``manufacturer_id``.

    A new manufacturer's id is made from its name, so the items meet the known ones only and are not read for their names first.
    """
    names = items.where(F.col("manufacturer_name").isNotNull()).select(F.col("manufacturer_name").alias("name")).distinct()
    created = names.join(manufacturers, "name", "left_anti").withColumn("id", natural_id("name"))
    dim = manufacturers.unionByName(created.select(*manufacturers.columns))
    kind = dim.schema["id"].dataType
    ids = manufacturers.select(F.col("id").cast(kind).alias("_known_id"), F.col("name").alias("manufacturer_name"), F.lit(True).alias("_known"))
    made = F.when(F.col("manufacturer_name").isNotNull(), natural_id("manufacturer_name").cast(kind))
    mapped = lookup_hot(items, ids, "manufacturer_name").withColumn(
        "manufacturer_id", F.when(F.col("_known"), F.col("_known_id")).otherwise(made))
    return dim, mapped.drop("_known", "_known_id")


def upsert_products(products: DataFrame, incoming: DataFrame, order: Column, as_of=None) -> DataFrame:
    """Products after an upsert on ``master_sku``: the batch's last row wins.

    With ``as_of``, a changed or new row gets it as ``updated_at``.
    """
    last = _one_per_key(incoming, ["master_sku"], order, last=True)
    fields = [c for c in ("master_name", "category", "unit") if c in incoming.columns]
    touched = F.struct(*[F.col(f"n.{c}") for c in fields])
    before = F.struct(*[F.col(f"o.{c}") for c in fields])
    hit = F.col("n.master_sku").isNotNull()
    columns = [F.coalesce("o.master_sku", "n.master_sku").alias("master_sku")]
    columns += [F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields]
    id_type = products.schema["id"].dataType
    columns += [F.coalesce(F.col("o.id"), natural_id("n.master_sku").cast(id_type)).alias("id")]
    if as_of is not None:
        changed = hit & ~before.eqNullSafe(touched)
        old = F.col("o.updated_at") if "updated_at" in products.columns else F.lit(None).cast("timestamp")
        columns += [F.when(changed, F.lit(as_of).cast("timestamp")).otherwise(old).alias("updated_at")]
    return products.alias("o").join(last.alias("n"), F.col("o.master_sku") == F.col("n.master_sku"), "full_outer").select(*columns)


def apply_corrections(invoices: DataFrame, corrections: DataFrame, fields: Sequence[str], order: Column) -> DataFrame:
    """Invoices after manual validation.

    ``corrections`` has ``invoice_id``, ``validated``, ``validated_by`` and any of
    ``fields``; the last request per invoice counts and null means "keep".
    """
    last = _one_per_key(corrections, ["invoice_id"], order, last=True)
    given = [f for f in fields if f in corrections.columns]
    joined = invoices.alias("i").join(last.alias("c"), F.col("i.id") == F.col("c.invoice_id"), "left")
    out = [
        (F.coalesce(f"c.{c}", f"i.{c}") if c in given else F.col(f"i.{c}")).alias(c)
        for c in invoices.columns if c not in ("validated", "validated_by")
    ]
    old = F.col("i.validated") if "validated" in invoices.columns else F.lit(False)
    by = F.col("i.validated_by") if "validated_by" in invoices.columns else F.lit(None).cast("string")
    return joined.select(*out, F.coalesce("c.validated", old).alias("validated"),
                         F.coalesce("c.validated_by", by).alias("validated_by"))


# ---- records to rows -----------------------------------------------------


def invoice_headers(records: DataFrame) -> DataFrame:
    """Invoice rows from accepted records. A subtotal or tax of 0 becomes null.

    The path and the text of the source are kept where the records have them.
    """
    source = [F.col(c) for c in ("source_file_path", "raw_ocr_text") if c in records.columns]
    return records.select(
        natural_id("vendor_id", "invoice_number").alias("id"),
        "invoice_number", "vendor_id", "store_id", "invoice_date", "due_date",
        F.nullif("subtotal", F.lit(0.0)).alias("subtotal"),
        F.nullif("tax", F.lit(0.0)).alias("tax"),
        "total",
        F.col("file_id").alias("source_file_id"), *source,
        F.col("confidence").alias("confidence_score"),
        F.lit("processed").alias("processing_status"),
        F.to_json(F.struct("vendor", "store", "items"), {"ignoreNullFields": "false"}).alias("structured_data"),
    )


def invoice_items(records: DataFrame) -> DataFrame:
    """Item rows in array order, with the manufacturer split off the name."""
    lines = records.select("invoice_id", F.posexplode("items").alias("pos", "item"))
    return lines.select(
        natural_id("invoice_id", "pos").alias("id"),
        "invoice_id",
        F.col("item.product_name").alias("vendor_product_name"),
        F.col("item.sku").alias("vendor_sku"),
        F.col("item.quantity").alias("quantity"),
        F.col("item.unit_price").alias("unit_price"),
        F.col("item.line_total").alias("line_total"),
        (F.col("pos") + 1).alias("line_number"),
        F.lit(False).alias("matched"),
        F.inline(manufacturer_row(F.col("item.product_name"))),
    )


@dataclass
class Ingested:
    """What one batch adds, and one status row per file."""

    vendors: DataFrame
    invoices: DataFrame
    items: DataFrame
    status: DataFrame
    manufacturers: DataFrame | None = None


def ingest(
    batch: DataFrame, vendors: DataFrame, stores: DataFrame, invoices: DataFrame, manufacturers: DataFrame | None = None
) -> Ingested:
    """Parse, reject, score, check and load one batch of ``(file_id, extraction)``.

    ``vendors`` (id, nit) and ``invoices`` (vendor_id, invoice_number) are the
    tables so far; ``stores`` serves the name lookup. The first record of an invoice
    wins, within the batch and against the table: by ``received_at`` if the batch has
    it, then by file id; null ids come last and each such record counts for itself.
    With ``manufacturers`` (id, name) items get a ``manufacturer_id`` and the result
    the names that are new. The batch is parsed once and kept in the checkpoint
    folder, without the texts it was parsed from; the frames read it from there.
    """
    return load_parsed(keep_records(check_batch(batch)), vendors, stores, invoices, manufacturers)


#: Columns of checked records that loading reads; the last four only some batches have.
RECORD = ("file_id", "vendor", "store", "invoice_number", "invoice_date", "due_date", "items", "subtotal", "tax", "total", "confidence",
          "reject_reason", "warnings", "received_at", "source_file_path", "raw_ocr_text", FIRST)


def keep_records(checked: DataFrame) -> DataFrame:
    """Checked records with a row number, kept as files of the columns that loading reads."""
    return kept(checked.select(*[c for c in RECORD if c in checked.columns], F.monotonically_increasing_id().alias(ROW)))


def check_batch(batch: DataFrame) -> DataFrame:
    """Parsed records of a batch with reject reason, confidence and warnings.

    With ``raw_ocr_text`` in the batch, a text that is too short to extract from is the first reason.
    """
    checked = invoice_warnings(parse_extractions(batch))
    if "raw_ocr_text" not in batch.columns:
        return checked
    short = F.when(~F.coalesce(text_guard(F.col("raw_ocr_text")), F.lit(False)), "text_too_short")
    return checked.withColumn("reject_reason", F.coalesce(short, "reject_reason"))


def load_parsed(
    parsed: DataFrame, vendors: DataFrame, stores: DataFrame, invoices: DataFrame | None, manufacturers: DataFrame | None = None
) -> Ingested:
    """:func:`ingest` from checked records.

    With a column ``FIRST`` in them, it says which records load their invoice, and ``invoices`` is not read.
    """
    if ROW not in parsed.columns:
        parsed = keep_records(parsed)
    arrival = [F.col("received_at").isNull(), F.col("received_at")] if "received_at" in parsed.columns else []
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate([*arrival, F.col("file_id").isNull(), F.col("file_id"), F.col(ROW)])))
    good = parsed.where(F.col("reject_reason").isNull()).withColumns({"nit": F.col("vendor.nit"), "_store": F.col("store.name"), "_at": order})
    # the row number in ``_at`` differs in all rows, so its least is that of one record
    first = F.min(F.struct("_at", *[F.col(f"vendor.{c}").alias(c) for c in ("name", "address", "phone")])).alias("_v")
    created = good.groupBy("nit").agg(first).join(vendors.select("nit"), "nit", "left_anti").select(
        "nit", "_v.name", "_v.address", "_v.phone").withColumn("id", natural_id("nit"))
    # winners are found by keys and row numbers alone; of the records, what a result needs meets them once, by row number
    ids = vendors.select(F.col("id").alias("_id"), "nit", F.lit(True).alias("_known"))
    with_vendor = lambda df: df.where(F.col("nit").isNotNull()).join(ids, "nit", "left").withColumn(
        "vendor_id", F.when(F.col("_known"), F.col("_id")).otherwise(natural_id("nit")))
    if FIRST in parsed.columns:
        winners = with_vendor(good.where(FIRST).select("nit", ROW, "_store")).select(ROW, "vendor_id", "_store")
    else:
        # keys alone meet the vendors; one reduction, by the key of the table, since few files come twice
        keyed = with_vendor(good.select("nit", "invoice_number", "_at", ROW, "_store"))
        of_invoice = keyed.groupBy("vendor_id", "invoice_number").agg(F.min(F.struct("_at", ROW, "_store")).alias("_w"))
        winners = of_invoice.join(invoices.select("vendor_id", "invoice_number"), ["vendor_id", "invoice_number"], "left_anti").select(
            f"_w.{ROW}", "vendor_id", "_w._store")
    winners = kept(winners)
    found = find_stores(winners.select(F.col("_store").alias("name")), stores)
    placed = lookup(winners, found.select(F.col("name").alias("_store"), "store_id"), "_store", ROW).drop("_store")
    records = good.drop("nit", "_store", "_at")
    status = (
        parsed.select("file_id", "reject_reason", "warnings", "confidence", ROW)
        .join(winners.select(ROW, F.lit(True).alias("_new")), ROW, "left")
        .withColumn("status", F.when(F.col("reject_reason").isNotNull(), "rejected")
                    .when(F.col("_new"), "processed").otherwise("duplicate"))
        .drop("_new", ROW)
    )
    headers = invoice_headers(records.join(placed, ROW))
    items = invoice_items(records.join(winners, ROW).withColumn("invoice_id", natural_id("vendor_id", "invoice_number")))
    if manufacturers is None:
        return Ingested(created, headers, items, status)
    known_makers = manufacturers.select("id", "name")
    after, items = get_or_create_manufacturers(known_makers, items)
    return Ingested(created, headers, items, status, after.join(known_makers.select("name"), "name", "left_anti").select("id", "name"))
