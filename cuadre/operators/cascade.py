"""Removal of rows along foreign keys, over any number of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cuadre.session import cut


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` names rows of ``parent`` by ``id``. When they go, rows of ``child`` go too
    (``cascade``), lose the value (``set null``) or forbid the removal (``restrict``)."""

    child: str
    column: str
    parent: str
    action: str = "cascade"


# The foreign keys of the invoice tables.
INVOICE_KEYS = (
    ForeignKey("product_mappings", "product_id", "products"),
    ForeignKey("product_mappings", "vendor_id", "vendors"),
    ForeignKey("invoices", "vendor_id", "vendors", "restrict"),
    ForeignKey("invoices", "store_id", "stores", "restrict"),
    ForeignKey("invoice_items", "invoice_id", "invoices"),
    ForeignKey("invoice_items", "product_id", "products", "restrict"),
    ForeignKey("processing_log", "invoice_id", "invoices"),
)


def closure(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey], removed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Ids (``id``) that go from each table once those of ``removed`` go.

    Each round follows only the ids that the round before added, by a semi join of two columns of the
    child, and leaves out what is known already, so cycles of keys end. Rounds are as many as the
    longest chain of rows.
    """
    gone = {t: cut(ids.select("id").where("id IS NOT NULL").distinct()) for t, ids in removed.items()}
    new = dict(gone)
    while new:
        found: dict[str, DataFrame] = {}
        for k in keys:
            if k.action != "cascade" or k.parent not in new or k.child not in tables:
                continue
            hit = tables[k.child].select("id", F.col(k.column).alias("_parent")).join(
                new[k.parent].withColumnRenamed("id", "_parent"), "_parent", "left_semi").select("id")
            found[k.child] = found[k.child].unionByName(hit) if k.child in found else hit
        new = {}
        for t, ids in found.items():
            ids = ids.where("id IS NOT NULL").distinct()
            fresh = cut(ids.join(gone[t], "id", "left_anti") if t in gone else ids)
            if not fresh.isEmpty():
                gone[t] = gone[t].unionByName(fresh) if t in gone else fresh
                new[t] = fresh
    return gone


def remove(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey], removed: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables after the removal, and by "child.column" the rows that forbid it.

    Rows that go themselves forbid nothing. All tables are given back, those without change as they
    are; the caller keeps the old ones if any row forbids the removal.
    """
    gone = closure(tables, keys, removed)
    left = {t: df.join(gone[t], "id", "left_anti").select(*df.columns) if t in gone else df for t, df in tables.items()}
    forbidding = {}
    for k in keys:
        if k.action == "cascade" or k.parent not in gone or k.child not in tables:
            continue
        lost = gone[k.parent].select(F.col("id").alias(k.column), F.lit(True).alias("_lost"))
        if k.action == "restrict":
            forbidding[f"{k.child}.{k.column}"] = left[k.child].join(lost, k.column, "left_semi")
        else:
            kept = left[k.child].join(lost, k.column, "left")
            left[k.child] = kept.withColumn(k.column, F.when(F.col("_lost").isNull(), F.col(k.column))).select(*tables[k.child].columns)
    return left, forbidding
