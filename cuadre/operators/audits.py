"""Rule checks over the invoice tables: each adds a flag or lists the rows at fault."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def line_total_check(items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``line_total_ok``: the line total is within 1 % of quantity times unit price."""
    expected = F.col("quantity") * F.col("unit_price")
    off = F.abs(F.col("line_total") - expected) > expected * F.lit(tolerance)
    return items.withColumn("line_total_ok", ~off)


def due_date_check(invoices: DataFrame) -> DataFrame:
    """``due_date_ok``: no due date, or one that is not before the invoice date."""
    return invoices.withColumn(
        "due_date_ok", F.coalesce(F.col("due_date") >= F.col("invoice_date"), F.lit(True)))


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that do not hold, as an array; a null value breaks no rule."""
    return F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))


def item_range_checks(items: DataFrame) -> DataFrame:
    return items.withColumn("range_errors", broken_rules({
        "quantity": F.col("quantity") > 0, "unit_price": F.col("unit_price") >= 0, "line_total": F.col("line_total") >= 0,
    }))


def invoice_range_checks(invoices: DataFrame) -> DataFrame:
    rules = {
        "subtotal": lambda c: c >= 0, "tax": lambda c: c >= 0, "total": lambda c: c > 0,
        "confidence_score": lambda c: c.between(0, 1),
    }
    return invoices.withColumn(
        "range_errors", broken_rules({n: rule(F.col(n)) for n, rule in rules.items() if n in invoices.columns}))


def enum_checks(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """``enum_errors``: columns with a value outside their allowed set."""
    return df.withColumn("enum_errors", broken_rules({c: F.col(c).isin(list(v)) for c, v in allowed.items()}))


# Allowed text lengths.
LENGTHS = {"name": (1, 255), "nit": (9, 20), "code": (1, 50), "sku": (1, 100), "invoice_number": (1, 100)}


def length_checks(df: DataFrame, limits: Mapping[str, tuple[int, int]]) -> DataFrame:
    """``length_errors``: required text columns that are missing, too short or too long."""
    inside = {c: F.coalesce(F.length(c).between(lo, hi), F.lit(False)) for c, (lo, hi) in limits.items()}
    return df.withColumn("length_errors", broken_rules(inside))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphans(children: DataFrame, parents: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    return children.where(F.col(fk).isNotNull()).join(parents.select(F.col(pk).alias(fk)), fk, "left_anti")


def cascade_delete(children: DataFrame, removed: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Children that remain once the ``removed`` parents are gone."""
    return children.join(removed.select(F.col(pk).alias(fk)), fk, "left_anti")
