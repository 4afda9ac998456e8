"""Manufacturer extraction from an invoice product name, as one native expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cuadre.functions.text import strip

# The patterns of the three rules. A name is one to three capitalized words.
_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
LEADING = rf"^({_NAME})"
IN_PARENS = rf"\(({_NAME})\)\s*$"
AFTER_DASH = rf"\s+-\s+({_NAME})\s*$"
PARENS = r"\s*\([^)]+\)\s*$"

# Words after a dash that describe the product, not its maker.
DESCRIPTIVE_WORDS = ["frozen", "fresh", "organic", "whole", "sliced", "usa", "italy"]


def extract_manufacturer(name: Column) -> Column:
    """Struct ``(manufacturer_name, product_name_clean, manufacturer_prefix)``.

    Tried in order: a ``|`` segment that starts with a capitalized name (the
    rightmost such segment wins and everything left of it is the product), a
    name in parentheses at the end, a name after a spaced dash at the end.
    """
    return F.element_at(manufacturer_row(name), 1)


def manufacturer_row(name: Column) -> Column:
    """:func:`extract_manufacturer` as a one-element array, ready for ``inline``.

    The lambda over the one-element array binds the costly matches to a
    variable, so each of them is computed once.
    """
    segments = F.transform(F.split(name, r"\|"), lambda part, i: F.struct(i.alias("at"), strip(part).alias("text")))
    hits = F.filter(segments, lambda segment: segment["text"].rlike(LEADING))
    matches = F.struct(
        strip(name).alias("stripped"),
        F.when(F.contains(name, F.lit("|")), F.try_element_at(hits, F.lit(-1))).alias("segment"),
        F.nullif(F.regexp_extract(name, IN_PARENS, 1), F.lit("")).alias("in_parens"),
        F.nullif(F.regexp_extract(name, AFTER_DASH, 1), F.lit("")).alias("after_dash"),
    )
    return F.transform(F.array(matches), lambda found: _decide(name, found))


def _decide(name: Column, found: Column) -> Column:
    segment, in_parens, after_dash = found["segment"], found["in_parens"], found["after_dash"]
    nothing = F.lit(None).cast("string")

    def row(maker: Column, clean: Column, prefix: Column) -> Column:
        return F.struct(maker.alias("manufacturer_name"), clean.alias("product_name_clean"),
                        prefix.alias("manufacturer_prefix"))

    before = F.array_join(F.slice(F.split(name, r"\|"), F.lit(1), segment["at"]), "|")
    return (
        F.when(name.isNull() | (found["stripped"] == ""), row(nothing, name, nothing))
        .when(segment.isNotNull(), row(F.regexp_extract(segment["text"], LEADING, 1), strip(before), segment["text"]))
        .when(in_parens.isNotNull(),
              row(in_parens, strip(F.regexp_replace(name, PARENS, "")), in_parens))
        .when(after_dash.isNotNull() & ~F.lower(after_dash).isin(DESCRIPTIVE_WORDS),
              row(after_dash, strip(F.regexp_replace(name, AFTER_DASH, "")), after_dash))
        .otherwise(row(nothing, found["stripped"], nothing))
    )
