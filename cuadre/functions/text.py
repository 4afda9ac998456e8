"""Scalar column functions: names, dates, formats, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Unicode white space plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
NOT_KEPT = r"(?U)[^a-z0-9\s\x1c-\x1f]"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
EXTENSION = r"\.([^./]+)$"
# The form of a tax number, the least text worth extracting.
NIT = r"^\d{9,10}-\d$"
MIN_CHARS = 10


def strip(col: Column) -> Column:
    """Trim every kind of white space (``trim`` alone removes only blanks)."""
    return F.regexp_replace(col, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def once(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with costly ``columns`` that are computed once per row.

    A plain projection is copied into every later filter on its columns; the
    one-element ``inline`` stops that, at the price of column pruning.
    """
    kept = [c for c in df.columns if c not in drop and c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def normalize_name(col: Column) -> Column:
    """Lower case, keep only a-z, 0-9 and white space, single blanks, trimmed.

    Accented letters and punctuation are deleted, not replaced.
    """
    kept = F.regexp_replace(F.lower(col), NOT_KEPT, "")
    return F.trim(F.regexp_replace(kept, rf"(?U){SPACE}+", " "))


def effective_name(clean: Column, raw: Column) -> Column:
    """The cleaned product name, or the invoice name when that is null or empty."""
    return F.coalesce(F.nullif(clean, F.lit("")), raw)


def confidence_pct(score: Column) -> Column:
    """``0.925`` -> ``92%`` (half to even)."""
    return F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%"))


def date_parts(day: Column) -> dict[str, Column]:
    """Report date columns. ``year`` is the calendar year, ``iso_year`` goes with ``week``."""
    return {
        "date": F.date_format(day, "yyyy-MM-dd"),
        "week": F.weekofyear(day),
        "month_name": F.date_format(day, "MMMM"),
        "month": F.month(day),
        "quarter": F.concat(F.lit("Q"), F.quarter(day).cast("string")),
        "year": F.year(day),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), day),
    }


def nit_valid(nit: Column) -> Column:
    """Nine or ten digits, dash, one digit. The check digit is not verified."""
    return F.coalesce(nit.rlike(NIT), F.lit(False))


def text_guard(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """True when enough text is left after trimming to be worth extracting."""
    return F.coalesce(F.length(strip(text)) >= min_chars, F.lit(False))


def ocr_confidence(stop_reason: Column, output_tokens: Column, max_tokens: int = 4096) -> Column:
    """Confidence of a text-recognition response from how it ended and how long it is."""
    ended = F.when(stop_reason == "end_turn", 0.05).when(stop_reason == "max_tokens", -0.1).otherwise(0.0)
    size = F.when(output_tokens < 50, -0.15).when(output_tokens > max_tokens * 0.9, -0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.9) + ended + size))


def confidence_route(score: Column, approve: float = 0.95, review: float = 0.75) -> Column:
    return (
        F.when(score >= approve, "auto_approve").when(score < review, "manual_review").otherwise("standard")
    )


def store_code_base(name: Column) -> Column:
    """First ten characters, upper case, blanks and dashes as underscores."""
    return F.translate(F.upper(F.substring(name, 1, 10)), " -", "__")


# File extensions and their media types.
MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif",
}
INVOICE_EXTENSIONS = ["pdf", "jpg", "jpeg", "png"]
MAX_FILE_BYTES = 10 * 1024 * 1024


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, EXTENSION, 1))


def media_type(path: Column) -> Column:
    """Media type of an image path; null marks an unsupported file."""
    pairs = [F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), file_extension(path))


def file_accepted(path: Column, length: Column, extensions: list[str] | None = None) -> Column:
    return file_extension(path).isin(extensions or INVOICE_EXTENSIONS) & (length <= MAX_FILE_BYTES)
