from datetime import date

import pytest
from pyspark.sql import functions as F

from cuadre.functions import text
from cuadre.functions.manufacturer import extract_manufacturer


def test_normalize_name(column):
    got = column(lambda d: text.normalize_name(d.a), ["Café  100-20 ®", " \tA  B\n", "", None, "a b c", "--"])
    assert got == ["caf 10020", "a b", "", None, "a b c", ""]


@pytest.mark.parametrize("name, maker, clean, prefix", [
    ("Tiramisu | Bindi Foods 500", "Bindi Foods", "Tiramisu", "Bindi Foods 500"),
    ("Cake | Bindi | 123", "Bindi", "Cake", "Bindi"),
    ("Bindi | 123", "Bindi", "", "Bindi"),
    ("Cake | 12 | Gran Sabor De Casa", "Gran Sabor De", "Cake | 12", "Gran Sabor De Casa"),
    ("cake | 12 (Bridor)", "Bridor", "cake | 12", "Bridor"),
    ("Croissant (Bridor)", "Bridor", "Croissant", "Bridor"),
    ("Bread - Frozen", None, "Bread - Frozen", None),
    ("Coffee - Lavazza", "Lavazza", "Coffee", "Lavazza"),
    (" Coffee-Lavazza ", None, "Coffee-Lavazza", None),
    ("  ", None, "  ", None),
    (None, None, None, None),
])
def test_manufacturer(column, name, maker, clean, prefix):
    got = column(lambda d: extract_manufacturer(d.a), [name])[0]
    assert (got.manufacturer_name, got.product_name_clean, got.manufacturer_prefix) == (maker, clean, prefix)


def test_effective_name(column):
    got = column(lambda d: text.effective_name(d.a, d.b), [("x", "y"), ("", "y"), (None, "y")], "a string, b string")
    assert got == ["x", "y", "y"]


def test_date_parts(column):
    got = column(lambda d: F.struct(*[c.alias(n) for n, c in text.date_parts(d.a).items()]), [date(2024, 12, 30)], "a date")[0]
    assert got.asDict() == {"date": "2024-12-30", "week": 1, "month_name": "December", "month": 12, "quarter": "Q4",
                            "year": 2024, "iso_year": 2025}


def test_scores(column):
    assert column(lambda d: text.confidence_pct(d.a), [0.925, 0.5, 1.0, 0.935], "a double") == ["92%", "50%", "100%", "94%"]
    got = column(lambda d: text.ocr_confidence(d.a, d.b), [("end_turn", 500), ("max_tokens", 4096), ("end_turn", 10)],
                 "a string, b int")
    assert got == pytest.approx([0.95, 0.75, 0.80])
    assert column(lambda d: text.confidence_route(d.a), [0.95, 0.8, 0.74], "a double") == [
        "auto_approve", "standard", "manual_review"]


def test_nit_and_guard(column):
    assert column(lambda d: text.nit_valid(d.a), ["900123456-7", "900123456", "12345678-9", "1234567890-1", None]) == [
        True, False, False, True, False]
    assert column(lambda d: text.text_guard(d.a), ["  123456789 \n", "1234567890", None]) == [False, True, False]


def test_files(column):
    assert column(lambda d: text.media_type(d.a), ["a.JPG", "x/b.webp", "c.pdf", "none"]) == [
        "image/jpeg", "image/webp", None, None]
    got = column(lambda d: text.file_accepted(d.a, d.b), [("a.PDF", 10), ("a.pdf", 11 * 1024 * 1024), ("a.webp", 1)],
                 "a string, b bigint")
    assert got == [True, False, False]


def test_store_code_base(column):
    assert column(lambda d: text.store_code_base(d.a), ["Tienda Norte-2", "a-b"]) == ["TIENDA_NOR", "A_B"]
