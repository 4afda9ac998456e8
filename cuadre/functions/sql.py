"""The functions for SQL text: ``register(spark)`` makes them temporary functions of the session.

Each is a SQL expression, so Spark puts it into the caller's plan and generates code for it. The
patterns are those of the column functions; tests compare both.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cuadre.functions import manufacturer as maker, text

_EDGES = rf"(?U)^{text.SPACE}+|{text.SPACE}+$"

AMOUNTS = ("quantity", "unit_price", "line_total")
ITEM_LIST = "ARRAY<STRUCT<product_name STRING, sku STRING, quantity DOUBLE, unit_price DOUBLE, line_total DOUBLE>>"


def _strip(value: str) -> str:
    """In place: lambda functions cannot pass their variables to a SQL function."""
    return f"regexp_replace({value}, r'{_EDGES}', '')"


def _number(value: str) -> str:
    return f"CASE WHEN {value} RLIKE r'{text.NUMBER}' THEN try_cast(trim({value}) AS DOUBLE) END"


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _maker(name: str, clean: str, prefix: str) -> str:
    return f"named_struct('manufacturer_name', {name}, 'product_name_clean', {clean}, 'manufacturer_prefix', {prefix})"


def statements() -> list[str]:
    """The functions in the order in which they need one another."""
    media = ", ".join(f"'{ext}', '{kind}'" for ext, kind in text.MEDIA_TYPES.items())
    segment = f"try_element_at(filter(transform(split(name, r'\\|'), (part, i) -> struct(i AS at, {_strip('part')} AS text)), s -> s.text RLIKE r'{maker.LEADING}'), -1)"
    scalar = {
        "cuadre_strip(value STRING) RETURNS STRING": _strip("value"),
        "cuadre_normalize_name(name STRING) RETURNS STRING":
            rf"trim(regexp_replace(regexp_replace(lower(name), r'{text.NOT_KEPT}', ''), r'(?U){text.SPACE}+', ' '))",
        "cuadre_effective_name(clean STRING, raw STRING) RETURNS STRING": "coalesce(nullif(clean, ''), raw)",
        "cuadre_confidence_pct(score DOUBLE) RETURNS STRING": "concat(CAST(CAST(bround(score * 100, 0) AS INT) AS STRING), '%')",
        "cuadre_nit_valid(nit STRING) RETURNS BOOLEAN": rf"coalesce(nit RLIKE r'{text.NIT}', false)",
        "cuadre_text_guard(value STRING) RETURNS BOOLEAN": f"coalesce(length(cuadre_strip(value)) >= {text.MIN_CHARS}, false)",
        "cuadre_store_code_base(name STRING) RETURNS STRING": "translate(upper(substring(name, 1, 10)), ' -', '__')",
        "cuadre_file_extension(path STRING) RETURNS STRING": rf"lower(regexp_extract(path, r'{text.EXTENSION}', 1))",
        "cuadre_media_type(path STRING) RETURNS STRING": f"try_element_at(map({media}), cuadre_file_extension(path))",
        "cuadre_file_accepted(path STRING, size BIGINT) RETURNS BOOLEAN":
            f"cuadre_file_extension(path) IN ({_quoted(text.INVOICE_EXTENSIONS)}) AND size <= {text.MAX_FILE_BYTES}",
        "cuadre_number(value STRING) RETURNS DOUBLE": _number("value"),
        # an array, to be inlined around a subquery: a table function over a column would be joined back by a shuffle of the texts
        f"cuadre_salvage_items(items STRING) RETURNS {ITEM_LIST}": f"""
            filter(transform(from_json(items, 'array<map<string,string>>'), i -> CASE WHEN i IS NOT NULL THEN named_struct(
                'product_name', CASE WHEN map_contains_key(i, 'product_name') THEN i['product_name'] ELSE '' END, 'sku', i['sku'],
                {', '.join(f"'{key}', CASE WHEN map_contains_key(i, '{key}') THEN {_number(f"i['{key}']")} ELSE 0D END" for key in AMOUNTS)}) END),
              t -> {' AND '.join(f't.{key} IS NOT NULL' for key in ('product_name', *AMOUNTS))})""",
        "cuadre_manufacturer(name STRING) RETURNS STRUCT<manufacturer_name STRING, product_name_clean STRING, manufacturer_prefix STRING>": rf"""
            element_at(transform(array(struct(
                {_strip('name')} AS stripped, CASE WHEN contains(name, '|') THEN {segment} END AS segment,
                nullif(regexp_extract(name, r'{maker.IN_PARENS}', 1), '') AS in_parens,
                nullif(regexp_extract(name, r'{maker.AFTER_DASH}', 1), '') AS after_dash)), f -> CASE
              WHEN name IS NULL OR f.stripped = '' THEN {_maker('CAST(NULL AS STRING)', 'name', 'CAST(NULL AS STRING)')}
              WHEN f.segment IS NOT NULL THEN {_maker(f"regexp_extract(f.segment.text, r'{maker.LEADING}', 1)",
                                                     _strip("array_join(slice(split(name, r'\\|'), 1, f.segment.at), '|')"), 'f.segment.text')}
              WHEN f.in_parens IS NOT NULL THEN {_maker('f.in_parens', _strip(f"regexp_replace(name, r'{maker.PARENS}', '')"), 'f.in_parens')}
              WHEN f.after_dash IS NOT NULL AND lower(f.after_dash) NOT IN ({_quoted(maker.DESCRIPTIVE_WORDS)})
                THEN {_maker('f.after_dash', _strip(f"regexp_replace(name, r'{maker.AFTER_DASH}', '')"), 'f.after_dash')}
              ELSE {_maker('CAST(NULL AS STRING)', 'f.stripped', 'CAST(NULL AS STRING)')} END), 1)""",
    }
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in scalar.items()]


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark``; calling it again replaces them."""
    for statement in statements():
        spark.sql(statement)
