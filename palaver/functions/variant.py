"""Strictly typed reads from VARIANT: a value of another JSON kind is NULL, never converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SAFE_INTEGER = 9_007_199_254_740_991


def field(v: Column, path: str) -> Column:
    """The member at ``path`` as VARIANT: NULL when absent, a variant null when JSON null."""
    return F.try_variant_get(v, path, "variant")


def is_absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def text(v: Column) -> Column:
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def obj(v: Column) -> Column:
    """The variant itself when it is a JSON object."""
    return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), v)


def array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def boolean(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def is_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.lit(False))


def json_text(v: Column) -> Column:
    return F.to_json(v)


def safe_integer(v: Column) -> Column:
    """A JSON number that is a whole number in [0, 2^53 - 1]."""
    number = F.when(is_number(v), F.try_variant_get(v, "$", "double"))
    whole = (number == F.floor(number)) & (number >= 0) & (number <= F.lit(float(MAX_SAFE_INTEGER)))
    return F.when(whole, number.cast("bigint"))


def integer_or_digits(v: Column) -> Column:
    """As ``safe_integer``, also from a string of decimal digits."""
    return F.coalesce(safe_integer(v), digits(text(v)))


def digits(value: Column) -> Column:
    parsed = F.when(value.rlike(r"^[0-9]+$"),
                    F.regexp_replace(value, r"^0+(?=[0-9])", "").try_cast("bigint"))
    return F.when(parsed <= MAX_SAFE_INTEGER, parsed)
