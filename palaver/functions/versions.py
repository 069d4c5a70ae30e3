"""Release numbers and the layout that belongs to them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the strict release form, with an optional product prefix before it.
_VERSION = r"^(?:[a-z][a-z0-9-]* v?)?([0-9]{1,5}\.[0-9]{1,5}\.[0-9]{1,5}(?:-[a-zA-Z0-9.-]{1,40})?)$"


def parse_version(text: Column) -> Column:
    """``x.y.z`` or ``x.y.z-pre`` after trimming; NULL for any other form."""
    return F.nullif(F.regexp_extract(F.trim(text), _VERSION, 1), F.lit(""))


def version_order(version: Column) -> Column:
    """The three numbers, for numeric ordering."""
    return F.transform(F.split(F.split(version, "-")[0], r"\."), lambda x: x.cast("int"))


@dataclass(frozen=True)
class LayoutRule:
    """One row of the rule list; the first rule whose pattern matches decides."""

    name: str
    layout: str
    pattern: str


# Rules in priority order.
LAYOUT_RULES = (
    LayoutRule("v2-session-transfer", "v2", r"^2\.(0|[1-9][0-9]{0,4})\.(0|[1-9][0-9]{0,4})$"),
    LayoutRule("v2-session-transfer-legacy", "v2", r"^2\.(0|[1-9][0-9]{0,4})\.(0|[1-9][0-9]{0,4})$"),
    LayoutRule("v1-cli-library", "v1", r"^1\.(0|[1-9][0-9]{0,4})\.(0|[1-9][0-9]{0,4})$"),
    LayoutRule("v1-cli-library-legacy", "v1", r"^1\.(0|[1-9][0-9]{0,4})\.(0|[1-9][0-9]{0,4})$"),
)


def pick_layout(version: Column, rules: Sequence[LayoutRule] = LAYOUT_RULES) -> Column:
    """struct(rule, layout) of the first matching rule, NULL without one.

    The rule list is a short parameter, so it becomes one CASE expression and needs no join.
    """
    chosen = F.lit(None).cast("struct<rule:string,layout:string>")
    for rule in reversed(rules):
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.layout).alias("layout"))
        chosen = F.when(version.rlike(rule.pattern), value).otherwise(chosen)
    return chosen
