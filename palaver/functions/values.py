"""Small column rules: status names, epoch times, references and size limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.variant import MAX_SAFE_INTEGER, digits

# Status names of the source and of the bundle.
TOOL_STATUS = {"success": "completed", "failed": "error", "running": "running"}
MESSAGE_STATUS = {"completed": "completed", "in_progress": "running"}


def normalize_status(value: Column, names: Mapping[str, str] = TOOL_STATUS) -> Column:
    """The bundle's name of a source status, ``unknown`` for anything else."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit("unknown"))


def to_epoch_ms(value: Column, unit: str = "ms") -> Column:
    """Milliseconds since the epoch from digits; with ``ms`` also from ISO text. Else NULL."""
    number = digits(value.cast("string"))
    if unit == "s":
        return F.when(number <= MAX_SAFE_INTEGER // 1000, number * 1000)
    iso = F.when(~value.cast("string").rlike(r"^[0-9]+$"),
                 F.unix_millis(F.try_to_timestamp(value.cast("string"))))
    return F.coalesce(number, F.when(iso >= 0, iso))


def distinct_refs(refs: Column) -> Column:
    """References without repeats, ordered by the hash of their JSON text."""
    hashed = F.transform(refs, lambda r: F.struct(F.sha2(F.to_json(r), 256).alias("h"), r.alias("r")))
    return F.transform(F.array_sort(F.array_distinct(hashed)), lambda x: x["r"])


def verified_refs_only(refs: Column, session_id: Column, profile_id: str, profile_version: int,
                       prefix: str = "runtime:getMessages#") -> Column:
    """True when there is a reference and all point into the session through the verified profile."""
    def good(ref: Column) -> Column:
        return F.coalesce(
            (ref["session_id"] == session_id) & (ref["profile"]["id"] == profile_id)
            & (ref["profile"]["version"] == profile_version)
            & (ref["locator"]["type"] == "runtime-field")
            & F.startswith(ref["locator"]["value"], F.lit(prefix)), F.lit(False))
    return F.coalesce(F.size(refs) > 0, F.lit(False)) & F.coalesce(F.forall(refs, good), F.lit(False))


def within_size(json_text: Column, max_bytes: int) -> Column:
    """False when a payload is over the byte limit; the payload itself is never cut."""
    return F.octet_length(json_text) <= F.lit(max_bytes)


GRADES = ("complete", "partial", "metadata-only", "unrecoverable")


def parse_grades(grades: Sequence[str] | str | None = None) -> list[str]:
    """The recovery grades to keep; an unknown or empty list is an error."""
    if grades is None:
        return ["complete", "partial"]
    wanted = grades.split(",") if isinstance(grades, str) else list(grades)
    if not wanted or any(g not in GRADES for g in wanted):
        raise ValueError("INVALID_ARGUMENTS: unknown recovery grade")
    return list(dict.fromkeys(wanted))
