"""Text measures and the policies for publishing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.credentials import redact_or_mask


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def split_offset(text: Column, start: Column) -> Column:
    """Bytes (0 to 3) from byte ``start`` (0-based) to the next character boundary."""
    window = F.hex(F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, F.lit(3)))
    continuation = F.regexp_extract(window, r"^((?:[89AB][0-9A-F]){0,3})", 1)
    return (F.length(continuation) / 2).cast("int")


def utf8_tail(text: Column, limit: int | Column) -> Column:
    """The longest suffix of whole characters that fits in ``limit`` bytes."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    size = F.octet_length(text)
    start = size - limit
    offset = start + split_offset(text, start)
    raw = F.substring(F.encode(text, "UTF-8"), offset.cast("int") + 1, size.cast("int"))
    return F.when(size <= limit, text).otherwise(F.decode(raw, "UTF-8"))


def session_label(title: Column, placeholder: str = "Untitled session") -> Column:
    """One line: white space collapsed, a blank title replaced."""
    flat = F.trim(F.regexp_replace(title, r"\s+", " "))
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit(placeholder))


# Context keys that may be published.
SAFE_CONTEXT_KEYS = (
    "command", "count", "diagnosticId", "diagnosticIds", "exitCode", "instancePath", "keyword",
    "operation", "productVersion", "profileId", "recovery", "schemaPath", "sourceKind", "status",
)
ABSOLUTE_PATH = r"""(?:^|[\s"'(])(?:/Users/|/home/|[A-Za-z]:[\\/])"""
MAX_CONTEXT_CHARS = 256
MAX_CONTEXT_ITEMS = 20


def safe_scalar(value: Column) -> Column:
    """A string fit for a log: credentials and absolute paths masked, long text cut with a note."""
    masked = redact_or_mask(value)
    return (F.when(value.isNull(), F.lit(None).cast("string"))
            .when(masked != value, masked)
            .when(value.rlike(ABSOLUTE_PATH), F.lit("[REDACTED_PATH]"))
            .when(F.length(value) > MAX_CONTEXT_CHARS,
                  F.concat(F.substring(value, 1, MAX_CONTEXT_CHARS), F.lit("...[TRUNCATED]")))
            .otherwise(value))


def sanitize_context(context: Column) -> Column:
    """A map<string,string> in which only allow-listed keys keep a (safe) value, keys sorted."""
    def clean(entry: Column) -> Column:
        allowed = entry["key"].isin(*SAFE_CONTEXT_KEYS)
        return F.struct(
            F.when(allowed, entry["key"]).otherwise(safe_scalar(entry["key"])).alias("key"),
            F.when(allowed, safe_scalar(entry["value"])).otherwise(F.lit("[REDACTED]")).alias("value"))
    entries = F.array_sort(F.map_entries(context),
                           lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1)
                           .otherwise(0))
    return F.transform(entries, clean)


def sanitize_items(values: Column) -> Column:
    """An array value of an allowed key: at most 20 safe items."""
    return F.transform(F.slice(values, 1, MAX_CONTEXT_ITEMS), safe_scalar)


# What published evidence must never contain.
FORBIDDEN_EVIDENCE = (
    r"""/Users/|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"""
    r"""|"(?:message_id|turn_id|reply_to_message_id|params|result)"\s*:"""
)


def value_evidence(value: Column) -> Column:
    """Hash, length and non-empty flag in place of a value."""
    return F.struct(
        F.concat(F.lit("sha256:"), F.sha2(value, 256)).alias("sha256"),
        F.length(value).cast("bigint").alias("chars"),
        (F.trim(value) != "").alias("non_empty"))


def leaks_private_values(json_text: Column) -> Column:
    return json_text.rlike(FORBIDDEN_EVIDENCE)
