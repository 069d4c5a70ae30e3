"""Row validation against a rule table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``check`` must be true (NULL counts as true: an absent optional field is valid)."""

    path: str
    keyword: str
    check: Column
    message: str = "Value does not satisfy the schema."


def required(column: str) -> Rule:
    return Rule(column, "required", F.col(column).isNotNull(), "Required field is missing.")


def non_empty(column: str) -> Rule:
    return Rule(column, "minLength", F.col(column) != "")


def one_of(column: str, values: Sequence[str]) -> Rule:
    return Rule(column, "enum", F.col(column).isin(*values))


def matches(column: str, pattern: str) -> Rule:
    return Rule(column, "pattern", F.col(column).rlike(pattern))


def minimum(column: str, least: int) -> Rule:
    return Rule(column, "minimum", F.col(column) >= least)


def min_items(column: str, least: int) -> Rule:
    return Rule(column, "minItems", F.size(column) >= least)


def closed(column: str, allowed: Sequence[str]) -> Rule:
    """No member of the VARIANT object ``column`` outside ``allowed``."""
    keys = F.map_keys(F.try_variant_get(F.col(column), "$", "map<string,variant>"))
    extra = F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))
    return Rule(column, "additionalProperties", F.size(extra) == 0, "Unknown field.")


def exactly_one(path: str, checks: Sequence[Column]) -> Rule:
    """oneOf: exactly one alternative holds."""
    hits = sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in checks), F.lit(0))
    return Rule(path, "oneOf", hits == 1)


def validate_rows(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """One issue row per broken rule (keys, path, keyword, message); values are never repeated."""
    broken = F.array(*[F.when(~F.coalesce(r.check, F.lit(True)), F.struct(
        F.lit(r.path).alias("path"), F.lit(r.keyword).alias("keyword"), F.lit(r.message).alias("message")))
        for r in rules])
    return (df.select(*keys, F.explode(F.filter(broken, lambda i: i.isNotNull())).alias("i"))
            .select(*keys, "i.*"))


SHA256 = r"^sha256:[a-f0-9]{64}$"
# Enumerations of the bundle.
RECOVERY = ("complete", "partial", "metadata-only", "unrecoverable")
TOOL_STATES = ("running", "streaming", "completed", "error", "unknown")
EVENT_STATES = ("completed", "running", "error", "unknown")
RESOURCE_TYPES = ("attachment", "file", "image", "long-text", "unknown")
AVAILABILITY = ("available", "missing", "deferred")
SEVERITY = ("info", "warning", "error")
SUBJECTS = ("bundle", "project", "session", "event", "resource")


def bundle_rules() -> Mapping[str, Sequence[Rule]]:
    """The shape rules of every bundle table."""
    c = F.col
    user, assistant, tool = c("type") == "user", c("type") == "assistant", c("type") == "tool"
    return {
        "projects": [required("project_id"), non_empty("project_id"), non_empty("path"), required("refs")],
        "sessions": [required("session_id"), non_empty("session_id"), non_empty("title"),
                     non_empty("project_id"), non_empty("project_path"), non_empty("parent_id"),
                     minimum("created_at", 0), minimum("updated_at", 0),
                     required("recovery"), one_of("recovery", RECOVERY), required("refs")],
        "events": [required("event_id"), non_empty("event_id"), required("ord"), minimum("ord", 0),
                   minimum("created_at", 0), minimum("completed_at", 0), non_empty("turn_id"),
                   non_empty("reply_to"), required("type"), one_of("type", ("user", "assistant")),
                   Rule("text", "required", ~user | c("text").isNotNull(), "Required field is missing."),
                   Rule("status", "required", ~assistant | c("status").isNotNull(), "Required field is missing."),
                   Rule("status", "enum", ~assistant | c("status").isin(*EVENT_STATES)),
                   Rule("completed_at", "additionalProperties", ~user | c("completed_at").isNull(), "Unknown field."),
                   Rule("status", "additionalProperties", ~user | c("status").isNull(), "Unknown field."),
                   required("refs")],
        "blocks": [required("type"), one_of("type", ("text", "reasoning", "tool")),
                   minimum("created_at", 0), minimum("completed_at", 0), required("refs"),
                   exactly_one("type", [
                       ~tool & c("text").isNotNull() & c("call_id").isNull() & c("name").isNull()
                       & c("input").isNull() & c("status").isNull(),
                       tool & (c("call_id") != "") & (c("name") != "") & c("input").isNotNull()
                       & c("status").isin(*TOOL_STATES) & c("text").isNull()])],
        "resources": [required("resource_id"), non_empty("resource_id"), required("type"),
                      one_of("type", RESOURCE_TYPES), required("availability"),
                      one_of("availability", AVAILABILITY), non_empty("relative_path"),
                      non_empty("mime_type"), matches("sha256", SHA256), minimum("size_bytes", 0)],
        "diagnostics": [required("id"), non_empty("id"), required("severity"), one_of("severity", SEVERITY),
                        required("code"), matches("code", r"^[A-Z][A-Z0-9_]*$"),
                        one_of("subject_type", SUBJECTS), non_empty("subject_id")],
    }
