"""Referential, order, time and graph checks over the bundle tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.graph import parent_cycles
from palaver.operators.ordered import previous_value
from palaver.operators.refs import link_replies, missing_refs


def check_strict_order(events: DataFrame) -> DataFrame:
    """Events whose order is not above that of the array element before (not a running maximum)."""
    return (previous_value(events, ["session_id"], "pos", "ord", "previous_ord")
            .filter(F.col("ord") <= F.coalesce("previous_ord", F.lit(-1))))


def check_unique(df: DataFrame, scope: Sequence[str], key: str) -> DataFrame:
    """(scope, key) values that occur more than once, with their number."""
    return (df.groupBy(*scope, key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def check_times(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose end precedes their start; both must be known."""
    return df.filter(F.col(end) < F.col(start))


def check_provenance(df: DataFrame) -> DataFrame:
    """Rows with a reference into another session."""
    return df.filter(F.exists("refs", lambda r: r["session_id"].isNotNull()
                              & (r["session_id"] != F.col("session_id"))))


def _diagnostic(rows: DataFrame, code: str, refs: Column) -> DataFrame:
    rows = rows.select("session_id", refs.alias("refs"))
    ident = F.to_json(F.struct(F.lit(code).alias("code"), F.col("session_id").alias("source_id"), "refs"))
    return rows.select(
        F.concat(F.lit("sha256:"), F.sha2(ident, 256)).alias("id"), F.lit("error").alias("severity"),
        F.lit(code).alias("code"), F.lit("session").alias("subject_type"),
        F.col("session_id").alias("subject_id"), "refs")


def check_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """All checks as diagnostics with ids that follow from their content, unique by id.

    Tables: projects(project_id), sessions(session_id, project_id, parent_id, created_at,
    updated_at, refs), events(session_id, pos, event_id, type, ord, created_at, completed_at,
    reply_to, refs), blocks(session_id, event_id, pos, type, call_id, created_at, completed_at,
    refs), resources(session_id, resource_id).
    """
    sessions, events = tables["sessions"], tables["events"]
    blocks, resources = tables["blocks"], tables["resources"]
    refs = F.col("refs")
    own = sessions.select("session_id", "refs")

    def of_session(ids: DataFrame, code: str) -> DataFrame:
        return _diagnostic(own.join(ids.select("session_id").distinct(), "session_id", "left_semi"), code, refs)

    def of_event(ids: DataFrame, code: str) -> DataFrame:
        keys = ids.select("session_id", "event_id").distinct()
        rows = events.filter("type = 'assistant'").join(keys, ["session_id", "event_id"], "left_semi")
        return _diagnostic(rows, code, refs)
    found = [
        of_session(check_unique(sessions, [], "session_id"), "SESSION_ID_CONFLICT"),
        of_session(missing_refs(sessions, tables["projects"], "project_id", "project_id"),
                   "PROJECT_REFERENCE_MISSING"),
        of_session(missing_refs(sessions, sessions, "parent_id", "session_id"), "PARENT_REFERENCE_MISSING"),
        of_session(parent_cycles(sessions), "PARENT_CYCLE"),
        of_session(check_times(sessions, "created_at", "updated_at"), "SESSION_TIME_INVALID"),
        of_session(check_unique(events, ["session_id"], "event_id"), "EVENT_ID_CONFLICT"),
        of_session(check_unique(resources, ["session_id"], "resource_id"), "RESOURCE_ID_CONFLICT"),
        _diagnostic(check_strict_order(events), "EVENT_ORDER_CONFLICT", refs),
        _diagnostic(check_provenance(events), "EVENT_SOURCE_MISMATCH", refs),
        _diagnostic(link_replies(events).filter("NOT reply_ok"), "REPLY_REFERENCE_INVALID", refs),
        _diagnostic(check_times(events.filter("type = 'assistant'"), "created_at", "completed_at"),
                    "EVENT_TIME_INVALID", refs),
        of_event(check_times(blocks, "created_at", "completed_at"), "CONTENT_TIME_INVALID"),
        of_event(check_provenance(blocks), "CONTENT_SOURCE_MISMATCH"),
        of_event(check_unique(blocks.filter("type = 'tool'"), ["session_id", "event_id"], "call_id"),
                 "TOOL_ID_CONFLICT"),
    ]
    repeated_projects = (check_unique(tables["projects"], [], "project_id").limit(1).select(
        F.concat(F.lit("sha256:"), F.sha2(F.lit("PROJECT_ID_CONFLICT"), 256)).alias("id"),
        F.lit("error").alias("severity"), F.lit("PROJECT_ID_CONFLICT").alias("code"),
        F.lit("bundle").alias("subject_type"), F.lit(None).cast("string").alias("subject_id"),
        F.array().cast(sessions.schema["refs"].dataType).alias("refs")))
    result = repeated_projects
    for part in found:
        result = result.unionByName(part)
    return result.dropDuplicates(["id"])
