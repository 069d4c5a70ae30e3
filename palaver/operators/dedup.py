"""Duplicate handling: repeats collapse, contradictions are set aside, nothing is guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import durable


def dedup_quarantine(df: DataFrame, key: Sequence[str], digest: str, order: Sequence[str],
                     ) -> tuple[DataFrame, DataFrame]:
    """(kept, conflicts): one row per key whose rows all have one ``digest``; other keys as issues.

    The first row by ``order`` represents a key. One shuffle with map-side aggregation; the state
    per key is constant, so a key that holds a third of all rows costs one row per map task.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    # Both results come from one aggregation, which is written once.
    grouped = durable(df.groupBy(*key).agg(
        F.min(digest).alias("_low"), F.max(digest).alias("_high"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")))
    same = F.col("_low") == F.col("_high")
    kept = grouped.filter(same).select(*key, *[F.col("_row")[c].alias(c) for c in rest])
    conflicts = grouped.filter(~same).select(
        *key, "n_rows", F.lit("DUPLICATE_CONFLICT").alias("code"), F.lit("error").alias("severity"))
    return kept, conflicts


def merged_sources(df: DataFrame, key: Sequence[str], source: Sequence[str]) -> DataFrame:
    """The distinct sources of every key as rows; a list per key could grow without bound."""
    return df.select(*key, *source).distinct()


def dedup_by_content(df: DataFrame, digest: str, order: Sequence[str], source: str) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): one row per content hash with its source count, and the sources as rows."""
    sources = merged_sources(df, [digest], [source])
    rest = [c for c in df.columns if c not in (digest, source)]
    first = df.groupBy(digest).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    counts = sources.groupBy(digest).agg(F.count(F.lit(1)).alias("n_sources"),
                                         F.min(source).alias("first_source"))
    rows = (first.join(counts, digest)
            .select(digest, *[F.col("_row")[c].alias(c) for c in rest], "n_sources", "first_source"))
    return rows, sources


def cross_role_conflicts(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, invalid): message ids used by both roles, or claiming another session, are set aside.

    Expects session_id, message_id, role and claimed_session_id, one row per (session, id, role).
    """
    roles = messages.groupBy("session_id", "message_id").agg(
        (F.count(F.lit(1)) > 1).alias("_shared"))
    flagged = messages.join(roles, ["session_id", "message_id"])
    foreign = F.col("claimed_session_id") != F.col("session_id")
    code = (F.when(foreign, "MESSAGE_SESSION_MISMATCH").when(F.col("_shared"), "EVENT_ID_CONFLICT"))
    tagged = flagged.withColumn("code", code).drop("_shared")
    return tagged.filter(F.col("code").isNull()).drop("code"), tagged.filter(F.col("code").isNotNull())


def dedup_plan_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plan items of a message by item id; a conflicting item disappears with its reasoning."""
    return dedup_quarantine(items, ["session_id", "message_id", "item_id"], "digest", ["entry_index"])
