"""How complete is a session, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.credentials import is_blank
from palaver.functions.values import GRADES
from palaver.operators.refs import with_reply_state


def _blank(text: Column) -> Column:
    return F.coalesce(is_blank(text), F.lit(True))


def session_evidence(events: DataFrame, blocks: DataFrame, invalid: DataFrame | None = None,
                     resources: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Nine counts per session.

    ``blocks`` needs session_id and event_id, ``invalid`` session_id and n_invalid, ``resources``
    session_id and availability, ``expected`` session_id and expected. Sessions come from ``events``
    and ``expected``.
    """
    with_content = (blocks.select("session_id", "event_id").distinct()
                    .withColumn("_content", F.lit(True)))
    rows = with_reply_state(events).join(with_content, ["session_id", "event_id"], "left")
    user, assistant = F.col("type") == "user", F.col("type") == "assistant"
    counts = rows.groupBy("session_id").agg(
        F.count_if(user).alias("user_messages"),
        F.count_if(user & ~_blank(F.col("text"))).alias("user_messages_with_text"),
        F.count_if(assistant).alias("assistant_messages"),
        F.count_if(assistant & F.coalesce("_content", F.lit(False))).alias("assistant_messages_with_content"),
        F.count_if(assistant & F.col("completed_at").isNotNull())
        .alias("assistant_messages_with_completion_time"),
        F.count_if(assistant & F.coalesce("reply_ok", F.lit(False))).alias("assistant_messages_linked_to_user"))
    if expected is not None:
        counts = counts.join(expected.select("session_id", "expected"), "session_id", "full")
    else:
        counts = counts.withColumn("expected", F.lit(None).cast("bigint"))
    if invalid is not None:
        counts = counts.join(invalid.select("session_id", "n_invalid"), "session_id", "left")
    else:
        counts = counts.withColumn("n_invalid", F.lit(0))
    if resources is not None:
        dangling = resources.groupBy("session_id").agg(
            F.count_if(F.col("availability") != "available").alias("n_dangling"))
        counts = counts.join(dangling, "session_id", "left")
    else:
        counts = counts.withColumn("n_dangling", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return counts.select(
        "session_id", F.col("expected").cast("bigint").alias("expected_message_count"),
        *[zero(c).alias(c) for c in (
            "user_messages", "user_messages_with_text", "assistant_messages",
            "assistant_messages_with_content", "assistant_messages_with_completion_time",
            "assistant_messages_linked_to_user")],
        zero("n_invalid").alias("invalid_messages"), zero("n_dangling").alias("dangling_references"))


# The reasons in their reporting order.
REASONS = (
    "PROFILE_UNVERIFIED", "PROFILE_UNSUPPORTED", "METADATA_MISSING", "MESSAGE_SOURCE_UNAVAILABLE",
    "MESSAGE_SOURCE_ERROR", "MESSAGE_COUNT_UNKNOWN", "MESSAGE_COUNT_MISMATCH", "USER_MESSAGES_MISSING",
    "USER_TEXT_MISSING", "ASSISTANT_MESSAGES_MISSING", "ASSISTANT_CONTENT_MISSING",
    "ASSISTANT_COMPLETION_TIME_MISSING", "REPLY_RELATION_MISSING", "INVALID_MESSAGES",
    "DANGLING_REFERENCES", "SOURCE_CORRUPT",
)


def grade_sessions(evidence: DataFrame) -> DataFrame:
    """``recovery`` grade and the ordered ``reasons`` of every session.

    Adds to the columns of ``session_evidence``: profile_verification, metadata_available,
    message_source, source_corrupt.
    """
    c = F.col
    recovered = c("user_messages") + c("assistant_messages") + c("invalid_messages")
    any_user, any_assistant = c("user_messages") > 0, c("assistant_messages") > 0
    tests = {
        "PROFILE_UNVERIFIED": c("profile_verification") == "unverified",
        "PROFILE_UNSUPPORTED": c("profile_verification") == "unsupported",
        "METADATA_MISSING": ~c("metadata_available"),
        "MESSAGE_SOURCE_UNAVAILABLE": c("message_source") == "unavailable",
        "MESSAGE_SOURCE_ERROR": c("message_source") == "error",
        "MESSAGE_COUNT_UNKNOWN": c("expected_message_count").isNull(),
        "MESSAGE_COUNT_MISMATCH": c("expected_message_count") != recovered,
        "USER_MESSAGES_MISSING": ~any_user,
        "USER_TEXT_MISSING": any_user & (c("user_messages_with_text") < c("user_messages")),
        "ASSISTANT_MESSAGES_MISSING": ~any_assistant,
        "ASSISTANT_CONTENT_MISSING":
            any_assistant & (c("assistant_messages_with_content") < c("assistant_messages")),
        "ASSISTANT_COMPLETION_TIME_MISSING":
            any_assistant & (c("assistant_messages_with_completion_time") < c("assistant_messages")),
        "REPLY_RELATION_MISSING":
            any_assistant & (c("assistant_messages_linked_to_user") < c("assistant_messages")),
        "INVALID_MESSAGES": c("invalid_messages") > 0,
        "DANGLING_REFERENCES": c("dangling_references") > 0,
        "SOURCE_CORRUPT": c("source_corrupt"),
    }
    reasons = F.filter(F.array(*[F.when(tests[r], F.lit(r)) for r in REASONS]), lambda r: r.isNotNull())
    partial = ((c("profile_verification") == "verified") & (c("message_source") == "available")
               & (c("user_messages_with_text") > 0) & (c("assistant_messages_with_content") > 0))
    return evidence.withColumn("reasons", reasons).withColumn(
        "recovery", F.when(F.size("reasons") == 0, "complete").when(c("source_corrupt"), "unrecoverable")
        .when(partial, "partial").when(c("metadata_available"), "metadata-only").otherwise("unrecoverable"))


def evidence_faults(evidence: DataFrame) -> DataFrame:
    """Rows that must not be graded: impossible counts or a repeated identity."""
    c = F.col
    counts = [name for name in evidence.columns if name.endswith(("_messages", "_text", "_content", "_time",
                                                                    "_user", "_references", "_count"))]
    negative = F.coalesce(F.least(*[F.coalesce(c(n), F.lit(0)) for n in counts]) < 0, F.lit(False))
    excess = (c("user_messages_with_text") > c("user_messages"))
    for name in ("with_content", "with_completion_time", "linked_to_user"):
        excess = excess | (c(f"assistant_messages_{name}") > c("assistant_messages"))
    repeated = evidence.groupBy("session_id").agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    return (evidence.join(repeated, "session_id")
            .withColumn("fault", F.when(negative, "NEGATIVE_COUNT").when(excess, "COUNT_ABOVE_PARENT")
                        .when(c("session_id") == "", "IDENTITY_EMPTY")
                        .when(c("_repeated"), "IDENTITY_REPEATED"))
            .filter("fault IS NOT NULL").select("session_id", "fault"))


def demote_on_diagnostics(sessions: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """A complete session with any diagnostic above ``info`` about it becomes partial."""
    flagged = (diagnostics.filter("severity <> 'info' AND subject_id IS NOT NULL")
               .select(F.col("subject_id").alias("session_id")).distinct().withColumn("_flag", F.lit(True)))
    return (sessions.join(flagged, "session_id", "left")
            .withColumn("recovery", F.when(F.col("_flag") & (F.col("recovery") == "complete"), "partial")
                        .otherwise(F.col("recovery"))).drop("_flag"))


def domain_counts(df: DataFrame, column: str, domain: tuple[str, ...] | list[str]) -> DataFrame:
    """Row count per value of a fixed domain, zeros kept."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def grade_distribution(sessions: DataFrame) -> DataFrame:
    return domain_counts(sessions, "recovery", GRADES)


def source_counts(sources: DataFrame, domain: tuple[str, ...]) -> DataFrame:
    """Sources per kind, zeros kept; ``sources`` has one row per source."""
    return domain_counts(sources, "kind", domain)


def filter_recovery(sessions: DataFrame, grades=None) -> DataFrame:
    from palaver.functions.values import parse_grades
    return sessions.filter(F.col("recovery").isin(*parse_grades(grades)))


def summarize_bundle(sessions: DataFrame, events: DataFrame, resources: DataFrame,
                     diagnostics: DataFrame) -> DataFrame:
    """Counts and distinct diagnostic codes per session; no content."""
    counts = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("type") == "user").alias("users"),
        F.count_if(F.col("type") == "assistant").alias("assistants"))
    held = resources.groupBy("session_id").agg(F.count(F.lit(1)).alias("resources"))
    # Codes come from a fixed list, so the set per session is small.
    codes = (diagnostics.filter("subject_type = 'session'").groupBy(F.col("subject_id").alias("session_id"))
             .agg(F.array_sort(F.collect_set("code")).alias("codes")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (sessions.select("session_id", "recovery").join(counts, "session_id", "left")
            .join(held, "session_id", "left").join(codes, "session_id", "left")
            .select("session_id", "recovery", zero("messages"), zero("users"), zero("assistants"),
                    zero("resources"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes")))
