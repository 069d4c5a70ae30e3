"""Reports about an export: capabilities, log evidence, message statistics, structure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.ordered import previous_value, top_per_key
from palaver.operators.payload import payload_nodes
from palaver.session import durable

# Storage profiles and capability states.
PROFILES = ("workspace-v3", "memento-v1", "hybrid", "unknown")
CAPABILITY_STATES = ("available", "missing", "invalid", "unverified", "requires-runtime")


def workspace_profile(version: Column, has_item_table: Column, has_memento: Column,
                      supported: Sequence[str]) -> Column:
    """struct(id, verification) of a workspace store."""
    def pair(name: str, state: str) -> Column:
        return F.struct(F.lit(name).alias("id"), F.lit(state).alias("verification"))
    return (F.when(~F.coalesce(version.isin(*supported), F.lit(False)), pair("unknown", "unsupported"))
            .when(has_memento & has_item_table, pair("hybrid", "unverified"))
            .when(has_memento, pair("memento-v1", "unverified"))
            .when(has_item_table, pair("workspace-v3", "verified")).otherwise(pair("unknown", "unsupported")))


def gated_status(status: Column, verification: Column) -> Column:
    """An available field counts only under a verified profile."""
    return F.when((status == "available") & (verification != "verified"), "unverified").otherwise(status)


def capability_coverage(fields: DataFrame, supported: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(coverage, profiles): states per field, and workspaces per profile, zeros kept.

    ``fields``: workspace_id, version, has_item_table, has_memento, field, status.
    """
    typed = fields.withColumn("profile", workspace_profile(
        F.col("version"), F.col("has_item_table"), F.col("has_memento"), supported)).withColumn(
        "status", gated_status(F.col("status"), F.col("profile.verification")))
    coverage = typed.groupBy("field").agg(*[
        F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in CAPABILITY_STATES])
    stores = typed.select("workspace_id", F.col("profile.id").alias("profile")).distinct()
    from palaver.operators.evidence import domain_counts
    return coverage, domain_counts(stores, "profile", PROFILES)


def log_evidence(events: DataFrame, turns: int = 8, calls: int = 12) -> dict[str, DataFrame]:
    """What the log proves about every session.

    ``events`` as from ``parse_log_lines`` with session_id and line_no. Tables: sessions (summary),
    turns (first 8), calls (all tool calls), call_samples (first 12).
    """
    c = F.col
    events = durable(events)
    history = events.filter("kind = 'history'").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("histories"), F.bool_or("has_more").alias("pagination_observed"),
        F.bool_or(c("plan_items") > 0).alias("plan_items_observed"))
    spans = events.filter("kind IN ('history', 'metadata')").groupBy("session_id").agg(
        F.min_by("observed_at", "line_no").alias("observed_from"), F.max_by("observed_at", "line_no").alias("observed_to"))
    metadata = events.filter("kind = 'metadata'")
    applied = events.filter("kind = 'applied'").select("session_id", "message_id", "reply_to").distinct().withColumn(
        "_applied", F.lit(True))
    first = top_per_key(metadata, ["session_id"], ["line_no"], turns, "sample")
    sampled = first.join(applied, ["session_id", "message_id", "reply_to"], "left").select(
        "session_id", "sample", F.sha2("message_id", 256).alias("message_hash"), F.sha2("reply_to", 256).alias("reply_hash"),
        F.sha2("turn_id", 256).alias("turn_hash"), "message_index", "message_type", "status",
        F.coalesce("_applied", F.lit(False)).alias("relation_verified"))
    stepped = previous_value(sampled, ["session_id"], "sample", "message_index", "_before")
    turn_facts = stepped.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turn_samples"), F.bool_and("relation_verified").alias("reply_association_verified"),
        F.bool_and(c("_before").isNull() | (c("message_index") > c("_before"))).alias("indices_increasing"))
    # The last state other than Running ends a call; the order of states needs no list.
    per_call = events.filter("kind = 'tool'").groupBy("session_id", "call_id").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("transitions"),
        F.max_by(F.struct("status", "exit_code"), F.when(c("status") != "Running", c("line_no"))).alias("_last"))
    calls_table = per_call.select(
        "session_id", "call_id", "first_line", "transitions",
        F.coalesce("_last.status", F.lit("unpaired")).alias("terminal_status"),
        F.when(c("_last.exit_code").isNull(), "unknown").when(c("_last.exit_code") == 0, "success")
        .otherwise("error").alias("exit_kind"))
    statuses = events.filter("kind = 'tool'").groupBy("session_id").agg(F.array_sort(F.collect_set("status")).alias("statuses"))
    tool_facts = calls_table.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(c("terminal_status") != "unpaired").alias("paired"))
    samples = top_per_key(calls_table, ["session_id"], ["first_line", "call_id"], calls, "sample").select(
        "session_id", "sample", F.sha2("call_id", 256).alias("call_hash"), "terminal_status", "exit_kind", "transitions")
    sessions = history.join(spans, "session_id", "left").join(turn_facts, "session_id", "left").join(
        tool_facts, "session_id", "left").join(statuses, "session_id", "left").withColumn(
        "session_hash", F.sha2("session_id", 256)).withColumn("unpaired", c("calls") - c("paired"))
    return {"sessions": sessions, "turns": sampled, "calls": calls_table, "call_samples": samples}


def evidence_profile(messages: DataFrame, groups: Mapping[str, str], texts: Sequence[str],
                     times: Sequence[str]) -> DataFrame:
    """(metric, value, n): counts by role, status and type; text sizes; time coverage.

    ``groups`` maps a metric name to its column. One pass: every row is exploded to its facts,
    which are summed on the map side.
    """
    facts = [F.struct(F.lit(metric).alias("metric"), F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value"),
                      F.lit(1).cast("bigint").alias("n")) for metric, column in groups.items()]
    facts.append(F.struct(F.lit("messages").alias("metric"), F.lit("all").alias("value"), F.lit(1).cast("bigint").alias("n")))
    for name in texts:
        present = F.col(name).isNotNull()
        for value, amount in (("count", F.when(present, 1)), ("nonEmpty", F.when(F.trim(name) != "", 1)),
                              ("totalChars", F.length(name))):
            facts.append(F.struct(F.lit(f"text.{name}").alias("metric"), F.lit(value).alias("value"),
                                  F.coalesce(amount, F.lit(0)).cast("bigint").alias("n")))
    for name in times:
        facts.append(F.struct(F.lit("timing").alias("metric"), F.lit(name).alias("value"),
                              F.col(name).isNotNull().cast("bigint").alias("n")))
    return (messages.select(F.explode(F.array(*facts)).alias("f")).groupBy("f.metric", "f.value")
            .agg(F.sum("f.n").alias("n")))


def key_presence(df: DataFrame, column: str) -> DataFrame:
    """(key, n): how many rows have each top-level key in a JSON text column."""
    keys = F.map_keys(F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>"))
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def assert_coverage(profile: DataFrame, relation: DataFrame, texts: Sequence[str]) -> DataFrame:
    """(expectation, ok) over an evidence profile.

    ``relation``: one row with samples and matches of assistant replies. All facts are summed into
    one row, and the expectations are columns of it.
    """
    replies = relation.select(F.explode(F.array(*[F.struct(
        F.lit("relation").alias("metric"), F.lit(name).alias("value"), F.col(name).cast("bigint").alias("n"))
        for name in ("samples", "matches")])).alias("r")).select("r.*")
    def total(metric: str, value: str | None = None) -> Column:
        hit = F.col("metric") == metric
        if value is not None:
            hit = hit & (F.col("value") == value)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    row = profile.unionByName(replies).agg(
        total("messages").alias("messages"), total("role", "user").alias("users"),
        total("role", "assistant").alias("assistants"), total("status").alias("statuses"),
        total("type").alias("types"), total("timing", "created_at").alias("created"),
        total("timing", "completed_at").alias("completed"),
        total("relation", "samples").alias("samples"), total("relation", "matches").alias("matches"),
        *[total(f"text.{t}", "nonEmpty").alias(f"text_{t}") for t in texts])
    c = F.col
    checks = {
        "roles sum to messages": (c("users") > 0) & (c("assistants") > 0) & (c("users") + c("assistants") == c("messages")),
        "classifications sum to messages": (c("statuses") == c("messages")) & (c("types") == c("messages")),
        "every assistant is linked": (c("samples") > 0) & (c("samples") == c("matches")) & (c("samples") == c("assistants")),
        "timing is complete": (c("created") == c("messages")) & (c("completed") == c("assistants")),
        **{f"text present: {t}": c(f"text_{t}") > 0 for t in texts},
    }
    pairs = F.array(*[F.struct(F.lit(name).alias("expectation"), test.alias("ok")) for name, test in checks.items()])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def profile_json_keys(df: DataFrame, keys: Sequence[str], column: str, max_depth: int | None = None) -> DataFrame:
    """(path, key, kind, n): structure of a JSON text column over all rows; array items share ``[*]``.

    All levels are profiled; a ``max_depth``, if given, is an error of the walk beyond it.
    """
    nodes = payload_nodes(df, keys, column, reparse=False, max_depth=max_depth)
    shape = F.regexp_replace("path", r"\[[0-9]+\]", "[*]")
    return nodes.groupBy(shape.alias("path"), F.col("key"), F.col("kind")).agg(F.count(F.lit(1)).alias("n"))


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, type, nullable, row_count) of every table."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable)
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    columns = spark.createDataFrame(rows, "table_name string, cid int, column_name string, type string, nullable boolean")
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return columns.join(counts, "table_name")
