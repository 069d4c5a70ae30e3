"""What a migration would do, decided session by session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.identity import NAMESPACE, stable_session_id
from palaver.functions.values import parse_grades
from palaver.operators.budget import byte_budget
from palaver.operators.directories import map_paths
from palaver.operators.graph import parent_order
from palaver.operators.layout1 import map_sessions_v1
from palaver.operators.mapping import map_sessions_v2, transfer_bytes
from palaver.operators.ordered import row_position
from palaver.operators.reconcile import snapshot
from palaver.session import durable

# Largest transfer of one session, and of one plan for one bundle, in bytes. A plan for a fleet has no such limit.
MAX_TRANSFER_BYTES = 384 * 1024 ** 2
MAX_PLAN_BYTES = 1024 ** 3
NO_LIMIT = (1 << 63) - 1


@dataclass
class PlanOptions:
    recovery: str | None = None
    namespace: str = NAMESPACE
    layout: str = "v2"
    version: str = "2.0.12"
    source_platform: str = "linux"
    target_platform: str = "linux"
    fallback: str | None = None
    max_transfer: int = MAX_TRANSFER_BYTES
    max_plan: int = NO_LIMIT


def order_sessions(sessions: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """source_id, target_id, parent_id, pos: parents first, ids ascending."""
    placed = row_position(parent_order(sessions), [], ["subtree_min", "depth"], "pos")
    named = sessions.select("session_id", F.col("parent_id").alias("_parent")).join(placed, "session_id")
    return named.select(
        F.col("session_id").alias("source_id"), stable_session_id(F.col("session_id"), namespace).alias("target_id"),
        F.when(F.col("_parent").isNotNull(), stable_session_id(F.col("_parent"), namespace)).alias("parent_id"), "pos")


def decide_status(rows: DataFrame, max_transfer: int, max_plan: int) -> DataFrame:
    """``status`` and ``reasons``: recovery filter, parents, directory, mapping, size and budget.

    ``rows``: target_id, parent_id, pos, wanted, reason (of directory or mapping, NULL if fine), bytes.
    """
    c = F.col
    too_large = c("bytes") > max_transfer
    own = F.when(~c("wanted"), "RECOVERY_EXCLUDED").when(c("reason").isNotNull(), c("reason")).when(
        F.coalesce(too_large, F.lit(True)), "TRANSFER_TOO_LARGE")
    # A row that does not come to be has no size in the budget.
    rows = durable(rows.withColumn("_own", own).withColumn("ready", own.isNull())
                   .withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("bigint")))
    decided = byte_budget(rows.select("target_id", "parent_id", "pos", "bytes", "ready"), max_plan).select(
        "target_id", c("status").alias("_budget"))
    joined = durable(rows.join(decided, "target_id"))
    parents = joined.select(c("target_id").alias("parent_id"), (c("_budget") == "ready").alias("_parent_ready"))
    # Roots have no parent and do not meet in the join.
    roots = joined.filter("parent_id IS NULL").withColumn("_parent_ready", F.lit(None).cast("boolean"))
    full = joined.filter("parent_id IS NOT NULL").join(parents, "parent_id", "left").unionByName(roots)
    orphan = c("parent_id").isNotNull() & ~F.coalesce("_parent_ready", F.lit(False))
    reason = (F.when(~c("wanted"), "RECOVERY_EXCLUDED").when(orphan, "PARENT_MISSING")
              .when(c("_own").isNotNull(), c("_own")).when(c("_budget") != "ready", "TRANSFER_TOO_LARGE"))
    status = F.when(~c("wanted"), "excluded").when(reason.isNotNull(), "blocked").otherwise("ready")
    none = F.array().cast("array<string>")
    return full.withColumn("status", status).withColumn(
        "reasons", F.when(reason.isNotNull(), F.array(reason)).otherwise(none)).drop(
        "_own", "_budget", "_parent_ready", "ready")


def build_plan(tables: dict[str, DataFrame], path_maps: DataFrame, directories: DataFrame,
               options: PlanOptions = PlanOptions()) -> tuple[DataFrame, object]:
    """(plan, mapped): one plan row per session, and the mapped rows of those that are ready.

    A session that cannot be mapped blocks only itself and its children.
    """
    c = F.col
    wanted = parse_grades(options.recovery)
    sessions = tables["sessions"]
    order = durable(order_sessions(sessions.select("session_id", "parent_id"), options.namespace))
    kept = dict(tables)
    kept["sessions"] = sessions.filter(c("recovery").isin(*wanted))
    ids = kept["sessions"].select("session_id")
    for name in ("events", "blocks", "resources"):
        kept[name] = tables[name].join(ids, "session_id", "left_semi")
    mapped = map_sessions_v2(kept, options.namespace)
    sizes = transfer_bytes(mapped)
    snap = snapshot(mapped.messages, mapped.blocks, mapped.sessions)
    output, rejects = mapped, mapped.rejects
    if options.layout == "v1":
        output = map_sessions_v1(mapped, options.version, options.namespace)
        rejects = output.rejects
        messages = output.messages.select("session_id", "target_id", "pos", F.lit(0).alias("sub"), "id",
                                          c("role").alias("type"), "body")
        parts = output.parts.withColumnRenamed("id", "part_id")
        users = messages.filter("type = 'user'").select(c("id").alias("message_id"))
        counted = parts.join(users, "message_id", "left_anti")
        snap = snapshot(messages, parts, output.sessions, "v1").drop("text", "reasoning", "tools").join(
            counted.groupBy("target_id").agg(
                F.count_if(c("type") == "text").alias("text"), F.count_if(c("type") == "reasoning").alias("reasoning"),
                F.count_if(c("type") == "tool").alias("tools")), "target_id", "left")
    expected = durable(snap.select("target_id", F.to_json(F.struct(*sorted(
        x for x in snap.columns if x != "target_id"))).alias("expected")))
    places = map_paths(sessions.select("session_id", "project_path"), path_maps, directories,
                       options.source_platform, options.target_platform, options.fallback, "project_path")
    codes = output.diagnostics.groupBy("session_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    rows = (order.join(sessions.select(c("session_id").alias("source_id"), "recovery"), "source_id")
            .join(places.select(c("session_id").alias("source_id"), "target_directory", "strategy",
                                c("reason").alias("_directory")), "source_id")
            .join(rejects.select(c("session_id").alias("source_id"), c("code").alias("_mapping")), "source_id", "left")
            .join(sizes, "target_id", "left").join(expected, "target_id", "left")
            .join(codes.withColumnRenamed("session_id", "source_id"), "source_id", "left"))
    rows = rows.withColumn("wanted", c("recovery").isin(*wanted)).withColumn(
        "reason", F.coalesce("_directory", "_mapping")).drop("_directory", "_mapping")
    decided = decide_status(durable(rows), options.max_transfer, options.max_plan)
    ready = c("status") == "ready"
    none = F.array().cast("array<string>")
    plan = decided.select(
        "source_id", "target_id", "parent_id", "pos", "recovery", "status", "reasons", "strategy", "target_directory",
        F.concat("reasons", F.when(ready, F.coalesce("codes", none)).otherwise(none)).alias("codes"), "bytes",
        F.when(ready, c("expected")).alias("expected"),
        F.when(ready, F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "expected", "target_directory"), 256)))
        .alias("transfer_hash"))
    return plan, output


