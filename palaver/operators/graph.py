"""The forest of parent sessions, by pointer doubling: about log2(depth) joins, no recursion.

Every round replaces each pointer by the pointer of its target. The joins are many-to-one on a
unique key, so a parent with very many children is split by the adaptive skew join; subtree values
are folded with map-side aggregation. Every round is written to the checkpoint folder. All joins are sort-merge joins by a hint:
files of ids are many times smaller than their rows, and a broadcast chosen by their size would pass millions of rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import durable


def _pointers(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.col("session_id").alias("id"), F.col("parent_id").alias("jump"))


def parent_cycles(sessions: DataFrame) -> DataFrame:
    """Ids that lie on a parent cycle (not those that only lead into one).

    A round keeps the paths that start where another one ends. When a round loses none and every id has one
    parent, the pointers are a permutation and all that is left are cycles: about log2(depth) rounds.
    """
    ids = sessions.select("session_id").distinct()
    # A parent that does not exist ends the path.
    known = ids.withColumnRenamed("session_id", "jump")
    live = durable(_pointers(sessions).filter("jump IS NOT NULL").distinct().join(known.hint("merge"), "jump", "left_semi")
                   .select("id", "jump"))
    total, left = ids.count(), live.count()
    unique = left == live.select("id").distinct().count()
    steps = 1
    while steps < total and left:
        target = live.select(F.col("id").alias("jump"), F.col("jump").alias("_next"))
        ends = live.select(F.col("jump").alias("id")).distinct()
        rows = live.join(target.hint("merge"), "jump").join(ends.hint("merge"), "id", "left_semi").select("id", F.col("_next").alias("jump"))
        live = durable(rows if unique else rows.distinct())
        before, left = left, live.count()
        if unique and left == before:
            break
        steps *= 2
    return live.select(F.col("jump").alias("session_id")).distinct()


def parent_order(sessions: DataFrame) -> DataFrame:
    """Every session with ``subtree_min`` and ``depth``; sorted by both, parents come first.

    This is the order in which a depth-first walk over ascending ids emits the sessions. A missing
    parent, a repeated id or a cycle is an error.
    """
    if not sessions.groupBy("session_id").count().filter("count > 1").isEmpty():
        raise ValueError("IDENTITY_INVALID: repeated session")
    ids = sessions.select(F.col("session_id").alias("parent_id"))
    if not sessions.filter("parent_id IS NOT NULL").join(ids.hint("merge"), "parent_id", "left_anti").isEmpty():
        raise ValueError("IDENTITY_INVALID: missing parent")
    total = sessions.count()
    nodes = durable(_pointers(sessions).select(
        "id", "jump", F.col("id").alias("low"),
        F.when(F.col("jump").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    steps = 1
    while not nodes.filter("jump IS NOT NULL").isEmpty():
        if steps >= 2 * total:
            raise ValueError("IDENTITY_INVALID: cycle")
        moving = nodes.filter("jump IS NOT NULL")
        below = moving.groupBy(F.col("jump").alias("id")).agg(F.min("low").alias("_low"))
        target = nodes.select(F.col("id").alias("jump"), F.col("jump").alias("_next"),
                              F.col("depth").alias("_more"))
        moved = moving.join(target.hint("merge"), "jump").select(
            "id", F.col("_next").alias("jump"), "low", (F.col("depth") + F.col("_more")).alias("depth"))
        rest = nodes.filter("jump IS NULL")
        nodes = durable(moved.unionByName(rest).join(below.hint("merge"), "id", "left").select(
            "id", "jump", F.least("low", F.coalesce("_low", "low")).alias("low"), "depth"))
        steps *= 2
    return nodes.select(F.col("id").alias("session_id"), F.col("low").alias("subtree_min"), "depth")


def propagate_block(plan: DataFrame, key: str = "target_id", parent: str = "parent_id",
                    ready: str = "ready") -> DataFrame:
    """``effective``: ready and every ancestor ready. A parent outside the plan is not ready."""
    nodes = durable(plan.select(F.col(key).alias("id"), F.col(parent).alias("jump"), F.col(ready).alias("ok")))
    rounds = 0
    while not nodes.filter("ok AND jump IS NOT NULL").isEmpty():
        rounds += 1
        if rounds > 64:
            raise ValueError("IDENTITY_INVALID: cycle")
        target = nodes.select(F.col("id").alias("jump"), F.col("jump").alias("_next"), F.col("ok").alias("_ok"))
        moving = nodes.filter("ok AND jump IS NOT NULL").join(target.hint("merge"), "jump", "left").select(
            "id", F.col("_next").alias("jump"), F.coalesce("_ok", F.lit(False)).alias("ok"))
        nodes = durable(moving.unionByName(nodes.filter("NOT (ok AND jump IS NOT NULL)")))
    return plan.join(nodes.select(F.col("id").alias(key), F.col("ok").alias("effective")).hint("merge"), key)
