"""A byte budget over an ordered plan: first come, first served, and smaller items may still fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.graph import propagate_block
from palaver.operators.ordered import running_sum
from palaver.session import durable

_FOLD = 100_000


def byte_budget(plan: DataFrame, cap: int, window: int = _FOLD) -> DataFrame:
    """``plan`` plus ``status`` (ready, blocked, too_large): items taken in ``pos`` order up to ``cap``.

    ``plan``: target_id, parent_id, pos, bytes, ready. An item that does not fit is skipped and
    its children are blocked. As long as the running total stays within the budget this is one
    prefix sum. Only after an overflow does a loop decide the rest: each round accepts the longest
    prefix that fits, drops everything larger than what is left, and folds the next ``window``
    undecided rows, three numbers each.
    """
    base = durable(propagate_block(plan, ready="ready"))
    total = base.filter("effective").agg(F.sum("bytes")).first()[0] or 0
    blocked = F.when(F.col("effective"), "ready").otherwise("blocked")
    if total <= cap:
        return base.withColumn("status", blocked).select(*plan.columns, "status")
    left = cap
    pending = base.filter("effective").select("target_id", "parent_id", "pos", "bytes")
    decided = None

    def decide(rows: DataFrame, status: str | None = None) -> None:
        nonlocal decided
        if status is not None:
            rows = rows.withColumn("status", F.lit(status))
        rows = rows.select("target_id", "status")
        decided = rows if decided is None else decided.unionByName(rows)
    while True:
        # What is left only shrinks, so a row larger than that can be refused at once.
        decide(pending.filter(F.col("bytes") > left), "too_large")
        decided = durable(decided)
        refused = decided.filter("status <> 'ready'").select("target_id", F.lit(False).alias("_ok"))
        marked = plan.select("target_id", "parent_id").join(refused, "target_id", "left").select(
            "target_id", "parent_id", F.coalesce("_ok", F.lit(True)).alias("ready"))
        alive = propagate_block(marked, ready="ready").filter("effective").select("target_id")
        pending = durable(pending.filter(F.col("bytes") <= left).join(alive, "target_id", "left_semi"))
        sums = running_sum(pending.withColumn("_all", F.lit(0)), ["_all"], "pos", "bytes", "_sum")
        first_over = sums.filter(F.col("_sum") > left).agg(F.min("pos")).first()[0]
        if first_over is None:
            decide(pending, "ready")
            break
        fits = pending.filter(F.col("pos") < first_over)
        decide(fits, "ready")
        left -= int(fits.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
        rows = pending.filter(F.col("pos") >= first_over).orderBy("pos").limit(window)
        folded = durable(rows.groupBy(F.lit(0).alias("_one")).applyInPandas(
            _greedy(left), "target_id string, status string, pos bigint, bytes bigint"))
        decide(folded)
        last, used = folded.agg(F.max("pos"), F.sum(
            F.when(F.col("status") == "ready", F.col("bytes")).otherwise(0))).first()
        left -= int(used or 0)
        pending = pending.filter(F.col("pos") > last)
    result = base.join(decided, "target_id", "left").withColumn("status", F.coalesce("status", F.lit("blocked")))
    # Below a refused item everything is blocked, whatever its own size.
    parents = durable(result.select(F.col("target_id").alias("parent_id"), F.col("status").alias("_parent")))
    lost = F.col("_parent").isNotNull() & (F.col("_parent") != "ready")
    roots = result.filter("parent_id IS NULL").withColumn("_parent", F.lit(None).cast("string"))
    return result.filter("parent_id IS NOT NULL").join(parents, "parent_id", "left").unionByName(roots).withColumn(
        "status", F.when(lost, "blocked").otherwise(F.col("status"))).select(*plan.columns, "status")


def _greedy(left: int):
    def fold(pdf):
        remaining, state = left, {}
        pdf = pdf.sort_values("pos")
        out = []
        for ident, parent, size in zip(pdf.target_id, pdf.parent_id, pdf.bytes):
            if parent in state and state[parent] != "ready":
                state[ident] = "blocked"
            elif size > remaining:
                state[ident] = "too_large"
            else:
                remaining -= int(size)
                state[ident] = "ready"
            out.append(state[ident])
        return pdf.assign(status=out)[["target_id", "status", "pos", "bytes"]]
    return fold
