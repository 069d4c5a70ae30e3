"""Comparing what was planned with what a target holds, by hashes and positions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.ordered import top_per_key, tree_hash

# Header fields a target may change, per layout.
ALLOWED = {
    "v2": ("projectID", "subpath", "time.updated", "model.variant"),
    "v1": ("projectID", "path"),
}
MAX_LOCATIONS = 1000


def header_fields(headers: DataFrame, layout: str = "v2", column: str = "info") -> DataFrame:
    """(target_id, field, value_hash, allowed): header members, nested projections as own rows."""
    spark = headers.sparkSession
    top = headers.select("target_id", F.try_parse_json(column).alias("_v")).lateralJoin(
        spark.tvf.variant_explode(F.col("_v").outer())).select("target_id", F.col("key").alias("field"), "value")
    nested = [f for f in ALLOWED[layout] if "." in f]
    owners = {f.split(".")[0] for f in nested}
    plain = [f for f in ALLOWED[layout] if "." not in f]
    rows = []
    whole = top.filter(~F.col("field").isin(*owners)) if owners else top
    rows.append(whole.select("target_id", "field", F.sha2(F.to_json("value"), 256).alias("value_hash"),
                             F.col("field").isin(*plain).alias("allowed")))
    for name in nested:
        owner, member = name.split(".")
        part = top.filter(F.col("field") == owner)
        inner = F.try_variant_get("value", f"$.{member}", "variant")
        rows.append(part.filter(inner.isNotNull()).select(
            "target_id", F.lit(name).alias("field"), F.sha2(F.to_json(inner), 256).alias("value_hash"),
            F.lit(True).alias("allowed")))
        members = F.try_variant_get("value", "$", "map<string,variant>")
        rest = F.to_json(F.map_filter(members, lambda k, _: k != member))
        rows.append(part.select("target_id", F.lit(owner).alias("field"), F.sha2(
            F.coalesce(rest, F.to_json("value")), 256).alias("value_hash"), F.lit(False).alias("allowed")))
    result = rows[0]
    for part in rows[1:]:
        result = result.unionByName(part)
    return result


def message_hashes(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(target_id, pos, hash) of every message with its blocks in order; pos counts sub-rows too."""
    of_blocks = tree_hash(blocks.withColumn("_h", F.sha2("body", 256)), ["target_id", "message_id"],
                          "content_pos", "_h", "_blocks")
    joined = messages.join(of_blocks.withColumnRenamed("message_id", "id"), ["target_id", "id"], "left")
    return joined.select("target_id", (F.col("pos") * 2 + F.col("sub")).alias("pos"), F.sha2(
        F.concat("body", F.lit("|"), F.coalesce("_blocks", F.lit(""))), 256).alias("hash"))


def reconcile(expected: DataFrame, actual: DataFrame, expected_fields: DataFrame | None = None,
              actual_fields: DataFrame | None = None, key: Sequence[str] = ("target_id",),
              limit: int = MAX_LOCATIONS) -> tuple[DataFrame, DataFrame]:
    """(report, locations): exact difference count, status and allowed changes per session.

    ``expected`` and ``actual``: key, pos, hash (one row per message). Field tables come from
    ``header_fields``. At most ``limit`` locations per session are listed; the count is exact.
    """
    key = list(key)
    left = expected.select(*key, "pos", F.col("hash").alias("_e"))
    right = actual.select(*key, "pos", F.col("hash").alias("_a"))
    pairs = left.join(right, key + ["pos"], "full")
    differences = pairs.filter(~F.col("_e").eqNullSafe(F.col("_a"))).select(
        *key, F.col("pos"), F.concat(F.lit("messages["), F.col("pos"), F.lit("]")).alias("location"))
    lengths = pairs.groupBy(*key).agg(F.count("_e").alias("n_expected"), F.count("_a").alias("n_actual"))
    longer = lengths.filter("n_expected <> n_actual").select(
        *key, F.lit(-1).cast("bigint").alias("pos"), F.lit("messages.length").alias("location"))
    found = differences.select(*key, F.col("pos").cast("bigint").alias("pos"), "location").unionByName(longer)
    allowed = None
    if expected_fields is not None and actual_fields is not None:
        fields = expected_fields.select(*key, "field", F.col("value_hash").alias("_e"), F.col("allowed").alias("_x")).join(
            actual_fields.select(*key, "field", F.col("value_hash").alias("_a"), F.col("allowed").alias("_y")),
            key + ["field"], "full").filter(~F.col("_e").eqNullSafe(F.col("_a")))
        free = F.coalesce("_x", "_y")
        found = found.unionByName(fields.filter(~free).select(
            *key, F.lit(-2).cast("bigint").alias("pos"), F.concat(F.lit("info."), "field").alias("location")))
        # Only a handful of header fields may change.
        allowed = fields.filter(free).groupBy(*key).agg(F.array_sort(F.collect_set(
            F.concat(F.lit("info."), "field"))).alias("allowed_projections"))
    counts = found.groupBy(*key).agg(F.count(F.lit(1)).alias("difference_count"))
    report = lengths.join(counts, key, "left").withColumn(
        "difference_count", F.coalesce("difference_count", F.lit(0)).cast("bigint")).withColumn(
        "status", F.when(F.col("difference_count") > 0, "mismatch").otherwise("verified"))
    if allowed is not None:
        report = report.join(allowed, key, "left")
    locations = top_per_key(found, key, ["pos", "location"], limit, "rank")
    return report, locations


def transfer_counts(messages: DataFrame, blocks: DataFrame, digest: str = "hash") -> DataFrame:
    """Counts per session and the hash of its messages in order: the snapshot kept in a manifest.

    ``messages``: target_id, pos, type, ``digest``; ``blocks``: target_id, type. Layout 1 passes
    its parts as blocks. Texts of users are not counted, as in the target's own report.
    """
    counts = messages.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("type") == "user").alias("users"),
        F.count_if(F.col("type") == "assistant").alias("assistants"))
    inner = blocks.groupBy("target_id").agg(
        F.count_if(F.col("type") == "text").alias("text"), F.count_if(F.col("type") == "reasoning").alias("reasoning"),
        F.count_if(F.col("type") == "tool").alias("tools"))
    hashes = tree_hash(messages, ["target_id"], "pos", digest, "messages_sha256")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return (counts.join(inner, "target_id", "left").join(hashes, "target_id")
            .select("target_id", "messages", "users", "assistants", zero("text"), zero("reasoning"), zero("tools"),
                    "messages_sha256"))


def snapshot(messages: DataFrame, blocks: DataFrame, headers: DataFrame, layout: str = "v2") -> DataFrame:
    """Counts, message hash and header hash (without the fields a target may change)."""
    full = message_hashes(messages, blocks)
    typed = messages.select("target_id", (F.col("pos") * 2 + F.col("sub")).alias("pos"), "type")
    counts = transfer_counts(typed.join(full, ["target_id", "pos"]), blocks)
    fields = header_fields(headers, layout).filter("NOT allowed").groupBy("target_id").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("field", "value_hash")))), 256).alias("_i"))
    return counts.join(fields, "target_id").withColumn(
        "info_sha256", F.concat(F.lit("sha256:"), "_i")).drop("_i")


def same_snapshot(left: Column, right: Column) -> Column:
    return F.coalesce(F.to_json(left) == F.to_json(right), F.lit(False))
