"""The manifest: what a run planned, did and saw, one Parquet snapshot per revision.

Rows: target_id, source_id, parent_id, pos, state, created, attempts, codes, transfer_hash,
expected, actual, deletion_hash, replacement. ``expected`` and ``actual`` are snapshot hashes
(JSON text of counts and hashes), so every comparison is one equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.ordered import set_hash

STATES = ("pending", "importing", "verified", "failed", "skipped", "excluded", "blocked", "deleting", "rolled-back")
TERMINAL = ("verified", "skipped", "excluded", "blocked", "rolled-back")
REPLACEMENT = "struct<run_id:string,deletion_hash:string,state:string>"


def init_manifest(plan: DataFrame, run_id: str) -> DataFrame:
    """A manifest for a plan: ready rows are pending. The run id enters the hash of the transfer,
    because the owner marker is part of what will be written."""
    ready = F.col("status") == "ready"
    owned = F.when(ready, F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "transfer_hash", F.lit(run_id)), 256)))
    return plan.select(
        "target_id", "source_id", "parent_id", "pos", F.when(ready, "pending").otherwise(F.col("status")).alias("state"),
        F.lit(False).alias("created"), F.lit(0).alias("attempts"), "codes", owned.alias("transfer_hash"),
        F.when(ready, F.col("expected")).alias("expected"), F.lit(None).cast("string").alias("actual"),
        F.lit(None).cast("string").alias("deletion_hash"), F.lit(None).cast(REPLACEMENT).alias("replacement"))


def manifest_checksum(manifest: DataFrame) -> str:
    rows = manifest.select(F.sha2(F.to_json(F.struct(*sorted(manifest.columns))), 256).alias("h"))
    first = set_hash(rows, [], "h", "checksum").first()
    return first["checksum"] if first else "sha256:" + "0" * 64


def write_manifest(manifest: DataFrame, root: str, revision: int) -> str:
    """Write one revision; an existing revision is never replaced. Returns its checksum."""
    path = f"{root}/revision={revision:06d}"
    manifest.write.mode("errorifexists").parquet(path)
    return manifest_checksum(manifest.sparkSession.read.parquet(path))


def read_manifest(spark: SparkSession, root: str, revision: int, checksum: str | None = None) -> DataFrame:
    manifest = spark.read.parquet(f"{root}/revision={revision:06d}")
    if checksum is not None and manifest_checksum(manifest) != checksum:
        raise ValueError("MANIFEST_INVALID: checksum")
    return manifest


def validate_manifest(manifest: DataFrame, run_id: str, rollback_state: str | None = None) -> DataFrame:
    """Broken rules: target_id, code. Ids unique, parents earlier, and states consistent."""
    c = F.col

    def repeated(column: str, code: str) -> DataFrame:
        many = manifest.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(column)
        return manifest.join(many, column, "left_semi").select("target_id", F.lit(code).alias("code"))
    places = manifest.groupBy(c("target_id").alias("parent_id")).agg(F.min("pos").alias("_p"))
    parents = manifest.filter("parent_id IS NOT NULL").join(places, "parent_id", "left").filter(
        F.coalesce(c("_p") >= c("pos"), F.lit(True))).select("target_id", F.lit("PARENT_NOT_EARLIER").alias("code"))
    needs = ~c("state").isin("excluded", "blocked")
    bare = c("expected").isNull() | c("transfer_hash").isNull()
    has_replacement = c("replacement").isNotNull()
    rollback = c("state").isin("deleting", "rolled-back")
    rules = {
        "STATE_UNKNOWN": ~c("state").isin(*STATES),
        "EXPECTED_MISSING": needs & bare,
        "VERIFIED_WITHOUT_EVIDENCE": (c("state") == "verified") & (~c("created") | c("actual").isNull()),
        "CREATED_WITHOUT_ATTEMPT": c("created") & (c("attempts") == 0),
        "DELETION_HASH_WITHOUT_CREATION": c("deletion_hash").isNotNull() & ~c("created"),
        "REPLACEMENT_INVALID": has_replacement & (bare | (c("replacement.run_id") == run_id) | (
            (c("replacement.state") != "deleted") & (c("attempts") > 0))),
        "ROLLBACK_INVALID": rollback & (F.lit(rollback_state is None) | has_replacement | (c("attempts") == 0)),
        "DELETING_INVALID": (c("state") == "deleting") & (~c("created") | c("deletion_hash").isNull()
                                                          | F.lit(rollback_state == "completed")),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules.items()]),
                      lambda x: x.isNotNull())
    states = manifest.select("target_id", F.explode(broken).alias("code"))
    return (repeated("target_id", "TARGET_ID_REPEATED").unionByName(repeated("source_id", "SOURCE_ID_REPEATED"))
            .unionByName(parents).unionByName(states))


def summarize_plan(plan: DataFrame) -> DataFrame:
    status = F.col("status")
    return plan.agg(*[F.count_if(status == s).alias(s) for s in ("ready", "excluded", "blocked")])


def summarize_manifest(manifest: DataFrame) -> DataFrame:
    state, replaced = F.col("state"), F.col("replacement").isNotNull()
    return manifest.agg(
        F.coalesce(F.bool_or(state.isin("failed", "blocked", "importing", "pending")), F.lit(False)).alias("has_failures"),
        F.count_if(F.col("created") & ~replaced).alias("created"), F.count_if(F.col("created") & replaced).alias("replaced"),
        F.count_if(state == "verified").alias("verified"), F.count_if(state == "skipped").alias("skipped"))


def summarize_rollback(entries: DataFrame) -> DataFrame:
    action = F.col("action")
    return entries.agg(
        F.coalesce(F.bool_or(action == "protected"), F.lit(False)).alias("has_failures"),
        F.count_if(action == "delete").alias("eligible"), F.count_if(action == "already-rolled-back").alias("rolled_back"),
        F.count_if(action == "skip").alias("skipped"))


def latest_valid_manifest(manifests: DataFrame) -> DataFrame:
    """Per source the newest manifest that may authorise a replacement, ties by name.

    ``manifests``: manifest, source_id, n_rows, state, created, deletion_hash, rollback_state,
    modified_at, one row per manifest row.
    """
    usable = manifests.filter((F.col("n_rows") == 1) & F.col("rollback_state").isNull() & (F.col("state") == "verified")
                              & F.col("created") & F.col("deletion_hash").isNotNull())
    return usable.groupBy("source_id").agg(F.min_by(
        F.struct("manifest", "modified_at"), F.struct((-F.col("modified_at")).alias("t"), "manifest")).alias("m")).select(
        "source_id", "m.*")


def retention(rows: DataFrame, current: DataFrame, source_id: str | None = None) -> DataFrame:
    """Artifacts that a newer run supersedes: all rows terminal and of one source, not current.

    ``rows``: artifact, source_id, state; ``current``: artifact. Nothing is deleted here.
    """
    single = rows.groupBy("artifact").agg(
        F.bool_and(F.col("state").isin(*TERMINAL)).alias("_t"), F.min("source_id").alias("source_id"),
        F.max("source_id").alias("_last"))
    done = single.filter(F.col("_t") & (F.col("source_id") == F.col("_last")))
    if source_id is not None:
        done = done.filter(F.col("source_id") == source_id)
    return done.join(current.select("artifact"), "artifact", "left_anti").select("artifact", "source_id")
