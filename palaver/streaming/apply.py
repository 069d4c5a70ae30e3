"""Applying plan rows as they arrive, without importing anything twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.plans.lifecycle import TARGET, import_rows, planned_rows
from palaver.plans.manifest import init_manifest
from palaver.session import durable

PLAN = ("target_id", "source_id", "parent_id", "pos", "status", "codes", "expected", "transfer_hash")


def _revisions(spark, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    done = [n for n in names if n.startswith("revision=") and fs.exists(
        spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def _read(spark, root: str, revisions: list[int]) -> DataFrame:
    return spark.read.option("basePath", root).parquet(*[f"{root}/revision={r}" for r in revisions])


def _latest(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c != "revision"]
    return rows.groupBy("target_id").agg(F.max_by(F.struct(*names), "revision").alias("r")).select("r.*")


def stream_apply(plan_stream: DataFrame, root: str, run_id: str, checkpoint: str):
    """Start a query that imports plan rows as they arrive, each batch by the rules of ``import_rows``.

    The first plan row of an id counts; of several in one batch, the least. A batch takes up its new rows and every
    earlier one that is not settled, so a child that came before its parent is imported after it. Below
    ``root`` a batch writes a revision of the manifest (the rows it took up) and of the target (the rows it added), named
    by its batch id. A batch that is repeated after an interruption reads older revisions only and overwrites its own.
    """
    manifests, targets = f"{root}/manifest", f"{root}/target"

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [r for r in _revisions(spark, manifests) if r < batch_id]
        arrived = batch.groupBy("target_id").agg(F.min(F.struct(*PLAN)).alias("r")).select("r.*")
        taken = init_manifest(arrived, run_id).join(arrived.select("target_id", F.col("transfer_hash").alias("plan_hash")), "target_id")
        held = planned_rows(arrived, run_id).where("false")
        around = taken.where("false")
        if earlier:
            known = durable(_latest(_read(spark, manifests, earlier)))
            open_ = F.col("transfer_hash").isNotNull() & (F.col("state") != "verified")
            taken = taken.join(known.select("target_id"), "target_id", "left_anti").unionByName(known.filter(open_))
            taken = durable(taken)
            parents = taken.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("target_id")).distinct()
            around = known.filter(~open_).join(parents, "target_id", "left_semi")
            held = _read(spark, targets, earlier).select(*TARGET).join(taken.select("target_id"), "target_id", "left_semi")
        else:
            taken = durable(taken)
        plan = taken.filter("transfer_hash IS NOT NULL").select(
            "target_id", "parent_id", "source_id", F.lit("ready").alias("status"), "expected", F.col("plan_hash").alias("transfer_hash"))
        hashes = taken.select("target_id", "plan_hash")
        after, new = import_rows(taken.unionByName(around).drop("plan_hash"), plan, held, run_id)
        new.write.mode("overwrite").parquet(f"{targets}/revision={batch_id}")
        after.join(hashes, "target_id").write.mode("overwrite").parquet(f"{manifests}/revision={batch_id}")
    return (plan_stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_applied(spark, root: str) -> DataFrame:
    """The target rows that ``stream_apply`` has added so far; what a batch without a manifest left behind does not count."""
    return _read(spark, f"{root}/target", _revisions(spark, f"{root}/manifest")).select(*TARGET)


def read_states(spark, root: str) -> DataFrame:
    """The manifest of the stream: the last state of every plan row."""
    manifests = f"{root}/manifest"
    return _latest(_read(spark, manifests, _revisions(spark, manifests))).drop("plan_hash")
