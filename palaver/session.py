"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "palaver", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; only a local session may fall back to one of its own."""
    context = spark.sparkContext
    named = (spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
             or context.getCheckpointDir())
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="palaver-checkpoint-")
        context.setCheckpointDir(named)
    return named


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written; results built on them must be stored first."""
    count = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        count += int(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder once and read it back.

    This cuts the lineage, so a lost executor costs no recomputation, and unlike a row checkpoint
    the readers still prune columns and push filters down.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/palaver/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has, one for each core at least.

    Tables are read by their bytes, so costly work on a few well compressed ones runs in a task or two.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of an application, once; the driver's file server hands it out."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):  # already imported from an archive that was handed out
        return
    target = os.path.join(tempfile.mkdtemp(prefix="palaver-package-"), "palaver.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
