"""Reading back what a target holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_target(spark: SparkSession, path: str, planned: DataFrame) -> DataFrame:
    """Planned ids with their stored session, NULL fields where the target has none."""
    return lookup_target(spark.read.parquet(path), planned)


def lookup_target(target: DataFrame, planned: DataFrame) -> DataFrame:
    """``present`` tells whether a planned target_id exists; ids are compared exactly."""
    stored = target.withColumn("_present", F.lit(True))
    return (planned.select("target_id").distinct().join(stored, "target_id", "left")
            .withColumn("present", F.coalesce("_present", F.lit(False))).drop("_present"))


def list_children(target: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent_id, target_id) of the stored children of ``parents``; a child of itself or a repeat is an error."""
    children = target.filter("parent_id IS NOT NULL").select("parent_id", "target_id").join(
        parents.select(F.col("target_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    counts = children.groupBy("parent_id", "target_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("valid", (F.col("_n") == 1) & (F.col("target_id") != F.col("parent_id"))).drop("_n")
