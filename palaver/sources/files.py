"""Inventories of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.mime import is_plain_utf8, sniff_mime
from palaver.functions.paths import basename_extension, percent_decode


def inventory(files: DataFrame) -> DataFrame:
    """The inventory of ``files(path, size_bytes, content)``; contents stay on the executors."""
    utf8 = is_plain_utf8(F.col("content"))
    return files.select(
        "path", F.col("size_bytes").cast("bigint").alias("size_bytes"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"),
        sniff_mime(F.col("content"), utf8).alias("mime"), utf8.alias("valid_utf8"),
        basename_extension(F.col("path")).alias("ext"), F.size(F.split("path", "/")).alias("depth"),
        F.sha2("path", 256).alias("path_hash"))


#: The most bytes a binary value of Spark can hold.
MAX_VALUE_BYTES = 2**31 - 16


def read_file_inventory(spark: SparkSession, root: str, workspace_depth: int = 0, max_bytes: int = MAX_VALUE_BYTES) -> DataFrame:
    """Every file below ``root``: size, SHA-256, type, strict UTF-8 flag, extension, depth, path hash, readable.

    With ``workspace_depth`` 1 the first path component is the workspace id. Contents are hashed
    on the executors and do not leave the scan. A file that cannot be read, or is longer than ``max_bytes``, stops
    nothing: its row has no hash and no type and is not ``readable``.
    """
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    relative = F.regexp_replace(percent_decode(F.col("path")), F.lit(r"^.*?\Q" + base + r"\E/"), F.lit(""))
    listed = reader.load(base).select("path", "length")  # contents are not opened
    hashed = inventory(reader.load(base).filter(F.col("length") <= max_bytes).select("path", F.col("length").alias("size_bytes"), "content"))
    read = hashed.select("path", "sha256", "mime", "valid_utf8", F.lit(True).alias("_read"))
    result = listed.join(read, "path", "left").select(
        relative.alias("path"), F.col("length").alias("size_bytes"), "sha256", "mime", "valid_utf8",
        F.coalesce("_read", F.lit(False)).alias("readable"))
    result = result.withColumns({"ext": basename_extension(F.col("path")), "depth": F.size(F.split("path", "/")), "path_hash": F.sha2("path", 256)})
    if workspace_depth:
        result = result.withColumn("workspace_id", F.split("path", "/")[0]).withColumn(
            "relative_path", F.regexp_replace("path", r"^[^/]+/", ""))
    return result
