"""Where a project lives on the target machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.paths import ancestors, normalize_path, path_key


def map_paths(df: DataFrame, path_maps: DataFrame, directories: DataFrame, source_platform: str = "linux",
              target_platform: str = "linux", fallback: str | None = None, path: str = "path") -> DataFrame:
    """Target directory and strategy (preserved, mapped, fallback, unresolved) of every source path.

    ``path_maps``: from, to; ``directories``: directory (those that exist on the target). The most
    specific map wins, and only whole path components match: each path is exploded to its own
    ancestors, so the prefix search is an equi-join. Two targets for one prefix are an error.
    """
    source_sep = "\\" if source_platform == "win32" else "/"
    target_sep = "\\" if target_platform == "win32" else "/"
    same_dialect = (source_platform == "win32") == (target_platform == "win32")
    maps = path_maps.select(
        normalize_path(F.col("from"), source_platform).alias("_from"),
        normalize_path(F.col("to"), target_platform).alias("_to"))
    maps = maps.groupBy(path_key(F.col("_from"), source_platform).alias("_key")).agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"),
        F.bool_or(F.col("_to").isNull() | F.col("_from").isNull()).alias("_bad"),
        F.min(path_key(F.col("_to"), target_platform)).alias("_low"),
        F.max(path_key(F.col("_to"), target_platform)).alias("_high"))
    if not maps.filter("_bad OR _low <> _high").isEmpty():
        raise ValueError("PATH_MAP_INVALID")
    maps = maps.select("_key", "_from", "_to")
    normal = df.withColumn("source_path", normalize_path(F.col(path), source_platform))
    paths = normal.select("source_path").filter("source_path IS NOT NULL").distinct()
    prefixes = paths.select("source_path", F.explode(ancestors(F.col("source_path"), source_sep)).alias("_prefix"))
    best = prefixes.select("source_path", path_key(F.col("_prefix"), source_platform).alias("_key")).join(
        maps, "_key").groupBy("source_path").agg(
        F.max_by(F.struct("_from", "_to"), F.length("_from")).alias("_m"))
    rest = F.substring(F.col("source_path"), F.length("_m._from") + 1, F.length("source_path"))
    parts = F.filter(F.split(rest, "\\\\" if source_sep == "\\" else "/"), lambda p: p != "")
    odd = F.exists(parts, lambda p: p.rlike(r'[<>:"/\\|?*\x00-\x1f]|[. ]$'))
    joined = F.when(F.size(parts) == 0, F.col("_m._to")).otherwise(F.concat(
        F.regexp_replace("_m._to", r"[/\\]$" if target_sep == "\\" else "/$", ""), F.lit(target_sep),
        F.array_join(parts, target_sep)))
    invalid = odd if target_platform == "win32" else F.lit(False)
    mapped = best.select("source_path", F.when(~invalid, joined).alias("_mapped"), invalid.alias("_invalid"))
    exists = directories.select(F.col("directory").alias("_candidate"), F.lit(True).alias("_exists")).distinct()
    chosen = normal.join(mapped, "source_path", "left")
    candidate = F.coalesce("_mapped", F.when(F.col("_invalid").isNull() & F.lit(same_dialect), F.col("source_path")))
    chosen = chosen.withColumn("_candidate", candidate).join(exists, "_candidate", "left")
    found = F.coalesce("_exists", F.lit(False))
    fallback_path = normalize_path(F.lit(fallback), target_platform)
    fallback_ok = False
    if fallback is not None:
        fallback_ok = not exists.filter(F.col("_candidate") == fallback_path).isEmpty()
    wrong = F.coalesce("_invalid", F.lit(False)) | (F.col(path).isNotNull() & F.col("source_path").isNull())
    use_fallback = ~found & ~wrong & F.lit(fallback is not None)
    strategy = (F.when(use_fallback, "fallback").when(wrong, "unresolved").when(F.col("_mapped").isNotNull(), "mapped")
                .when(F.col("_candidate").isNotNull(), "preserved").otherwise("unresolved"))
    writable = F.when(use_fallback, F.lit(fallback_ok)).otherwise(found & ~wrong)
    return chosen.select(
        *df.columns, "source_path",
        F.when(use_fallback, fallback_path).when(~wrong, F.col("_candidate")).alias("target_directory"),
        strategy.alias("strategy"), writable.alias("writable"),
        F.when(wrong, "PATH_MAP_INVALID").when(~writable, "DIRECTORY_INVALID").alias("reason"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, prefix): the longest listed directory at or above every POSIX path."""
    exploded = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    hits = exploded.join(prefixes.select("prefix").distinct(), "prefix")
    return hits.groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
