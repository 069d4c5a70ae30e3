"""Ordered computations that never need a whole key in one task.

A window over a session is one task per session, and one session may hold a third of all rows.
The helpers here cut each key into chunks of consecutive positions, compute inside the chunks,
and then combine the (few) chunk summaries. Positions are array indices, so a chunk has at most
``chunk`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import durable

CHUNK = 65_536
FANOUT = 4_096


def _chunked(df: DataFrame, pos: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk)))


def same_keys(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal names where NULL equals NULL; the names of the left side stay."""
    other = right.withColumnsRenamed({name: f"_right_{name}" for name in names})
    on = F.lit(True)
    for name in names:
        on = on & F.col(name).eqNullSafe(F.col(f"_right_{name}"))
    return left.join(other, on, how).drop(*[f"_right_{name}" for name in names])


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str,
                chunk: int = CHUNK) -> DataFrame:
    """Inclusive running total of ``value`` by ``pos`` within ``keys``.

    A NULL key is a key. A row without a position has no total and counts in nobody's.
    """
    keys = list(keys)
    parts = _chunked(df, pos, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    local = parts.withColumn(
        "_local", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.filter(F.col(pos).isNotNull()).groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"))
               .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
               .drop("_total"))
    return (same_keys(local, offsets, keys + ["_chunk"], "left")
            .withColumn(out, F.coalesce(F.col("_local"), F.lit(0)) + F.col("_offset"))
            .drop("_chunk", "_local", "_offset"))


def previous_value(df: DataFrame, keys: Sequence[str], pos: str, value: str | Column, out: str,
                   chunk: int = CHUNK) -> DataFrame:
    """The value of the preceding row by ``pos`` within ``keys``; NULL on the first row.

    A NULL key is a key. A row without a position neither has nor is a predecessor.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    parts = _chunked(df.withColumn("_value", F.struct(value.alias("v"))), pos, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    local = parts.withColumn("_prev", F.lag("_value").over(inside))
    between = Window.partitionBy(*keys).orderBy("_chunk")
    tails = (parts.filter(F.col(pos).isNotNull()).groupBy(*keys, "_chunk").agg(F.max_by("_value", pos).alias("_last"))
             .withColumn("_carry", F.lag("_last").over(between)).drop("_last"))
    known = F.when(F.col(pos).isNotNull(), F.coalesce(F.col("_prev"), F.col("_carry")))
    return (same_keys(local, tails, keys + ["_chunk"], "left")
            .withColumn(out, known["v"])
            .drop("_chunk", "_value", "_prev", "_carry"))


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str,
                 small: int = 1_000_000) -> DataFrame:
    """0-based row number by ``order`` within ``keys`` (all rows when ``keys`` is empty).

    While no key has more than ``small`` rows this is a plain window. Beyond that the rows are
    range-partitioned on (keys, order), which splits a hot key over many tasks, and numbered by
    partition offset. Both give the same numbers, also to rows with a NULL key.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    largest = counts.agg(F.max("count")).first()[0] or 0
    if largest <= small:
        window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
        return df.withColumn(out, F.row_number().over(window).cast("bigint") - 1)
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = [F.col(k) for k in keys] + order
    numbered = durable(df.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered)
                       .withColumn("_global", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_global", 33))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = (numbered.groupBy(*keys, "_part")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_global").alias("_first"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .drop("_n"))
    return (same_keys(numbered, blocks, keys + ["_part"])
            .withColumn(out, F.col("_global") - F.col("_first") + F.col("_before"))
            .drop("_global", "_part", "_first", "_before"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                out: str = "rank", salts: int = 64) -> DataFrame:
    """The first ``k`` rows of every key, ranked from 1.

    Spark applies a row-number limit before the shuffle already (window group limit), so a hot key
    sends at most ``k`` rows per map task. For a large ``k`` the key is cut down in salted pieces
    as well.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    kept = df
    if k > 64:
        plain = [c for c in df.columns if not _unhashable(df, c)]
        pieces = Window.partitionBy(*keys, "_salt").orderBy(*order)
        kept = (df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
                .withColumn("_r", F.row_number().over(pieces)).filter(F.col("_r") <= k)
                .drop("_r", "_salt"))
    window = Window.partitionBy(*keys).orderBy(*order)
    return (kept.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= k)
            .withColumn(out, F.col("_r").cast("bigint")).drop("_r"))


def _unhashable(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType.simpleString()
    return "variant" in kind or "map<" in kind


def _node_hash(children: str) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["_h"]), ","), 256)


def tree_hash(df: DataFrame, keys: Sequence[str], pos: str, digest: str, out: str,
              fanout: int = FANOUT, levels: int = 3) -> DataFrame:
    """One hash per key over its rows in ``pos`` order, as a hash tree of fixed height.

    A node hashes at most ``fanout`` children, so no group is larger than that. The height is
    fixed, so equal content gives equal hashes at any scale.
    """
    keys = list(keys)
    level = df.select(*keys, F.col(pos).cast("bigint").alias("_p"), F.col(digest).alias("_h"))
    for step in range(levels):
        parent = F.floor(F.col("_p") / F.lit(fanout)) if step + 1 < levels else F.lit(0)
        level = (level.groupBy(*keys, parent.cast("bigint").alias("_q"))
                 .agg(F.array_sort(F.collect_list(F.struct("_p", "_h"))).alias("_c"))
                 .select(*keys, F.col("_q").alias("_p"), _node_hash("_c").alias("_h")))
    return level.select(*keys, F.concat(F.lit("sha256:"), F.col("_h")).alias(out))


def set_hash(df: DataFrame, keys: Sequence[str], digest: str, out: str) -> DataFrame:
    """One hash per key over its distinct row hashes, independent of order.

    ``digest`` holds hex SHA-256. Hashes are grouped by their first six digits, those nodes by
    three, those by none: hashes are distinct and uniform, so every node stays small.
    """
    keys = list(keys)
    level = df.select(*keys, F.col(digest).alias("_h")).distinct().withColumn("_p", F.col("_h"))
    for width in (6, 3, 0):
        level = (level.groupBy(*keys, F.substring("_p", 1, width).alias("_q"))
                 .agg(F.array_sort(F.collect_list(F.struct("_p", "_h"))).alias("_c"))
                 .select(*keys, F.col("_q").alias("_p"), _node_hash("_c").alias("_h")))
    return level.select(*keys, F.concat(F.lit("sha256:"), F.col("_h")).alias(out))
