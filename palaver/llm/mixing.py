"""Mixing sources to target weights with nested hash thresholds, without a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import durable

#: Bits of the hash of a document, and how many of them one histogram resolves.
BITS, STEP = 60, 12


def n_words() -> Column:
    """Words of the column ``text``; null has none."""
    blank = F.translate(F.coalesce(F.col("text"), F.lit("")), " \t\n\x0b\f\r", " " * 6)
    return F.size(F.filter(F.split(blank, " "), lambda w: w != "")).cast("long")


def place() -> Column:
    """A stable number of BITS bits for a document id; a null id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all sizes; no target
    is over ``most`` times its source's size, the excess goes to the others by weight. The capped sources are a
    prefix of the order by size over weight, so two windows over the sources (not the documents) settle it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = totals.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns({"_all": F.sum("source_size").over(every), "_weights": F.sum("_w").over(every)})
    before = (Window.orderBy((F.col("source_size").cast("double") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    spent = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    used = F.coalesce(F.sum("_w").over(before), F.lit(0))
    ranked = ranked.withColumns({"_rest": F.col("_all") - spent, "_left": F.col("_weights") - used})
    capped = F.col("source_size") * most * F.col("_left") <= F.col("_w") * F.col("_rest")
    ranked = ranked.withColumn("_capped", capped)
    rest = F.min(F.when(~F.col("_capped"), F.struct(-F.col("_left"), "_rest", "_left"))).over(every)
    free = (F.col("_w") * rest["_rest"]).cast("double") / rest["_left"].cast("double")
    return ranked.select("source", "source_size", F.when(F.col("_capped"), (F.col("source_size") * most).cast("double")).otherwise(free).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``copies`` (whole rounds of the source) and ``threshold``: documents whose place is below it come once more.

    Per level: sizes summed by source and the next STEP bits of the place, only inside the bucket where the budget of
    the source ends; what lies before that bucket is spent. After BITS / STEP levels the bucket is a single place.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("copies", whole).withColumns({
        "_budget": F.col("target") - F.col("copies") * F.col("source_size"), "_spent": F.lit(0).cast("long"), "_prefix": F.lit(0).cast("long")})
    for level in range(BITS // STEP):
        shift = BITS - STEP * (level + 1)
        bucket = F.shiftright(F.col("place"), shift)
        own = state.select(F.col("source").alias("_source"), "_prefix", "_spent", "_budget")
        inside = sizes.join(own, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright(F.col("place"), shift + STEP) == F.col("_prefix")))
        sums = inside.groupBy("_source", "_spent", "_budget", bucket.alias("_bucket")).agg(F.sum("size").alias("_size"))
        upto = Window.partitionBy("_source").orderBy("_bucket")
        run = sums.withColumn("_upto", F.col("_spent") + F.sum("_size").over(upto))
        over = F.when(F.col("_upto") > F.col("_budget"), F.struct("_bucket", (F.col("_upto") - F.col("_size")).alias("_spent")))
        found = run.groupBy("_source").agg(F.min(over).alias("_cut"), F.max("_upto").alias("_total"))
        # Without a bucket over the budget all of the level fits: the end lies behind its last bucket.
        joined = state.join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
        state = durable(joined.select(
            "source", "source_size", "target", "copies", "_budget",
            F.when(F.col("_cut").isNotNull(), F.col("_cut._spent")).otherwise(F.coalesce(F.col("_total"), F.col("_spent"))).alias("_spent"),
            F.when(F.col("_cut").isNotNull(), F.col("_cut._bucket")).otherwise(F.shiftleft(F.col("_prefix") + 1, STEP)).alias("_prefix")))
    return state.select("source", "source_size", "target", "copies", F.col("_prefix").alias("threshold"))


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, size: Column | None = None) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``taken`` copies of it (``copies``); other columns stay.

    Rows with one id share a place, so they are taken together. A source of no size gets nothing. Columns of these
    names give way.
    """
    measured = documents.drop("source_size", "target", "taken", "copies", "place").withColumns({"size": n_words() if size is None else size, "place": place()})
    sizes = durable(measured.select("source", "size", "place"))
    cut = durable(thresholds(sizes, source_targets(sizes, weights, most)))
    named = cut.select(F.col("source").alias("_source"), "source_size", "target", F.col("copies").alias("_copies"), F.col("threshold").alias("_threshold"))
    joined = measured.join(named, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.col("_copies") + (F.col("place") < F.col("_threshold")).cast("long"))
    return (joined.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size")).drop("_source", "_copies", "_threshold", "place"))


MIXING_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lft FROM s
  WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * lft <= w * rest AS capped FROM o),
f AS (SELECT arg_max(rest, lft) AS rest, max(lft) AS lft FROM c WHERE NOT capped),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * f.rest AS DOUBLE) / CAST(f.lft AS DOUBLE) END AS target
  FROM c LEFT JOIN f ON true),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
  sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN source_size = 0 THEN 0 ELSE least(3, whole + CASE WHEN upto <= target - whole * source_size THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM r"""
