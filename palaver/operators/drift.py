"""Whether the schema of a target still fits the one that was reviewed, for a fleet of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.ordered import row_position, same_keys, top_per_key
from palaver.operators.payload import payload_nodes
from palaver.session import durable

# Keywords without effect on data.
ANNOTATIONS = ("title", "description", "default", "examples", "deprecated")

# Fixed value: positions in one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32_768


def flatten_schemas(schemas: DataFrame, id_col: str = "schema_id", column: str = "schema") -> DataFrame:
    """(schema_id, path, attr, value): one row per keyword of every node of a JSON schema.

    Set-like keywords (required, enum, type lists) give one row per member, and alternatives
    (anyOf, oneOf, allOf) one row per alternative by its hash, so all comparisons are row joins.
    """
    c = F.col
    parent = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    item_of = F.regexp_extract("path", r"^(.*)\.(required|enum|type|anyOf|oneOf|allOf)\[[0-9]+\]$", 1)
    item_attr = F.regexp_extract("path", r"^(.*)\.(required|enum|type|anyOf|oneOf|allOf)\[[0-9]+\]$", 2)
    outside = ~c("path").rlike(r"\.(?:anyOf|oneOf|allOf)\[[0-9]+\].")
    named = parent.rlike(r"\.properties$")

    def part(condition, path, attr, value):
        return F.when(outside & condition, F.struct(path.alias("path"), attr.alias("attr"), value.alias("value")))
    # One pass: the nodes are read once, and a node may be a keyword, a member and a property at a time.
    parts = F.array(
        part(c("kind").isin("string", "number", "boolean", "null") & c("key").isNotNull() & ~named, parent, c("key"), F.coalesce("json", "text")),
        part(item_attr != "", item_of, item_attr, F.when(item_attr.isin("anyOf", "oneOf", "allOf"), F.sha2("json", 256)).otherwise(c("json"))),
        part(named, F.regexp_replace(parent, r"\.properties$", ""), F.lit("property"), c("key")))
    nodes = payload_nodes(schemas, [id_col], column, reparse=False)
    return nodes.select(id_col, F.inline(F.filter(parts, lambda p: p.isNotNull())))


def missing_parts(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """(schema_id, path, attr, value) for every baseline row that a schema of ``observed`` does not hold.

    Baseline rows are numbered, and the numbers a schema holds become bitmaps of 4 KiB; full bitmaps are dropped, and only the
    unset bits of the others become rows. The baseline is neither collected nor repeated for a schema, and has no size limit.
    """
    c, keys = F.col, ["path", "attr", "value"]
    numbered = durable(row_position(baseline.select(*keys).distinct(), [], keys, "_n").withColumn("_n", c("_n") + 1))
    parts = numbered.count()
    if not parts:
        return observed.select("schema_id", *keys).limit(0)
    held = same_keys(observed.select("schema_id", *keys).distinct(), numbered, keys).groupBy(
        "schema_id", F.bitmap_bucket_number("_n").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits"))
    wanted = observed.select("schema_id").distinct().select(
        "schema_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(-(-parts // BITMAP_BITS)).cast("bigint"))).alias("_bucket")).withColumn(
        "_size", F.least(F.lit(BITMAP_BITS), F.lit(parts) - (c("_bucket") - 1) * BITMAP_BITS).cast("int"))
    lacking = wanted.join(held, ["schema_id", "_bucket"], "left").filter(F.coalesce(F.bitmap_count("_bits"), F.lit(0)) < c("_size"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((c("_size") - 1) / 8).cast("int")), lambda i: F.struct(
        i.alias("at"), F.coalesce(F.hex(F.substring(c("_bits"), i + 1, F.lit(1))), F.lit("00")).alias("byte")))
    pieces = lacking.select("schema_id", "_bucket", F.explode(F.filter(pieces, lambda p: p["byte"] != "FF")).alias("_p"))
    bits = pieces.select("schema_id", "_bucket", "_p.at", F.conv("_p.byte", 16, 10).cast("int").alias("_byte"),
                         F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit")).filter(F.expr("shiftright(_byte, _bit) & 1 = 0"))
    numbers = bits.select("schema_id", ((c("_bucket") - 1) * BITMAP_BITS + c("at") * 8 + c("_bit") + 1).alias("_n"))
    return numbers.join(numbered, "_n").select("schema_id", *keys)


def schema_drift(baseline: DataFrame, observed: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(verdicts, changes): exact, compatible or incompatible per observed schema.

    ``baseline``: path, attr, value; ``observed``: schema_id, path, attr, value. Only a new optional
    property of a closed object, a wider enum, more anyOf alternatives and annotations are
    compatible. At most ``limit`` changed places are listed; the count is exact. Rows without a schema id are left out.
    """
    c = F.col
    observed = observed.filter(c("schema_id").isNotNull())
    ids = observed.select("schema_id").distinct()
    base = baseline.select("path", "attr", "value").distinct()
    seen = observed.select("schema_id", "path", "attr", "value").distinct()
    missing = missing_parts(base, seen).withColumns({"_in_base": F.lit(True), "_in_new": F.lit(None).cast("boolean")})
    extra = same_keys(seen, base, ["path", "attr", "value"], "left_anti").withColumns(
        {"_in_base": F.lit(None).cast("boolean"), "_in_new": F.lit(True)})
    pairs = missing.unionByName(extra)
    closed = baseline.filter("attr = 'additionalProperties' AND value = 'false'").select("path", F.lit(True).alias("_closed"))
    still_closed = observed.filter("attr = 'additionalProperties' AND value = 'false'").select(
        "schema_id", "path", F.lit(True).alias("_still"))
    demanded = observed.filter("attr = 'required'").select(
        "schema_id", "path", F.regexp_replace("value", '"', "").alias("value"), F.lit(True).alias("_required"))
    new_property = observed.filter("attr = 'property'").select(
        "schema_id", F.concat("path", F.lit(".properties."), "value").alias("_inside")).join(
        baseline.filter("attr = 'property'").select(F.concat("path", F.lit(".properties."), "value").alias("_inside")),
        "_inside", "left_anti")
    changed = pairs.join(closed.distinct(), "path", "left").join(still_closed.distinct(), ["schema_id", "path"], "left").join(
        demanded.distinct(), ["schema_id", "path", "value"], "left")
    # Everything inside a new property belongs to that one change: a path meets the properties above it by its own prefixes.
    places = changed.select("schema_id", "path").distinct()
    ends = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: (i == F.length("path")) | F.substring(c("path"), i + 1, F.lit(1)).isin(".", "["))
    above = places.select("schema_id", "path", F.explode(F.transform(ends, lambda i: F.substring(c("path"), F.lit(1), i))).alias("_inside"))
    inside = above.join(new_property.distinct(), ["schema_id", "_inside"], "left_semi").select("schema_id", "path").distinct()
    changed = changed.join(inside, ["schema_id", "path"], "left_anti")
    added = c("_in_base").isNull()
    free = (c("attr").isin(*ANNOTATIONS) | (added & c("attr").isin("enum", "anyOf"))
            | (added & (c("attr") == "property") & F.coalesce("_closed", F.lit(False)) & F.coalesce("_still", F.lit(False))
               & ~F.coalesce("_required", F.lit(False))))
    place = F.concat("path", F.lit("."), "attr", F.when(c("attr") == "property", F.concat(F.lit("."), "value")).otherwise(""))
    rows = changed.select("schema_id", place.alias("place"), free.alias("compatible"))
    changes = rows.groupBy("schema_id", "place").agg(F.bool_and("compatible").alias("compatible"))
    counts = changes.groupBy("schema_id").agg(F.count(F.lit(1)).alias("change_count"), F.bool_and("compatible").alias("_ok"))
    verdicts = ids.join(counts, "schema_id", "left").select(
        "schema_id", F.when(c("change_count").isNull(), "exact").when(c("_ok"), "compatible").otherwise("incompatible")
        .alias("status"), F.coalesce("change_count", F.lit(0)).alias("change_count"))
    return verdicts, top_per_key(changes, ["schema_id"], ["place"], limit, "rank")


def compare_to(schemas: DataFrame, baseline_id: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Drift of all ``schemas(schema_id, schema)`` against the one named ``baseline_id``."""
    rows = durable(flatten_schemas(schemas))
    base = rows.filter(F.col("schema_id") == baseline_id).drop("schema_id")
    return schema_drift(base, rows.filter(F.col("schema_id") != baseline_id), limit)
