"""Walking nested payloads: leaves, credentials and resource paths inside JSON of any depth."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import variant as V
from palaver.functions.credentials import (
    MARKER, credential_key, has_credentials, js_trim, populated_text, redact_hit, redact_text,
)
from palaver.functions.paths import percent_decode
from palaver.session import durable, spread

# A text without any of these cannot hold a credential, not even an encoded one.
_SUSPICIOUS = (
    r"(?i)key|secret|token|passw|authorization|cookie|credential|\\|%[0-9a-f]{2}|gh[pousr]_|github_pat_|npm_"
    r"|sk-|xox[baprs]-|glpat-|hf_|aiza|akia|asia|eyj|-----begin|://|bearer|basic|signature|sig=|--"
)


def suspicious(text: Column) -> Column:
    return text.rlike(_SUSPICIOUS)


def _kind(v: Column, text: Column) -> Column:
    shape = F.schema_of_variant(v)
    return (F.when(v.isNull() & text.isNotNull(), "string")
            .when(F.startswith(shape, F.lit("OBJECT")), "object")
            .when(F.startswith(shape, F.lit("ARRAY")), "array")
            .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
            .when(shape == "VOID", "null").otherwise("number"))


def _walk(df: DataFrame, column: str, reparse: bool = True, decode: bool = False, max_depth: int | None = None,
          prune: bool = False) -> list[DataFrame]:
    """The nodes of the JSON text ``column`` of rows ``_k``, one stored table a level of nesting.

    Columns: _k, place (positions from the root, one of a kind), parent (its place), pos, path, key, kind, v, text, depth, and
    whether a node is opened. With ``prune`` only nodes whose text could hold a credential are opened. The rows are dealt over all
    tasks first, and every level is written by the tasks that read the one above.
    """
    raw = F.col(column)
    level = spread(df.select("_k", column)).select("_k", F.lit("").alias("place"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"),
                      F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"),
                      F.try_parse_json(raw).alias("v"), raw.alias("_raw"), F.lit(0).alias("depth"))
    # A plain text has no variant; it is kept as the text of a string node.
    level = level.filter(F.col("_raw").isNotNull()).withColumn(
        "text", F.when(F.col("v").isNull(), F.col("_raw")).otherwise(V.text(F.col("v")))).drop("_raw")
    found: list[DataFrame] = []
    kind = _kind(F.col("v"), F.col("text"))
    trimmed = js_trim(F.col("text"))
    could = suspicious(F.coalesce("text", F.to_json("v"))) if prune else F.lit(True)
    inner = F.when((F.col("kind") == "string") & trimmed.rlike(r'^[{\["]') & could, F.try_parse_json(trimmed))
    opening = {"_inner": inner if reparse else F.lit(None).cast("variant"), "_open": F.col("kind").isin("object", "array") & could}
    for depth in itertools.count():
        level = durable(level.withColumn("kind", kind).withColumns(opening))
        if depth and level.isEmpty():
            return found
        if max_depth is not None and depth > max_depth:
            raise ValueError("SENSITIVE_SCAN_LIMIT: depth")
        found.append(level)
        level = _next_level(level, decode)


def _size() -> Column:
    return F.coalesce(F.size(F.try_variant_get("v", "$", "map<string,variant>")), F.size(F.try_variant_get("v", "$", "array<variant>")))


def payload_nodes(df: DataFrame, keys: Sequence[str], column: str, reparse: bool = True,
                  decode: bool = False, max_depth: int | None = None, prune: bool = False) -> DataFrame:
    """Every node of the JSON text ``column``, one level of nesting per round.

    Columns: keys, path, key, kind, text (strings), size (containers), json, depth. With
    ``reparse`` a string that holds JSON is opened too; with ``decode`` a percent-encoded string is
    also shown decoded. Text that is not JSON is one string node. The walk goes on until a level is
    empty, whatever its depth and size; only a ``max_depth`` that a caller asks for is an error. With ``prune``
    what lies below a node without any sign of a credential is not shown.
    """
    found: DataFrame | None = None
    for level in _walk(df.select(F.struct(*keys).alias("_k"), F.col(column).alias("_column")), "_column", reparse, decode, max_depth, prune):
        shown = level.select(
            *[F.col("_k")[name].alias(name) for name in keys], "path", "key",
            F.when(F.col("_inner").isNotNull(), "json").otherwise(F.col("kind")).alias("kind"), "text",
            F.when(F.col("kind").isin("object", "array"), _size()).cast("bigint").alias("size"),
            F.when(F.col("v").isNotNull(), F.to_json("v")).alias("json"),
            F.col("depth").cast("bigint").alias("depth"))
        found = shown if found is None else found.unionByName(shown)
    return found


def _next_level(level: DataFrame, decode: bool) -> DataFrame:
    spark = level.sparkSession
    below = (F.col("depth") + 1).alias("depth")
    containers = level.filter("_open").select("_k", F.col("place").alias("parent"), F.col("path").alias("_path"), F.col("v").alias("_v"), "depth")
    members = containers.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(
        "_k", F.concat("parent", F.lit("/"), F.col("pos")).alias("place"), "parent", "pos",
        F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), F.col("pos"), F.lit("]")))
        .otherwise(F.concat("_path", F.lit("."), F.col("key"))).alias("path"),
        "key", F.col("value").alias("v"), V.text(F.col("value")).alias("text"), below)

    def only_child(rows: DataFrame, mark: str, v: Column, text: Column) -> DataFrame:
        return rows.select("_k", F.concat("place", F.lit(f"/{mark}")).alias("place"), F.col("place").alias("parent"), F.lit(0).alias("pos"),
                           F.concat("path", F.lit(mark)).alias("path"), F.lit(None).cast("string").alias("key"), v.alias("v"), text.alias("text"), below)
    result = members.unionByName(only_child(level.filter("_inner IS NOT NULL"), "#", F.col("_inner"), V.text(F.col("_inner"))))
    if decode:
        plain = level.filter((F.col("kind") == "string") & F.col("_inner").isNull() & F.col("text").rlike("(?i)%[0-9a-f]{2}"))
        decoded = only_child(plain, "%", F.lit(None).cast("variant"), percent_decode(F.col("text")))
        result = result.unionByName(decoded.filter("text IS NOT NULL"))
    return result


def payload_leaves(df: DataFrame, keys: Sequence[str], column: str, **options) -> DataFrame:
    """The scalar nodes: keys, path, key, kind, value, depth."""
    nodes = payload_nodes(df, keys, column, **options)
    return nodes.filter(F.col("kind").isin("string", "number", "boolean", "null")).select(
        *keys, "path", "key", "kind", F.coalesce("text", "json").alias("value"), "depth")


def _sensitive(nodes: DataFrame) -> Column:
    populated = (F.when(F.col("kind").isin("string", "json"), populated_text(F.col("text")))
                 .when(F.col("kind").isin("object", "array"), F.col("size") > 0)
                 .otherwise(F.col("kind") != "null"))
    in_text = F.when(F.col("kind") == "string", has_credentials(F.col("text"))).otherwise(False)
    by_key = F.coalesce(credential_key(F.col("key")) & populated, F.lit(False))
    return in_text | by_key | F.coalesce(has_credentials(F.col("key")), F.lit(False))


def has_credentials_nested(df: DataFrame, keys: Sequence[str], column: str, out: str = "hit") -> DataFrame:
    """``out``: any credential in the text or JSON of ``column``, however it is nested or encoded.

    ``keys`` identify the rows, NULL is a value of a key like others. A cheap filter on the raw text decides which
    rows are opened at all, and inside which nodes are. The join is a sort-merge join by a hint: beside a VARIANT keys count as a
    few thousandths of a file, and a broadcast chosen by that size would pass the keys of all hits through the driver.
    """
    keys = list(keys)
    nodes = payload_nodes(df.filter(suspicious(F.col(column))), keys, column, decode=True, prune=True)
    hits = nodes.filter(_sensitive(nodes)).select(F.struct(*keys).alias("_row")).distinct().withColumn(out, F.lit(True))
    return df.withColumn("_row", F.struct(*keys)).join(hits.hint("merge"), "_row", "left").drop("_row").withColumn(out, F.coalesce(out, F.lit(False)))


def assert_no_credentials(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The table unchanged; a hit in any column stops the run before anything is written."""
    for column in columns:
        if not has_credentials_nested(df, keys, column).filter("hit").select(F.lit(1)).limit(1).isEmpty():
            raise ValueError(f"SENSITIVE_CONTENT_REQUIRES_REBINDING: column {column}")
    return df


def redact_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plain-text columns with credentials replaced and ``redacted_count`` summed over them."""
    total = F.lit(0).cast("bigint")
    for column in columns:
        # The cheap test decides per row; only rows with a hit pay for the replacements.
        df = df.withColumn(f"_h_{column}", has_credentials(F.col(column)))
        df = df.withColumn(f"_r_{column}", F.when(F.col(f"_h_{column}"), redact_hit(F.col(column))))
        total = total + F.coalesce(F.col(f"_r_{column}")["count"], F.lit(0))
    df = df.withColumn("redacted_count", total)
    for column in columns:
        df = df.withColumn(column, F.coalesce(F.col(f"_r_{column}")["value"], F.col(column))).drop(
            f"_r_{column}", f"_h_{column}")
    return df


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def redact_payloads(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """JSON-text ``column`` with credential values replaced, and ``redacted_count``.

    A value under a sensitive key becomes the marker, whatever it holds; a string is redacted as text, or opened and
    redacted inside when it holds JSON, however deep; a key that is a token gets a name that its hash gives. The nodes of a payload
    are found from the root down and its text is made anew from the deepest change up: only the
    containers above a change are rebuilt, each of them once, so the work does not grow with the number of changes in
    one payload. The result is scanned again and masked as a whole when anything is left. No join is a broadcast, whatever
    the files of a level seem to weigh.
    """
    keys = list(keys)
    df = durable(spread(df))
    checked = durable(has_credentials_nested(df, keys, column, "_hit").withColumn("_id", F.struct(*keys)))
    dirty = checked.filter("_hit").select("_id", F.col(column).alias("_json"))
    if dirty.isEmpty():
        return checked.drop("_hit", "_id").withColumn("redacted_count", F.lit(0).cast("bigint"))
    canonical = dirty.withColumn("_json", F.coalesce(F.to_json(F.try_parse_json("_json")), _quoted(F.col("_json"))))
    built: DataFrame | None = None  # what the changes one level down make of their containers: _id, place, body, n
    columns = _change_columns()
    for level in reversed(_walk(canonical.withColumnRenamed("_id", "_k"), "_json", prune=True)):
        level = level.withColumnRenamed("_k", "_id")
        changes = durable(_changes(level, built, columns))
        built = _rebuilt(level, changes)
    edited = changes.select("_id", F.col("json").alias("_new"), F.greatest("n", F.lit(1)).alias("_n"))
    edited = canonical.join(edited.hint("merge"), "_id", "left").select("_id", F.coalesce("_new", "_json").alias("_json"), F.coalesce("_n", F.lit(1)).alias("_n"))
    rescanned = has_credentials_nested(durable(edited), ["_id"], "_json", "_left").select(
        "_id", F.when(F.col("_left"), F.lit(f'"{MARKER}"')).otherwise(F.col("_json")).alias("_json"), "_n")
    return (checked.drop("_hit").join(rescanned.hint("merge"), "_id", "left")
            .withColumn(column, F.coalesce("_json", column))
            .withColumn("redacted_count", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_json", "_n", "_id"))


def _change_columns() -> tuple[dict[str, Column], list[Column]]:
    """What ``_changes`` computes; the same for every level."""
    kind = F.col("kind")
    populated = (F.when(kind == "string", populated_text(F.col("text")))
                 .when(kind.isin("object", "array"), _size() > 0).otherwise(kind != "null"))
    plain = F.when((kind == "string") & F.col("_inner").isNull() & suspicious(F.col("text")), redact_text(F.col("text")))
    tests = {"_by_key": F.coalesce(credential_key(F.col("key")) & populated, F.lit(False)),
             "_token": F.coalesce(has_credentials(F.col("key")), F.lit(False)), "_plain": plain}
    cleaned = F.when(F.col("_plain.count") > 0, _quoted(F.col("_plain.value")))
    opened = (F.when(kind == "object", F.concat(F.lit("{"), "body", F.lit("}"))).when(kind == "array", F.concat(F.lit("["), "body", F.lit("]")))
              .otherwise(_quoted(F.col("body"))))
    json = F.when(F.col("_by_key"), F.lit(f'"{MARKER}"')).when(F.col("body").isNotNull(), opened).otherwise(cleaned)
    inside = F.coalesce("inside", F.lit(0)) + F.coalesce("_plain.count", F.lit(0))
    n = F.when(F.col("_by_key"), 1).otherwise(inside) + F.col("_token").cast("int")
    name = F.when(F.col("_token"), F.concat(F.lit("[REDACTED_KEY_"), F.substring(F.sha2("key", 256), 1, 8), F.lit("]")))
    return tests, [F.col("_id"), F.col("place"), F.col("parent"), json.alias("json"), name.alias("name"), n.cast("bigint").alias("n")]


def _changes(level: DataFrame, built: DataFrame | None, columns: tuple[dict[str, Column], list[Column]]) -> DataFrame:
    """The changed nodes of a level: _id, place, parent, json (their new text), name (their new key), n (credentials taken out)."""
    # Only what was opened or could hold a credential itself meets the changes below; the tests come first, so no payload is shuffled.
    could = F.col("_open") | F.col("_inner").isNotNull() | suspicious(F.concat_ws(" ", "key", "text"))
    rows = level.filter(could).withColumns(columns[0])
    if built is None:
        rows = rows.withColumns({"body": F.lit(None).cast("string"), "inside": F.lit(0).cast("bigint")})
    else:
        rows = rows.drop("v", "text", "_inner").join(built.hint("merge"), ["_id", "place"], "left")
    return rows.select(*columns[1]).filter("n > 0")


def _rebuilt(level: DataFrame, changes: DataFrame) -> DataFrame:
    """_id, place, body, inside of every parent of a change: the texts of all its children in their order, changed or as they were."""
    touched = changes.select("_id", "parent").distinct()
    new = changes.select("_id", "place", F.col("json").alias("_new"), "name", "n")
    own = F.coalesce(F.to_json("v"), _quoted(F.col("text")))
    children = level.select("_id", "place", "parent", "pos", "key", own.alias("_own")).join(
        touched.hint("merge"), ["_id", "parent"], "left_semi").join(new.hint("merge"), ["_id", "place"], "left")
    text = F.coalesce("_new", "_own")
    part = F.when(F.col("key").isNotNull(), F.concat(_quoted(F.coalesce("name", "key")), F.lit(":"), text)).otherwise(text)
    return children.groupBy("_id", F.col("parent").alias("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), ",").alias("body"),
        F.sum("n").alias("inside"))


RESOURCE_PATH = r"(?:^|[\\/])(?:long-text|paste-files)(?:[\\/]|$)"


def resource_paths(df: DataFrame, keys: Sequence[str], column: str, max_depth: int | None = None) -> DataFrame:
    """Members named filePath or relatePath whose text looks like a stored resource, with locator."""
    nodes = payload_nodes(df, keys, column, reparse=False, max_depth=max_depth)
    return nodes.filter(F.col("key").isin("filePath", "relatePath") & (F.col("kind") == "string")
                        & F.col("text").rlike(RESOURCE_PATH)).select(
        *keys, F.substring("path", F.lit(3), F.length("path")).alias("locator"), F.col("text").alias("value"))
