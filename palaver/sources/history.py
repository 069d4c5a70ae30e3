"""Input history of workspaces: the prompts a user typed, with attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import variant as V
from palaver.functions.credentials import is_blank
from palaver.functions.identity import digest

# Fixed value: the state key ends with this name.
HISTORY_KEY_SUFFIX = "agent-storage-input-history"


def _full(v: Column) -> Column:
    text = V.text(v)
    return F.when(text != "", text)


def _dimension(item: Column, *names: str) -> tuple[Column, Column]:
    given = F.coalesce(*[F.when(~V.is_absent(V.field(item, f"$.{n}")), V.field(item, f"$.{n}")) for n in names])
    value = V.integer_or_digits(given)
    value = F.when(value > 0, value)
    return value, given.isNull() | value.isNotNull()


def _file(item: Column) -> Column:
    width, width_ok = _dimension(item, "imageWidth", "width")
    height, height_ok = _dimension(item, "imageHeight", "height")
    mode = V.field(item, "$.uploadMode")
    names = {"id": "id", "name": "name", "type": "type", "uri": "resourceUri", "kind": "kind"}
    size = V.integer_or_digits(V.field(item, "$.size"))
    ok = size.isNotNull() & width_ok & height_ok & (mode.isNull() | _full(mode).isNotNull())
    for raw in names.values():
        ok = ok & _full(V.field(item, f"$.{raw}")).isNotNull()
    return F.struct(
        *[_full(V.field(item, f"$.{raw}")).alias(n) for n, raw in names.items()], size.alias("size_bytes"),
        _full(mode).alias("upload_mode"), width.alias("width"), height.alias("height"),
        (V.obj(item).isNotNull() & ok).alias("ok"))


def read_input_history(kv: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, issues) of ``kv(workspace_id, key, value)``.

    Every entry has its text, parsed query (canonical JSON), media, files, a content hash and the
    source it came from. An entry with an invalid member or without content is an issue.
    """
    match = F.col("key") == key if key else F.endswith("key", F.lit(HISTORY_KEY_SUFFIX))
    rows = kv.filter(match).withColumn("list", V.array(F.try_parse_json("value")))
    broken = rows.filter("list IS NULL").select(
        "workspace_id", F.lit(None).cast("int").alias("entry_index"),
        F.lit("HISTORY_CONTAINER_INVALID").alias("code"), F.lit("error").alias("severity"))
    items = rows.filter("list IS NOT NULL").select(
        "workspace_id", "key", F.posexplode("list").alias("entry_index", "e"))
    e = F.col("e")
    text = V.text(V.field(e, "$.inputText"))
    query = V.field(e, "$.parsedQuery")
    parts, media = V.array(query), V.array(V.field(e, "$.multiMedia"))
    files_v = V.field(e, "$.files")
    files = F.when(files_v.isNull(), F.array().cast("array<variant>")).otherwise(V.array(files_v))
    media_of = F.transform(media, lambda m: F.struct(
        _full(V.field(m, "$.resource_id")).alias("resource_id"),
        _full(V.field(m, "$.resource_type")).alias("resource_type")))
    files_of = F.transform(files, _file)
    valid = (V.obj(e).isNotNull() & text.isNotNull()
             & F.forall(parts, lambda p: V.is_text(p) | V.obj(p).isNotNull())
             & F.forall(media_of, lambda m: m["resource_id"].isNotNull() & m["resource_type"].isNotNull())
             & F.forall(files_of, lambda f: f["ok"])
             & (~is_blank(text) | (F.size(parts) > 0) | (F.size(media) > 0) | (F.size(files) > 0)))
    typed = items.select(
        "workspace_id", "entry_index", text.alias("input_text"), F.to_json(query).alias("parsed_query"),
        media_of.alias("media"), F.transform(files_of, lambda f: f.dropFields("ok")).alias("files"),
        F.concat(F.lit("ItemTable:"), "key", F.lit("["), "entry_index", F.lit("]")).alias("locator"),
        digest(F.to_json(e)).alias("source_digest"), F.coalesce(valid, F.lit(False)).alias("_valid"))
    content = F.to_json(F.struct("files", "input_text", "media", F.try_parse_json("parsed_query").alias("parsed_query")))
    entries = typed.filter("_valid").withColumn("digest", digest(content)).drop("_valid")
    issues = typed.filter("NOT _valid").select(
        "workspace_id", "entry_index", F.lit("HISTORY_ENTRY_INVALID").alias("code"),
        F.lit("error").alias("severity"))
    return entries, issues.unionByName(broken)
