"""Session metadata candidates: service records and workspace key/value state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import variant as V
from palaver.functions.credentials import is_blank
from palaver.functions.identity import digest
from palaver.functions.values import to_epoch_ms
from palaver.functions.variant import MAX_SAFE_INTEGER
from palaver.operators.parse import SESSION_ID
from palaver.session import durable
from palaver.sources.messages import SESSION_LISTS, unwrap

# Keys of the workspace state.
ACTIVE_SESSION_KEY = "ai-chat-v2.lastActiveSessionId"
SESSION_INDEX_KEY = "chat.ChatSessionStore.index"


def _session_id(v: Column) -> Column:
    text = V.text(v)
    return F.when(text.rlike(SESSION_ID), text)


def _title(v: Column) -> Column:
    text = V.text(v)
    return F.when(~is_blank(text), text)


def _ms(v: Column) -> Column:
    return F.coalesce(V.safe_integer(v), to_epoch_ms(F.nullif(V.text(v), F.lit("")), "ms"))


def _s(v: Column) -> Column:
    value = V.integer_or_digits(v)
    return F.when(value <= MAX_SAFE_INTEGER // 1000, value * 1000)


def _issue(condition: Column, code: str, field: str | None = None) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit("error").alias("severity"),
                                      F.lit(field).cast("string").alias("field")))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("issues", F.filter("issues", lambda i: i.isNotNull())).withColumn(
        "has_error", F.size("issues") > 0)
    issues = rows.select("session_id", "workspace_id", "entry_index", F.explode("issues").alias("i")).select(
        "session_id", "workspace_id", "entry_index", "i.*")
    return rows.filter("accepted").drop("issues", "accepted"), issues


def parse_session_records(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, issues) of ``recs(entry_index, rec)``; priority 2.

    A record with only the local id is a list record: other time fields, in seconds.
    """
    rec = F.col("rec")
    names = ("chat_session_id", "session_id", "created_at", "updated_at", "update_at", "parent_session_id", "title", "name")
    # The members are read once; everything below works on these columns.
    recs = recs.select("entry_index", V.obj(rec).isNull().alias("_no_object"), digest(F.to_json(rec)).alias("_digest"),
                       *[V.field(rec, f"$.{name}").alias(name) for name in names])
    recs = durable(recs.select("*", _session_id(F.col("chat_session_id")).alias("_modern"),
                               _session_id(F.col("session_id")).alias("_local")))
    get = F.col
    modern, local = F.col("_modern"), F.col("_local")
    no_id = ((get("chat_session_id").isNotNull() & modern.isNull())
             | (get("session_id").isNotNull() & local.isNull())
             | F.coalesce(modern != local, F.lit(False)) | F.coalesce(modern, local).isNull() | F.col("_no_object"))
    is_list = local.isNotNull() & modern.isNull()
    created_v = get("created_at")
    updated_v = F.when(is_list, get("update_at")).otherwise(get("updated_at"))
    time = lambda v: F.when(is_list, _s(v)).otherwise(_ms(v))
    parent_v, owner = get("parent_session_id"), F.coalesce(modern, local)
    given_parent = ~V.is_absent(parent_v) & ~F.coalesce(V.text(parent_v) == "", F.lit(False))
    parent = F.when(given_parent, _session_id(parent_v))
    wrong_type = lambda v: ~V.is_absent(v) & ~V.is_text(v)
    issues = F.when(no_id, F.array(_issue(F.lit(True), "SESSION_RECORD_INVALID"))).otherwise(F.array(
        _issue(wrong_type(get("title")) | wrong_type(get("name")), "SESSION_RECORD_INVALID", "title"),
        _issue(created_v.isNotNull() & time(created_v).isNull(), "SESSION_TIMESTAMP_INVALID", "created_at"),
        _issue(updated_v.isNotNull() & time(updated_v).isNull(), "SESSION_TIMESTAMP_INVALID", "updated_at"),
        _issue((given_parent & parent.isNull()) | F.coalesce(parent == owner, F.lit(False)),
               "SESSION_RECORD_INVALID", "parent_id")))
    rows = recs.select(
        F.when(~no_id, owner).alias("session_id"), F.lit(None).cast("string").alias("workspace_id"),
        "entry_index", F.coalesce(_title(get("title")), _title(get("name"))).alias("title"),
        time(created_v).alias("created_at"), time(updated_v).alias("updated_at"),
        F.when(parent != owner, parent).alias("parent_id"), F.lit(2).alias("priority"),
        F.lit("runtime-metadata").alias("kind"),
        F.when(is_list, "chat.getSessions").otherwise("chat.getSessionMetadata").alias("locator"),
        F.col("_digest").alias("digest"), issues.alias("issues"), (~no_id).alias("accepted"))
    return _split(rows)


def read_session_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, issues) of saved session-list responses, one JSON response per line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    recs, bad = unwrap(lines, [], "value", SESSION_LISTS, "SESSION_RECORD_INVALID")
    candidates, issues = parse_session_records(recs)
    return candidates, issues.unionByName(bad, allowMissingColumns=True)


def read_kv_sessions(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, issues) of ``kv(workspace_id, key, value)``.

    The active-session key gives an id (priority 0); the index gives titled entries (priority 1)
    whose key must equal the id inside.
    """
    none = lambda kind: F.lit(None).cast(kind)
    active_id = F.when(F.col("value").rlike(SESSION_ID), F.col("value"))
    active = kv.filter(F.col("key") == ACTIVE_SESSION_KEY).select(
        active_id.alias("session_id"), "workspace_id", none("int").alias("entry_index"),
        none("string").alias("title"), none("bigint").alias("created_at"), none("bigint").alias("updated_at"),
        none("string").alias("parent_id"), F.lit(0).alias("priority"),
        F.lit("workspace-active-session").alias("kind"), F.lit(f"ItemTable:{ACTIVE_SESSION_KEY}").alias("locator"),
        digest(F.col("value")).alias("digest"),
        F.array(_issue(active_id.isNull(), "SESSION_RECORD_INVALID")).alias("issues"),
        active_id.isNotNull().alias("accepted"))
    parsed = F.try_parse_json("value")
    entries = F.try_variant_get(V.field(F.col("v"), "$.entries"), "$", "map<string,variant>")
    index = kv.filter(F.col("key") == SESSION_INDEX_KEY).withColumn("v", parsed).withColumn(
        "entries", F.when(V.safe_integer(V.field(F.col("v"), "$.version")) == 1, entries))
    broken = index.filter("entries IS NULL").select(
        none("string").alias("session_id"), "workspace_id", none("int").alias("entry_index"),
        F.lit("SESSION_RECORD_INVALID").alias("code"), F.lit("error").alias("severity"),
        none("string").alias("field"))
    # Entry numbers follow the sorted keys of one workspace index.
    names = index.filter("entries IS NOT NULL").select(
        "workspace_id", "entries", F.posexplode(F.array_sort(F.map_keys("entries"))).alias("entry_index", "name"))
    entry = F.try_element_at("entries", F.col("name"))
    rows = names.withColumn("e", entry)
    e = F.col("e")
    own = F.when(F.col("name").rlike(SESSION_ID) & V.obj(e).isNotNull(), F.col("name"))
    created = _ms(V.field(e, "$.timing.startTime"))
    updated = F.coalesce(_ms(V.field(e, "$.timing.endTime")), _ms(V.field(e, "$.lastMessageDate")))
    title = _title(V.field(e, "$.title"))
    incomplete = (~F.coalesce(_session_id(V.field(e, "$.sessionId")) == own, F.lit(False)) | title.isNull()
                  | created.isNull() | updated.isNull())
    indexed = rows.select(
        own.alias("session_id"), "workspace_id", "entry_index", title.alias("title"),
        created.alias("created_at"), updated.alias("updated_at"), none("string").alias("parent_id"),
        F.lit(1).alias("priority"), F.lit("workspace-session-index").alias("kind"),
        F.lit(f"ItemTable:{SESSION_INDEX_KEY}").alias("locator"), digest(F.to_json(e)).alias("digest"),
        F.array(_issue(own.isNull() | incomplete, "SESSION_RECORD_INVALID")).alias("issues"),
        own.isNotNull().alias("accepted"))
    candidates, issues = _split(active.unionByName(indexed))
    return candidates, issues.unionByName(broken)


def read_kv_session_ids(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, faults): only the session ids of a workspace state, for an inventory."""
    candidates, issues = read_kv_sessions(kv)
    return candidates.select("workspace_id", "session_id").distinct(), issues.select("workspace_id").distinct()
