"""The bundle: nested JSON on the outside, one table per kind of row inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.identity import digest
from palaver.operators.payload import assert_no_credentials
from palaver.operators.rules import bundle_rules, validate_rows

_REFS = ("array<struct<workspaceStorageId:string,sourceSessionId:string,locator:struct<type:string,value:string>,"
         "parserProfile:struct<id:string,version:int>,sha256:string>>")
BUNDLE = (
    "schemaVersion int, createdAt string, source struct<product:struct<name:string,version:string>,platform:string,"
    "profile:struct<id:string,version:int,verification:string>,sourceFingerprint:string,collectedAt:string>,"
    f"projects array<struct<sourceId:string,name:string,path:string,sourceRefs:{_REFS}>>,"
    "sessions array<struct<sourceId:string,title:string,projectSourceId:string,projectPath:string,"
    "parentSourceId:string,createdAt:bigint,updatedAt:bigint,recovery:string,events:array<struct<type:string,"
    "sourceId:string,order:bigint,createdAt:bigint,completedAt:bigint,turnSourceId:string,replyToSourceId:string,"
    "status:string,text:string,content:array<struct<type:string,text:string,callId:string,name:string,"
    "input:variant,output:variant,error:variant,status:string,createdAt:bigint,completedAt:bigint,"
    f"sourceRefs:{_REFS}>>,sourceRefs:{_REFS}>>,resources:array<struct<sourceId:string,type:string,"
    "availability:string,relativePath:string,mimeType:string,sha256:string,sizeBytes:bigint,"
    f"sourceRefs:{_REFS}>>,sourceRefs:{_REFS}>>,"
    "diagnostics array<struct<id:string,severity:string,code:string,message:string,"
    f"subject:struct<type:string,sourceId:string>,sourceRefs:{_REFS},context:variant>>"
)
# Fixed value: largest bundle file that is accepted.
MAX_BUNDLE_BYTES = 1024 ** 3


def _refs(column: str):
    """References under our own field names."""
    return F.transform(F.col(column), lambda r: F.struct(
        r["workspaceStorageId"].alias("workspace_id"), r["sourceSessionId"].alias("session_id"),
        r["locator"].alias("locator"), r["parserProfile"].alias("profile"), r["sha256"].alias("sha256")))


def explode_bundle(bundle: DataFrame) -> dict[str, DataFrame]:
    """The normalised tables of nested bundle rows."""
    source = bundle.select("schemaVersion", "createdAt", "source.*")
    projects = bundle.select(F.explode("projects").alias("p")).select("p.*").select(
        F.col("sourceId").alias("project_id"), "name", "path", _refs("sourceRefs").alias("refs"))
    nested = bundle.select(F.explode("sessions").alias("s")).select("s.*")
    sessions = nested.select(
        F.col("sourceId").alias("session_id"), "title", F.col("projectSourceId").alias("project_id"),
        F.col("projectPath").alias("project_path"), F.col("parentSourceId").alias("parent_id"),
        F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"), "recovery",
        _refs("sourceRefs").alias("refs"))
    rows = nested.select(F.col("sourceId").alias("session_id"), F.posexplode("events").alias("pos", "e"))
    events = rows.select("session_id", "pos", "e.*").select(
        "session_id", "pos", F.col("sourceId").alias("event_id"), "type", F.col("order").alias("ord"),
        F.col("createdAt").alias("created_at"), F.col("completedAt").alias("completed_at"),
        F.col("turnSourceId").alias("turn_id"), F.col("replyToSourceId").alias("reply_to"), "status", "text",
        _refs("sourceRefs").alias("refs"))
    blocks = rows.select("session_id", F.col("e.sourceId").alias("event_id"),
                         F.posexplode("e.content").alias("pos", "b")).select(
        "session_id", "event_id", "pos", "b.*").select(
        "session_id", "event_id", "pos", "type", "text", F.col("callId").alias("call_id"), "name",
        *[F.when(F.col(c).isNotNull(), F.to_json(c)).alias(c) for c in ("input", "output", "error")], "status",
        F.col("createdAt").alias("created_at"), F.col("completedAt").alias("completed_at"),
        _refs("sourceRefs").alias("refs"))
    resources = nested.select(F.col("sourceId").alias("session_id"), F.explode("resources").alias("r")).select(
        "session_id", "r.*").select(
        "session_id", F.col("sourceId").alias("resource_id"), "type", "availability",
        F.col("relativePath").alias("relative_path"), F.col("mimeType").alias("mime_type"), "sha256",
        F.col("sizeBytes").alias("size_bytes"), _refs("sourceRefs").alias("refs"))
    diagnostics = bundle.select(F.explode("diagnostics").alias("d")).select("d.*").select(
        "id", "severity", "code", "message", F.col("subject.type").alias("subject_type"),
        F.col("subject.sourceId").alias("subject_id"), _refs("sourceRefs").alias("refs"),
        F.when(F.col("context").isNotNull(), F.to_json("context")).alias("context"))
    return {"source": source, "projects": projects, "sessions": sessions, "events": events, "blocks": blocks,
            "resources": resources, "diagnostics": diagnostics}


def check_bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """Broken shape rules of all tables: table, row key, path, keyword, message."""
    keys = {"projects": ["project_id"], "sessions": ["session_id"], "events": ["session_id", "pos"],
            "blocks": ["session_id", "event_id", "pos"], "resources": ["session_id", "resource_id"],
            "diagnostics": ["id"]}
    result = None
    for name, rules in bundle_rules().items():
        found = validate_rows(tables[name], rules, keys[name]).select(
            F.lit(name).alias("table"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys[name]]).alias("row"),
            "path", "keyword", "message")
        result = found if result is None else result.unionByName(found)
    return result


TEXT_COLUMNS = {"sessions": (["session_id"], ["title"]), "events": (["session_id", "pos"], ["text"]),
                "blocks": (["session_id", "event_id", "pos"], ["text", "input", "output", "error"])}


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of one bundle file or a folder of them; size, JSON, credential and shape checks first."""
    sizes = spark.read.format("binaryFile").load(path).select("length")
    if not sizes.filter(F.col("length") > MAX_BUNDLE_BYTES).isEmpty():
        raise ValueError("BUNDLE_TOO_LARGE")
    raw = (spark.read.schema(BUNDLE + ", _broken string").option("multiLine", True)
           .option("columnNameOfCorruptRecord", "_broken").json(path))
    if not raw.filter("_broken IS NOT NULL OR schemaVersion IS NULL OR schemaVersion <> 1").isEmpty():
        raise ValueError("BUNDLE_INVALID_JSON")
    # Unknown fields are lost by an explicit schema, so their names are checked on the raw text.
    names = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    allowed = F.array(*[F.lit(n) for n in ("schemaVersion", "createdAt", "source", "projects", "sessions",
                                            "diagnostics")])
    keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    if not names.filter(F.size(F.array_except(keys, allowed)) > 0).isEmpty():
        raise ValueError("BUNDLE_SCHEMA_INVALID: unknown field")
    tables = explode_bundle(raw)
    for name, (row_key, columns) in TEXT_COLUMNS.items():
        assert_no_credentials(tables[name], row_key, columns)
    if not check_bundle(tables).isEmpty():
        raise ValueError("BUNDLE_SCHEMA_INVALID")
    return tables


def bundle_row_hashes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, hash) of every row, for a hash of the whole bundle."""
    result = None
    for name in sorted(tables):
        plain = [c for c in tables[name].columns]
        rows = tables[name].select(F.sha2(F.to_json(F.struct(F.lit(name).alias("_table"), *plain)), 256).alias("h"))
        result = rows if result is None else result.unionByName(rows)
    return result


def write_bundle(tables: dict[str, DataFrame], out: str, check: bool = True) -> str:
    """One Parquet folder per table below a new folder ``out``; returns the bundle hash.

    Nothing is written when a text holds a credential, and an existing table is never replaced.
    """
    from palaver.operators.ordered import set_hash
    if check:
        for name, (row_key, columns) in TEXT_COLUMNS.items():
            if name in tables:
                assert_no_credentials(tables[name], row_key, columns)
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    stored = {name: spark.read.parquet(f"{out}/{name}") for name in tables}
    return set_hash(bundle_row_hashes(stored), [], "h", "bundle_hash").first()["bundle_hash"]


def export_header(source: DataFrame) -> DataFrame:
    """The bundle header as one canonical JSON line."""
    return source.select(F.to_json(F.struct(*sorted(source.columns))).alias("json")).withColumn(
        "hash", digest(F.col("json")))
