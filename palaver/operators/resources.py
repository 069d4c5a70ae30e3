"""Files that messages refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.paths import file_uri_to_path, normalize_posix
from palaver.operators.payload import RESOURCE_PATH, resource_paths
from palaver.session import durable

WORKSPACE_ID = r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,255}$"


def resource_id(workspace_id: Column, relative_path: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(
        relative_path.alias("relativePath"), workspace_id.alias("workspaceStorageId"))), 256))


def local_resource_path(storage_root: str, workspace_id: Column, value: Column) -> Column:
    """Path below the workspace when the layout is one of the two known ones; else NULL."""
    root = F.concat(F.lit(storage_root.rstrip("/") + "/"), workspace_id)
    decoded = F.when(F.startswith(value, F.lit("file:")), file_uri_to_path(value, "linux")).otherwise(value)
    absolute = normalize_posix(F.when(F.startswith(decoded, F.lit("/")), decoded).otherwise(
        F.concat(root, F.lit("/"), decoded)))
    inside = F.startswith(absolute, F.concat(root, F.lit("/")))
    relative = F.when(inside, F.substring(absolute, F.length(root) + 2, F.length(absolute)))
    known = relative.rlike(r"^(?:paste-files/[^/]+|long-text/[^/]+/[^/]+/[^/]*[^/.][^/]*\.txt)$")
    return F.when(workspace_id.rlike(WORKSPACE_ID) & known, relative)


def stored_entries(inventory: DataFrame) -> DataFrame:
    """(workspace_id, relative_path, size_bytes, mime, readable, is_file): the inventory by entry of the resource folders.

    Files below ``paste-files/<name>/`` show that the entry is a folder; it is one row that is not a file and cannot be read.
    """
    entry = F.regexp_extract("relative_path", "^paste-files/[^/]+", 0)
    deep = F.coalesce(F.col("relative_path").rlike("^paste-files/[^/]+/"), F.lit(False))
    files = inventory.filter(~deep).select("workspace_id", "relative_path", "size_bytes", "mime", F.coalesce("readable", F.lit(False)).alias("readable"),
                                     F.lit(True).alias("is_file"))
    folders = inventory.filter(deep).select("workspace_id", entry.alias("relative_path")).distinct()
    return files.unionByName(folders.withColumns({"readable": F.lit(False), "is_file": F.lit(False)}), allowMissingColumns=True)


def file_issues(entries: DataFrame) -> DataFrame:
    """(workspace_id, relative_path, code, severity): folders in place of files, files that cannot be read, unknown contents."""
    code = (F.when(~F.col("is_file"), "RESOURCE_LAYOUT_INVALID").when(~F.col("readable"), "RESOURCE_READ_FAILED")
            .when(F.col("mime") == "application/octet-stream", "RESOURCE_MIME_UNKNOWN"))
    severity = F.when(F.col("code") == "RESOURCE_MIME_UNKNOWN", "warning").otherwise("error")
    return entries.withColumn("code", code).filter("code IS NOT NULL").select(
        "workspace_id", "relative_path", "code", severity.alias("severity"))


def resolve_file_refs(refs: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, issues, unreferenced) by exact workspace and relative path, never by file name.

    ``refs``: ref_id, workspace_id, relative_path (NULL when not local), path, explicit, mime,
    size; ``inventory``: workspace_id, relative_path, size_bytes, mime, readable. Issues are those of references and, with a
    NULL ref_id, those of the stored files. Each input runs once: entries, references and their join are written, and what is
    referenced is read from there. The join stays one-sided, because only so can a file that many rows refer to be split.
    """
    entries = durable(stored_entries(inventory))
    held = entries.select("workspace_id", "relative_path", F.col("size_bytes").alias("_size"),
                          F.col("mime").alias("_mime"), F.col("readable").alias("_readable"))
    looks_local = F.coalesce(F.col("path").rlike(RESOURCE_PATH) | F.col("path").rlike("^(?:file:|/)"), F.lit(False))
    bad = F.col("relative_path").isNull() & (looks_local | F.col("explicit"))
    availability = (F.when(bad, F.lit(None).cast("string")).when(F.col("relative_path").isNull(), "deferred")
                    .when(F.col("_readable"), "available").when(F.col("_readable").isNull(), "missing")
                    .otherwise("deferred"))
    # What could not be read has no known size or type to differ from.
    differs = F.coalesce(F.col("_readable") & (F.col("size") != F.col("_size")), F.lit(False)) | F.coalesce(
        F.col("_readable") & (F.col("mime") != F.col("_mime")), F.lit(False))
    code = (F.when(bad, "RESOURCE_REFERENCE_INVALID").when(F.col("availability") == "deferred", "RESOURCE_DEFERRED")
            .when(F.col("availability") == "missing", "RESOURCE_MISSING")
            .when(differs, "RESOURCE_METADATA_MISMATCH"))
    # References without a local path skip the join: they would all meet in one task.
    refs = durable(refs)
    local = refs.filter("relative_path IS NOT NULL").join(held, ["workspace_id", "relative_path"], "left")
    joined = local.unionByName(refs.filter("relative_path IS NULL"), allowMissingColumns=True)
    rows = durable(joined.withColumn("availability", availability).withColumn("code", code))
    severity = F.when(F.col("code").isin("RESOURCE_REFERENCE_INVALID", "RESOURCE_METADATA_MISMATCH"), "error") \
        .otherwise("warning")
    resolved = rows.filter("availability IS NOT NULL").select(*refs.columns, "availability")
    issues = rows.filter("code IS NOT NULL").select(
        "ref_id", "workspace_id", "relative_path", "code", severity.alias("severity")).unionByName(
        file_issues(entries).withColumn("ref_id", F.lit(None).cast(refs.schema["ref_id"].dataType)))
    referenced = rows.filter("_readable IS NOT NULL").select("workspace_id", "relative_path").distinct()
    unreferenced = entries.join(referenced, ["workspace_id", "relative_path"], "left_anti").select(
        "workspace_id", "relative_path", F.lit("RESOURCE_UNASSOCIATED").alias("code"))
    return resolved, issues, unreferenced


def history_references(entries: DataFrame, storage_root: str) -> DataFrame:
    """References of input-history entries: paths inside the query, attached files and media."""
    keyed = entries.select("workspace_id", "locator", "source_digest", "parsed_query", "files", "media")
    inside = resource_paths(keyed.select("workspace_id", "locator", "parsed_query").withColumnRenamed(
        "locator", "entry"), ["workspace_id", "entry"], "parsed_query").select(
        "workspace_id", "entry", F.concat(F.lit("parsedQuery"), F.when(
            F.col("locator").startswith("["), F.col("locator")).otherwise(F.concat(F.lit("."), "locator"))).alias("field"),
        F.col("value").alias("path"), F.lit(None).cast("string").alias("declared_type"),
        F.lit(None).cast("string").alias("mime"), F.lit(None).cast("bigint").alias("size"))
    files = keyed.select("workspace_id", F.col("locator").alias("entry"), F.posexplode("files").alias("i", "f")).select(
        "workspace_id", "entry", F.concat(F.lit("files["), "i", F.lit("].resourceUri")).alias("field"),
        F.col("f.uri").alias("path"), F.when(F.col("f.kind") == "image", "image").otherwise("attachment")
        .alias("declared_type"), F.col("f.type").alias("mime"), F.col("f.size_bytes").alias("size"))
    media = keyed.select("workspace_id", F.col("locator").alias("entry"), F.posexplode("media").alias("i", "m")).select(
        "workspace_id", "entry", F.concat(F.lit("multiMedia["), "i", F.lit("]")).alias("field"),
        F.lit(None).cast("string").alias("path"),
        F.when(F.col("m.resource_type") == "image", "image").otherwise("unknown").alias("declared_type"),
        F.lit(None).cast("string").alias("mime"), F.lit(None).cast("bigint").alias("size"))
    refs = inside.unionByName(files).unionByName(media)
    return refs.select(
        F.sha2(F.to_json(F.array("workspace_id", "entry", "field")), 256).alias("ref_id"), "workspace_id",
        local_resource_path(storage_root, F.col("workspace_id"), F.col("path")).alias("relative_path"),
        "path", F.lit(False).alias("explicit"), "declared_type", "mime", "size",
        F.concat("entry", F.lit("#"), "field").alias("locator"))
