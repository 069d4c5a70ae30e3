"""Workspaces and the project folders they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import variant as V
from palaver.functions.paths import file_uri_to_path, normalize_path, path_key

# Comments and strings are matched together, so that "//" inside a string stays.
_TOKENS = r'("(?:[^"\\]|\\.)*")|//[^\n\r]*|/\*[\s\S]*?\*/'
_TRAILING = r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])'


def relaxed_json(text: Column) -> Column:
    """VARIANT of JSON with comments and trailing commas."""
    plain = F.regexp_replace(text, _TOKENS, "$1")
    return F.try_parse_json(F.regexp_replace(plain, _TRAILING, "$1"))


def _dirname(path: Column, platform: str) -> Column:
    return F.regexp_extract(path, r"^(.*)\\[^\\]*$" if platform == "win32" else r"^(.*)/[^/]*$", 1)


def read_workspace_projects(metadata: DataFrame, configs: DataFrame, platform: str,
                            ) -> tuple[DataFrame, DataFrame]:
    """(projects, issues) of ``metadata(workspace_id, text)`` and ``configs(path, text)``.

    A folder workspace has one project. A workspace file lists folders, each with a path (relative
    to the file) or a URI; the first entry per path counts and a bad entry only costs itself.
    """
    m = F.col("m")
    folder, file = V.field(m, "$.folder"), V.field(m, "$.workspace")
    uri = F.nullif(V.text(F.coalesce(folder, file)), F.lit(""))
    read = metadata.withColumn("m", V.obj(relaxed_json(F.col("text")))).select(
        "workspace_id", F.col("text").isNull().alias("absent"),
        F.when(m.isNotNull() & (folder.isNotNull() != file.isNotNull()), uri).alias("uri"),
        F.when(folder.isNotNull(), "folder").otherwise("workspace").alias("kind"))
    located = read.withColumn("path", file_uri_to_path(F.col("uri"), platform))

    def issue(rows: DataFrame, code: str, severity: str = "error") -> DataFrame:
        index = F.col("entry_index") if "entry_index" in rows.columns else F.lit(None).cast("int")
        return rows.select("workspace_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                           index.alias("entry_index"))
    issues = (issue(located.filter("absent"), "WORKSPACE_METADATA_NOT_FOUND", "warning")
              .unionByName(issue(located.filter("NOT absent AND uri IS NULL"), "WORKSPACE_METADATA_INVALID"))
              .unionByName(issue(located.filter("uri IS NOT NULL AND path IS NULL"), "WORKSPACE_URI_UNSUPPORTED")))
    usable = located.filter("path IS NOT NULL")
    folders = usable.filter("kind = 'folder'").select(
        "workspace_id", F.lit(0).alias("entry_index"), "path", F.lit("folder-uri").alias("source"))
    files = usable.filter("kind = 'workspace'").join(
        configs.select("path", F.col("text").alias("config")), "path", "left")
    lists = V.array(V.field(V.obj(relaxed_json(F.col("config"))), "$.folders"))
    opened = files.withColumn("folders", lists)
    issues = (issues.unionByName(issue(opened.filter("config IS NULL"), "WORKSPACE_CONFIG_NOT_FOUND", "warning"))
              .unionByName(issue(opened.filter("config IS NOT NULL AND folders IS NULL"), "WORKSPACE_CONFIG_INVALID")))
    entries = opened.filter("folders IS NOT NULL").select(
        "workspace_id", F.col("path").alias("file"), F.posexplode("folders").alias("entry_index", "e"))
    e = F.col("e")
    has_path, has_uri = V.field(e, "$.path").isNotNull(), V.field(e, "$.uri").isNotNull()
    raw_path = F.nullif(V.text(V.field(e, "$.path")), F.lit(""))
    raw_uri = F.nullif(V.text(V.field(e, "$.uri")), F.lit(""))
    absolute = raw_path.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\)" if platform == "win32" else "^/")
    separator = "\\" if platform == "win32" else "/"
    joined = F.when(absolute, raw_path).otherwise(
        F.concat(_dirname(F.col("file"), platform), F.lit(separator), raw_path))
    well_formed = V.obj(e).isNotNull() & (has_path != has_uri) & F.coalesce(raw_path, raw_uri).isNotNull()
    resolved = entries.select(
        "workspace_id", "entry_index", well_formed.alias("ok"), has_uri.alias("by_uri"),
        F.when(well_formed & has_path, normalize_path(joined, platform))
        .when(well_formed, file_uri_to_path(raw_uri, platform)).alias("path"),
        F.when(has_path, "workspace-folder-path").otherwise("workspace-folder-uri").alias("source"))
    issues = (issues.unionByName(issue(resolved.filter("path IS NULL AND ok AND by_uri"), "WORKSPACE_URI_UNSUPPORTED"))
              .unionByName(issue(resolved.filter("path IS NULL AND NOT (ok AND by_uri)"), "WORKSPACE_CONFIG_INVALID")))
    first = resolved.filter("path IS NOT NULL").groupBy(
        "workspace_id", path_key(F.col("path"), platform).alias("_key")).agg(
        F.min_by(F.struct("entry_index", "path", "source"), "entry_index").alias("_p")).select(
        "workspace_id", "_p.*")
    return folders.unionByName(first), issues
