"""From raw exports to a checked bundle, as one graph of table operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.dedup import cross_role_conflicts, dedup_quarantine
from palaver.operators.evidence import demote_on_diagnostics, grade_sessions, session_evidence
from palaver.operators.integrity import check_integrity
from palaver.operators.merge import dedup_projects, merge_tool_observations, project_id
from palaver.operators.ordered import row_position, set_hash
from palaver.operators.parse import LOCATOR, parse_assistant_messages, parse_user_messages
from palaver.operators.refs import associate_resources, issues_to_events, join_reads, resolve_project
from palaver.operators.segments import order_blocks
from palaver.operators.mapping import PROFILE
from palaver.session import durable
from palaver.sources.messages import unwrap

REF = ("struct<workspace_id:string,session_id:string,locator:struct<type:string,value:string>,"
       "profile:struct<id:string,version:int>,sha256:string>")


@dataclass
class Inputs:
    """Everything an assembly reads. Optional tables may be left out."""

    records: DataFrame          # session_id, title, created_at, updated_at, parent_id, status
    sources: DataFrame          # session_id, workspace_id, kind, locator, digest
    responses: DataFrame        # session_id, status, expected, and response (JSON text) unless recs is given
    workspace_projects: DataFrame   # workspace_id, path, source
    recs: DataFrame | None = None   # session_id, entry_index, rec VARIANT: records instead of whole responses
    issues: list[DataFrame] = field(default_factory=list)   # session_id?, code, severity
    resources: DataFrame | None = None      # resource_id, type, availability, relative_path, ...
    resource_refs: DataFrame | None = None  # resource_id, session_id
    history_hashes: DataFrame | None = None  # digest
    platform: str = "linux"
    product_version: str = "0"
    collected_at: str = ""


def runtime_ref(session: Column, workspace: Column, locator: Column, sha: Column) -> Column:
    return F.struct(
        workspace.alias("workspace_id"), session.alias("session_id"),
        F.struct(F.lit("runtime-field").alias("type"), locator.alias("value")).alias("locator"),
        F.struct(F.lit(PROFILE[0]).alias("id"), F.lit(PROFILE[1]).alias("version")).alias("profile"),
        sha.alias("sha256"))


def _message_locator(message_id: Column, part: Column | None = None) -> Column:
    base = F.concat(F.lit(LOCATOR + "["), F.to_json(F.array(message_id)), F.lit("]"))
    base = F.regexp_replace(base, r"\[\[(.*)\]\]$", "[$1]")
    return base if part is None else F.concat(base, F.lit("."), part)


def make_diagnostics(rows: DataFrame) -> DataFrame:
    """Diagnostics with ids from their content. ``rows``: code, severity, subject_type, subject_id,
    message_id, locator, entry_index, refs (missing ones are filled with NULL)."""
    kinds = {"subject_type": "string", "subject_id": "string", "message_id": "string", "locator": "string",
             "entry_index": "int", "refs": f"array<{REF}>"}
    for name, kind in kinds.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("refs", F.coalesce("refs", F.array().cast(f"array<{REF}>")))
    content = F.struct("code", "severity", *kinds)
    return rows.select(
        F.concat(F.lit("sha256:"), F.sha2(F.to_json(content), 256)).alias("id"), "severity", "code",
        *kinds, F.array_distinct(F.filter(F.transform("refs", lambda r: r["session_id"]),
                                          lambda s: s.isNotNull())).alias("ref_sessions"))


def assemble(inputs: Inputs) -> dict[str, DataFrame]:
    """The bundle tables: source, projects, sessions, events, blocks, resources, diagnostics.

    A session with contradicting metadata or reads is left out whole and named by an error SESSION_CONTRADICTION; the others stay.
    """
    c = F.col
    spark = inputs.records.sparkSession
    digest_of = lambda df: df.withColumn("digest", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    joined, contradictions = join_reads(digest_of(inputs.records), digest_of(inputs.responses))
    if not contradictions.isEmpty():
        clashing = durable(contradictions.select("session_id").distinct())
        without = lambda df: df.join(clashing, "session_id", "left_anti")
        joined = without(joined)
        issues = clashing.select(F.lit("SESSION_CONTRADICTION").alias("code"), F.lit("error").alias("severity"), "session_id")
        inputs = replace(inputs, records=without(inputs.records), responses=without(inputs.responses), sources=without(inputs.sources),
                         recs=None if inputs.recs is None else without(inputs.recs), issues=[*inputs.issues, issues])
    ids = durable(joined.select("session_id", "meta", "has_metadata", "read_status", "expected"))
    places = inputs.sources.filter("workspace_id IS NOT NULL").select("session_id", "workspace_id").distinct()
    # References name the least workspace; all of them stay in session_workspaces.
    home = places.groupBy("session_id").agg(F.min("workspace_id").alias("workspace_id"))

    # Messages.
    if inputs.recs is None:
        available = inputs.responses.filter("status = 'available'").select("session_id", "response").distinct()
        recs, container_issues = unwrap(available, ["session_id"], "response")
        raw_hashes = available.select("session_id", F.concat(F.lit("sha256:"), F.sha2("response", 256)).alias("raw"))
    else:
        recs, container_issues = inputs.recs, None
        raw_hashes = set_hash(recs.select("session_id", F.sha2(F.concat_ws("|", "entry_index", F.to_json("rec")), 256)
                                          .alias("h")), ["session_id"], "h", "raw")
    recs = durable(recs)
    users, user_issues = parse_user_messages(recs)
    parsed = parse_assistant_messages(recs)
    key = ["session_id", "message_id"]
    kept_users, user_conflicts = dedup_quarantine(users, key, "digest", ["entry_index"])
    kept_assistants, assistant_conflicts = dedup_quarantine(parsed["messages"], key, "digest", ["entry_index"])
    both = kept_users.withColumn("role", F.lit("user")).unionByName(
        kept_assistants.withColumn("role", F.lit("assistant")), allowMissingColumns=True)
    clean, invalid = cross_role_conflicts(durable(both))
    placed = row_position(clean, ["session_id"], ["ord", "message_id"], "pos")
    placed = durable(placed.join(home, "session_id", "left"))

    # Blocks of the kept assistant records.
    owner = placed.filter("role = 'assistant'").select("session_id", "message_id", "entry_index", "workspace_id")
    of_kept = lambda df, column: df.withColumnRenamed(column, "entry_index").join(
        owner.select("session_id", "message_id", "entry_index"), ["session_id", "message_id", "entry_index"], "left_semi")
    texts = of_kept(parsed["texts"], "entry_index").drop("digest", "entry_index")
    reasoning = of_kept(parsed["reasoning"], "entry_index").drop("digest", "entry_index")
    observed = parsed["tool_obs"].withColumnRenamed("entry_index", "block_no").withColumnRenamed("rec_index", "entry_index") \
        .join(owner.select("session_id", "message_id", "entry_index"), ["session_id", "message_id", "entry_index"],
              "left_semi").drop("entry_index").withColumnRenamed("block_no", "entry_index")
    observed = durable(observed)
    calls, tool_conflicts = merge_tool_observations(observed)
    seen = observed.groupBy("session_id", "message_id", "call_id").agg(
        F.min_by(F.struct("locator", "digest"), "entry_index").alias("_s"))
    tools = calls.join(seen, ["session_id", "message_id", "call_id"]).select(
        "session_id", "message_id", c("entry_index").alias("block_index"), "call_id", "name", "input", "output",
        "error", "status", F.coalesce("started_at", "generated_at").alias("created_at"), "completed_at",
        F.concat("_s.locator", F.lit(".tool_call_info")).alias("locator"), c("_s.digest").alias("sha"))
    text_sha = F.concat(F.lit("sha256:"), F.sha2("text", 256))
    ordered = order_blocks(texts.withColumn("sha", text_sha), reasoning.withColumn("sha", text_sha), tools)
    blocks = ordered.join(owner.drop("entry_index"), key).select(
        "session_id", c("message_id").alias("event_id"), "pos", "type", "text", "call_id", "name", "input", "output",
        "error", "status", "created_at", "completed_at", F.array(runtime_ref(
            c("session_id"), c("workspace_id"), _message_locator(c("message_id"), c("locator")), c("sha"))).alias("refs"))
    blocks = durable(blocks)

    own = runtime_ref(c("session_id"), c("workspace_id"), _message_locator(c("message_id")), c("digest"))
    of_text = runtime_ref(c("session_id"), c("workspace_id"), _message_locator(c("message_id"), c("text_locator")),
                          c("text_digest"))
    events = durable(placed.select(
        "session_id", "pos", c("message_id").alias("event_id"), c("role").alias("type"), "ord", "created_at",
        "completed_at", "turn_id", "reply_to", F.when(c("role") == "assistant", c("status")).alias("status"), "text",
        F.when(c("role") == "user", F.array(own, of_text)).otherwise(F.array(own)).alias("refs")))

    # Provenance of a session: its metadata sources, else its first events, else the raw response.
    runtime_kind = c("kind") == "runtime-metadata"
    meta_ref = F.struct(
        c("workspace_id"), c("session_id"), F.struct(
            F.when(runtime_kind, "runtime-field").when(c("kind") == "snapshot-directory", "relative-path")
            .otherwise("database-key").alias("type"), c("locator").alias("value")).alias("locator"),
        F.struct(F.when(runtime_kind, PROFILE[0]).otherwise("workspace-v3").alias("id"), F.lit(1).alias("version"))
        .alias("profile"), c("digest").alias("sha256"))
    # One reference per source kind is enough to prove a session; all sources stay a table.
    meta_refs = inputs.sources.groupBy("session_id", "kind").agg(F.min(meta_ref).alias("r")).groupBy("session_id").agg(
        F.array_sort(F.collect_list("r")).alias("meta_refs"))
    event_refs = events.groupBy("session_id").agg(F.min_by("refs", "pos").alias("event_refs"))
    raw_refs = durable(raw_hashes.join(home, "session_id", "left").select("session_id", F.array(runtime_ref(
        c("session_id"), c("workspace_id"), F.lit("runtime:getMessages#response"), c("raw"))).alias("raw_refs")))
    proof = (ids.join(meta_refs, "session_id", "left").join(event_refs, "session_id", "left")
             .join(raw_refs, "session_id", "left"))
    none = F.array().cast(f"array<{REF}>")
    both_refs = F.array_distinct(F.concat(F.coalesce("meta_refs", none), F.coalesce("event_refs", none)))
    proof = durable(proof.withColumn("refs", F.when(F.size(both_refs) > 0, both_refs).otherwise(
        F.coalesce("raw_refs", none))))

    # Issues of parsing.
    parse_issues = user_issues
    for extra in (parsed["issues"],
                  user_conflicts.select(*key, F.lit("USER_DUPLICATE_CONFLICT").alias("code"), "severity"),
                  assistant_conflicts.select(*key, F.lit("ASSISTANT_DUPLICATE_CONFLICT").alias("code"), "severity"),
                  tool_conflicts.filter("code = 'TOOL_CONFLICT'").select(*key, "code", "severity"),
                  *([container_issues] if container_issues is not None else [])):
        parse_issues = parse_issues.unionByName(extra, allowMissingColumns=True)
    located = issues_to_events(parse_issues, events, raw_refs).withColumn("subject_type", F.lit("session")).withColumn(
        "subject_id", c("session_id"))
    clashes = invalid.join(home, "session_id", "left").select(
        "code", F.lit("error").alias("severity"), F.lit("session").alias("subject_type"),
        c("session_id").alias("subject_id"), "message_id", F.array(runtime_ref(
            c("claimed_session_id"), F.when(c("code") != "MESSAGE_SESSION_MISMATCH", c("workspace_id")),
            _message_locator(c("message_id")), c("digest"))).alias("refs"))
    found = [make_diagnostics(located), make_diagnostics(clashes)]
    for table in inputs.issues:
        subject = c("session_id") if "session_id" in table.columns else F.lit(None).cast("string")
        # Without a session an issue concerns the bundle; resource issues then only warn.
        found.append(make_diagnostics(table.select(
            "code", "severity", F.when(subject.isNotNull(), "session").otherwise("bundle").alias("subject_type"),
            subject.alias("subject_id"))))

    # Projects and resources.
    projects = dedup_projects(inputs.workspace_projects, inputs.platform)
    project_refs = inputs.workspace_projects.groupBy(project_id(c("path"), inputs.platform).alias("project_id")).agg(
        F.min(F.struct("workspace_id", F.lit(None).cast("string").alias("session_id"), F.struct(
            F.lit("workspace-state").alias("type"), F.concat(
                F.lit("workspace.json#resolved-project:"), project_id(c("path"), inputs.platform)).alias("value")).alias("locator"),
            F.struct(F.lit("workspace-v3").alias("id"), F.lit(1).alias("version")).alias("profile"),
            F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct("path", "source")), 256)).alias("sha256"))).alias("_r"))
    projects = durable(projects.join(project_refs, "project_id").select(
        "project_id", F.lit(None).cast("string").alias("name"), "path", F.array("_r").alias("refs")))
    chosen = resolve_project(places, inputs.workspace_projects.select(
        "workspace_id", project_id(c("path"), inputs.platform).alias("project_id"))).filter("project_id IS NOT NULL")
    if inputs.resources is not None:
        linked, unassociated = associate_resources(inputs.resources, inputs.resource_refs, ids)
        resources = durable(linked.withColumn("refs", none))
        found.append(make_diagnostics(unassociated.select(
            "code", "severity", F.lit("resource").alias("subject_type"), c("resource_id").alias("subject_id"))))
    else:
        resources = spark.createDataFrame([], "session_id string, resource_id string, type string, availability string, "
                                          "relative_path string, mime_type string, sha256 string, size_bytes bigint, "
                                          f"refs array<{REF}>")

    # Sessions, graded.
    backed = proof.filter(F.size("refs") > 0)
    unbacked = proof.filter(F.size("refs") == 0).select(
        F.lit("SESSION_WITHOUT_EVIDENCE").alias("code"), F.lit("warning").alias("severity"),
        F.lit("session").alias("subject_type"), c("session_id").alias("subject_id"))
    bad = invalid.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_invalid"))
    evidence = session_evidence(events, blocks, bad, resources, ids.select("session_id", "expected"))
    graded = grade_sessions(backed.select(
        "session_id", "read_status", "has_metadata", c("meta.status").alias("_status"), "refs", "meta").join(
        evidence, "session_id").select(
        *[x for x in evidence.columns], "refs", "meta", c("read_status").alias("message_source"),
        F.lit("verified").alias("profile_verification"), F.lit(False).alias("source_corrupt"),
        (c("has_metadata") & F.coalesce(c("_status") != "invalid", F.lit(True))).alias("metadata_available")))
    graded = durable(graded.join(chosen, "session_id", "left").join(
        projects.select("project_id", c("path").alias("project_path")), "project_id", "left"))
    warn = lambda rows, code: rows.select(
        F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.lit("session").alias("subject_type"),
        c("session_id").alias("subject_id"), "refs")
    tool = c("type") == "tool"
    open_tools = blocks.filter(tool & (~c("status").isin("completed", "error") | (
        (c("status") == "completed") & c("output").isNull()))).select("session_id", "event_id").distinct() \
        .withColumn("_open", F.lit(True))
    incomplete = events.filter("type = 'assistant'").join(open_tools, ["session_id", "event_id"], "left").filter(
        (c("status") != "completed") | F.coalesce("_open", F.lit(False)))
    found += [
        make_diagnostics(unbacked), make_diagnostics(warn(incomplete, "CONTENT_INCOMPLETE")),
        make_diagnostics(warn(graded.filter("project_id IS NULL"), "PROJECT_UNRESOLVED")),
        make_diagnostics(warn(graded.filter("meta IS NULL OR meta.status <> 'complete'"), "METADATA_INCOMPLETE")),
        make_diagnostics(graded.select(
            F.explode("reasons").alias("code"), F.lit("warning").alias("severity"), F.lit("session").alias("subject_type"),
            c("session_id").alias("subject_id"), "refs"))]
    sessions = graded.select(
        "session_id", c("meta.title").alias("title"), "project_id", "project_path", c("meta.parent_id").alias("parent_id"),
        c("meta.created_at").alias("created_at"), c("meta.updated_at").alias("updated_at"), "recovery", "refs")
    tables = {"projects": projects, "sessions": sessions, "events": events, "blocks": blocks, "resources": resources}
    checks = check_integrity(tables)
    found.append(checks.withColumn("ref_sessions", F.array_distinct(F.filter(F.transform(
        "refs", lambda r: r["session_id"]), lambda s: s.isNotNull()))))
    diagnostics = found[0]
    for part in found[1:]:
        diagnostics = diagnostics.unionByName(part, allowMissingColumns=True)
    diagnostics = durable(diagnostics.dropDuplicates(["id"]))
    tables["sessions"] = durable(demote_on_diagnostics(sessions, diagnostics))
    tables["diagnostics"] = diagnostics
    tables["session_workspaces"] = places
    states = ids.select("session_id", "read_status", "expected")
    tables["source"] = fingerprint(tables, states, inputs.history_hashes).select(
        F.lit(1).alias("schema_version"), F.lit(inputs.product_version).alias("product_version"),
        F.lit(inputs.platform).alias("platform"), F.lit("verified").alias("verification"),
        F.lit(inputs.collected_at).alias("collected_at"), "fingerprint")
    return tables


def fingerprint(tables: dict[str, DataFrame], read_states: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One hash of ids, references, resources, cache hashes, read states and rejected evidence.

    Row hashes go through a hash tree, so nothing is collected; the time of collection plays no part.
    """
    def rows(kind: str, df: DataFrame, *columns: str) -> DataFrame:
        return df.select(F.sha2(F.to_json(F.struct(F.lit(kind).alias("kind"), *columns)), 256).alias("h"))
    parts = rows("session", tables["sessions"], "session_id", "refs")
    parts = parts.unionByName(rows("project", tables["projects"], "project_id", "refs"))
    parts = parts.unionByName(rows("resource", tables["resources"], *sorted(tables["resources"].columns)))
    parts = parts.unionByName(rows("read", read_states, *read_states.columns))
    parts = parts.unionByName(rows("evidence", tables["diagnostics"].select(F.explode("refs").alias("ref")), "ref"))
    if history is not None:
        parts = parts.unionByName(rows("history", history, "digest"))
    return set_hash(parts, [], "h", "fingerprint")
