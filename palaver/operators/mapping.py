"""Bundle sessions to the second target layout (messages with content blocks).

A session stays a set of rows: one header, one row per message, one row per block, each with its
JSON body. Nothing is nested, so a session of any length is spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import variant as V
from palaver.functions.identity import digest, stable_message_id, stable_session_id
from palaver.functions.values import verified_refs_only
from palaver.operators.ordered import previous_value, running_sum, same_keys, set_hash
from palaver.operators.refs import diagnostics_by_session, with_reply_state
from palaver.operators.segments import (
    CONTEXT_BYTES, RECENT_BYTES, labelled_texts, recent_tail, segment_history, tail_bytes,
    text_context_bytes, tool_context_bytes,
)
from palaver.session import durable

# Placeholders, markers and codes of the mapping.
MISSING_OUTPUT = "[tool completed without persisted output]"
MISSING_ERROR = "[tool failed without a persisted error message]"
MISSING_TEXT = "[assistant response ended before final text was persisted]"
MAPPING_VERSION = 8
UNKNOWN_AGENT = "import-unknown"
PROJECT_ID = "import-unassigned"
PROFILE = ("runtime-v1", 1)
PROJECTABLE = ("REPLY_REFERENCE_INVALID", "TOOL_CALL_INVALID", "TOOL_ERROR_UNVERIFIED", "USER_TEXT_MISSING")


@dataclass
class Mapped:
    """Result tables of a mapping; ``rejects`` names the sessions that cannot be mapped."""

    sessions: DataFrame
    messages: DataFrame
    blocks: DataFrame
    diagnostics: DataFrame
    rejects: DataFrame
    # Tool blocks without a start time: kept beside the transcript, not shown in it.
    deferred: DataFrame


def _has_error(error: Column) -> Column:
    return F.coalesce(~error.isin("null", '""', "{}", "[]"), F.lit(False))


def _value(json_text: Column) -> Column:
    return F.try_parse_json(json_text)


def _as_text(json_text: Column) -> Column:
    """A JSON string as its text, anything else as canonical JSON."""
    return F.coalesce(V.text(_value(json_text)), json_text)


def _encoding(json_text: Column) -> Column:
    return F.when(V.is_text(_value(json_text)), "text").otherwise("canonical-json")


def project_shell_tool(name: Column, input_json: Column, output_json: Column) -> Column:
    """struct(name, input, output, details): an ``exec_command`` call shown as a shell command.

    ``cmd`` becomes ``command``; stdout (or output) becomes the visible output, its mirrors are
    dropped, and the rest with a hash of the whole stays in ``details``. Other tools pass through.
    """
    members = F.try_variant_get(_value(input_json), "$", "map<string,variant>")
    command = V.field(_value(input_json), "$.cmd")
    is_shell = (name == "exec_command") & V.is_text(command)
    kept = F.map_filter(members, lambda k, _: ~k.isin("cmd", "command"))
    new_input = F.to_json(F.parse_json(F.to_json(F.map_concat(kept, F.create_map(F.lit("command"), command)))))
    result = _value(output_json)
    stdout, plain = V.field(result, "$.stdout"), V.field(result, "$.output")
    visible = F.when(V.is_text(stdout), "stdout").when(V.is_text(plain), "output")
    shown = F.when(V.is_text(stdout), F.to_json(stdout)).when(V.is_text(plain), F.to_json(plain))
    fields = F.try_variant_get(result, "$", "map<string,variant>")
    mirrored = F.filter(F.array(F.lit("stdout"), F.lit("output")), lambda f: F.coalesce(
        F.to_json(F.try_element_at(fields, f)) == shown, F.lit(False)))
    rest = F.to_json(F.map_filter(fields, lambda k, _: ~F.array_contains(mirrored, k)))
    lifted = F.coalesce(V.obj(result).isNotNull() & visible.isNotNull(), F.lit(False))
    details = F.struct(
        name.alias("sourceToolName"), F.lit("cmd").alias("sourceCommandField"),
        V.field(_value(input_json), "$.command").alias("sourceInputCommand"),
        F.when(lifted, visible).alias("visibleOutputField"), F.when(lifted, mirrored).alias("mirroredOutputFields"),
        F.when(lifted, F.try_parse_json(rest)).alias("sourceOutputRemainder"),
        F.when(lifted, digest(output_json)).alias("sourceOutputSha256"))
    shell = F.struct(F.lit("shell").alias("name"), new_input.alias("input"),
                     F.when(lifted, shown).otherwise(output_json).alias("output"),
                     F.to_json(details).alias("details"))
    same = F.struct(name.alias("name"), input_json.alias("input"), output_json.alias("output"),
                    F.lit("{}").alias("details"))
    return F.when(is_shell, shell).otherwise(same)


def _merge(*objects: Column) -> Column:
    """One JSON object of several JSON object texts (no shared keys)."""
    inner = F.filter(F.array(*[F.substring(o, F.lit(2), F.length(o) - 2) for o in objects]),
                     lambda x: x.isNotNull() & (x != ""))
    return F.to_json(F.parse_json(F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))))


_DIAGNOSTIC = "array<struct<code:string,field:string>>"


def map_blocks_v2(blocks: DataFrame) -> DataFrame:
    """``body`` (JSON), ``out_type``, ``deferred``, ``reject`` and ``notes`` of every block.

    ``blocks`` carries recovery of its session, event_pos and ``verified`` besides the block
    columns. A tool without a start time is deferred in a partial session and rejected otherwise.
    """
    c = F.col
    place = F.concat(F.lit("events["), c("event_pos"), F.lit("].content["), c("pos"), F.lit("]"))
    time = F.when(c("created_at").isNotNull(), F.struct(
        c("created_at").alias("created"), c("completed_at").alias("completed")))
    progress = F.exists("refs", lambda r: (r["locator"]["type"] == "runtime-field")
                        & F.endswith(r["locator"]["value"], F.lit(".plan_item.thought")))
    is_tool = c("type") == "tool"
    as_reasoning = (c("type") == "reasoning") | ((c("type") == "text") & progress)
    has_error = _has_error(c("error"))
    rows = blocks.withColumn("_p", project_shell_tool(c("name"), c("input"), c("output")))
    p = c("_p")
    input_ok = V.obj(_value(c("input"))).isNotNull()
    streaming = c("status") == "streaming"
    live = c("status").isin("running", "unknown")
    failed, done = c("status") == "error", c("status") == "completed"
    reject = (F.when(~c("verified"), "sourceRefs")
              .when(is_tool & c("created_at").isNull() & (c("recovery") != "partial"), "createdAt")
              .when(is_tool & c("created_at").isNull(), F.lit(None).cast("string"))
              .when(is_tool & streaming & (~V.is_text(_value(c("input"))) | c("output").isNotNull()), "input/output")
              .when(is_tool & ~streaming & ~input_ok, "input")
              .when(is_tool & done & has_error, "error"))
    deferred = is_tool & c("created_at").isNull()
    kept_payload = c("output").isNotNull() | has_error
    shell_visible = (p["name"] == "shell") & V.field(_value(p["details"]), "$.visibleOutputField").isNotNull()
    live_details = F.when((c("status") == "unknown") | kept_payload, _merge(p["details"], F.to_json(F.struct(
        c("status").alias("sourceStatus"),
        F.when(~F.coalesce(shell_visible, F.lit(False)), _value(c("output"))).alias("sourceOutput"),
        F.when(has_error, _value(c("error"))).alias("sourceError"))))).when(p["details"] != "{}", p["details"])
    live_output = F.when((p["name"] == "shell") & V.is_text(_value(p["output"])), V.text(_value(p["output"])))
    live_state = F.to_json(F.struct(
        F.lit("running").alias("status"), _value(p["input"]).alias("input"),
        F.struct(_value(live_details).alias("provenance"), live_output.alias("output")).alias("metadata")))
    error_json = F.when(has_error, c("error")).otherwise(F.lit(f'"{MISSING_ERROR}"'))
    output_json = F.coalesce(p["output"], F.lit(f'"{MISSING_OUTPUT}"'))
    shown = lambda j: F.array(F.struct(F.lit("text").alias("type"), _as_text(j).alias("text")))
    error_state = F.to_json(F.struct(
        F.lit("error").alias("status"), _value(p["input"]).alias("input"),
        F.struct(F.lit("TOOL_ERROR").alias("type"), _as_text(error_json).alias("message")).alias("error"),
        F.when(p["output"].isNotNull(), shown(p["output"])).alias("content"),
        F.struct(_value(_merge(p["details"], F.to_json(F.struct(
            _encoding(error_json).alias("errorEncoding"), digest(error_json).alias("errorSha256"),
            F.when(~has_error, F.lit(True)).alias("sourceErrorMissing"),
            F.when(p["output"].isNotNull(), _encoding(p["output"])).alias("outputEncoding"),
            F.when(p["output"].isNotNull(), digest(p["output"])).alias("outputSha256"))))).alias("provenance"))
        .alias("metadata")))
    done_state = F.to_json(F.struct(
        F.lit("completed").alias("status"), _value(p["input"]).alias("input"), shown(output_json).alias("content"),
        F.struct(_value(_merge(p["details"], F.to_json(F.struct(
            _encoding(output_json).alias("outputEncoding"), digest(output_json).alias("outputSha256"),
            F.when(p["output"].isNull(), F.lit(True)).alias("sourceOutputMissing"))))).alias("provenance"))
        .alias("metadata")))
    streaming_state = F.to_json(F.struct(F.lit("streaming").alias("status"), V.text(_value(c("input"))).alias("input")))
    state = (F.when(streaming, streaming_state).when(live, live_state).when(failed, error_state)
             .otherwise(done_state))
    tool = F.to_json(F.struct(
        F.lit("tool").alias("type"), c("call_id").alias("id"),
        F.when(streaming, c("name")).otherwise(p["name"]).alias("name"), time.alias("time"),
        _value(state).alias("state")))
    plain = F.when(as_reasoning, F.to_json(F.struct(
        F.lit("reasoning").alias("type"), c("text").alias("text"), time.alias("time")))).otherwise(
        F.to_json(F.struct(F.lit("text").alias("type"), c("text").alias("text"))))
    ok = reject.isNull()

    def note(condition: Column, code: str, field: str) -> Column:
        return F.when(ok & condition, F.struct(F.lit(code).alias("code"),
                                               F.concat(place, F.lit(f".{field}")).alias("field")))
    started = is_tool & c("created_at").isNotNull()
    notes = F.filter(F.array(
        note(deferred, "TOOL_TIMING_MISSING", "createdAt"),
        note(started & (c("status") == "unknown"), "TOOL_STATUS_PROJECTED", "status"),
        note(started & (c("status") == "running") & kept_payload, "RUNNING_TOOL_PAYLOAD_PRESERVED", "output/error"),
        note(started & failed, "TOOL_ERROR_PRESERVED", "status"),
        note(started & done & p["output"].isNull(), "TOOL_OUTPUT_MISSING", "output"),
        note(started & done & c("completed_at").isNull(), "TOOL_COMPLETION_TIME_MISSING", "completedAt")),
        lambda n: n.isNotNull())
    context = F.when(deferred, F.lit(0).cast("bigint")).when(is_tool, tool_context_bytes(
        F.when(streaming, c("input")).otherwise(p["input"]),
        F.when(failed & p["output"].isNotNull(), _as_text(p["output"])).when(done, _as_text(output_json)),
        F.when(failed, _as_text(error_json)))).otherwise(text_context_bytes(c("text")))
    body = F.when(~deferred & ok, F.when(is_tool, F.to_json(F.parse_json(tool))).otherwise(
        F.to_json(F.parse_json(plain))))
    return rows.select(
        "session_id", "event_id", "event_pos", "pos",
        F.when(as_reasoning, "reasoning").otherwise(c("type")).alias("out_type"), body.alias("body"),
        deferred.alias("deferred"), F.when(reject.isNotNull(), F.concat(place, F.lit("."), reject)).alias("reject"),
        notes.alias("notes"), context.alias("context_bytes"), "text", "created_at", "completed_at")


def _concerning(tables: dict[str, DataFrame]) -> tuple[DataFrame, dict]:
    """Per session: error blockers, codes and projected codes; and the same for bundle-level rows.

    Codes come from a fixed list, so the sets are small.
    """
    diagnostics = tables["diagnostics"]
    sessions = tables["sessions"]
    blocking = (F.col("severity") == "error") | (F.col("code") == "TOOL_ERROR_UNVERIFIED")
    known, general = diagnostics_by_session(diagnostics, sessions, tables["events"], tables["resources"], blocking, F.col("code").isin(*PROJECTABLE))
    known = known.join(sessions.select("session_id", "recovery"), "session_id")
    excused = F.col("recovery") == "partial"
    per_session = known.select(
        "session_id", (F.col("blocked") | (F.col("own_blocked") & F.coalesce(~excused, F.lit(True)))).alias("_blocked"), F.col("codes").alias("_codes"),
        F.when(excused, F.col("own_codes")).otherwise(F.array().cast("array<string>")).alias("_projected"))
    row = general.agg(F.collect_set("code").alias("codes"), F.coalesce(F.bool_or(
        (F.col("severity") == "error") | (F.col("code") == "TOOL_ERROR_UNVERIFIED")), F.lit(False)).alias("blocked")).first()
    return per_session, {"codes": sorted(row["codes"]), "blocked": bool(row["blocked"])}


def session_hash(tables: dict[str, DataFrame]) -> DataFrame:
    """(session_id, source_hash) over every row of a session; rows carry their positions."""
    rows = None
    for name in ("sessions", "events", "blocks", "resources"):
        part = tables[name].select("session_id", F.sha2(F.to_json(F.struct(
            F.lit(name).alias("_table"), *sorted(tables[name].columns))), 256).alias("h"))
        rows = part if rows is None else rows.unionByName(part)
    return set_hash(rows, ["session_id"], "h", "source_hash")


def map_sessions_v2(tables: dict[str, DataFrame], namespace: str, directory: str = "/",
                    verification: str = "verified", profile: tuple[str, int] = PROFILE,
                    cap: int = CONTEXT_BYTES, recent: int = RECENT_BYTES) -> Mapped:
    """Map all sessions; one that cannot be mapped without loss lands in ``rejects`` and nowhere else."""
    c = F.col
    events, sessions, blocks = tables["events"], tables["sessions"], tables["blocks"]
    issues, general = _concerning(tables)
    verified = lambda: verified_refs_only(c("refs"), c("session_id"), *profile)
    head = sessions.select("session_id", "title", "parent_id", "created_at", "updated_at", "recovery")
    # Events with ids, reply state and their session's grade.
    grade = sessions.select("session_id", "recovery")
    rows = (with_reply_state(events).join(grade, "session_id")
            .withColumn("target_id", stable_session_id(c("session_id"), namespace))
            .withColumn("id", stable_message_id(c("session_id"), c("event_id"), c("ord"), namespace)))
    rows = previous_value(rows, ["session_id"], "pos", "id", "_previous")
    user = c("type") == "user"
    projects_unknown = (c("recovery") == "partial") & (c("status") == "unknown")
    final = c("status").isin("completed", "error") | projects_unknown
    problem = (F.when(~verified(), "sourceRefs").when(c("created_at").isNull(), "createdAt")
               .when(~user & (~F.coalesce(final, F.lit(False)) | c("completed_at").isNull()), "completedAt/status"))
    rows = durable(rows.withColumn("reject", F.when(
        c("id").isNull() | F.coalesce(c("id") <= c("_previous"), F.lit(False)), "idMapping").when(
        problem.isNotNull(), F.concat(F.lit("events["), c("pos"), F.lit("]."), problem))))
    # Blocks.
    where = rows.select("session_id", "event_id", c("pos").alias("event_pos"), "recovery")
    mapped_blocks = durable(map_blocks_v2(blocks.withColumn("verified", verified()).join(
        where, ["session_id", "event_id"])))
    # Session gates.
    counts = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    gate = head.join(counts, "session_id", "left").join(issues.select("session_id", "_blocked"), "session_id", "left")
    gates = gate.select("session_id", F.when(F.lit(verification != "verified"), "source.profile.verification")
                        .when(F.coalesce("_blocked", F.lit(False)) | F.lit(general["blocked"]), "diagnostics")
                        .when(c("_n").isNull() | ~c("recovery").isin("complete", "partial"), "recovery")
                        .when(c("created_at").isNull() | c("updated_at").isNull(), "time")
                        .when(c("parent_id") == c("session_id"), "parentSourceId")
                        .when(F.lit(not directory or "\0" in directory), "directory").alias("field"))
    rejects = (gates.filter("field IS NOT NULL").withColumn("rank", F.lit(0))
               .unionByName(rows.filter("reject IS NOT NULL").select(
                   "session_id", c("reject").alias("field"), F.lit(1).alias("rank")))
               .unionByName(mapped_blocks.filter("reject IS NOT NULL").select(
                   "session_id", c("reject").alias("field"), F.lit(2).alias("rank"))))
    rejects = durable(rejects.groupBy("session_id").agg(
        F.min_by("field", F.struct("rank", "field")).alias("field")).withColumn("code", F.lit("MAPPING_REJECTED")))
    rows = rows.join(rejects, "session_id", "left_anti")
    mapped_blocks = mapped_blocks.join(rejects, "session_id", "left_anti")
    # Placeholder text where the source reported that final text is missing.
    told = tables["diagnostics"].filter("code = 'ASSISTANT_TEXT_MISSING' AND message_id IS NOT NULL").select(
        c("subject_id").alias("session_id"), c("message_id").alias("event_id")).distinct()
    has_text = mapped_blocks.filter("out_type = 'text' AND body IS NOT NULL").select("session_id", "event_id").distinct()
    blank = (rows.filter((c("type") == "assistant") & (c("recovery") == "partial"))
             .join(told, ["session_id", "event_id"], "left_semi")
             .join(has_text, ["session_id", "event_id"], "left_anti"))
    size = blocks.groupBy("session_id", "event_id").agg(F.max("pos").alias("_last"))
    placeholder = blank.join(size, ["session_id", "event_id"], "left").select(
        "session_id", "event_id", c("pos").alias("event_pos"), (F.coalesce("_last", F.lit(-1)) + 1).alias("pos"),
        F.lit("text").alias("out_type"), F.to_json(F.struct(
            F.lit(MISSING_TEXT).alias("text"), F.lit("text").alias("type"))).alias("body"),
        F.lit(False).alias("deferred"), text_context_bytes(F.lit(MISSING_TEXT)).alias("context_bytes"),
        F.lit(MISSING_TEXT).alias("text"))
    shown = mapped_blocks.select(*placeholder.columns).unionByName(placeholder)
    numbered = running_sum(shown.withColumn("_one", F.when(c("body").isNotNull(), 1).otherwise(0)),
                           ["session_id", "event_id"], "pos", "_one", "_k")
    numbered = durable(numbered.withColumn("content_pos", F.when(c("body").isNotNull(), c("_k") - 1)))
    ids = rows.select("session_id", "event_id", "target_id", "id")
    deferred = numbered.filter("deferred").select("session_id", "event_id", "event_pos", "pos").join(
        blocks.select("session_id", "event_id", "pos", "call_id", "name", "input", "output", "error", "status",
                      "completed_at"), ["session_id", "event_id", "pos"])
    out_blocks = numbered.filter("body IS NOT NULL").join(ids, ["session_id", "event_id"]).select(
        "session_id", "target_id", "event_pos", "event_id", c("id").alias("message_id"), "content_pos",
        c("out_type").alias("type"), "body")
    # Messages.
    assistant_meta = F.struct(
        c("event_id").alias("sourceId"), c("ord").alias("order"), c("turn_id").alias("turnSourceId"),
        F.when(c("reply_ok"), c("reply_to")).alias("replyToSourceId"),
        F.when(~c("reply_ok"), F.when(c("reply_to").isNotNull(), "unresolved").otherwise("missing"))
        .alias("replyReferenceStatus"),
        F.when(~c("reply_ok"), c("reply_to")).alias("unresolvedReplyToSourceId"), c("status").alias("status"),
        F.array(F.lit("agent"), F.lit("model")).alias("unknownSourceFields"))
    user_meta = F.struct(c("event_id").alias("sourceId"), c("ord").alias("order"), c("turn_id").alias("turnSourceId"))
    user_body = F.to_json(F.struct(
        c("id"), F.struct(user_meta.alias("provenance")).alias("metadata"), c("text").alias("text"),
        F.struct(c("created_at").alias("created")).alias("time"), F.lit("user").alias("type")))
    assistant_body = F.to_json(F.struct(
        F.lit(UNKNOWN_AGENT).alias("agent"),
        F.when(c("status") == "error", "error").when(projects_unknown, "unknown").alias("finish"), c("id"),
        F.struct(assistant_meta.alias("provenance")).alias("metadata"),
        F.struct(F.lit("unknown").alias("id"), F.lit(UNKNOWN_AGENT).alias("providerID")).alias("model"),
        F.struct(c("created_at").alias("created"), c("completed_at").alias("completed")).alias("time"),
        F.lit("assistant").alias("type")))
    messages = rows.select("session_id", "target_id", "pos", F.lit(0).alias("sub"), "event_id", "id", "type",
                           "created_at", "completed_at", "reply_to", "reply_ok", "ord",
                           F.when(user, user_body).otherwise(assistant_body).alias("body"))
    # Boundaries.
    block_bytes = numbered.groupBy("session_id", c("event_pos").alias("pos")).agg(
        F.sum("context_bytes").alias("_bytes"))
    sized = rows.join(block_bytes, ["session_id", "pos"], "left").select(
        "session_id", "pos", "type", F.when(user, text_context_bytes(c("text"))).otherwise(
            F.coalesce("_bytes", F.lit(0))).cast("bigint").alias("bytes"))
    texts = rows.filter(user).select("session_id", "pos", F.lit(0).cast("bigint").alias("block_pos"), "type",
                                     F.coalesce("text", F.lit("")).alias("text")).unionByName(
        numbered.filter("out_type = 'text' AND body IS NOT NULL").select(
            "session_id", c("event_pos").alias("pos"), c("content_pos").alias("block_pos"),
            F.lit("assistant").alias("type"), "text"))
    boundaries = continuation_boundaries(sized, texts, cap, recent)
    stamp = F.coalesce("completed_at", "created_at")
    compaction = boundaries.join(rows.select("session_id", "pos", "target_id", "event_id", "id", "created_at",
                                             "completed_at"), ["session_id", "pos"]).select(
        "session_id", "target_id", "pos", F.lit(1).alias("sub"), "event_id",
        F.concat("id", F.lit("_compact")).alias("id"), F.lit("compaction").alias("type"), "created_at",
        "completed_at", F.lit(None).cast("string").alias("reply_to"), F.lit(None).cast("boolean").alias("reply_ok"),
        F.lit(None).cast("bigint").alias("ord"), F.to_json(F.struct(
            F.concat("id", F.lit("_compact")).alias("id"), F.struct(F.struct(
                c("active_bytes").alias("activeContextBytes"), F.lit("continuation-boundary").alias("kind"),
                F.lit(MAPPING_VERSION).alias("mappingVersion")).alias("provenance")).alias("metadata"),
            F.lit("manual").alias("reason"), c("recent").alias("recent"), F.lit("completed").alias("status"),
            F.lit("").alias("summary"), F.struct(stamp.alias("created")).alias("time"),
            F.lit("compaction").alias("type"))).alias("body"))
    messages = messages.unionByName(compaction)
    # Headers.
    resources = tables["resources"].groupBy("session_id").agg(F.count(F.lit(1)).alias("_resources"))
    extra = F.array(*[F.lit(x) for x in general["codes"]]).cast("array<string>")
    no_codes = F.array().cast("array<string>")
    headers = (head.join(rejects, "session_id", "left_anti").join(issues, "session_id", "left")
               .join(resources, "session_id", "left").join(session_hash(tables), "session_id"))
    codes = F.array_sort(F.array_distinct(F.concat(F.coalesce("_codes", no_codes), extra)))
    projected = F.array_sort(F.coalesce("_projected", no_codes))
    headers = headers.withColumn("codes", codes).withColumn("projected", projected).withColumn(
        "resource_count", F.coalesce("_resources", F.lit(0)).cast("bigint"))
    info = F.to_json(F.struct(
        F.lit(0).alias("cost"), stable_session_id(c("session_id"), namespace).alias("id"),
        F.struct(F.lit(directory).alias("directory")).alias("location"),
        F.struct(F.struct(
            F.lit(MAPPING_VERSION).alias("mappingVersion"),
            F.when(F.size("projected") > 0, c("projected")).alias("projectedSourceCodes"),
            c("resource_count").alias("resourceCount"), c("codes").alias("sourceDiagnosticCodes"),
            c("recovery").alias("sourceRecovery"), c("session_id").alias("sourceSessionId"),
            c("source_hash").alias("sourceSessionSha256"),
            F.array(*[F.lit(x) for x in ("cost", "tokens", "agent", "model")]).alias("unknownSourceFields"))
            .alias("provenance")).alias("metadata"),
        stable_session_id(c("parent_id"), namespace).alias("parentID"), F.lit(PROJECT_ID).alias("projectID"),
        F.struct(c("created_at").alias("created"), c("updated_at").alias("updated")).alias("time"), c("title"),
        F.struct(F.struct(F.lit(0).alias("read"), F.lit(0).alias("write")).alias("cache"), F.lit(0).alias("input"),
                 F.lit(0).alias("output"), F.lit(0).alias("reasoning")).alias("tokens")))
    out_sessions = headers.select(
        "session_id", stable_session_id(c("session_id"), namespace).alias("target_id"),
        stable_session_id(c("parent_id"), namespace).alias("parent_id"), "title", "created_at", "updated_at",
        "recovery", "source_hash", "codes", "projected", "resource_count",
        F.lit(MAPPING_VERSION).alias("mapping_version"), F.to_json(F.parse_json(info)).alias("info"))
    notes = _notes(out_sessions, rows, mapped_blocks, placeholder, compaction, projects_unknown)
    return Mapped(out_sessions, messages, out_blocks, notes, rejects, deferred)


def continuation_boundaries(sized: DataFrame, texts: DataFrame, cap: int, recent: int) -> DataFrame:
    """(session_id, pos, active_bytes, recent) for sessions over the limit; the rest is not touched."""
    totals = sized.groupBy("session_id").agg(F.sum("bytes").alias("_t")).filter(F.col("_t") > cap).select("session_id")
    long = durable(totals)
    if long.isEmpty():
        empty = sized.limit(0).select("session_id", "pos", F.col("bytes").alias("active_bytes"))
        return empty.withColumn("recent", F.lit("").cast("string"))
    entries = durable(labelled_texts(texts.join(long, "session_id", "left_semi"), recent))
    rows = sized.join(long, "session_id", "left_semi")
    # The kept text after a message without text is that after the message before it.
    tails = tail_bytes(entries, recent).select("session_id", "pos", F.struct("tail_bytes").alias("_tb"))
    filled = _last_known(rows.join(tails, ["session_id", "pos"], "left"))
    nothing = F.octet_length(F.lit("[Assistant]: Earlier imported messages remain stored in this session."))
    cuts = segment_history(filled.withColumn("tail_bytes", F.coalesce("tail_bytes", nothing)), cap)
    cuts = durable(cuts)
    return cuts.join(recent_tail(entries, cuts, recent), ["session_id", "pos"])


def _last_known(rows: DataFrame, chunk: int = 65_536) -> DataFrame:
    """``tail_bytes`` carried forward over rows without one, chunk by chunk."""
    from pyspark.sql import Window
    parts = rows.withColumn("_chunk", F.floor(F.col("pos") / chunk))
    inside = Window.partitionBy("session_id", "_chunk").orderBy("pos")
    local = parts.withColumn("_here", F.last("_tb", ignorenulls=True).over(inside))
    across = Window.partitionBy("session_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy("session_id", "_chunk").agg(
        F.max_by("_tb", F.when(F.col("_tb").isNotNull(), F.col("pos"))).alias("_end"))
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(across)).drop("_end")
    return same_keys(local, carry, ["session_id", "_chunk"]).withColumn(
        "tail_bytes", F.coalesce("_here", "_carry")["tail_bytes"]).drop("_tb", "_here", "_carry", "_chunk")


def _notes(sessions: DataFrame, rows: DataFrame, blocks: DataFrame, placeholder: DataFrame,
           compaction: DataFrame, projects_unknown: Column) -> DataFrame:
    """Warnings of the mapping: session_id, code, field."""
    c = F.col
    place = F.concat(F.lit("events["), c("pos"), F.lit("]"))
    none = F.lit(None).cast("string").alias("field")
    plain = lambda df, code: df.select("session_id", F.lit(code).alias("code"), none)
    assistants = rows.filter("type = 'assistant'")
    parts = [
        plain(sessions, "SOURCE_FIELDS_UNKNOWN"),
        plain(sessions.filter(F.size("projected") > 0), "PARTIAL_SOURCE_PROJECTION"),
        plain(sessions.filter("resource_count > 0"), "RESOURCES_DEFERRED"),
        assistants.filter("NOT reply_ok").select("session_id", F.lit("REPLY_REFERENCE_UNRESOLVED").alias("code"),
                                                 F.concat(place, F.lit(".replyToSourceId")).alias("field")),
        assistants.filter(projects_unknown).select("session_id", F.lit("ASSISTANT_STATUS_PROJECTED").alias("code"),
                                                   F.concat(place, F.lit(".status")).alias("field")),
        blocks.select("session_id", F.explode("notes").alias("n")).select("session_id", "n.code", "n.field"),
        placeholder.select("session_id", F.lit("ASSISTANT_TEXT_MISSING").alias("code"), F.concat(
            F.lit("events["), c("event_pos"), F.lit("].content")).alias("field")),
        compaction.select("session_id").distinct().select(
            "session_id", F.lit("CONTINUATION_BOUNDARY").alias("code"), F.lit("events").alias("field")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def transfer_bytes(mapped: Mapped) -> DataFrame:
    """(target_id, bytes): exact size of each session as one compact JSON transfer."""
    c = F.col
    blocks = mapped.blocks.groupBy("target_id", c("event_pos").alias("pos")).agg(
        F.sum(F.octet_length("body") + 1).alias("_b"))
    # An assistant body gains ,"content":[...] and every block but the first a comma.
    sized = mapped.messages.join(blocks.withColumn("sub", F.lit(0)), ["target_id", "pos", "sub"], "left").select(
        "target_id", (F.octet_length("body") + F.when(c("type") == "assistant", F.lit(len(',"content":[]')) + F.greatest(
            F.coalesce(c("_b"), F.lit(0)) - 1, F.lit(0))).otherwise(0) + 1).alias("_m"))
    totals = sized.groupBy("target_id").agg(F.sum("_m").alias("_m"))
    frame = len('{"info":,"messages":[]}')
    return mapped.sessions.join(totals, "target_id", "left").select(
        "target_id", (F.octet_length("info") + F.lit(frame) + F.greatest(
            F.coalesce("_m", F.lit(0)) - 1, F.lit(0))).cast("bigint").alias("bytes"))
