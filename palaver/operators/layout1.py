"""The first target layout (message info and parts), derived from the mapped second layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import variant as V
from palaver.functions.identity import stable_part_id
from palaver.operators.mapping import MAPPING_VERSION, PROJECT_ID, UNKNOWN_AGENT, Mapped
from palaver.operators.segments import normalize_message_order
from palaver.session import durable


@dataclass
class MappedParts:
    sessions: DataFrame
    messages: DataFrame
    parts: DataFrame
    provenance: DataFrame
    diagnostics: DataFrame
    rejects: DataFrame


def _part_time(body: Column, need_end: bool) -> Column:
    """Times of the block, with those of the turn where the block has none."""
    time = V.field(body, "$.time")
    start = F.coalesce(V.safe_integer(V.field(time, "$.created")), F.col("turn_created"))
    end = F.coalesce(V.safe_integer(V.field(time, "$.completed")), F.col("turn_completed"))
    return F.struct(start.alias("start"), (end if need_end else F.lit(None).cast("bigint")).alias("end"))


def map_parts(blocks: DataFrame, namespace: str) -> DataFrame:
    """One part per block: id, type, JSON body, ``reject`` and which times had to be projected.

    ``blocks``: target_id, message_id, content_pos, body (JSON of layout 2), turn_created,
    turn_completed.
    """
    b = F.try_parse_json(F.col("body"))
    rows = blocks.withColumn("b", b).withColumn("kind", V.text(V.field(F.col("b"), "$.type")))
    b = F.col("b")
    rows = rows.withColumn("st", V.field(b, "$.state")).withColumn("status", V.text(V.field(F.col("st"), "$.status")))
    st, kind, status = F.col("st"), F.col("kind"), F.col("status")
    time = V.field(b, "$.time")
    has_start = V.safe_integer(V.field(time, "$.created")).isNotNull()
    has_end = V.safe_integer(V.field(time, "$.completed")).isNotNull()
    ident = stable_part_id(F.col("target_id"), F.col("message_id"), F.col("content_pos"), namespace)
    common = [ident.alias("id"), F.col("message_id").alias("messageID"), F.col("target_id").alias("sessionID"),
              kind.alias("type")]
    text = F.coalesce(V.text(V.field(b, "$.text")), F.lit(""))
    text_body = F.to_json(F.struct(*common, text.alias("text"), F.when(has_start, F.struct(
        V.safe_integer(V.field(time, "$.created")).alias("start"))).alias("time")))
    reasoning_body = F.to_json(F.struct(*common, text.alias("text"), _part_time(b, True).alias("time"),
                                        V.field(b, "$.metadata").alias("metadata")))
    name = F.coalesce(V.text(V.field(b, "$.name")), F.lit(UNKNOWN_AGENT))
    metadata = F.coalesce(V.obj(V.field(st, "$.metadata")), F.parse_json(F.lit("{}")))
    given = F.coalesce(V.obj(V.field(st, "$.input")), F.parse_json(F.lit("{}")))
    content = V.array(V.field(st, "$.content"))
    outputs = F.filter(F.transform(content, lambda x: F.when(V.text(V.field(x, "$.type")) == "text",
                                                             V.text(V.field(x, "$.text")))), lambda x: x.isNotNull())
    marker = F.coalesce(V.obj(V.field(metadata, "$.provenance")), F.parse_json(F.lit("{}")))
    with_output = F.map_concat(F.try_variant_get(marker, "$", "map<string,variant>"), F.create_map(
        F.lit("outputContent"), V.field(st, "$.content")))
    error_marker = F.when(F.size(content) > 0, F.try_parse_json(F.to_json(with_output))).otherwise(marker)
    other = F.map_filter(F.try_variant_get(metadata, "$", "map<string,variant>"), lambda k, _: k != "provenance")
    error_meta = F.try_parse_json(F.to_json(F.map_concat(other, F.create_map(F.lit("provenance"), error_marker))))
    pending = F.to_json(F.struct(F.lit("pending").alias("status"), F.parse_json(F.lit("{}")).alias("input"),
                                 F.coalesce(V.text(V.field(st, "$.input")), F.lit("")).alias("raw")))
    running = F.to_json(F.struct(F.lit("running").alias("status"), given.alias("input"), metadata.alias("metadata"),
                                 _part_time(b, False).alias("time")))
    done = F.to_json(F.struct(F.lit("completed").alias("status"), given.alias("input"),
                              F.get(outputs, 0).alias("output"), metadata.alias("metadata"), name.alias("title"),
                              _part_time(b, True).alias("time")))
    failed = F.to_json(F.struct(
        F.lit("error").alias("status"), given.alias("input"),
        F.coalesce(V.text(V.field(st, "$.error.message")), F.lit("")).alias("error"), error_meta.alias("metadata"),
        _part_time(b, True).alias("time")))
    state = (F.when(status == "streaming", pending).when(status == "running", running)
             .when(status == "completed", done).when(status == "error", failed))
    tool_body = F.to_json(F.struct(*common, F.coalesce(V.text(V.field(b, "$.id")), F.lit("")).alias("callID"),
                                   name.alias("tool"), F.try_parse_json(state).alias("state")))
    bad = (kind == "tool") & (state.isNull() | ((status == "completed") & (
        (F.coalesce(F.size(content), F.lit(0)) != 1) | (F.size(outputs) != 1))))
    timed = (kind == "reasoning") | ((kind == "tool") & (status != "streaming"))
    ended = (kind == "reasoning") | ((kind == "tool") & status.isin("completed", "error"))
    return rows.select(
        *[c for c in blocks.columns if c not in ("body",)], ident.alias("id"), kind.alias("type"),
        F.when(kind == "text", text_body).when(kind == "reasoning", reasoning_body).otherwise(tool_body).alias("body"),
        F.when(F.coalesce(bad, F.lit(False)) | ~F.coalesce(kind.isin("text", "reasoning", "tool"), F.lit(False)),
               "tool.content").alias("reject"),
        F.coalesce(timed & ~has_start, F.lit(False)).alias("start_projected"),
        F.coalesce(ended & ~has_end, F.lit(False)).alias("end_projected"),
        F.coalesce(status == "streaming", F.lit(False)).alias("was_streaming"))


def map_sessions_v1(mapped: Mapped, version: str, namespace: str, directory: str = "/") -> MappedParts:
    """Layout 1 of a layout-2 mapping; boundaries are dropped and counted."""
    c = F.col
    messages = mapped.messages.filter("type <> 'compaction'")
    boundaries = mapped.messages.filter("type = 'compaction'").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("omitted"))
    targets = messages.filter("type = 'user'").select("session_id", c("event_id").alias("reply_to"),
                                                      c("id").alias("parent_message"))
    linked = messages.join(targets, ["session_id", "reply_to"], "left")
    reject = F.when(c("type") == "assistant", F.when(
        ~F.coalesce("reply_ok", F.lit(False)) | c("parent_message").isNull(), "assistant.reply").when(
        c("completed_at").isNull(), "assistant.completedAt"))
    linked = linked.withColumn("reject", reject)
    turn = messages.select("session_id", c("pos").alias("event_pos"), c("created_at").alias("turn_created"),
                           c("completed_at").alias("turn_completed"))
    parts = map_parts(mapped.blocks.join(turn, ["session_id", "event_pos"]).select(
        "session_id", "target_id", "event_pos", "message_id", "content_pos", "body", "turn_created",
        "turn_completed"), namespace)
    user_text = V.text(V.field(F.try_parse_json(c("body")), "$.text"))
    user_id = stable_part_id(c("target_id"), c("id"), F.lit(0), namespace)
    user_parts = messages.filter("type = 'user'").select(
        "session_id", "target_id", c("pos").alias("event_pos"), c("id").alias("message_id"),
        F.lit(0).cast("bigint").alias("content_pos"), user_id.alias("id"), F.lit("text").alias("type"),
        F.to_json(F.struct(user_id.alias("id"), c("id").alias("messageID"), c("target_id").alias("sessionID"),
                           F.lit("text").alias("type"), F.coalesce(user_text, F.lit("")).alias("text"))).alias("body"))
    rejects = (mapped.rejects.select("session_id", "field", "code")
               .unionByName(linked.filter("reject IS NOT NULL").select(
                   "session_id", c("reject").alias("field"), F.lit("UNSUPPORTED_STATE").alias("code")))
               .unionByName(parts.filter("reject IS NOT NULL").select(
                   "session_id", c("reject").alias("field"), F.lit("UNSUPPORTED_STATE").alias("code"))))
    rejects = rejects.groupBy("session_id").agg(F.min_by(F.struct("field", "code"), "code").alias("r")).select(
        "session_id", "r.*")
    keep = lambda df: df.join(rejects, "session_id", "left_anti")
    finish = V.text(V.field(F.try_parse_json(c("body")), "$.finish"))
    zero = F.struct(F.struct(F.lit(0).alias("read"), F.lit(0).alias("write")).alias("cache"),
                    F.lit(0).alias("input"), F.lit(0).alias("output"), F.lit(0).alias("reasoning"))
    user_info = F.to_json(F.struct(
        F.lit(UNKNOWN_AGENT).alias("agent"), c("id"), F.struct(
            F.lit("unknown").alias("modelID"), F.lit(UNKNOWN_AGENT).alias("providerID")).alias("model"),
        F.lit("user").alias("role"), c("target_id").alias("sessionID"),
        F.struct(c("created_at").alias("created")).alias("time")))
    assistant_info = F.to_json(F.struct(
        F.lit(UNKNOWN_AGENT).alias("agent"), F.lit(0).alias("cost"), finish.alias("finish"), c("id"),
        F.lit(UNKNOWN_AGENT).alias("mode"), F.lit("unknown").alias("modelID"), c("parent_message").alias("parentID"),
        F.struct(F.lit(directory).alias("cwd"), F.lit(directory).alias("root")).alias("path"),
        F.lit(UNKNOWN_AGENT).alias("providerID"), F.lit("assistant").alias("role"), c("target_id").alias("sessionID"),
        F.struct(c("created_at").alias("created"), c("completed_at").alias("completed")).alias("time"),
        zero.alias("tokens")))
    # This layout orders messages by creation time and id; parts and provenance follow their message.
    placed, moved = normalize_message_order(keep(linked))
    placed = durable(placed)
    out_messages = placed.select(
        "session_id", "target_id", c("new_pos").alias("pos"), "event_id", "id", c("type").alias("role"), "created_at",
        F.when(c("type") == "user", user_info).otherwise(assistant_info).alias("body"))
    provenance = placed.select(
        "session_id", c("new_pos").alias("pos"), F.to_json(V.field(F.try_parse_json(c("body")), "$.metadata.provenance")).alias("event"))
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))
    heads = keep(mapped.sessions).join(counts, "session_id", "left").join(boundaries, "session_id", "left")
    info = F.to_json(F.struct(
        F.lit(UNKNOWN_AGENT).alias("agent"), F.lit(0).alias("cost"), F.lit(directory).alias("directory"),
        c("target_id").alias("id"), F.struct(F.struct(
            F.coalesce("omitted", F.lit(0)).alias("continuationBoundariesOmitted"), F.lit("v1").alias("dialect"),
            F.coalesce("events", F.lit(0)).alias("eventCount"), F.lit(MAPPING_VERSION).alias("mappingVersion"),
            c("projected").alias("projectedSourceCodes"), c("resource_count").alias("resourceCount"),
            c("codes").alias("sourceDiagnosticCodes"), c("recovery").alias("sourceRecovery"),
            c("session_id").alias("sourceSessionId"), c("source_hash").alias("sourceSessionSha256"),
            F.lit(version).alias("targetVersion"),
            F.array(*[F.lit(x) for x in ("cost", "tokens", "agent", "model")]).alias("unknownSourceFields"))
            .alias("provenance")).alias("metadata"),
        F.struct(F.lit("unknown").alias("id"), F.lit(UNKNOWN_AGENT).alias("providerID")).alias("model"),
        c("parent_id").alias("parentID"), F.lit(PROJECT_ID).alias("projectID"),
        F.concat(F.lit("import-"), F.substring("target_id", 5, 8)).alias("slug"),
        F.struct(c("created_at").alias("created"), c("updated_at").alias("updated")).alias("time"), "title",
        zero.alias("tokens"), F.lit(version).alias("version")))
    sessions = heads.select("session_id", "target_id", "parent_id", "recovery", "mapping_version",
                            F.to_json(F.parse_json(info)).alias("info"))
    out_parts = keep(parts).select("session_id", "target_id", "event_pos", "message_id", "content_pos", "id", "type",
                                   "body").unionByName(keep(user_parts))
    steps = placed.select("session_id", c("pos").alias("event_pos"), "new_pos")
    out_parts = out_parts.join(steps, ["session_id", "event_pos"]).withColumn("event_pos", c("new_pos")).drop("new_pos")
    reordered = moved.filter("reordered")
    note = lambda rows, code, field: rows.select("session_id").distinct().select(
        "session_id", F.lit(code).alias("code"), F.lit(field).alias("field"))
    diagnostics = (keep(mapped.diagnostics).filter("code <> 'CONTINUATION_BOUNDARY'")
                   .unionByName(note(reordered, "MESSAGE_ORDER_NORMALIZED", "events"))
                   .unionByName(note(keep(boundaries), "CONTINUATION_BOUNDARY_OMITTED", "events"))
                   .unionByName(note(keep(parts).filter("was_streaming"), "TOOL_STATUS_PENDING", "events"))
                   .unionByName(note(keep(parts).filter("start_projected"), "PART_START_PROJECTED", "part.start"))
                   .unionByName(note(keep(parts).filter("end_projected"), "PART_END_PROJECTED", "part.end"))
                   .unionByName(note(sessions, "PROVENANCE_AT_SESSION", "info.metadata")))
    return MappedParts(sessions, out_messages, out_parts, provenance, diagnostics, rejects)
