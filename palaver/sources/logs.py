"""Renderer log lines as typed events; the same code reads files and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import variant as V
from palaver.functions.common import let

# The markers in front of the JSON of each event kind, and the stamp width.
MARKERS = {
    "history": "[stream-diagnostics][init] history messages loaded ",
    "metadata": "[MetadataHandler] received metadata ",
    "applied": "[stream-diagnostics][metadata] metadata applied ",
    "tool": "[ai-chat/v2][Realtime] event: background_command_status_changed ",
}
STAMP_CHARS = 29


def _after(line: Column, kind: str, marker: str) -> Column:
    """struct(kind, v) of the JSON object behind the marker, NULL without one."""
    place = F.instr(line, F.lit(marker))
    parsed = F.when(place > 0, F.try_parse_json(F.substring(line, place + len(marker), F.length(line))))
    return let(parsed, lambda v: F.when(V.obj(v).isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("v"))))


def _any_marker(line: Column) -> Column:
    marks = [F.contains(line, F.lit(m)) for m in MARKERS.values()]
    return marks[0] | marks[1] | marks[2] | marks[3]


def _number(v: Column) -> Column:
    return F.when(V.is_number(v), F.try_variant_get(v, "$", "double"))


def parse_log_lines(lines: DataFrame, column: str = "value", session: str | None = None) -> DataFrame:
    """One typed row per recognised line; lines without a known marker or with bad JSON are skipped.

    Extra columns of ``lines`` (for example a line number) are kept. ``session`` keeps only lines
    that mention it.
    """
    line = F.regexp_replace(F.col(column), r"\r$", "")
    if session is not None:
        lines = lines.filter(F.contains(F.col(column), F.lit(session)))
    extra = [c for c in lines.columns if c != column]
    # Each line is parsed once; all fields are read from that value.
    found = F.coalesce(*[_after(line, kind, marker) for kind, marker in MARKERS.items()])

    def fields(p: Column) -> Column:
        kind, b = p["kind"], p["v"]
        text = lambda path: F.nullif(V.text(V.field(b, path)), F.lit(""))
        only = lambda name, value: F.when(kind == name, value)
        return F.struct(
            kind.alias("kind"), F.coalesce(text("$.session_id"), text("$.sessionId")).alias("session_id"),
            *[only("history", _number(V.field(b, f"$.{raw}"))).alias(n) for n, raw in (
                ("loaded", "loadedMessageCount"), ("stored", "storeMessageCount"),
                ("pending", "pendingMessageCount"), ("plan_items", "planItemCount"))],
            only("history", V.boolean(V.field(b, "$.hasMore"))).alias("has_more"),
            F.coalesce(only("metadata", text("$.message_id")), only("applied", text("$.agentMessageId"))).alias("message_id"),
            F.coalesce(only("metadata", text("$.reply_to_message_id")), only("applied", text("$.userMessageId"))).alias("reply_to"),
            only("metadata", text("$.turn_id")).alias("turn_id"),
            only("metadata", _number(V.field(b, "$.message_index"))).alias("message_index"),
            only("metadata", text("$.message_type")).alias("message_type"),
            only("tool", text("$.tool_call_id")).alias("call_id"),
            F.coalesce(only("metadata", text("$.status")), only("tool", text("$.result.status"))).alias("status"),
            only("tool", _number(V.field(b, "$.result.exit_code"))).alias("exit_code"))
    marked = lines.filter(_any_marker(F.col(column)))
    opened = marked.select(*extra, F.substring(line, 1, STAMP_CHARS).alias("observed_at"),
                           F.explode(F.array_compact(F.array(let(found, fields)))).alias("f"))
    typed = opened.select(*extra, "observed_at", "f.*").filter("kind IS NOT NULL")
    complete = (F.when(F.col("kind") == "history", F.col("loaded").isNotNull() & F.col("stored").isNotNull()
                       & F.col("pending").isNotNull() & F.col("plan_items").isNotNull() & F.col("has_more").isNotNull())
                .when(F.col("kind") == "metadata", F.col("message_id").isNotNull() & F.col("turn_id").isNotNull()
                      & F.col("reply_to").isNotNull() & F.col("message_index").isNotNull()
                      & F.col("message_type").isNotNull() & F.col("status").isNotNull())
                .when(F.col("kind") == "applied", F.col("message_id").isNotNull() & F.col("reply_to").isNotNull())
                .otherwise(F.col("call_id").isNotNull() & F.col("status").isNotNull()))
    return typed.filter(complete)


def read_log_events(spark: SparkSession, path: str, streaming: bool = False, session: str | None = None) -> DataFrame:
    """Log files of a folder, in batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return parse_log_lines(reader.text(path), session=session)
