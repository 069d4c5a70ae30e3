"""Queries for logs, profiles, fingerprints, parsing and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.catalog.base import EVENTS, SESSIONS, TABLES, query
from palaver.operators import profile
from palaver.operators.ordered import set_hash

# Every event is one log line of its user's session.
LOG = """SELECT event_id AS line_no, concat('2024-01-01T00:00:00.000+00:00', ' [info] ',
  CASE event_type WHEN 'signup' THEN concat('[stream-diagnostics][init] history messages loaded ', chr(123), '"session_id":"u', CAST(user_id AS STRING), '","loadedMessageCount":', CAST(event_id AS STRING),
      ',"storeMessageCount":1,"pendingMessageCount":0,"planItemCount":', CAST(event_id % 2 AS STRING), ',"hasMore":', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END, chr(125))
   WHEN 'view' THEN concat('[MetadataHandler] received metadata ', chr(123), '"session_id":"u', CAST(user_id AS STRING), '","message_id":"m', CAST(event_id AS STRING), '","turn_id":"t","reply_to_message_id":"r', CAST(event_id AS STRING),
      '","message_index":', CAST(floor(value) AS STRING), ',"message_type":"task","status":"completed"', chr(125))
   WHEN 'click' THEN concat('[stream-diagnostics][metadata] metadata applied ', chr(123), '"session_id":"u', CAST(user_id AS STRING), '","agentMessageId":"m', CAST(event_id - 1 AS STRING), '","userMessageId":"r', CAST(event_id - 1 AS STRING), '"', chr(125))
   WHEN 'purchase' THEN concat('[ai-chat/v2][Realtime] event: background_command_status_changed ', chr(123), '"session_id":"u', CAST(user_id AS STRING), '","tool_call_id":"c', CAST(event_id % 40 AS STRING),
      '","result":', chr(123), '"status":"', CASE event_id % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Finished' ELSE 'Killed' END, '"', CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',"exit_code":', CAST(event_id % 2 AS STRING)) END, chr(125), chr(125))
   ELSE concat('[MetadataHandler] received metadata ', chr(123), 'broken') END) AS value FROM {events}"""
_KIND = "CASE event_type WHEN 'signup' THEN 'history' WHEN 'view' THEN 'metadata' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'tool' END"


def _log(t):
    from palaver.sources.logs import parse_log_lines
    whole = LOG.replace("CAST(floor(value) AS STRING)", "CAST(CAST(floor(value) AS BIGINT) AS STRING)")
    return parse_log_lines(t.sql(whole))


@query("s07_read_log_events", f"""
SELECT event_id AS line_no, {_KIND} AS kind, concat('u', CAST(user_id AS STRING)) AS session_id,
  CASE WHEN event_type = 'signup' THEN event_id % 5 = 0 END AS has_more, CASE WHEN event_type = 'view' THEN floor(value) END AS message_index,
  CASE event_type WHEN 'view' THEN 'completed' WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Finished' ELSE 'Killed' END END AS status
FROM events WHERE event_type <> 'error'""")
def _(t):
    return _log(t).select("line_no", "kind", "session_id", "has_more", "message_index", "status")


@query("a18_log_evidence", f"""
WITH h AS (SELECT user_id, count(*) AS histories, bool_or(event_id % 5 = 0) AS pagination_observed, bool_or(event_id % 2 > 0) AS plan_items_observed FROM events WHERE event_type = 'signup' GROUP BY 1),
v AS (SELECT e.user_id, e.event_id, floor(e.value) AS i, EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'click' AND a.user_id = e.user_id AND a.event_id - 1 = e.event_id) AS ok,
   row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS k FROM events e WHERE e.event_type = 'view'),
s AS (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY k) AS b FROM v WHERE k <= 8),
u AS (SELECT user_id, count(*) AS turn_samples, bool_and(ok) AS reply_association_verified, bool_and(b IS NULL OR i > b) AS indices_increasing FROM s GROUP BY 1),
c AS (SELECT user_id, event_id % 40 AS call, bool_or(event_id % 3 <> 0) AS paired FROM events WHERE event_type = 'purchase' GROUP BY ALL),
d AS (SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE paired) AS paired FROM c GROUP BY 1),
x AS (SELECT user_id, string_agg(DISTINCT CASE event_id % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Finished' ELSE 'Killed' END, ',' ORDER BY CASE event_id % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Finished' ELSE 'Killed' END) AS statuses FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT sha256(concat('u', CAST(user_id AS STRING))) AS session_hash, histories, pagination_observed, plan_items_observed, turn_samples, reply_association_verified, indices_increasing, calls, paired, calls - paired AS unpaired, statuses
FROM h LEFT JOIN u USING (user_id) LEFT JOIN d USING (user_id) LEFT JOIN x USING (user_id)""")
def _(t):
    return profile.log_evidence(_log(t))["sessions"].select(
        "session_hash", "histories", "pagination_observed", "plan_items_observed", "turn_samples", "reply_association_verified",
        "indices_increasing", "calls", "paired", "unpaired", F.array_join("statuses", ",").alias("statuses"))


@query("a18_log_calls", """
WITH c AS (SELECT user_id, event_id % 40 AS call, count(*) AS transitions, min(event_id) AS first_line, max(event_id) FILTER (WHERE event_id % 3 <> 0) AS last FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT concat('u', CAST(user_id AS STRING)) AS session_id, concat('c', CAST(call AS STRING)) AS call_id, first_line, transitions,
  CASE last % 3 WHEN 1 THEN 'Finished' WHEN 2 THEN 'Killed' ELSE 'unpaired' END AS terminal_status,
  CASE WHEN last IS NULL OR last % 4 = 0 THEN 'unknown' WHEN last % 2 = 0 THEN 'success' ELSE 'error' END AS exit_kind FROM c""")
def _(t):
    return profile.log_evidence(_log(t))["calls"]


STORES = """SELECT concat('w', CAST(p_partkey AS STRING)) AS workspace_id, CASE WHEN p_size % 4 = 0 THEN '9.9.9' ELSE '3.3.104' END AS version, p_size % 3 <> 0 AS has_item_table,
  p_retailprice > 950 AS has_memento, p_type AS field, CASE p_size % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' WHEN 2 THEN 'requires-runtime' ELSE 'available' END AS status FROM {part}"""


@query("a17_capability_coverage", f"""
WITH s AS (SELECT *, version = '3.3.104' AND has_item_table AND NOT has_memento AS verified FROM ({STORES})), g AS (SELECT field, CASE WHEN status = 'available' AND NOT verified THEN 'unverified' ELSE status END AS status FROM s)
SELECT field, count(*) FILTER (WHERE status = 'available') AS available, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'invalid') AS invalid,
  count(*) FILTER (WHERE status = 'unverified') AS unverified, count(*) FILTER (WHERE status = 'requires-runtime') AS requires_runtime FROM g GROUP BY 1""")
def _(t):
    return profile.capability_coverage(t.sql(STORES), ("3.3.104",))[0]


@query("a17_profile_counts", f"""
WITH s AS (SELECT CASE WHEN version <> '3.3.104' THEN 'unknown' WHEN has_memento AND has_item_table THEN 'hybrid' WHEN has_memento THEN 'memento-v1' WHEN has_item_table THEN 'workspace-v3' ELSE 'unknown' END AS profile FROM ({STORES}))
SELECT d.profile, count(s.profile) AS n FROM (VALUES ('workspace-v3'), ('memento-v1'), ('hybrid'), ('unknown')) d(profile) LEFT JOIN s USING (profile) GROUP BY 1""")
def _(t):
    return profile.capability_coverage(t.sql(STORES), ("3.3.104",))[1]


_PROFILE_SQL = f"""
WITH e AS ({EVENTS})
SELECT 'messages' AS metric, 'all' AS value, count(*) AS n FROM e UNION ALL SELECT 'role', type, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'status', coalesce(status, 'unknown'), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'text.text', 'count', count(text) FROM e UNION ALL SELECT 'text.text', 'nonEmpty', count(*) FILTER (WHERE trim(text) <> '') FROM e
UNION ALL SELECT 'text.text', 'totalChars', CAST(sum(length(text)) AS BIGINT) FROM e
UNION ALL SELECT 'timing', 'created_at', count(created_at) FROM e UNION ALL SELECT 'timing', 'completed_at', count(completed_at) FROM e"""


def _evidence_profile(t):
    return profile.evidence_profile(t.sql(EVENTS), {"role": "type", "status": "status", "type": "type"}, ["text"],
                                    ["created_at", "completed_at"])


@query("a19_evidence_profile", _PROFILE_SQL)
def _(t):
    return _evidence_profile(t)


@query("a19_key_presence", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def _(t):
    return profile.key_presence(t.events, "props")


@query("a20_assert_coverage", f"""
WITH e AS ({EVENTS}), r AS (SELECT count(*) AS samples, count(*) FILTER (WHERE u.type = 'user') AS matches FROM e a LEFT JOIN e u ON u.session_id = a.session_id AND u.event_id = a.reply_to WHERE a.type = 'assistant'),
c AS (SELECT count(*) AS m, count(*) FILTER (WHERE type = 'user') AS u, count(*) FILTER (WHERE type = 'assistant') AS a, count(completed_at) AS k, count(*) FILTER (WHERE trim(text) <> '') AS x FROM e)
SELECT 'roles sum to messages' AS expectation, u > 0 AND a > 0 AND u + a = m AS ok FROM c UNION ALL SELECT 'classifications sum to messages', true
UNION ALL SELECT 'every assistant is linked', samples > 0 AND samples = matches AND samples = a FROM r, c UNION ALL SELECT 'timing is complete', k = a FROM c UNION ALL SELECT 'text present: text', x > 0 FROM c""")
def _(t):
    from palaver.operators.refs import link_replies
    relation = link_replies(t.sql(EVENTS)).agg(F.count(F.lit(1)).alias("samples"), F.count_if("reply_ok").alias("matches"))
    return profile.assert_coverage(_evidence_profile(t), relation, ["text"])


def _set_sql(rows: str) -> str:
    """The three levels of the set hash over ``rows`` with a column h."""
    return f"""WITH r AS (SELECT DISTINCT h FROM ({rows})), a AS (SELECT substring(h, 1, 6) AS p, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM r GROUP BY 1),
b AS (SELECT substring(p, 1, 3) AS q, sha256(string_agg(h, ',' ORDER BY p)) AS h FROM a GROUP BY 1)
SELECT concat('sha256:', sha256(string_agg(h, ',' ORDER BY q))) AS fingerprint FROM b"""


@query("a21_fingerprint", _set_sql("SELECT sha256(text) AS h FROM documents"))
def _(t):
    return set_hash(t.documents.select(F.sha2("text", 256).alias("h")), [], "h", "fingerprint")


# Names of types in DuckDB for those of Spark that occur in the given tables.
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "TINYINT": "tinyint", "VARCHAR": "string", "DOUBLE": "double", "FLOAT": "float",
          "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "FLOAT[]": "array<float>", "DOUBLE[]": "array<double>"}
_TYPE_CASE = "CASE column_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " ELSE column_type END"


@query("a23_profile_tables", " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, column_name, {_TYPE_CASE} AS type, "null" = 'YES' AS nullable, (SELECT count(*) FROM {name}) AS row_count FROM (DESCRIBE {name})"""
    for name in TABLES))
def _(t):
    return profile.profile_tables({name: getattr(t, name) for name in TABLES}).select("table_name", "column_name", "type", "nullable", "row_count")


@query("a22_profile_json_keys", """
SELECT '$' AS path, NULL AS key, 'object' AS kind, count(*) AS n FROM events UNION ALL SELECT '$.k', 'k', 'number', count(*) FROM events
UNION ALL SELECT '$.list', 'list', 'array', count(*) FROM events UNION ALL SELECT '$.list[*]', NULL, 'object', 2 * count(*) FROM events
UNION ALL SELECT '$.list[*].t', 't', 'string', 2 * count(*) FROM events""")
def _(t):
    rows = t.events.select("event_id", F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"list":[{"t":"'), "event_type",
                                                F.lit('"},{"t":"'), "event_type", F.lit('"}]}')).alias("payload"))
    return profile.profile_json_keys(rows, ["event_id"], "payload")


@query("a24_schema_drift", """
SELECT concat('s', CAST(p_partkey AS STRING)) AS schema_id, CASE WHEN p_size % 5 = 0 THEN 'incompatible' WHEN p_size % 3 = 0 OR p_size % 7 = 0 THEN 'compatible' ELSE 'exact' END AS status,
  CAST(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS change_count FROM part""")
def _(t):
    from palaver.operators.drift import compare_to
    head, tail = '{"type":"object","additionalProperties":false,"required":["a"],"properties":{"a":{"type":', "}}"
    # Some schemas change a type, some widen an enum, some add an optional property.
    text = F.concat(F.lit(head), F.when(F.col("p_size") % 5 == 0, '"number"').otherwise('"string"'), F.lit('},"b":{"enum":["x","y"'),
                    F.when(F.col("p_size") % 3 == 0, ',"z"').otherwise(""), F.lit("]}"),
                    F.when(F.col("p_size") % 7 == 0, ',"c":{"type":"string"}').otherwise(""), F.lit(tail))
    base = t.spark.createDataFrame([("base", head + '"string"},"b":{"enum":["x","y"]}' + tail)], "schema_id string, schema string")
    fleet = t.part.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("schema_id"), text.alias("schema"))
    return compare_to(base.unionByName(fleet), "base")[0]


def records(t):
    """Every turn as a saved record of a message service, with plan steps and a tool call."""
    c = F.col
    second = (1700000000 + c("conv_id") * 100 + c("turn")).alias("created_at")
    base = [F.concat(F.lit("m"), c("turn").cast("string")).alias("message_id"), c("session_id").alias("chat_session_id"),
            c("role"), c("turn").alias("message_index"), second]
    user = F.to_json(F.struct(*base, c("text").alias("content")))
    stamp = 1700000000000 + c("conv_id") * 100000 + c("turn") * 1000
    call = F.struct(F.concat(F.lit("c"), c("turn").cast("string")).alias("id"), F.lit("exec_command").alias("name"),
                    F.struct(F.lit("ls").alias("cmd")).alias("params"),
                    F.struct(F.lit("success").alias("status"), F.struct(c("text").alias("stdout")).alias("data")).alias("result"))
    entry = F.struct(F.lit("plan_item").alias("type"), F.struct(
        F.concat(F.lit("p"), c("turn").cast("string")).alias("id"), F.lit("because").alias("reasoning_content"), call.alias("tool_call_info"),
        F.struct(stamp.alias("tool_call_started_at_ms"), (stamp + 10).alias("tool_call_finished_at_ms")).alias("timing")).alias("plan_item"))
    said = F.struct(F.lit("proposal").alias("type"), F.struct(F.struct(c("text").alias("thought")).alias("content")).alias("proposal"))
    fields = F.to_json(F.struct(
        *base, F.lit("task").alias("message_type"), F.lit("completed").alias("status"), F.concat(F.lit("t"), c("turn").cast("string")).alias("turn_id"),
        F.concat(F.lit("m"), (c("turn") - 1).cast("string")).alias("reply_to_message_id"), stamp.alias("chat_start_time"),
        (stamp + 500).alias("chat_end_time")))
    joined = F.concat(F.substring(fields, F.lit(1), F.length(fields) - 1), F.lit(',"content":{"messages":['), F.to_json(entry), F.lit(","),
                      F.to_json(said), F.lit("]}}"))
    rows = t.conversations.withColumn("session_id", F.concat(F.lit("session-"), c("conv_id").cast("string"))).select(
        "session_id", "turn", F.when(c("role") == "assistant", joined).otherwise(user).alias("record"))
    return rows


def recs(t):
    """The records one by one, as the parsers take them."""
    return records(t).select("session_id", F.col("turn").cast("int").alias("entry_index"), F.try_parse_json("record").alias("rec"))


@query("p01_parse_user_messages", """
SELECT concat('session-', CAST(conv_id AS STRING)) AS session_id, concat('m', CAST(turn AS STRING)) AS message_id, turn AS ord, (1700000000 + conv_id * 100 + turn) * 1000 AS created_at, sha256(text) AS text_hash, NULL AS code
FROM conversations WHERE role = 'user' UNION ALL SELECT concat('session-', CAST(conv_id AS STRING)), concat('m', CAST(turn AS STRING)), NULL, NULL, NULL, 'USER_RECORD_INVALID' FROM conversations WHERE role = 'system'""")
def _(t):
    from palaver.operators.parse import parse_user_messages
    messages, issues = parse_user_messages(recs(t))
    none = lambda kind: F.lit(None).cast(kind)
    return messages.select("session_id", "message_id", "ord", "created_at", F.sha2("text", 256).alias("text_hash"), none("string").alias("code")).unionByName(
        issues.select("session_id", "message_id", none("bigint").alias("ord"), none("bigint").alias("created_at"), none("string").alias("text_hash"), "code"))


_ASSISTANTS = "SELECT concat('session-', CAST(conv_id AS STRING)) AS session_id, concat('m', CAST(turn AS STRING)) AS message_id, turn, text, 1700000000000 + conv_id * 100000 + turn * 1000 AS stamp FROM conversations WHERE role = 'assistant'"


@query("p03_parse_assistant_messages", f"""
SELECT session_id, message_id, turn AS ord, 'completed' AS status, stamp AS started_at, stamp + 500 AS completed_at, concat('m', CAST(turn - 1 AS STRING)) AS reply_to FROM ({_ASSISTANTS})""")
def _(t):
    from palaver.operators.parse import parse_assistant_messages
    return parse_assistant_messages(recs(t))["messages"].select(
        "session_id", "message_id", "ord", "status", "started_at", "completed_at", "reply_to")


@query("p04_assistant_text_blocks", f"""
SELECT session_id, message_id, CAST(1 AS INT) AS block_index, sha256(text) AS text_hash, 'content.messages[1].proposal.content.thought' AS locator FROM ({_ASSISTANTS}) WHERE trim(text) <> ''""")
def _(t):
    from palaver.operators.parse import parse_assistant_messages
    return parse_assistant_messages(recs(t))["texts"].select(
        "session_id", "message_id", "block_index", F.sha2("text", 256).alias("text_hash"), "locator")


@query("p05_reasoning_blocks", f"SELECT session_id, message_id, CAST(0 AS INT) AS block_index, 'because' AS text FROM ({_ASSISTANTS})")
def _(t):
    from palaver.operators.parse import parse_assistant_messages
    return parse_assistant_messages(recs(t))["reasoning"].select("session_id", "message_id", "block_index", "text")


@query("p06_tool_observations", f"""
SELECT session_id, message_id, concat('c', CAST(turn AS STRING)) AS call_id, 'exec_command' AS name, '{{"cmd":"ls"}}' AS input, 'completed' AS status, stamp AS started_at, stamp + 10 AS completed_at FROM ({_ASSISTANTS})""")
def _(t):
    from palaver.operators.parse import parse_assistant_messages
    return parse_assistant_messages(recs(t))["tool_obs"].select(
        "session_id", "message_id", "call_id", "name", "input", "status", "started_at", "completed_at")


@query("p02_message_text", """
SELECT conv_id, turn, sha256(text) AS text_hash, turn % 3 <> 2 AS from_content FROM conversations""")
def _(t):
    from palaver.operators.parse import message_text
    # A plain text, a string of blocks, or only a query.
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    content = F.when(F.col("turn") % 3 == 0, F.to_json(F.array("text"))).when(F.col("turn") % 3 == 1, block)
    value = F.try_parse_json(F.when(F.col("turn") % 3 == 0, F.substring(content, F.lit(2), F.length(content) - 2)).otherwise(content))
    rows = t.conversations.withColumn("content", value).withColumn("query", F.try_parse_json(block))
    m = message_text(F.col("content"), F.col("query"))
    return rows.select("conv_id", "turn", m.alias("m")).select(
        "conv_id", "turn", F.sha2(F.coalesce("m.content_text", "m.query_text"), 256).alias("text_hash"),
        F.col("m.content_text").isNotNull().alias("from_content"))


@query("a04_dedup_plan_items", """
WITH i AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS versions, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN versions = 1 THEN 'kept' ELSE 'conflict' END AS outcome FROM i""")
def _(t):
    from palaver.operators.dedup import dedup_plan_items
    rows = t.lineitem.select(F.col("l_orderkey").alias("session_id"), F.lit("m").alias("message_id"), F.col("l_linenumber").alias("item_id"),
                             F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"), F.col("l_suppkey").alias("entry_index"))
    kept, conflicts = dedup_plan_items(rows)
    pick = lambda df, name: df.select(F.col("session_id").alias("l_orderkey"), F.col("item_id").alias("l_linenumber"), F.lit(name).alias("outcome"))
    return pick(kept, "kept").unionByName(pick(conflicts, "conflict"))


@query("j13_issues_to_events", f"""
SELECT session_id, event_id AS message_id, CASE WHEN type = 'user' THEN 'event' ELSE 'raw' END AS origin FROM ({EVENTS}) WHERE length(text) % 3 = 0""")
def _(t):
    from palaver.operators.refs import issues_to_events
    events = t.sql(EVENTS)
    issues = events.filter("length(text) % 3 = 0").select("session_id", F.col("event_id").alias("message_id"), F.lit("X").alias("code"))
    surviving = events.filter("type = 'user'").select("session_id", "event_id", "pos", F.array(F.lit("event")).alias("refs"))
    raw = events.select("session_id").distinct().withColumn("raw_refs", F.array(F.lit("raw")))
    return issues_to_events(issues, surviving, raw).select("session_id", "message_id", F.col("refs")[0].alias("origin"))


def bundle_of(t):
    """The bundle assembled from the conversations."""
    from palaver.plans.assemble import Inputs, assemble
    expected = t.conversations.groupBy(F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session_id")).agg(
        F.count(F.lit(1)).alias("expected"))
    answers = expected.select("session_id", F.lit("available").alias("status"), "expected")
    sessions = t.sql(SESSIONS)
    metadata = sessions.select("session_id", F.lit("A title").alias("title"), "created_at", F.coalesce("updated_at", "created_at").alias("updated_at"),
                              "parent_id", F.lit("complete").alias("status"))
    places = F.concat(F.lit("w"), (F.col("conv_id") % 10).cast("string"))
    sources = sessions.select("session_id", places.alias("workspace_id"), F.lit("runtime-metadata").alias("kind"), F.lit("runtime:getSessions#session").alias("locator"),
                              F.concat(F.lit("sha256:"), F.sha2("session_id", 256)).alias("digest"))
    projects = sources.select("workspace_id", F.concat(F.lit("/work/"), "workspace_id").alias("path"), F.lit("folder-uri").alias("source")).distinct()
    return assemble(Inputs(metadata, sources, answers, projects, recs=recs(t)))


# A system turn is an invalid record: an error for both parsers. Replies to it dangle. A session
# that was updated before it was created is not complete either.
_ASSEMBLED = """WITH c AS (SELECT concat('session-', CAST(conv_id AS STRING)) AS session_id, role, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
s AS (SELECT session_id, CAST(substring(session_id, 9) AS BIGINT) AS n, count(*) FILTER (WHERE role = 'system') AS bad, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants,
  count(*) FILTER (WHERE role = 'assistant' AND before IS DISTINCT FROM 'user') AS dangling FROM c GROUP BY 1)"""


@query("m01_assemble", f"""{_ASSEMBLED}
SELECT session_id, users, assistants, 3 * assistants AS blocks, CASE WHEN bad = 0 AND dangling = 0 AND users > 0 AND assistants > 0 AND NOT (n % 17 = 1 AND n % 9 <> 0) THEN 'complete' WHEN users > 0 AND assistants > 0 THEN 'partial' ELSE 'metadata-only' END AS recovery FROM s""")
def _(t):
    b = bundle_of(t)
    events = b["events"].groupBy("session_id").agg(F.count_if(F.col("type") == "user").alias("users"), F.count_if(F.col("type") == "assistant").alias("assistants"))
    blocks = b["blocks"].groupBy("session_id").agg(F.count(F.lit(1)).alias("blocks"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    return b["sessions"].select("session_id", "recovery").join(events, "session_id", "left").join(blocks, "session_id", "left").select(
        "session_id", zero("users"), zero("assistants"), zero("blocks"), "recovery")


