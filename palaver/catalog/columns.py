"""Queries for the column functions and the small set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.catalog.base import BLOCKS, EVENTS, READ_TWICE, SESSIONS, query
from palaver.functions import credentials as C
from palaver.functions import identity as I
from palaver.functions import paths as P
from palaver.functions import text as T
from palaver.functions import values as V
from palaver.functions import versions as R
from palaver.operators import payload, refs
from palaver.operators.ordered import top_per_key
from palaver.operators.segments import order_blocks

STATUS = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' END AS raw
FROM {orders} UNION ALL SELECT event_id AS o_orderkey, event_type AS raw FROM {events}"""


@query("p07_normalize_status", f"""
SELECT raw, CASE raw WHEN 'success' THEN 'completed' WHEN 'failed' THEN 'error' WHEN 'running' THEN 'running' ELSE 'unknown' END AS status,
  count(*) AS n FROM ({STATUS}) GROUP BY 1, 2""")
def _(t):
    rows = t.sql(STATUS).select("raw", V.normalize_status(F.col("raw")).alias("status"))
    return rows.groupBy("raw", "status").agg(F.count(F.lit(1)).alias("n"))


TIMES = """SELECT event_id, concat('17', lpad(CAST(event_id AS STRING), 8, '0')) AS seconds,
  CASE WHEN event_id % 3 = 0 THEN concat('2024-01-', lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0'), 'T00:00:07Z')
       WHEN event_id % 3 = 1 THEN concat('00', CAST(event_id AS STRING)) ELSE event_type END AS mixed FROM {events}"""


@query("p08_to_epoch_ms", f"""
SELECT event_id, CAST(seconds AS BIGINT) * 1000 AS from_seconds,
  CASE WHEN regexp_full_match(mixed, '[0-9]+') THEN CAST(mixed AS BIGINT)
       ELSE epoch_ms(CAST(TRY_CAST(mixed AS TIMESTAMPTZ) AS TIMESTAMP)) END AS from_mixed FROM ({TIMES})""")
def _(t):
    return t.sql(TIMES).select("event_id", V.to_epoch_ms(F.col("seconds"), "s").alias("from_seconds"),
                               V.to_epoch_ms(F.col("mixed")).alias("from_mixed"))


RELEASES = """SELECT p_partkey, concat(CAST(p_size % 3 AS STRING), '.', CAST(p_size AS STRING), '.',
  CASE WHEN p_partkey % 10 = 0 THEN '01' ELSE CAST(p_partkey AS STRING) END,
  CASE WHEN p_partkey % 7 = 0 THEN '-beta.1' ELSE '' END) AS release FROM {part}"""


@query("p13_pick_layout", f"""
SELECT p_partkey, CASE WHEN regexp_full_match(release, '2\\.(0|[1-9][0-9]{{0,4}})\\.(0|[1-9][0-9]{{0,4}})') THEN 'v2'
  WHEN regexp_full_match(release, '1\\.(0|[1-9][0-9]{{0,4}})\\.(0|[1-9][0-9]{{0,4}})') THEN 'v1' END AS layout
FROM ({RELEASES})""".replace("{0,4}", "{0,4}"))
def _(t):
    return t.sql(RELEASES).select("p_partkey", R.pick_layout(F.col("release"))["layout"].alias("layout"))


@query("r17_parse_version", f"""
WITH v AS (SELECT CASE WHEN regexp_full_match(release, '[0-9]{{1,5}}\\.[0-9]{{1,5}}\\.[0-9]{{1,5}}(-[a-zA-Z0-9.-]{{1,40}})?') THEN release END AS version
  FROM ({RELEASES}))
SELECT version, row_number() OVER (ORDER BY CAST(split_part(split_part(version, '-', 1), '.', 1) AS INT),
  CAST(split_part(split_part(version, '-', 1), '.', 2) AS INT), CAST(split_part(split_part(version, '-', 1), '.', 3) AS INT), version) - 1 AS place
FROM (SELECT DISTINCT version FROM v WHERE version IS NOT NULL)""")
def _(t):
    from palaver.operators.ordered import row_position
    found = t.sql(RELEASES).select(R.parse_version(F.concat(F.lit("tool v"), "release")).alias("version"))
    found = found.filter("version IS NOT NULL").distinct()
    return row_position(found, [], [R.version_order(F.col("version")), "version"], "place")


@query("p16_size_guard", """
SELECT conv_id, turn, strlen(text) AS n_bytes, strlen(text) <= 600 AS fits FROM {conversations}""")
def _(t):
    return t.conversations.select("conv_id", "turn", T.utf8_bytes(F.col("text")).cast("bigint").alias("n_bytes"),
                                  V.within_size(F.col("text"), 600).alias("fits"))


@query("p17_session_list", f"""
SELECT session_id, coalesce(nullif(trim(regexp_replace(CASE WHEN conv_id % 6 = 0 THEN '  ' ELSE title END, '\\s+', ' ', 'g')), ''), 'Untitled session') AS label,
  row_number() OVER (ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, session_id) - 1 AS place
FROM ({SESSIONS})""")
def _(t):
    from palaver.operators.ordered import row_position
    rows = t.sql(SESSIONS).withColumn("title", F.when(F.col("conv_id") % 6 == 0, "  ").otherwise(F.col("title")))
    listed = row_position(rows, [], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), "session_id"], "place")
    return listed.select("session_id", T.session_label(F.col("title")).alias("label"), "place")


@query("a07_distinct_refs", f"""
WITH r AS (SELECT DISTINCT session_id, sha256(to_json({{'role': type, 'status': status}})) AS h,
  concat(type, ':', coalesce(status, '-')) AS ref FROM ({EVENTS}))
SELECT session_id, string_agg(ref, ',' ORDER BY h) AS refs FROM r GROUP BY session_id""".replace(
    "to_json({{'role': type, 'status': status}})",
    "concat('{\"role\":\"', type, '\"', CASE WHEN status IS NULL THEN '' ELSE concat(',\"status\":\"', status, '\"') END, '}')"))
def _(t):
    # A session is short here; on long ones the references stay rows (see merged_sources).
    refs_of = t.sql(EVENTS).select("session_id", F.col("type").alias("role"), "status").distinct()
    rows = refs_of.groupBy("session_id").agg(F.collect_list(F.struct("role", "status")).alias("r"))
    shown = F.transform(V.distinct_refs(F.concat("r", "r")), lambda x: F.concat(
        x["role"], F.lit(":"), F.coalesce(x["status"], F.lit("-"))))
    return rows.select("session_id", F.array_join(shown, ",").alias("refs"))


@query("r01_canonical_json", """
SELECT event_id, concat('{"k":', CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS STRING), ',"u":', CAST(user_id AS STRING), ',"z":["', event_type, '",null]}') AS canonical
FROM events""")
def _(t):
    text = F.concat(F.lit('{ "z" : [ "'), "event_type", F.lit('", null ], "u": '), F.col("user_id"), F.lit(', "k": '),
                    F.get_json_object("props", "$.k"), F.lit(" }"))
    return t.events.select("event_id", I.canonical_json(text).alias("canonical"))


@query("r02_content_hash", """
SELECT doc_id, concat('sha256:', sha256(text)) AS h, concat('sha256:', sha256(concat('["', lang, '","', source, '"]'))) AS pair
FROM documents""")
def _(t):
    return t.documents.select("doc_id", I.content_hash(F.col("text")).alias("h"),
                              I.content_hash(F.col("lang"), F.col("source")).alias("pair"))


@query("r03_stable_session_id", f"""
SELECT session_id, concat('ses_imp_', sha256(concat('["transcript-id-v1","transcripts","session","', session_id, '"]'))) AS target_id
FROM ({SESSIONS})""")
def _(t):
    return t.sql(SESSIONS).select("session_id", I.stable_session_id(F.col("session_id")).alias("target_id"))


@query("r04_stable_message_id", f"""
SELECT session_id, event_id, concat('msg_000000000000', format('{{:016x}}', ord), '_imp_',
  sha256(concat('["transcript-id-v1","transcripts","message","', session_id, '","', event_id, '"]'))) AS id FROM ({EVENTS})""".replace("{{:016x}}", "{:016x}"))
def _(t):
    return t.sql(EVENTS).select("session_id", "event_id", I.stable_message_id(
        F.col("session_id"), F.col("event_id"), F.col("ord")).alias("id"))


@query("r05_stable_part_id", f"""
SELECT session_id, event_id, concat('prt_', format('{{:016x}}', pos), '_imp_', substring(sha256(concat(
  '["transcript-id-v1","transcripts","part","', session_id, '","', event_id, '","', CAST(pos AS STRING), '"]')), 1, 24)) AS id
FROM ({EVENTS})""".replace("{{:016x}}", "{:016x}"))
def _(t):
    return t.sql(EVENTS).select("session_id", "event_id", I.stable_part_id(
        F.col("session_id"), F.col("event_id"), F.col("pos")).alias("id"))


@query("r06_file_uri_to_path", r"""
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', 'file://') AS plain, regexp_replace(url, '^https?://', 'file://') AS hosted FROM pages)
SELECT page_id,
  CASE WHEN NOT contains(plain, '?') AND NOT contains(plain, '#') AND NOT regexp_matches(plain, '(?i)%(2f|5c)')
       THEN regexp_replace(regexp_replace(url_decode(replace(substring(plain, 8), '+', '%2B')), '/+', '/', 'g'), '(.)/$', '\1') END AS posix,
  CASE WHEN NOT contains(hosted, '?') AND NOT contains(hosted, '#') AND NOT regexp_matches(hosted, '(?i)%(2f|5c)')
        AND regexp_matches(hosted, '^file://[^/]+/[^/]')
       THEN regexp_replace(replace(concat('//', lower(regexp_extract(hosted, '^file://([^/]*)', 1)), url_decode(regexp_extract(hosted, '^file://[^/]*(/.*)$', 1))), '/', '\'), '\\$', '') END AS unc
FROM u""")
def _(t):
    plain = F.regexp_replace("url", "^https?://[^/]+", "file://")
    hosted = F.regexp_replace("url", "^https?://", "file://")
    return t.pages.select("page_id", P.file_uri_to_path(plain, "darwin").alias("posix"),
                          P.file_uri_to_path(hosted, "win32").alias("unc"))


PATHS = r"""SELECT page_id, concat('/', lang_path, '//./x/../', lang_path, '/') AS path, concat('c:/', lang_path, '/./y') AS drive FROM (
  SELECT page_id, regexp_extract(url, '^https?://[^/]+/([A-Za-z]+)', 1) AS lang_path FROM {pages}) p"""


@query("r07_normalize_path", rf"""
SELECT page_id, CASE WHEN path IS NULL THEN NULL ELSE concat('/', lp, CASE WHEN lp = '' THEN '' ELSE '/' END, lp) END AS posix,
  concat('C:\', lp, CASE WHEN lp = '' THEN '' ELSE '\' END, 'y') AS windows, CAST(NULL AS STRING) AS relative
FROM (SELECT *, regexp_extract(drive, '^c:/([^/]*)/', 1) AS lp FROM ({PATHS}))""")
def _(t):
    fixed = t.pages.select("page_id", F.regexp_extract("url", "^https?://[^/]+/([A-Za-z]+)", 1).alias("lp")).select(
        "page_id", F.concat(F.lit("/"), "lp", F.lit("//./x/../"), "lp", F.lit("/")).alias("path"),
        F.concat(F.lit("c:/"), "lp", F.lit("/./y")).alias("drive"))
    return fixed.select("page_id", P.normalize_path(F.col("path"), "linux").alias("posix"),
                        P.normalize_path(F.col("drive"), "win32").alias("windows"),
                        P.normalize_path(F.concat(F.lit("a"), "path"), "linux").alias("relative"))


@query("r09_utf8_tail", r"""
WITH b AS (SELECT conv_id, turn, text, strlen(text) AS n FROM conversations),
c AS (SELECT conv_id, turn, text, n, unnest(generate_series(1, least(length(text), 64))) AS k FROM b),
s AS (SELECT conv_id, turn, n, k, right(text, k) AS tail FROM c),
m AS (SELECT conv_id, turn, n, max(CASE WHEN strlen(tail) <= 61 THEN k END) AS k FROM s GROUP BY ALL)
SELECT b.conv_id, b.turn, CAST(b.n AS BIGINT) AS n_bytes, right(b.text, m.k) AS tail FROM b LEFT JOIN m USING (conv_id, turn)""")
def _(t):
    return t.conversations.select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("n_bytes"),
                                  T.utf8_tail(F.col("text"), 61).alias("tail"))


# The same patterns in RE2 form; the tables hold assignments of the form key = "value".
_TOKENS = ("|".join((
    r"\b(gh[pousr]_[A-Za-z0-9_]{16,}|github_pat_[A-Za-z0-9_]{16,}|npm_[A-Za-z0-9]{20,})\b",
    r"\bsk-(proj-|ant-)?[A-Za-z0-9_-]{20,}\b", r"\bxox[baprs]-[A-Za-z0-9-]{12,}\b",
    r"\b(glpat-[A-Za-z0-9_-]{16,}|hf_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{30,})\b", r"\b(AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{8,}\b", "-----BEGIN ([A-Z0-9]+ )?PRIVATE KEY-----",
    r"(?i:\b[a-z][a-z0-9+.-]{1,20}://[^\s/@:]+:[^\s/@]+@)", r"(?i:\b(Bearer|Basic)\s+[A-Za-z0-9+/_.=-]{8,})",
    r"""(?i:[?&](X-Amz-Signature|X-Goog-Signature|sig)=[^&\s"''<>]+)""")))
_ASSIGNED = (r"""(?i)(^|[\s"''?&,{])([A-Za-z_][A-Za-z0-9_.-]*[_.-])?(api[_-]?key|access[_-]?key([_-]?id)?|secret([_-]?(access[_-]?)?key)?"""
             r"""|client[_-]?secret|access[_-]?token|refresh[_-]?token|auth[_-]?token|token|password|passwd|private[_-]?key"""
             r"""|authorization|cookie|set[_-]?cookie|credentials?)["'']?\s*[:=]\s*("[^"]+"|''[^'']+''|[^\s,;&}\]"'']+)""")
_SECRET_TEXTS = """SELECT 'd' AS kind, doc_id AS id, text AS body FROM {documents} UNION ALL SELECT 'p' AS kind, page_id AS id, html AS body FROM {pages}"""
_HIT = f"(regexp_matches(body, '{_TOKENS}') OR regexp_matches(body, '{_ASSIGNED}'))"
_CLEANED = (r"""regexp_replace(body, '(?i)((^|[\s"''?&,{])([A-Za-z_][A-Za-z0-9_.-]*[_.-])?(token|password|api[_-]?key|secret)["'']?\s*[:=]\s*)"""
            r"""("[^"]*"|''[^'']*''|[^\s,;&}\]"'']+)', '\1"[REDACTED_SECRET]"', 'g')""")


@query("r10_has_credentials", f"SELECT kind, id, {_HIT} AS hit FROM ({_SECRET_TEXTS})")
def _(t):
    return t.sql(_SECRET_TEXTS).select("kind", "id", C.has_credentials(F.col("body")).alias("hit"))


@query("r12_credential_guard", f"SELECT kind, bool_or({_HIT}) AS stopped, count(*) AS n FROM ({_SECRET_TEXTS}) GROUP BY kind")
def _(t):
    rows = t.sql(_SECRET_TEXTS)
    stopped = rows.groupBy("kind").agg(F.bool_or(C.has_credentials(F.col("body"))).alias("stopped"),
                                       F.count(F.lit(1)).alias("n"))
    return stopped


@query("r13_redact_text", f"""
SELECT kind, id, CAST(CASE WHEN {_HIT} THEN len(regexp_extract_all(body, '(?i)(?:^|[\\s"''?&,{{])(?:[A-Za-z_][A-Za-z0-9_.-]*[_.-])?(?:token|password|api[_-]?key|secret)["'']?\\s*[:=]\\s*(?:"[^"]*"|''[^'']*''|[^\\s,;&}}\\]"'']+)')) ELSE 0 END AS BIGINT) AS redacted_count,
  sha256(CASE WHEN {_HIT} THEN {_CLEANED} ELSE body END) AS body_hash FROM ({_SECRET_TEXTS})""")
def _(t):
    rows = payload.redact_columns(t.sql(_SECRET_TEXTS), ["body"])
    return rows.select("kind", "id", "redacted_count", F.sha2("body", 256).alias("body_hash"))


@query("r14_redact_or_mask", f"""
SELECT kind, id, sha256(CASE WHEN {_HIT} THEN '[REDACTED_SECRET]' ELSE body END) AS body_hash FROM ({_SECRET_TEXTS})""")
def _(t):
    return t.sql(_SECRET_TEXTS).select("kind", "id", F.sha2(C.redact_or_mask(F.col("body")), 256).alias("body_hash"))


CONTEXT = """SELECT event_id, event_type, concat(CASE WHEN event_id % 3 = 0 THEN '/home/u' ELSE 'v' END, CAST(event_id AS STRING)) AS value,
  CASE WHEN event_id % 2 = 0 THEN 'status' ELSE event_type END AS name FROM {events}"""


@query("r15_sanitize_context", f"""
SELECT event_id, CASE WHEN name = 'status' THEN concat('command=', CASE WHEN starts_with(value, '/home/') THEN '[REDACTED_PATH]' ELSE value END,
    ';status=', CASE WHEN starts_with(value, '/home/') THEN '[REDACTED_PATH]' ELSE value END)
  ELSE CASE WHEN name < 'command' THEN concat(name, '=[REDACTED];command=', CASE WHEN starts_with(value, '/home/') THEN '[REDACTED_PATH]' ELSE value END)
       ELSE concat('command=', CASE WHEN starts_with(value, '/home/') THEN '[REDACTED_PATH]' ELSE value END, ';', name, '=[REDACTED]') END END AS context
FROM ({CONTEXT})""")
def _(t):
    safe = T.sanitize_context(F.create_map(F.col("name"), F.col("value"), F.lit("command"), F.col("value")))
    return t.sql(CONTEXT).select("event_id", F.array_join(
        F.transform(safe, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("context"))


@query("r16_hash_identifiers", """
SELECT conv_id, turn, concat('sha256:', sha256(text)) AS text_sha256, length(text) AS text_chars, trim(text) <> '' AS non_empty,
  regexp_matches(text, '/Users/|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS leaks FROM conversations""".replace("\\\\", "\\"))
def _(t):
    e = T.value_evidence(F.col("text"))
    return t.conversations.select("conv_id", "turn", e["sha256"].alias("text_sha256"), e["chars"].alias("text_chars"),
                                  e["non_empty"].alias("non_empty"), T.leaks_private_values(F.col("text")).alias("leaks"))


@query("r19_payload_leaves", """
SELECT event_id, '$.k' AS path, CAST(json_extract(props, '$.k') AS STRING) AS value, CAST(1 AS BIGINT) AS depth FROM events
UNION ALL SELECT event_id, '$.t', event_type, 1 FROM events
UNION ALL SELECT event_id, '$.n#[0].u', CAST(user_id AS STRING), 4 FROM events
UNION ALL SELECT event_id, '$.n#[1]', event_type, 3 FROM events""")
def _(t):
    inner = F.to_json(F.array(F.to_json(F.struct(F.col("user_id").alias("u"))), F.to_json(F.array("event_type"))))
    # A string that holds JSON: [{"u": n}, "type"].
    text = F.concat(F.lit('[{"u":'), F.col("user_id"), F.lit('},"'), F.col("event_type"), F.lit('"]'))
    del inner
    rows = t.events.select("event_id", F.to_json(F.struct(
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), text.alias("n"), F.col("event_type").alias("t"))).alias("payload"))
    return payload.payload_leaves(rows, ["event_id"], "payload").select("event_id", "path", "value", "depth")


@query("t01_sort_sessions", f"""
SELECT session_id, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, session_id) - 1 AS place FROM ({SESSIONS})""")
def _(t):
    from palaver.operators.ordered import row_position
    rows = refs.sort_sessions(t.sql(SESSIONS))
    return row_position(rows, [], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), "session_id"], "place") \
        .select("session_id", "place")


@query("t02_sort_messages", f"""
SELECT session_id, event_id AS message_id, row_number() OVER (PARTITION BY session_id ORDER BY ord, created_at, event_id) - 1 AS place FROM ({EVENTS})""")
def _(t):
    from palaver.operators.ordered import row_position
    rows = refs.sort_messages(t.sql(EVENTS).withColumnRenamed("event_id", "message_id"))
    return row_position(rows, ["session_id"], ["ord", "created_at", "message_id"], "place").select(
        "session_id", "message_id", "place")


@query("t03_top_k_per_group", """
SELECT event_type, event_id, rank, total FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank,
  count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rank <= 12""")
def _(t):
    top = top_per_key(t.events, ["event_type"], [F.desc("value"), "event_id"], 12)
    totals = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    return top.join(totals, "event_type").select("event_type", "event_id", "rank", "total")


@query("t04_union_events", f"SELECT session_id, event_id, type, reply_to FROM ({EVENTS})")
def _(t):
    rows = t.sql(EVENTS)
    users = rows.filter("type = 'user'").select("session_id", "event_id")
    assistants = rows.filter("type = 'assistant'").select("session_id", "event_id", "reply_to")
    return refs.union_events(users, assistants)


@query("t05_union_diagnostics", """
SELECT DISTINCT sha256(concat(event_type, CAST(user_id AS STRING))) AS id, event_type AS code FROM events""")
def _(t):
    rows = t.events.select(F.sha2(F.concat("event_type", "user_id"), 256).alias("id"), F.col("event_type").alias("code"))
    return refs.union_diagnostics(rows, rows.limit(0), rows)


@query("t06_key_union", "SELECT l_orderkey AS k FROM lineitem UNION SELECT o_custkey FROM orders")
def _(t):
    return refs.key_union(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query("w05_order_blocks", f"""
WITH b AS (SELECT session_id, event_id AS message_id, ord % 3 AS block_index, 1 AS r, text, CAST(NULL AS STRING) AS call_id FROM ({BLOCKS}) x JOIN ({EVENTS}) e USING (session_id, event_id, text)
 UNION ALL SELECT session_id, event_id, ord % 2, 0, status, NULL FROM ({EVENTS}) WHERE type = 'assistant'
 UNION ALL SELECT session_id, event_id, ord % 4, 2, NULL, turn_id FROM ({EVENTS}) WHERE type = 'assistant')
SELECT session_id, message_id, CASE r WHEN 0 THEN 'reasoning' WHEN 1 THEN 'text' ELSE 'tool' END AS type,
  row_number() OVER (PARTITION BY session_id, message_id ORDER BY block_index, r, coalesce(call_id, '')) - 1 AS pos FROM b""")
def _(t):
    events, blocks = t.sql(EVENTS), t.sql(BLOCKS)
    base = events.filter("type = 'assistant'").withColumnRenamed("event_id", "message_id")
    kept = blocks.select("session_id", F.col("event_id").alias("message_id")).distinct()
    texts = base.join(kept, ["session_id", "message_id"], "left_semi").select(
        "session_id", "message_id", (F.col("ord") % 3).alias("block_index"), "text")
    reasoning = base.select("session_id", "message_id", (F.col("ord") % 2).alias("block_index"), F.col("status").alias("text"))
    tools = base.select("session_id", "message_id", (F.col("ord") % 4).alias("block_index"), F.col("turn_id").alias("call_id"))
    return order_blocks(texts, reasoning, tools).select("session_id", "message_id", "type", "pos")


@query("a01_dedup_quarantine", f"""
SELECT session_id, message_id, 'kept' AS outcome, min(sha256(text)) AS digest, count(*) AS n FROM ({READ_TWICE}) GROUP BY ALL HAVING count(DISTINCT text) = 1
UNION ALL SELECT session_id, message_id, 'conflict', NULL, count(*) FROM ({READ_TWICE}) GROUP BY session_id, message_id HAVING count(DISTINCT text) > 1""")
def _(t):
    from palaver.operators.dedup import dedup_quarantine, merged_sources
    rows = t.sql(READ_TWICE).withColumn("digest", F.sha2("text", 256))
    kept, conflicts = dedup_quarantine(rows, ["session_id", "message_id"], "digest", ["read_no"])
    n = merged_sources(rows, ["session_id", "message_id"], ["read_no"]).groupBy("session_id", "message_id").agg(
        F.count(F.lit(1)).alias("n"))
    good = kept.join(n, ["session_id", "message_id"]).select(
        "session_id", "message_id", F.lit("kept").alias("outcome"), "digest", "n")
    return good.unionByName(conflicts.select("session_id", "message_id", F.lit("conflict").alias("outcome"),
                                             F.lit(None).cast("string").alias("digest"), F.col("n_rows").alias("n")))
