"""Queries for sources, payloads, mapping and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.catalog.base import CATALOG, EVENTS, SESSIONS, feed, query
from palaver.catalog.joins import LINKED, OBSERVED
from palaver.functions.mime import is_plain_utf8, sniff_mime



@query("s01_read_messages", """
SELECT conv_id, turn, CASE WHEN turn % 8 < 7 THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_records, CASE WHEN turn % 8 = 7 THEN 'CONTAINER_INVALID' END AS code FROM conversations""")
def _(t):
    from palaver.sources.messages import unwrap
    pair = F.concat(F.lit("["), F.to_json(F.struct("role", "turn")), F.lit(","), F.to_json(F.struct("role")), F.lit("]"))
    shapes = ("{}", '{"messages":{}}', '{"items":{}}', '{"data":{"messages":{}}}', '{"data":{"items":{}}}',
              '{"data":{"data":{"messages":{}}}}', '{"data":{"data":{"items":{}}}}', '{"other":{}}')
    body = None
    for i, shape in enumerate(shapes):
        head, tail = shape.rsplit("{}", 1) if shape != "{}" else ("", "")
        text = F.concat(F.lit(head), pair, F.lit(tail))
        body = F.when(F.col("turn") % 8 == i, text) if body is None else body.when(F.col("turn") % 8 == i, text)
    records, issues = unwrap(t.conversations.select("conv_id", "turn", body.alias("response")), ["conv_id", "turn"], "response")
    counts = records.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_records")).withColumn("code", F.lit(None).cast("string"))
    return counts.unionByName(issues.select("conv_id", "turn", F.lit(0).cast("bigint").alias("n_records"), "code"))


@query("s02_session_records", """
WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS m, concat('customer-', CAST(c_custkey AS STRING)) AS id FROM customer)
SELECT k AS entry_index, CASE WHEN m < 2 THEN id END AS session_id, CASE m WHEN 0 THEN 1700000000000 + k WHEN 1 THEN (1700000000 + k) * 1000 END AS created_at,
  CASE WHEN m = 2 THEN 'SESSION_RECORD_INVALID' WHEN k % 10 = 0 THEN 'SESSION_TIMESTAMP_INVALID' END AS code FROM c""")
def _(t):
    from palaver.sources.sessions import parse_session_records
    k, ident = F.col("c_custkey"), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))
    bad = F.when(k % 10 == 0, "never").otherwise("2024-01-01T00:00:00Z")
    bad_s = F.when(k % 10 == 0, "never").otherwise("1700000000")
    modern = F.to_json(F.struct(ident.alias("chat_session_id"), F.col("c_name").alias("title"), (1700000000000 + k).alias("created_at"), bad.alias("updated_at")))
    local = F.to_json(F.struct(ident.alias("session_id"), F.col("c_name").alias("name"), (1700000000 + k).alias("created_at"), bad_s.alias("update_at")))
    clash = F.to_json(F.struct(ident.alias("session_id"), F.lit("another-session").alias("chat_session_id")))
    rec = F.when(k % 3 == 0, modern).when(k % 3 == 1, local).otherwise(clash)
    candidates, issues = parse_session_records(t.customer.select(k.alias("entry_index"), F.try_parse_json(rec).alias("rec")))
    return candidates.select("entry_index", "session_id", "created_at").join(issues.select("entry_index", "code"), "entry_index", "full")


@query("s04_read_kv_sessions", """
SELECT concat('w', CAST(c_custkey AS STRING)) AS workspace_id, concat('customer-', CAST(c_custkey AS STRING)) AS session_id, 0 AS priority, NULL AS created_at, false AS has_error FROM customer
UNION ALL SELECT concat('w', CAST(c_custkey AS STRING)), concat('indexed-', CAST(c_custkey AS STRING)), 1, 1700000000000 + c_custkey, c_custkey % 4 = 0 FROM customer WHERE c_custkey % 6 <> 5""")
def _(t):
    from palaver.sources.sessions import ACTIVE_SESSION_KEY, SESSION_INDEX_KEY, read_kv_sessions
    k = F.col("c_custkey")
    name = F.concat(F.lit("indexed-"), k.cast("string"))
    entry = F.to_json(F.struct(F.when(k % 4 == 0, "other-session").otherwise(name).alias("sessionId"), F.col("c_name").alias("title"), F.struct(
        (1700000000000 + k).alias("startTime"), (1700000000000 + k + 5).alias("endTime")).alias("timing")))
    index = F.concat(F.lit('{"version":'), F.when(k % 6 == 5, "2").otherwise("1"), F.lit(',"entries":{"'), name, F.lit('":'), entry, F.lit("}}"))
    place = F.concat(F.lit("w"), k.cast("string")).alias("workspace_id")
    kv = t.customer.select(place, F.lit(ACTIVE_SESSION_KEY).alias("key"), F.concat(F.lit("customer-"), k.cast("string")).alias("value")).unionByName(
        t.customer.select(place, F.lit(SESSION_INDEX_KEY).alias("key"), index.alias("value")))
    return read_kv_sessions(kv)[0].select("workspace_id", "session_id", "priority", "created_at", "has_error")


@query("s05_read_input_history", """
SELECT concat('w', CAST(event_id AS STRING)) AS workspace_id, event_type AS input_text, CAST(event_id % 3 AS BIGINT) AS n_files, NULL AS code FROM events WHERE event_id % 7 <> 6
UNION ALL SELECT concat('w', CAST(event_id AS STRING)), NULL, NULL, 'HISTORY_ENTRY_INVALID' FROM events WHERE event_id % 7 = 6""")
def _(t):
    from palaver.sources.history import read_input_history
    e = F.col("event_id")
    file = '{"id":"f","name":"n","size":3,"type":"text/plain","resourceUri":"u","kind":"file"}'
    files = F.when(e % 3 == 0, "[]").when(e % 3 == 1, f"[{file}]").otherwise(f"[{file},{file}]")
    media = F.when(e % 7 == 6, '[{"resource_id":""}]').otherwise("[]")
    value = F.concat(F.lit('[{"inputText":"'), "event_type", F.lit('","parsedQuery":["q"],"multiMedia":'), media, F.lit(',"files":'), files, F.lit("}]"))
    kv = t.events.select(F.concat(F.lit("w"), e.cast("string")).alias("workspace_id"), F.lit("x-agent-storage-input-history").alias("key"), value.alias("value"))
    entries, issues = read_input_history(kv)
    return entries.select("workspace_id", "input_text", F.size("files").cast("bigint").alias("n_files"), F.lit(None).cast("string").alias("code")).unionByName(
        issues.select("workspace_id", F.lit(None).cast("string").alias("input_text"), F.lit(None).cast("bigint").alias("n_files"), "code"))


@query("s06_file_inventory", """
SELECT concat(lang, '/', source, '/', CAST(doc_id AS STRING), '.TXT') AS path, strlen(text) AS size_bytes, concat('sha256:', sha256(text)) AS sha256, 'text/plain' AS mime, true AS valid_utf8, '.txt' AS ext,
  len(string_split(concat(lang, '/', source, '/', CAST(doc_id AS STRING)), '/')) AS depth, sha256(concat(lang, '/', source, '/', CAST(doc_id AS STRING), '.TXT')) AS path_hash FROM documents""")
def _(t):
    from palaver.sources.files import inventory
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    found = inventory(t.documents.select(path.alias("path"), F.octet_length("text").alias("size_bytes"), F.encode("text", "UTF-8").alias("content")))
    return found.withColumn("depth", F.col("depth").cast("bigint"))


@query("r08_sniff_mime", """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM documents""")
def _(t):
    heads = ("89504E470D0A1A0A", "FFD8FF", "474946383961", "524946460000000057454250", "255044462D", "", "00FE")
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 7 + 1).cast("int")))
    content = F.concat(head, F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", content.alias("c")).select("doc_id", sniff_mime(F.col("c"), is_plain_utf8(F.col("c"))).alias("mime"))


@query("s08_workspace_projects", """
WITH p AS (SELECT page_id, page_id % 5 AS m, concat('w', CAST(page_id AS STRING)) AS w FROM pages)
SELECT w AS workspace_id, concat('/home/p', CAST(page_id AS STRING)) AS path, 'folder-uri' AS source, NULL AS code FROM p WHERE m = 0
UNION ALL SELECT w, concat('/ws/', CAST(page_id AS STRING), '/app'), 'workspace-folder-path', NULL FROM p WHERE m = 1
UNION ALL SELECT w, '/abs/lib', 'workspace-folder-uri', NULL FROM p WHERE m = 1
UNION ALL SELECT w, NULL, NULL, 'WORKSPACE_CONFIG_INVALID' FROM p WHERE m = 1
UNION ALL SELECT w, NULL, NULL, 'WORKSPACE_URI_UNSUPPORTED' FROM p WHERE m = 2
UNION ALL SELECT w, NULL, NULL, 'WORKSPACE_METADATA_INVALID' FROM p WHERE m = 3
UNION ALL SELECT w, NULL, NULL, 'WORKSPACE_CONFIG_NOT_FOUND' FROM p WHERE m = 4""")
def _(t):
    from palaver.sources.workspaces import read_workspace_projects
    k = F.col("page_id").cast("string")
    m = F.col("page_id") % 5
    text = (F.when(m == 0, F.concat(F.lit('{ // one folder\n "folder": "file:///home/p'), k, F.lit('", }')))
            .when(m == 1, F.concat(F.lit('{"workspace":"file:///ws/'), k, F.lit('/a.code-workspace"}')))
            .when(m == 2, F.concat(F.lit('{"folder":"ssh://host/'), k, F.lit('"}')))
            .when(m == 3, F.lit('{"folder":"file:///a","workspace":"file:///b"}'))
            .otherwise(F.concat(F.lit('{"workspace":"file:///none/'), k, F.lit('.code-workspace"}'))))
    metadata = t.pages.select(F.concat(F.lit("w"), k).alias("workspace_id"), text.alias("text"))
    # The same folder twice, an absolute URI, and an entry with both members.
    config = '{"folders": [{"path": "app"}, /* again */ {"path": "./x/../app"}, {"uri": "file:///abs/lib"}, {"path": "a", "uri": "b"},],}'
    configs = t.pages.select(F.concat(F.lit("/ws/"), k, F.lit("/a.code-workspace")).alias("path"), F.lit(config).alias("text"))
    projects, issues = read_workspace_projects(metadata, configs, "darwin")
    none = F.lit(None).cast("string")
    return projects.select("workspace_id", "path", "source", none.alias("code")).unionByName(
        issues.select("workspace_id", none.alias("path"), none.alias("source"), "code"))


@query("s09_read_bundle_tables", """
SELECT 'sessions' AS name, count(*) AS n FROM conversations UNION ALL SELECT 'events', count(*) FROM conversations
UNION ALL SELECT 'blocks', count(*) FROM conversations UNION ALL SELECT 'broken rules', count(*) FROM conversations WHERE turn = 0""")
def _(t):
    from palaver.sources.bundle import BUNDLE, check_bundle, explode_bundle
    # Every turn as one nested bundle with one session; a first turn has an empty tool name.
    block = F.struct(F.lit("tool").alias("type"), F.lit("c").alias("callId"), F.when(F.col("turn") == 0, "").otherwise("n").alias("name"),
                     F.struct(F.col("turn").alias("x")).alias("input"), F.lit("completed").alias("status"), F.array().cast("array<string>").alias("sourceRefs"))
    event = F.struct(F.lit("assistant").alias("type"), F.lit("e").alias("sourceId"), F.col("turn").alias("order"), F.lit("completed").alias("status"),
                     F.array(block).alias("content"), F.array().cast("array<string>").alias("sourceRefs"))
    session = F.struct(F.concat_ws("-", F.lit("session"), "conv_id", "turn").alias("sourceId"), F.lit("partial").alias("recovery"), F.array(event).alias("events"),
                       F.array().cast("array<string>").alias("resources"), F.array().cast("array<string>").alias("sourceRefs"))
    text = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.array(session).alias("sessions"), F.array().cast("array<string>").alias("projects"),
                              F.array().cast("array<string>").alias("diagnostics")))
    nested = t.conversations.select(F.from_json(text, BUNDLE).alias("b")).select("b.*")
    tables = explode_bundle(nested)
    tables["broken rules"] = check_bundle(tables)
    counts = None
    for name in ("sessions", "events", "blocks", "broken rules"):
        one = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("s10_write_bundle", f"""
SELECT 'sessions' AS name, count(*) AS n FROM ({SESSIONS}) UNION ALL SELECT 'events', count(*) FROM ({EVENTS})""")
def _(t):
    import uuid

    from palaver.session import checkpoint_dir
    from palaver.sources.bundle import write_bundle
    out = f"{checkpoint_dir(t.spark).rstrip('/')}/palaver-bundle-{uuid.uuid4().hex}"
    tables = {"sessions": t.sql(SESSIONS), "events": t.sql(EVENTS)}
    # Texts of the tables hold no credentials that would stop the write; the check runs over them all.
    write_bundle(tables, out)
    counts = [t.spark.read.parquet(f"{out}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name in tables]
    return counts[0].unionByName(counts[1])


@query("r11_has_credentials_nested", """
SELECT event_id, event_id % 4 <> 3 AS hit FROM events""")
def _(t):
    from palaver.operators.payload import has_credentials_nested
    e = F.col("event_id")
    secret = F.concat(F.lit("value-"), e.cast("string"))
    inner = F.to_json(F.struct(F.to_json(F.struct(secret.alias("password"))).alias("body")))
    payload = (F.when(e % 4 == 0, F.to_json(F.struct(F.struct(secret.alias("apiKey")).alias("config"))))
               .when(e % 4 == 1, F.to_json(F.struct(F.array(inner).alias("output"))))
               .when(e % 4 == 2, F.to_json(F.struct(F.concat(F.lit("https://h.test/?%74oken="), secret).alias("url"))))
               .otherwise(F.to_json(F.struct(F.lit("${MY_VAR}").alias("password"), F.col("event_type").alias("note")))))
    return has_credentials_nested(t.events.select("event_id", payload.alias("payload")), ["event_id"], "payload").select("event_id", "hit")


@query("r13_redact_payloads", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"config":{"apiKey":"[REDACTED_SECRET]"},"note":"x"}' WHEN 1 THEN '{"output":["{\\"body\\":\\"{\\\\\\"password\\\\\\":\\\\\\"[REDACTED_SECRET]\\\\\\"}\\"}"]}'
  ELSE concat('{"note":"', event_type, '"}') END AS payload, CAST(CASE WHEN event_id % 3 < 2 THEN 1 ELSE 0 END AS BIGINT) AS redacted_count FROM events""")
def _(t):
    from palaver.operators.payload import redact_payloads
    e = F.col("event_id")
    secret = F.concat(F.lit("value-"), e.cast("string"))
    inner = F.to_json(F.struct(F.to_json(F.struct(secret.alias("password"))).alias("body")))
    payload = (F.when(e % 3 == 0, F.to_json(F.struct(F.struct(secret.alias("apiKey")).alias("config"), F.lit("x").alias("note"))))
               .when(e % 3 == 1, F.to_json(F.struct(F.array(inner).alias("output"))))
               .otherwise(F.to_json(F.struct(F.col("event_type").alias("note")))))
    return redact_payloads(t.events.select("event_id", payload.alias("payload")), ["event_id"], "payload")


@query("r18_resource_paths", """
SELECT event_id, 'a[0].filePath' AS locator, concat('paste-files/', event_type) AS value FROM events UNION ALL SELECT event_id, 'b.relatePath', 'x/long-text/1' FROM events WHERE event_id % 2 = 0""")
def _(t):
    from palaver.operators.payload import resource_paths
    e = F.col("event_id")
    text = F.concat(F.lit('{"a":[{"filePath":"paste-files/'), "event_type", F.lit('"}],"b":{"relatePath":"'), F.when(e % 2 == 0, "x/long-text/1").otherwise("plain"),
                    F.lit('"},"filePath":7}'))
    return resource_paths(t.events.select("event_id", text.alias("payload")), ["event_id"], "payload")


@query("j07_map_paths", r"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/repo/a' WHEN 1 THEN '/repo/sub/b' WHEN 2 THEN '/repo-old' ELSE '/gone' END AS base, concat('/n', CAST(page_id AS STRING)) AS leaf FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('/new/a', leaf) WHEN 1 THEN concat('/deep/b', leaf) WHEN 2 THEN concat('/repo-old', leaf) ELSE '/tmp/fallback' END AS target_directory,
  CASE page_id % 4 WHEN 0 THEN 'mapped' WHEN 1 THEN 'mapped' WHEN 2 THEN 'preserved' ELSE 'fallback' END AS strategy, true AS writable FROM p""")
def _(t):
    from palaver.operators.directories import map_paths
    m, leaf = F.col("page_id") % 4, F.concat(F.lit("/n"), F.col("page_id").cast("string"))
    at = lambda a, b, c, d: F.concat(F.when(m == 0, a).when(m == 1, b).when(m == 2, c).otherwise(d), leaf)
    rows = t.pages.select("page_id", at("/repo/a", "/repo/sub/b", "/repo-old", "/gone").alias("path"))
    maps = t.spark.createDataFrame([("/repo", "/new"), ("/repo/sub/", "/deep")], "from string, to string")
    held = t.pages.filter(m < 3).select(at("/new/a", "/deep/b", "/repo-old", "/").alias("directory")).unionByName(
        t.pages.select(F.lit("/tmp/fallback").alias("directory")).distinct())
    return map_paths(rows, maps, held, fallback="/tmp/fallback").select("page_id", "target_directory", "strategy", "writable")


@query("p10_project_shell_tool", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'shell' ELSE 'read' END AS name,
  CASE WHEN event_id % 2 = 0 THEN concat('{"command":"ls ', event_type, '","cwd":"/"}') ELSE concat('{"cmd":"ls ', event_type, '","cwd":"/"}') END AS input,
  CASE WHEN event_id % 2 = 0 THEN concat('"', event_type, '"') ELSE concat('{"code":0,"output":"', event_type, '","stdout":"', event_type, '"}') END AS output,
  CASE WHEN event_id % 2 = 0 THEN '{"code":0}' END AS remainder FROM events""")
def _(t):
    from palaver.functions import variant as V
    from palaver.operators.mapping import project_shell_tool
    given = F.to_json(F.struct(F.concat(F.lit("ls "), "event_type").alias("cmd"), F.lit("/").alias("cwd")))
    result = F.to_json(F.struct(F.lit(0).alias("code"), F.col("event_type").alias("output"), F.col("event_type").alias("stdout")))
    name = F.when(F.col("event_id") % 2 == 0, "exec_command").otherwise("read")
    rows = t.events.select("event_id", name.alias("n"), given.alias("i"), result.alias("o"))
    p = rows.select("event_id", project_shell_tool(F.col("n"), F.col("i"), F.col("o")).alias("p"))
    rest = F.to_json(V.field(F.try_parse_json(F.col("p.details")), "$.sourceOutputRemainder"))
    return p.select("event_id", "p.name", "p.input", "p.output", rest.alias("remainder"))


def mapping_tables(t):
    """Bundle tables of the conversations, every row with a verified reference."""
    ref = F.struct(F.lit(None).cast("string").alias("workspace_id"), F.col("session_id"), F.struct(
        F.lit("runtime-field").alias("type"), F.lit("runtime:getMessages#message").alias("value")).alias("locator"),
        F.struct(F.lit("runtime-v1").alias("id"), F.lit(1).alias("version")).alias("profile"), F.lit("h").alias("sha256"))
    refs = lambda df: df.withColumn("refs", F.array(ref))
    none = lambda kind: F.lit(None).cast(kind)
    recovery = F.when(F.col("conv_id") % 3 == 0, "partial").when(F.col("conv_id") % 10 == 4, "metadata-only").otherwise("complete")
    sessions = refs(t.sql(SESSIONS)).select(
        "session_id", "title", none("string").alias("project_id"), none("string").alias("project_path"), "parent_id", "created_at", "updated_at",
        recovery.alias("recovery"), "refs")
    events = refs(t.sql(EVENTS)).drop("conv_id")
    assistants = refs(t.sql(EVENTS)).filter("type = 'assistant'")
    size = F.length("text")
    base = assistants.select("session_id", "event_id", "text", "created_at", "completed_at", "refs", size.alias("_n"))
    texts = base.select("session_id", "event_id", F.lit(0).cast("bigint").alias("pos"), F.lit("text").alias("type"), "text", none("string").alias("call_id"),
                        none("string").alias("name"), none("string").alias("input"), none("string").alias("output"), none("string").alias("error"),
                        none("string").alias("status"), none("bigint").alias("created_at"), none("bigint").alias("completed_at"), "refs")
    state = F.element_at(F.array(*[F.lit(x) for x in ("completed", "error", "running", "unknown")]), (F.col("_n") % 4 + 1).cast("int"))
    tools = base.select("session_id", "event_id", F.lit(1).cast("bigint").alias("pos"), F.lit("tool").alias("type"), none("string").alias("text"), F.lit("c").alias("call_id"),
                        F.lit("read").alias("name"), F.lit('{"path":"a"}').alias("input"), F.when(F.col("_n") % 3 > 0, F.lit('{"x":1}')).alias("output"),
                        F.when(F.col("_n") % 20 == 0, F.lit('"bad"')).alias("error"), state.alias("status"),
                        F.when(F.col("_n") % 29 > 0, F.col("created_at")).alias("created_at"), "completed_at", "refs")
    known = t.sql(SESSIONS).select("session_id", "conv_id", F.concat(F.lit("r"), F.floor(F.col("conv_id") / 40).cast("string")).alias("resource_id"))
    resources = known.select("session_id", "resource_id", F.lit("available").alias("availability"))  # forty sessions share one
    eighth = F.col("conv_id") % 8
    code = F.when(eighth == 5, "EXPORT_DAMAGED").when(eighth == 6, "USER_TEXT_MISSING").when(eighth == 7, "EXPORT_LATE")
    about = known.filter(eighth >= 5).select(
        F.concat(F.lit("d"), "session_id").alias("id"), code.alias("code"), F.when(eighth == 7, "warning").otherwise("error").alias("severity"),
        F.lit("session").alias("subject_type"), F.col("session_id").alias("subject_id"), F.array("session_id").alias("ref_sessions"), none("string").alias("message_id"))
    shared = known.filter("resource_id = 'r2'").select("resource_id").distinct().select(
        F.lit("shared").alias("id"), F.lit("RESOURCE_DAMAGED").alias("code"), F.lit("error").alias("severity"), F.lit("resource").alias("subject_type"),
        F.col("resource_id").alias("subject_id"), F.array().cast("array<string>").alias("ref_sessions"), none("string").alias("message_id"))
    diagnostics = about.unionByName(shared)
    return {"sessions": sessions, "events": events, "blocks": texts.unionByName(tools), "resources": resources, "diagnostics": diagnostics}


_MAPPED = f"""e AS ({EVENTS}), s AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'partial' WHEN conv_id % 10 = 4 THEN 'metadata-only' ELSE 'complete' END AS recovery FROM ({SESSIONS})),
b AS (SELECT e.session_id, e.event_id, s.recovery, length(text) AS n, ['completed', 'error', 'running', 'unknown'][length(text) % 4 + 1] AS status FROM e JOIN s USING (session_id) WHERE type = 'assistant'),
bad AS (SELECT DISTINCT session_id FROM b WHERE (n % 29 = 0 AND recovery <> 'partial') OR (n % 29 > 0 AND status = 'completed' AND n % 20 = 0)
  UNION SELECT e.session_id FROM e WHERE type = 'assistant' AND (status <> 'completed' OR completed_at IS NULL)
  UNION SELECT session_id FROM s WHERE conv_id % 8 = 5 OR (conv_id % 8 = 6 AND recovery <> 'partial') OR floor(conv_id / 40) = 2
  UNION SELECT session_id FROM s WHERE recovery = 'metadata-only' OR updated_at IS NULL OR NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = s.session_id))"""


@query("p09_map_blocks_v2", f"""
WITH {_MAPPED}
SELECT session_id, event_id, n % 29 = 0 AS deferred, CASE WHEN n % 29 = 0 AND recovery <> 'partial' THEN 'createdAt' WHEN n % 29 > 0 AND status = 'completed' AND n % 20 = 0 THEN 'error' END AS reject,
  CASE WHEN n % 29 = 0 OR (status = 'completed' AND n % 20 = 0) THEN NULL WHEN status = 'unknown' THEN 'running' ELSE status END AS state,
  CASE WHEN n % 29 = 0 OR (status = 'completed' AND n % 20 = 0) THEN NULL WHEN status = 'completed' THEN CASE WHEN n % 3 > 0 THEN '{{"x":1}}' ELSE '[tool completed without persisted output]' END
   WHEN status = 'error' AND n % 3 > 0 THEN '{{"x":1}}' END AS shown FROM b""")
def _(t):
    from palaver.functions import variant as V
    from palaver.functions.values import verified_refs_only
    from palaver.operators.mapping import map_blocks_v2
    tables = mapping_tables(t)
    where = tables["events"].select("session_id", "event_id", F.col("pos").alias("event_pos")).join(tables["sessions"].select("session_id", "recovery"), "session_id")
    tools = tables["blocks"].filter("type = 'tool'").withColumn("verified", verified_refs_only(F.col("refs"), F.col("session_id"), "runtime-v1", 1))
    out = map_blocks_v2(tools.join(where, ["session_id", "event_id"]))
    body = F.try_parse_json("body")
    return out.select("session_id", "event_id", "deferred", F.regexp_extract("reject", r"\]\.([A-Za-z/]+)$", 1).alias("reject"), V.text(V.field(body, "$.state.status")).alias("state"),
                      V.text(V.field(body, "$.state.content[0].text")).alias("shown"))


@query("p11_map_sessions_v2", f"""
WITH {_MAPPED}, k AS (SELECT session_id, count(*) AS messages FROM e GROUP BY 1), n AS (SELECT session_id, count(*) AS texts, count(*) FILTER (WHERE n % 29 > 0) AS tools FROM b GROUP BY 1)
SELECT s.session_id, bad.session_id IS NULL AS mapped, CASE WHEN bad.session_id IS NULL THEN messages ELSE 0 END AS messages, CASE WHEN bad.session_id IS NULL THEN coalesce(texts, 0) + coalesce(tools, 0) ELSE 0 END AS blocks
FROM s LEFT JOIN bad USING (session_id) LEFT JOIN k USING (session_id) LEFT JOIN n USING (session_id)""")
def _(t):
    from palaver.operators.mapping import map_sessions_v2
    tables = mapping_tables(t)
    m = map_sessions_v2(tables, "transcripts")
    messages = m.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    blocks = m.blocks.groupBy("session_id").agg(F.count(F.lit(1)).alias("blocks"))
    ok = m.sessions.select("session_id", F.lit(True).alias("mapped"))
    return tables["sessions"].select("session_id").join(ok, "session_id", "left").join(messages, "session_id", "left").join(blocks, "session_id", "left").select(
        "session_id", F.coalesce("mapped", F.lit(False)).alias("mapped"), F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query("p12_map_sessions_v1", f"""
WITH {_MAPPED}, l AS ({LINKED}), worse AS (SELECT session_id FROM bad UNION SELECT session_id FROM l WHERE NOT reply_ok),
k AS (SELECT session_id, count(*) AS messages, count(*) FILTER (WHERE type = 'user') AS users FROM e GROUP BY 1), n AS (SELECT session_id, count(*) AS texts, count(*) FILTER (WHERE n % 29 > 0) AS tools FROM b GROUP BY 1)
SELECT s.session_id, messages, users + coalesce(texts, 0) + coalesce(tools, 0) AS parts FROM s JOIN k USING (session_id) LEFT JOIN n USING (session_id) WHERE s.session_id NOT IN (SELECT session_id FROM worse)""")
def _(t):
    from palaver.operators.layout1 import map_sessions_v1
    from palaver.operators.mapping import map_sessions_v2
    m = map_sessions_v1(map_sessions_v2(mapping_tables(t), "transcripts"), "1.18.32", "transcripts")
    parts = m.parts.groupBy("session_id").agg(F.count(F.lit(1)).alias("parts"))
    return m.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages")).join(parts, "session_id")


def _replay(t, name: str, build):
    """Run a stream over the events, in four micro-batches out of order, until it is drained; return what it wrote."""
    import uuid

    from palaver.session import checkpoint_dir
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/palaver-stream-{name}-{uuid.uuid4().hex}"
    events = t.events
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
    stream = feed((events.filter(part == i) for i in range(4)), f"{base}/in", lambda s: (
        build(s).writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").outputMode("update")
        .trigger(availableNow=True).start()))
    return t.spark.read.schema(build(stream).schema).parquet(f"{base}/out")


@query("st01_stream_dedup", """
SELECT CAST(user_id AS STRING) AS key, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1""")
def _(t):
    from palaver.streaming.dedup import stream_dedup_quarantine
    log = _replay(t, "dedup", lambda s: stream_dedup_quarantine(s, "user_id", "event_type", "ts"))
    return log.groupBy("key").agg(F.max_by("conflict", "n").alias("conflict"))


@query("st02_stream_tool_state", CATALOG["a03_merge_tool_observations"].sql)
def _(t):
    from palaver.streaming.tools import stream_tool_state
    log = _replay(t, "tools", lambda s: stream_tool_state(t.spark.sql(OBSERVED, events=s)))
    names = ["entry_index", "generated_at", "started_at", "completed_at"]
    last = log.groupBy("session_id", "call_id").agg(F.max_by(F.struct("n_observations", "code", "status", *names), "n_observations").alias("r"))
    return last.select("session_id", "call_id", "r.n_observations", F.when(F.col("r.code").isNull(), F.col("r.status")).otherwise("conflict").alias("outcome"),
                       *[F.col(f"r.{c}").alias(c) for c in names])


@query("u01_sql_functions", """
SELECT doc_id, concat('sha256:', sha256(text)) AS h, concat('ses_imp_', sha256(concat('["transcript-id-v1","ns","session","', CAST(doc_id AS STRING), '"]'))) AS target_id, strlen(text) AS n_bytes FROM documents""")
def _(t):
    from palaver.functions.register import register_functions
    register_functions(t.spark, "tx_")
    return t.sql("""SELECT doc_id, tx_content_hash(text) AS h, tx_stable_session_id('ns', CAST(doc_id AS STRING)) AS target_id,
        CAST(tx_utf8_bytes(text) AS BIGINT) AS n_bytes FROM {documents}""")
