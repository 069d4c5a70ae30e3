"""Queries for the joins, the merges and the evidence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.catalog.base import BLOCKS, EVENTS, READ_TWICE, SESSIONS, TOOL_OBS, query
from palaver.operators import dedup, evidence, merge, refs
from palaver.operators.directories import longest_prefix
from palaver.operators.reconcile import reconcile, transfer_counts
from palaver.operators.resources import resolve_file_refs

LINKED = f"""SELECT a.session_id, a.event_id, coalesce(u.type = 'user' AND u.ord < a.ord, false) AS reply_ok
FROM ({EVENTS}) a LEFT JOIN ({EVENTS}) u ON u.session_id = a.session_id AND u.event_id = a.reply_to WHERE a.type = 'assistant'"""


@query("j01_link_replies", LINKED)
def _(t):
    return refs.link_replies(t.sql(EVENTS)).select("session_id", "event_id", "reply_ok")


@query("j02_missing_refs", """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def _(t):
    paying = t.customer.filter("c_acctbal > 0")
    return refs.missing_refs(t.orders, paying, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


READS = """SELECT o_custkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'error' ELSE 'unavailable' END AS status,
  length(o_orderstatus) + 4 AS expected, o_orderstatus AS digest FROM {orders}"""


@query("j03_join_reads", f"""
WITH r AS (SELECT session_id, count(DISTINCT digest) AS k, min(digest) AS d, min_by(status, digest) AS status, min(expected) AS expected FROM ({READS}) GROUP BY 1)
SELECT coalesce(c.c_custkey, r.session_id) AS session_id, c.c_custkey IS NOT NULL AS has_metadata, coalesce(r.status, 'unavailable') AS read_status,
  CASE WHEN r.status = 'available' THEN CAST(r.expected AS BIGINT) END AS expected, coalesce(r.k > 1, false) AS contradicts
FROM customer c FULL JOIN r ON r.session_id = c.c_custkey""")
def _(t):
    metadata = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("digest"))
    joined, wrong = refs.join_reads(metadata, t.sql(READS))
    marks = wrong.filter("kind = 'read'").select("session_id", F.lit(True).alias("contradicts"))
    return joined.join(marks, "session_id", "left").select(
        "session_id", "has_metadata", "read_status", F.col("expected").cast("bigint").alias("expected"),
        F.coalesce("contradicts", F.lit(False)).alias("contradicts"))


@query("j04_resolve_project", """
SELECT l_orderkey AS session_id, CASE WHEN min(s_nationkey) = max(s_nationkey) THEN min(s_nationkey) END AS project_id
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def _(t):
    pairs = t.lineitem.select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("workspace_id"))
    projects = t.supplier.select(F.col("s_suppkey").alias("workspace_id"), F.col("s_nationkey").alias("project_id"))
    return refs.resolve_project(pairs, projects)


@query("j05_associate_resources", """
WITH k AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_totalprice > 490000 GROUP BY 1)
SELECT p_partkey AS resource_id, coalesce(n, 0) AS n_sessions, CASE WHEN n IS NULL THEN 'RESOURCE_UNASSOCIATED' END AS code FROM part LEFT JOIN k ON l_partkey = p_partkey""")
def _(t):
    resources = t.part.select(F.col("p_partkey").alias("resource_id"))
    links = t.lineitem.select(F.col("l_partkey").alias("resource_id"), F.col("l_orderkey").alias("session_id"))
    known = t.orders.filter("o_totalprice > 490000").select(F.col("o_orderkey").alias("session_id"))
    linked, rest = refs.associate_resources(resources, links, known)
    counted = linked.groupBy("resource_id").agg(F.count(F.lit(1)).alias("n_sessions")).withColumn(
        "code", F.lit(None).cast("string"))
    return counted.unionByName(rest.select("resource_id", F.lit(0).cast("bigint").alias("n_sessions"), "code"))


FILE_REFS = """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS ref_id, concat('w', CAST(l_suppkey AS STRING)) AS workspace_id,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('paste-files/', CAST(l_partkey AS STRING)) END AS relative_path,
  CASE WHEN l_linestatus = 'O' THEN concat('/paste-files/', CAST(l_partkey AS STRING)) ELSE concat('remote-', CAST(l_partkey AS STRING)) END AS path,
  false AS explicit, 'text/plain' AS mime, CAST(l_quantity AS BIGINT) AS size FROM {lineitem}"""
HELD = """SELECT concat('w', CAST(l_suppkey AS STRING)) AS workspace_id,
  concat('paste-files/', CAST(l_partkey AS STRING), CASE WHEN l_partkey % 17 = 0 THEN '/part' ELSE '' END) AS relative_path,
  max(CAST(l_quantity AS BIGINT)) AS size_bytes, CASE WHEN l_partkey % 13 = 0 THEN 'application/octet-stream' ELSE 'text/plain' END AS mime,
  min(l_tax) < 0.07 AS readable FROM {lineitem} WHERE l_discount > 0.02 GROUP BY l_suppkey, l_partkey"""


@query("j06_resolve_file_refs", f"""
WITH h AS (SELECT workspace_id, regexp_extract(relative_path, '^paste-files/[^/]+', 0) AS relative_path, size_bytes, mime,
  relative_path LIKE '%/part' AS folder, readable AND relative_path NOT LIKE '%/part' AS readable FROM ({HELD}) x),
j AS (SELECT r.*, h.size_bytes, h.mime AS held_mime, h.readable FROM ({FILE_REFS}) r LEFT JOIN h USING (workspace_id, relative_path)),
a AS (SELECT *, CASE WHEN relative_path IS NULL AND starts_with(path, '/') THEN NULL WHEN relative_path IS NULL THEN 'deferred'
   WHEN readable THEN 'available' WHEN readable IS NULL THEN 'missing' ELSE 'deferred' END AS availability FROM j),
c AS (SELECT *, CASE WHEN availability IS NULL THEN 'RESOURCE_REFERENCE_INVALID' WHEN availability = 'deferred' THEN 'RESOURCE_DEFERRED'
   WHEN availability = 'missing' THEN 'RESOURCE_MISSING' WHEN size <> size_bytes OR mime <> held_mime THEN 'RESOURCE_METADATA_MISMATCH' END AS code FROM a),
f AS (SELECT *, CASE WHEN folder THEN 'RESOURCE_LAYOUT_INVALID' WHEN NOT readable THEN 'RESOURCE_READ_FAILED'
   WHEN mime = 'application/octet-stream' THEN 'RESOURCE_MIME_UNKNOWN' END AS code FROM h)
SELECT 'availability' AS kind, ref_id, workspace_id, relative_path, availability AS value, NULL AS severity FROM c WHERE availability IS NOT NULL
UNION ALL SELECT 'code', ref_id, workspace_id, relative_path, code,
  CASE WHEN code IN ('RESOURCE_REFERENCE_INVALID', 'RESOURCE_METADATA_MISMATCH') THEN 'error' ELSE 'warning' END FROM c WHERE code IS NOT NULL
UNION ALL SELECT 'code', NULL, workspace_id, relative_path, code, CASE WHEN code = 'RESOURCE_MIME_UNKNOWN' THEN 'warning' ELSE 'error' END FROM f WHERE code IS NOT NULL
UNION ALL SELECT 'unreferenced', NULL, workspace_id, relative_path, 'RESOURCE_UNASSOCIATED', NULL FROM h WHERE NOT EXISTS (
  SELECT 1 FROM ({FILE_REFS}) r WHERE r.workspace_id = h.workspace_id AND r.relative_path = h.relative_path)""")
def _(t):
    resolved, issues, rest = resolve_file_refs(t.sql(FILE_REFS), t.sql(HELD))
    shape = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), *[
        (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ("ref_id", "workspace_id", "relative_path")],
        F.col(column).alias("value"), (F.col("severity") if "severity" in df.columns else F.lit(None).cast("string")).alias("severity"))
    return shape(resolved, "availability", "availability").unionByName(shape(issues, "code", "code")).unionByName(
        shape(rest, "unreferenced", "code"))


URL_PATHS = r"""SELECT DISTINCT concat('/', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')) AS path FROM {pages}"""
PREFIXES = r"""SELECT DISTINCT regexp_extract(path, '^/[^/]+', 0) AS prefix FROM (""" + URL_PATHS + r""") a
UNION SELECT DISTINCT regexp_extract(path, '^/[^/]+/[^/]+', 0) AS prefix FROM (""" + URL_PATHS + r""") b WHERE path LIKE '%/en%'"""


@query("j07_longest_prefix", f"""
SELECT path, arg_max(prefix, length(prefix)) AS prefix FROM ({URL_PATHS}) p JOIN (SELECT * FROM ({PREFIXES}) WHERE prefix <> '') x
  ON p.path = x.prefix OR starts_with(p.path, concat(x.prefix, '/')) GROUP BY path""")
def _(t):
    return longest_prefix(t.sql(URL_PATHS.replace("\\", "\\")), t.sql(PREFIXES).filter("prefix <> ''"))


ACTUAL = f"""SELECT session_id, pos, CASE WHEN length(text) % 6 = 0 THEN concat(text, '!') ELSE text END AS text FROM ({EVENTS}) x WHERE length(text) % 11 <> 0"""


@query("j08_reconcile", f"""
WITH p AS (SELECT session_id, pos, e.text AS le, a.text AS ra FROM ({EVENTS}) e FULL JOIN ({ACTUAL}) a USING (session_id, pos)),
k AS (SELECT session_id, count(le) AS n_expected, count(ra) AS n_actual, count(*) FILTER (WHERE le IS DISTINCT FROM ra) AS d FROM p GROUP BY 1)
SELECT session_id, n_expected, n_actual, d + CASE WHEN n_expected <> n_actual THEN 1 ELSE 0 END AS difference_count,
  CASE WHEN d > 0 THEN 'mismatch' ELSE 'verified' END AS status, least(3, d + CASE WHEN n_expected <> n_actual THEN 1 ELSE 0 END) AS listed FROM k""")
def _(t):
    hashed = lambda text: t.sql(text).select("session_id", "pos", F.sha2("text", 256).alias("hash"))
    report, places = reconcile(hashed(EVENTS), hashed(ACTUAL), key=("session_id",), limit=3)
    listed = places.groupBy("session_id").agg(F.count(F.lit(1)).alias("listed"))
    return report.join(listed, "session_id", "left").select(
        "session_id", "n_expected", "n_actual", "difference_count", "status", F.coalesce("listed", F.lit(0)).alias("listed"))


DIAGNOSTICS = f"""SELECT sha2(concat(session_id, event_id), 256) AS id, CASE WHEN length(text) % 3 = 0 THEN 'E1' ELSE 'W1' END AS code,
  CASE WHEN length(text) % 3 = 0 THEN 'error' ELSE 'warning' END AS severity,
  CASE length(text) % 5 WHEN 0 THEN 'session' WHEN 1 THEN 'event' WHEN 2 THEN 'project' WHEN 3 THEN 'resource' ELSE 'bundle' END AS subject_type,
  CASE length(text) % 5 WHEN 0 THEN session_id WHEN 1 THEN concat(session_id, '/', event_id) WHEN 2 THEN concat('p', CAST(conv_id % 10 AS STRING)) ELSE concat('none', session_id) END AS subject_id,
  CASE WHEN length(text) % 5 = 3 THEN session_id END AS ref_session FROM ({EVENTS}) d"""
_DUCK_DIAGNOSTICS = DIAGNOSTICS.replace("sha2(concat(session_id, event_id), 256)", "sha256(concat(session_id, event_id))")


@query("j09_diagnostics_by_session", f"""
WITH d AS ({_DUCK_DIAGNOSTICS}), s AS (SELECT session_id, conv_id, concat('p', CAST(conv_id % 10 AS STRING)) AS project_id FROM ({SESSIONS})),
m AS (SELECT DISTINCT s.session_id, d.id, d.severity FROM d JOIN s ON (d.subject_type = 'session' AND d.subject_id = s.session_id)
  OR (d.subject_type = 'project' AND d.subject_id = s.project_id) OR (d.subject_type = 'resource' AND d.ref_session = s.session_id)
  OR (d.subject_type = 'event' AND split_part(d.subject_id, '/', 1) = s.session_id)
  OR (d.subject_type = 'resource' AND (d.subject_id = concat('none', s.session_id) OR d.subject_id = concat('nonesession-', CAST(s.conv_id + 1 AS VARCHAR))))),
b AS (SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS e FROM d WHERE subject_type = 'bundle')
SELECT s.session_id, count(m.id) + any_value(b.n) AS n_issues, count(m.id) FILTER (WHERE m.severity = 'error') + any_value(b.e) AS n_errors
FROM s LEFT JOIN m USING (session_id), b GROUP BY 1""")
def _(t):
    diagnostics = t.sql(DIAGNOSTICS).withColumn("ref_sessions", F.when(F.col("ref_session").isNotNull(), F.array("ref_session"))
                                                .otherwise(F.array().cast("array<string>")))
    sessions = t.sql(SESSIONS).select("session_id", F.concat(F.lit("p"), (F.col("conv_id") % 10).cast("string")).alias("project_id"))
    events = t.sql(EVENTS).select("session_id", F.concat("session_id", F.lit("/"), "event_id").alias("event_id"))
    # A session holds a resource of its own and one that the next session holds too.
    resources = t.sql(SESSIONS).select("session_id", F.explode(F.array(
        F.concat(F.lit("none"), "session_id"), F.concat(F.lit("nonesession-"), (F.col("conv_id") + 1).cast("string")))).alias("resource_id"))
    own, general = refs.diagnostics_by_session(diagnostics, sessions, events, resources)
    # Bundle-level rows concern everyone: one pair of numbers is added, not a row per session.
    extra = general.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "error").alias("e")).first()
    return sessions.select("session_id").join(own, "session_id", "left").select(
        "session_id", (F.coalesce("n_issues", F.lit(0)) + extra["n"]).alias("n_issues"), (F.coalesce("n_errors", F.lit(0)) + extra["e"]).alias("n_errors"))


RUN_ROWS = """SELECT concat('ses_', CAST(o_orderkey AS STRING)) AS target_id, concat('s', CAST(o_custkey AS STRING)) AS source_id,
  CASE WHEN o_orderkey > 0 THEN concat('ses_', CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING)) END AS parent_id,
  CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'pending' ELSE 'failed' END AS state, o_totalprice > 100000 AS created,
  CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS deletion_hash, CAST(o_orderstatus <> 'O' AS INT) AS attempts FROM {orders}"""
PRIOR_ROWS = RUN_ROWS.replace("o_orderstatus WHEN 'F'", "substring(o_orderpriority, 1, 1) WHEN '1'").replace(
    "concat('s', CAST(o_custkey AS STRING))", "concat('s', CAST(o_custkey + CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS STRING))")


@query("j10_authorize_replacement", f"""
SELECT n.target_id, coalesce(p.state = 'verified' AND p.created AND p.deletion_hash IS NOT NULL AND p.source_id = n.source_id AND p.parent_id IS NOT DISTINCT FROM n.parent_id, false) AS fit,
  CASE WHEN p.state = 'verified' AND p.created AND p.deletion_hash IS NOT NULL AND p.source_id = n.source_id AND p.parent_id IS NOT DISTINCT FROM n.parent_id THEN p.deletion_hash END AS deletion_hash
FROM ({RUN_ROWS}) n JOIN ({PRIOR_ROWS}) p USING (target_id) WHERE n.state = 'pending'""")
def _(t):
    good, refused = refs.authorize_replacement(t.sql(RUN_ROWS), t.sql(PRIOR_ROWS), "run-0")
    return good.select("target_id", F.lit(True).alias("fit"), F.col("replacement.deletion_hash").alias("deletion_hash")).unionByName(
        refused.select("target_id", F.lit(False).alias("fit"), F.lit(None).cast("string").alias("deletion_hash")))


@query("j11_protect_children", f"""
WITH s AS (SELECT target_id, parent_id FROM ({RUN_ROWS}) WHERE state = 'verified')
SELECT DISTINCT s.target_id FROM s JOIN ({RUN_ROWS}) c ON c.parent_id = s.target_id
WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.target_id = c.target_id AND x.parent_id = c.parent_id)""")
def _(t):
    rows = t.sql(RUN_ROWS)
    selected = rows.filter("state = 'verified'").select("target_id", "parent_id")
    return refs.protect_children(selected, rows.filter("parent_id IS NOT NULL").select("target_id", "parent_id")).select("target_id")


STORED = """SELECT concat('ses_', CAST(o_orderkey AS STRING)) AS target_id, CASE WHEN o_totalprice > 50000 THEN 'run-1' ELSE 'run-0' END AS run_id,
  concat('s', CAST(o_custkey AS STRING)) AS source_id, CAST(o_custkey % 10 AS INT) AS mapping_version FROM {orders}"""


@query("j12_owned_by_run", f"""
SELECT target_id, s.run_id = 'run-1' AND s.source_id = m.source_id AND s.mapping_version BETWEEN 1 AND 8 AND m.attempts > 0 AS owned
FROM ({RUN_ROWS}) m JOIN ({STORED}) s USING (target_id)""")
def _(t):
    return refs.owned_by_run(t.sql(STORED), t.sql(RUN_ROWS), "run-1").select("target_id", "owned")


BOTH_ROLES = f"""SELECT session_id, event_id AS message_id, type AS role, session_id AS claimed_session_id FROM ({EVENTS}) a
UNION ALL SELECT session_id, event_id AS message_id, 'user' AS role, CASE WHEN length(text) % 4 = 0 THEN 'session-other' ELSE session_id END AS claimed_session_id
FROM ({EVENTS}) b WHERE type = 'assistant' AND length(text) % 3 = 0"""


@query("a02_cross_role_conflicts", f"""
WITH r AS ({BOTH_ROLES}), n AS (SELECT session_id, message_id, count(*) AS n FROM r GROUP BY ALL)
SELECT session_id, message_id, role, CASE WHEN claimed_session_id <> session_id THEN 'MESSAGE_SESSION_MISMATCH' WHEN n > 1 THEN 'EVENT_ID_CONFLICT' END AS code
FROM r JOIN n USING (session_id, message_id)""")
def _(t):
    clean, invalid = dedup.cross_role_conflicts(t.sql(BOTH_ROLES))
    return clean.select("session_id", "message_id", "role", F.lit(None).cast("string").alias("code")).unionByName(
        invalid.select("session_id", "message_id", "role", "code"))


OBSERVED = f"""SELECT session_id, 'm' AS message_id, call_id, entry_index, 'tool' AS name, '1' AS input, status, CAST(NULL AS STRING) AS error,
  CASE WHEN status IN ('completed', 'error') THEN 'done' END AS output,
  CASE WHEN amount % 3 = 0 THEN 1000 + entry_index % 7 END AS generated_at, CASE WHEN amount % 5 = 0 THEN CAST(1003 AS BIGINT) END AS started_at,
  CASE WHEN amount % 4 = 0 THEN CAST(1002 AS BIGINT) END AS completed_at, amount > 95 AS invalid FROM ({TOOL_OBS}) o"""
# The rule as written: take the observations in order and compare with what was merged so far.
_SEQUENTIAL = f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id, call_id ORDER BY entry_index) AS k,
    CASE WHEN completed_at < coalesce(started_at, generated_at) THEN NULL ELSE completed_at END AS e FROM ({OBSERVED})),
s AS (SELECT session_id, call_id, k, status, output, generated_at AS g, started_at AS s, e, invalid AS bad, entry_index, k AS n FROM o WHERE k = 1
 UNION ALL
 SELECT o.session_id, o.call_id, o.k,
   CASE WHEN o.status IN ('completed', 'error') OR (s.status NOT IN ('completed', 'error') AND o.status = 'running') THEN o.status ELSE s.status END,
   CASE WHEN o.status IN ('completed', 'error') OR (s.status NOT IN ('completed', 'error') AND o.status = 'running') THEN o.output ELSE s.output END,
   coalesce(s.g, o.generated_at), coalesce(s.s, o.started_at), coalesce(s.e, o.e),
   s.bad OR o.invalid OR (s.status IN ('completed', 'error') AND o.status IN ('completed', 'error') AND s.status <> o.status)
     OR coalesce(s.g <> o.generated_at, false) OR coalesce(s.s <> o.started_at, false) OR coalesce(s.e <> o.e, false)
     OR coalesce(coalesce(s.e, o.e) < coalesce(s.s, o.started_at, s.g, o.generated_at), false), s.entry_index, o.k
 FROM s JOIN o ON o.session_id = s.session_id AND o.call_id = s.call_id AND o.k = s.k + 1),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY k DESC) = 1)
SELECT session_id, call_id, n AS n_observations, CASE WHEN bad THEN 'conflict' ELSE status END AS outcome,
  CASE WHEN NOT bad THEN entry_index END AS entry_index, CASE WHEN NOT bad THEN g END AS generated_at,
  CASE WHEN NOT bad THEN s END AS started_at, CASE WHEN NOT bad THEN e END AS completed_at FROM f"""


@query("a03_merge_tool_observations", _SEQUENTIAL)
def _(t):
    calls, conflicts = merge.merge_tool_observations(t.sql(OBSERVED))
    none = lambda name: F.lit(None).cast("bigint").alias(name)
    return calls.select("session_id", "call_id", "n_observations", F.col("status").alias("outcome"), "entry_index", "generated_at",
                        "started_at", "completed_at").unionByName(conflicts.select(
        "session_id", "call_id", "n_observations", F.lit("conflict").alias("outcome"), none("entry_index"),
        none("generated_at"), none("started_at"), none("completed_at")))


CANDIDATES = """SELECT CAST(c_nationkey AS STRING) AS session_id, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS title, CAST(floor(c_acctbal) AS BIGINT) AS created_at,
  CAST(NULL AS BIGINT) AS updated_at, 1 AS priority FROM {customer}
UNION ALL SELECT CAST(s_nationkey AS STRING), CASE WHEN s_acctbal > 3000 THEN s_name END, CAST(floor(s_acctbal / 2000) AS BIGINT), CASE WHEN s_acctbal > 6000 THEN CAST(2 AS BIGINT) END, 2 FROM {supplier}
UNION ALL SELECT CAST(n_nationkey AS STRING), n_name, CAST(3 AS BIGINT), CAST(n_regionkey AS BIGINT), CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 0 END FROM {nation}"""


@query("a05_survivorship", f"""
WITH c AS ({CANDIDATES}),
l AS (SELECT session_id, 'title' AS f, title AS v, priority AS p FROM c UNION ALL SELECT session_id, 'created_at', CAST(created_at AS STRING), priority FROM c
      UNION ALL SELECT session_id, 'updated_at', CAST(updated_at AS STRING), priority FROM c),
b AS (SELECT * FROM l WHERE v IS NOT NULL QUALIFY p = max(p) OVER (PARTITION BY session_id, f)),
x AS (SELECT session_id, f, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS v, count(DISTINCT v) > 1 AS clash FROM b GROUP BY ALL),
w AS (SELECT k.session_id, max(v) FILTER (WHERE f = 'title') AS title, CAST(max(v) FILTER (WHERE f = 'created_at') AS BIGINT) AS created_at,
   CAST(max(v) FILTER (WHERE f = 'updated_at') AS BIGINT) AS updated_at, coalesce(bool_or(clash), false) AS clash FROM (SELECT DISTINCT session_id FROM c) k LEFT JOIN x USING (session_id) GROUP BY 1)
SELECT session_id, title, created_at, updated_at, CASE WHEN clash OR coalesce(updated_at < created_at, false) THEN 'invalid'
  WHEN title IS NULL OR created_at IS NULL OR updated_at IS NULL THEN 'partial' ELSE 'complete' END AS status FROM w""")
def _(t):
    records, _issues = merge.survivorship(t.sql(CANDIDATES), ["title", "created_at", "updated_at"])
    return records


@query("a06_dedup_by_content", """
SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(DISTINCT source) AS n_sources, min(source) AS first_source FROM documents GROUP BY 1""")
def _(t):
    rows = t.documents.select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    kept, _sources = dedup.dedup_by_content(rows, "digest", ["doc_id"], "source")
    return kept


PROJECT_PATHS = r"""SELECT concat('w', CAST(page_id AS STRING)) AS workspace_id, concat('/', regexp_extract(url, '^https?://[^/]+/([A-Za-z]+)', 1)) AS path FROM {pages}
UNION ALL SELECT concat('v', CAST(page_id AS STRING)), upper(concat('/', regexp_extract(url, '^https?://[^/]+/([A-Za-z]+)', 1))) FROM {pages}"""


@query("a08_dedup_projects", f"""
SELECT concat('sha256:', sha256(concat('{{"platform":"win32","path":"', lower(path), '"}}'))) AS project_id, min(path) AS path, count(DISTINCT workspace_id) AS n_workspaces
FROM ({PROJECT_PATHS}) GROUP BY lower(path)""")
def _(t):
    first = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]+/([A-Za-z]+)", 1))
    rows = t.pages.select(F.concat(F.lit("w"), "page_id").alias("workspace_id"), first.alias("path")).unionByName(
        t.pages.select(F.concat(F.lit("v"), "page_id").alias("workspace_id"), F.upper(first).alias("path")))
    return merge.dedup_projects(rows, "win32")


EVIDENCE_SQL = f"""SELECT k.session_id, CAST(k.n AS BIGINT) AS expected_message_count, count(*) FILTER (WHERE e.type = 'user') AS user_messages,
  count(*) FILTER (WHERE e.type = 'user' AND trim(e.text) <> '') AS user_messages_with_text, count(*) FILTER (WHERE e.type = 'assistant') AS assistant_messages,
  count(*) FILTER (WHERE e.type = 'assistant' AND b.event_id IS NOT NULL) AS assistant_messages_with_content,
  count(*) FILTER (WHERE e.type = 'assistant' AND e.completed_at IS NOT NULL) AS assistant_messages_with_completion_time,
  count(*) FILTER (WHERE l.reply_ok) AS assistant_messages_linked_to_user, CAST(0 AS BIGINT) AS invalid_messages, CAST(0 AS BIGINT) AS dangling_references
FROM (SELECT concat('session-', CAST(conv_id AS STRING)) AS session_id, count(*) AS n FROM conversations GROUP BY 1) k
LEFT JOIN ({EVENTS}) e USING (session_id) LEFT JOIN ({BLOCKS}) b ON b.session_id = e.session_id AND b.event_id = e.event_id
LEFT JOIN ({LINKED}) l ON l.session_id = e.session_id AND l.event_id = e.event_id GROUP BY 1, 2"""


def conversation_evidence(t):
    """Evidence of every conversation; system turns are expected but never recovered."""
    expected = t.conversations.groupBy(F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session_id")).agg(
        F.count(F.lit(1)).alias("expected"))
    return evidence.session_evidence(t.sql(EVENTS), t.sql(BLOCKS), expected=expected)


@query("a09_session_evidence", EVIDENCE_SQL)
def _(t):
    return conversation_evidence(t)


GRADED_SQL = f"""WITH ev AS ({EVIDENCE_SQL}),
r AS (SELECT session_id, list_filter([
  CASE WHEN expected_message_count <> user_messages + assistant_messages + invalid_messages THEN 'MESSAGE_COUNT_MISMATCH' END,
  CASE WHEN user_messages = 0 THEN 'USER_MESSAGES_MISSING' END, CASE WHEN user_messages > 0 AND user_messages_with_text < user_messages THEN 'USER_TEXT_MISSING' END,
  CASE WHEN assistant_messages = 0 THEN 'ASSISTANT_MESSAGES_MISSING' END,
  CASE WHEN assistant_messages_with_content < assistant_messages THEN 'ASSISTANT_CONTENT_MISSING' END,
  CASE WHEN assistant_messages_with_completion_time < assistant_messages THEN 'ASSISTANT_COMPLETION_TIME_MISSING' END,
  CASE WHEN assistant_messages_linked_to_user < assistant_messages THEN 'REPLY_RELATION_MISSING' END], lambda x: x IS NOT NULL) AS reasons, ev.* EXCLUDE (session_id) FROM ev)
SELECT session_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'complete'
  WHEN user_messages_with_text > 0 AND assistant_messages_with_content > 0 THEN 'partial' ELSE 'metadata-only' END AS recovery FROM r"""


def graded_conversations(t):
    rows = conversation_evidence(t).withColumn("profile_verification", F.lit("verified")).withColumn(
        "metadata_available", F.lit(True)).withColumn("message_source", F.lit("available")).withColumn(
        "source_corrupt", F.lit(False))
    return evidence.grade_sessions(rows)


@query("a10_grade_sessions", GRADED_SQL)
def _(t):
    return graded_conversations(t).select("session_id", F.array_join("reasons", ",").alias("reasons"), "recovery")


@query("a10_evidence_faults", f"""
WITH ev AS ({EVIDENCE_SQL}) SELECT session_id, 'COUNT_ABOVE_PARENT' AS fault FROM ev WHERE user_messages_with_text > user_messages - 3 OR assistant_messages_with_content > assistant_messages - 3""")
def _(t):
    # Counts lowered on purpose, so that parts exceed their whole.
    rows = conversation_evidence(t).withColumn("user_messages", F.greatest(F.col("user_messages") - 3, F.lit(0))).withColumn(
        "assistant_messages", F.greatest(F.col("assistant_messages") - 3, F.lit(0)))
    return evidence.evidence_faults(rows)


@query("a11_demote_on_diagnostics", f"""
WITH g AS ({GRADED_SQL}), d AS (SELECT DISTINCT session_id FROM ({EVENTS}) WHERE length(text) % 9 = 0)
SELECT g.session_id, CASE WHEN g.recovery = 'complete' AND d.session_id IS NOT NULL THEN 'partial' ELSE g.recovery END AS recovery FROM g LEFT JOIN d USING (session_id)""")
def _(t):
    found = t.sql(EVENTS).filter("length(text) % 9 = 0").select(F.col("session_id").alias("subject_id"), F.lit("warning").alias("severity"))
    return evidence.demote_on_diagnostics(graded_conversations(t).select("session_id", "recovery"), found)


@query("a12_grade_distribution", f"""
SELECT d.recovery, count(g.session_id) AS n FROM (VALUES ('complete'), ('partial'), ('metadata-only'), ('unrecoverable')) d(recovery) LEFT JOIN ({GRADED_SQL}) g USING (recovery) GROUP BY 1""")
def _(t):
    return evidence.grade_distribution(graded_conversations(t))


@query("p14_filter_recovery", f"SELECT session_id, recovery FROM ({GRADED_SQL}) WHERE recovery IN ('complete', 'partial')")
def _(t):
    return evidence.filter_recovery(graded_conversations(t)).select("session_id", "recovery")


KINDS = ("view", "click", "purchase", "error", "signup", "never-seen")


@query("a13_source_counts", f"""
SELECT k.kind, count(e.event_id) AS n FROM (VALUES {", ".join(f"('{k}')" for k in KINDS)}) k(kind) LEFT JOIN events e ON e.event_type = k.kind GROUP BY 1""")
def _(t):
    return evidence.source_counts(t.events.select(F.col("event_type").alias("kind")), KINDS)


@query("a14_summarize_bundle", f"""
WITH g AS ({GRADED_SQL}), e AS (SELECT session_id, count(*) AS m, count(*) FILTER (WHERE type = 'user') AS u, count(*) FILTER (WHERE type = 'assistant') AS a FROM ({EVENTS}) GROUP BY 1),
b AS (SELECT session_id, count(*) AS r FROM ({BLOCKS}) GROUP BY 1),
c AS (SELECT session_id, string_agg(DISTINCT concat('C', CAST(length(text) % 4 AS STRING)), ',' ORDER BY concat('C', CAST(length(text) % 4 AS STRING))) AS codes FROM ({EVENTS}) GROUP BY 1)
SELECT g.session_id, g.recovery, coalesce(m, 0) AS messages, coalesce(u, 0) AS users, coalesce(a, 0) AS assistants, coalesce(r, 0) AS resources, coalesce(codes, '') AS codes
FROM g LEFT JOIN e USING (session_id) LEFT JOIN b USING (session_id) LEFT JOIN c USING (session_id)""")
def _(t):
    events = t.sql(EVENTS)
    found = events.select(F.lit("session").alias("subject_type"), F.col("session_id").alias("subject_id"),
                          F.concat(F.lit("C"), (F.length("text") % 4).cast("string")).alias("code"))
    return evidence.summarize_bundle(graded_conversations(t), events, t.sql(BLOCKS), found).withColumn(
        "codes", F.array_join("codes", ","))


def _tree_sql(rows: str, key: str) -> str:
    """Three levels of the hash tree over (key, pos, h), as long as a key has fewer rows than the fan-out."""
    return f"SELECT {key}, concat('sha256:', sha256(sha256(sha256(string_agg(h, ',' ORDER BY pos))))) AS messages_sha256 FROM ({rows}) GROUP BY 1"


@query("a16_transfer_counts", f"""
WITH h AS ({_tree_sql(f"SELECT session_id, pos, sha256(text) AS h FROM ({EVENTS})", "session_id")}),
m AS (SELECT session_id, count(*) AS messages, count(*) FILTER (WHERE type = 'user') AS users, count(*) FILTER (WHERE type = 'assistant') AS assistants FROM ({EVENTS}) GROUP BY 1),
b AS (SELECT session_id, count(*) AS text FROM ({BLOCKS}) GROUP BY 1)
SELECT session_id AS target_id, messages, users, assistants, coalesce(text, 0) AS text, CAST(0 AS BIGINT) AS reasoning, CAST(0 AS BIGINT) AS tools, messages_sha256
FROM m JOIN h USING (session_id) LEFT JOIN b USING (session_id)""")
def _(t):
    rows = t.sql(EVENTS).select(F.col("session_id").alias("target_id"), "pos", "type", F.sha2("text", 256).alias("hash"))
    return transfer_counts(rows, t.sql(BLOCKS).withColumnRenamed("session_id", "target_id"))


# Every order is a session read page by page, one line item per page; the first page is read twice.
LINES = """SELECT l_orderkey AS session_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM {lineitem}"""
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query("s03_merge_pages", """
WITH c AS (SELECT l_orderkey AS session_id, count(*) AS rows, count(DISTINCT l_linenumber) AS ids, count(DISTINCT (l_linenumber, l_partkey)) AS versions FROM lineitem GROUP BY 1)
SELECT session_id, CASE WHEN o_orderstatus = 'P' OR versions > ids THEN 'rejected' ELSE 'kept' END AS outcome,
  CASE WHEN o_orderstatus = 'P' OR versions > ids THEN CAST(0 AS BIGINT) ELSE ids END AS n_items
FROM c JOIN orders ON o_orderkey = session_id""")
def _(t):
    from palaver.operators.ordered import row_position
    lines = row_position(t.sql(LINES), ["session_id"], _LINE_ORDER, "line")
    ends = lines.groupBy("session_id").agg(F.max("line").alias("last"))
    rows = lines.join(ends, "session_id").join(
        t.orders.select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderstatus") == "P").alias("_p")), "session_id")
    item = F.array(F.struct(F.col("l_linenumber").cast("string").alias("item_id"), F.col("session_id").alias("owner_id"),
                            F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest")))
    end = F.col("line") == F.col("last")

    def page(number, last, more):
        return F.struct(number.alias("page_no"), F.when(~last, F.concat(F.lit("t"), number.cast("string"))).alias("next_token"), more.alias("has_more"))
    # For some sessions the last page wrongly promises more.
    once = page(F.col("line") + 1, end, F.when(end, F.col("_p")).otherwise(F.lit(True)))
    again = page(F.lit(0).cast("bigint"), F.lit(False), F.lit(True))
    reads = F.when(F.col("line") == 0, F.array(once, again)).otherwise(F.array(once))
    pages = rows.select("session_id", item.alias("items"), F.explode(reads).alias("page")).select(
        "session_id", "page.page_no", F.lit(0).cast("bigint").alias("code"), "items", "page.next_token", "page.has_more",
        F.lit(None).cast("bigint").alias("total"))
    kept, rejected = merge.merge_pages(pages)
    counts = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_items"))
    return counts.select("session_id", F.lit("kept").alias("outcome"), "n_items").unionByName(
        rejected.select("session_id", F.lit("rejected").alias("outcome"), F.lit(0).cast("bigint").alias("n_items")))
