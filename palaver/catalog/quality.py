"""Queries for checks, graphs, segmentation and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.catalog.base import BLOCKS, EVENTS, SESSIONS, query
from palaver.catalog.joins import LINKED
from palaver.operators import graph, integrity, rules, segments
from palaver.operators.budget import byte_budget
from palaver.operators.refs import select_sessions

SHUFFLED = f"""SELECT session_id, pos, event_id, CASE WHEN length(text) % 6 = 0 THEN ord - 1 ELSE ord END AS ord, text FROM ({EVENTS}) w"""
_LAGGED = f"SELECT *, lag(ord) OVER (PARTITION BY session_id ORDER BY pos) AS previous_ord FROM ({SHUFFLED})"


@query("w01_check_strict_order", f"""
SELECT session_id, pos, ord, previous_ord FROM ({_LAGGED}) WHERE ord <= coalesce(previous_ord, -1)""")
def _(t):
    return integrity.check_strict_order(t.sql(SHUFFLED)).select("session_id", "pos", "ord", "previous_ord")


@query("w02_check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return integrity.check_unique(t.lineitem, ["l_orderkey"], "l_linenumber")


@query("w03_check_times", f"""
SELECT session_id, event_id, 'event' AS kind FROM ({EVENTS}) WHERE completed_at < created_at
UNION ALL SELECT session_id, NULL, 'session' FROM ({SESSIONS}) WHERE updated_at < created_at""")
def _(t):
    events = integrity.check_times(t.sql(EVENTS), "created_at", "completed_at").select(
        "session_id", "event_id", F.lit("event").alias("kind"))
    sessions = integrity.check_times(t.sql(SESSIONS), "created_at", "updated_at").select(
        "session_id", F.lit(None).cast("string").alias("event_id"), F.lit("session").alias("kind"))
    return events.unionByName(sessions)


def _with_refs(df):
    """A reference to the own session, for some rows to the session before."""
    other = F.when(F.length("text") % 10 == 0, F.lit("session-x")).otherwise(F.col("session_id"))
    ref = F.struct(F.lit(None).cast("string").alias("workspace_id"), other.alias("session_id"), F.struct(
        F.lit("runtime-field").alias("type"), F.lit("runtime:getMessages#message").alias("value")).alias("locator"),
        F.struct(F.lit("runtime-v1").alias("id"), F.lit(1).alias("version")).alias("profile"), F.lit("h").alias("sha256"))
    return df.withColumn("refs", F.array(ref))


@query("w04_check_provenance", f"SELECT session_id, event_id FROM ({EVENTS}) WHERE length(text) % 10 = 0")
def _(t):
    return integrity.check_provenance(_with_refs(t.sql(EVENTS))).select("session_id", "event_id")


@query("p15_verified_refs_only", f"SELECT session_id, event_id, length(text) % 10 <> 0 AS verified FROM ({EVENTS})")
def _(t):
    from palaver.functions.values import verified_refs_only
    rows = _with_refs(t.sql(EVENTS))
    return rows.select("session_id", "event_id", verified_refs_only(
        F.col("refs"), F.col("session_id"), "runtime-v1", 1).alias("verified"))


@query("w06_segment_history", f"""
WITH RECURSIVE b AS (SELECT session_id, pos, type, strlen(text) + 32 AS bytes, least(300, sum(strlen(text)) OVER (PARTITION BY session_id ORDER BY pos)) AS tail,
    row_number() OVER (PARTITION BY session_id ORDER BY pos) AS k FROM ({EVENTS})),
f AS (SELECT session_id, k, pos, bytes AS active, type = 'assistant' AND bytes > 1500 AS cut, CASE WHEN type = 'assistant' AND bytes > 1500 THEN tail ELSE bytes END AS total FROM b WHERE k = 1
 UNION ALL SELECT b.session_id, b.k, b.pos, f.total + b.bytes, b.type = 'assistant' AND f.total + b.bytes > 1500,
   CASE WHEN b.type = 'assistant' AND f.total + b.bytes > 1500 THEN b.tail ELSE f.total + b.bytes END FROM f JOIN b ON b.session_id = f.session_id AND b.k = f.k + 1)
SELECT session_id, pos, CAST(active AS BIGINT) AS active_bytes FROM f WHERE cut""")
def _(t):
    from palaver.operators.ordered import running_sum
    rows = t.sql(EVENTS).withColumn("b", F.octet_length("text").cast("bigint"))
    sized = running_sum(rows, ["session_id"], "pos", "b", "so_far").select(
        "session_id", "pos", "type", (F.col("b") + 32).alias("bytes"), F.least(F.lit(300).cast("bigint"), "so_far").alias("tail_bytes"))
    return segments.segment_history(sized, cap=1500)


# Conversations strung together to histories beyond the default limit; every text counts a hundred times.
_LONG = f"""SELECT concat('long-', CAST(conv_id % 3 AS STRING)) AS session_id, CAST(conv_id * 1000 + pos AS BIGINT) AS pos, type,
  CAST(length(text) * 100 + 32 AS BIGINT) AS bytes, CAST((length(text) * 37) % 16384 AS BIGINT) AS tail_bytes FROM ({EVENTS}) v"""


@query("w06_segment_long", f"""
WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS k FROM ({_LONG})),
f AS (SELECT session_id, k, pos, bytes AS active, type = 'assistant' AND bytes > 196608 AS cut, CASE WHEN type = 'assistant' AND bytes > 196608 THEN tail_bytes ELSE bytes END AS total FROM b WHERE k = 1
 UNION ALL SELECT b.session_id, b.k, b.pos, f.total + b.bytes, b.type = 'assistant' AND f.total + b.bytes > 196608,
   CASE WHEN b.type = 'assistant' AND f.total + b.bytes > 196608 THEN b.tail_bytes ELSE f.total + b.bytes END FROM f JOIN b ON b.session_id = f.session_id AND b.k = f.k + 1)
SELECT session_id, pos, CAST(active AS BIGINT) AS active_bytes FROM f WHERE cut""")
def _(t):
    return segments.segment_history(t.sql(_LONG))


_TAIL_LIMIT = 400


def _duck_tail(text: str, limit: str) -> str:
    return f"right({text}, coalesce(list_max(list_filter(range(0, {_TAIL_LIMIT + 1}), lambda n: strlen(right({text}, n)) <= {limit})), 0))"


# The rule as written: every entry is cut, appended, and the whole is cut again.
@query("w07_recent_tail", f"""
WITH RECURSIVE l AS (SELECT session_id, pos, text, CASE WHEN type = 'user' THEN '[User]: ' ELSE '[Assistant]: ' END AS label FROM ({EVENTS})),
e AS (SELECT session_id, pos, concat(label, {_duck_tail("text", f"{_TAIL_LIMIT} - strlen(label)")}) AS entry, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS k FROM l),
j AS (SELECT session_id, k, pos, entry AS recent FROM e WHERE k = 1
  UNION ALL SELECT e.session_id, e.k, e.pos, CASE WHEN strlen(e.entry) >= {_TAIL_LIMIT} THEN e.entry
    ELSE {_duck_tail("concat(j.recent, chr(10), chr(10), e.entry)", str(_TAIL_LIMIT))} END FROM j JOIN e ON e.session_id = j.session_id AND e.k = j.k + 1)
SELECT session_id, pos, CAST(strlen(recent) AS BIGINT) AS tail_bytes, sha256(recent) AS recent FROM j""")
def _(t):
    events = t.sql(EVENTS)
    texts = events.select("session_id", "pos", F.lit(0).cast("bigint").alias("block_pos"), "type", "text")
    # Texts longer than the limit are first cut to it, with their label.
    entries = segments.labelled_texts(texts, _TAIL_LIMIT)
    sizes = segments.tail_bytes(entries, _TAIL_LIMIT)
    shown = segments.recent_tail(entries, events.select("session_id", "pos"), _TAIL_LIMIT)
    return sizes.join(shown, ["session_id", "pos"]).select("session_id", "pos", "tail_bytes", F.sha2("recent", 256).alias("recent"))


_FOREST = f"SELECT session_id, parent_id FROM ({SESSIONS}) f"


@query("w08_parent_order", f"""
WITH RECURSIVE a AS (SELECT session_id, session_id AS top, parent_id AS up, 0 AS hops FROM ({_FOREST})
  UNION ALL SELECT a.session_id, f.session_id, f.parent_id, a.hops + 1 FROM a JOIN ({_FOREST}) f ON f.session_id = a.up),
d AS (SELECT session_id, max(hops) AS depth FROM a GROUP BY 1), l AS (SELECT top AS session_id, min(session_id) AS subtree_min FROM a GROUP BY 1)
SELECT session_id, subtree_min, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY subtree_min, depth) - 1 AS place FROM d JOIN l USING (session_id)""")
def _(t):
    from palaver.operators.ordered import row_position
    return row_position(graph.parent_order(t.sql(_FOREST)), [], ["subtree_min", "depth"], "place")


LOOPED = """SELECT concat('c', CAST(c_custkey AS STRING)) AS session_id,
  concat('c', CAST(CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 1 WHEN c_custkey % 10 = 4 THEN c_custkey - 1 WHEN c_custkey % 50 = 7 THEN c_custkey
    ELSE CAST(floor(c_custkey / 2) AS BIGINT) - 1 END AS STRING)) AS parent_id FROM {customer}"""


@query("w09_parent_cycles", f"""
WITH RECURSIVE w AS (SELECT session_id AS origin, parent_id AS here, 1 AS n FROM ({LOOPED})
  UNION ALL SELECT w.origin, l.parent_id, w.n + 1 FROM w JOIN ({LOOPED}) l ON l.session_id = w.here WHERE w.here <> w.origin AND w.n < 60)
SELECT DISTINCT origin AS session_id FROM w WHERE here = origin""")
def _(t):
    return graph.parent_cycles(t.sql(LOOPED))


TREE = """SELECT concat('s', CAST(o_orderkey AS STRING)) AS target_id, CASE WHEN o_orderkey > 0 THEN concat('s', CAST(CAST(floor(o_orderkey / 4) AS BIGINT) AS STRING)) END AS parent_id,
  o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderpriority <> '3-MEDIUM' OR o_orderkey < 20 AS ready FROM {orders}"""


@query("w10_propagate_block", f"""
WITH RECURSIVE e AS (SELECT target_id, ready AS effective FROM ({TREE}) WHERE parent_id IS NULL
  UNION ALL SELECT c.target_id, c.ready AND e.effective FROM e JOIN ({TREE}) c ON c.parent_id = e.target_id)
SELECT target_id, effective FROM e""")
def _(t):
    return graph.propagate_block(t.sql(TREE)).select("target_id", "effective")


# Parents come before children in pos, so one ordered pass over the plan decides everything.
BUDGET = """SELECT concat('s', CAST(c_custkey AS STRING)) AS target_id, CASE WHEN c_custkey > 0 THEN concat('s', CAST(CAST(floor(c_custkey / 40) AS BIGINT) AS STRING)) END AS parent_id,
  c_custkey AS pos, CAST(abs(floor(c_acctbal)) AS BIGINT) + 1 AS bytes, c_mktsegment <> 'MACHINERY' OR c_custkey < 5 AS ready FROM {customer}"""
_CAP = 600_000


@query("w11_byte_budget", f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM ({BUDGET})),
f AS (SELECT k, target_id, CAST({_CAP} AS BIGINT) - CASE WHEN ready AND bytes <= {_CAP} THEN bytes ELSE 0 END AS rest,
    CASE WHEN NOT ready THEN 'blocked' WHEN bytes <= {_CAP} THEN 'ready' ELSE 'too_large' END AS status,
    map {{target_id: ready AND bytes <= {_CAP}}} AS fine FROM p WHERE k = 1
 UNION ALL SELECT p.k, p.target_id, f.rest - CASE WHEN p.ready AND coalesce(f.fine[p.parent_id], false) AND p.bytes <= f.rest THEN p.bytes ELSE 0 END,
    CASE WHEN NOT p.ready OR NOT coalesce(f.fine[p.parent_id], false) THEN 'blocked' WHEN p.bytes <= f.rest THEN 'ready' ELSE 'too_large' END,
    CASE WHEN p.pos * 40 <= (SELECT max(pos) FROM p) THEN map_concat(f.fine, map {{p.target_id: p.ready AND coalesce(f.fine[p.parent_id], false) AND p.bytes <= f.rest}}) ELSE f.fine END
  FROM f JOIN p ON p.k = f.k + 1)
SELECT target_id, status FROM f""")
def _(t):
    return byte_budget(t.sql(BUDGET), _CAP, window=200).select("target_id", "status")


@query("w14_normalize_message_order", f"""
WITH m AS (SELECT session_id, event_id AS id, pos, created_at - CASE WHEN length(text) % 5 = 0 THEN 3000 ELSE 0 END AS created_at FROM ({EVENTS})),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS new_pos, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS old_pos FROM m)
SELECT session_id, id, new_pos, bool_or(new_pos <> old_pos) OVER (PARTITION BY session_id) AS reordered FROM p""")
def _(t):
    rows = t.sql(EVENTS).select("session_id", F.col("event_id").alias("id"), "pos", (
        F.col("created_at") - F.when(F.length("text") % 5 == 0, 3000).otherwise(0)).alias("created_at"))
    placed, flags = segments.normalize_message_order(rows)
    return placed.join(flags, "session_id").select("session_id", "id", "new_pos", "reordered")


@query("v01_validate_rows", """
SELECT o_orderkey, 'o_totalprice' AS path, 'minimum' AS keyword FROM orders WHERE o_totalprice < 20000
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'enum' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-[A-Z ]+$')""")
def _(t):
    checks = [rules.required("o_orderkey"), rules.minimum("o_totalprice", 20000), rules.one_of("o_orderstatus", ("F", "O")),
              rules.matches("o_orderpriority", r"^[1-4]-[A-Z ]+$"), rules.non_empty("o_orderpriority")]
    return rules.validate_rows(t.orders, checks, ["o_orderkey"]).select("o_orderkey", "path", "keyword")


@query("v02_check_integrity", f"""
WITH e AS (SELECT * FROM ({EVENTS})), o AS ({_LAGGED.replace(SHUFFLED, f"SELECT session_id, pos, event_id, CASE WHEN length(text) % 6 = 0 THEN ord - 1 ELSE ord END AS ord, text FROM ({EVENTS})")}),
s AS (SELECT * FROM ({SESSIONS})),
f AS (SELECT session_id, 'EVENT_ORDER_CONFLICT' AS code, event_id AS item FROM o WHERE ord <= coalesce(previous_ord, -1)
 UNION ALL SELECT session_id, 'EVENT_TIME_INVALID', event_id FROM e WHERE type = 'assistant' AND completed_at < created_at
 UNION ALL SELECT session_id, 'SESSION_TIME_INVALID', '' FROM s WHERE updated_at < created_at
 UNION ALL SELECT session_id, 'PROJECT_REFERENCE_MISSING', '' FROM s WHERE conv_id % 10 = 9
 UNION ALL SELECT a.session_id, 'REPLY_REFERENCE_INVALID', a.event_id FROM (SELECT x.session_id, x.event_id, x.reply_to, o.ord FROM e x JOIN o USING (session_id, event_id) WHERE x.type = 'assistant') a
   LEFT JOIN (SELECT y.session_id, y.event_id AS k, y.type, o.ord FROM e y JOIN o USING (session_id, event_id)) u ON u.session_id = a.session_id AND u.k = a.reply_to WHERE NOT coalesce(u.type = 'user' AND u.ord < a.ord, false))
SELECT session_id, code, count(*) AS n FROM f GROUP BY 1, 2""")
def _(t):
    # The reference of a row names it, so every finding has its own id.
    named = lambda df, item: df.withColumn("refs", F.array(F.struct(
        F.lit(None).cast("string").alias("workspace_id"), F.col("session_id"), F.struct(
            F.lit("runtime-field").alias("type"), item.alias("value")).alias("locator"),
        F.struct(F.lit("runtime-v1").alias("id"), F.lit(1).alias("version")).alias("profile"), F.lit("h").alias("sha256"))))
    project = F.concat(F.lit("p"), (F.col("conv_id") % 10).cast("string"))
    sessions = named(t.sql(SESSIONS).withColumn("project_id", project), F.lit("s"))
    events = named(t.sql(EVENTS).withColumn("ord", F.when(F.length("text") % 6 == 0, F.col("ord") - 1).otherwise(F.col("ord"))),
                   F.col("event_id"))
    none = lambda kind: F.lit(None).cast(kind)
    blocks = named(t.sql(BLOCKS), F.lit("b")).withColumn("call_id", none("string")).withColumn(
        "created_at", none("bigint")).withColumn("completed_at", none("bigint"))
    resources = t.sql(BLOCKS).select("session_id", F.col("event_id").alias("resource_id"))
    projects = sessions.filter("project_id <> 'p9'").select("project_id").distinct()
    found = integrity.check_integrity({"projects": projects, "sessions": sessions, "events": events, "blocks": blocks,
                                       "resources": resources})
    return found.groupBy(F.col("subject_id").alias("session_id"), "code").agg(F.count(F.lit(1)).alias("n"))


@query("s12_select_sessions", f"""
WITH s AS (SELECT session_id, conv_id FROM ({SESSIONS}) WHERE conv_id % 10 = 4)
SELECT 'sessions' AS name, count(*) AS n FROM s UNION ALL SELECT 'events', count(*) FROM ({EVENTS}) WHERE session_id IN (SELECT session_id FROM s)
UNION ALL SELECT 'blocks', count(*) FROM ({BLOCKS}) WHERE session_id IN (SELECT session_id FROM s)
UNION ALL SELECT 'projects', 1 UNION ALL SELECT 'diagnostics', count(*) FROM ({LINKED}) WHERE NOT reply_ok AND session_id IN (SELECT session_id FROM s)""")
def _(t):
    from palaver.operators.refs import link_replies
    path = F.concat(F.lit("/work/p"), (F.col("conv_id") % 10).cast("string"))
    sessions = t.sql(SESSIONS).withColumn("project_path", path).withColumn("project_id", F.sha2("project_path", 256))
    events = t.sql(EVENTS)
    tables = {"sessions": sessions, "events": events, "blocks": t.sql(BLOCKS),
              "projects": sessions.select("project_id", F.col("project_path").alias("path")).distinct(),
              "diagnostics": link_replies(events).filter("NOT reply_ok").select(
                  F.col("session_id").alias("subject_id"), F.lit("session").alias("subject_type"))}
    chosen = select_sessions(tables, project="/work//x/../p4/")
    counts = None
    for name, table in chosen.items():
        one = table.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts.select("name", "n")
