"""Queries for planning and the migration life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.catalog.base import SESSIONS, feed, query
from palaver.plans import lifecycle as life
from palaver.plans import manifest as mf
from palaver.plans.plan import decide_status
from palaver.sources.target import list_children, lookup_target

RUN, PRIOR = "run-1", "run-0"

# One plan row per order; parents come earlier.
PLAN = """SELECT concat('ses_', CAST(o_orderkey AS STRING)) AS target_id, concat('s', CAST(o_orderkey AS STRING)) AS source_id,
  CASE WHEN o_orderkey > 0 THEN concat('ses_', CAST(CAST(floor(o_orderkey / 5) AS BIGINT) AS STRING)) END AS parent_id, o_orderkey AS pos,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey > 50 THEN 'excluded' WHEN o_totalprice > 480000 THEN 'blocked' ELSE 'ready' END AS status,
  o_totalprice, o_orderstatus, o_orderpriority FROM {orders}"""
# What the target holds before the run: some of it ours, some foreign, some edited.
HELD = """SELECT target_id, parent_id, source_id, CASE WHEN o_totalprice < 60000 THEN 'run-1' ELSE 'other' END AS run_id, 8 AS mapping_version,
  CASE WHEN o_totalprice < 30000 THEN 'edited' ELSE concat('x', CAST(pos AS STRING)) END AS snapshot, concat('h', CAST(pos AS STRING)) AS hash
FROM (""" + PLAN + """) p WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""
# An unfinished earlier revision of the manifest.
MANIFEST = """SELECT target_id, source_id, parent_id, pos,
  CASE WHEN status <> 'ready' THEN status WHEN o_orderpriority IN ('1-URGENT') AND o_totalprice < 60000 AND o_totalprice >= 30000 AND o_orderstatus = 'F' THEN 'verified' ELSE 'pending' END AS state,
  status = 'ready' AND o_orderpriority IN ('1-URGENT') AND o_totalprice < 60000 AND o_totalprice >= 30000 AND o_orderstatus = 'F' AS created,
  CASE WHEN status = 'ready' AND o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 1 ELSE 0 END AS attempts,
  CASE WHEN status = 'ready' THEN concat('t', CAST(pos AS STRING)) END AS transfer_hash, CASE WHEN status = 'ready' THEN concat('x', CAST(pos AS STRING)) END AS expected
FROM (""" + PLAN + """) q"""


def plan_of(t):
    """The plan rows with the columns of ``build_plan``."""
    return t.sql(PLAN).select(
        "target_id", "source_id", "parent_id", "pos", "status", F.array().cast("array<string>").alias("codes"),
        F.concat(F.lit("x"), "pos").alias("expected"), F.concat(F.lit("p"), "pos").alias("transfer_hash"))


def manifest_of(t):
    rows = t.sql(MANIFEST)
    verified = F.col("state") == "verified"
    return rows.select(
        "target_id", "source_id", "parent_id", "pos", "state", "created", "attempts",
        F.array().cast("array<string>").alias("codes"), "transfer_hash", "expected", F.when(verified, F.col("expected")).alias("actual"),
        F.when(verified, F.concat(F.lit("h"), "pos")).alias("deletion_hash"), F.lit(None).cast(mf.REPLACEMENT).alias("replacement"))


_M = f"WITH p AS ({PLAN}), m AS ({MANIFEST}), h AS ({HELD})"
_OWNED = "(h.run_id = 'run-1' AND h.source_id = m.source_id AND m.attempts > 0)"


@query("s11_read_target", f"""{_M} SELECT m.target_id, h.target_id IS NOT NULL AS present, h.snapshot FROM m LEFT JOIN h USING (target_id)""")
def _(t):
    return lookup_target(t.sql(HELD), t.sql(MANIFEST)).select("target_id", "present", "snapshot")


@query("m11_list_children", f"""{_M} SELECT h.parent_id, h.target_id, h.target_id <> h.parent_id AS valid FROM h WHERE h.parent_id IN (SELECT target_id FROM m WHERE state = 'pending')""")
def _(t):
    return list_children(t.sql(HELD), t.sql(MANIFEST).filter("state = 'pending'"))


_PLAN_BASE = f"""SELECT concat('ses_', session_id) AS target_id, CASE WHEN parent_id IS NOT NULL THEN concat('ses_', parent_id) END AS parent_id, conv_id AS pos,
  n_chars * 10 AS bytes, conv_id % 8 <> 5 AS wanted, CASE WHEN conv_id % 13 = 6 THEN 'MAPPING_REJECTED' END AS reason FROM ({SESSIONS}) s"""


@query("m02_plan_status", f"""
WITH RECURSIVE b AS (SELECT *, CASE WHEN NOT wanted THEN 'RECOVERY_EXCLUDED' WHEN reason IS NOT NULL THEN reason WHEN bytes > 90000 THEN 'TRANSFER_TOO_LARGE' END AS own FROM ({_PLAN_BASE})),
e AS (SELECT target_id, own IS NULL AS ok FROM b WHERE parent_id IS NULL UNION ALL SELECT b.target_id, b.own IS NULL AND e.ok FROM e JOIN b ON b.parent_id = e.target_id),
r AS (SELECT b.*, e.ok, coalesce(u.ok, b.parent_id IS NULL) AS parent_ok FROM b JOIN e USING (target_id) LEFT JOIN e u ON u.target_id = b.parent_id)
SELECT target_id, CASE WHEN NOT wanted THEN 'excluded' WHEN ok THEN 'ready' ELSE 'blocked' END AS status,
  CASE WHEN NOT wanted THEN 'RECOVERY_EXCLUDED' WHEN NOT parent_ok THEN 'PARENT_MISSING' ELSE coalesce(own, '') END AS reasons FROM r""")
def _(t):
    decided = decide_status(t.sql(_PLAN_BASE), 90_000, 10 ** 12)
    return decided.select("target_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query("m03_init_manifest", f"""
WITH p AS ({PLAN}) SELECT target_id, CASE WHEN status = 'ready' THEN 'pending' ELSE status END AS state, false AS created, 0 AS attempts,
  CASE WHEN status = 'ready' THEN concat('sha256:', sha256(concat('p', CAST(pos AS STRING), '|run-1'))) END AS transfer_hash FROM p""")
def _(t):
    return mf.init_manifest(plan_of(t), RUN).select("target_id", "state", "created", "attempts", "transfer_hash")


@query("m04_apply_plan", f"""
WITH RECURSIVE p AS ({PLAN}), m AS ({MANIFEST}), h AS ({HELD}),
x AS (SELECT m.*, h.target_id IS NOT NULL AS there, {_OWNED} IS TRUE AS owned, coalesce(h.snapshot = m.expected, false) AS same,
   m.transfer_hash IS NOT NULL AND m.state <> 'verified' AS active FROM m LEFT JOIN h ON h.target_id = m.target_id),
e AS (SELECT target_id, (state = 'verified' OR (active AND there AND owned AND same) OR (active AND NOT there AND NOT created)) AS ok FROM x WHERE parent_id IS NULL OR NOT (active AND NOT there)
  UNION ALL SELECT x.target_id, NOT x.created AND e.ok FROM e JOIN x ON x.parent_id = e.target_id WHERE x.active AND NOT x.there)
SELECT x.target_id, CASE WHEN NOT active THEN state WHEN NOT there THEN CASE WHEN created THEN 'failed' WHEN e.ok THEN 'verified' ELSE 'failed' END
   WHEN owned THEN CASE WHEN same THEN 'verified' ELSE 'failed' END WHEN attempts = 0 THEN 'skipped' ELSE 'failed' END AS state,
  CASE WHEN NOT active THEN '' WHEN NOT there THEN CASE WHEN created THEN 'TARGET_CHANGED' WHEN e.ok THEN '' ELSE 'PARENT_MISSING' END
   WHEN owned THEN CASE WHEN same THEN '' ELSE 'PARTIAL_WRITE' END WHEN attempts = 0 THEN 'SESSION_CONFLICT' ELSE 'TARGET_CHANGED' END AS codes,
  attempts + CASE WHEN active AND NOT there AND NOT created AND e.ok THEN 1 ELSE 0 END AS attempts
FROM x LEFT JOIN e USING (target_id)""")
def _(t):
    after, _target = life.apply_plan(manifest_of(t), plan_of(t), t.sql(HELD), RUN)
    return after.select("target_id", "state", F.array_join("codes", ",").alias("codes"), "attempts")


@query("m04_apply_plan_target", f"""{_M},
n AS (SELECT count(*) AS before FROM h)
SELECT 'rows before' AS what, before AS n FROM n
UNION ALL SELECT 'repeated ids', CAST(0 AS BIGINT) UNION ALL SELECT 'second run adds', CAST(0 AS BIGINT)""")
def _(t):
    held = t.sql(HELD)
    first, target = life.apply_plan(manifest_of(t), plan_of(t), held, RUN)
    _second, again = life.apply_plan(first, plan_of(t), target, RUN)
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    repeated = target.groupBy("target_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    added = again.join(target.select("target_id"), "target_id", "left_anti")
    return one(held, "rows before").unionByName(one(repeated, "repeated ids")).unionByName(one(added, "second run adds"))


@query("m05_resume", f"""
WITH p AS ({PLAN}) SELECT target_id, CASE WHEN status <> 'ready' THEN status WHEN o_orderpriority = '3-MEDIUM' THEN 'pending' ELSE 'verified' END AS state,
  status = 'ready' AND o_orderpriority <> '3-MEDIUM' AS created FROM p""")
def _(t):
    # Everything was applied once; then the sessions of one priority vanished from the target.
    plan = plan_of(t)
    fresh = mf.init_manifest(plan, RUN)
    ready = F.col("transfer_hash").isNotNull()
    done = (fresh.withColumn("state", F.when(ready, "verified").otherwise(F.col("state"))).withColumn("created", ready)
            .withColumn("attempts", F.when(ready, 1).otherwise(0)).withColumn("actual", F.col("expected"))
            .withColumn("deletion_hash", F.col("transfer_hash")))
    kept = t.sql(PLAN).filter("o_orderpriority <> '3-MEDIUM'").select("target_id")
    target = life.planned_rows(plan, RUN).join(kept, "target_id", "left_semi")
    return life.resume(done, plan, target, RUN).select("target_id", "state", "created")


@query("m06_target_evidence", f"""{_M}
SELECT coalesce(bool_or(m.state = 'verified' AND m.created AND {_OWNED} AND h.snapshot = m.expected), false) AS proven, coalesce(bool_or(h.target_id IS NOT NULL), false) AS any_present FROM m LEFT JOIN h ON h.target_id = m.target_id""")
def _(t):
    return life.target_evidence(manifest_of(t), t.sql(HELD), RUN)


@query("m07_verify", f"""{_M}
SELECT m.target_id, CASE WHEN attempts = 0 THEN state WHEN {_OWNED} AND h.snapshot = m.expected THEN 'verified' ELSE 'failed' END AS state,
  CASE WHEN attempts = 0 OR ({_OWNED} AND h.snapshot = m.expected) THEN '' ELSE 'RECONCILIATION_FAILED' END AS codes FROM m LEFT JOIN h ON h.target_id = m.target_id""")
def _(t):
    return life.verify(manifest_of(t), t.sql(HELD), RUN).select("target_id", "state", F.array_join("codes", ",").alias("codes"))


@query("m08_plan_replacement", f"""
WITH p AS ({PLAN}) SELECT target_id, row_number() OVER (ORDER BY pos DESC) - 1 AS place FROM p WHERE status = 'ready' AND NOT (o_orderstatus = 'P' AND pos > 3000)""")
def _(t):
    from palaver.operators.ordered import row_position
    plan = plan_of(t)
    new = mf.init_manifest(plan, RUN)
    before = mf.init_manifest(plan, PRIOR)
    ready = F.col("transfer_hash").isNotNull()
    prior = (before.withColumn("state", F.when(ready, "verified").otherwise(F.col("state"))).withColumn("created", ready)
             .withColumn("attempts", F.when(ready, 1).otherwise(0)).withColumn("actual", F.col("expected"))
             .withColumn("deletion_hash", F.col("transfer_hash")).filter(ready))
    # Some leaves of the earlier run are gone already.
    kept = t.sql(PLAN).filter("NOT (o_orderstatus = 'P' AND pos > 3000)").select("target_id")
    target = life.planned_rows(plan, PRIOR).join(kept, "target_id", "left_semi")
    _updated, deletions = life.plan_replacement(new, prior, target, PRIOR)
    return row_position(deletions, [], [F.desc("pos")], "place").select("target_id", "place")


_ROLLBACK = f"""{_M},
a AS (SELECT m.target_id, m.parent_id, CASE WHEN m.attempts = 0 THEN 'skip' WHEN h.target_id IS NULL THEN CASE WHEN m.created THEN 'protected' ELSE 'absent' END
   WHEN NOT {_OWNED} THEN 'protected' WHEN m.created THEN 'delete' WHEN h.snapshot = m.expected THEN 'delete' ELSE 'protected' END AS action,
  CASE WHEN m.attempts = 0 THEN '' WHEN h.target_id IS NULL THEN CASE WHEN m.created THEN 'TARGET_CHANGED' ELSE '' END
   WHEN NOT {_OWNED} THEN 'TARGET_CHANGED' WHEN m.created OR h.snapshot = m.expected THEN '' ELSE 'ROLLBACK_EVIDENCE_MISSING' END AS code
  FROM m LEFT JOIN h ON h.target_id = m.target_id),
u AS (SELECT DISTINCT a.target_id FROM a JOIN h ON h.parent_id = a.target_id WHERE a.action = 'delete' AND NOT EXISTS (
   SELECT 1 FROM a x WHERE x.action = 'delete' AND x.target_id = h.target_id AND x.parent_id = a.target_id))
SELECT a.target_id, CASE WHEN u.target_id IS NOT NULL THEN 'protected' ELSE a.action END AS action, CASE WHEN u.target_id IS NOT NULL THEN 'CHILDREN_PROTECTED' ELSE a.code END AS codes FROM a LEFT JOIN u USING (target_id)"""


@query("m09_plan_rollback", _ROLLBACK)
def _(t):
    return life.plan_rollback(manifest_of(t), t.sql(HELD), RUN).select("target_id", "action", F.array_join("codes", ",").alias("codes"))


@query("m10_apply_rollback", f"""
WITH p AS ({PLAN}) SELECT state, count(*) AS n, count(*) FILTER (WHERE created) AS created, CAST(0 AS BIGINT) AS left_over FROM (
  SELECT CASE WHEN status <> 'ready' THEN status ELSE 'rolled-back' END AS state, status = 'ready' AS created FROM p) GROUP BY 1""")
def _(t):
    plan = plan_of(t)
    fresh = mf.init_manifest(plan, RUN)
    ready = F.col("transfer_hash").isNotNull()
    done = (fresh.withColumn("state", F.when(ready, "verified").otherwise(F.col("state"))).withColumn("created", ready)
            .withColumn("attempts", F.when(ready, 1).otherwise(0)).withColumn("actual", F.col("expected"))
            .withColumn("deletion_hash", F.col("transfer_hash")))
    target = life.planned_rows(plan, RUN)
    entries = life.plan_rollback(done, target, RUN)
    after, rest = life.apply_rollback(done, target, entries, RUN, RUN)
    remaining = after.join(rest.select("target_id", F.lit(1).alias("_left")), "target_id", "left")
    return remaining.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if("created").alias("created"),
                                          F.count("_left").alias("left_over"))


@query("a15_summarize_plan", f"""
WITH p AS ({PLAN}) SELECT count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'excluded') AS excluded, count(*) FILTER (WHERE status = 'blocked') AS blocked FROM p""")
def _(t):
    return mf.summarize_plan(t.sql(PLAN))


@query("a15_summarize_manifest", f"""{_M}
SELECT bool_or(state IN ('failed', 'blocked', 'importing', 'pending')) AS has_failures, count(*) FILTER (WHERE created) AS created, CAST(0 AS BIGINT) AS replaced,
  count(*) FILTER (WHERE state = 'verified') AS verified, count(*) FILTER (WHERE state = 'skipped') AS skipped FROM m""")
def _(t):
    return mf.summarize_manifest(manifest_of(t))


@query("a15_summarize_rollback", f"""
WITH r AS ({_ROLLBACK}) SELECT bool_or(action = 'protected') AS has_failures, count(*) FILTER (WHERE action = 'delete') AS eligible,
  count(*) FILTER (WHERE action = 'already-rolled-back') AS rolled_back, count(*) FILTER (WHERE action = 'skip') AS skipped FROM r""")
def _(t):
    return mf.summarize_rollback(life.plan_rollback(manifest_of(t), t.sql(HELD), RUN))


FAULTY = """SELECT concat('t', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS target_id, concat('s', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS source_id,
  CASE WHEN l_linenumber > 1 THEN concat('t', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber - 1 AS STRING)) END AS parent_id,
  l_orderkey * 10 + l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'N' THEN 'pending' ELSE 'deleting' END AS state, l_tax > 0.02 AS created,
  CAST(floor(l_discount * 100) AS INT) AS attempts, CASE WHEN l_quantity > 5 THEN 'th' END AS transfer_hash, CASE WHEN l_quantity > 4 THEN 'ex' END AS expected,
  CASE WHEN l_linestatus = 'O' THEN 'ac' END AS actual, CASE WHEN l_quantity > 40 THEN 'dh' END AS deletion_hash FROM {lineitem}"""


@query("v03_validate_manifest", f"""
WITH m AS ({FAULTY}), f AS (
 SELECT target_id, 'TARGET_ID_REPEATED' AS code FROM m WHERE target_id IN (SELECT target_id FROM m GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT target_id, 'SOURCE_ID_REPEATED' FROM m WHERE source_id IN (SELECT source_id FROM m GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT m.target_id, 'PARENT_NOT_EARLIER' FROM m LEFT JOIN (SELECT target_id AS k, min(pos) AS p FROM m GROUP BY 1) x ON x.k = m.parent_id WHERE m.parent_id IS NOT NULL AND coalesce(p >= pos, true)
 UNION ALL SELECT target_id, 'EXPECTED_MISSING' FROM m WHERE expected IS NULL OR transfer_hash IS NULL
 UNION ALL SELECT target_id, 'VERIFIED_WITHOUT_EVIDENCE' FROM m WHERE state = 'verified' AND (NOT created OR actual IS NULL)
 UNION ALL SELECT target_id, 'CREATED_WITHOUT_ATTEMPT' FROM m WHERE created AND attempts = 0
 UNION ALL SELECT target_id, 'DELETION_HASH_WITHOUT_CREATION' FROM m WHERE deletion_hash IS NOT NULL AND NOT created
 UNION ALL SELECT target_id, 'ROLLBACK_INVALID' FROM m WHERE state = 'deleting'
 UNION ALL SELECT target_id, 'DELETING_INVALID' FROM m WHERE state = 'deleting' AND (NOT created OR deletion_hash IS NULL))
SELECT code, count(*) AS n, count(DISTINCT target_id) AS rows FROM f GROUP BY 1""")
def _(t):
    rows = t.sql(FAULTY).withColumn("codes", F.array().cast("array<string>")).withColumn(
        "replacement", F.lit(None).cast(mf.REPLACEMENT))
    found = mf.validate_manifest(rows, RUN)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_id").alias("rows"))


MANIFESTS = """SELECT concat('m', CAST(o_orderkey AS STRING)) AS manifest, concat('s', CAST(o_custkey AS STRING)) AS source_id, CASE WHEN o_totalprice > 400000 THEN 2 ELSE 1 END AS n_rows,
  CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'verified' END AS state, o_totalprice > 50000 AS created, CASE WHEN o_totalprice > 80000 THEN 'h' END AS deletion_hash,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'completed' END AS rollback_state, o_orderdate FROM {orders}"""


@query("w12_latest_valid_manifest", f"""
SELECT source_id, manifest FROM ({MANIFESTS}) WHERE n_rows = 1 AND rollback_state IS NULL AND state = 'verified' AND created AND deletion_hash IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY o_orderdate DESC, manifest) = 1""")
def _(t):
    rows = t.sql(MANIFESTS).withColumn("modified_at", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return mf.latest_valid_manifest(rows).select("source_id", "manifest")


ARTIFACTS = """SELECT concat('a', CAST(l_orderkey AS STRING)) AS artifact, concat('s', CAST(l_suppkey % 3 AS STRING)) AS source_id,
  CASE WHEN l_shipdate > CAST('2000-06-01' AS TIMESTAMP) THEN 'pending' WHEN l_returnflag = 'A' THEN 'verified' ELSE 'skipped' END AS state FROM {lineitem}"""


@query("w13_retention", f"""
SELECT artifact, min(source_id) AS source_id FROM ({ARTIFACTS}) GROUP BY 1 HAVING bool_and(state IN ('verified', 'skipped', 'excluded', 'blocked', 'rolled-back'))
  AND count(DISTINCT source_id) = 1 AND artifact NOT IN (SELECT concat('a', CAST(o_orderkey AS STRING)) FROM orders WHERE o_orderstatus = 'P')""")
def _(t):
    current = t.orders.filter("o_orderstatus = 'P'").select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("artifact"))
    return mf.retention(t.sql(ARTIFACTS), current)


@query("m04_apply_plan_readback", f"""
WITH RECURSIVE p AS (SELECT *, CASE WHEN pos % 31 = 3 THEN 'READBACK_INVALID' WHEN pos % 37 = 5 THEN 'PARTIAL_WRITE' WHEN pos % 41 = 7 THEN 'TARGET_CHANGED' ELSE '' END AS fault FROM ({PLAN}) q),
e AS (SELECT target_id, fault FROM p WHERE status = 'ready' AND parent_id IS NULL
  UNION ALL SELECT p.target_id, p.fault FROM e JOIN p ON p.parent_id = e.target_id WHERE p.status = 'ready' AND e.fault = '')
SELECT p.target_id, CASE WHEN status <> 'ready' THEN status WHEN e.fault = '' THEN 'verified' ELSE 'failed' END AS state,
  CASE WHEN status <> 'ready' THEN '' ELSE coalesce(e.fault, 'PARENT_MISSING') END AS codes, CASE WHEN e.target_id IS NULL THEN 0 ELSE 1 END AS attempts,
  coalesce(e.fault IN ('', 'PARTIAL_WRITE'), false) AS created, coalesce(e.fault <> 'READBACK_INVALID', false) AS stored
FROM p LEFT JOIN e USING (target_id)""")
def _(t):
    """Storage loses some sessions, cuts some short and gives some to another run; what came back decides."""
    plan = plan_of(t)
    pos = F.regexp_extract("target_id", "([0-9]+)$", 1).cast("long")

    def write(rows):
        kept = rows.filter(pos % 31 != 3)
        cut, foreign = (pos % 37 == 5), (pos % 37 != 5) & (pos % 41 == 7)
        return kept.withColumn("snapshot", F.when(cut, F.lit("cut")).otherwise(F.col("snapshot"))).withColumn(
            "run_id", F.when(foreign, F.lit("other")).otherwise(F.col("run_id")))
    empty = life.planned_rows(plan, RUN).where("false")
    after, target = life.apply_plan(mf.init_manifest(plan, RUN), plan, empty, RUN, write)
    there = target.select("target_id", F.lit(True).alias("_there"))
    return after.join(there, "target_id", "left").select(
        "target_id", "state", F.array_join("codes", ",").alias("codes"), "attempts", "created", F.coalesce("_there", F.lit(False)).alias("stored"))


@query("st03_apply_batches", f"""
WITH RECURSIVE p AS ({PLAN}), e AS (SELECT target_id FROM p WHERE status = 'ready' AND parent_id IS NULL
  UNION ALL SELECT p.target_id FROM e JOIN p ON p.parent_id = e.target_id WHERE p.status = 'ready')
SELECT p.target_id, CASE WHEN status <> 'ready' THEN status WHEN e.target_id IS NULL THEN 'failed' ELSE 'verified' END AS state,
  CASE WHEN status = 'ready' AND e.target_id IS NULL THEN 'PARENT_MISSING' ELSE '' END AS codes, CASE WHEN e.target_id IS NULL THEN 0 ELSE 1 END AS times_imported
FROM p LEFT JOIN e USING (target_id)""")
def _(t):
    """The plan arrives in four batches, children before parents too, and one part twice; the end is that of one batch."""
    import uuid

    from palaver.session import checkpoint_dir
    from palaver.streaming.apply import read_applied, read_states, stream_apply
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/palaver-stream-{uuid.uuid4().hex}"
    plan = plan_of(t)
    part = F.pmod(F.xxhash64("target_id"), F.lit(3))
    feed((plan.filter(part == i) for i in (2, 0, 2, 1)), f"{base}/in", lambda stream: stream_apply(stream, f"{base}/out", RUN, f"{base}/checkpoint"))
    applied = read_applied(t.spark, f"{base}/out").groupBy("target_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return read_states(t.spark, f"{base}/out").join(applied, "target_id", "left").select(
        "target_id", "state", F.array_join("codes", ",").alias("codes"), F.coalesce("n", F.lit(0)).alias("times_imported"))
