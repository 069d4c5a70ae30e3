"""Apply, resume, verify, replace and roll back a plan as table diffs.

The target is a table of stored sessions: target_id, parent_id, run_id, source_id,
mapping_version, snapshot (as ``expected`` in the manifest) and hash (exact content, with the owner
marker). A change of the target is a new table, never an update in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.graph import propagate_block
from palaver.operators.refs import authorize_replacement, protect_children
from palaver.session import durable

TARGET = ("target_id", "parent_id", "run_id", "source_id", "mapping_version", "snapshot", "hash")


def _with_target(manifest: DataFrame, target: DataFrame, run_id: str) -> DataFrame:
    """Manifest rows with the stored session beside them (``_`` columns) and ``owned``."""
    stored = target.select("target_id", *[F.col(c).alias(f"_{c}") for c in TARGET[2:]], F.lit(True).alias("_there"))
    joined = manifest.join(stored, "target_id", "left").withColumn("present", F.coalesce("_there", F.lit(False)))
    owned = ((F.col("_run_id") == run_id) & (F.col("_source_id") == F.col("source_id"))
             & F.col("_mapping_version").between(1, 8) & (F.col("attempts") > 0))
    return joined.withColumn("owned", F.coalesce(owned, F.lit(False)))


def _plain(df: DataFrame, manifest: DataFrame) -> DataFrame:
    return df.select(*manifest.columns)


def _codes(*codes: str) -> Column:
    return F.array(*[F.lit(code) for code in codes]).cast("array<string>")


def planned_rows(plan: DataFrame, run_id: str) -> DataFrame:
    """The target rows a plan would write, carrying the owner marker of the run."""
    return plan.filter("status = 'ready'").select(
        "target_id", "parent_id", F.lit(run_id).alias("run_id"), "source_id", F.lit(8).alias("mapping_version"),
        F.col("expected").alias("snapshot"), F.concat(F.lit("sha256:"), F.sha2(
            F.concat_ws("|", "transfer_hash", F.lit(run_id)), 256)).alias("hash"))


def check_plan(manifest: DataFrame, plan: DataFrame, run_id: str) -> None:
    """A manifest belongs to exactly this plan: same rows, same transfer hashes and snapshots."""
    now = planned_rows(plan, run_id).select("target_id", F.col("hash").alias("_h"), F.col("snapshot").alias("_s"))
    both = manifest.filter("transfer_hash IS NOT NULL").join(now, "target_id", "full")
    changed = both.filter(~F.col("transfer_hash").eqNullSafe(F.col("_h")) | ~F.col("expected").eqNullSafe(F.col("_s")))
    if not changed.isEmpty():
        raise ValueError("PLAN_CHANGED")


def resume(manifest: DataFrame, plan: DataFrame, target: DataFrame, run_id: str) -> DataFrame:
    """Verified rows whose session vanished go back to pending; an edited session stops the run."""
    check_plan(manifest, plan, run_id)
    seen = _with_target(manifest, target, run_id)
    verified = F.col("state") == "verified"
    intact = F.col("owned") & (F.col("_snapshot") == F.col("expected")) & F.coalesce(
        F.col("_hash") == F.col("deletion_hash"), F.lit(True))
    if not seen.filter(verified & F.col("present") & ~F.coalesce(intact, F.lit(False))).isEmpty():
        raise ValueError("TARGET_CHANGED")
    none = F.lit(None).cast("string")
    gone = F.col("_gone")
    return _plain(seen.withColumn("_gone", verified & ~F.col("present"))
                  .withColumn("state", F.when(gone, "pending").otherwise(F.col("state")))
                  .withColumn("created", F.when(gone, False).otherwise(F.col("created")))
                  .withColumn("codes", F.when(gone, _codes()).otherwise(F.col("codes")))
                  .withColumn("actual", F.when(gone, none).otherwise(F.col("actual")))
                  .withColumn("deletion_hash", F.when(gone, none).otherwise(F.col("deletion_hash"))), manifest)


def start_import(manifest: DataFrame, target: DataFrame, run_id: str) -> DataFrame:
    """The manifest with every row settled that needs no write, and ``importing`` on the others.

    A row is to be imported when its session is absent, was never created before, and every ancestor is
    verified or to be imported too. Store the result before writing: an interrupted run goes on from it.
    """
    seen = durable(_with_target(manifest, target, run_id))
    c = F.col
    active = c("transfer_hash").isNotNull() & (c("state") != "verified")
    matches = F.coalesce(c("_snapshot") == c("expected"), F.lit(False))
    changed = F.coalesce(c("_hash") != c("deletion_hash"), F.lit(False))
    # What a row will be if its parents are fine; a stored session does not ask for its parents.
    fine = (c("state") == "verified") & ~active | (active & c("present") & c("owned") & matches & ~changed) | (
        active & ~c("present") & ~c("created"))
    waits = active & ~c("present")
    graph = seen.select("target_id", F.when(waits, c("parent_id")).alias("parent_id"), fine.alias("ready"))
    outcome = propagate_block(graph, ready="ready").select("target_id", c("effective").alias("_fine"))
    rows = seen.join(outcome, "target_id")
    starts = active & ~c("present") & ~c("created") & c("_fine")
    orphan = active & ~c("present") & ~c("created") & ~c("_fine")
    lost = active & ~c("present") & c("created")
    kept = active & c("present") & c("owned")
    foreign = active & c("present") & ~c("owned")
    first = c("attempts") == 0
    state = (F.when(starts, "importing").when(orphan | lost, "failed")
             .when(kept, F.when(matches & ~changed, "verified").otherwise("failed"))
             .when(foreign, F.when(first, "skipped").otherwise("failed")).otherwise(c("state")))
    codes = (F.when(starts, _codes()).when(orphan, _codes("PARENT_MISSING")).when(lost, _codes("TARGET_CHANGED"))
             .when(kept, F.when(changed, _codes("TARGET_CHANGED")).when(matches, _codes()).otherwise(
                 _codes("PARTIAL_WRITE")))
             .when(foreign, F.when(first, _codes("SESSION_CONFLICT")).otherwise(_codes("TARGET_CHANGED")))
             .otherwise(c("codes")))
    actual = F.when(starts, F.lit(None).cast("string")).when(kept | foreign, c("_snapshot")).otherwise(c("actual"))
    deletion = F.when(kept & matches, F.coalesce("deletion_hash", "_hash")).otherwise(c("deletion_hash"))
    result = rows.select(
        "target_id", "source_id", "parent_id", "pos", state.alias("state"), (c("created") | kept).alias("created"),
        (c("attempts") + F.when(starts, 1).otherwise(0)).alias("attempts"), codes.alias("codes"), "transfer_hash",
        "expected", actual.alias("actual"), deletion.alias("deletion_hash"), "replacement")
    return result.select(*manifest.columns)


def finish_import(started: DataFrame, stored: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, rows to publish): every importing row judged by what storage holds of it now.

    ``stored``: the rows read back, one per session at most. A session that came back as expected is verified, an
    own one that differs is a partial write, a foreign one a changed target, an absent one an invalid
    read-back. Below a session that is not verified nothing is published and no attempt counted: the outcome
    of importing parents first, without a pass per level.
    """
    c = F.col
    seen = durable(_with_target(started, stored, run_id))
    importing = c("state") == "importing"
    back = importing & c("present") & c("owned")
    good = back & F.coalesce(c("_snapshot") == c("expected"), F.lit(False))
    if seen.filter(importing & ~good).isEmpty():
        rows = seen.withColumn("_orphan", F.lit(False))
    else:
        graph = seen.select("target_id", F.when(importing, c("parent_id")).alias("parent_id"),
                            (good | (c("state") == "verified")).alias("ready"))
        bad = propagate_block(graph, ready="ready").filter("NOT effective").select(c("target_id").alias("parent_id"))
        below = seen.filter(importing & c("parent_id").isNotNull()).join(bad, "parent_id", "left_semi").select(
            "target_id", F.lit(True).alias("_below"))
        rows = seen.join(below, "target_id", "left").withColumn("_orphan", F.coalesce("_below", F.lit(False)))
    orphan = importing & c("_orphan")
    tried = importing & ~c("_orphan")
    mine = tried & back
    state = F.when(tried & good, "verified").when(importing, "failed").otherwise(c("state"))
    codes = (F.when(orphan, _codes("PARENT_MISSING")).when(tried & good, _codes()).when(mine, _codes("PARTIAL_WRITE"))
             .when(tried & c("present"), _codes("TARGET_CHANGED")).when(tried, _codes("READBACK_INVALID")).otherwise(c("codes")))
    result = rows.select(
        "target_id", "source_id", "parent_id", "pos", state.alias("state"), (c("created") | mine).alias("created"),
        (c("attempts") - F.when(orphan, 1).otherwise(0)).alias("attempts"), codes.alias("codes"), "transfer_hash", "expected",
        F.when(mine, c("_snapshot")).otherwise(c("actual")).alias("actual"),
        F.when(mine, c("_hash")).otherwise(c("deletion_hash")).alias("deletion_hash"), "replacement")
    published = stored.select(*TARGET).join(rows.filter(tried).select("target_id"), "target_id", "left_semi")
    return result.select(*started.columns), published.select(*TARGET)


def import_rows(manifest: DataFrame, plan: DataFrame, target: DataFrame, run_id: str,
                write: Callable[[DataFrame], DataFrame] = durable) -> tuple[DataFrame, DataFrame]:
    """(manifest, new target rows) after writing what may be imported and reading it back.

    ``write`` stores target rows and returns what the storage holds of them afterwards.
    """
    started = durable(start_import(manifest, target, run_id))
    chosen = started.filter("state = 'importing'").select("target_id")
    stored = write(planned_rows(plan, run_id).join(chosen, "target_id", "left_semi").select(*TARGET))
    return finish_import(started, stored, run_id)


def apply_plan(manifest: DataFrame, plan: DataFrame, target: DataFrame, run_id: str,
               write: Callable[[DataFrame], DataFrame] = durable) -> tuple[DataFrame, DataFrame]:
    """(manifest, target) after importing everything that may be imported, idempotently.

    Rows are marked importing, written, read back and only then verified or failed. The ancestors are
    followed by pointer doubling, so one pass settles the whole forest.
    """
    after, new = import_rows(manifest, plan, target, run_id, write)
    return after, target.select(*TARGET).unionByName(new)


def verify(manifest: DataFrame, target: DataFrame, run_id: str) -> DataFrame:
    """State and codes of every row as the target shows them now."""
    seen = _with_target(manifest, target, run_id)
    c = F.col
    tried = c("attempts") > 0
    removed = c("state").isin("deleting", "rolled-back")
    gone = (c("state") == "rolled-back") & ~c("present")
    good = c("owned") & F.coalesce(c("_snapshot") == c("expected"), F.lit(False))
    state = (F.when(~tried, c("state")).when(removed, F.when(gone, "rolled-back").otherwise("failed"))
             .when(good, "verified").otherwise("failed"))
    codes = F.when(~tried, c("codes")).when(F.when(removed, gone).otherwise(good), _codes()).otherwise(
        _codes("RECONCILIATION_FAILED"))
    return seen.select("target_id", state.alias("state"), codes.alias("codes"))


def has_failures(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or(F.col("state").isin("failed", "pending", "importing", "blocked")),
                                 F.lit(False)).alias("has_failures"))


def target_matches(previous: dict, current: dict, manifest: DataFrame, target: DataFrame, run_id: str,
                   layout_of=lambda version: version.split(".")[0]) -> bool:
    """Whether a run may go on against ``current``: the same descriptor, or a compatible one that
    still shows an untouched session of the run, or shows no planned session at all."""
    if previous == current:
        return True
    layouts = {layout_of(d[k]) for d in (previous, current) for k in ("binary_version", "server_version")}
    compatible = (len(layouts) == 1 and previous["schema_hash"] == current["schema_hash"]
                  and previous.get("protocol_hash", current.get("protocol_hash")) == current.get("protocol_hash"))
    if not compatible:
        return False
    evidence = target_evidence(manifest, target, run_id).first()
    return bool(evidence["proven"]) or not bool(evidence["any_present"])


def target_evidence(manifest: DataFrame, target: DataFrame, run_id: str) -> DataFrame:
    """One row: is any session proven unchanged, and is any planned session present."""
    seen = _with_target(manifest, target, run_id)
    proof = (F.col("state") == "verified") & F.col("created") & F.col("owned") & (
        F.col("_snapshot") == F.col("expected")) & (F.col("_hash") == F.col("deletion_hash"))
    return seen.agg(F.coalesce(F.bool_or(proof), F.lit(False)).alias("proven"),
                    F.coalesce(F.bool_or("present"), F.lit(False)).alias("any_present"))


def plan_replacement(manifest: DataFrame, prior: DataFrame, target: DataFrame, prior_run: str,
                     ) -> tuple[DataFrame, DataFrame]:
    """(manifest, deletions): pending rows take over verified rows of an earlier run.

    Everything is checked before anything is deleted: authorisation, exact content, and that no
    child outside the selection hangs below. Deletions are ordered children first.
    """
    good, refused = authorize_replacement(manifest, prior, prior_run)
    good = durable(good)
    if not refused.isEmpty() or good.isEmpty():
        raise ValueError("REPLACEMENT_INVALID")
    picked = good.select("target_id", "source_id", "parent_id", "pos", "replacement", F.lit(1).alias("attempts"))
    seen = durable(_with_target(picked, target, prior_run))
    exact = F.col("owned") & (F.col("_hash") == F.col("replacement.deletion_hash"))
    if not seen.filter(F.col("present") & ~F.coalesce(exact, F.lit(False))).isEmpty():
        raise ValueError("TARGET_CHANGED")
    here = seen.filter("present")
    children = target.filter("parent_id IS NOT NULL").select("target_id", "parent_id").join(
        here.select(F.col("target_id").alias("parent_id")), "parent_id", "left_semi")
    # A selected child may be gone already; an extra or moved child may not exist.
    if not protect_children(picked.select("target_id", "parent_id"), children).isEmpty():
        raise ValueError("CHILDREN_PROTECTED")
    deletions = here.select("target_id", "pos").orderBy(F.desc("pos"))
    replaced = good.select("target_id", F.col("replacement").alias("_new"))
    updated = manifest.join(replaced, "target_id", "left").withColumn(
        "replacement", F.when(F.col("_new").isNotNull(), F.struct(
            F.col("_new.run_id").alias("run_id"), F.col("_new.deletion_hash").alias("deletion_hash"),
            F.lit("deleted").alias("state"))).otherwise(F.col("replacement"))).select(*manifest.columns)
    return updated, deletions


def delete_sessions(target: DataFrame, deletions: DataFrame) -> DataFrame:
    """The target without the listed sessions, as a new table."""
    return target.join(deletions.select("target_id"), "target_id", "left_anti").select(*target.columns)


def plan_rollback(manifest: DataFrame, target: DataFrame, run_id: str) -> DataFrame:
    """(target_id, pos, action, codes): delete, absent, already-rolled-back, skip or protected."""
    seen = durable(_with_target(manifest, target, run_id))
    c = F.col
    skip = c("replacement").isNotNull() | (c("attempts") == 0) | (c("state") == "skipped")
    known_absent = ~c("created") | c("state").isin("deleting", "rolled-back")
    same_hash = F.coalesce(c("_hash") == c("deletion_hash"), F.lit(False))
    recoverable = ~c("created") & F.coalesce(c("_snapshot") == c("expected"), F.lit(False))
    code = (F.when(skip, F.lit(None).cast("string"))
            .when(~c("present"), F.when(~known_absent, "TARGET_CHANGED"))
            .when(~c("owned") | (c("state") == "rolled-back"), "TARGET_CHANGED")
            .when(c("deletion_hash").isNotNull(), F.when(~same_hash, "TARGET_CHANGED"))
            .when(~recoverable, "ROLLBACK_EVIDENCE_MISSING"))
    action = (F.when(skip, "skip").when(code.isNotNull(), "protected")
              .when(~c("present"), F.when(c("state") == "rolled-back", "already-rolled-back").otherwise("absent"))
              .otherwise("delete"))
    rows = seen.select("target_id", "parent_id", "pos", action.alias("action"), code.alias("code"))
    selected = rows.filter("action = 'delete'").select("target_id", "parent_id")
    children = target.filter("parent_id IS NOT NULL").select("target_id", "parent_id").join(
        selected.select(F.col("target_id").alias("parent_id")), "parent_id", "left_semi")
    unsafe = protect_children(selected, children).select("target_id", F.lit(True).alias("_unsafe"))
    both = rows.join(unsafe, "target_id", "left")
    risky = F.coalesce("_unsafe", F.lit(False))
    final = F.when(risky, "CHILDREN_PROTECTED").otherwise(c("code"))
    return both.select("target_id", "pos", F.when(risky, "protected").otherwise(c("action")).alias("action"),
                       F.when(final.isNotNull(), F.array(final)).otherwise(_codes()).alias("codes"))


def apply_rollback(manifest: DataFrame, target: DataFrame, entries: DataFrame, run_id: str, confirm: str,
                   ) -> tuple[DataFrame, DataFrame]:
    """(manifest, target) after the rollback; needs the exact run id and a graph without protected rows."""
    if confirm != run_id:
        raise ValueError("CONFIRMATION_REQUIRED")
    if not entries.filter("action = 'protected'").isEmpty():
        raise ValueError("ROLLBACK_PROTECTED")
    done = entries.filter("action IN ('delete', 'absent')").select("target_id", F.col("action").alias("_action"))
    rest = delete_sessions(target, done.filter("_action = 'delete'"))
    evidence = target.select("target_id", F.col("hash").alias("_hash"))
    rows = manifest.join(done, "target_id", "left").join(evidence, "target_id", "left")
    removed, deleted = F.col("_action").isNotNull(), F.col("_action") == "delete"
    updated = (rows.withColumn("state", F.when(removed, "rolled-back").otherwise(F.col("state")))
               .withColumn("codes", F.when(removed, _codes()).otherwise(F.col("codes")))
               .withColumn("created", F.col("created") | F.coalesce(deleted, F.lit(False)))
               .withColumn("deletion_hash", F.when(deleted, F.col("_hash")).otherwise(F.col("deletion_hash"))))
    return updated.select(*manifest.columns), rest
