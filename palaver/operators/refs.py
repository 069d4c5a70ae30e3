"""Joins that follow references between the tables of a bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_replies(events: DataFrame) -> DataFrame:
    """Assistant events with ``reply_ok``: the target is an earlier user event of the session.

    When an id occurs twice in a session the last array element counts.
    """
    # Order and role share one number, so the aggregation keeps two numbers per id and can hash.
    packed = F.col("ord") * 2 + (F.col("type") == "user").cast("bigint")
    targets = (events.groupBy("session_id", F.col("event_id").alias("reply_to"))
               .agg(F.max_by(packed, "pos").alias("_t")))
    assistants = events.filter("type = 'assistant'")
    linked = assistants.filter("reply_to IS NOT NULL").join(targets, ["session_id", "reply_to"], "left")
    good = (F.pmod("_t", F.lit(2)) == 1) & (F.shiftright("_t", 1) < F.col("ord"))
    linked = linked.withColumn("reply_ok", F.coalesce(good, F.lit(False))).select(*events.columns, "reply_ok")
    return linked.unionByName(assistants.filter("reply_to IS NULL").withColumn("reply_ok", F.lit(False)))


def with_reply_state(events: DataFrame) -> DataFrame:
    """All events with ``reply_ok``, which is NULL for users."""
    return link_replies(events).unionByName(
        events.filter("type <> 'assistant'").withColumn("reply_ok", F.lit(None).cast("boolean")))


def missing_refs(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (present) reference has no parent row."""
    parents = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(parents, child_key, "left_anti")


def join_reads(metadata: DataFrame, reads: DataFrame, digest: str = "digest",
               ) -> tuple[DataFrame, DataFrame]:
    """(sessions, contradictions): every id with its metadata and read state.

    ``metadata`` and ``reads`` both carry session_id and ``digest``; ``reads`` adds status and
    expected. Equal repeats collapse, unequal ones are contradictions (the caller sets those sessions aside).
    """
    def one_row(df: DataFrame, kind: str) -> DataFrame:
        rest = [c for c in df.columns if c != "session_id"]
        return df.groupBy("session_id").agg(
            (F.min(digest) != F.max(digest)).alias("clash"),
            F.min_by(F.struct(*rest), digest).alias(kind))
    meta, read = one_row(metadata, "meta"), one_row(reads, "read")
    contradictions = (meta.filter("clash").select("session_id", F.lit("metadata").alias("kind"))
                      .unionByName(read.filter("clash").select("session_id", F.lit("read").alias("kind"))))
    joined = (meta.drop("clash").join(read.drop("clash"), "session_id", "full")
              .withColumn("has_metadata", F.col("meta").isNotNull())
              .withColumn("read_status", F.coalesce("read.status", F.lit("unavailable")))
              .withColumn("expected", F.when(F.col("read.status") == "available", F.col("read.expected"))))
    return joined, contradictions


def resolve_project(sessions: DataFrame, workspace_projects: DataFrame) -> DataFrame:
    """The project of a session when its workspaces name exactly one; else NULL.

    ``sessions``: session_id, workspace_id (one row per pair); ``workspace_projects``:
    workspace_id, project_id. Only least and greatest id are kept, never a list.
    """
    pairs = sessions.select("session_id", "workspace_id").distinct().join(
        workspace_projects.select("workspace_id", "project_id").distinct(), "workspace_id", "left")
    found = pairs.groupBy("session_id").agg(F.min("project_id").alias("_a"), F.max("project_id").alias("_b"))
    return found.select("session_id", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("project_id"))


def associate_resources(resources: DataFrame, refs: DataFrame, sessions: DataFrame,
                        ) -> tuple[DataFrame, DataFrame]:
    """(linked, unassociated): resources of a session, only by explicit reference to it."""
    known = refs.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    pairs = known.select("resource_id", "session_id").distinct()
    linked = resources.join(pairs, "resource_id")
    unassociated = (resources.join(pairs, "resource_id", "left_anti")
                    .withColumn("code", F.lit("RESOURCE_UNASSOCIATED"))
                    .withColumn("severity", F.lit("warning")))
    return linked, unassociated


def diagnostics_by_session(diagnostics: DataFrame, sessions: DataFrame, events: DataFrame, resources: DataFrame,
                           blocking: Column | None = None, excused: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sessions, bundle_level): what is known against each session, one row a session.

    ``diagnostics``: id, code, severity, subject_type, subject_id, ref_sessions array<string>. A session is concerned by issues about
    itself, its project, its events and its resources, and by those that refer to it; an issue counts once. Issues are
    summed up per subject before any join, so a session meets one row for each of its subjects, however many issues that has and
    however many sessions share it. Columns: session_id, n_issues, n_errors, codes (a fixed list gives them), blocked (any
    ``blocking`` issue), and of the ``excused`` ones about the session itself: own_codes and own_blocked, which are not in blocked.
    Bundle-level rows concern every session; they stay one table. NULL subjects and sessions meet nobody.
    """
    blocking = F.coalesce(F.col("severity") == "error" if blocking is None else blocking, F.lit(False))
    excused = F.coalesce(F.lit(False) if excused is None else excused, F.lit(False))
    general = F.col("subject_type").isNull() | (F.col("subject_type") == "bundle")
    fields = ["id", "code", "severity", "subject_type", "subject_id"]
    own = diagnostics.filter(~general).withColumns({"_blocks": blocking, "_excused": excused & (F.col("subject_type") == "session")})
    own = own.dropDuplicates(["id"])

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        out = F.col("_excused")
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_issues"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.collect_set("code").alias("codes"),
            F.bool_or(F.col("_blocks") & ~out).alias("blocked"), F.collect_set(F.when(out, F.col("code"))).alias("own_codes"),
            F.bool_or(F.col("_blocks") & out).alias("own_blocked"))

    subjects = None
    for kind, table, column in (("session", sessions, "session_id"), ("project", sessions, "project_id"),
                                ("event", events, "event_id"), ("resource", resources, "resource_id")):
        part = table.filter(F.col("session_id").isNotNull() & F.col(column).isNotNull()).select(
            "session_id", F.lit(kind).alias("subject_type"), F.col(column).alias("subject_id"))
        subjects = part if subjects is None else subjects.unionByName(part)
    subjects = subjects.distinct()
    by_subject = subjects.join(summed(own, "subject_type", "subject_id"), ["subject_type", "subject_id"]).drop("subject_type", "subject_id")
    # A reference adds an issue only where no subject of the session did; about another session nothing is excused.
    named = own.withColumn("session_id", F.explode(F.array_distinct("ref_sessions"))).withColumn("_excused", F.lit(False))
    named = named.join(subjects, ["session_id", "subject_type", "subject_id"], "left_anti").join(
        sessions.select("session_id").distinct(), "session_id", "left_semi")
    both = by_subject.unionByName(summed(named, "session_id"))
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))  # noqa: E731 sets of codes from a fixed list
    found = both.groupBy("session_id").agg(
        F.sum("n_issues").alias("n_issues"), F.sum("n_errors").alias("n_errors"), union("codes").alias("codes"),
        F.bool_or("blocked").alias("blocked"), union("own_codes").alias("own_codes"), F.bool_or("own_blocked").alias("own_blocked"))
    return found, diagnostics.filter(general).select(*fields)


def issues_to_events(issues: DataFrame, events: DataFrame, raw_refs: DataFrame) -> DataFrame:
    """Every issue with the references of its event if that survived, else of the raw response.

    ``raw_refs``: session_id, raw_refs.
    """
    targets = events.groupBy("session_id", F.col("event_id").alias("message_id")).agg(
        F.max_by("refs", "pos").alias("_event_refs"))
    named = issues.filter("message_id IS NOT NULL").join(targets, ["session_id", "message_id"], "left")
    both = named.unionByName(issues.filter("message_id IS NULL"), allowMissingColumns=True)
    return (both.join(raw_refs.select("session_id", "raw_refs"), "session_id", "left")
            .withColumn("refs", F.coalesce("_event_refs", "raw_refs"))
            .drop("_event_refs", "raw_refs"))


def protect_children(selected: DataFrame, target_children: DataFrame) -> DataFrame:
    """Selected ids with a real child outside the selection, or one planned under another parent.

    ``selected``: target_id, parent_id; ``target_children``: target_id, parent_id (as stored).
    """
    stray = target_children.join(selected.select("target_id", "parent_id"), ["target_id", "parent_id"],
                                 "left_anti")
    parents = stray.select(F.col("parent_id").alias("target_id")).distinct()
    return selected.join(parents, "target_id", "left_semi").withColumn("code", F.lit("CHILDREN_PROTECTED"))


def owned_by_run(target: DataFrame, manifest: DataFrame, run_id: str | Column) -> DataFrame:
    """Manifest rows with their stored session and ``owned``: written by this run for this source."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    stored = target.select("target_id", F.col("run_id").alias("_run"), F.col("source_id").alias("_source"),
                           F.col("mapping_version").alias("_version"))
    owned = ((F.col("_run") == run) & (F.col("_source") == F.col("source_id"))
             & F.col("_version").between(1, 8) & (F.col("attempts") > 0))
    return (manifest.join(stored, "target_id")
            .withColumn("owned", F.coalesce(owned, F.lit(False))).drop("_run", "_source", "_version"))


def authorize_replacement(new: DataFrame, prior: DataFrame, prior_run: str) -> tuple[DataFrame, DataFrame]:
    """(replacements, refused): pending rows that have a prior row, and those whose prior is unfit."""
    before = prior.select("target_id", *[F.col(c).alias(f"_{c}") for c in
                                         ("source_id", "parent_id", "state", "created", "deletion_hash")])
    fit = ((F.col("_state") == "verified") & F.col("_created") & F.col("_deletion_hash").isNotNull()
           & (F.col("_source_id") == F.col("source_id"))
           & F.col("_parent_id").eqNullSafe(F.col("parent_id")))
    pairs = (new.filter("state = 'pending'").join(before, "target_id")
             .withColumn("_fit", F.coalesce(fit, F.lit(False))))
    plain = [column for column in new.columns if column != "replacement"]
    good = pairs.filter("_fit").select(*plain, F.struct(
        F.lit(prior_run).alias("run_id"), F.col("_deletion_hash").alias("deletion_hash"),
        F.lit("pending").alias("state")).alias("replacement"))
    return good, pairs.filter("NOT _fit").select(*plain)


def key_union(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The keys that occur on either side."""
    return left.select(*columns).union(right.select(*columns)).distinct()


def union_events(users: DataFrame, assistants: DataFrame) -> DataFrame:
    """Both roles as one table; columns of one role are NULL for the other."""
    return users.withColumn("type", F.lit("user")).unionByName(
        assistants.withColumn("type", F.lit("assistant")), allowMissingColumns=True)


def union_diagnostics(*tables: DataFrame) -> DataFrame:
    """All diagnostics, one row per id."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged.dropDuplicates(["id"])


def sort_sessions(sessions: DataFrame) -> DataFrame:
    """Newest update first, then newest creation, unknown times last."""
    return sessions.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), "session_id")


def sort_messages(messages: DataFrame) -> DataFrame:
    """Session, order, creation, id: a range-partitioned sort, so a long session spreads out."""
    return messages.orderBy("session_id", "ord", "created_at", "message_id")


def select_sessions(tables: dict[str, DataFrame], session: str | None = None, project: str | None = None,
                    platform: str = "linux") -> dict[str, DataFrame]:
    """The bundle reduced to one session and/or project, with what these refer to."""
    from palaver.functions.paths import normalize_path, path_key
    if session is None and project is None:
        return dict(tables)
    sessions = tables["sessions"]
    if session is not None:
        sessions = sessions.filter(F.col("session_id") == session)
    if project is not None:
        sessions = sessions.filter(
            path_key(normalize_path(F.col("project_path"), platform), platform)
            == path_key(normalize_path(F.lit(project), platform), platform))
    if sessions.isEmpty():
        raise ValueError("SELECTION_EMPTY")
    ids = sessions.select("session_id")
    result = {name: table.join(ids, "session_id", "left_semi")
              if "session_id" in table.columns and name != "sessions" else table
              for name, table in tables.items()}
    result["sessions"] = sessions
    if "projects" in tables:
        result["projects"] = tables["projects"].join(sessions.select("project_id"), "project_id", "left_semi")
    if "diagnostics" in tables:
        diagnostics = tables["diagnostics"]
        other = diagnostics.filter(F.coalesce(F.col("subject_type") != "session", F.lit(True)))
        kept = diagnostics.filter("subject_type = 'session'").join(
            ids.withColumnRenamed("session_id", "subject_id"), "subject_id", "left_semi")
        result["diagnostics"] = other.unionByName(kept)
    return result
