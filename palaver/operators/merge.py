"""Merging competing observations of one thing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.session import durable


def merge_tool_observations(obs: DataFrame, key: Sequence[str] = ("session_id", "message_id", "call_id"),
                            ) -> tuple[DataFrame, DataFrame]:
    """(calls, conflicts): the observations of every tool call merged, terminal states first.

    The columns of ``obs`` are those of ``tool_states``.
    """
    key = list(key)
    merged = _merged(obs, key)
    calls = merged.filter(~F.col("_conflict")).select(
        *key, "entry_index", "n_observations", *[F.col("_best")[c].alias(c) for c in RESULT], *TIMES)
    conflicts = merged.filter("_conflict").select(*key, "n_observations", _code().alias("code"), F.lit("error").alias("severity"))
    return calls, conflicts


RESULT = ("name", "input", "status", "output", "error")
TIMES = ("generated_at", "started_at", "completed_at")


def tool_states(obs: DataFrame, key: Sequence[str] = ("session_id", "message_id", "call_id")) -> DataFrame:
    """One row per tool call: the merged call, or a code and no values where observations contradict each other.

    Columns besides the key: entry_index, name, input, status, output, error (JSON text),
    generated_at, started_at, completed_at, and ``invalid`` for a payload that cannot be kept.
    Observations are compared in entry order without a window: each rule is a minimum or maximum,
    so a call with very many observations still aggregates on the map side, and a stream keeps one row of
    state per call.
    """
    key = list(key)
    fine = ~F.col("_conflict")
    return _merged(obs, key).select(
        *key, "n_observations", F.when(F.col("_conflict"), _code()).alias("code"), F.when(fine, F.col("entry_index")).alias("entry_index"),
        *[F.when(fine, F.col("_best")[c]).alias(c) for c in RESULT], *[F.when(fine, F.col(c)).alias(c) for c in TIMES])


def _code() -> Column:
    return F.when(F.col("_invalid"), "TOOL_PAYLOAD_INVALID").otherwise("TOOL_CONFLICT")


def _merged(obs: DataFrame, key: list[str]) -> DataFrame:
    """One row per call with the merged values and ``_conflict``."""
    terminal = F.col("status").isin("completed", "error")
    running = F.col("status") == "running"
    payload = F.sha2(F.to_json(F.struct("status", "output", "error")), 256)
    rank = F.when(terminal, 2).when(running, 1).otherwise(0)
    # The last terminal wins, else the last running, else the first of the unknown ones.
    turn = F.when(terminal | running, F.col("entry_index")).otherwise(-F.col("entry_index"))
    own_start = F.coalesce("started_at", "generated_at")
    rows = (obs.withColumn("completed_at", F.when(~F.coalesce(F.col("completed_at") < own_start, F.lit(False)),
                                                  F.col("completed_at")))
            .withColumn("_terminal", F.when(terminal, payload)))
    aggregates = [
        F.count(F.lit(1)).alias("n_observations"), F.min("entry_index").alias("entry_index"),
        F.bool_or("invalid").alias("_invalid"),
        (F.min("name") != F.max("name")).alias("_name"), (F.min("input") != F.max("input")).alias("_input"),
        F.coalesce(F.min("_terminal") != F.max("_terminal"), F.lit(False)).alias("_result"),
        F.max_by(F.struct(*RESULT),
                 F.struct(rank, turn)).alias("_best"),
    ]
    for name in TIMES:
        seen = F.when(F.col(name).isNotNull(), F.col("entry_index"))
        aggregates += [F.min(name).alias(name), F.min(seen).alias(f"_at_{name}"),
                       F.coalesce(F.min(name) != F.max(name), F.lit(False)).alias(f"_differs_{name}")]
    merged = rows.groupBy(*key).agg(*aggregates)
    conflict = (F.col("_invalid") | F.col("_name") | F.col("_input") | F.col("_result")
                | _any([F.col(f"_differs_{n}") for n in TIMES]) | _bad_prefix())
    return merged.withColumn("_conflict", F.coalesce(conflict, F.lit(False)))


def _any(flags: Sequence[Column]) -> Column:
    result = flags[0]
    for flag in flags[1:]:
        result = result | flag
    return result


def _bad_prefix() -> Column:
    """An end before its start after any number of observations, not only after the last.

    The start of a prefix is started_at once seen, until then generated_at. So a pair is wrong
    when the end precedes started_at, or precedes generated_at while started_at was still unseen.
    """
    end, started, generated = F.col("completed_at"), F.col("started_at"), F.col("generated_at")
    both_known = F.greatest(F.col("_at_generated_at"), F.col("_at_completed_at"))
    unseen = F.coalesce(F.col("_at_started_at") > both_known, F.lit(True))
    return F.coalesce(end < started, F.lit(False)) | F.coalesce((end < generated) & unseen, F.lit(False))


def survivorship(candidates: DataFrame, fields: Sequence[str], key: Sequence[str] = ("session_id",),
                 priority: str = "priority", created: str = "created_at", updated: str = "updated_at",
                 required: Sequence[str] = ("title", "created_at", "updated_at"),
                 ) -> tuple[DataFrame, DataFrame]:
    """(records, issues): per key and field the value of the highest priority that has one.

    Two values at that priority are an error and give NULL. A missing required field is a warning.
    """
    key = list(key)
    aggregates = []
    for name in fields:
        has = F.col(name).isNotNull()
        # Best priority with the greatest value, and best priority with the least value.
        aggregates += [F.max(F.when(has, F.struct(F.col(priority).alias("p"), F.col(name).alias("v"))))
                       .alias(f"_high_{name}"),
                       F.min(F.when(has, F.struct((-F.col(priority)).alias("p"), F.col(name).alias("v"))))
                       .alias(f"_low_{name}")]
    extra = [F.bool_or("has_error").alias("_error")] if "has_error" in candidates.columns else []
    merged = candidates.groupBy(*key).agg(*aggregates, *extra)
    columns, issues = [], []
    for name in fields:
        high, low = F.col(f"_high_{name}")["v"], F.col(f"_low_{name}")["v"]
        clash = F.coalesce(high != low, F.lit(False))
        columns.append(F.when(~clash, high).alias(name))
        issues.append(_issue(clash, "METADATA_CONFLICT", "error", name))
    chosen = merged.select(*key, *columns, *(["_error"] if extra else []),
                           F.array(*issues).alias("_clashes"))
    late = [_issue(F.col(name).isNull(), f"{name.upper()}_MISSING", "warning", name) for name in required]
    if created in fields and updated in fields:
        late.append(_issue(F.coalesce(F.col(updated) < F.col(created), F.lit(False)),
                           "TIMESTAMP_ORDER_INVALID", "error", None))
    found = F.filter(F.concat("_clashes", F.array(*late)), lambda i: i.isNotNull())
    wrong = F.exists("issues", lambda i: i["severity"] == "error")
    if extra:
        wrong = wrong | F.col("_error")
    records = chosen.withColumn("issues", found).withColumn(
        "status", F.when(wrong, "invalid").when(F.size("issues") > 0, "partial").otherwise("complete"))
    return (records.select(*key, *fields, "status"),
            records.select(*key, F.explode("issues").alias("i")).select(*key, "i.*"))


def _issue(condition: Column, code: str, severity: str, name: str | None) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                                      F.lit(name).cast("string").alias("field")))


def dedup_projects(paths: DataFrame, platform: str) -> DataFrame:
    """One project per path key (lower case on Windows); the smallest path represents it."""
    return (paths.groupBy(project_id(F.col("path"), platform).alias("project_id"))
            .agg(F.min("path").alias("path"), F.count_distinct("workspace_id").alias("n_workspaces")))


def project_id(path: Column, platform: str) -> Column:
    """Identity of a project path, the same for every workspace that names it."""
    folded = F.lower(path) if platform == "win32" else path
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(
        F.lit(platform).alias("platform"), folded.alias("path"))), 256))


def merge_pages(pages: DataFrame, id_col: str = "item_id", check_total: bool = False,
                ) -> tuple[DataFrame, DataFrame]:
    """(items, rejected): overlapping pages of every session read joined into one list of items.

    ``pages``: session_id, page_no, code, items array<struct<item_id, owner_id, digest, ...>>,
    next_token, has_more, total. An item repeated alike counts once, at its first place. Any fault
    rejects the whole session: another hash for an id, a foreign or empty id, a token used twice,
    an empty page that continues, ``has_more`` against the token, pages after the end, or a total
    that changes or does not match.
    """
    token = F.nullif(F.col("next_token"), F.lit(""))
    continues = token.isNotNull()
    page_fault = F.coalesce(F.col("code") != 0, F.lit(True)) | F.col("items").isNull() | F.when(
        continues, (F.size("items") == 0) | ~F.coalesce("has_more", F.lit(True))
        | (F.length(token) > 4096)).otherwise(F.coalesce("has_more", F.lit(False)))
    checked = pages.withColumn("_fault", page_fault).withColumn("_token", token)
    per_session = checked.groupBy("session_id").agg(
        F.bool_or("_fault").alias("_fault"), F.max("page_no").alias("_last"),
        F.min(F.when(F.col("_token").isNull(), F.col("page_no"))).alias("_end"),
        F.count("page_no").alias("_pages"), F.count_distinct("page_no").alias("_numbers"),
        F.count("_token").alias("_tokens"), F.count_distinct("_token").alias("_distinct"),
        F.min("total").alias("_low"), F.max("total").alias("_total"))
    items = checked.select("session_id", "page_no", F.posexplode("items").alias("item_no", "item")) \
        .select("session_id", "page_no", "item_no", "item.*")
    bad_item = ((F.col("owner_id") != F.col("session_id")) | F.coalesce(F.col(id_col) == "", F.lit(True)))
    rest = [c for c in items.columns if c not in ("session_id", id_col)]
    unique = durable(items.withColumn("_bad", F.coalesce(bad_item, F.lit(True))).groupBy("session_id", id_col).agg(
        F.min("digest").alias("_dl"), F.max("digest").alias("_dh"), F.bool_or("_bad").alias("_bad"),
        F.min_by(F.struct(*rest), F.struct("page_no", "item_no")).alias("_row")))
    item_faults = unique.groupBy("session_id").agg(
        F.bool_or(F.col("_bad") | (F.col("_dl") != F.col("_dh"))).alias("_items"),
        F.count(F.lit(1)).alias("_n"))
    broken = (F.col("_fault") | (F.col("_tokens") != F.col("_distinct")) | F.col("_end").isNull()
              | (F.col("_end") != F.col("_last")) | (F.col("_pages") != F.col("_numbers"))
              | F.coalesce("_items", F.lit(False)))
    if check_total:
        broken = broken | F.coalesce((F.col("_low") != F.col("_total"))
                                     | (F.col("_total") != F.coalesce("_n", F.lit(0))), F.lit(False))
    verdict = per_session.join(item_faults, "session_id", "left").withColumn("_broken", broken)
    rejected = durable(verdict.filter("_broken").select("session_id", F.lit("READ_REJECTED").alias("code")))
    kept = (unique.select("session_id", id_col, *[F.col("_row")[c].alias(c) for c in rest])
            .join(rejected, "session_id", "left_anti"))
    return kept, rejected
