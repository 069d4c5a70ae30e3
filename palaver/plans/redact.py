"""Removing credentials from a whole bundle before it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.credentials import MARKER
from palaver.operators.payload import has_credentials_nested, redact_columns, redact_payloads
from palaver.session import durable


def _clean_text(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One text column redacted; a text with a hit that only shows when opened is masked."""
    plain = durable(redact_columns(df, [column]))
    left = has_credentials_nested(plain, keys, column, "_left")
    return left.withColumn(column, F.when(F.col("_left"), F.lit(MARKER)).otherwise(F.col(column))).withColumn(
        "redacted_count", F.col("redacted_count") + F.col("_left").cast("bigint")).drop("_left")


def redact_bundle(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, counts): titles, texts, reasoning and tool payloads without recognised credentials.

    Ids and paths stay as they are. A session that lost a value is complete no more, and gets a
    warning. ``counts``: session_id, redacted_count.
    """
    result = dict(tables)
    found = []

    def clean(name: str, keys: list[str], texts: list[str], payloads: list[str]) -> None:
        table = tables[name]
        total = F.lit(0).cast("bigint")
        for column, work in [(c, _clean_text) for c in texts] + [(c, redact_payloads) for c in payloads]:
            table = work(table, keys, column).withColumnRenamed("redacted_count", f"_n_{column}")
            total = total + F.col(f"_n_{column}")
        table = durable(table.withColumn("_n", total))
        found.append(table.filter("_n > 0").groupBy("session_id").agg(F.sum("_n").alias("redacted_count")))
        result[name] = table.select(*tables[name].columns)
    clean("sessions", ["session_id"], ["title"], [])
    clean("events", ["session_id", "pos"], ["text"], [])
    clean("blocks", ["session_id", "event_id", "pos"], ["text"], ["input", "output", "error"])
    counts = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("session_id").agg(
        F.sum("redacted_count").alias("redacted_count"))
    counts = durable(counts)
    touched = counts.select("session_id", F.lit(True).alias("_touched"))
    result["sessions"] = result["sessions"].join(touched, "session_id", "left").withColumn(
        "recovery", F.when(F.col("_touched") & (F.col("recovery") == "complete"), "partial").otherwise(
            F.col("recovery"))).select(*tables["sessions"].columns)
    if "diagnostics" in tables:
        code = F.lit("CREDENTIALS_REDACTED")
        notes = counts.select(
            F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(code, "session_id")), 256)).alias("id"),
            F.lit("warning").alias("severity"), code.alias("code"), F.lit("session").alias("subject_type"),
            F.col("session_id").alias("subject_id"))
        result["diagnostics"] = tables["diagnostics"].unionByName(notes, allowMissingColumns=True)
    return result, counts
