"""The scalar functions as temporary SQL functions, so SQL users run no Python either."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name -> (parameters, return type, SQL body)
SQL_FUNCTIONS = {
    "canonical_json": ("j STRING", "STRING", "to_json(try_parse_json(j))"),
    "content_hash": ("t STRING", "STRING", "concat('sha256:', sha2(t, 256))"),
    "stable_session_id": (
        "ns STRING, id STRING", "STRING",
        "CASE WHEN id <> '' THEN concat('ses_imp_', sha2(to_json(array('transcript-id-v1', ns, 'session', id)), 256)) END"),
    "stable_message_id": (
        "ns STRING, session STRING, id STRING, ord BIGINT", "STRING",
        "CASE WHEN session <> '' AND id <> '' AND ord >= 0 THEN concat('msg_000000000000', lpad(lower(hex(ord)), 16, '0'),"
        " '_imp_', sha2(to_json(array('transcript-id-v1', ns, 'message', session, id)), 256)) END"),
    "tool_status": (
        "s STRING", "STRING",
        "coalesce(try_element_at(map('success', 'completed', 'failed', 'error', 'running', 'running'), s), 'unknown')"),
    "epoch_ms_of_seconds": (
        "s STRING", "BIGINT",
        "CASE WHEN s RLIKE '^[0-9]+$' AND try_cast(s AS BIGINT) <= 9007199254740 THEN try_cast(s AS BIGINT) * 1000 END"),
    "utf8_bytes": ("t STRING", "INT", "octet_length(t)"),
    "session_label": (
        "title STRING", "STRING",
        "coalesce(nullif(trim(regexp_replace(title, '\\\\s+', ' ')), ''), 'Untitled session')"),
    "release": (
        "t STRING", "STRING",
        "nullif(regexp_extract(trim(t), '^(?:[a-z][a-z0-9-]* v?)?([0-9]{1,5}[.][0-9]{1,5}[.][0-9]{1,5}"
        "(?:-[a-zA-Z0-9.-]{1,40})?)$', 1), '')"),
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions for this session and return their names."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in SQL_FUNCTIONS]
