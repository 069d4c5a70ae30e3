"""Named queries over a folder of tables, each with a SQL text of the same meaning.

Input tables of the operators are derived from the given tables by SQL that runs unchanged on Spark
and on DuckDB: ``{name}`` stands for a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
_PLACE = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


class Source:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {name: getattr(self, name) for name in set(_PLACE.findall(text))}
        return self.spark.sql(text, **used)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Source], DataFrame]
    sql: str | None


def feed(batches: Iterable[DataFrame], folder: str, start: Callable[[DataFrame], StreamingQuery]) -> DataFrame:
    """Replay tables as micro-batches: each is written by all tasks, and ``start`` drains the stream over ``folder`` before the
    next one arrives. A stream without a limit of files takes all that is new as one micro-batch. Returns the stream.
    """
    for batch in batches:
        batch.write.mode("append").parquet(folder)
        stream = batch.sparkSession.readStream.schema(batch.schema).parquet(folder)
        start(stream).awaitTermination()
    return stream


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` is for DuckDB, with the same derived inputs."""
    def add(run: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} exists")
        CATALOG[name] = Query(name, run, plain(sql) if sql else None)
        return run
    return add


def plain(text: str) -> str:
    """The text with table placeholders turned into table names."""
    return _PLACE.sub(r"\1", text)


# Derived inputs. Conversations become sessions: a turn is an event, and a reply goes to the turn before.
EVENTS = """SELECT concat('session-', CAST(conv_id AS STRING)) AS session_id, conv_id, turn AS pos,
  concat('m', CAST(turn AS STRING)) AS event_id, role AS type, turn AS ord,
  1700000000000 + conv_id * 100000 + turn * 1000 AS created_at,
  CASE WHEN role = 'assistant' AND (conv_id + turn) % 7 <> 0
       THEN 1700000000000 + conv_id * 100000 + turn * 1000 + CASE WHEN (conv_id + turn) % 11 = 0 THEN -5 ELSE 500 END END
    AS completed_at,
  concat('t', CAST(turn AS STRING)) AS turn_id,
  CASE WHEN role = 'assistant' THEN concat('m', CAST(turn - 1 AS STRING)) END AS reply_to,
  CASE WHEN role = 'assistant' THEN CASE WHEN (conv_id + turn) % 13 = 0 THEN 'running' ELSE 'completed' END END AS status,
  text
FROM {conversations} WHERE role <> 'system'"""

# The same export read twice; some messages differ in the second read.
READ_TWICE = f"""SELECT session_id, event_id AS message_id, type AS role, ord, text, 0 AS read_no FROM ({EVENTS}) a
UNION ALL
SELECT session_id, event_id AS message_id, type AS role, ord,
  CASE WHEN length(text) % 4 = 0 THEN concat(text, ' (edited)') ELSE text END AS text, 1 AS read_no FROM ({EVENTS}) b"""

# Assistant turns with content, one text block each; some have none.
BLOCKS = f"""SELECT session_id, event_id, CAST(0 AS BIGINT) AS pos, 'text' AS type, text FROM ({EVENTS}) e
WHERE type = 'assistant' AND length(text) % 5 <> 0"""

SESSIONS = """SELECT concat('session-', CAST(conv_id AS STRING)) AS session_id, conv_id,
  CASE WHEN conv_id > 0 THEN concat('session-', CAST(CAST(floor(conv_id / 2) AS BIGINT) AS STRING)) END AS parent_id,
  min(1700000000000 + conv_id * 100000 + turn * 1000) AS created_at,
  CASE WHEN conv_id % 9 = 0 THEN NULL ELSE max(1700000000000 + conv_id * 100000 + turn * 1000) - CASE WHEN conv_id % 17 = 1 THEN 900000 ELSE 0 END END AS updated_at,
  min(text) AS title, sum(length(text)) AS n_chars
FROM {conversations} GROUP BY conv_id"""

# A calendar day of a user is one tool call; every event is an observation of it.
TOOL_OBS = """SELECT concat('u', CAST(user_id AS STRING)) AS session_id, concat('d', substring(CAST(ts AS STRING), 1, 10)) AS call_id,
  event_id AS entry_index, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' ELSE 'unknown' END AS status,
  CAST(round(value) AS BIGINT) AS amount, props
FROM {events}"""
