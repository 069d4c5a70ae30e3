"""Response containers of the message and session services."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import variant as V

# Where a response may hold its list, in order of preference.
MESSAGE_LISTS = ("$", "$.messages", "$.items", "$.data.messages", "$.data.items",
                 "$.data.data.messages", "$.data.data.items")
SESSION_LISTS = ("$", "$.items", "$.sessions", "$.data.items", "$.data.sessions",
                 "$.data.data.items", "$.data.data.sessions")


def container_items(response: Column, places: Sequence[str] = MESSAGE_LISTS) -> Column:
    """The list inside a response as array<variant>; NULL when it has none."""
    return F.coalesce(*[F.try_variant_get(response, place, "array<variant>") for place in places])


def unwrap(responses: DataFrame, keys: Sequence[str], column: str, places: Sequence[str] = MESSAGE_LISTS,
           code: str = "CONTAINER_INVALID") -> tuple[DataFrame, DataFrame]:
    """(records, issues): one row per list item; a response without a list is one issue.

    ``column`` is JSON text or VARIANT.
    """
    keys = list(keys)
    is_text = responses.schema[column].dataType.simpleString() == "string"
    value = F.try_parse_json(column) if is_text else F.col(column)
    opened = responses.select(*keys, container_items(value, places).alias("_items"))
    records = opened.filter("_items IS NOT NULL").select(*keys, F.posexplode("_items").alias("entry_index", "rec"))
    issues = opened.filter("_items IS NULL").select(
        *keys, F.lit(None).cast("int").alias("entry_index"), F.lit(code).alias("code"),
        F.lit("error").alias("severity"))
    return records, issues


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"session_id": ..., "status": ..., "expected": ..., "response": ...}``."""
    line = F.try_parse_json("value")
    status = V.text(V.field(line, "$.status"))
    return spark.read.text(path).filter(F.trim("value") != "").select(
        V.text(V.field(line, "$.session_id")).alias("session_id"),
        F.coalesce(status, F.lit("available")).alias("status"),
        V.safe_integer(V.field(line, "$.expected")).alias("expected"),
        F.to_json(V.field(line, "$.response")).alias("response"))


def read_messages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(recs(session_id, entry_index, rec), issues) of a folder of saved responses."""
    return unwrap(read_responses(spark, path).filter("status = 'available'"), ["session_id"], "response")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages as input of ``merge_pages``: lines ``{"session_id", "page_no", "result"}``."""
    line = F.try_parse_json("value")
    data = V.obj(V.field(line, "$.result.data"))
    items = V.array(V.field(data, "$.items"))
    token = V.field(data, "$.next_page_token")
    shaped = F.transform(items, lambda i: F.struct(
        V.text(V.field(i, "$.message_id")).alias("item_id"),
        V.text(V.field(i, "$.chat_session_id")).alias("owner_id"),
        F.sha2(F.to_json(i), 256).alias("digest"), F.to_json(i).alias("json")))
    return spark.read.text(path).filter(F.trim("value") != "").select(
        V.text(V.field(line, "$.session_id")).alias("session_id"),
        V.safe_integer(V.field(line, "$.page_no")).alias("page_no"),
        V.safe_integer(V.field(line, "$.result.code")).alias("code"), shaped.alias("items"),
        V.text(token).alias("next_token"), V.boolean(V.field(data, "$.has_more")).alias("has_more"),
        V.safe_integer(V.field(data, "$.total")).alias("total"))
