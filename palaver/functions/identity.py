"""Canonical JSON, content hashes and identities that depend on identity alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identity tag, default namespace and id prefixes.
IDENTITY_TAG = "transcript-id-v1"
NAMESPACE = "transcripts"
SESSION_PREFIX = "ses_imp_"
MESSAGE_PREFIX = "msg_000000000000"
PART_PREFIX = "prt_"


def canonical_json(json_text: Column) -> Column:
    """Compact JSON with sorted keys, array order kept; NULL for text that is not JSON."""
    return F.to_json(F.try_parse_json(json_text))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def content_hash(*values: Column) -> Column:
    """``sha256:`` and hex of one text, or of the JSON array of several."""
    if len(values) == 1:
        return digest(values[0])
    return digest(F.to_json(F.array(*[v.cast("string") for v in values])))


def _tuple_hex(*parts: Column) -> Column:
    # A JSON array keeps the parts apart whatever characters they hold.
    return F.sha2(F.to_json(F.array(F.lit(IDENTITY_TAG), *parts)), 256)


def _ordered_hex(position: Column) -> Column:
    return F.lpad(F.lower(F.hex(position.cast("bigint"))), 16, "0")


def stable_session_id(source_id: Column, namespace: str = NAMESPACE) -> Column:
    return F.when(source_id != "", F.concat(
        F.lit(SESSION_PREFIX), _tuple_hex(F.lit(namespace), F.lit("session"), source_id)))


def stable_message_id(session_id: Column, message_id: Column, position: Column,
                      namespace: str = NAMESPACE) -> Column:
    """Ids sort by the source order because it leads as zero-padded hex."""
    valid = (session_id != "") & (message_id != "") & (position >= 0)
    return F.when(valid, F.concat(
        F.lit(MESSAGE_PREFIX), _ordered_hex(position), F.lit("_imp_"),
        _tuple_hex(F.lit(namespace), F.lit("message"), session_id, message_id)))


def stable_part_id(session_id: Column, message_id: Column, position: Column,
                   namespace: str = NAMESPACE) -> Column:
    owner = _tuple_hex(F.lit(namespace), F.lit("part"), session_id, message_id, position.cast("string"))
    return F.concat(F.lit(PART_PREFIX), _ordered_hex(position), F.lit("_imp_"), F.substring(owner, 1, 24))
