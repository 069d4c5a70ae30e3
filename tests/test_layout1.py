"""Layout 1 puts messages into the order of creation time and id."""

import json

from palaver.operators.layout1 import map_sessions_v1
from palaver.operators.mapping import Mapped


def test_messages_parts_and_provenance_follow_creation_time(spark):
    def message(session, pos, kind, created):
        answer = kind == "assistant"
        body = json.dumps({"text": f"text {pos}", "metadata": {"provenance": {"n": pos}}})
        return (session, f"t-{session}", pos, f"e{pos}", f"m{pos}", kind, "e0" if answer else None, True if answer else None,
                created, created + 5 if answer else None, body)

    messages = spark.createDataFrame(
        [message("back", 0, "user", 20), message("back", 1, "compaction", 20), message("back", 2, "assistant", 10),
         message("forth", 0, "user", 1), message("forth", 1, "assistant", 2)],
        "session_id string, target_id string, pos bigint, event_id string, id string, type string, reply_to string, reply_ok boolean, "
        "created_at bigint, completed_at bigint, body string")
    text = json.dumps({"type": "text", "text": "answer"})
    blocks = spark.createDataFrame(
        [("back", "t-back", 2, "m2", 0, text), ("forth", "t-forth", 1, "m1", 0, text)],
        "session_id string, target_id string, event_pos bigint, message_id string, content_pos bigint, body string")
    sessions = spark.createDataFrame(
        [(s, f"t-{s}", None, "complete", 8, [], 0, [], "h", 1, 30, "title") for s in ("back", "forth")],
        "session_id string, target_id string, parent_id string, recovery string, mapping_version int, projected array<string>, "
        "resource_count bigint, codes array<string>, source_hash string, created_at bigint, updated_at bigint, title string")
    diagnostics = spark.createDataFrame([], "session_id string, code string, field string")
    rejects = spark.createDataFrame([], "session_id string, field string, code string")
    out = map_sessions_v1(Mapped(sessions, messages, blocks, diagnostics, rejects, blocks.limit(0)), "1.0.0", "n")
    assert {(r.session_id, r.pos, r.id) for r in out.messages.collect()} == {
        ("back", 0, "m2"), ("back", 1, "m0"), ("forth", 0, "m0"), ("forth", 1, "m1")}
    assert {(r.session_id, r.event_pos, r.message_id) for r in out.parts.collect()} == {
        ("back", 0, "m2"), ("back", 1, "m0"), ("forth", 0, "m0"), ("forth", 1, "m1")}
    assert {(r.session_id, r.pos, json.loads(r.event)["n"]) for r in out.provenance.collect()} == {
        ("back", 0, 2), ("back", 1, 0), ("forth", 0, 0), ("forth", 1, 1)}
    noted = {r.session_id for r in out.diagnostics.filter("code = 'MESSAGE_ORDER_NORMALIZED'").collect()}
    assert noted == {"back"}
