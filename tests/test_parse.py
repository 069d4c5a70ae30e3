"""Raw records with every kind of fault."""

import json

from palaver.operators.dedup import dedup_quarantine
from palaver.operators.parse import parse_assistant_messages, parse_user_messages
from palaver.sources.messages import read_messages, read_pages
from palaver.sources.sessions import read_session_records

S = "session-one"


def _recs(spark, *records):
    from pyspark.sql import functions as F
    rows = [(S, i, json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "session_id string, entry_index int, j string").select(
        "session_id", "entry_index", F.parse_json("j").alias("rec"))


def _user(i, **more):
    return {"message_id": f"u{i}", "chat_session_id": S, "role": "user", "message_index": i, "created_at": 1700000000, **more}


def _assistant(i, content, **more):
    return {"message_id": f"a{i}", "chat_session_id": S, "role": "assistant", "message_index": str(i), "created_at": "1700000001",
            "turn_id": "t", "reply_to_message_id": "u0", "message_type": "task", "status": "completed",
            "chat_start_time": 1700000001000, "chat_end_time": 1700000002000, "content": content, **more}


def test_user_records(spark):
    block = [{"type": "text", "text_content": "one "}, {"type": "image"}, {"type": "text", "text": "two"}]
    recs = _recs(
        spark, _user(0, content="plain"), _user(1, content=json.dumps(block)), _user(2, content=block),
        _user(3, content="  ", query=json.dumps(["from ", {"type": "text", "content": "query"}, {"type": "x"}])),
        _user(4, content=7, user_message_context={"parsedQuery": ["late"]}), _user(5, content="12"),
        _user(6, query="not json"), 5, {"role": "system"}, {"role": "assistant"}, _user(7, message_index=-1, content="x"),
        _user(8, content=[{"type": "text", "text": 5}]), _user(9, content=" padded "))
    messages, issues = parse_user_messages(recs)
    assert {r.message_id: (r.text, r.text_locator) for r in messages.collect()} == {
        "u0": ("plain", "content"), "u1": ("one two", "content"), "u2": ("one two", "content"), "u3": ("from query", "query"),
        "u4": ("late", "user_message_context.parsedQuery"), "u9": (" padded ", "content")}
    found = sorted((r.entry_index, r.code) for r in issues.collect())
    assert found == sorted([
        (3, "USER_TEXT_FROM_QUERY"), (4, "USER_CONTENT_INVALID"), (4, "USER_TEXT_FROM_QUERY"), (5, "USER_CONTENT_INVALID"),
        (5, "USER_TEXT_MISSING"), (6, "USER_QUERY_INVALID"), (6, "USER_TEXT_MISSING"), (7, "USER_RECORD_INVALID"),
        (8, "USER_RECORD_INVALID"), (10, "USER_RECORD_INVALID"), (11, "USER_CONTENT_INVALID"), (11, "USER_TEXT_MISSING")])


def _plan(ident, **more):
    return {"type": "plan_item", "plan_item": {"id": ident, **more}}


def test_assistant_records(spark):
    finish = {"id": "c9", "name": "finish", "params": json.dumps({"summary": "done"}), "result": {"status": "success"}}
    chat = {"messages": [_plan("p1", thought="step"), _plan("p2", thought="done"), _plan("p3", tool_call_info=finish), _plan("p4", thought="after")]}
    proposal = {"messages": [{"type": "proposal", "proposal": {"content": {"thought": "hello", "reasoning_content": "why"}}},
                             _plan("p1", reasoning_content="because"), _plan("p1", reasoning_content="because"), _plan("p2", reasoning_content="x"),
                             _plan("p2", reasoning_content="y"), {"type": "agent_call"}, "bad"]}
    recs = _recs(spark, _assistant(0, chat, agent_type="chat"), _assistant(1, json.dumps(proposal)),
                 _assistant(2, {"content": "general", "reasoning_content": 5}, message_type="general", status="weird", chat_end_time=1),
                 _assistant(3, "broken"), _assistant(4, {"messages": []}, turn_id="bad id!"))
    out = parse_assistant_messages(recs)
    texts = {}
    for r in out["texts"].orderBy("message_id", "block_index", "sub_rank").collect():
        texts.setdefault(r.message_id, []).append(r.text)
    assert texts == {"a0": ["step", "done", "after"], "a1": ["hello"], "a2": ["general"]}
    assert sorted((r.message_id, r.text) for r in out["reasoning"].collect()) == [("a1", "because"), ("a1", "why")]
    rows = {r.message_id: r for r in out["messages"].collect()}
    assert rows["a2"].completed_at is None and rows["a2"].status == "unknown" and rows["a0"].ord == 0
    codes = {(r.message_id, r.code) for r in out["issues"].collect()}
    assert {("a1", "PLAN_ITEM_CONFLICT"), ("a1", "CONTENT_TYPE_UNSUPPORTED"), ("a1", "ASSISTANT_CONTENT_INVALID"), ("a1", "PLAN_ITEM_INVALID"),
            ("a2", "REASONING_INVALID"), ("a2", "ASSISTANT_STATUS_INVALID"), ("a2", "ASSISTANT_TIMING_ORDER_INVALID"),
            ("a3", "ASSISTANT_CONTENT_INVALID"), ("a3", "ASSISTANT_TEXT_MISSING"), ("a3", "TOOL_CONTAINER_INVALID"),
            ("a4", "ASSISTANT_RECORD_INVALID")} <= codes


def test_tool_observations(spark):
    call = lambda **more: {"id": "c1", "name": "read", "params": {"b": 1, "a": None}, **more}
    content = {"messages": [
        _plan("p1", tool_call_info=call(result={"status": "success", "data": {"x": [1, None]}}), timing={"tool_call_started_at_ms": 5, "tool_call_finished_at_ms": 3}),
        _plan("p2", tool_call_info=call(id="c2", result={"status": "odd", "error_message": "no"}), timing={"generated_at_ms": "7"}),
        _plan("p3", tool_call_info={"name": "", "result": {}}), _plan("p4", tool_call_info={"id": "c3", "name": " "}),
        _plan("p5", tool_call_info={"id": "c4", "name": "n", "result": "text", "params": {}}), _plan("p6", tool_call_info={"id": "c5", "name": "n"})]}
    out = parse_assistant_messages(_recs(spark, _assistant(0, content)))
    obs = {r.call_id: r for r in out["tool_obs"].collect()}
    assert set(obs) == {"c1", "c2", "c4", "c5"}
    assert (obs["c1"].status, obs["c1"].input, obs["c1"].output) == ("completed", '{"a":null,"b":1}', '{"x":[1,null]}')
    assert obs["c2"].error == '"no"' and obs["c2"].generated_at is None and obs["c4"].invalid and obs["c5"].invalid
    codes = sorted(r.code for r in out["issues"].collect() if r.code.startswith("TOOL"))
    assert codes == sorted(["TOOL_TIMING_INVALID", "TOOL_TIMING_INVALID", "TOOL_STATUS_UNSUPPORTED", "TOOL_ERROR_UNVERIFIED", "TOOL_CALL_INVALID",
                            "TOOL_RESULT_INVALID", "TOOL_INPUT_INVALID", "TOOL_RESULT_MISSING"])


def test_readers_of_saved_responses(spark, tmp_path):
    lines = [{"session_id": S, "response": {"data": {"data": {"items": [_user(0, content="hi"), _user(0, content="hi")]}}}},
             {"session_id": "session-two", "response": {"nothing": 1}}, {"session_id": "session-three", "status": "error"}]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    recs, issues = read_messages(spark, str(tmp_path / "r.jsonl"))
    messages, _ = parse_user_messages(recs)
    kept, conflicts = dedup_quarantine(messages, ["session_id", "message_id"], "digest", ["entry_index"])
    assert [r.text for r in kept.collect()] == ["hi"] and conflicts.count() == 0
    assert [(r.session_id, r.code) for r in issues.collect()] == [("session-two", "CONTAINER_INVALID")]
    page = {"session_id": S, "page_no": 0, "result": {"code": 0, "data": {"items": [_user(0)], "has_more": False}}}
    (tmp_path / "p.jsonl").write_text(json.dumps(page))
    row = read_pages(spark, str(tmp_path / "p.jsonl")).first()
    assert row.code == 0 and row["items"][0].owner_id == S and row.next_token is None and row.has_more is False
    listing = {"data": {"sessions": [{"session_id": "session-one", "name": "A", "created_at": 5, "update_at": 6}, {"session_id": "x"}]}}
    (tmp_path / "s.jsonl").write_text(json.dumps(listing))
    candidates, bad = read_session_records(spark, str(tmp_path / "s.jsonl"))
    assert [(r.session_id, r.created_at, r.updated_at) for r in candidates.collect()] == [("session-one", 5000, 6000)]
    assert [r.code for r in bad.collect()] == ["SESSION_RECORD_INVALID"]
