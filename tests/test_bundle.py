"""From responses to a bundle, a plan and a migrated target."""

import json

import pytest
from pyspark.sql import functions as F

from palaver.plans import lifecycle as life
from palaver.plans import manifest as mf
from palaver.plans.assemble import Inputs, assemble
from palaver.plans.plan import PlanOptions, build_plan
from palaver.session import durable

S = "session-alpha"


def _response():
    tool = {"id": "c1", "name": "exec_command", "params": {"cmd": "ls"}, "result": {"status": "success", "data": {"stdout": "x\n", "output": "x\n", "code": 0}}}
    content = {"messages": [
        {"type": "proposal", "proposal": {"content": {"reasoning_content": "First.", "thought": "Opening.\n"}}},
        {"type": "plan_item", "plan_item": {"id": "p1", "reasoning_content": "Tool reason.", "tool_call_info": tool,
                                            "timing": {"tool_call_started_at_ms": 1700000002000, "tool_call_finished_at_ms": 1700000003000}}},
        {"type": "proposal", "proposal": {"content": {"thought": "Final.\n"}}}]}
    return [
        {"message_id": "a1", "chat_session_id": S, "turn_id": "t1", "reply_to_message_id": "u1", "role": "assistant", "message_type": "task",
         "message_index": 2, "created_at": 1700000001, "chat_start_time": 1700000001100, "chat_end_time": 1700000004000, "status": "completed", "content": content},
        {"message_id": "u1", "chat_session_id": S, "role": "user", "message_index": 1, "created_at": 1700000000, "content": "Read this.\n"}]


@pytest.fixture(scope="module")
def bundle(spark):
    child = [dict(r, chat_session_id="session-child") for r in _response()]
    answers = spark.createDataFrame([(S, "available", 2, json.dumps(_response())), ("session-child", "available", 2, json.dumps(child)),
                                     ("session-ghost", "unavailable", None, None)], "session_id string, status string, expected bigint, response string")
    records = spark.createDataFrame([(S, "T", 1700000000000, 1700000004000, None, "complete"), ("session-child", "C", 1700000000000, 1700000004000, S, "complete")],
                                    "session_id string, title string, created_at bigint, updated_at bigint, parent_id string, status string")
    sources = spark.createDataFrame([(x, "w1", "runtime-metadata", "runtime:getSessions#session", "sha256:" + "a" * 64) for x in (S, "session-child")],
                                    "session_id string, workspace_id string, kind string, locator string, digest string")
    projects = spark.createDataFrame([("w1", "/work/x", "folder-uri")], "workspace_id string, path string, source string")
    return assemble(Inputs(records, sources, answers, projects))


def test_assembled_rows(bundle):
    assert {r.session_id: (r.recovery, r.project_path) for r in bundle["sessions"].collect()} == {
        S: ("complete", "/work/x"), "session-child": ("complete", "/work/x")}
    blocks = bundle["blocks"].filter(F.col("session_id") == S).orderBy("pos").collect()
    assert [(b.type, b.text or b.call_id) for b in blocks] == [
        ("reasoning", "First."), ("text", "Opening.\n"), ("reasoning", "Tool reason."), ("tool", "c1"), ("text", "Final.\n")]
    assert [(r.code, r.subject_id) for r in bundle["diagnostics"].collect()] == [("SESSION_WITHOUT_EVIDENCE", "session-ghost")]
    assert bundle["source"].first().fingerprint.startswith("sha256:")


def test_a_contradicting_session_is_set_aside(spark):
    kinds = "session_id string, title string, created_at bigint, updated_at bigint, parent_id string, status string"
    records = spark.createDataFrame([(S, "T", 1, 2, None, "complete"), ("bad", "A", 1, 2, None, "complete"), ("bad", "B", 1, 2, None, "complete")], kinds)
    answers = spark.createDataFrame([(x, "available", 2, json.dumps([dict(r, chat_session_id=x) for r in _response()])) for x in (S, "bad")],
                                    "session_id string, status string, expected bigint, response string")
    sources = spark.createDataFrame([(x, "w1", "runtime-metadata", "runtime:getSessions#session", "sha256:" + "a" * 64) for x in (S, "bad")],
                                    "session_id string, workspace_id string, kind string, locator string, digest string")
    projects = spark.createDataFrame([("w1", "/work/x", "folder-uri")], "workspace_id string, path string, source string")
    got = assemble(Inputs(records, sources, answers, projects))
    assert [r.session_id for r in got["sessions"].collect()] == [S] and got["events"].filter("session_id = 'bad'").isEmpty()
    assert [(r.code, r.severity, r.subject_id) for r in got["diagnostics"].collect()] == [("SESSION_CONTRADICTION", "error", "bad")]


@pytest.fixture(scope="module")
def planned(spark, bundle):
    maps = spark.createDataFrame([("/work", "/new")], "from string, to string")
    held = spark.createDataFrame([("/new/x",)], "directory string")
    plan, mapped = build_plan(bundle, maps, held, PlanOptions(namespace="ns"))
    return durable(plan), mapped


def test_plan_and_transfer(planned):
    plan, mapped = planned
    rows = plan.orderBy("pos").collect()
    assert [(r.source_id, r.status, r.strategy, r.target_directory) for r in rows] == [
        (S, "ready", "mapped", "/new/x"), ("session-child", "ready", "mapped", "/new/x")]
    assert rows[1].parent_id == rows[0].target_id and rows[0].bytes > 1000
    counts = json.loads(rows[0].expected)
    assert (counts["messages"], counts["users"], counts["text"], counts["reasoning"], counts["tools"]) == (2, 1, 2, 2, 1)
    tool = mapped.blocks.filter("type = 'tool'").first()
    state = json.loads(tool.body)["state"]
    assert state["content"] == [{"text": "x\n", "type": "text"}] and state["input"] == {"command": "ls"}
    assert state["metadata"]["provenance"]["sourceOutputRemainder"] == {"code": 0}


def test_the_exact_transfer_size(planned, bundle):
    plan, mapped = planned
    target = plan.orderBy("pos").first().target_id
    blocks = {}
    for b in mapped.blocks.filter(F.col("target_id") == target).orderBy("content_pos").collect():
        blocks.setdefault(b.event_pos, []).append(json.loads(b.body))
    messages = []
    for m in mapped.messages.filter(F.col("target_id") == target).orderBy("pos", "sub").collect():
        body = json.loads(m.body)
        if m.type == "assistant":
            body["content"] = blocks.get(m.pos, [])
        messages.append(body)
    info = json.loads(mapped.sessions.filter(F.col("target_id") == target).first().info)
    text = json.dumps({"info": info, "messages": messages}, separators=(",", ":"), ensure_ascii=False)
    assert plan.filter(F.col("target_id") == target).first().bytes == len(text.encode())


def test_layout_one(spark, bundle):
    maps = spark.createDataFrame([("/work", "/new")], "from string, to string")
    held = spark.createDataFrame([("/new/x",)], "directory string")
    plan, out = build_plan(bundle, maps, held, PlanOptions(namespace="ns", layout="v1", version="1.18.32"))
    assert {r.status for r in plan.collect()} == {"ready"}
    parts = out.parts.filter(F.col("session_id") == S).orderBy("event_pos", "id").collect()
    assert [p.type for p in parts] == ["text", "reasoning", "text", "reasoning", "tool", "text"]
    codes = {r.code for r in out.diagnostics.collect()}
    assert {"PART_START_PROJECTED", "PART_END_PROJECTED", "PROVENANCE_AT_SESSION", "SOURCE_FIELDS_UNKNOWN"} <= codes


def test_apply_resume_replace_and_roll_back(spark, planned, tmp_path):
    plan, _ = planned
    empty = life.planned_rows(plan, "r").limit(0)
    first, target = life.apply_plan(mf.init_manifest(plan, "run-a"), plan, empty, "run-a")
    first, target = durable(first), durable(target)
    assert {r.state for r in first.collect()} == {"verified"} and target.count() == 2
    checksum = mf.write_manifest(first, str(tmp_path / "m"), 1)
    stored = mf.read_manifest(spark, str(tmp_path / "m"), 1, checksum)
    assert mf.validate_manifest(stored, "run-a").count() == 0
    # Resuming twice imports nothing again.
    again, same = life.apply_plan(life.resume(stored, plan, target, "run-a"), plan, target, "run-a")
    assert sorted(again.select("target_id", "attempts").collect()) == sorted(first.select("target_id", "attempts").collect())
    assert same.count() == 2
    edited = target.withColumn("hash", F.lit("edited"))
    with pytest.raises(ValueError, match="TARGET_CHANGED"):
        life.resume(stored, plan, edited, "run-a")
    with pytest.raises(ValueError, match="PLAN_CHANGED"):
        life.resume(stored, plan.withColumn("transfer_hash", F.lit("x")), target, "run-a")
    # Another run takes over; children go first.
    updated, deletions = life.plan_replacement(mf.init_manifest(plan, "run-b"), stored, target, "run-a")
    places = [r.pos for r in deletions.collect()]
    assert places == sorted(places, reverse=True) and len(places) == 2
    second, replaced = life.apply_plan(updated, plan, life.delete_sessions(target, deletions), "run-b")
    assert {r.run_id for r in replaced.collect()} == {"run-b"}
    assert mf.summarize_manifest(second).first().replaced == 2
    extra = target.unionByName(target.limit(1).withColumn("target_id", F.lit("ses_child")).withColumn(
        "parent_id", F.lit(plan.orderBy("pos").first().target_id)))
    with pytest.raises(ValueError, match="CHILDREN_PROTECTED"):
        life.plan_replacement(mf.init_manifest(plan, "run-b"), stored, extra, "run-a")
    # Roll back the first run.
    entries = durable(life.plan_rollback(stored, target, "run-a"))
    assert {r.action for r in entries.collect()} == {"delete"}
    with pytest.raises(ValueError, match="CONFIRMATION"):
        life.apply_rollback(stored, target, entries, "run-a", "wrong")
    done, rest = life.apply_rollback(stored, target, entries, "run-a", "run-a")
    assert {r.state for r in done.collect()} == {"rolled-back"} and rest.count() == 0
    assert {r.action for r in life.plan_rollback(stored, extra, "run-a").collect()} == {"delete", "protected"}


def test_target_changes():
    old = {"binary_version": "2.0.1", "server_version": "2.0.1", "schema_hash": "h"}
    assert life.target_matches(old, dict(old), None, None, "r")
    assert not life.target_matches(old, dict(old, schema_hash="other"), None, None, "r")
    assert not life.target_matches(old, dict(old, binary_version="1.0.1"), None, None, "r")


def test_files_and_bundle_reader(spark, tmp_path):
    from palaver.sources.bundle import read_bundle
    from palaver.sources.files import read_file_inventory
    root = tmp_path / "files"
    (root / "w1" / "paste-files").mkdir(parents=True)
    (root / "w1" / "paste-files" / "a b.PNG").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (root / "w1" / "note.txt").write_text("héllo")
    (root / "w1" / "bad.bin").write_bytes(b"\xff\xfe")
    rows = {r.relative_path: r for r in read_file_inventory(spark, str(root), workspace_depth=1).collect()}
    assert (rows["paste-files/a b.PNG"].mime, rows["paste-files/a b.PNG"].ext, rows["paste-files/a b.PNG"].depth) == ("image/png", ".png", 3)
    assert rows["note.txt"].mime == "text/plain" and rows["note.txt"].size_bytes == 6 and rows["bad.bin"].mime == "application/octet-stream"
    short = {r.relative_path: r for r in read_file_inventory(spark, str(root), workspace_depth=1, max_bytes=8).collect()}
    png = short["paste-files/a b.PNG"]  # too long here: a row, not a stop
    assert len(short) == 3 and (png.readable, png.sha256, png.mime, png.size_bytes) == (False, None, None, 9) and short["note.txt"].readable
    session = {"sourceId": S, "recovery": "partial", "events": [{"type": "user", "sourceId": "u", "order": 0, "text": "hi", "sourceRefs": []}],
               "resources": [], "sourceRefs": []}
    good = {"schemaVersion": 1, "createdAt": "2026-01-01T00:00:00Z", "source": {}, "projects": [], "sessions": [session], "diagnostics": []}
    path = tmp_path / "b.json"
    path.write_text(json.dumps(good, indent=1))
    assert read_bundle(spark, str(path))["events"].first().text == "hi"
    for change, code in (({"extra": 1}, "unknown field"), ({"schemaVersion": 2}, "INVALID_JSON"),
                         ({"sessions": [dict(session, recovery="odd")]}, "SCHEMA_INVALID"),
                         ({"sessions": [dict(session, title=f"ghp_{'A' * 30}")]}, "SENSITIVE")):
        path.write_text(json.dumps({**good, **change}))
        with pytest.raises(ValueError, match=code):
            read_bundle(spark, str(path))


def test_faults_of_stored_files_are_issues(spark):
    from palaver.operators.resources import resolve_file_refs
    inventory = spark.createDataFrame(
        [("w", "paste-files/ok", 3, "text/plain", True), ("w", "paste-files/locked", 3, None, False), ("w", "paste-files/odd", 3, "application/octet-stream", True),
         ("w", "paste-files/dir/a", 1, "text/plain", True), ("w", "paste-files/dir/b", 1, "text/plain", True)],
        "workspace_id string, relative_path string, size_bytes bigint, mime string, readable boolean")
    refs = spark.createDataFrame([(str(i), "w", p, p, False, "text/plain", 4) for i, p in enumerate(
        ["paste-files/ok", "paste-files/locked", "paste-files/dir", "paste-files/gone"])],
        "ref_id string, workspace_id string, relative_path string, path string, explicit boolean, mime string, size bigint")
    resolved, issues, rest = resolve_file_refs(refs, inventory)
    assert {r.ref_id: r.availability for r in resolved.collect()} == {"0": "available", "1": "deferred", "2": "deferred", "3": "missing"}
    assert {(r.ref_id, r.relative_path[12:], r.code, r.severity) for r in issues.collect()} == {
        ("0", "ok", "RESOURCE_METADATA_MISMATCH", "error"), ("1", "locked", "RESOURCE_DEFERRED", "warning"), ("2", "dir", "RESOURCE_DEFERRED", "warning"),
        ("3", "gone", "RESOURCE_MISSING", "warning"), (None, "locked", "RESOURCE_READ_FAILED", "error"),
        (None, "odd", "RESOURCE_MIME_UNKNOWN", "warning"), (None, "dir", "RESOURCE_LAYOUT_INVALID", "error")}
    assert [r.relative_path for r in rest.collect()] == ["paste-files/odd"]


def test_long_histories_are_segmented(bundle):
    from palaver.operators.mapping import map_sessions_v2
    mapped = map_sessions_v2(bundle, "ns", cap=200, recent=40)
    rows = mapped.messages.filter(F.col("session_id") == S).orderBy("pos", "sub").collect()
    assert [r.type for r in rows] == ["user", "assistant", "compaction"]
    body = json.loads(rows[2].body)
    joined = "[User]: Read this.\n\n\n[Assistant]: Opening.\n\n\n[Assistant]: Final.\n"
    assert body["recent"] == joined[-40:] and body["id"] == rows[1].id + "_compact"
    assert body["metadata"]["provenance"]["activeContextBytes"] > 200
    assert "CONTINUATION_BOUNDARY" in {r.code for r in mapped.diagnostics.collect()}


def test_redaction_of_a_bundle(bundle):
    from palaver.operators.payload import assert_no_credentials
    from palaver.plans.redact import redact_bundle
    dirty = dict(bundle)
    mine = F.col("session_id") == S
    dirty["events"] = bundle["events"].withColumn("text", F.when(mine & (F.col("type") == "user"), F.lit('use password="pq rs" now')).otherwise(F.col("text")))
    dirty["blocks"] = bundle["blocks"].withColumn("input", F.when(mine & F.col("input").isNotNull(), F.lit('{"env":{"apiKey":"k-1"}}')).otherwise(F.col("input")))
    clean, counts = redact_bundle(dirty)
    assert [(r.session_id, r.redacted_count) for r in counts.collect()] == [(S, 2)]
    assert {r.session_id: r.recovery for r in clean["sessions"].collect()} == {S: "partial", "session-child": "complete"}
    assert clean["events"].filter(mine & (F.col("type") == "user")).first().text == 'use password="[REDACTED_SECRET]" now'
    assert clean["blocks"].filter(mine & F.col("input").isNotNull()).first().input == '{"env":{"apiKey":"[REDACTED_SECRET]"}}'
    assert_no_credentials(clean["blocks"], ["session_id", "event_id", "pos"], ["input", "output", "text"])
    assert "CREDENTIALS_REDACTED" in {r.code for r in clean["diagnostics"].collect()}
