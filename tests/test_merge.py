"""Merging rules against a pass over the observations in order."""

import random

from palaver.operators.dedup import dedup_quarantine
from palaver.operators.merge import merge_pages, merge_tool_observations


def _sequential(obs):
    prev = None
    for o in obs:
        o = dict(o)
        start = o["s"] if o["s"] is not None else o["g"]
        if o["e"] is not None and start is not None and o["e"] < start:
            o["e"] = None
        if prev is None:
            prev = o
            continue
        end = lambda x: x["status"] in ("completed", "error")
        if (prev["name"] != o["name"] or (end(prev) and end(o) and (prev["status"], prev["out"]) != (o["status"], o["out"]))
                or any(prev[f] is not None and o[f] is not None and prev[f] != o[f] for f in "gse")):
            return "conflict"
        pick = o if end(o) or (not end(prev) and o["status"] == "running") else prev
        merged = dict(pick)
        for f in "gse":
            merged[f] = prev[f] if prev[f] is not None else o[f]
        start = merged["s"] if merged["s"] is not None else merged["g"]
        if merged["e"] is not None and start is not None and merged["e"] < start:
            return "conflict"
        prev = merged
    return (prev["status"], prev["out"], prev["g"], prev["s"], prev["e"])


def test_tool_merge_matches_the_sequential_rule(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for call in range(400):
        obs = []
        for i in range(rng.randrange(1, 5)):
            time = lambda p, c: rng.choice(c) if rng.random() < p else None
            obs.append({"name": "n" if rng.random() < 0.97 else "m", "status": rng.choice(["completed", "error", "running", "unknown"]),
                        "out": rng.choice(["1", "1", "1", "2", None]), "g": time(0.4, [5]), "s": time(0.3, [4, 6, 6]), "e": time(0.4, [5, 5, 7])})
        want[f"c{call}"] = _sequential(obs)
        rows += [("s", "m", f"c{call}", i, o["name"], "{}", o["status"], o["out"], None, o["g"], o["s"], o["e"], False) for i, o in enumerate(obs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, message_id string, call_id string, entry_index int, name string, input string, status string,"
                               "output string, error string, generated_at bigint, started_at bigint, completed_at bigint, invalid boolean")
    calls, conflicts = merge_tool_observations(df)
    got = {r.call_id: (r.status, r.output, r.generated_at, r.started_at, r.completed_at) for r in calls.collect()}
    got.update({r.call_id: "conflict" for r in conflicts.collect()})
    assert got == want


def test_quarantine_does_not_depend_on_input_order(spark):
    rows = [("a", "1", 0, "x"), ("a", "1", 1, "y"), ("b", "1", 0, "x"), ("b", "2", 1, "x"), ("c", "9", 0, "x")]
    for order in (rows, rows[::-1]):
        kept, conflicts = dedup_quarantine(spark.createDataFrame(order, "k string, h string, i int, src string"), ["k"], "h", ["i"])
        assert sorted((r.k, r.h, r.src) for r in kept.collect()) == [("a", "1", "x"), ("c", "9", "x")]
        assert [(r.k, r.n_rows) for r in conflicts.collect()] == [("b", 2)]


def _page(session, no, ids, token=None, more=None, code=0, total=None, owner=None):
    return (session, no, code, [(i, owner or session, h) for i, h in ids], token, more, total)


def test_page_faults_reject_the_whole_session(spark):
    one, two = ("m1", "h1"), ("m2", "h2")
    pages = [
        _page("good", 0, [one, two], "t1", True), _page("good", 1, [two], None, False),
        _page("clash", 0, [one], "t1"), _page("clash", 1, [("m1", "other")]),
        _page("foreign", 0, [one], owner="someone"),
        _page("reused", 0, [one], "t"), _page("reused", 1, [two], "t"), _page("reused", 2, [two]),
        _page("empty", 0, [], "t"), _page("empty", 1, [one]), _page("contradiction", 0, [one], None, True),
        _page("failed", 0, [one], code=1), _page("unfinished", 0, [one], "t"), _page("total", 0, [one], total=5), _page("nothing", 0, []),
    ]
    df = spark.createDataFrame(pages, "session_id string, page_no bigint, code bigint, items array<struct<item_id:string,owner_id:string,digest:string>>,"
                               "next_token string, has_more boolean, total bigint")
    kept, rejected = merge_pages(df)
    assert {r.session_id for r in rejected.collect()} == {"clash", "foreign", "reused", "empty", "contradiction", "failed", "unfinished"}
    assert sorted((r.session_id, r.item_id) for r in kept.collect()) == [("good", "m1"), ("good", "m2"), ("total", "m1")]
    assert "total" in {r.session_id for r in merge_pages(df, check_total=True)[1].collect()}


def test_merged_pages_are_stored_once(spark):
    pages = spark.sql("""SELECT session_id, page_no, 0L AS code, array(named_struct('item_id', concat('i', page_no), 'owner_id', session_id, 'digest', 'd')) AS items,
        CASE WHEN page_no < 2 THEN concat('t', page_no) END AS next_token, page_no < 2 OR session_id = 's1' AS has_more, CAST(NULL AS BIGINT) AS total
        FROM VALUES ('s0'), ('s1') AS s(session_id), (SELECT id AS page_no FROM range(3))""")
    kept, rejected = merge_pages(pages)
    assert kept.inputFiles() and rejected.inputFiles()
    assert [(r.session_id, r.item_id) for r in kept.orderBy("item_id").collect()] == [("s0", f"i{n}") for n in range(3)]
    assert [r.session_id for r in rejected.collect()] == ["s1"]
