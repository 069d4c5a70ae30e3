"""What is known against a session, from issues about its subjects."""

import random

from pyspark.sql import functions as F

from palaver.operators.refs import diagnostics_by_session

ISSUE = "id string, code string, severity string, subject_type string, subject_id string, ref_sessions array<string>"


def _tables(spark, sessions, events, resources):
    return (spark.createDataFrame(sessions, "session_id string, project_id string"), spark.createDataFrame(events, "session_id string, event_id string"),
            spark.createDataFrame(resources, "session_id string, resource_id string"))


def test_a_shared_subject_gives_one_row_a_session(spark):
    issues = spark.createDataFrame([(f"d{i}", "C", "error", "event", "m1", []) for i in range(20)], ISSUE)
    found, general = diagnostics_by_session(issues, *_tables(spark, [(f"s{i}", None) for i in range(50)], [(f"s{i}", "m1") for i in range(50)], []))
    rows = found.collect()
    assert len(rows) == 50 and {(r.n_issues, r.n_errors, r.blocked) for r in rows} == {(20, 20, True)} and general.count() == 0


def test_issues_equal_all_pairs(spark):
    rng = random.Random(4)
    names = [f"s{i}" for i in range(12)]
    sessions = [(s, rng.choice(["p0", "p1", None])) for s in names]
    events = [(rng.choice(names), f"m{rng.randrange(9)}") for _ in range(60)] + [(None, "m1"), ("s1", None)]
    resources = [(rng.choice(names), f"r{rng.randrange(5)}") for _ in range(20)]
    issues = []
    for i in range(150):
        kind = rng.choice(["session", "project", "event", "resource", "bundle", None])
        subject = {"session": rng.choice(names), "project": rng.choice(["p0", "p1", "p9"]), "event": f"m{rng.randrange(9)}",
                   "resource": f"r{rng.randrange(6)}"}.get(kind)
        issues.append((f"d{i}", rng.choice("ABC"), rng.choice(["error", "warning"]), kind, subject, rng.sample([*names, "ghost"], rng.randrange(3))))
    issues.append(("null", "A", "error", "event", None, None))
    excused = F.col("code") == "A"
    found, general = diagnostics_by_session(spark.createDataFrame(issues + issues[:9], ISSUE), *_tables(spark, sessions, events, resources), None, excused)
    got = {r.session_id: r for r in found.collect()}
    for name, project in sessions:
        own = {"session": {name}, "project": {project} - {None}, "event": {e for s, e in events if s == name}, "resource": {r for s, r in resources if s == name}}
        mine = [i for i in issues if i[3] in own and (i[4] in own[i[3]] and i[4] is not None or name in (i[5] or []))]
        about = [i for i in mine if i[1] == "A" and i[3] == "session" and i[4] == name]
        if not mine:
            assert name not in got
            continue
        row = got[name]
        assert (row.n_issues, row.n_errors) == (len(mine), sum(i[2] == "error" for i in mine))
        assert set(row.codes) == {i[1] for i in mine} and set(row.own_codes) == {i[1] for i in about}
        assert row.own_blocked == any(i[2] == "error" for i in about) and row.blocked == any(i[2] == "error" for i in mine if i not in about)
    assert general.dropDuplicates(["id"]).count() == sum(i[3] in ("bundle", None) for i in issues)
