"""The chunked and range-partitioned forms against plain Python."""

import random

from pyspark.sql import functions as F

from palaver.operators import ordered, segments
from palaver.operators.budget import byte_budget
from palaver.operators.graph import parent_cycles, parent_order


def _rows(seed, n=400, keys=3):
    rng = random.Random(seed)
    counts = {}
    rows = []
    for _ in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(keys)}"
        pos = counts.get(key, 0)
        counts[key] = pos + 1
        rows.append((key, pos, rng.randrange(100)))
    return rows


def test_running_sum_and_previous_over_chunks(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    got = {(r.k, r.pos): (r.s, r.p) for r in ordered.previous_value(
        ordered.running_sum(df, ["k"], "pos", "v", "s", chunk=7), ["k"], "pos", "v", "p", chunk=5).collect()}
    total, before = {}, {}
    for k, pos, v in sorted(rows):
        total[k] = total.get(k, 0) + v
        assert got[(k, pos)] == (total[k], before.get(k))
        before[k] = v


def test_row_position_is_the_same_for_hot_keys(spark):
    rows = [(k, pos, v) for k, pos, v in _rows(2)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    plain = {tuple(r) for r in ordered.row_position(df, ["k"], ["v", "pos"], "n").collect()}
    spread = {tuple(r[c] for c in ("k", "pos", "v", "n"))
              for r in ordered.row_position(df, ["k"], ["v", "pos"], "n", small=1).collect()}
    assert plain == spread
    whole = ordered.row_position(df, [], ["v", "k", "pos"], "n", small=1).collect()
    assert [r.n for r in sorted(whole, key=lambda r: (r.v, r.k, r.pos))] == list(range(len(rows)))


def test_hashes_do_not_depend_on_partitioning_and_see_every_change(spark):
    rows = [(k, pos, f"{v:064x}") for k, pos, v in _rows(3)]
    df = spark.createDataFrame(rows, "k string, pos bigint, h string")
    first = {r.k: r.t for r in ordered.tree_hash(df, ["k"], "pos", "h", "t", fanout=4).collect()}
    again = {r.k: r.t for r in ordered.tree_hash(df.repartition(7), ["k"], "pos", "h", "t", fanout=4).collect()}
    assert first == again
    changed = df.withColumn("h", F.when((F.col("k") == "hot") & (F.col("pos") == 100), "x").otherwise(F.col("h")))
    other = {r.k: r.t for r in ordered.tree_hash(changed, ["k"], "pos", "h", "t", fanout=4).collect()}
    assert {k for k in first if first[k] != other[k]} == {"hot"}


def test_top_per_key_with_salts(spark):
    rows = _rows(4)
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    got = {(r.k, r.rank): r.pos for r in ordered.top_per_key(df, ["k"], [F.desc("v"), "pos"], 70).collect()}
    for key in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))[:70]
        assert [got[(key, i + 1)] for i in range(len(want))] == [r[1] for r in want]


def _fold(rows, cap):
    """The rule as it stands: one message after the other."""
    total, out = {}, []
    for key, pos, kind, size, tail in sorted(rows, key=lambda r: (r[0], r[1])):
        total[key] = total.get(key, 0) + size
        if kind == "assistant" and total[key] > cap:
            out.append((key, pos, total[key]))
            total[key] = tail
    return sorted(out)


def test_segment_history_equals_the_fold(spark):
    rng = random.Random(5)
    kinds = ["user", "assistant"]
    rows = [("s", i, rng.choice(kinds), rng.randrange(1, 90), rng.randrange(1, 40)) for i in range(300)]
    rows += [("small", 0, "assistant", 5, 5), ("exact", 0, "assistant", 200, 0), ("exact", 1, "assistant", 1, 1), ("one", 7, "assistant", 900, 3)]
    rows += [("zeros", i, rng.choice(kinds), rng.choice([0, 0, 0, 150]), rng.choice([0, 250, 199])) for i in range(120)]  # kept text over the limit too
    rows += [("gaps", i * 100_000, rng.choice(kinds), rng.randrange(0, 400), rng.randrange(0, 200)) for i in range(60)]
    rows += [("users", i, "user", 100, 1) for i in range(20)] + [("steps", i, "assistant", 201, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id string, pos bigint, type string, bytes bigint, tail_bytes bigint")
    want = _fold(rows, 200)
    assert len({r[0] for r in want}) == 6
    for width in (65536, 37):
        assert sorted(tuple(r) for r in segments.segment_history(df, cap=200, width=width).collect()) == want
    assert segments.segment_history(df.limit(0)).collect() == [] and segments.segment_history(df, cap=10 ** 9).collect() == []


def test_segment_history_at_the_default_cap(spark):
    rng = random.Random(11)
    rows = [(f"s{k}", i, rng.choice(["user", "assistant", "assistant"]), rng.randrange(0, 60_000), rng.randrange(0, 16_384)) for k in range(3) for i in range(500)]
    rows = [(k, p, t, b, None if p % 50 == 0 else tail) for k, p, t, b, tail in rows] + [(None, 0, "assistant", 500_000, 1), ("s0", None, "assistant", 500_000, 1)]
    df = spark.createDataFrame(rows, "session_id string, pos bigint, type string, bytes bigint, tail_bytes bigint")
    want = _fold([(k, p, t, b, tail or 0) for k, p, t, b, tail in rows if k and p is not None], segments.CONTEXT_BYTES)
    assert sorted(tuple(r) for r in segments.segment_history(df).collect()) == want and len(want) > 150


def _tail(text, limit):
    while len(text.encode()) > limit:
        text = text[1:]
    return text


def test_recent_tail_cuts_between_characters(spark):
    rng = random.Random(6)
    alphabet = ["a", "b ", "é", "€", "\U0001f600"]
    rows = [("s", i, 0, rng.choice(["user", "assistant"]), "".join(rng.choices(alphabet, k=rng.randrange(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id string, pos bigint, block_pos bigint, type string, text string")
    limit, recent, want = 64, "", {}
    for _, pos, _, kind, text in rows:
        label = segments.LABELS[kind]
        entry = _tail(label + _tail(text, limit - len(label)), limit)
        recent = entry if len(entry.encode()) >= limit else _tail(f"{recent}\n\n{entry}" if recent else entry, limit)
        want[pos] = recent
    entries = segments.labelled_texts(df, limit)
    sizes = {r.pos: r.tail_bytes for r in segments.tail_bytes(entries, limit).collect()}
    shown = {r.pos: r.recent for r in segments.recent_tail(entries, df.select("session_id", "pos"), limit).collect()}
    assert sizes == {p: len(t.encode()) for p, t in want.items()}
    assert shown == want


def test_pretty_json_bytes(spark):
    import json
    values = [{"a": [1, {"b": "x{[,:\"\\"}], "c": {}, "d": []}, [], {}, "text", [[], [1, 2]], {"k": {"z": None, "y": [True]}}]
    rows = [(json.dumps(v, separators=(",", ":"), sort_keys=True),) for v in values]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(segments.pretty_json_bytes(F.col("j"))).collect()]

    def pretty(v):
        return len((json.dumps(v, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())
    assert got == [pretty(v) for v in values]


def test_parent_order_matches_the_walk(spark):
    rng = random.Random(7)
    ids = [f"s{i:03d}" for i in range(120)]
    order = ids[:]
    rng.shuffle(order)
    parents = {x: (rng.choice(order[:i]) if i and rng.random() < 0.8 else None) for i, x in enumerate(order)}
    done, want = set(), []
    for x in sorted(ids):
        chain = []
        while x is not None and x not in done:
            chain.append(x)
            x = parents[x]
        for y in reversed(chain):
            done.add(y)
            want.append(y)
    df = spark.createDataFrame(list(parents.items()), "session_id string, parent_id string")
    got = [r.session_id for r in parent_order(df).orderBy("subtree_min", "depth").collect()]
    assert got == want


def test_cycles_are_found_without_what_leads_to_them(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("tail", "a"), ("tail2", "tail"), ("self", "self"), ("ok", None), ("kid", "ok"), ("lost", "gone")]
    df = spark.createDataFrame(pairs, "session_id string, parent_id string")
    assert {r[0] for r in parent_cycles(df).collect()} == {"a", "b", "c", "self"}


def test_byte_budget_matches_the_greedy_pass(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        parent = f"t{rng.randrange(i)}" if i and rng.random() < 0.3 else None
        rows.append((f"t{i}", parent, i, rng.randrange(1, 60), rng.random() < 0.9))
    left, state = 900, {}
    for ident, parent, _, size, ready in rows:
        if not ready or (parent is not None and state[parent] != "ready"):
            state[ident] = "blocked"
        elif size > left:
            state[ident] = "too_large"
        else:
            left -= size
            state[ident] = "ready"
    df = spark.createDataFrame(rows, "target_id string, parent_id string, pos bigint, bytes bigint, ready boolean")
    for window in (100_000, 7):
        assert {r.target_id: r.status for r in byte_budget(df, 900, window=window).collect()} == state


def test_null_keys_and_null_positions_stay(spark):
    rows = [(None, 0, 5), (None, 1, 7), ("a", 0, 1), ("a", None, 5), ("a", 1, 2), (None, None, 9)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    sums = {(r.k, r.pos): r.s for r in ordered.running_sum(df, ["k"], "pos", "v", "s", chunk=1).collect()}
    assert sums == {(None, 0): 5, (None, 1): 12, ("a", 0): 1, ("a", 1): 3, ("a", None): None, (None, None): None}
    before = {(r.k, r.pos): r.p for r in ordered.previous_value(df, ["k"], "pos", "v", "p", chunk=1).collect()}
    assert before == {(None, 0): None, (None, 1): 5, ("a", 0): None, ("a", 1): 1, ("a", None): None, (None, None): None}
    small = {(r.k, r.v): r.n for r in ordered.row_position(df, ["k"], ["v"], "n").collect()}
    large = {(r.k, r.v): r.n for r in ordered.row_position(df, ["k"], ["v"], "n", small=1).collect()}
    assert small == large and len(small) == 6


def test_annotations_are_the_five_fixed_ones():
    from palaver.operators.drift import ANNOTATIONS
    assert set(ANNOTATIONS) == {"title", "description", "default", "examples", "deprecated"}
