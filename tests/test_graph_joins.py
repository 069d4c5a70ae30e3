"""Graphs by pointer doubling: joins that pass no rows through the driver, and cycles with repeated ids."""

from pyspark.sql import functions as F

from palaver.operators import graph


def test_graph_joins_are_not_broadcast(spark):
    rows = spark.range(1, 400).select(F.concat(F.lit("s"), "id").alias("session_id"), F.when(F.col("id") > 1, F.concat(
        F.lit("s"), F.floor(F.col("id") / 3 + 1).cast("int"))).alias("parent_id"), (F.col("id") % 5 > 0).alias("ready"))
    plan = graph.propagate_block(rows, "session_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cycles_end_with_the_longest_way_into_one(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "durable", lambda df: written.append(1) or df.localCheckpoint())
    # Cycles of 1, 2 and 7, one way of 20 into a cycle, a chain that ends, a missing parent, and very many short ways.
    edges = [("a", "a"), ("b", "c"), ("c", "b"), *[(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)], ("w0", "b"),
             *[(f"w{i}", f"w{i - 1}") for i in range(1, 20)], ("e0", None), ("e1", "e0"), ("m", "none"), (None, "a"),
             *[(f"z{i}", "a") for i in range(3000)]]
    on_cycle = {"a", "b", "c", *[f"r{i}" for i in range(7)]}
    sessions = spark.createDataFrame(edges, "session_id string, parent_id string")
    assert {r[0] for r in graph.parent_cycles(sessions).collect()} == on_cycle
    assert len(written) <= 7  # rounds by the way of 20, not by the number of sessions
    assert {r[0] for r in graph.parent_cycles(sessions.unionByName(sessions)).collect()} == on_cycle
    assert graph.parent_cycles(sessions.where("session_id LIKE 'e%'")).count() == 0
