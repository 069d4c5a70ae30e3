"""Schema drift against plain sets, with baselines of several bitmaps."""

import random

from pyspark.sql import functions as F

from palaver.operators.drift import compare_to, missing_parts, schema_drift

ROWS = "schema_id string, path string, attr string, value string"


def test_missing_parts_equal_set_differences(spark):
    rng = random.Random(2)
    base = [(f"$.p{i}", rng.choice(["type", "enum"]), rng.choice(["a", None, str(i)])) for i in range(300)]
    seen = {f"s{k}": [b for b in base if rng.random() < share] + [(f"$.x{k}", "type", "new")] for k, share in enumerate((0, 0.5, 0.99, 1))}
    baseline = spark.createDataFrame(base + base[:9], "path string, attr string, value string")
    observed = spark.createDataFrame([(k, *row) for k, rows in seen.items() for row in rows * 2], ROWS)
    got = [tuple(r) for r in missing_parts(baseline, observed).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, *b) for k, rows in seen.items() for b in set(base) - set(rows)}
    assert missing_parts(baseline.limit(0), observed).count() == 0 and missing_parts(baseline, observed.limit(0)).count() == 0


def test_baseline_of_several_bitmaps(spark):
    size = 70_000
    baseline = spark.range(size).select(F.concat(F.lit("$.properties.f"), "id").alias("path"), F.lit("type").alias("attr"), F.lit('"string"').alias("value"))
    of = lambda name, rows: rows.withColumn("schema_id", F.lit(name))
    without = {5, 32_767, 32_768, 32_769, 65_535, 65_536, 69_999}
    number = F.regexp_extract("path", "f([0-9]+)$", 1).cast("int")
    observed = of("whole", baseline).unionByName(of("some", baseline.filter(~number.isin(*without)))).unionByName(of("few", baseline.filter(number < 10)))
    got = missing_parts(baseline, observed).groupBy("schema_id").agg(F.count("*").alias("n"), F.min(number).alias("least")).collect()
    assert {tuple(r) for r in got} == {("some", len(without), 5), ("few", size - 10, 10)}
    verdicts, changes = schema_drift(baseline, observed, limit=3)
    assert {(r["schema_id"], r["status"], r["change_count"]) for r in verdicts.collect()} == {
        ("whole", "exact", 0), ("some", "incompatible", len(without)), ("few", "incompatible", size - 10)}
    assert changes.groupBy("schema_id").count().filter("count > 3").isEmpty()


def test_a_new_property_does_not_hide_one_with_a_longer_name(spark):
    form = '{"type":"object","additionalProperties":false,"properties":{"ab":{"type":"%s"}%s}}'
    schemas = spark.createDataFrame([
        ("base", form % ("string", "")), ("same", form % ("string", "")), ("wider", form % ("string", ',"a":{"type":"object","properties":{"q":{"type":"null"}}}')),
        ("other", form % ("number", ',"a":{"type":"string"}')), (None, form % ("number", ""))], "schema_id string, schema string")
    got = {r["schema_id"]: (r["status"], r["change_count"]) for r in compare_to(schemas, "base")[0].collect()}
    assert got == {"same": ("exact", 0), "wider": ("compatible", 1), "other": ("incompatible", 2)}
