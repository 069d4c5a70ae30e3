"""Steps that do not store their input a second time."""

from pyspark.sql import functions as F

from palaver.operators import drift


def test_schemas_are_flattened_without_a_second_copy(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("written again")
    monkeypatch.setattr(drift, "durable", refuse)
    text = '{"type":["null","object"],"properties":{"a":{"enum":[1,"x"]},"enum":["q"]},"anyOf":[{"type":"string"}],"required":["a"]}'
    got = [tuple(r)[1:] for r in drift.flatten_schemas(spark.createDataFrame([("s", text)], "schema_id string, schema string")).collect()]
    alternative = drift_hash(spark, '{"type":"string"}')
    assert sorted(got, key=str) == sorted([
        ("$", "type", '"null"'), ("$", "type", '"object"'), ("$", "required", '"a"'), ("$", "anyOf", alternative),
        ("$", "property", "a"), ("$", "property", "enum"), ("$.properties.a", "enum", "1"), ("$.properties.a", "enum", '"x"'),
        ("$.properties", "enum", '"q"'), ("$", "property", None)], key=str)


def drift_hash(spark, text):
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
