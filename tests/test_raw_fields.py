"""Raw rows parsed once, field by field."""

from tidewater.functions.records import field_profile, raw_fields

ROWS = ['{"a": "1", "b": null, "c": {"x": 1}, "d": [1, 2]}', '{"a": 2.50, "nested key / x": "t"}', '{"a": "-3"', "{}", "[1]", "7", "", None,
        '{"a": "12,5", "A": true}']


def test_fields(spark):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(ROWS)], "feed string, row_no int, raw_data string")
    got = sorted((r["row_no"], r["key"] or "", r["kind"] or "", r["value"] or "") for r in raw_fields(df, ("row_no",)).collect())
    assert got == [
        (0, "a", "scalar", "1"), (0, "b", "null", ""), (0, "c", "object", '{"x":1}'), (0, "d", "array", "[1,2]"),
        (1, "a", "scalar", "2.5"), (1, "nested key / x", "scalar", "t"),
        (2, "", "", ""), (3, "", "", ""), (4, "", "", ""), (5, "", "", ""), (6, "", "", ""),
        (8, "A", "scalar", "true"), (8, "a", "scalar", "12,5")]
    prof = {r["key"]: r for r in field_profile(raw_fields(df)).collect()}
    assert (prof["a"]["n"], prof["a"]["n_numbers"], prof["a"]["least"], prof["a"]["greatest"], prof["a"]["n_chars"]) == (3, 2, 1.0, 2.5, 8)
    assert prof["b"]["n_null"] == 1 and prof["c"]["n_object"] == 1 and prof[None]["n"] == 5
    assert raw_fields(df.limit(0)).count() == 0


def test_one_parse_and_folded_before_the_shuffle(spark):
    df = spark.createDataFrame([("f", t) for t in ROWS], "feed string, raw_data string")
    plan = field_profile(raw_fields(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") <= 1 and "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_kinds_without_a_schema_for_each_value(spark):
    """A schema is built for values that look like an object or array only."""
    rows = ['{"a": "{x", "b": "[x", "c": {}, "d": []}', ' {"a": "{\\"k\\": 1}"}', "\t[{}]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "row_no int, raw_data string")
    got = raw_fields(df, ("row_no",))
    assert sorted((r["row_no"], r["key"] or "", r["kind"] or "") for r in got.collect()) == [
        (0, "a", "scalar"), (0, "b", "scalar"), (0, "c", "object"), (0, "d", "array"), (1, "a", "scalar"), (2, "", "")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().replace("schemaOfVariant", "schema_of_variant")
    assert "AS _type" not in plan
