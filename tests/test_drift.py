import json

from tideline.operators.drift import cast_value, cells, changes_between, ingest, parse_definition, schema_changes, subject_table, with_previous, write_tables

S = "schema_id bigint, subject string, version int, definition string"
P = "payload_id bigint, file_id bigint, record_no int, payload string"
FILES = "file_id bigint, subject string, schema_version int, promoted_fields array<string>"


def obj(fields, **more):
    return json.dumps({"fields": fields, "required_fields": []} | more)


def lst(*fields):
    return json.dumps({"fields": list(fields)}, indent=1)


def found(spark, entries):
    return sorted(tuple(r) for r in schema_changes(spark.createDataFrame(entries, S)).collect())


def test_changes_of_every_kind(spark):
    v1 = lst({"name": "a", "type": "Int32", "field_id": 1}, {"name": "b", "type": "Utf8", "field_id": 2}, {"name": "s", "type": "record", "fields": [{"name": "x", "type": "long"}, {"name": "y", "type": "bool"}]}, {"name": "old", "type": "int"})
    v3 = lst({"name": "a2", "type": "bigint", "field_id": 1}, {"name": "b", "type": "string", "field_id": 2}, {"name": "s", "type": "Struct", "fields": [{"name": "x", "type": "text"}, {"name": "z", "type": "bool"}]}, {"name": "new", "type": "INTEGER", "aliases": ["gone", "old"]})
    v4 = obj({"a3": "long", "s": "Utf8", "b": "Utf8", "new": "Int32"}, renamed_from={"a3": "a2", "b": "nothing"})
    assert found(spark, [(1, "t", 1, v1), (3, "t", 3, v3), (4, "t", 4, v4), (9, "u", 2, v4)]) == [
        ("t", 3, "a2", "renamed"), ("t", 3, "a2", "type_changed"), ("t", 3, "new", "renamed"), ("t", 3, "s.x", "type_changed"), ("t", 3, "s.y", "removed"), ("t", 3, "s.z", "added"),
        ("t", 4, "a3", "renamed"), ("t", 4, "s", "type_changed"), ("t", 4, "s.x", "removed"), ("t", 4, "s.z", "removed"),
    ]


def test_layout_spelling_and_twice_registered_versions_change_nothing(spark):
    a, b = obj({"x": "Float64", "c": {"Struct": {"v": "Int64"}}}), lst({"name": "c", "type": "RECORD", "fields": [{"name": "v", "type": "bigint"}]}, {"name": "x", "type": " double"})
    assert found(spark, [(1, "t", 1, a), (2, "t", 1, b), (3, "t", 2, b), (4, "t", 2, a), (4, "t", 2, a)]) == []


def test_a_present_former_name_is_no_rename():
    old, new = parse_definition(obj({"a": "int"})), parse_definition(obj({"a": "int", "b": "int"}, renamed_from={"b": "a"}))
    assert changes_between(old, new) == [("b", "added", None)]


def test_broken_null_and_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "t", 1, None), (2, "t", 1, "{"), (3, "t", 1, obj({"a": "int"})), (4, "t", 2, "[]"), (5, "t", None, "{}"), (6, None, 3, obj({})), (7, "t", 3, obj({}))]) == [("t", 3, "a", "removed")]
    assert parse_definition('{"fields": {"s": {}, "t": null, "u": {"Struct": null}}}') is not None


def test_previous_over_spans(spark):
    df = spark.createDataFrame([("s", v) for v in (0, 3, 511, 512, 5000)], "subject string, version int")
    assert {r.version: r.previous for r in with_previous(df).collect()} == {0: None, 3: 0, 511: 3, 512: 511, 5000: 512}


def test_one_table_with_rescue_promotion_and_replay(spark, tmp_path):
    v1, v2 = obj({"a": "int", "b": "string"}), obj({"a2": "long", "c": {"Struct": {"x": "bool"}}}, renamed_from={"a2": "a"})
    entries = spark.createDataFrame([(1, "t", 1, v1), (2, "t", 2, v2)], S)
    files = spark.createDataFrame([(1, "t", 1, ["extra"]), (2, "t", None, None), (3, "nobody", 1, None)], FILES)
    rows = [
        (1, 1, 0, '{"a": 5, "b": "gone", "extra": 1}'), (1, 1, 0, '{"a": 5, "b": "gone", "extra": 1}'), (2, 2, 0, '{"a2": "five", "c": {"x": true, "y": [1]}, "extra": 1.5}'), (3, 1, 0, None),
        (4, 1, 0, "{oops"), (5, 1, 0, "[1]"), (6, 3, 0, '{"a": 1}'), (7, None, 0, "{}"), (8, 1, 0, "{}"), (9, 2, 0, '{"a": null}'), (None, 1, 0, "{}"),
    ]
    got = {r.payload_id: r for r in ingest(spark.createDataFrame(rows, P), files, entries).collect()}
    typed = {i: {k: v for part in (r.typed.asDict() or {}).values() for k, v in part.items()} for i, r in got.items()}
    assert typed[1] == {"a2": 5, "extra": 1.0} and got[1].typed.doubles == {"extra": 1.0} and got[1].rescued == '{"b":"gone"}'
    assert typed[2] == {"c.x": True, "extra": 1.5} and json.loads(got[2].rescued) == {"a2": "five", "c.y": [1]}
    assert [got[i].status for i in (3, 4, 5, 6, 7, 8, 9)] == ["null", "broken", "not_object", "no_schema", "no_schema", "clean", "clean"]
    assert got[9].typed.longs == {"a2": None} and json.loads(got[4].rescued) == {"_raw": "{oops"} and len(got) == 9
    done = ingest(spark.createDataFrame(rows, P), files, entries)
    write_tables(done, f"{tmp_path}/tables")
    table = subject_table(spark.read.parquet(f"{tmp_path}/tables"), "t", {"a2": "long", "c": "struct", "c.x": "bool", "extra": "double", "b": "int"})
    assert dict(table.dtypes) == {"payload_id": "bigint", "a2": "bigint", "b": "int", "c.x": "boolean", "extra": "double", "_rescued": "string"}
    assert {r.payload_id: (r.a2, r["c.x"], r.extra) for r in table.collect()} == {1: (5, None, 1.0), 2: (None, True, 1.5), **{i: (None, None, None) for i in (3, 4, 5, 8, 9)}}
    assert {(r.payload_id, r.field_name, r.long_value, r.double_value) for r in cells(done).where("bool_value IS NULL").collect()} == {(1, "a2", 5, None), (1, "extra", None, 1.0), (2, "extra", None, 1.5), (9, "a2", None, None)}
    assert ingest(spark.createDataFrame([], P), files, entries).count() == 0


def test_odd_payloads(spark):
    entries, files = spark.createDataFrame([(1, "t", 1, obj({"a": "int"}))], S), spark.createDataFrame([(1, "t", 1, None)], FILES)
    odd = ['{"a": NaN}', '{"a":' * 50_000 + "1" + "}" * 50_000, '{"a": [' + "[" * 5000 + "]" * 5000 + "]}", '{"a": 1, "x": "' + "y" * 300_000 + '"}', '{"\\ud800": 1}', '{"a": ' + "9" * 5000 + "}"]
    got = {r.payload_id: r for r in ingest(spark.createDataFrame([(i, 1, 0, t) for i, t in enumerate(odd)], P), files, entries).collect()}
    assert len(got) == 6 and got[0].status == "broken" and got[3].typed.longs == {"a": 1} and len(got[3].rescued) > 300_000 and got[4].rescued == '{"?":1}'


def test_casts():
    assert cast_value(2**31, "int") == (False, None) and cast_value(2**31, "long") == (True, 2**31)
    assert cast_value(1, "double") == (True, 1.0) and cast_value(True, "int") == (False, None) and cast_value(10**400, "double") == (False, None)


def test_a_hot_subject_is_spread(spark):
    entries, files = spark.createDataFrame([(1, "t", 1, obj({"a": "int"})), (2, "u", 1, obj({"b": "int"}))], S), spark.createDataFrame([(1, "t", 1, None), (2, "u", 1, None)], FILES)
    rows = spark.range(6000).selectExpr("id AS payload_id", "IF(id % 50 = 0, 2L, 1L) AS file_id", "0 AS record_no", "IF(id % 50 = 0, '{\"b\": 1}', '{\"a\": 2}') AS payload")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        done = ingest(rows, files, entries)
        assert done.where("status = 'clean'").count() == 6000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
