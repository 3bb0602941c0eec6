import json
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tideline.llm.terms import _names_deep, member_names, radix_aggregate, sum_folder, term_frequencies

S = "payload_id bigint, payload string"


def brute(rows):
    occ, rec, n = Counter(), Counter(), 0
    for text in {i: t for i, t in rows if i is not None}.values():
        c = member_names(text)
        if c is not None:
            n += 1
            occ.update(c)
            rec.update(c.keys())
    return {(k, occ[k], rec[k], "rare" if rec[k] < 5 else "common" if rec[k] > 0.4 * n else None) for k in occ}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": {"b": [{"a": 1}, {"c": "\\"d\\": 1"}]}}', {"a": 2, "b": 1, "c": 1}),
        ('{"a": 1, "a": 2}', {"a": 2}), ('{"gr\\u00f6\\u00dfe": 0}', {"größe": 1}), ("{}", {}), (" \n{} ", {}),
        ('{"": 1}', {"": 1}), ('{"n": ' + "9" * 6000 + "}", {"n": 1}), ('{"e": 1e999}', {"e": 1}),
        (None, None), ("", None), (" ", None), ("[1]", None), ('"a"', None), ("true", None), ("1", None), ("{", None), ('{"a": NaN}', None), ('{"a": -Infinity}', None), ("{'a': 1}", None), ('{"a": 01}', None), ('{"a": 1,}', None), ('{"a": "\t"}', None), ("{} x", None), ("﻿{}", None),
    ],
)
def test_member_names(text, want):
    got = member_names(text)
    assert (None if got is None else dict(got)) == want
    if text:
        deep = _names_deep(text)
        assert (None if deep is None else dict(deep)) == want


def test_very_deep_and_very_long():
    deep = '{"a":' * 60_000 + "1" + "}" * 60_000
    assert member_names(deep) == {"a": 60_000}
    assert member_names('{"a":' * 60_000 + "[" + "}" * 60_000) is None
    assert sum(member_names("{" + ",".join(f'"k{i}":{{}}' for i in range(50_000)) + "}").values()) == 50_000


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from("abcé\\\""), c, max_size=3), max_leaves=8)


@given(json_values)
def test_both_parsers_agree(value):
    text = json.dumps(value)
    assert member_names(text) == _names_deep(text)


def test_frequencies(spark):
    rows = [(i, json.dumps({"all": i, **({"some": 1} if i % 2 else {}), **({"few": {"deep": 1}} if i < 4 else {}), "x" * (i % 7): 0})) for i in range(20)]
    rows += [rows[3]] * 5 + [(100, None), (101, ""), (102, "[]"), (None, '{"nobody": 1}')]
    df = spark.createDataFrame(rows, S).selectExpr("*", "'x' AS id", "1 AS terms", "2 AS ns", "3 AS h")
    got = {tuple(r) for r in term_frequencies(df).collect()}
    assert got == brute(rows)
    # with partitions so small that they split again and again
    assert {tuple(r) for r in term_frequencies(df, most_bytes=1).collect()} == got
    assert term_frequencies(df.limit(0)).count() == 0


def test_lone_surrogate(spark):
    df = spark.createDataFrame([(1, '{"\\ud800": 1}')], S)
    assert [r.field_name for r in term_frequencies(df).collect()] == ["?"]


def test_radix_aggregate_of_many_terms(spark):
    partial = spark.range(60_000, numPartitions=4).selectExpr("CAST(id % 20000 AS string) AS term", "2L AS occurrences", "1L AS records")
    out = radix_aggregate(partial, most_bytes=20_000)
    assert out.count() == 20_000 and out.where("occurrences <> 6 OR records <> 3").isEmpty()


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from(['{"a":1}', '{"b":{"a":2}}', "{}", "x", None])), max_size=12))
def test_like_brute_force(spark, pairs):
    rows = list(dict(pairs).items())
    assert {tuple(r) for r in term_frequencies(spark.createDataFrame(rows, S)).collect()} == brute(rows)


def test_what_cant_spill_is_summed_in_passes(spark, tmp_path):
    spark.range(400_000, numPartitions=2).selectExpr("concat(repeat('x', 60), id % 150000) AS term", "1L AS occurrences", "1L AS records").write.parquet(f"{tmp_path}/radix=3")
    for spill in (None, str(tmp_path)):
        got = [r for b in sum_folder(f"file://{tmp_path}/radix=3", "24MB", spill) for r in b.to_pylist()]
        assert len(got) == len({r["term"] for r in got}) == 150_000 and sum(r["occurrences"] for r in got) == 400_000


def test_files_and_jobs_dont_grow_with_the_tasks(spark):
    seen = []
    for tasks in (3, 60):
        partial = spark.range(6000, numPartitions=tasks).selectExpr("CAST(id % 500 AS string) AS term", "1L AS occurrences", "1L AS records")
        spark.sparkContext.setJobGroup(f"g{tasks}", "")
        assert radix_aggregate(partial).count() == 500
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"g{tasks}")))
    assert seen[0] == seen[1]
