from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tideline.operators.components import star_components
from tideline.operators.redelivery import first_copies, surplus_copies

SCHEMA = "delivery_id bigint, queue_url string, message_id string, message_deduplication_id string, sequence_number bigint"


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    seen = {}
    for d, q, *ids, _ in rows:
        find(d)
        for i, v in enumerate(ids):
            v = (v or "").strip().lower()
            if v and q is not None:
                if (i, q, v) in seen:
                    parent[find(d)] = find(seen[i, q, v])
                seen[i, q, v] = d
    best = {}
    for d, *_, n in rows:
        o = (n is None, n or 0, d)
        k = find(d)
        best[k] = min(best.get(k, o), o)
    return {r[0] for r in rows} - {b[2] for b in best.values()}


def found(spark, rows, schema=SCHEMA):
    return sorted(r.delivery_id for r in surplus_copies(spark.createDataFrame(rows, schema)).collect())


def test_chains_case_blanks_and_nulls(spark):
    rows = [
        (1, "q", "A", "x", 5), (2, "q", " a\t", None, 3), (3, "q", "b", "X ", 9), (4, "q", "b", "  ", None),  # one message, kept: 2
        (5, "p", "a", "x", 1), (6, "q", None, None, 1), (7, "q", "", " ", 1), (8, "q", None, None, 1), (9, None, "a", "x", 0), (10, None, "a", "x", 0),
    ]
    assert found(spark, rows) == [1, 3, 4]
    assert set(found(spark, rows)) == brute(rows)


def test_null_sequence_is_last_and_ties_go_to_the_lower_row(spark):
    assert found(spark, [(1, "q", "a", None, None), (2, "q", "a", None, 7), (3, "q", "a", None, 7)]) == [1, 3]


def test_long_chain(spark):
    rows = [(i, "q", f"m{i // 2}", f"d{(i + 1) // 2}", 100 - i) for i in range(100)]
    assert set(found(spark, rows)) == brute(rows) == set(range(99))


def test_hot_identifier_and_repeated_rows(spark):
    rows = [(i, "q", "hot", f"d{i}", i) for i in range(3000)] + [(0, "q", "hot", "d0", 0)] * 3
    assert found(spark, rows) == list(range(1, 3000))


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == []
    names = SCHEMA + ", id string, rank string, k0a string, top string, n bigint, u int"
    assert found(spark, [(1, "q", "a", None, 1, "x", "y", "z", "t", 5, 1), (2, "q", "a", None, 2, "x", "y", "z", "t", 5, 1), (None, "q", "a", None, 0, "", "", "", "", 0, 0)], names) == [2]


def test_very_long_identifiers(spark):
    a = "x" * 200_000
    assert found(spark, [(1, "q", a, None, 1), (2, "q", a + " ", None, 2), (3, "q", a + "y", None, 3)]) == [2]


def test_kept_rows_are_whole(spark):
    rows = [(1, "q", "a", None, 1), (2, "q", "a", None, 2), (3, "q", None, None, None)]
    assert Counter(map(tuple, first_copies(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter([rows[0], rows[2]])


def test_a_row_stored_twice_is_kept_once(spark):
    rows = [(1, "q", "a", None, 1)] * 3 + [(2, "q", "b", None, 4), (2, "q", "b", None, 3), (None, "q", "c", None, 1), (None, "q", "c", None, 1)]
    assert Counter(map(tuple, first_copies(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter([rows[0], rows[4], rows[5], rows[5]])


def test_any_integers_and_other_orders(spark):
    big = 2**63 - 1
    for a, b in ((-5, 3), (1 << 62, -(1 << 62)), (big, -big - 1)):
        rows = [(-big - 1, "q", "a", None, max(a, b)), (big, "q", "a", None, min(a, b)), (7, "q", "a", None, None), (-3, "q", "a", None, min(a, b))]
        assert found(spark, rows) == [-big - 1, 7, big]
    text = spark.createDataFrame([(1, "q", "a", None, "b"), (2, "q", "a", None, "a"), (3, "q", "a", None, None)], SCHEMA.replace("sequence_number bigint", "sequence_number string"))
    assert sorted(r.delivery_id for r in surplus_copies(text).collect()) == [1, 3]


def test_the_folds_are_hash_aggregates(spark):
    from pyspark.sql import functions as F

    from tideline.operators.redelivery import _rank

    df = spark.createDataFrame([(1, "q", "a", "b", 1)], SCHEMA)
    plan = df.select("delivery_id", "message_id", _rank(df, "delivery_id", ["sequence_number"]).alias("rank")).groupBy("message_id").agg(F.min_by("delivery_id", "rank"), F.min("rank"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["q", "p", None]), st.sampled_from(["a", "A ", "b", "c", None, " "]), st.sampled_from(["x", "y", " X", "z", None]), st.one_of(st.none(), st.integers(0, 5))), max_size=25))
def test_like_brute_force(spark, rows):
    rows = [(i, *r) for i, r in enumerate(rows)]
    assert set(found(spark, rows)) == brute(rows)


def test_components_of_a_star_and_a_ring(spark):
    edges = [(i, 1000) for i in range(500)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(edges, "u bigint, v bigint"))[0].collect()}
    assert got == {**{i: 0 for i in [*range(1, 500), 1000]}, **{2000 + i: 2000 for i in range(1, 50)}}
