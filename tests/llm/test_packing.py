import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm.packing import fill_report, nnls, pack, patterns, plan_groups, runs_of
from tideline.llm.tokens import encoding

D = "doc_id bigint, text string"
C = "container_class string, capacity_tokens int"


def check(hist, capacity):
    groups = plan_groups(hist, capacity)
    placed = {}
    for g in groups:
        used = sum(s * k for s, k in g.slots)
        assert g.m > 0 and 0 <= used <= capacity and g.free == capacity - used
        for s, k in g.slots:
            placed[s] = placed.get(s, 0) + g.m * k
    assert placed == {s: n for s, n in hist.items() if n}
    runs = runs_of("c", groups, capacity)
    for s, n in placed.items():
        ends = sorted((r[2], r[3]) for r in runs if r[1] == s)
        assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]] and ends[-1][1] == n
    return sum(g.m for g in groups)


def test_patterns_fill_exactly():
    assert sorted(patterns(5, 3)) == sorted([(5,), (4, 1), (3, 2), (3, 1, 1), (2, 2, 1)])


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 30)), np.zeros(30)
    x[[3, 7, 20]] = (1, 2, 3)
    got = nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6
    assert nnls(np.eye(2), np.array([-1.0, 2.0])).tolist() == [0.0, pytest.approx(2.0)]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([1, 7, 64, 512]).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(0, c), st.integers(0, 500), max_size=30))))
def test_every_item_once_and_none_too_full(case):
    capacity, hist = case
    n = check(hist, capacity)
    total = sum(s * k for s, k in hist.items())
    assert n >= -(-total // capacity)


def test_little_unused_space():
    rng = np.random.default_rng(3)
    sizes = np.clip(rng.lognormal(5, 1.2, 20_000).astype(int), 1, 2048)
    hist = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    assert check(hist, 2048) <= 1.01 * sizes.sum() / 2048
    # a third of all items of one size
    hist[700] = 10_000
    assert check(hist, 2048) <= 1.12 * sum(s * n for s, n in hist.items()) / 2048


def rows(spark, docs, containers):
    df = spark.createDataFrame(docs, D).selectExpr("*", "1 AS n", "2 AS size", "'x' AS container_class", "3 AS g")
    return [r.asDict() for r in pack(df, spark.createDataFrame(containers, C)).collect()]


def test_pack(spark):
    docs = [(1, "alpha beta gamma " * 300), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "one two three"), *[(i, "word " * (i % 9)) for i in range(10, 60)]]
    out = rows(spark, docs, [("a", 64), ("b", 100_000), ("b", 50), ("zero", 0), ("none", None), (None, 9)])
    encode = encoding().encode_ordinary
    for c, cap in (("a", 64), ("b", 100_000)):
        own = [r for r in out if r["container_class"] == c]
        assert len({(r["doc_id"], r["piece"]) for r in own if r["doc_id"] != 4}) == len([r for r in own if r["doc_id"] != 4])
        at, sums = {}, {}
        for r in own:
            at.setdefault(r["container"], []).append(r["position"])
            sums[r["container"]] = sums.get(r["container"], 0) + r["tokens"]
        assert all(sorted(p) == list(range(len(p))) for p in at.values()) and sorted(at) == list(range(len(at)))
        assert all(r["fill"] == sums[r["container"]] <= cap for r in own)
        total = {d: 0 for d, _ in docs}
        for r in own:
            total[r["doc_id"]] += r["tokens"]
        assert total[1] == len(encode(docs[0][1])) and total[2] == total[3] == 0 and total[4] == 2 * len(encode("x"))
        assert all(r["n_pieces"] == max(1, -(-total[r["doc_id"]] // cap)) for r in own if r["doc_id"] not in (4,))
    assert {r["container_class"] for r in out} == {"a", "b"}


def test_empty(spark):
    assert rows(spark, [], [("a", 10)]) == [] and rows(spark, [(1, "x")], []) == []


def test_hot_size_is_ranked_in_groups(spark):
    docs = spark.range(50_000).selectExpr("id AS doc_id", "'same text' AS text")
    classes = spark.createDataFrame([("a", 64)], C)
    out = pack(docs, classes)
    assert out.select("doc_id").distinct().count() == 50_000
    assert out.groupBy("container", "position").count().where("count > 1").isEmpty()
    assert fill_report(out, classes).first().filled_share > 0.99
