"""Registered queries cover their whole tables."""

import bisect
import hashlib
import json

import __spark_entry__ as e

from tideline.operators import lookup


def test_every_schema_step_is_compared(spark, tmp_path):
    d = lambda required, **fields: json.dumps({"fields": [{"name": k, "type": v} for k, v in fields.items()], "required_fields": required})
    rows = [(1, "a", 1, d(["x"], x="int")), (2, "a", 2, d(["x"], x="int", y="int")), (3, "a", 3, d(["x"], x="long", y="int")), (4, "a", 7, d([], y="int")), (5, "gap", 1, d(["x"], x="int")), (6, "gap", 3, d(["x"], x="int")), (7, "one", 1, d(["x"], x="int")), (8, "none", 1, d([])), (9, "none", 2, d([]))]
    spark.createDataFrame(rows, "schema_id bigint, subject string, version int, definition string").write.parquet(f"{tmp_path}/schema_entries.parquet")
    got = {(r.subject, r.version): (r.previous, r.backward, r.forward, r.full) for r in e.queries()["schema_compatibility"](spark, str(tmp_path)).collect()}
    assert got == {("a", 2): (1, True, True, True), ("a", 3): (2, False, True, False), ("a", 7): (3, True, False, False), ("gap", 3): (1, True, True, True), ("none", 2): (1, True, True, True)}


def test_every_log_row_is_looked_up(spark):
    d = "/root/testdata/sf0.001"
    got = e.queries()["chunk_covering_lookup"](spark, d)
    assert got.count() == spark.read.parquet(f"{d}/events.parquet").count() and got.where("start_offset IS NULL").count() == 0


def test_a_ring_of_over_a_million_points_is_exact(spark):
    n = 62_501
    place = lambda x: hashlib.md5(x.encode()).hexdigest()[:8]
    ring = sorted((place(f"{i}#{v}"), str(i)) for i in range(n) for v in range(16))
    want = {k: ring[bisect.bisect_left(ring, (place(str(k)), "")) % len(ring)][1] for k in range(200)}
    got = lookup.ring_successor(spark.range(200).withColumnRenamed("id", "k"), spark.range(n).withColumnRenamed("id", "node"), "k", "node")
    assert {r.k: r.ring_node for r in got.collect()} == want
