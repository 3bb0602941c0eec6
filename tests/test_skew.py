from pyspark.sql import functions as F

from tideline.operators.skew import LEAST_SHARE, heavy_key_report, heavy_keys, skew_aggregate, skew_join, split_share, stream_totals, tenant_ops


def table(spark, n=10_000):
    # a third of the rows on one key, 2 % exactly on another, just above on a third, nulls, the rest spread
    return spark.range(n).selectExpr(f"CASE WHEN id < {n} DIV 3 THEN 'hot' WHEN id < {n} DIV 3 + 200 THEN 'even' WHEN id < {n} DIV 3 + 401 THEN 'above' WHEN id % 5 = 0 THEN NULL ELSE 'k' || id END AS k", "id AS v")


def test_heavy_keys_are_exact(spark):
    assert sorted(heavy_keys(table(spark), "k")) == ["above", "hot"]


def test_all_rows_on_one_key_all_null_and_empty(spark):
    assert heavy_keys(spark.range(100).selectExpr("1L AS k"), "k") == [1]
    assert heavy_keys(spark.range(100).selectExpr("CAST(NULL AS string) AS k"), "k") == []
    assert heavy_keys(spark.range(0).selectExpr("1L AS k"), "k") == []


def test_fifty_keys_at_the_limit(spark):
    assert heavy_keys(spark.range(5000).selectExpr("id % 50 AS k"), "k") == []
    assert len(heavy_keys(spark.range(4900).selectExpr("id % 49 AS k"), "k")) == 49


def test_aggregate_equals_plain(spark):
    df = table(spark)
    got = skew_aggregate(df, "k", [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")], [F.sum("n").alias("n"), F.sum("s").alias("s")])
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_join_equals_plain(spark):
    left = table(spark).withColumn("w", F.lit(1))
    right = left.where("k IS NOT NULL").select("k").distinct().where("k <> 'k9999'").withColumn("w", F.length("k"))
    for how in ("left", "inner"):
        got = skew_join(left, right, "k", how=how).groupBy("k", "v", "w", "w_right").count()
        want = left.join(right.withColumnRenamed("w", "w_right"), "k", how).groupBy("k", "v", "w", "w_right").count()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_report_totals_and_clashing_columns(spark):
    r = table(spark).selectExpr("k AS stream_id", "1 AS payload_len", "v AS logical_offset", "'x' AS salt_", "1 AS n_records", "2 AS tenant_id")
    s = spark.createDataFrame([("hot", 7, "n"), ("hot", 7, "n"), (None, 1, "z")], "stream_id string, tenant_id bigint, stream_name string")
    got = {t.stream_id: t for t in stream_totals(r, s).collect()}
    assert (got["hot"].n_records, got["hot"].tenant_id, got["above"].tenant_id) == (3333, 7, None) and got[None].tenant_id is None
    assert [tuple(x) for x in heavy_key_report([("stream", r, "stream_id")]).collect()] == [("stream", "above"), ("stream", "hot")]
    ops = spark.createDataFrame([(1, "Ack"), (1, None), (None, "Nack"), (1, "odd")], "tenant_id bigint, op string")
    assert {t.tenant_id: (t.n_ack, t.n_nack, t.n_other) for t in tenant_ops(ops).collect()} == {1: (1, 0, 2), None: (0, 1, 0)}
    assert stream_totals(r.limit(0), s).count() == 0


def test_many_heavy_keys_and_a_bound_in_rows(spark):
    df = spark.range(6000).selectExpr("id % 300 AS k", "id AS v")
    assert split_share(df) == 0.02 and split_share(df, task_rows=12) == 0.002 and split_share(df, task_rows=0) == LEAST_SHARE
    heavy = heavy_keys(df, "k", split_share(df, task_rows=12))
    assert len(heavy) == 300
    right = spark.range(250).selectExpr("id AS k", "id * 2 AS w")
    got, want = skew_join(df, right, "k", heavy), df.join(right, "k", "left")
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == 6000
    agg = [F.count(F.lit(1)).alias("n")]
    assert skew_aggregate(df, "k", agg, [F.sum("n").alias("n")], heavy).where("n <> 20").isEmpty()
