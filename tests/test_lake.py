import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideline.functions import ids
from test_overlay import journal
from tideline.operators import govern, lookup, overlay, registry, shred
from tideline.sources import log
from tideline.sources.ledger import CommitConflict, Ledger
from tideline.streaming import pipelines


def file(n):
    return {"path": f"p{n}", "record_count": n, "size_bytes": 10 * n}


def test_commits_conflicts_expiry(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/t", "fast")
    a = book.commit([file(1000)], None, 1_700_000_000_000)
    with pytest.raises(CommitConflict):
        book.commit([file(1)], None)
    b = book.commit([file(500)], a.snapshot_id, 1_700_000_060_000)
    assert (b.snapshot_id, b.parent_id, b.total_records, b.added_records) == (2, 1, 1500, 500)
    assert book.expire(1_700_000_030_000, held=True) == 0
    assert book.expire(1_700_000_030_000) == 1 and [s.snapshot_id for s in book.snapshots()] == [2]
    assert book.expire(2**60) == 0
    assert [book.due(*x) for x in ((10_000, 4000), (10_000, 7000), (6000, 0), (2000, 0))] == [True, False, True, False]


def test_time_travel_evolution_orphans_and_codecs(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/t")
    for i, codec in enumerate(("snappy", "zstd", "lz4", "none")):
        df = spark.range(i + 1).withColumn(f"c{i}", F.lit(i))
        book.append(df, codec=codec, commit_id=f"b{i}")
        book.append(df, codec=codec, commit_id=f"b{i}")
    assert book.read().count() == 10 and book.read(as_of=2).count() == 3
    assert set(book.read().columns) == {"id", "c0", "c1", "c2", "c3"} and book.read().where("c3 IS NULL").count() == 6
    assert book.orphans() == []
    spark.range(1).coalesce(1).write.parquet(f"file://{tmp_path}/t/data/stray")
    stray = book.orphans()
    assert len(stray) == 1 and book.orphans(frozenset(stray)) == []


def test_offsets_continue_from_the_head_and_layout(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 200, "w"), (None, 1, "n")], "stream_id string, at int, body string")
    heads = spark.createDataFrame([("a", 10)], "stream_id string, head_offset bigint")
    out = log.dense_offsets(df, "stream_id", ["at"], F.floor(F.col("at") / 100), head=heads)
    assert {(r.stream_id, r.at): r.log_offset for r in out.collect()} == {("a", 1): 10, ("a", 3): 11, ("a", 200): 12, ("b", 2): 0, (None, 1): 0}
    log.write_layout(out.withColumn("ingest_ts", F.lit("2024-01-01").cast("timestamp")), str(tmp_path / "l"), buckets=2)
    back = log.read_layout(spark, str(tmp_path / "l"))
    assert back.count() == 5 and {"event_date", "stream_bucket"} <= set(back.columns)
    assert list(Path(tmp_path / "l").glob("event_date=*/stream_bucket=*"))


SHRED = "position bigint, payload string"


def test_shred(spark):
    rows = spark.createDataFrame([(0, '{"user_id":"u1","action":"login","extra1":"val1"}'), (1, '{"user_id":"u2","action":"click","extra2":"val2"}'), (2, '{"user_id":"u3","amount":99,"excess_field":"overflow"}'), (3, "[1,2]"), (4, '{"user_id":null}'), (5, None), (6, "{x")], SHRED)
    seen = shred.field_observations(rows, "position", "payload")
    names = [r.field for r in shred.first_come(seen, 3).collect()]
    assert names == ["action", "extra1", "user_id"] and [r.field for r in shred.first_come(seen, 3, ["user_id", "zz"]).collect()] == ["action"]
    out = shred.shred(rows, "payload", names, keep=["position"])
    assert out.columns == ["position", "action", "extra1", "user_id", shred.OVERFLOW]
    got = {r.position: tuple(r)[1:] for r in out.collect()}
    assert got[0] == ("login", "val1", "u1", None) and got[1] == ("click", None, "u2", '{"extra2":"val2"}')
    assert got[2][:3] == (None, None, "u3") and json.loads(got[2][3]) == {"amount": 99, "excess_field": "overflow"}
    assert got[3] == (None, None, None, '{"raw":[1,2]}') and got[4][2] == "null" and got[5] == (None,) * 4 and json.loads(got[6][3]) == {"raw": "{x"}
    assert shred.shred(rows, "payload", names, keep=["position"], null_mode="missing").where("position = 4").first().user_id is None
    assert [r.field for r in shred.ranked_schema(seen, 2).collect()] == ["user_id", "action"]
    assert shred.shred(rows.limit(0), "payload", []).columns == [shred.OVERFLOW]


def test_lookups(spark):
    left = spark.createDataFrame([("a", x) for x in (50, 100, 250, 99_999)] + [("b", 1)], "k string, at bigint")
    right = spark.createDataFrame([("a", 100, 1), ("a", 200, 2), ("a", 200, 3), ("b", 2, 9)], "k string, at bigint, v int")
    assert {(r.k, r.at): r.v for r in lookup.asof_backward(left, right, "k", "at", ["v"], 64).collect()} == {("a", 50): None, ("a", 100): 1, ("a", 250): 3, ("a", 99_999): 3, ("b", 1): None}
    chunks = spark.createDataFrame([("a", 0, 99), ("a", 100, 260)], "k string, start_offset bigint, end_offset bigint")
    assert {(r.k, r.at): r.start_offset for r in lookup.covering(left, chunks, "k", "at", 64, ["start_offset", "end_offset"]).collect()} == {("a", 50): 0, ("a", 100): 100, ("a", 250): 100, ("a", 99_999): None, ("b", 1): None}


def test_compatibility(spark):
    s = "subject string, field string, type string, required boolean"
    old = spark.createDataFrame([("s", "id", "long", True), ("s", "user", "string", False), ("t", "x", "int", False), ("u", "x", "int", True)], s)
    new = spark.createDataFrame([("s", "id", "long", True), ("s", "user", "string", False), ("s", "email", "string", False), ("t", "x", "int", True), ("u", "y", "int", False)], s)
    assert {r.subject: (r.backward, r.forward, r.full) for r in registry.compatibility(old, new).collect()} == {"s": (True, True, True), "t": (False, True, False), "u": (True, False, False)}
    assert (registry.widened("int", "long"), registry.widened("long", "float"), registry.widened("int", "string")) == ("long", "double", None)


def test_encryption_and_chain(spark):
    df = spark.createDataFrame([(1, 1, "t", "hello"), (2, 2, "t", "world")], "id int, dek_id int, stream string, body string")
    keys = spark.createDataFrame([(1, bytearray(range(32))), (2, bytearray(range(1, 33)))], "dek_id int, dek binary")
    sealed = govern.encrypt(df, "body", keys, "dek_id", F.col("stream"))
    assert "body" not in sealed.columns
    assert {r.id: r.payload for r in govern.decrypt(sealed, keys.where("dek_id = 1"), "dek_id", F.col("stream")).collect()} == {1: "hello", 2: None}
    assert govern.decrypt(sealed, keys, "dek_id", F.lit("other")).where("payload IS NOT NULL").isEmpty()
    ev = spark.createDataFrame([(1, i, f"a{i}") for i in range(20)], "tenant_id int, seq int, action string")
    chain = govern.build_chain(ev, ["seq", "action"])
    assert govern.verify_chain(chain, ["seq", "action"]).where("NOT intact").isEmpty()
    forged = chain.withColumn("action", F.when(F.col("seq") == 7, "x").otherwise(F.col("action")))
    assert [r.seq for r in govern.verify_chain(forged, ["seq", "action"]).where("NOT intact").collect()] == [7]


def test_handles_and_tokens(spark):
    row = spark.range(1).select(ids.receipt_handle(F.lit(7), F.lit(12), F.lit(999), F.lit(0x12345678)).alias("h"), ids.unpack_token(ids.pack_token(F.lit(42), F.lit(7), F.lit(1001))).alias("t"), ids.queue_group(F.lit("https://x/1/orders-queue")).alias("g")).select("*", ids.parse_handle(F.col("h")).alias("p"), ids.parse_handle(F.lit("RH-x")).alias("bad")).first()
    assert row.h == "RH-00000007-000000000000000c-00000000000003e7-12345678" and tuple(row.p) == (7, 12, 999, 0x12345678) and row.bad is None
    assert tuple(row.t) == (42, 7, 1001) and row.g == "sqs-group-orders-queue"


def test_partitions_are_pruned(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('s', id % 5) AS stream_id", "id AS log_offset", "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 8 AS INT)) AS ingest_ts")
    log.write_layout(rows, f"{tmp_path}/l", buckets=2)
    own = log.read_layout(spark, f"{tmp_path}/l").where("event_date = date'2024-01-03' AND stream_bucket = 1 AND log_offset > 10")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(log_offset)" in plan
    files = own.select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "event_date=2024-01-03/stream_bucket=1" in files[0][0]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def source(spark, tmp_path, df, name):
    df.repartition(2).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_stream_into_the_ledger_once(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    book = Ledger(spark, f"file://{tmp_path}/t")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")) if (tmp_path / "in").exists() else source(spark, tmp_path, df, "in")
        pipelines.ingest(stream, book, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert book.read().count() == 100 and len(book.snapshots()) == 2


def run(stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_state(rocks, tmp_path):
    spark = rocks
    rows = [("p", 0, 0, 0, 2, 10), ("p", 1, 0, 0, 2, 12), ("p", 2, 0, 2, 2, 14), ("q", 3, 1, 5, 1, 16), ("q", 4, 0, 6, 1, 18)]
    df = spark.createDataFrame(rows, "k string, arrival bigint, producer_epoch bigint, base_sequence bigint, n_records bigint, next_offset bigint").coalesce(1)
    run(pipelines.idempotent_produce(source(spark, tmp_path, df.coalesce(1), "prod"), "k"), tmp_path, "produced", "append")
    assert {r.arrival: r.outcome for r in spark.table("produced").collect()}.keys() == set(range(5))
    bare = spark.createDataFrame([(-1, 1, 0, 5, 1, 10), (-1, 2, 0, 5, 1, 11)], "producer_id bigint, arrival bigint, producer_epoch bigint, base_sequence bigint, n_records bigint, next_offset bigint").withColumn("k", F.lit("free"))
    bare.coalesce(1).write.parquet(str(tmp_path / "free"))
    run(pipelines.idempotent_produce(spark.readStream.schema(bare.schema).parquet(str(tmp_path / "free")), "k"), tmp_path, "free", "append")
    assert {r.arrival: (r.outcome, r.base_offset) for r in spark.table("free").collect()} == {1: ("accepted", 10), 2: ("accepted", 11)}


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_leases_are_those_of_the_journal(rocks, tmp_path, seed):
    """A random journal in random order, cut into micro-batches."""
    spark = rocks
    rows = journal(random.Random(seed), 240, 12)
    j = spark.createDataFrame([(f"{s}:{o}", s, o, *rest) for s, o, *rest in rows], "k string, stream_id string, log_offset bigint, seq bigint, op string, token bigint, deadline_us bigint")
    stream = source(spark, tmp_path, j.repartition(3), "ops")
    run(pipelines.leases(stream, "k"), tmp_path, f"leased{seed}", "update")
    latest = {}
    for r in spark.table(f"leased{seed}").collect():  # in the order of the micro-batches
        latest[r.key] = (r.state, r.token, r.deadline_us, r.attempts)
    want = {f"{r.stream_id}:{r.log_offset}": (r.state, r.token, r.deadline_us, r.attempts) for r in overlay.fold_journal(j.drop("k"), ["stream_id"]).collect()}
    assert latest == want


def test_stream_duplicates(spark, tmp_path):
    ts = lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"
    df = spark.createDataFrame([("a", 1, ts(0, 1), 5), ("a", 1, ts(0, 2), 5), ("a", 2, ts(0, 50), 7), ("b", 3, ts(1, 10), 1), ("a", 4, ts(9, 0), 1)], "k string, id int, t string, w int").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    run(pipelines.deduplicate(read(), ["id"], "t"), tmp_path, "once", "append")
    assert spark.table("once").count() == 4
