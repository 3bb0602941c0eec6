import random

from tideline.operators.late import HOUR_US, CounterState, arrivals, late_records, merge_counters, period_counters, source_counters
from tideline.streaming import pipelines

REC = "record_id bigint, batch_id bigint, stream_id string, payload_len int, timestamp_delta_ms bigint"
HEAD = "batch_id bigint, timestamp_us bigint, physical_ms bigint, hlc_logical int, hlc_node_id int"
H = HOUR_US // 1000  # an hour in ms


def make(spark, recs, heads, rec=REC, head=HEAD):
    return spark.createDataFrame(recs, rec), spark.createDataFrame(heads, head)


def test_verdicts_at_the_limits(spark):
    heads = [(b, 0, ms, 0, 0) for b, ms in ((1, H - 1), (2, H), (3, 3 * H - 1), (4, 3 * H))]
    recs = [(10 + b, b, "s", 1, 5) for b in (1, 2, 3, 4)] + [(20, 2, "s", 1, H), (21, 2, "s", 1, None), (22, 9, "s", 1, 0), (None, 2, "s", 1, 0)]
    got = {r.record_id: r.verdict for r in arrivals(*make(spark, recs, heads)).collect()}
    # 20 happens at the very start of the second hour
    assert got == {11: "on_time", 12: "late", 13: "late", 14: "too_late", 20: "on_time", 21: None, 22: None}


def test_repeats_change_nothing(spark):
    heads, recs = [(1, 0, H, 0, 0)], [(1, 1, "s", 7, 0), (2, 1, "s", 8, 0)]
    once = period_counters(*make(spark, recs, heads)).collect()
    again = period_counters(*make(spark, recs * 3, heads * 2)).collect()
    assert once == again and (once[0].first_count, once[0].corrected_count, once[0].corrected_bytes) == (0, 2, 15)


def test_a_record_sent_again_counts_once_with_its_last_state(spark):
    heads = [(1, 0, 10, 0, 0), (2, 0, 10, 1, 0)]
    got = period_counters(*make(spark, [(1, 1, "s", 5, 0), (1, 2, "s", 6, 0)], heads)).collect()
    assert [(r.first_count, r.first_bytes) for r in got] == [(1, 6)]


def test_null_key_null_weight_before_1970(spark):
    got = period_counters(*make(spark, [(1, 1, None, None, 0), (2, 1, None, 3, 0)], [(1, -1, -1, 0, 0)])).collect()
    assert [(r.stream_id, r.first_count, r.first_bytes, str(r.period_start)) for r in got] == [(None, 2, 3, "1969-12-31 23:00:00")]


def test_empty_and_clashing_columns(spark):
    assert late_records(*make(spark, [], [])).count() == 0
    recs, heads = make(spark, [(1, 1, "s", 1, 0, "x", "y", 1)], [(1, 0, H, 0, 0, "z")], REC + ", verdict string, arrival string, event_us int", HEAD + ", register string")
    assert [tuple(r) for r in late_records(recs, heads).collect()] == [(1, "late")]
    assert period_counters(recs, heads).count() == 1


def test_hot_batch(spark):
    recs = spark.range(20_000).selectExpr("id AS record_id", "IF(id % 3 = 0, 1, id) AS batch_id", "'s' AS stream_id", "1 AS payload_len", "0L AS timestamp_delta_ms")
    heads = spark.range(20_000).selectExpr("id AS batch_id", "0L AS timestamp_us", f"{H}L AS physical_ms", "0 AS hlc_logical", "0 AS hlc_node_id")
    assert late_records(recs, heads).count() == 20_000


def some(n=240, seed=3):
    r = random.Random(seed)
    heads = [(b, r.randrange(3 * H) * 1000, r.randrange(6 * H), b % 3, 0) for b in range(20)]
    return [(i, r.randrange(21), r.choice(["s", "s", "t", None]), r.choice([1, 7, None]), r.choice([None, 0, H // 2, H])) for i in range(n)], heads


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_replayed_repeated_and_shuffled_deliveries_give_the_same_counters(spark, tmp_path):
    recs, heads = some()
    want = rows_of(period_counters(*make(spark, recs, heads)))
    for seed in (1, 2):
        r = random.Random(seed)
        rows = recs + r.choices(recs, k=60)  # delivered again, in the same or another delivery
        r.shuffle(rows)
        cuts = sorted(r.sample(range(len(rows)), 3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        state = CounterState(spark, f"file://{tmp_path}/{seed}")
        assert state.totals() is None
        for epoch, part in enumerate(parts):
            known = heads if epoch == len(parts) - 1 else heads[: 5 * (epoch + 1)]  # some headers come after their records
            df, h = make(spark, part, known)
            state.apply(df, h, epoch)
            state.apply(df, h, epoch)  # replayed after it was complete
            if seed == 2 and epoch == 1:
                state.compact()
                state.apply(df, h, epoch)
        assert rows_of(state.totals()) == want
        if seed == 2:
            state.compact(closed_before_us=2 * HOUR_US)
            assert rows_of(state.totals()) == want and state.applied(0)
            continue
        # a delivery that broke off before its counters were complete is written anew
        import shutil

        shutil.rmtree(f"{tmp_path}/{seed}/counters/epoch={len(parts) - 1}")
        state.apply(*make(spark, parts[-1], heads), len(parts) - 1)
        assert rows_of(state.totals()) == want


def test_merging_counters_is_idempotent_and_in_any_order(spark):
    recs, heads = some()
    early, all_ = (source_counters(arrivals(*make(spark, x, heads), columns=["stream_id", "payload_len"]), "stream_id", "payload_len") for x in (recs[:100], recs))
    one, two = merge_counters(early.unionByName(all_), "stream_id"), merge_counters(all_.unionByName(early).unionByName(early), "stream_id")
    assert rows_of(one) == rows_of(two) == rows_of(all_)


def test_streamed_counters_are_those_of_the_batch(spark, tmp_path):
    recs, heads = some(90, 8)
    df, h = make(spark, recs + recs[:20], heads)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    state = CounterState(spark, f"file://{tmp_path}/state")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        pipelines.late_counters(stream, lambda: h, state, f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    assert rows_of(state.totals()) == rows_of(period_counters(df, h))
