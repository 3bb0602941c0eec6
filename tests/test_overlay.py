import random

import pytest

from tideline.operators import overlay
from tideline.operators.producer import Hlc, ProducerState, fold_producers

J = "stream_id string, log_offset bigint, seq bigint, op string, token bigint, deadline_us bigint"
KEY = ["stream_id"]


def plain(rows, max_retries=3):
    """The journal folded one row after the other."""
    state = {}
    for s, o, _, op, token, deadline in sorted({(r[0], r[1], r[2]): r for r in rows}.values(), key=lambda r: r[2]):
        st, tok, dl, att = state.get((s, o), ("READY", None, None, 0))
        holds = st == "LEASED" and tok == token
        if op == "Acquire" and st == "READY":
            st, tok, dl, att = "LEASED", token, deadline, att + 1
        elif (op == "Ack" and holds) or (op == "AckUnfenced" and st != "EVICTED_DLQ"):
            st, tok, dl, att = "ACKED", None, None, 0
        elif op == "Nack" and st == "LEASED":
            st, tok, dl, att = ("EVICTED_DLQ", None, None, 0) if att >= max_retries else ("READY", None, None, att)
        elif op == "EvictDlq" and st != "ACKED":
            st, tok, dl, att = "EVICTED_DLQ", None, None, 0
        elif op == "Redrive" and st == "EVICTED_DLQ":
            st, tok, dl, att = "READY", None, None, 0
        elif op == "Renew" and holds:
            dl = deadline
        elif op == "Expire" and st == "LEASED" and dl is not None and dl <= deadline:
            st, tok, dl, att = ("EVICTED_DLQ", None, None, 0) if att >= max_retries else ("READY", None, None, att)
        state[s, o] = (st, tok, dl, att)
    return state


def journal(rng, n, offsets=60):
    """Random operations, some repeated, in random order."""
    rows = []
    for seq in range(n):
        op = rng.choice(["Acquire", "Acquire", "Acquire", "Ack", "Ack", "Nack", "EvictDlq", "Redrive", "Renew", "Expire", "AckUnfenced"])
        rows.append((rng.choice("ab"), rng.randrange(offsets), seq, op, rng.choice([2**60 + rng.randrange(4), None]) if op in ("Acquire", "Ack", "Renew") else None, rng.randrange(n) if op in ("Acquire", "Renew", "Expire") else None))
    rows += rng.sample(rows, n // 10)
    rng.shuffle(rows)
    return rows


def fold(spark, rows, **how):
    return {(r.stream_id, r.log_offset): (r.state, r.token, r.deadline_us, r.attempts) for r in overlay.fold_journal(spark.createDataFrame(rows, J), KEY, **how).collect()}


def test_fold_like_a_plain_one(spark):
    rows = journal(random.Random(4), 3000)
    assert fold(spark, rows) == plain(rows)


def test_outcomes(spark):
    ops = [("Acquire", 7, 9), ("Acquire", 8, 9), ("Ack", 8, None), ("Renew", 7, 20), ("Nack", None, None), ("Ack", 7, None), ("Acquire", 9, 30), ("Expire", None, 30), ("Acquire", 1, 9), ("Nack", None, None), ("Ack", 1, None), ("AckUnfenced", None, None), ("Redrive", None, None), ("AckUnfenced", None, None), ("Ack", 5, None), ("EvictDlq", None, None)]
    df = spark.createDataFrame([("s", 0, i, op, t, d) for i, (op, t, d) in enumerate(ops)], J)
    got = [r.outcome for r in overlay.journal_outcomes(df, KEY).orderBy("seq").collect()]
    assert got == ["granted", "refused", "conflict:stale_token", "renewed", "returned", "conflict:not_leased", "granted", "returned", "granted", "dead_lettered", "conflict:not_leased", "ignored", "redriven", "accepted", "accepted", "ignored"]
    r = overlay.fold_journal(df, KEY).first()
    assert (r.state, r.granted, r.rejected, r.attempts) == ("ACKED", 3, 4, 0)


def test_the_real_journal(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lease_deltas.parquet").selectExpr("concat_ws('|', tenant_id, stream_id, group_id) AS stream_id", "log_offset", "seq", "op", "token", "deadline_us")
    rows = [tuple(r) for r in df.collect()]
    assert fold(spark, rows) == plain(rows)


def test_tokens_attempts_and_expiry(spark):
    lease = [("s", 0, 1, "Acquire", 7, 100), ("s", 0, 2, "Nack", None, None), ("s", 0, 3, "Acquire", 8, 100)]
    assert fold(spark, [*lease, ("s", 0, 4, "Ack", 7, None)])["s", 0][:2] == ("LEASED", 8)
    assert fold(spark, [*lease, ("s", 0, 5, "Ack", 8, None)])["s", 0][0] == "ACKED"
    assert fold(spark, [*lease, ("s", 0, 4, "Expire", None, 99)])["s", 0][0] == "LEASED"
    assert fold(spark, [*lease, ("s", 0, 4, "Expire", None, 100)], max_retries=2)["s", 0][0] == "EVICTED_DLQ"
    assert fold(spark, [*lease, ("s", 0, 4, "Nack", 7, None)], fenced_nack=True)["s", 0][0] == "LEASED"


@pytest.mark.parametrize(("states", "base"), [("AAA", 3), ("DAR", 2), ("RAA", 0), ("ALD", 1), ("DDL", 2)])
def test_base_offsets(spark, states, base):
    full = {"A": "ACKED", "D": "EVICTED_DLQ", "R": "READY", "L": "LEASED"}
    df = spark.createDataFrame([("s", i, full[x]) for i, x in enumerate(states)], "stream_id string, log_offset bigint, state string")
    assert overlay.base_offsets(df).first().w_base == base
    assert overlay.base_of_sparse(df.where("state <> 'READY'"), KEY).first().w_base == base
    assert overlay.invariant_breaches(df).count() == 0


def test_large_offsets_and_empty(spark):
    assert fold(spark, [("s", 4_500_000_001, 1, "Acquire", 1, None)])["s", 4_500_000_001][0] == "LEASED"
    assert fold(spark, []) == {} and fold(spark, [("s", None, 1, "Ack", 1, None), ("s", 1, None, "Ack", 1, None)]) == {}


def test_producers(spark):
    s = ProducerState()
    assert [s.offer(0, 0, 5, 100), s.offer(0, 0, 5, 1), s.offer(0, 10, 1, 1), s.offer(0, 5, 5, 105), s.offer(1, 40, 1, 110), s.offer(0, 41, 1, 1), s.offer(1, 41, 0, 1)] == [
        ("accepted", 100), ("duplicate", 100), ("out_of_order", None), ("accepted", 105), ("accepted", 110), ("fenced", None), ("empty", None)]
    rows = [(1, "t", 0, 0, 0, 0, 2, 10), (1, "t", 0, 1, 0, 0, 2, 12), (-1, "t", 0, 2, 0, 0, 2, 14), (-1, "t", 0, 3, 0, 0, 2, 16)]
    df = spark.createDataFrame(rows, "producer_id bigint, topic string, partition int, arrival bigint, producer_epoch int, base_sequence bigint, n_records int, next_offset bigint")
    assert {r.arrival: (r.outcome, r.base_offset) for r in fold_producers(df).collect()} == {0: ("accepted", 10), 1: ("duplicate", 10), 2: ("accepted", 14), 3: ("accepted", 16)}


def test_hlc():
    a, b = Hlc(1), Hlc(2)
    assert (a.now(1000), t2 := a.now(1000)) == ((1000, 0, 1), (1000, 1, 1))
    assert b.update(t2, 950) == (1000, 2, 2)
