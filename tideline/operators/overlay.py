"""The consumption overlay: what each consumer group has leased, acknowledged or given up of a log.

The state of an offset depends only on the operations on that offset, in their order, so journals fold per offset: a JVM-side
ordered aggregate, spread over as many tasks as there are offsets, however much of the log one group holds. What a group has in
common (base offset, depth, invariants) are aggregates over the folded offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READY, LEASED, ACKED, DLQ = "READY", "LEASED", "ACKED", "EVICTED_DLQ"
TERMINAL = (ACKED, DLQ)
_STATE = "struct<state:string,token:bigint,deadline_us:bigint,attempts:int,granted:int,rejected:int,outcome:string>"


def _step(max_retries: int, fenced_nack: bool):
    def step(s: Column, e: Column) -> Column:
        op, state = e["op"], s["state"]
        holds = (state == LEASED) & s["token"].eqNullSafe(e["token"])
        grant = (op == "Acquire") & (state == READY)
        nacked = (op == "Nack") & (state == LEASED) & (holds | F.lit(not fenced_nack) | e["token"].isNull())
        expired = (op == "Expire") & (state == LEASED) & (s["deadline_us"] <= e["deadline_us"])
        dropped = nacked | expired
        spent = s["attempts"] >= max_retries
        acked = (op == "Ack") & holds
        renewed = (op == "Renew") & holds
        evicted = (op == "EvictDlq") & (state != ACKED)
        redriven = (op == "Redrive") & (state == DLQ)
        plain = (op == "AckUnfenced") & (state != DLQ)
        refused = ((op == "Acquire") & ~grant) | ((op == "Ack") & ~holds & (state != ACKED)) | ((op == "Renew") & ~holds)
        new_state = (
            F.when(grant, LEASED).when(acked | plain, ACKED).when(dropped & spent, DLQ).when(dropped, READY).when(evicted, DLQ).when(redriven, READY).otherwise(state)
        )
        over = acked | plain | dropped | evicted | redriven
        # what the operation came to; an acknowledgement of what is acknowledged already passes
        outcome = (
            F.when(op == "Acquire", F.when(grant, "granted").otherwise("refused"))
            .when(op == "Ack", F.when(acked | (state == ACKED), "accepted").when(state == LEASED, "conflict:stale_token").otherwise("conflict:not_leased"))
            .when(op == "AckUnfenced", F.when(plain, "accepted").otherwise("ignored"))
            .when(op == "Renew", F.when(renewed, "renewed").when(state == LEASED, "conflict:stale_token").otherwise("conflict:not_leased"))
            .when(dropped, F.when(spent, "dead_lettered").otherwise("returned"))
            .when(evicted, "dead_lettered").when(redriven, "redriven").otherwise("ignored")
        )
        return F.struct(
            new_state.alias("state"),
            F.when(grant, e["token"]).when(~over, s["token"]).alias("token"),
            F.when(grant | renewed, e["deadline_us"]).when(~over, s["deadline_us"]).alias("deadline_us"),
            F.when(grant, s["attempts"] + 1).when(redriven | evicted | acked | plain | (dropped & spent), 0).otherwise(s["attempts"]).cast("int").alias("attempts"),
            (s["granted"] + grant.cast("int")).alias("granted"),
            (s["rejected"] + F.coalesce(refused, F.lit(False)).cast("int")).alias("rejected"),
            outcome.alias("outcome"),
        )

    return step


def fold_journal(journal: DataFrame, key: Sequence[str], max_retries: int = 3, fenced_nack: bool = False) -> DataFrame:
    """(key, log_offset, state, token, deadline_us, attempts, granted, rejected) after all operations of a journal.

    Operations have seq, op, log_offset, token and deadline_us; rows repeated under one seq count once, rows out of order are put in
    order. An acquisition is granted on READY only and counts an attempt; an acknowledgement needs the lease's token (one on
    ACKED passes), an unfenced one nothing, but it doesn't bring back a dead letter; a nack or expiry returns the offset, or gives it up after ``max_retries``
    attempts, which are counted anew then; ACKED outlives eviction. A nack isn't checked for its token unless ``fenced_nack``. Operations without offset or seq are dropped.
    """
    ops, start = _ops(journal, key)
    done = ops.withColumn("s", F.aggregate("ops", start, lambda s, e: _step(max_retries, fenced_nack)(s, e).cast(_STATE)))
    return done.select(*key, "log_offset", "s.*").drop("outcome")


def journal_outcomes(journal: DataFrame, key: Sequence[str], max_retries: int = 3, fenced_nack: bool = False) -> DataFrame:
    """(key, log_offset, seq, op, outcome): what each operation came to, by the rules of fold_journal: granted, refused, accepted, conflict:stale_token,
    conflict:not_leased, renewed, returned, dead_lettered, redriven or ignored. An acknowledgement of a dead letter is a conflict, wherever the base is."""
    ops, start = _ops(journal, key)
    seed = F.struct(start.alias("s"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        new = _step(max_retries, fenced_nack)(acc["s"], e).cast(_STATE)
        return F.struct(new.alias("s"), F.concat(acc["out"], F.array(new["outcome"])).alias("out"))

    done = ops.withColumn("a", F.aggregate("ops", seed, step)).select(*key, "log_offset", F.explode(F.arrays_zip("ops", F.col("a.out").alias("out"))).alias("o"))
    return done.select(*key, "log_offset", "o.ops.seq", "o.ops.op", F.col("o.out").alias("outcome"))


def replay_breaks(journal: DataFrame, key: Sequence[str], max_retries: int = 3) -> DataFrame:
    """(key, n_ops, aborted_at, n_replayed) of a strict replay, which an acquisition that isn't granted or an acknowledgement with another token breaks off."""
    o = journal_outcomes(journal, key, max_retries)
    bad = (F.col("outcome") == "refused") | F.col("outcome").startswith("conflict:")
    at = o.groupBy(*key).agg(F.count(F.lit(1)).alias("n_ops"), F.min(F.when(bad, F.col("seq"))).alias("aborted_at"))
    done = o.join(at, list(key)).groupBy(*key).agg(F.count_if(F.col("aborted_at").isNull() | (F.col("seq") < F.col("aborted_at"))).alias("n_replayed"))
    return at.join(done, list(key))


def _ops(journal: DataFrame, key: Sequence[str]) -> tuple[DataFrame, Column]:
    """Each offset's operations in order, and the state they start from."""
    rows = journal.where("log_offset IS NOT NULL AND seq IS NOT NULL")
    once = rows.groupBy(*key, "log_offset", "seq").agg(F.min(F.struct("op", "token", "deadline_us")).alias("e"))
    ops = once.groupBy(*key, "log_offset").agg(F.array_sort(F.collect_list(F.struct("seq", "e.op", "e.token", "e.deadline_us"))).alias("ops"))
    start = F.struct(F.lit(READY).alias("state"), F.lit(None).cast("bigint").alias("token"), F.lit(None).cast("bigint").alias("deadline_us"), F.lit(0).alias("attempts"), F.lit(0).alias("granted"), F.lit(0).alias("rejected"), F.lit(None).cast("string").alias("outcome"))
    return ops, start.cast(_STATE)


def state_of_log(log: DataFrame, folded: DataFrame, key: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Every offset of the log with its state; offsets the journal doesn't mention are READY."""
    return log.join(folded, [*key, "log_offset"], "left").withColumn("state", F.coalesce("state", F.lit(READY))).withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def base_offsets(states: DataFrame, key: Sequence[str] = ("stream_id",)) -> DataFrame:
    """The lowest offset that isn't terminal, or the one after the head: an aggregate, no global order needed."""
    open_ = ~F.col("state").isin(*TERMINAL)
    return states.groupBy(*key).agg(F.coalesce(F.min(F.when(open_, F.col("log_offset"))), F.max("log_offset") + 1).alias("w_base"), F.max("log_offset").alias("head"))


def base_of_sparse(folded: DataFrame, key: Sequence[str]) -> DataFrame:
    """base_offsets where only the journal is known: the first offset from 0 that is missing among the terminal ones."""
    term = folded.where(F.col("state").isin(*TERMINAL)).select(*key, "log_offset")
    groups = folded.groupBy(*key).agg(F.max("log_offset").alias("head"))
    candidates = term.select(*key, (F.col("log_offset") + 1).alias("log_offset")).unionByName(groups.select(*key, F.lit(0).cast("bigint").alias("log_offset")))
    first = candidates.join(term, [*key, "log_offset"], "left_anti").groupBy(*key).agg(F.min("log_offset").alias("w_base"))
    return groups.join(first, list(key))


def dead_letters(log: DataFrame, states: DataFrame, key: Sequence[str] = ("stream_id",)) -> DataFrame:
    """The virtual dead-letter queue: the log records whose offset was given up."""
    return log.join(states.where(F.col("state") == DLQ).select(*key, "log_offset"), [*key, "log_offset"], "left_semi")


def inspect(states: DataFrame, key: Sequence[str] = ("stream_id",), samples: int = 100) -> DataFrame:
    """Per group: base offset, leased, acknowledged above the base, given up, and the first ``samples`` dead letters."""
    base = base_offsets(states, key)
    j = states.join(base, list(key))
    n = lambda s: F.count_if(F.col("state") == s)
    counts = j.groupBy(*key).agg(F.max("w_base").alias("w_base"), n(READY).alias("n_ready"), n(LEASED).alias("n_leased"), F.count_if((F.col("state") == ACKED) & (F.col("log_offset") > F.col("w_base"))).alias("n_acked_above"), n(DLQ).alias("n_dlq"))
    order = Window.partitionBy(*key).orderBy("log_offset")
    first = states.where(F.col("state") == DLQ).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= samples).groupBy(*key).agg(F.array_sort(F.collect_list("log_offset")).alias("dlq_samples"))
    return counts.join(first, list(key), "left")


def invariant_breaches(states: DataFrame, key: Sequence[str] = ("stream_id",), bases: DataFrame | None = None) -> DataFrame:
    """Rows that break an invariant: an offset with two states, or one that isn't terminal below its group's base (``bases`` has key and w_base as stored; else
    the bases the states themselves give, below which nothing can be open)."""
    two = states.groupBy(*key, "log_offset").agg(F.count_distinct("state").alias("n")).where("n > 1").select(*key, "log_offset", F.lit("two_states").alias("breach"))
    held = (base_offsets(states, key) if bases is None else bases).select(*key, "w_base")
    below = states.join(held, list(key)).where((F.col("log_offset") < F.col("w_base")) & ~F.col("state").isin(*TERMINAL))
    return two.unionByName(below.select(*key, "log_offset", F.lit("open_below_base").alias("breach")))


def lease_candidates(states: DataFrame, stream_id: str, n: int, retry_first: bool = False) -> DataFrame:
    """The next offsets to lease: READY ones in ascending order (or those retried most first), at most n."""
    order = [F.col("attempts").desc(), F.col("log_offset")] if retry_first else [F.col("log_offset")]
    return states.where((F.col("stream_id") == stream_id) & (F.col("state") == READY)).orderBy(*order).limit(n)


def expired_leases(states: DataFrame, now_us: int, max_retries: int = 3) -> DataFrame:
    """Leases whose deadline has come (inclusive), with the state the offset falls back to."""
    due = states.where((F.col("state") == LEASED) & (F.col("deadline_us") <= now_us))
    return due.withColumn("next_state", F.when(F.col("attempts") >= max_retries, DLQ).otherwise(READY))


def attempts(journal: DataFrame, key: Sequence[str]) -> DataFrame:
    """The number of the attempt each acquisition is."""
    return journal.where("op = 'Acquire'").withColumn("attempt", F.row_number().over(Window.partitionBy(*key, "log_offset").orderBy("seq")).cast("bigint"))


def depth(states: DataFrame, key: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Queue attributes and lag: ready and in-flight estimates, and how far the base is behind the head."""
    j = states.join(base_offsets(states, key), list(key))
    return j.groupBy(*key).agg(F.count_if(F.col("state") == READY).alias("ready"), F.count_if(F.col("state") == LEASED).alias("in_flight"), (F.max("head") + 1 - F.max("w_base")).alias("lag"))


def snapshot(states: DataFrame, key: Sequence[str] = ("stream_id",)) -> DataFrame:
    """What a restart needs: every offset that isn't plainly READY, and not those acknowledged below the base, which the base implies.

    Leases, tokens and attempts are kept, and dead letters below the base stay dead letters.
    """
    bases = base_offsets(states, key)
    j = states.join(bases, list(key))
    implied = (F.col("state") == ACKED) & (F.col("log_offset") < F.col("w_base"))
    plain = (F.col("state") == READY) & (F.col("attempts") == 0)
    return j.where(~implied & ~plain).select(*key, "log_offset", "state", "token", "deadline_us", "attempts")


def restored(log: DataFrame, snap: DataFrame, bases: DataFrame, key: Sequence[str] = ("stream_id",)) -> DataFrame:
    """The states of a log from a snapshot and its bases."""
    j = log.join(snap, [*key, "log_offset"], "left").join(bases.select(*key, "w_base"), list(key), "left")
    state = F.coalesce("state", F.when(F.col("log_offset") < F.col("w_base"), ACKED).otherwise(READY))
    return j.withColumn("state", state).withColumn("attempts", F.coalesce("attempts", F.lit(0))).drop("w_base")


class Lease:
    """The rules of fold_journal for one offset, an operation at a time, for streams."""

    __slots__ = ("attempts", "deadline", "state", "token")

    def __init__(self) -> None:
        self.state, self.token, self.deadline, self.attempts = READY, None, None, 0

    def _set(self, state: str, attempts: int) -> None:
        self.state, self.token, self.deadline, self.attempts = state, None, None, attempts

    def apply(self, op: str, token: int | None, deadline: int | None, max_retries: int = 3) -> None:
        leased = self.state == LEASED
        holds = leased and self.token == token
        due = op == "Expire" and leased and None not in (self.deadline, deadline) and self.deadline <= deadline
        if op == "Acquire" and self.state == READY:
            self.state, self.token, self.deadline, self.attempts = LEASED, token, deadline, self.attempts + 1
        elif (op == "Ack" and holds) or (op == "AckUnfenced" and self.state != DLQ):
            self._set(ACKED, 0)
        elif due or (op == "Nack" and leased):
            spent = self.attempts >= max_retries
            self._set(DLQ if spent else READY, 0 if spent else self.attempts)
        elif op == "Renew" and holds:
            self.deadline = deadline
        elif op == "EvictDlq" and self.state != ACKED:
            self._set(DLQ, 0)
        elif op == "Redrive" and self.state == DLQ:
            self._set(READY, 0)
