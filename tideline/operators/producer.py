"""Idempotent producers, epochs and clocks: checks that follow the order of arrival within a key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running

OUTCOMES = "outcome string, base_offset bigint"


class ProducerState:
    """Last sequence per (producer, topic, partition): the exact rules, for folds in batch and stream."""

    def __init__(self, epoch: int | None = None, last: int | None = None, offset: int | None = None) -> None:
        self.epoch, self.last, self.offset = epoch, last, offset

    def offer(self, epoch: int, base: int, n: int, next_offset: int) -> tuple[str, int | None]:
        """(outcome, base offset) of a batch of n records. The first batch of a producer, or of a higher epoch, may start anywhere; one at
        or below the last sequence is a duplicate and gets the last batch's offset; a gap is out of order; a lower epoch is fenced."""
        if n <= 0:
            return "empty", None
        if self.epoch is not None and epoch < self.epoch:
            return "fenced", None
        if self.epoch is not None and epoch == self.epoch and self.last is not None:
            if base <= self.last:
                return "duplicate", self.offset
            if base > self.last + 1:
                return "out_of_order", None
        self.epoch, self.last, self.offset = epoch, base + n - 1, next_offset
        return "accepted", next_offset


def fold_producers(batches: DataFrame, key: Sequence[str] = ("producer_id", "topic", "partition"), order: str = "arrival") -> DataFrame:
    """Each producer batch with its outcome, in order of arrival per key. A producer id of -1 isn't checked, and its batches go nowhere.

    The rules are sequential per producer and partition: a key's batches (not records) are one task's, streamed in order with one state, never held.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema) + ", " + OUTCOMES
    cols = batches.columns
    free = batches.where("producer_id = -1").select("*", F.lit("accepted").alias("outcome"), F.col("next_offset").cast("bigint").alias("base_offset"))
    checked = batches.where("producer_id IS NULL OR producer_id <> -1").repartition(*key).sortWithinPartitions(*key, order)

    def fold(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, ProducerState()
        for b in parts:
            outcomes, offsets = [], []
            for *k, epoch, base, n, offset in zip(*[b.column(c).to_pylist() for c in (*key, "producer_epoch", "base_sequence", "n_records", "next_offset")], strict=True):
                if k != now:
                    now, state = k, ProducerState()
                outcome, at = state.offer(epoch, base, n, offset)
                outcomes.append(outcome)
                offsets.append(at)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(outcomes, pa.string()), pa.array(offsets, pa.int64())], names=[*cols, "outcome", "base_offset"])

    return checked.mapInArrow(fold, schema).unionByName(free)


def check_sequences(batches: DataFrame, key: Sequence[str], order: str, base: str = "base_sequence", n: str = "n_records", block: Column | None = None) -> DataFrame:
    """The same for logs without gaps or epochs, by running maxima: a batch at or below the greatest sequence seen before is a duplicate."""
    seen = F.col("seen_")
    outcome = F.when(seen.isNull(), "accepted").when(F.col(base) <= seen, "duplicate").when(F.col(base) > seen + 1, "out_of_order").otherwise("accepted")
    return running(batches, key, [order], F.col(base) + F.col(n) - 1, "seen_", block=block, before=True).withColumn("outcome", outcome).drop("seen_")


def fence_epochs(rows: DataFrame, key: Sequence[str], order: str, epoch: str = "epoch", block: Column | None = None) -> DataFrame:
    """``fenced`` where a row's epoch is below the greatest one before it. With a ``block`` (see running) a hot key is many tasks'."""
    return running(rows, key, [order], F.col(epoch), "max_epoch", block=block).withColumn("fenced", F.col(epoch) < F.col("max_epoch"))


def window_duplicates(rows: DataFrame, key: Sequence[str], order: str, seconds: float, tie: Sequence[str] = (), sequence: str | None = None, most: int = 10_000, block: Column | None = None) -> DataFrame:
    """``duplicate`` where the same key came at most ``seconds`` before: a bounded deduplication window. With a ``sequence`` number it also ends after so many numbers.

    The row before in order has the greatest time of all before, so a running maximum does, and with a ``block`` (see running) a hot key is many tasks'.
    """
    at = F.unix_micros(F.col(order).cast("timestamp"))
    out = running(rows, key, [order, *tie], at, "before_", block=block, before=True)
    near = at - F.col("before_") <= int(seconds * 1_000_000)
    if sequence is not None:
        out = out.withColumn("seq_", F.lag(sequence).over(Window.partitionBy(*key).orderBy(order, *tie)))
        near = near & F.coalesce(F.col(sequence) - F.col("seq_") <= most, F.lit(True))
    return out.withColumn("duplicate", F.coalesce(near, F.lit(False))).drop("before_", "seq_")


def hlc_now(rows: DataFrame, key: Sequence[str], order: str, physical: str = "physical_ms", block: Column | None = None) -> DataFrame:
    """Hybrid logical clock of local events: the running maximum of the physical time, and the count inside its plateau."""
    top = running(rows, key, [order], F.col(physical), "hlc_ms", block=block)
    return top.withColumn("hlc_count", (F.row_number().over(Window.partitionBy(*key, "hlc_ms").orderBy(order)) - 1).cast("bigint"))


def hlc_receive(rows: DataFrame, key: Sequence[str], order: Sequence[str], physical: str, remote_ms: str, remote_count: str) -> DataFrame:
    """The clock of a receiver after each message: hlc_ms and hlc_count by the update rule, or by that for local events where there is no remote time.

    Each step depends on the last, so a receiver's messages are one task's, streamed in order with one clock, never held.
    """
    cols = rows.columns
    ordered = rows.repartition(*key).sortWithinPartitions(*key, *order)

    def tick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, clock = None, Hlc(0)
        for b in batches:
            ms, counts = [], []
            for *k, own, r_ms, r_count in zip(*[b.column(c).to_pylist() for c in (*key, physical, remote_ms, remote_count)], strict=True):
                if k != now:
                    now, clock = k, Hlc(0)
                got = clock.now(own or 0) if r_ms is None else clock.update((r_ms, r_count or 0, 0), own or 0)
                ms.append(got[0])
                counts.append(got[1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(ms, pa.int64()), pa.array(counts, pa.int64())], names=[*cols, "hlc_ms", "hlc_count"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", hlc_ms bigint, hlc_count bigint"
    return ordered.mapInArrow(tick, schema)


class Hlc:
    """now and update of a hybrid logical clock, for receivers."""

    def __init__(self, node: int) -> None:
        self.node, self.ms, self.count = node, 0, 0

    def now(self, physical: int) -> tuple[int, int, int]:
        self.ms, self.count = (physical, 0) if physical > self.ms else (self.ms, self.count + 1)
        return self.ms, self.count, self.node

    def update(self, other: tuple[int, int, int], physical: int) -> tuple[int, int, int]:
        top = max(self.ms, other[0], physical)
        if top == self.ms == other[0]:
            self.count = max(self.count, other[1]) + 1
        elif top == self.ms:
            self.count += 1
        elif top == other[0]:
            self.count = other[1] + 1
        else:
            self.count = 0
        self.ms = top
        return self.ms, self.count, self.node
