"""Structured Streaming: the same operators over unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.late import CounterState
from ..operators.overlay import Lease
from ..operators.producer import ProducerState
from ..sources.ledger import Ledger

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRIGGERS = {"standard": "60 seconds", "fast": "5 seconds", "relaxed": "5 minutes"}


def ingest(stream: DataFrame, ledger: Ledger, checkpoint: str, available_now: bool = False, name: str = "ingest") -> StreamingQuery:
    """Append a stream to a ledger, one snapshot per micro-batch; a batch replayed after a failure is committed once, by its id."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            ledger.append(batch, commit_id=f"{name}-{batch_id}")

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGERS[ledger.cadence])).start()


def deduplicate(stream: DataFrame, identifiers: list[str], time: str, within: str = "10 minutes") -> DataFrame:
    """Drop repeats that come within a bounded time of the first; the state older than that is forgotten."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(identifiers)


def late_counters(records: DataFrame, batches: Callable[[], DataFrame], state: CounterState, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Merge a stream of records into the counters of their event periods, by the same rules as in batch: see late.CounterState.

    ``batches`` gives the headers known by now; it is called for every micro-batch. A micro-batch that is replayed, or records that are delivered again,
    change nothing, and a record is on time, late or too late by its batch's arrival, not by the stream's progress.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        state.apply(batch, batches(), batch_id)

    writer = records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGERS["standard"])).start()


class Producers(StatefulProcessor):
    """Idempotent produce: one ProducerState per key. A producer id of -1 isn't checked and keeps no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "epoch bigint, last bigint, off bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else (None, None, None)
        state = ProducerState(*held)
        for r in sorted(rows, key=lambda r: r.arrival):
            outcome, offset = ("accepted", r.next_offset) if r.producer_id == -1 else state.offer(r.producer_epoch, r.base_sequence, r.n_records, r.next_offset)
            yield Row(arrival=r.arrival, outcome=outcome, base_offset=offset)
        self.state.update((state.epoch, state.last, state.offset))

    def close(self) -> None:
        pass


def idempotent_produce(stream: DataFrame, key: str) -> DataFrame:
    """Outcome per producer batch, in the order of arrival inside a micro-batch and of the micro-batches; needs the RocksDB state store (STATE_STORE).

    A micro-batch's batches of one producer are sorted by one task: batches of records, not records.
    """
    named = stream if "producer_id" in stream.columns else stream.withColumn("producer_id", F.lit(None).cast("bigint"))
    return named.groupBy(key).transformWithState(Producers(), "arrival bigint, outcome string, base_offset bigint", "Append", "none")


class Leases(StatefulProcessor):
    """The overlay of one (group, stream, offset), by the rules of fold_journal.

    The state has the offset's operations by seq, so that one that comes late, in another micro-batch than those after it, takes its place, and one that is
    repeated changes nothing; the outcome is that of the whole journal so far. An offset has a few operations, one lease's for each attempt.
    """

    max_retries = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ops = handle.getMapState("ops", "seq bigint", "op string, token bigint, deadline bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        low = lambda op: tuple((x is not None, x) for x in op)
        for r in rows:
            if r.seq is None:
                continue
            op, at = (r.op, r.token, r.deadline_us), (r.seq,)
            if not self.ops.containsKey(at) or low(op) < low(tuple(self.ops.getValue(at))):
                self.ops.updateValue(at, op)
        lease = Lease()
        for _, op in sorted(((k[0], tuple(v)) for k, v in self.ops.iterator()), key=lambda x: x[0]):
            lease.apply(*op, self.max_retries)
        yield Row(key=key[0], state=lease.state, token=lease.token, deadline_us=lease.deadline, attempts=lease.attempts)

    def close(self) -> None:
        pass


def leases(stream: DataFrame, key: str) -> DataFrame:
    """The state of every offset a micro-batch touched; needs the RocksDB state store (STATE_STORE)."""
    return stream.groupBy(key).transformWithState(Leases(), "key string, state string, token bigint, deadline_us bigint, attempts int", "Update", "none")
