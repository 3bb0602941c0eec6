"""A small client over one log folder: produce, consume, lease. Every call is a plan over the stored tables; there is no server."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import overlay
from .sources import log
from .sources.ledger import Ledger

_JOURNAL = "stream_id string, group_id string, log_offset bigint, seq bigint, op string, token bigint, deadline_us bigint"
_KEY = ["stream_id", "group_id"]


class Client:
    """Streams of records in a ledger, and the journal of what groups did with them in another."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.records = Ledger(spark, f"{path.rstrip('/')}/records")
        self.journal = Ledger(spark, f"{path.rstrip('/')}/journal")

    def log(self) -> DataFrame | None:
        """All records with their offsets, or None before the first."""
        return self.records.read() if self.records.current() else None

    def produce(self, rows: DataFrame, order: Sequence[str], commit_id: str | None = None) -> int:
        """Append rows (stream_id, ...): offsets go on from each stream's head, in the given order. A commit id that was used before appends nothing. Returns how many records there are."""
        held = self.log()
        heads = None if held is None else log.registry_heads(held).select("stream_id", "head_offset")
        numbered = log.dense_offsets(rows, "stream_id", order, F.lit(0), head=heads)
        return self.records.append(numbered, commit_id=commit_id).total_records

    def consume(self, stream_id: str, start: int = 0) -> log.Cursor:
        """A cursor over one stream."""
        held = self.log()
        if held is None:
            raise ValueError("nothing was produced yet")
        return log.Cursor(held, stream_id, start)

    def _note(self, ops: list[tuple]) -> None:
        self.journal.append(self.spark.createDataFrame(ops, _JOURNAL))

    def states(self, stream_id: str, group_id: str) -> DataFrame:
        """Every offset of a stream with the group's state of it."""
        own = self.log().where(F.col("stream_id") == stream_id).withColumn("group_id", F.lit(group_id))
        ops = self.journal.read() if self.journal.current() else self.spark.createDataFrame([], _JOURNAL)
        mine = ops.where((F.col("stream_id") == stream_id) & (F.col("group_id") == group_id))
        return overlay.state_of_log(own, overlay.fold_journal(mine, _KEY), _KEY)

    def _seq(self) -> int:
        head = self.journal.current()
        return head.total_records if head else 0

    def lease(self, stream_id: str, group_id: str, n: int, deadline_us: int) -> list[tuple[int, int]]:
        """(offset, token) of up to n READY offsets, leased until the deadline. Tokens are unique in a journal."""
        rows = overlay.lease_candidates(self.states(stream_id, group_id), stream_id, n).select("log_offset").collect()  # at most n
        seq = self._seq()
        ops = [(stream_id, group_id, r.log_offset, seq + i, "Acquire", seq + i + 1, deadline_us) for i, r in enumerate(rows)]
        if ops:
            self._note(ops)
        return [(o[2], o[5]) for o in ops]

    def ack(self, stream_id: str, group_id: str, leased: Sequence[tuple[int, int]]) -> None:
        """Acknowledge leased offsets; one whose token isn't the lease's any more changes nothing."""
        seq = self._seq()
        self._note([(stream_id, group_id, o, seq + i, "Ack", t, None) for i, (o, t) in enumerate(leased)])

    def nack(self, stream_id: str, group_id: str, offsets: Sequence[int]) -> None:
        """Return leased offsets, or give them up after their last attempt."""
        seq = self._seq()
        self._note([(stream_id, group_id, o, seq + i, "Nack", None, None) for i, o in enumerate(offsets)])
