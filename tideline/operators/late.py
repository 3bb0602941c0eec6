"""Late and out-of-order events: per-period counters that converge whatever the order and number of deliveries.

The counters are conflict-free. The smallest has the key (period, source, version): a source is a batch, its versions are the records in it, each at most
once; a delivery that is retried or comes out of order finds its cell there already. A source's counter in a period sums its cells, with the number of them
as version; as a source only ever adds, the greatest version is the right one, and merging two states takes the maximum per source. The sum over the sources is the
period's value. Whether a source's counter is part of what was first reported, late or too late follows from its arrival and the period's end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, settle

HOUR_US = 3_600_000_000


def merge_registers(df: DataFrame, source: Sequence[str], version: Column, state: Sequence[str]) -> DataFrame:
    """One register per source: the state at its greatest version.

    This is the merge of a conflict-free counter: taking a maximum is idempotent, commutative and associative, so a delivery
    that is retried, repeated or out of order changes nothing. Partial maxima are taken map-side.
    Equal versions are settled by the greater state, so the result is the same in any order. A null version loses.
    """
    cols = [F.col(c) for c in state]
    best = df.groupBy(*source).agg(F.max(F.struct(version.alias("version"), *cols)).alias("register"))
    return best.select(*source, *[F.col("register")[c].alias(c) for c in state])


def arrivals(
    records: DataFrame, batches: DataFrame, columns: Sequence[str] = (), lateness_us: int = 2 * HOUR_US, period_us: int = HOUR_US
) -> DataFrame:
    """Each record once, with its event time, period and verdict.

    A record happens at its batch's ``timestamp_us`` plus its own ``timestamp_delta_ms`` and arrives at the batch's
    ``physical_ms``. With E the end of its period (the start of the next one), the verdict is ``on_time`` for arrival before
    E, ``late`` from E to before E + lateness, ``too_late`` from there on, and null where a time is missing.

    These are the cells of the counters: ``source`` is the batch, the record its version. A record sent again in another batch is counted once, in the
    batch of the greatest arrival (physical_ms, hlc_logical, hlc_node_id). ``columns`` names the record columns to keep.

    Repeated headers fold first, by the greatest arrival; a header without a batch id or a record without a record id is
    dropped, as it can't be named; a record whose batch has no header gets a null verdict. Both sides may be skewed: the
    join has one row per batch on the right, so adaptive execution splits a hot batch on the left.
    """
    heads = (
        batches.where("batch_id IS NOT NULL")
        .groupBy("batch_id")
        .agg(F.max(F.struct(*[F.col(c) for c in ("physical_ms", "hlc_logical", "hlc_node_id", "timestamp_us")])).alias("arrival"))
    )
    rows = records.where("record_id IS NOT NULL").select("record_id", "batch_id", "timestamp_delta_ms", *[F.col(c).alias(f"keep_{c}") for c in columns])
    event = F.col("arrival.timestamp_us") + F.col("timestamp_delta_ms") * 1000
    end = F.col("event_us") - F.pmod("event_us", F.lit(period_us)) + period_us
    came = F.col("arrival.physical_ms") * 1000
    verdict = F.when(came < F.col("period_end_us"), "on_time").when(came < F.col("period_end_us") + lateness_us, "late").when(came.isNotNull() & F.col("period_end_us").isNotNull(), "too_late")
    timed = rows.join(heads, "batch_id", "left").withColumn("event_us", event).withColumn("period_end_us", end).withColumn("verdict", verdict)
    version = F.struct("arrival.physical_ms", "arrival.hlc_logical", "arrival.hlc_node_id")
    kept = [f"keep_{c}" for c in columns]
    merged = merge_registers(timed.withColumn("source", F.col("batch_id")), ["record_id"], version, ["period_end_us", "verdict", "source", *kept])
    return merged.select("record_id", "source", "period_end_us", "verdict", *[F.col(f"keep_{c}").alias(c) for c in columns])


def late_records(records: DataFrame, batches: DataFrame, **how) -> DataFrame:
    """(record_id, verdict) of the records that came after their period had ended."""
    return arrivals(records, batches, **how).where("verdict IN ('late', 'too_late')").select("record_id", "verdict")


#: What a source's counter is keyed by and holds.
CELL_KEY = ("period_end_us", "source", "verdict")


def source_counters(cells: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, period_end_us, source, verdict, version, n, total): each source's counter in a period. Cells are combined map-side.

    ``version`` is the number of the source's records that are in: it only grows, so of two states of a source the greater version holds the other.
    Cells without a time are in no period. A null key is a group of its own; a null weight adds nothing.
    """
    counted = cells.where("verdict IS NOT NULL").groupBy(key, *CELL_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(weight), F.lit(0)).cast("bigint")).alias("total"))
    return counted.select(key, *CELL_KEY, F.col("n").alias("version"), "n", "total")


def merge_counters(states: DataFrame, key: str) -> DataFrame:
    """One state from several: the greatest version per source. Idempotent, commutative and associative."""
    best = states.groupBy(key, *CELL_KEY).agg(F.max("version").alias("version"), F.max_by("n", "version").alias("n"), F.max_by("total", "version").alias("total"))
    return best.select(key, *CELL_KEY, "version", "n", "total")


def sum_sources(state: DataFrame, key: str, period_us: int = HOUR_US) -> DataFrame:
    """Count and total per key and period over the sources of a merged state, as first reported and as corrected; see period_counters."""
    on, late = F.col("verdict") == "on_time", F.col("verdict") == "late"
    some = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    return state.groupBy(key, F.timestamp_micros(F.col("period_end_us") - period_us).cast("timestamp_ntz").alias("period_start")).agg(
        some("n", on).alias("first_count"),
        some("total", on).alias("first_bytes"),
        some("n", on | late).alias("corrected_count"),
        some("total", on | late).alias("corrected_bytes"),
        some("n", F.col("verdict") == "too_late").alias("dropped_count"),
    )


def period_counters(
    records: DataFrame, batches: DataFrame, key: str = "stream_id", weight: str = "payload_len", period_us: int = HOUR_US, **how
) -> DataFrame:
    """Count and bytes per key and event period, as first reported and as corrected by late records.

    The sources' counters summed: ``first_*`` holds what had arrived by the end of the period, ``corrected_*`` adds
    the late, ``dropped_count`` tells how many came beyond the cut-off and are in neither. Records without an event time are
    in no period. A null key is a group of its own; a null weight adds nothing. A hot key or period folds map-side.
    """
    cells = arrivals(records, batches, columns=[key, weight], period_us=period_us, **how)
    return sum_sources(source_counters(cells, key, weight), key, period_us)


class CounterState:
    """Counters kept between deliveries, in a folder of the shared storage.

    Every delivery is applied under a number (a stream's batch id). It adds its new cells and the new versions of the counters it touches, never changes a
    file, and is a no-op once complete; one that broke off is written anew. ``totals`` merges the versions and sums the sources. A delivery may hold any part of
    any batch, repeat records of earlier deliveries, or come before its batch's header, for which its records wait. A record belongs to one batch.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "stream_id", weight: str = "payload_len", lateness_us: int = 2 * HOUR_US, period_us: int = HOUR_US) -> None:
        self.spark, self.path, self.key, self.weight, self.how = spark, path.rstrip("/"), key, weight, {"lateness_us": lateness_us, "period_us": period_us}

    def _complete(self, kind: str, what: str) -> list[int]:
        """The numbers of the complete folders ``what=N`` of a kind."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(root.suffix(f"/{what}=*/_SUCCESS")) if fs.exists(root) else []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _read(self, kind: str, below: int | None = None, like: DataFrame | None = None) -> DataFrame | None:
        """A kind's rows of all deliveries below one: the last compaction and what came after it."""
        base = max(self._complete(kind, "upto"), default=-1)
        at = [f"{self.path}/{kind}/upto={base}"] * (base >= 0) + [f"{self.path}/{kind}/epoch={e}" for e in self._complete(kind, "epoch") if e > base and (below is None or e < below)]
        if not at:
            return None
        return self.spark.read.parquet(*at) if like is None else self.spark.read.schema(like.schema).parquet(*at)

    def applied(self, epoch: int) -> bool:
        return epoch <= max(self._complete("counters", "upto"), default=-1) or epoch in self._complete("counters", "epoch")

    def apply(self, records: DataFrame, batches: DataFrame, epoch: int) -> None:
        """Add a delivery of records. ``batches`` has the headers known by now."""
        if self.applied(epoch):
            return
        own = records.select("record_id", "batch_id", "timestamp_delta_ms", self.key, self.weight)
        before = [e for e in self._complete("waiting", "epoch") if e < epoch]
        rows = own.unionByName(self.spark.read.schema(own.schema).parquet(f"{self.path}/waiting/epoch={before[-1]}")) if before else own
        known = batches.where("batch_id IS NOT NULL").select("batch_id").distinct()
        rows.join(known, "batch_id", "left_anti").where("record_id IS NOT NULL AND batch_id IS NOT NULL").write.mode("overwrite").parquet(f"{self.path}/waiting/epoch={epoch}")
        cells = arrivals(rows, batches, columns=[self.key, self.weight], **self.how).where("verdict IS NOT NULL")
        old = self._read("cells", epoch, cells)
        if old is not None:
            # only the periods the delivery touches can hold its records already
            came, _ = settle(cells, "cells")
            low, high = came.agg(F.min("period_end_us"), F.max("period_end_us")).first()
            seen = old.where(F.col("period_end_us").between(low, high)) if low is not None else old.limit(0)
            cells = came.join(seen.select("record_id", "source"), ["record_id", "source"], "left_anti").select(*cells.columns)
        cells.write.mode("overwrite").parquet(f"{self.path}/cells/epoch={epoch}")
        new = source_counters(self.spark.read.schema(cells.schema).parquet(f"{self.path}/cells/epoch={epoch}"), self.key, self.weight)
        held = self._read("counters", epoch, new)
        if held is not None:
            # a touched source's new version holds its old one
            same = [F.col(f"new.{c}").eqNullSafe(F.col(f"held.{c}")) for c in (self.key, *CELL_KEY)]
            merged = merge_counters(held, self.key).alias("held")
            add = lambda c: (F.col(f"new.{c}") + F.coalesce(F.col(f"held.{c}"), F.lit(0))).alias(c)
            new = new.alias("new").join(merged, reduce(and_, same), "left").select(*[F.col(f"new.{c}").alias(c) for c in (self.key, *CELL_KEY)], add("version"), add("n"), add("total"))
        new.write.mode("overwrite").parquet(f"{self.path}/counters/epoch={epoch}")

    def compact(self, closed_before_us: int | None = None) -> None:
        """Merge all deliveries so far into one table of each kind; between two deliveries only.

        With ``closed_before_us`` the cells of periods that ended before are dropped: a record of them that is delivered once more would count anew, so the time
        must be one from which no delivery is repeated. Counters stay.
        """
        done = self._complete("counters", "epoch")
        if not done:
            return
        cells = self._read("cells")
        kept = cells if closed_before_us is None else cells.where(F.col("period_end_us") >= closed_before_us)
        kept.write.mode("overwrite").parquet(f"{self.path}/cells/upto={done[-1]}")
        merge_counters(self._read("counters"), self.key).write.mode("overwrite").parquet(f"{self.path}/counters/upto={done[-1]}")
        for kind in ("cells", "counters"):
            for e in [x for x in self._complete(kind, "epoch") if x <= done[-1]]:
                drop_path(self.spark, f"{self.path}/{kind}/epoch={e}")
            for u in self._complete(kind, "upto")[:-1]:
                drop_path(self.spark, f"{self.path}/{kind}/upto={u}")

    def state(self) -> DataFrame | None:
        """The merged counters, or None before the first delivery."""
        held = self._read("counters")
        return None if held is None else merge_counters(held, self.key)

    def totals(self) -> DataFrame | None:
        """Count and total per key and period as of all deliveries; see period_counters."""
        state = self.state()
        return None if state is None else sum_sources(state, self.key, self.how["period_us"])
