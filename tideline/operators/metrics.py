"""Telemetry: counters, index percentiles, freshness, file hygiene, renderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .running import running

#: The number, name and subsystem of each diagnostic code. What to do about them is said in own words.
DIAGNOSTICS = [
    (1, "InvalidBatchHeader", "check how segments are aligned, and the disk"),
    (2, "CrcMismatch", "recover the segment, or replace the device"),
    (3, "StaleLeaseToken", "acquire the message again and use the new token"),
    (4, "MaxRetriesExceeded", "look at the message in the dead-letter view"),
    (5, "QuotaExceeded", "raise the tenant's quota or send less"),
    (6, "StorageCorruption", "take the node out and rebuild it from its peers"),
    (7, "WatermarkRegression", "stop and check how coordinators are fenced"),
    (8, "SchemaIncompatible", "the payload went to the overflow; register a compatible version"),
    (9, "IoFailure", "look at the kernel's log and the mount"),
    (10, "BackpressureEngaged", "look at compaction and the upload backlog"),
    (11, "RaftQuorumLost", "bring peers back or heal the network"),
    (12, "EpochFenced", "refresh the shard's routing"),
    (13, "RaftLeaderTransferTimeout", "let the follower catch up first"),
    (14, "Tier1UploadFailed", "check credentials, limits and the network"),
    (15, "StateReconciliationMismatch", "load the state's snapshot anew"),
    (16, "NodeDrainTimeout", "evict the shards that didn't drain"),
]


def diagnostics(spark: SparkSession, prefix: str = "ERR") -> DataFrame:
    """(code, name, remediation) of the 16 codes; the prefix is the deployment's."""
    return spark.createDataFrame([(f"{prefix}-{n:03d}", name, text) for n, name, text in DIAGNOSTICS], "code string, name string, remediation string")


def readiness(probes: DataFrame) -> DataFrame:
    """probes (draining, storage, state_plane, memory) with status and detail: draining first, then what is broken, then what is short."""
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(ok("draining"), "Degraded").when(~ok("storage") | ~ok("state_plane"), "Unhealthy").when(~ok("memory"), "Degraded").otherwise("Healthy")
    detail = F.when(ok("draining"), "draining").when(~ok("storage"), "storage isn't writable").when(~ok("state_plane"), "state plane is broken").when(~ok("memory"), "memory is short").otherwise("ready")
    return probes.withColumn("status", status).withColumn("detail", detail)


#: The phases of a migration, in their usual order; any may follow any.
PHASES = ("BridgeReplicating", "DualWriteValidation", "ConsumerCutover", "Decommissioned", "Rollback")


def current_phase(transitions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, phase) after transitions (by, at, phase): the latest one, whatever came before."""
    return transitions.groupBy(*by).agg(F.max_by("phase", "at").alias("phase"))


def migration_status(mappings: DataFrame, writes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per stream: the source's high-water mark, the own head, how far the own is ahead (0 where it is behind or nothing is mapped), and how many writes went to both."""
    last = mappings.groupBy(*by).agg(F.max_by(F.struct("source_high", "own_head"), "at").alias("m"))
    both = writes.groupBy(*by).agg(F.count(F.lit(1)).alias("dual_writes"))
    j = last.join(both, list(by), "full_outer")
    high, head = F.coalesce("m.source_high", F.lit(-1)), F.coalesce("m.own_head", F.lit(0))
    return j.select(*by, high.alias("source_high"), head.alias("own_head"), F.when((high >= 0) & (head >= high), head - high).otherwise(0).alias("offset_lag"), F.coalesce("dual_writes", F.lit(0)).alias("dual_writes"))


def rollup(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, sum, greatest and the floored integer mean (0 for nothing) of a counter."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"), F.coalesce(F.floor(F.sum(value) / F.count(value)), F.lit(0)).cast("bigint").alias("mean_floor"))


def index_percentiles(df: DataFrame, by: str, value: str, shares: Sequence[float], tie: str, span: float = 1.0) -> DataFrame:
    """Per key the element at index floor(n * p) of the sorted values, 0 where the index is out of range.

    Two passes, so that no task sorts a whole key: counts per bucket of the value tell which bucket holds an index, and only that
    bucket's values are ranked. ``span`` is the bucket width.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, value, tie, F.floor(F.col(value) / span).alias("b"))
    counts = rows.groupBy(by, "b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    cum = counts.withColumn("before", F.sum("c").over(w.orderBy("b")) - F.col("c")).withColumn("n", F.sum("c").over(w))
    wanted = cum.withColumn("p", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("i", F.floor(F.col("n") * F.col("p")))
    inside = wanted.where((F.col("i") >= F.col("before")) & (F.col("i") < F.col("before") + F.col("c"))).select(by, "b", "p", (F.col("i") - F.col("before")).alias("k"))
    ranked = rows.join(inside.select(by, "b").distinct(), [by, "b"], "left_semi").withColumn("k", (F.row_number().over(Window.partitionBy(by, "b").orderBy(value, tie)) - 1).cast("bigint"))
    hit = ranked.join(inside, [by, "b", "k"]).groupBy(by).pivot("p", [float(s) for s in shares]).agg(F.first(value))
    names = [c for c in hit.columns if c != by]
    return hit.select(by, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"p{round(float(n) * 1000)}") for n in names])


def rate(n: Column, seconds: Column) -> Column:
    """n per second, 0 where no time has passed."""
    return F.coalesce(n / F.nullif(seconds, F.lit(0.0)), F.lit(0.0))


def hygiene(files: DataFrame, small: int, by: Sequence[str] = ()) -> DataFrame:
    """Files, bytes, mean size and the share of small files."""
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("file_size_bytes").alias("n_bytes"), F.round(F.avg("file_size_bytes"), 3).alias("mean_bytes"), F.round(F.avg((F.col("file_size_bytes") < small).cast("double")), 6).alias("small_share"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """(line): name{labels} value, from (name, label, value)."""
    return metrics.select(F.format_string('%s{group="%s"} %d', F.col("name"), F.col("label"), F.col("value").cast("bigint")).alias("line"))


def backpressure(backlog: DataFrame, order: str, delta: str, threshold: int, by: Sequence[str], block: Column | None = None) -> DataFrame:
    """The running backlog per group, and whether backpressure is on (at or above the threshold). With a ``block`` (see running) a hot group is many tasks'."""
    return running(backlog, by, [order], F.col(delta), "backlog", "sum", block).withColumn("backpressure", F.col("backlog") >= threshold)


def inspection(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """(stream_id, doc): what there is of each stream, as the JSON an administrator sees."""
    per = chunks.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.min("start_offset").alias("first_offset"))
    j = heads.select("stream_id", "head_offset").join(per, "stream_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("stream_id", F.to_json(F.struct("stream_id", zero("head_offset"), zero("first_offset"), zero("n_chunks"), zero("n_records"), zero("n_bytes"))).alias("doc"))


def age_histogram(rows: DataFrame, age: Column, width: int, by: Sequence[str]) -> DataFrame:
    """(by, bucket, n): how many rows are from bucket * width old on; a negative age counts as 0."""
    return rows.groupBy(*by, F.floor(F.greatest(age, F.lit(0)) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
