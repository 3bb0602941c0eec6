"""The immutable log as DataFrames: offsets on append, ordered replay, bounded reads, chunk manifests, pushdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_offsets(df: DataFrame, key: str, order: Sequence[str], block: Column, into: str = "log_offset", head: DataFrame | None = None) -> DataFrame:
    """Append with offset assignment: 0, 1, 2, ... per key in the given order.

    Ranks are made in two levels, inside blocks and over the blocks' counts, so that a key holding most of the log is numbered by
    as many tasks as it has blocks. ``block`` must not decrease along the order (a time slice, a batch number). ``head`` has
    (key, head_offset): the first free offset of streams that hold records already.
    """
    rows = df.withColumn("block_", block)
    counts = rows.groupBy(key, "block_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.select(F.col(key).alias("key_"), F.col("block_").alias("at_"), (F.sum("n_").over(Window.partitionBy(key).orderBy("block_")) - F.col("n_")).alias("before_"))
    rank = F.row_number().over(Window.partitionBy(key, "block_").orderBy(*order)) - 1
    out = rows.withColumn("rank_", rank).join(before, F.col(key).eqNullSafe(F.col("key_")) & F.col("block_").eqNullSafe(F.col("at_")))
    offset = F.col("rank_") + F.col("before_")
    if head is not None:
        out = out.join(head.select(F.col(key).alias("head_key_"), F.col("head_offset").alias("head_")), F.col(key) == F.col("head_key_"), "left")
        offset = offset + F.coalesce("head_", F.lit(0))
    return out.withColumn(into, offset.cast("bigint")).drop("block_", "key_", "at_", "before_", "rank_", "n_", "head_key_", "head_")


def registry_heads(log: DataFrame) -> DataFrame:
    """Stream registry: the next free offset and the number of records per stream."""
    return log.groupBy("stream_id").agg((F.max("log_offset") + 1).alias("head_offset"), F.count(F.lit(1)).alias("n_records"))


def fetch(log: DataFrame, stream_id: str, start: int, max_records: int, end: int | None = None, max_bytes: int | None = None, size: Column | None = None) -> DataFrame:
    """Bounded read of one stream: records from ``start`` (to ``end`` inclusive) in order, at most ``max_records``, and, with ``max_bytes``, no more than fill it by
    ``size``, but always one. For committed records only, read what transactions.read_log gives.

    Offsets are dense, so the bound is a range predicate the scan can skip row groups by; ``has_more`` tells if the stream goes on.
    """
    last = start + max_records - 1 if end is None else min(end, start + max_records - 1)
    own = log.where((F.col("stream_id") == stream_id) & (F.col("log_offset") >= start) & (F.col("log_offset") <= last + 1))
    top = own.agg(F.max("log_offset")).scalar()
    page = own.where(F.col("log_offset") <= last)
    if max_bytes is None:
        return page.withColumn("has_more", (top > last) & F.lit(end is None or end > last))
    # at most max_records rows are summed
    sums = page.withColumn("bytes_", F.sum(size).over(Window.partitionBy("stream_id").orderBy("log_offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = sums.where((F.col("bytes_") <= max_bytes) | (F.col("log_offset") == own.agg(F.min("log_offset")).scalar()))
    taken = kept.agg(F.max("log_offset")).scalar()
    bound = top if end is None else F.least(top, F.lit(end))
    return kept.withColumn("has_more", bound > taken).drop("bytes_")


class Cursor:
    """A reader's place in one stream."""

    def __init__(self, log: DataFrame, stream_id: str, start: int = 0) -> None:
        self.log, self.stream_id, self._at = log, stream_id, start

    def position(self) -> int:
        return self._at

    def seek(self, offset: int) -> None:
        self._at = offset

    def poll(self, max_records: int = 500) -> list:
        """The next records, at most ``max_records``; the position moves behind the last of them."""
        rows = fetch(self.log, self.stream_id, self._at, max_records).orderBy("log_offset").limit(max_records).collect()
        if rows:
            self._at = rows[-1]["log_offset"] + 1
        return rows


def replay(log: DataFrame, segment: str, order: Sequence[str], into: str = "replay_no") -> DataFrame:
    """Recovery: every record with its place in the replay, segments by name and records by ``order`` inside. Numbered in two levels, so no task orders the whole log."""
    return dense_offsets(log.withColumn("all_", F.lit(0)), "all_", [segment, *order], F.col(segment), into).drop("all_")


def read_segments(spark, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The segment files under a directory, at any depth, with the file each record is from; ``replay`` orders them."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(path).withColumn("segment", F.element_at(F.split(F.input_file_name(), "/"), -1))


def seal(chunks: DataFrame, log: DataFrame, records_per_chunk: int, payload: str) -> DataFrame:
    """A manifest's chunks with ``crc32``, by which a sealed chunk is checked when it is read: the sum of the CRC-32 of offset and payload of its records, modulo 2^32.

    A sum can be made map-side and in any order, so no chunk is gathered.
    """
    own = F.crc32(F.concat(F.col("log_offset").cast("string").cast("binary"), F.coalesce(F.col(payload), F.lit("")).cast("binary")))
    sums = log.groupBy("stream_id", F.floor(F.col("log_offset") / records_per_chunk).alias("chunk_no")).agg(F.pmod(F.sum(own), F.lit(1 << 32)).alias("crc32"))
    return chunks.withColumn("chunk_no", F.floor(F.col("start_offset") / records_per_chunk)).join(sums, ["stream_id", "chunk_no"], "left").drop("chunk_no")


def flight_projection(log: DataFrame, payload: str, timestamp_ns: int) -> DataFrame:
    """(_offset, _timestamp_ns, payload): what an Arrow reader gets; bytes that aren't UTF-8 become U+FFFD."""
    return log.select(F.col("log_offset").alias("_offset"), F.lit(timestamp_ns).cast("bigint").alias("_timestamp_ns"), F.make_valid_utf8(F.col(payload).cast("string")).alias("payload"))


def replay_report(log: DataFrame, segment: str, batch: Sequence[str]) -> DataFrame:
    """Recovery report: segments, batches, records and the last offset seen."""
    return log.agg(F.count_distinct(segment).alias("n_segments"), F.count_distinct(F.struct(*batch)).alias("n_batches"), F.count(F.lit(1)).alias("n_records"), F.max("log_offset").alias("last_offset"))


def chunk_manifest(log: DataFrame, records_per_chunk: int, size: Column) -> DataFrame:
    """Sealed chunks: [start, end] inclusive, records and bytes, in order of start per stream."""
    no = F.floor(F.col("log_offset") / records_per_chunk)
    per = log.groupBy("stream_id", no.alias("chunk_no")).agg(F.min("log_offset").alias("start_offset"), F.max("log_offset").alias("end_offset"), F.count(F.lit(1)).alias("n_records"), F.sum(size).cast("bigint").alias("n_bytes"))
    return per.withColumn("uri", F.format_string("%s/%016x.parquet", F.col("stream_id"), F.col("start_offset"))).drop("chunk_no")


def write_layout(log: DataFrame, path: str, time: str = "ingest_ts", buckets: int = 128, codec: str = "snappy", mode: str = "append") -> None:
    """The lakehouse layout: partitioned by day and stream bucket, files sorted by (stream, offset), at most 5 million records a file.

    A day and bucket is written by as many tasks as it has blocks of 5 million offsets a stream, so that a hot stream's day isn't one task's.
    """
    laid = log.withColumn("event_date", F.to_date(time)).withColumn("stream_bucket", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).cast("int"))
    spread = laid.repartition("event_date", "stream_bucket", F.floor(F.col("log_offset") / 5_000_000)).sortWithinPartitions("event_date", "stream_bucket", "stream_id", "log_offset")
    spread.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", 5_000_000).partitionBy("event_date", "stream_bucket").parquet(path)


def read_layout(spark, path: str, schema=None) -> DataFrame:
    """Replay of a written log; evolved files are merged, missing columns are null. With a schema no footer is opened for it."""
    return spark.read.option("mergeSchema", "true").parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def pushdown(table: DataFrame, predicate: str, columns: Sequence[str], max_records: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Range and predicate projection; Catalyst takes predicate and columns into the scan."""
    out = table.where(predicate)
    if max_records is not None:
        out = out.orderBy(*order).limit(max_records)
    return out.select(*columns)


def pushdown_report(table: DataFrame, predicate: str) -> DataFrame:
    """(scanned, matched): the rows a predicate is put to, and those that meet it."""
    return table.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.expr(predicate)).alias("matched"))


def pushdown_query(table: DataFrame, within: str, predicate: str, columns: Sequence[str], max_records: int, order: Sequence[str]) -> DataFrame:
    """A bounded range with a predicate: at most ``max_records`` rows in order, each with how many the range has (scanned) and how many meet the predicate (matched)."""
    ranged = table.where(within)
    counts = pushdown_report(ranged, predicate)
    page = ranged.where(predicate).orderBy(*order).limit(max_records).select(*columns)
    return page.withColumn("scanned", counts.select("scanned").scalar()).withColumn("matched", counts.select("matched").scalar())
