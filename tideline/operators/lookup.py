"""Lookups that are joins here: floor, covering range, ring successor, translation, first at or after a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, value: Sequence[str], span: int) -> DataFrame:
    """Each left row with the last right row of its ``by`` at or before its ``at``.

    Rows of both sides meet in slices of ``span`` along ``at``; a slice that opens without a right row takes the last of the slices before, found
    among one row per slice. No task sees a whole key, and no pairs are made. Of equal positions the greatest value counts.
    """
    slice_ = lambda c: F.floor(F.col(c) / span)
    kept = F.struct(*[F.col(v).alias(v) for v in value])
    marks = right.where(F.col(at).isNotNull()).select(F.col(by), F.col(at), F.struct(F.col(at).alias("at_"), kept.alias("v_")).alias("mark_"))
    marks = marks.groupBy(by, at).agg(F.max("mark_").alias("mark_"))
    rows = left.withColumn("mark_", F.lit(None).cast(marks.schema["mark_"].dataType)).withColumn("left_", F.lit(True))
    both = rows.unionByName(marks.withColumn("left_", F.lit(False)), allowMissingColumns=True).withColumn("slice_", slice_(at))
    near = F.last("mark_", ignorenulls=True).over(Window.partitionBy(by, "slice_").orderBy(F.col(at), F.col("left_")).rowsBetween(Window.unboundedPreceding, 0))
    tops = marks.groupBy(by, slice_(at).alias("slice_")).agg(F.max("mark_").alias("top_"))
    wanted = both.select(by, "slice_").distinct().join(tops, [by, "slice_"], "left")
    far = wanted.withColumn("far_", F.last("top_", ignorenulls=True).over(Window.partitionBy(by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1))).select(by, "slice_", "far_")
    out = both.withColumn("near_", near).where("left_").join(far, [by, "slice_"], "left")
    got = F.coalesce("near_", "far_")
    return out.select(*left.columns, *[got["v_"][v].alias(v) for v in value])


def covering(points: DataFrame, chunks: DataFrame, by: str, at: str, width: int, value: Sequence[str]) -> DataFrame:
    """Each point with the range [start_offset, end_offset] of its ``by`` that covers it; the first by start if several do.

    A range is entered under every slice of ``width`` it touches, so the join is an equality on (by, slice) with a residual filter.
    """
    spread = chunks.withColumn("slice_", F.explode(F.sequence(F.floor(F.col("start_offset") / width), F.floor(F.col("end_offset") / width))))
    spread = spread.select(F.col(by), "slice_", "start_offset", "end_offset", *[v for v in value if v not in ("start_offset", "end_offset")])
    hit = points.withColumn("slice_", F.floor(F.col(at) / width)).join(spread, [by, "slice_"], "left")
    inside = (F.col(at) >= F.col("start_offset")) & (F.col(at) <= F.col("end_offset"))
    first = F.min(F.when(inside, F.struct("start_offset", *[v for v in value if v != "start_offset"])))
    return hit.groupBy(*points.columns).agg(first.alias("c_")).select(*points.columns, *[F.col("c_")[v].alias(v) for v in value])


def ring_successor(keys: DataFrame, nodes: DataFrame, key: str, node: str, vnodes: int = 16) -> DataFrame:
    """Each key's node on a consistent-hash ring: the first virtual node at or after its hash, wrapping around.

    An as-of lookup along the ring run backwards, in 4,096 slices of the 32-bit hash, so a ring of any size is exact and no task has all of it.
    Of points with one hash the lowest node counts; a key past the last point takes the first one.
    """
    place = lambda c: (-F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")).alias("at_")
    name = F.col(node).cast("string")
    points = nodes.select(name.alias("n_"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v_")).select(place(F.concat_ws("#", "n_", F.col("v_").cast("string"))), "n_")
    points = points.groupBy("at_").agg(F.min("n_").alias("ring_node")).withColumn("ring_", F.lit(0))
    first = points.agg(F.max_by("ring_node", "at_").alias("first_"))
    found = asof_backward(keys.select("*", place(F.col(key).cast("string")), F.lit(0).alias("ring_")), points, "ring_", "at_", ["ring_node"], 1 << 20)
    return found.select(*keys.columns, F.coalesce("ring_node", first.scalar()).alias("ring_node"))


def committed(commits: DataFrame, by: Sequence[str], offset: str, order: Sequence[str]) -> DataFrame:
    """Stream mode: the offset each group committed last, which may be lower than one before. Independent of what is leased or acknowledged."""
    return commits.groupBy(*by).agg(F.max_by(offset, F.struct(*order, offset)).alias("committed_offset"))


def translate(committed: DataFrame, bridges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Committed source offsets in the target's numbering: own_base + (offset - source_base) inside a bridged range; the outcome tells
    ``translated``, ``above_high_water`` or ``unmapped``."""
    j = committed.join(bridges, list(by), "left")
    moved = F.col("own_base") + (F.col("committed_offset") - F.col("source_base"))
    outcome = F.when(F.col("own_base").isNull(), "unmapped").when(F.col("committed_offset") > F.col("high_water"), "above_high_water").otherwise("translated")
    return j.select(*committed.columns, F.when(outcome == "translated", moved).alias("own_offset"), outcome.alias("outcome"))


def offset_for_time(log: DataFrame, ts: str, when: Column) -> DataFrame:
    """Per stream the first offset at or after a time, with the earliest and the next free one."""
    return log.groupBy("stream_id").agg(F.min("log_offset").alias("earliest"), F.min(F.when(F.col(ts) >= when, F.col("log_offset"))).alias("at_or_after"), (F.max("log_offset") + 1).alias("latest"))
