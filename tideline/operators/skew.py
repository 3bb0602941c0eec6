"""A few keys holding most records: detect them by a sketch, give them a plan of their own, union the rest."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketches are merged in two levels, so that the last task gets at most this many.
FAN_IN = 64
#: A key is heavy from this share of all rows on, and, where work is split by it, from so many rows one task may get; but not below the share for which a
#: sketch still has at most a million entries.
SHARE, TASK_ROWS, LEAST_SHARE = 0.02, 50_000_000, 2e-5


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> list:
    """The keys with more than ``share`` of all rows, exactly, as a list of at most 1/share values.

    A mergeable frequent-items sketch (one bounded sketch per task, merged in two levels) proposes candidates: its error is
    below share/4 of the rows, so no heavy key is missed. One filtered count then keeps those really above the share.
    All rows count, also repeated ones and those with a null key; a null is no key.
    """
    # the error of a frequent-items sketch is at most 3.5 / items of the rows; its size must be a power of two here
    items = 2 ** max(6, math.ceil(math.log2(4 * 3.5 / share)))
    most = math.ceil(2 / share)
    part = F.pmod(F.spark_partition_id(), F.lit(FAN_IN))
    level = df.select(F.col(key).alias("k"), part.alias("p"))
    if level.isEmpty():  # sketches of nothing can't be combined
        return []
    counted = level.groupBy("p").agg(F.expr(f"approx_top_k_accumulate(k, {items})").alias("sketch"), F.count(F.lit(1)).alias("n"))
    top = counted.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {items}), {min(most, items)})").alias("top"), F.sum("n").alias("n")).first()
    floor = share * top.n
    candidates = [r["item"] for r in top.top or [] if r["item"] is not None and r["count"] > floor]
    if not candidates:
        return []
    few = df.sparkSession.createDataFrame([(c,) for c in candidates], df.select(F.col(key).alias("k")).schema)
    exact = df.select(F.col(key).alias("k")).join(F.broadcast(few), "k").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor)
    return [r.k for r in exact.collect()]


def split_share(df: DataFrame, share: float = SHARE, task_rows: int = TASK_ROWS) -> float:
    """The share from which a key must be split: ``share``, or what one task may get, whichever is less. The rows are counted, of files by their footers."""
    return max(LEAST_SHARE, min(share, task_rows / max(1, df.count())))


def _apart(df: DataFrame, key: str, heavy: list) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy keys, the others, null keys among them). Heavy keys, at most 1/LEAST_SHARE, are met by a broadcast once there are too many for an expression."""
    if len(heavy) <= 200:
        is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False)) if heavy else F.lit(False)
        return df.where(is_heavy), df.where(~is_heavy)
    few = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in heavy], df.select(key).schema))
    return df.join(few, key, "left_semi").select(*df.columns), df.join(few, key, "left_anti").select(*df.columns)


def skew_aggregate(df: DataFrame, key: str, aggs: Sequence[Column], merge: Sequence[Column], heavy: list | None = None, salts: int = 64, share: float = SHARE) -> DataFrame:
    """Per-key aggregates with the work spread evenly.

    Rows of heavy keys are salted, aggregated per (key, salt) and merged; the others take one ordinary shuffle; then union.
    ``aggs`` are named aggregates of the rows, ``merge`` the aggregates that merge those names into the same names. A null
    key is an ordinary key here, so its rows are grouped under null.
    """
    heavy = heavy_keys(df, key, split_share(df, share)) if heavy is None else heavy
    hot, rest = _apart(df, key, heavy)
    light = rest.groupBy(key).agg(*aggs)
    if not heavy:
        return light
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))  # the same again should a task be run again; equal rows fold map-side
    hot = hot.withColumn("salt_", salt).groupBy(key, "salt_").agg(*aggs).groupBy(key).agg(*merge)
    return light.unionByName(hot)


def skew_join(left: DataFrame, right: DataFrame, key: str, heavy: list | None = None, how: str = "left", share: float = SHARE) -> DataFrame:
    """left joined to right on ``key``, where a few keys hold most rows of left.

    The right rows of the heavy keys are broadcast, so that heavy rows stay where they are; all other keys are joined by an
    ordinary shuffle; then union. What is broadcast is bounded: ``right`` must have one row per key, checked for the heavy
    keys, of which there are at most 1/share. ``how`` is inner or left. Columns of the right that the left has, too, come
    with the suffix ``_right``. A null key meets nothing and stays where it is.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    heavy = heavy_keys(left, key, split_share(left, share)) if heavy is None else heavy
    right = right.select(*[F.col(c).alias(c if c == key or c not in left.columns else f"{c}_right") for c in right.columns])
    few, others = _apart(right.where(F.col(key).isNotNull()), key, heavy)
    if not few.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"the right side has several rows for one {key}")
    hot, rest = _apart(left, key, heavy)
    stays = rest.where(F.col(key).isNull())
    out = hot.join(F.broadcast(few), key, how).unionByName(rest.where(F.col(key).isNotNull()).join(others.hint("shuffle_merge"), key, how))
    # a null key meets nothing, so its rows needn't move
    return out.unionByName(stays.join(F.broadcast(few.limit(0)), key, how)) if how == "left" else out


def heavy_key_report(parts: Sequence[tuple[str, DataFrame, str]], share: float = SHARE) -> DataFrame:
    """(key_kind, key_value) of every heavy key of the given (kind, table, column)s; values as text."""
    spark = parts[0][1].sparkSession
    rows = [(kind, str(v)) for kind, df, key in parts for v in sorted(heavy_keys(df, key, share))]
    return spark.createDataFrame(rows, "key_kind string, key_value string")


def stream_totals(records: DataFrame, streams: DataFrame) -> DataFrame:
    """Per stream: count, bytes and highest offset of its records as stored, with its tenant and name from the registry.

    The aggregates of the heavy streams and of the others are made apart (skew_aggregate) and the registry joined the same
    way. Records with a null stream form one row with a null key; a stream the registry lacks has null attributes.
    """
    heavy = heavy_keys(records, "stream_id", split_share(records))
    aggs = [F.count(F.lit(1)).alias("n_records"), F.sum(F.coalesce("payload_len", F.lit(0)).cast("bigint")).alias("n_bytes"), F.max("logical_offset").alias("max_offset")]
    merge = [F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.max("max_offset").alias("max_offset")]
    rows = records.select("stream_id", "payload_len", "logical_offset")
    totals = skew_aggregate(rows, "stream_id", aggs, merge, heavy)
    named = streams.where("stream_id IS NOT NULL").groupBy("stream_id").agg(F.min("tenant_id").alias("tenant_id"), F.min("stream_name").alias("stream_name"))
    return skew_join(totals, named, "stream_id", heavy)


def tenant_ops(deltas: DataFrame) -> DataFrame:
    """Per tenant: number of journal rows as stored by op, with the work of the heavy tenants salted. Other ops count as other."""
    known = ("Acquire", "Ack", "Nack", "EvictDlq")
    op = F.col("op")
    aggs = [F.count_if(op == o).alias(f"n_{o.lower()}") for o in known] + [F.count_if(~F.coalesce(op.isin(*known), F.lit(False))).alias("n_other")]
    merge = [F.sum(f"n_{o}").alias(f"n_{o}") for o in [*map(str.lower, known), "other"]]
    return skew_aggregate(deltas.select("tenant_id", "op"), "tenant_id", aggs, merge)


def tagged_records(records: DataFrame, streams: DataFrame) -> DataFrame:
    """Every record with its stream's tenant: the join in which a hot stream would otherwise fill one task."""
    named = streams.where("stream_id IS NOT NULL").groupBy("stream_id").agg(F.min("tenant_id").alias("tenant_id"))
    return skew_join(records.select("record_id", "stream_id", "payload_len"), named, "stream_id")
