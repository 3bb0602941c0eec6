"""Regions: which replication batches a region applies, given its role and epoch when they came."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIMARY, REPLICA = "primary", "replica"


def roles_over_time(events: DataFrame) -> DataFrame:
    """(region, at, role, epoch) after each control event (region, at, kind, new_epoch).

    ``promote`` makes the region primary in the next epoch, ``demote`` a replica in the epoch the event names. Epochs between two demotions count on
    from the first, so they are sums over the stretch since the last one; there are as many rows as control events. Before any event a region is a replica in epoch 0.
    """
    own = Window.partitionBy("region").orderBy("at")
    stretch = events.withColumn("stretch", F.count_if(F.col("kind") == "demote").over(own))
    inside = Window.partitionBy("region", "stretch").orderBy("at")
    start = F.coalesce(F.first(F.when(F.col("kind") == "demote", F.col("new_epoch"))).over(inside), F.lit(0))
    epoch = (start + F.count_if(F.col("kind") == "promote").over(inside)).cast("bigint")
    return stretch.select("region", "at", F.when(F.col("kind") == "promote", PRIMARY).otherwise(REPLICA).alias("role"), epoch.alias("epoch"))


def apply_batches(batches: DataFrame, events: DataFrame, span: int) -> DataFrame:
    """Each batch (region, at, region_epoch, base_offset, n_records, ...) with outcome and last_offset.

    A primary rejects every batch that is sent to it, lest there be two of them; a replica rejects one of an epoch before its own and applies the
    others. The role is that of the last event at or before the batch, found by an as-of join in slices of ``span`` along ``at``.
    """
    from .lookup import asof_backward

    named = roles_over_time(events).withColumnsRenamed({"role": "role_", "epoch": "epoch_"})
    j = asof_backward(batches, named, "region", "at", ["role_", "epoch_"], span)
    outcome = F.when(F.coalesce("role_", F.lit(REPLICA)) == PRIMARY, "rejected:primary").when(F.col("region_epoch") < F.coalesce("epoch_", F.lit(0)), "rejected:stale_epoch").otherwise("applied")
    last = F.when(outcome == "applied", F.col("base_offset") + F.col("n_records") - 1)
    return j.select(*batches.columns, outcome.alias("outcome"), last.alias("last_offset"))


def replicated_offsets(applied: DataFrame, stream: str = "stream_id") -> DataFrame:
    """(region, stream, last_offset): the last offset of the latest batch each region applied."""
    done = applied.where("outcome = 'applied'")
    return done.groupBy("region", stream).agg(F.max_by("last_offset", "at").alias("last_offset"))
