"""Transactions over the log: what a reader that asks for committed records sees, and tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMIT, ABORT = "commit", "abort"


def transaction_states(markers: DataFrame, by: Sequence[str] = ("stream_id",)) -> DataFrame:
    """(by, txn_id, state, marker_offset) from markers (by, log_offset, txn_id, kind).

    A transaction has one marker; should there be more, the first by offset holds, and what comes after it is nothing.
    """
    first = markers.where("txn_id <> 0").groupBy(*by, "txn_id").agg(F.min(F.struct("log_offset", "kind")).alias("m"))
    return first.select(*by, "txn_id", F.when(F.col("m.kind") == COMMIT, "committed").otherwise("aborted").alias("state"), F.col("m.log_offset").alias("marker_offset"))


def read_log(records: DataFrame, markers: DataFrame, committed: bool = True, by: Sequence[str] = ("stream_id",)) -> DataFrame:
    """The data records (by, log_offset, txn_id, ...) a reader sees, with the state of their transaction.

    Records outside transactions (txn_id 0) are always seen. With ``committed`` those of a transaction are seen if its commit marker lies behind them: not
    while it is open, not if it is aborted, nor if they come after the marker. Without, all are. The join is on the transaction, and Spark splits a hot one.
    """
    states = transaction_states(markers, by)
    j = records.join(states, [*by, "txn_id"], "left")
    in_time = F.col("log_offset") < F.col("marker_offset")
    state = F.when(F.col("txn_id") == 0, "none").when(F.col("state").isNull() | ~in_time, "open").otherwise(F.col("state"))
    out = j.withColumn("txn_state", state).drop("state", "marker_offset")
    return out.where(F.col("txn_state").isin("none", "committed")) if committed else out


def last_stable(records: DataFrame, markers: DataFrame, by: Sequence[str] = ("stream_id",)) -> DataFrame:
    """(by, last_stable_offset): the first offset of a transaction still open, or the one after the head."""
    every = read_log(records, markers, False, by)
    return every.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("txn_state") == "open", F.col("log_offset"))), F.max("log_offset") + 1).alias("last_stable_offset"))


def latest_values(records: DataFrame, key: str, order: Sequence[str], tombstone: str) -> DataFrame:
    """The latest record of each key, without those that are tombstones: what compaction keeps. Partial maxima are taken map-side."""
    cols = [c for c in records.columns if c != key and c not in order]
    last = records.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("v"), F.max(F.struct(*order)).alias("o"))
    return last.select(key, *[F.col(f"o.{c}").alias(c) for c in order], *[F.col(f"v.{c}").alias(c) for c in cols]).where(~F.coalesce(F.col(tombstone), F.lit(False)))
