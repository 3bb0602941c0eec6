"""Running aggregates along an order, in two levels, so that a key with a third of all rows is spread over as many tasks as it has blocks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, into: str, how: str = "max", block: Column | None = None, before: bool = False) -> DataFrame:
    """rows with the running maximum or sum of ``value`` per key, up to and with the row, or up to the one ``before`` it.

    Both are associative: inside a block rows are scanned in order, and what the blocks before it come to is scanned over one row per block. ``block`` must
    not decrease along the order (a slice of time, of sequence numbers); without one a key is one task's. Null values are passed over.
    """
    fold = {"max": F.max, "sum": F.sum}[how]
    frame = (Window.unboundedPreceding, -1 if before else Window.currentRow)
    if block is None:
        return rows.withColumn(into, fold(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(*frame)))
    cols = rows.columns
    r = rows.withColumn("block_", block).withColumn("value_", value)
    per = r.groupBy(*key, "block_").agg(fold("value_").alias("v_"))
    carry = fold("v_").over(Window.partitionBy(*key).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1))
    carried = per.select(*[F.col(k).alias(f"{k}_k_") for k in key], F.col("block_").alias("at_"), carry.alias("carry_"))
    inside = r.withColumn("in_", fold("value_").over(Window.partitionBy(*key, "block_").orderBy(*order).rowsBetween(*frame)))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_k_")) for k in key] + [F.col("block_").eqNullSafe(F.col("at_"))])
    both = F.greatest("in_", "carry_") if how == "max" else F.coalesce(F.col("in_") + F.col("carry_"), "in_", "carry_")
    return inside.join(carried, same).select(*cols, both.alias(into))
