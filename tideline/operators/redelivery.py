"""Messages delivered more than once: keep exactly one row of each."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import folded, key128
from ..session import settle
from .components import star_components

#: An order between -OUTER and OUTER and any row id of 64 bits fit into one decimal.
OUTER = 1 << 62
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _rank(messages: DataFrame, row_id: str, order: Sequence[str]) -> Column:
    """The place of a row: by order, nulls last, then by row id, as one value.

    One integer order and an integer id are packed into a decimal, a fixed-width buffer that hash aggregates keep in place. Other orders, and
    integers beyond OUTER (looked for first; the scan skips all row groups whose statistics rule them out), make a struct, which aggregates by sorting.
    """
    types = dict(messages.dtypes)
    if len(order) == 1 and types[order[0]] in _INTEGERS and types[row_id] in _INTEGERS and messages.where((F.col(order[0]) > OUTER) | (F.col(order[0]) < -OUTER)).isEmpty():
        place = F.coalesce(F.col(order[0]).cast("decimal(20,0)"), F.lit(Decimal(OUTER + 1)).cast("decimal(20,0)"))
        return (place * F.lit(Decimal(1 << 64))).cast("decimal(38,0)") + F.col(row_id).cast("decimal(20,0)")
    parts = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(*[x.alias(f"r{i}") for i, x in enumerate(parts)], F.col(row_id).alias("id"))


def _leaders(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """The first row of every identifier that more than one pair carries."""
    named = pairs.where(F.col(key[0]).isNotNull())
    return named.groupBy(*key).agg(F.min("top").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def surplus_copies(
    messages: DataFrame,
    row_id: str = "delivery_id",
    scope: str = "queue_url",
    identifiers: Sequence[str] = ("message_id", "message_deduplication_id"),
    order: Sequence[str] = ("sequence_number",),
) -> DataFrame:
    """The ``row_id`` of every row that isn't the copy to keep.

    Two rows are copies if they lie in one ``scope`` and share one of the ``identifiers``, compared without case and outer
    white space; copies of copies are copies too. The row kept is the lowest by ``order`` (nulls last), then by ``row_id``.

    Method: hash aggregation by identifier with min_by over order and deterministic tie-break, packed into one value (see _rank). Rows that agree in
    scope and all identifiers fold map-side, so a hot message costs one row per task; each identifier's first row is found the same
    way. Only pairs that an identifier ties to an earlier row go on to the components, usually a few per cent.

    Defined cases: a null or blank identifier ties nothing; a row with none, or with a null scope, is its own message; rows
    of one ``row_id`` count as one row, by their lowest order; a null ``row_id`` is dropped, as it can't be named; an empty
    table gives an empty result; other columns, whatever their names, are never read.
    """
    cols = [F.col(row_id).alias("id"), _rank(messages, row_id, order).alias("rank")]
    keys: list[list[str]] = []
    for i, name in enumerate(identifiers):
        a, b = key128(F.lit(i), F.col(scope), folded(F.col(name)))
        here = F.col(scope).isNotNull()
        keys.append([f"k{i}a", f"k{i}b"])
        cols += [F.when(here, a).alias(f"k{i}a"), F.when(here, b).alias(f"k{i}b")]
    rows = messages.where(F.col(row_id).isNotNull()).select(*cols)
    named = F.coalesce(*[F.col(k[0]) for k in keys]).isNotNull()
    flat = [c for k in keys for c in k]
    pairs, _ = settle(rows.where(named).groupBy(*flat).agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("top")), "pairs")

    links = None
    for k in keys:
        tied = pairs.join(_leaders(pairs, k), list(k)).where("lead <> top").select(F.col("top").alias("u"), F.col("lead").alias("v"))
        links = tied if links is None else links.unionByName(tied)
    losers, _ = star_components(links)
    keepers = pairs.join(losers.select(F.col("node").alias("top")), "top", "left_anti").select("id")
    return rows.where(named).select("id").join(keepers, "id", "left_anti").distinct().select(F.col("id").alias(row_id))


def first_copies(messages: DataFrame, row_id: str = "delivery_id", order: Sequence[str] = ("sequence_number",), **how) -> DataFrame:
    """The messages themselves, each exactly once: all columns of the rows kept. See surplus_copies.

    Rows stored twice under one ``row_id`` are one row, the lowest by order, then by a hash of all columns; they fold map-side, so a row stored very
    often doesn't fill a task. Rows with a null ``row_id`` can't be named as copies and all stay.
    """
    kept = messages.where(F.col(row_id).isNotNull()).join(surplus_copies(messages, row_id, order=order, **how), row_id, "left_anti").select(*messages.columns)
    place = F.struct(*[x.alias(f"r{i}") for i, x in enumerate([y for c in order for y in (F.col(c).isNull(), F.col(c))])], F.xxhash64(*messages.columns).alias("h"))
    once = kept.groupBy(F.col(row_id).alias("id")).agg(F.min_by(F.struct(*messages.columns), place).alias("row")).select("row.*")
    return once.unionByName(messages.where(F.col(row_id).isNull()))
