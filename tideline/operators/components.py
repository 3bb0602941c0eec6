"""Connected components by alternating stars, for the links that plain grouping leaves open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, settle


def star_components(links: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, root): every node that isn't the least of its component, with that least node.

    ``links`` has columns ``u`` and ``v`` of one orderable type (here a rank); direction doesn't matter. Each round
    contracts large and small stars, so a chain of n links takes O(log n) rounds. Every round is a grouped minimum (combined
    map-side) and a join on the node, which adaptive execution splits where one node has very many links; no component is
    ever gathered in one place. Each round is written to the shared folder, so lost executors cost only the current round.
    Empty input gives an empty result. Returns the table and its path.
    """
    spark = links.sparkSession
    flat = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, at = settle(flat, "stars")
    for _ in range(max_rounds):
        if _is_forest_of_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), at
        # large star: hang every greater neighbour of u under the least neighbour of u
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # small star: hang every lesser neighbour of u, and u itself, under the least of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt, nxt_at = settle(small, "stars")
        drop_path(spark, at)
        edges, at = nxt, nxt_at
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node hangs under exactly one node that hangs under none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
    per = ends.groupBy("e.n").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
    return per.where("ups > 1 OR (ups = 1 AND low = 0)").isEmpty()
