"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a partial aggregation (least neighbour of a node) and an equi-join, so a node with very many
neighbours is summed before the shuffle and its join is split. No links and no components reach the driver: it sees
one row of counts a round. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumibase.llm.shared import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node, and each smaller neighbour of it, to the least of these. Edges point from larger to smaller."""
    joined = edges.join(_least(edges), "u")
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return joined.select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From edges (u, v) the members (u, v) with v the least node that u reaches; the least nodes have no row.

    Loops and repeated edges are allowed; rows with a null end are dropped, as they link nothing. No edges: no rows.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_small_star(_large_star(now)).distinct(), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now
        mark = seen
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
