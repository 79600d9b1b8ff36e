"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlescan.llm.common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b: each node's neighbours (the larger ones, or for
    the small star the smaller ones and itself) are linked to its smallest neighbour."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        out = moved.unionByName(least.select("a", F.col("least").alias("b")))
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        out = (both.join(least, "a").filter(F.col("b") > F.col("a"))
               .select(F.col("b").alias("a"), F.col("least").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge; root: the smallest node of its component. Nulls and
    loops are no edges. Nodes are whole numbers. Each step is written to the shared folder."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = written(edges.filter(x.isNotNull() & y.isNotNull() & (x != y))
                  .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    sign = _sign(now)
    for _ in range(rounds):
        if not sign[0]:
            break
        now = written(_star(written(_star(now, small=False), "edges"), small=True), "edges")
        last, sign = sign, _sign(now)
        if sign == last:
            break
    else:
        raise RuntimeError("the components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
