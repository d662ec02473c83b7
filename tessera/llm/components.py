"""Connected components of an edge table, by alternating large and small stars.

Each round is two grouped minima joined back to the edges, so a hub with a
third of all edges is pre-aggregated before the shuffle and its join side can
be split.  Rounds are logarithmic in the longest path; each one ends in a
checkpoint in the shared folder, so that lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b: every node's relevant neighbours are tied to its smallest one."""
    if small:
        near = edges  # of each node only its smaller neighbours count
    else:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = near.join(least, "a")
    if small:
        out = tied.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        out = tied.where("b > a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    return out.where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Size and checksum of an edge table: equal in two rounds once nothing changes."""
    e = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(e)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a linked pair; root is the component's smallest node.

    Loops, repeated and reversed edges are harmless; without edges the result is empty.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    e = checkpoint(e)
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        e = checkpoint(_star(_star(e, small=False), small=True))
        if (now := _state(e)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
