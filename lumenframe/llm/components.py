"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import storage

#: Rows of a few short columns (some MB) up to which a side of a join is broadcast; beyond, both sides are shuffled.
FEW = 200_000


def small(df: DataFrame) -> DataFrame:
    """A stored ``df``, marked for broadcast if its count is at most ``FEW``."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _lowest(edges: DataFrame, own: bool) -> DataFrame:
    """(u, m): the lowest neighbour of each u, u itself included if ``own``. Stored, so that joins with it can be split."""
    low: Column = F.min("v")
    return storage.cut(edges.groupBy("u").agg((F.least(low, F.col("u")) if own else low).alias("m")))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v; any order); a component's name is its lowest node.

    A large star ties each node's higher neighbours to its lowest one, a small star its lower ones;
    both keep components whole and end with stars. Edges are stored after each round, and the loop
    ends when none changes; only counts reach the driver. Nodes are of any one ordered type. Null ends
    and loops are ignored; a node of loops only is in no component.
    """
    u, v = F.col("u"), F.col("v")
    now = storage.cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u != v").distinct())
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(small(_lowest(both, True)), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = storage.cut(large)
        low = _lowest(large, False)
        tied = large.join(small(low), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = storage.cut(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = tuple(now.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
