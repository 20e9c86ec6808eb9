"""Connected components of an edge list whose vertices are of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of `edges` (a, b); the component is its smallest vertex.

    Each round links every vertex's larger neighbours to its smallest one, then every vertex's smaller neighbours to their
    smallest; stars are left after a logarithmic number of rounds. Edges only, grouped by vertex with partial minima.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.distinct())
    before = _digest(edges)
    while before[0]:
        large = _linked(edges.union(edges.select("b", "a")), F.col("b") > F.col("a"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = joined.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = cut_lineage(small.select("e.a", F.col("e.m").alias("b")).filter("a <> b").distinct())
        after = _digest(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(edges.select("b", "b").distinct())


def _linked(both: DataFrame, keep) -> DataFrame:
    """(neighbour, smallest vertex around a) for each vertex a and its neighbours that `keep` picks."""
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(lowest, "a").filter(keep).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Count and an order-free sum of hashes: equal for equal edge sets."""
    hashed = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(F.pmod(hashed, F.lit(1 << 40))), F.bit_xor(hashed)).first()
    return tuple(row)
