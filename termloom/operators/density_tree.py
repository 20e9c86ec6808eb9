"""Leaf clusters of a density hierarchy from its spanning tree, by joins and connected components; no task sees a block.

Read the tree's edges in order (reach, gap, low, high): components grow, and one of at least `min_size` rows is big. A point
leaves its cluster at the edge at which its component became big, `h`. An edge between two big components splits: both sides
are clusters of their own, and a cluster without a split inside is a leaf. Hence

1. `h` of all points: small components follow their lightest edge. Along these pointers edges get lighter, so everything behind
   a big component, or behind a pair that points at each other and is big together, becomes big with its own pointer's edge.
   Where the pair stays small it is joined, so at most min_size - 1 rounds are needed.
2. An edge splits if both its points were big before it.
3. What other edges connect grew around one big component. Its leaf cluster are the points that became big before its first
   split; points that came later are noise, and so is everything where nothing splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.ordering import sparse_chunk, with_row_index
from termloom.operators.assemble import OUTLIER
from termloom.operators.merge import connected_components
from termloom.session import cut_lineage

KEY = ["reach", "gap", "low", "high"]


def _key() -> Column:
    return F.struct(*KEY)


def big_from(points: DataFrame, edges: DataFrame, min_size: int) -> DataFrame:
    """(row_id, since, h): the edge (KEY) at which each point's component became big, and its level.

    `points`: row_id, weight, core_distance. A point of at least `min_size` copies is big before all edges, at its core distance.
    """
    before = F.struct(F.lit(-1.0).alias("reach"), F.lit(-1.0).alias("gap"), F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))
    alone = F.col("weight") >= min_size
    state = cut_lineage(
        points.select(
            "row_id",
            F.col("row_id").alias("comp"),
            "weight",
            F.when(alone, before).alias("since"),
            F.when(alone, F.col("core_distance")).alias("h"),
        )
    )
    both = edges.select(F.col("low").alias("u"), F.col("high").alias("v"), _key().alias("key"))
    both = cut_lineage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "key")))
    while not state.filter("since is null").isEmpty():
        open_ = state.filter("since is null")
        ends = state.select(F.col("row_id").alias("v"), F.col("comp").alias("target"), F.col("since").isNotNull().alias("big"))
        out = both.join(open_.select(F.col("row_id").alias("u"), "comp"), "u").join(ends, "v").filter("comp <> target")
        pointers = out.groupBy("comp").agg(F.min(F.struct("key", "target", "big")).alias("p")).select("comp", "p.*")
        sizes = open_.groupBy("comp").agg(F.sum("weight").alias("size"))
        pointers = cut_lineage(pointers.join(sizes, "comp"))
        if pointers.isEmpty():  # whole trees below min_size
            break
        other = pointers.select(F.col("comp").alias("target"), F.col("key").alias("key_"), F.col("size").alias("size_"))
        pointers = pointers.join(other, "target", "left").withColumn("mutual", F.coalesce(F.col("key") == F.col("key_"), F.lit(False)))
        groups = connected_components(pointers.filter("not big").select(F.col("comp").alias("a"), F.col("target").alias("b")))
        pointers = pointers.join(groups.select(F.col("id").alias("comp"), F.col("component").alias("chain")), "comp", "left")
        pointers = cut_lineage(pointers.withColumn("chain", F.coalesce("chain", "comp")))
        ends_big = F.col("big") | (F.col("mutual") & (F.col("size") + F.col("size_") >= min_size))
        chains = pointers.groupBy("chain").agg(F.max(ends_big).alias("ends_big"))
        told = pointers.join(chains, "chain").select(
            "comp",
            F.when(F.col("ends_big"), F.col("key")).alias("found"),
            F.when(F.col("mutual"), F.least("comp", "target")).otherwise(F.col("comp")).alias("joined"),
        )
        state = state.join(told, "comp", "left").select(
            "row_id",
            F.coalesce("joined", "comp").alias("comp"),
            "weight",
            F.coalesce("since", "found").alias("since"),
            F.coalesce("h", "found.reach").alias("h"),
        )
        state = cut_lineage(state)
    return state.select("row_id", "since", "h")


def leaf_labels(points: DataFrame, edges: DataFrame, min_size: int) -> DataFrame:
    """(block_id, row_id, local_id, probability) of distinct points; -1 is noise. Local ids follow the lowest row of a cluster.

    `points`: coarse_id, row_id, weight, core_distance, of blocks of at least `min_size` rows; `edges`: KEY, the spanning trees.
    """
    big = cut_lineage(big_from(points, edges, min_size))
    at = edges.select(*KEY, _key().alias("key"))
    for side in ("low", "high"):
        at = at.join(big.select(F.col("row_id").alias(side), F.col("since").alias(f"since_{side}")), side)
    at = cut_lineage(at.withColumn("splits", (F.col("since_low") < F.col("key")) & (F.col("since_high") < F.col("key"))))
    inside = connected_components(at.filter("not splits").select(F.col("low").alias("a"), F.col("high").alias("b")))
    grown = big.join(inside.withColumnRenamed("id", "row_id"), "row_id", "left")
    grown = cut_lineage(grown.withColumn("component", F.coalesce("component", "row_id")))
    splits = at.filter("splits").select(F.explode(F.array("low", "high")).alias("row_id"), "key")
    first = splits.join(grown.select("row_id", "component"), "row_id").groupBy("component").agg(F.min("key").alias("split"))
    members = cut_lineage(grown.join(first, "component").filter(F.col("since") < F.col("split")).select("component", "row_id", "h"))
    named = points.select("coarse_id", "row_id").join(members, "row_id")
    leaves = named.groupBy("component").agg(
        F.min("coarse_id").alias("coarse_id"), F.min("row_id").alias("first"), F.min("h").alias("least")
    )
    leaves = cut_lineage(leaves)
    ranked = with_row_index(leaves, "first", "rank", ["coarse_id"], sparse_chunk(leaves, "first"))
    found = members.join(ranked.select("component", "rank", "least"), "component")
    share = F.when(F.col("h") <= 0, 1.0).when(F.col("least") <= 0, 0.0).otherwise((1 / F.col("h")) / (1 / F.col("least")))
    found = found.select("row_id", (F.col("rank") - 1).cast("int").alias("local_id"), share.alias("probability"))
    return points.select(F.col("coarse_id").alias("block_id"), "row_id").join(found, "row_id", "left").select(
        "block_id", "row_id", F.coalesce("local_id", F.lit(OUTLIER)).alias("local_id"), F.coalesce("probability", F.lit(0.0)).alias("probability")
    )
