"""Merging of similar clusters: similarity graph, connected components, renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.ordering import with_row_index
from termloom.functions.vectors import mean_vectors
from termloom.operators.assemble import clustered
from termloom.operators.similarity import similar_pairs
from termloom.session import cut_lineage

MERGE_THRESHOLD = 0.80


def cluster_centroids(points: DataFrame) -> DataFrame:
    """Mean vector and size per cluster, outliers left out."""
    return mean_vectors(clustered(points), ["cluster_id"], "vec")


def similar_clusters(points: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Candidate pairs, most similar first."""
    pairs = similar_pairs(cut_lineage(cluster_centroids(points)), threshold)
    return pairs.orderBy(F.desc("similarity"), "id_a", "id_b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of an edge list (a, b); the component is its smallest vertex.

    Alternating large-star and small-star contraction: a logarithmic number of rounds even on long chains,
    each made of a map-side-combined minimum and one join against a table with unique keys.
    """
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    edges = cut_lineage(edges.distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        starred = large.join(lowest, "a")
        small = (
            starred.select("a", F.col("m").alias("b"))
            .unionByName(starred.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        small = cut_lineage(small)
        changed = small.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(
            small, ["a", "b"], "left_anti"
        ).isEmpty()
        edges = small
        if changed:
            break
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def renumber(ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """Distinct ids with consecutive numbers from 0 in id order."""
    numbered = with_row_index(ids.select(id_col).distinct(), id_col, "_index")
    return numbered.select(id_col, (F.col("_index") - 1).alias(name))


def merge_clusters(points: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """(cluster_id, merged_id) for every non-outlier cluster: transitive merge, then consecutive ids."""
    centroids = cut_lineage(cluster_centroids(points))
    edges = similar_pairs(centroids, threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    component = connected_components(edges)
    roots = centroids.select(F.col("cluster_id").cast("long").alias("cluster_id")).join(
        component, F.col("cluster_id") == F.col("id"), "left"
    )
    roots = cut_lineage(roots.select("cluster_id", F.coalesce("component", "cluster_id").alias("root")))
    return roots.join(renumber(roots, "root", "merged_id"), "root").select("cluster_id", "merged_id")


def apply_merge(points: DataFrame, merged: DataFrame) -> DataFrame:
    """Points with merged cluster ids; outliers keep -1."""
    return (
        points.withColumn("cluster_id", F.col("cluster_id").cast("long"))
        .join(merged, "cluster_id", "left")
        .withColumn("cluster_id", F.coalesce("merged_id", "cluster_id"))
        .drop("merged_id")
    )
