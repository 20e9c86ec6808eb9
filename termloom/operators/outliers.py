"""Multi-pass assignment of outliers to their nearest cluster."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.numbers import ratio
from termloom.operators.assemble import OUTLIER, clustered
from termloom.operators.similarity import nearest_centroid
from termloom.session import cut_lineage

SIMILARITY_THRESHOLD = 0.55
LATER_PASSES = (0.45, 0.35, 0.25)
CONFIDENCE = {"high": 0.75, "medium": 0.6}


def confidence_band(similarity: Column, bounds: dict[str, float] | None = None) -> Column:
    bounds = bounds or CONFIDENCE
    return (
        F.when(similarity >= bounds["high"], "high").when(similarity >= bounds["medium"], "medium").otherwise("low")
    )


def _sums(points: DataFrame) -> DataFrame:
    return (
        points.groupBy(F.col("cluster_id").cast("long").alias("cluster_id"))
        .agg(Summarizer.sum(array_to_vector("vec")).alias("total"), F.count("*").alias("size"))
        .select("cluster_id", "total", "size")
    )


def reassign_outliers(
    points: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    aggressive: bool = True,
    bounds: dict[str, float] | None = None,
) -> DataFrame:
    """One row per reassigned outlier: new cluster, similarity, confidence and the pass that placed it.

    `points` has row_id, vec and cluster_id. Centroids move before each pass; they are kept as (sum, size) so a
    pass only reads the outliers still open and the rows placed by the pass before.
    """
    sums = cut_lineage(_sums(clustered(points)))
    waiting = cut_lineage(points.filter(F.col("cluster_id") == OUTLIER).select("row_id", "vec"))
    placed = None
    for pass_no, bound in enumerate((threshold, *LATER_PASSES) if aggressive else (threshold,), start=1):
        if waiting.isEmpty() or sums.isEmpty():
            break
        centroids = sums.select(
            "cluster_id", F.transform(vector_to_array("total"), lambda x: x / F.col("size")).alias("centroid")
        )
        found = cut_lineage(nearest_centroid(waiting, centroids).filter(F.col("score") >= bound))
        rows = found.withColumn("pass_no", F.lit(pass_no))
        placed = rows if placed is None else placed.unionByName(rows)
        moved = waiting.join(found, "row_id").select("vec", "cluster_id")
        merged = sums.unionByName(_sums(moved)).groupBy("cluster_id")
        sums = cut_lineage(merged.agg(Summarizer.sum(F.col("total")).alias("total"), F.sum("size").alias("size")))
        waiting = cut_lineage(waiting.join(found, "row_id", "left_anti"))
    if placed is None:
        empty = "row_id long, cluster_id long, score double, pass_no int"
        placed = points.sparkSession.createDataFrame([], empty)
    return placed.select(
        "row_id",
        F.lit(OUTLIER).alias("original_cluster"),
        F.col("cluster_id").alias("new_cluster"),
        F.col("score").alias("similarity"),
        confidence_band(F.col("score"), bounds).alias("confidence"),
        "pass_no",
    )


def apply_reassignment(points: DataFrame, placed: DataFrame) -> DataFrame:
    return (
        points.join(placed.select("row_id", "new_cluster"), "row_id", "left")
        .withColumn("cluster_id", F.coalesce("new_cluster", F.col("cluster_id").cast("long")))
        .drop("new_cluster")
    )


def reassignment_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outlier counts and rates of two labelings of the same rows."""
    labels = before.select("row_id", F.col("cluster_id").alias("old")).join(
        after.select("row_id", F.col("cluster_id").alias("new")), "row_id"
    )
    original, remaining = F.count_if(F.col("old") == OUTLIER), F.count_if(F.col("new") == OUTLIER)
    total = F.count("*")
    return labels.agg(
        original.alias("original_outliers"),
        remaining.alias("remaining_outliers"),
        (original - remaining).alias("reassigned"),
        ratio(original - remaining, original).alias("reassignment_rate"),
        ratio(total - remaining, total).alias("final_cluster_rate"),
    )
