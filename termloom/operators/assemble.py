"""Cluster metrics, scores, ranking and the final cluster report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.numbers import ratio, round_even
from termloom.functions.vectors import distance, mean_vectors

OUTLIER = -1

PRIORITY_WEIGHTS = {"volume": 0.4, "difficulty": 0.3, "size": 0.3}


def _zero(name: str, zero: int | float = 0) -> Column:
    return F.coalesce(F.col(name), F.lit(zero))


def clustered(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cluster_id") >= 0)


def unclustered(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cluster_id") == OUTLIER).orderBy("row_id")


def cluster_metrics(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Volume, difficulty and cpc aggregates per cluster; missing metrics count as 0."""
    volume = _zero("search_volume").cast("long")
    difficulty, cpc = _zero("keyword_difficulty", 0.0), _zero("cpc", 0.0)
    return members.groupBy(key).agg(
        F.sum(volume).alias("total_search_volume"),
        F.avg(volume).alias("avg_search_volume"),
        F.max(volume).alias("max_search_volume"),
        F.min(volume).alias("min_search_volume"),
        F.avg(difficulty).alias("avg_keyword_difficulty"),
        F.max(difficulty).alias("max_keyword_difficulty"),
        F.min(difficulty).alias("min_keyword_difficulty"),
        F.avg(cpc).alias("avg_cpc"),
        F.sum(volume * cpc).alias("total_cpc_opportunity"),
        F.count("*").alias("keyword_count"),
    )


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """One row over all clusters; zeros when there are none."""
    keywords = F.coalesce(F.sum("keyword_count"), F.lit(0))
    clusters = F.count("*")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return metrics.agg(
        clusters.alias("total_clusters"),
        keywords.alias("total_keywords"),
        total("total_search_volume").alias("total_search_volume"),
        ratio(keywords, clusters).alias("avg_cluster_size"),
        ratio(
            F.coalesce(F.sum(F.col("avg_keyword_difficulty") * F.col("keyword_count")), F.lit(0.0)), keywords
        ).alias("avg_keyword_difficulty"),
        F.coalesce(F.max("total_search_volume"), F.lit(0)).alias("largest_cluster_volume"),
        F.coalesce(F.min("total_search_volume"), F.lit(0)).alias("smallest_cluster_volume"),
        F.coalesce(F.sum("total_cpc_opportunity"), F.lit(0.0)).alias("total_cpc_opportunity"),
    )


def rank_score(by: str = "opportunity") -> Column:
    volume, difficulty = F.col("total_search_volume"), F.col("avg_keyword_difficulty")
    scores = {
        "difficulty": 100 - difficulty,
        "opportunity": volume / F.greatest(F.lit(1.0), difficulty),
        "size": F.col("keyword_count"),
    }
    return scores.get(by, volume).cast("double")


def rank_clusters(metrics: DataFrame, by: str = "opportunity") -> DataFrame:
    """(cluster_id, score), best first; an unknown criterion ranks by volume."""
    return metrics.select("cluster_id", rank_score(by).alias("score")).orderBy(F.desc("score"), "cluster_id")


def priority_score(
    volume: Column, difficulty: Column, count: Column, weights: dict[str, float] | None = None
) -> Column:
    """Weighted 0-100 score of log volume, inverse difficulty and size, to one decimal."""
    weights = weights or PRIORITY_WEIGHTS
    score = (
        F.least(F.lit(100.0), F.log1p(volume) * 10) * weights["volume"]
        + (100 - difficulty) * weights["difficulty"]
        + F.least(F.lit(100), count * 2) * weights["size"]
    )
    return round_even(score, 1)


def with_priority(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return metrics.withColumn(
        "priority_score",
        priority_score(
            F.col("total_search_volume"), F.col("avg_keyword_difficulty"), F.col("keyword_count"), weights
        ),
    )


def default_label(label: Column, cluster_id: Column) -> Column:
    return F.coalesce(label, F.format_string("Cluster %d", cluster_id))


def cluster_report(members: DataFrame, labels: DataFrame, quality: DataFrame) -> DataFrame:
    """One row per cluster: label, metrics, intent, quality and priority; highest priority first."""
    scored = with_priority(cluster_metrics(clustered(members)))
    return (
        scored.join(labels.select("cluster_id", "label", "intent"), "cluster_id", "left")
        .join(quality.select("cluster_id", "quality_score"), "cluster_id", "left")
        .select(
            F.col("cluster_id").alias("id"),
            default_label(F.col("label"), F.col("cluster_id")).alias("label"),
            F.col("keyword_count").alias("size"),
            F.col("total_search_volume").alias("total_volume"),
            F.col("avg_keyword_difficulty").alias("avg_difficulty"),
            F.coalesce("intent", F.lit("unknown")).alias("intent"),
            F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
            "priority_score",
        )
        .orderBy(F.desc("priority_score"), "id")
    )


def report_totals(report: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("size"), F.lit(0))
    return report.agg(
        F.count("*").alias("total_clusters"),
        F.coalesce(F.sum("total_volume"), F.lit(0)).alias("total_volume"),
        ratio(F.coalesce(F.sum(F.col("avg_difficulty") * F.col("size")), F.lit(0.0)), size).alias("avg_difficulty"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"),
        size.alias("clustered_keywords"),
    )


def run_summary(members: DataFrame, validations: DataFrame | None = None) -> DataFrame:
    """Totals of a run; the mean overlap covers clusters with a positive overlap."""
    outliers = F.count_if(F.col("cluster_id") == OUTLIER)
    total = F.count("*")
    facts = members.agg(
        total.alias("total_keywords"),
        outliers.alias("outlier_keywords"),
        (total - outliers).alias("clustered_keywords"),
        ratio(total - outliers, total).alias("cluster_rate"),
        F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"),
    )
    if validations is None:
        return facts.withColumn("avg_serp_overlap", F.lit(0.0))
    mean = validations.filter("average_overlap > 0").agg(F.coalesce(F.avg("average_overlap"), F.lit(0.0)))
    return facts.withColumn("avg_serp_overlap", mean.scalar())


def top_members(members: DataFrame, n: int = 10) -> DataFrame:
    """The `n` highest-volume members per cluster with their rank; ties keep row order.

    The rank filter runs as a group limit before the shuffle, so a hot cluster ships `n` rows per task.
    """
    rank = F.row_number().over(
        Window.partitionBy("cluster_id").orderBy(F.desc(_zero("search_volume")), F.col("row_id"))
    )
    return clustered(members).withColumn("rank", rank).filter(F.col("rank") <= n)


def first_members(members: DataFrame, n: int) -> DataFrame:
    """The first `n` members per cluster in row order, with their position."""
    position = F.row_number().over(Window.partitionBy("cluster_id").orderBy("row_id"))
    return clustered(members).withColumn("position", position).filter(F.col("position") <= n)


def keyword_lists(ranked: DataFrame, order_col: str, name: str) -> DataFrame:
    """Ordered keyword array per cluster; only for inputs already limited to a few rows per cluster."""
    pairs = F.array_sort(F.collect_list(F.struct(order_col, "keyword")))
    return ranked.groupBy("cluster_id").agg(F.transform(pairs, lambda p: p["keyword"]).alias(name))


def quality_score(mean_distance: Column, size: Column, overlap: Column, confidence: Column) -> Column:
    """0-100 score of tightness, URL overlap, size and validation confidence (NULL confidence: no validation)."""
    tightness = F.greatest(F.lit(0.0), 30 * F.exp(-mean_distance))
    agreement = F.when(confidence > 0, overlap * 30).otherwise(15.0)
    balance = (
        F.when(size.between(5, 100), 20.0)
        .when(size < 5, size * 4.0)
        .otherwise(F.greatest(F.lit(10.0), 20 - (size - 100) * 0.1))
    )
    clarity = F.coalesce(confidence * 20, F.lit(10.0))
    return F.least(F.lit(100.0), tightness + agreement + balance + clarity)


def cluster_info(points: DataFrame, validations: DataFrame | None = None) -> DataFrame:
    """Centroid, size, validation and quality per cluster. Members stay in the points table."""
    members = clustered(points).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    centroids = mean_vectors(members, ["cluster_id"], "vec")
    spread = (
        members.join(centroids.select("cluster_id", "centroid"), "cluster_id")
        .groupBy("cluster_id")
        .agg(F.avg(distance(F.col("vec"), F.col("centroid"))).alias("mean"))
    )
    info = centroids.join(spread, "cluster_id")
    if validations is None:
        info = info.withColumns({"average_overlap": F.lit(None).cast("double"), "confidence": F.lit(None).cast("double")})
    else:
        info = info.join(
            validations.select(F.col("cluster_id").cast("long").alias("cluster_id"), "average_overlap", "confidence"),
            "cluster_id",
            "left",
        )
    score = quality_score(F.col("mean"), F.col("size"), F.col("average_overlap"), F.col("confidence"))
    return info.withColumn("quality_score", score).drop("mean")
