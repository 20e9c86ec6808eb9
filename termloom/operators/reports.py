"""Datasets behind the result views, exports and workbook sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.numbers import band, difficulty_band, fixed_text, gauge, percent_text, ratio, round_even
from termloom.functions.ordering import exact_median
from termloom.operators.assemble import clustered, first_members, keyword_lists, unclustered


def _members_with_cluster(report: DataFrame, members: DataFrame) -> DataFrame:
    """Member rows with their cluster's report columns, in report then member order."""
    return (
        clustered(members)
        .join(report, F.col("cluster_id") == F.col("id"))
        .orderBy(F.desc("priority_score"), "id", "row_id")
    )


def keyword_export(report: DataFrame, members: DataFrame) -> DataFrame:
    """One row per clustered keyword."""
    return _members_with_cluster(report, members).select(
        F.col("id").alias("cluster_id"),
        F.col("label").alias("cluster_label"),
        "keyword",
        F.coalesce("search_volume", F.lit(0)).alias("search_volume"),
        F.coalesce("keyword_difficulty", F.lit(0.0)).alias("keyword_difficulty"),
        "intent",
        F.col("total_volume").alias("cluster_total_volume"),
        round_even(F.col("avg_difficulty"), 2).alias("cluster_avg_difficulty"),
        F.col("size").alias("cluster_size"),
        round_even(F.col("quality_score"), 2).alias("quality_score"),
    )


def _with_first_keywords(report: DataFrame, members: DataFrame, n: int, separator: str) -> DataFrame:
    firsts = keyword_lists(first_members(members, n), "position", "firsts")
    return report.join(firsts, F.col("cluster_id") == F.col("id"), "left").withColumn(
        "top_keywords", F.coalesce(F.array_join("firsts", separator), F.lit(""))
    )


def cluster_export(report: DataFrame, members: DataFrame) -> DataFrame:
    """One row per cluster with its first five members."""
    return (
        _with_first_keywords(report, members, 5, " | ")
        .orderBy(F.desc("priority_score"), "id")
        .select(
            F.col("id").alias("cluster_id"),
            "label",
            "size",
            "total_volume",
            round_even(F.col("avg_difficulty"), 2).alias("avg_difficulty"),
            "intent",
            round_even(F.col("quality_score"), 2).alias("quality_score"),
            "top_keywords",
        )
    )


def unclustered_export(members: DataFrame) -> DataFrame:
    return unclustered(members).select(
        "keyword",
        F.coalesce("search_volume", F.lit(0)).alias("search_volume"),
        F.coalesce("keyword_difficulty", F.lit(0.0)).alias("keyword_difficulty"),
    )


def report_header(summary: DataFrame) -> DataFrame:
    """Metadata row that accompanies a full export."""
    return summary.select(
        "total_keywords",
        F.col("n_clusters").alias("total_clusters"),
        percent_text(F.col("cluster_rate")).alias("cluster_rate"),
    )


def workbook_summary(summary: DataFrame, totals: DataFrame) -> DataFrame:
    """Six labelled metrics in display order."""
    facts = summary.select(
        "total_keywords",
        "n_clusters",
        "cluster_rate",
        "outlier_keywords",
        totals.select("total_volume").scalar().alias("total_volume"),
        totals.select("avg_difficulty").scalar().alias("avg_difficulty"),
    )
    lines = [
        ("Total Keywords", F.col("total_keywords").cast("string")),
        ("Total Clusters", F.col("n_clusters").cast("string")),
        ("Cluster Rate", percent_text(F.col("cluster_rate"))),
        ("Total Search Volume", F.format_number("total_volume", 0)),
        ("Average Difficulty", fixed_text(F.col("avg_difficulty"), 1)),
        ("Unclustered Keywords", F.col("outlier_keywords").cast("string")),
    ]
    rows = F.array(
        *[F.struct(F.lit(i).alias("line"), F.lit(k).alias("metric"), v.alias("value")) for i, (k, v) in enumerate(lines)]
    )
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def workbook_clusters(report: DataFrame, members: DataFrame) -> DataFrame:
    quality = round_even(F.col("quality_score"), 1)
    return (
        _with_first_keywords(report, members, 5, ", ")
        .orderBy(F.desc("priority_score"), "id")
        .select(
            F.col("id").alias("cluster_id"),
            "label",
            "size",
            "total_volume",
            round_even(F.col("avg_difficulty"), 1).alias("avg_difficulty"),
            F.initcap("intent").alias("intent"),
            quality.alias("quality_score"),
            band(quality).alias("quality_band"),
            "top_keywords",
        )
    )


def workbook_keywords(report: DataFrame, members: DataFrame) -> DataFrame:
    return _members_with_cluster(report, members).select(
        "keyword",
        F.col("id").alias("cluster_id"),
        F.col("label").alias("cluster_label"),
        F.coalesce("search_volume", F.lit(0)).alias("search_volume"),
        F.coalesce("keyword_difficulty", F.lit(0.0)).alias("keyword_difficulty"),
        F.initcap("intent").alias("intent"),
    )


def intent_histogram(report: DataFrame) -> DataFrame:
    """Cluster count and percentage per intent, most frequent first."""
    counts = report.groupBy("intent").agg(F.count("*").alias("clusters"))
    total = counts.agg(F.sum("clusters")).scalar()
    return counts.select(
        F.initcap("intent").alias("intent"), "clusters", (F.col("clusters") / total * 100).alias("percent")
    ).orderBy(F.desc("clusters"), "intent")


def size_distribution(report: DataFrame, n: int = 20) -> DataFrame:
    return report.orderBy(F.desc("size"), "id").limit(n).select("id", "label", "size")


def treemap(report: DataFrame) -> DataFrame:
    """Clusters by volume with display text and the overall volume."""
    total = report.agg(F.coalesce(F.sum("total_volume"), F.lit(0))).scalar()
    text = F.format_string("%s<br>%s vol | %d kw", F.col("label"), F.format_number("total_volume", 0), F.col("size"))
    return report.select(
        "id", text.alias("label"), F.col("total_volume").alias("volume"), total.alias("overall_volume")
    ).orderBy(F.desc("volume"), "id")


def opportunity_matrix(report: DataFrame) -> DataFrame:
    """Marker size and quadrant per cluster; split at mean difficulty and median volume."""
    facts = report.agg(F.max("size").alias("max_size"), F.avg("avg_difficulty").alias("mean_difficulty"))
    largest, split_x = facts.select("max_size").scalar(), facts.select("mean_difficulty").scalar()
    split_y = exact_median(report, "total_volume").scalar()
    placed = report.select(
        "id",
        "label",
        F.col("avg_difficulty").alias("difficulty"),
        F.col("total_volume").alias("volume"),
        (10 + F.col("size") / largest * 40).alias("marker_size"),
        split_x.alias("difficulty_split"),
        split_y.alias("volume_split"),
    )
    low, high = F.col("difficulty") < F.col("difficulty_split"), F.col("volume") >= F.col("volume_split")
    return placed.withColumn("quadrant", F.when(high & low, "Quick Wins").when(high, "High Value").otherwise(""))


def quality_leaders(report: DataFrame, n: int = 20) -> DataFrame:
    return (
        report.orderBy(F.desc("quality_score"), "id")
        .limit(n)
        .select(
            "id",
            "label",
            "quality_score",
            band(F.col("quality_score")).alias("band"),
            fixed_text(F.col("quality_score"), 0).alias("text"),
        )
    )


def gauges(kpis: DataFrame) -> DataFrame:
    """One row per gauge of a one-row KPI table (rates scaled to percent)."""
    lines = [
        ("Cluster Rate", F.col("cluster_rate") * 100),
        ("Avg Quality", F.col("avg_quality")),
        ("SERP Coherence", F.col("serp_overlap") * 100),
        ("Label Consistency", F.col("consistency_score") * 100),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("gauge"), gauge(v.cast("double")).alias("value")) for k, v in lines])
    return kpis.select(F.explode(rows).alias("g")).select("g.*", band(F.col("g.value")).alias("band"))


def rate_badge(rate: Column) -> Column:
    return F.when(rate > 0.8, "Good").otherwise("Low")


def easy_badge(difficulty: Column) -> Column:
    return F.when(difficulty < 30, "Easy")


def cluster_cards(report: DataFrame) -> DataFrame:
    return report.select(
        "id",
        "label",
        F.format_number("total_volume", 0).alias("volume"),
        easy_badge(F.col("avg_difficulty")).alias("easy"),
        difficulty_band(F.col("avg_difficulty")).alias("difficulty_band"),
        F.initcap("intent").alias("intent"),
        band(F.col("quality_score")).alias("quality_band"),
    )


def cluster_table(report: DataFrame) -> DataFrame:
    return report.select(
        F.col("label").alias("Cluster"),
        F.col("size").alias("Keywords"),
        F.col("total_volume").alias("Volume"),
        F.col("avg_difficulty").alias("Avg. KD"),
        F.initcap("intent").alias("Intent"),
        F.col("quality_score").alias("Quality"),
    )


def member_preview(members: DataFrame, n: int = 15) -> DataFrame:
    """First `n` keywords per cluster and how many more there are."""
    sizes = clustered(members).groupBy("cluster_id").agg(F.count("*").alias("size"))
    return (
        first_members(members, n)
        .join(sizes, "cluster_id")
        .select("cluster_id", "position", "keyword", F.greatest(F.col("size") - n, F.lit(0)).alias("remaining"))
    )


def unclustered_preview(members: DataFrame, n: int = 50) -> DataFrame:
    """First `n` unclustered keywords, the display column of each, and how many more there are."""
    outliers = unclustered(members)
    total = outliers.agg(F.count("*")).scalar()
    shown = outliers.limit(n).withColumn("total", total)
    split = F.least(F.lit(n // 2), F.floor(F.col("total") / 2))
    firsts = shown.agg(
        F.array_sort(F.collect_list(F.struct("row_id", "keyword"))).alias("rows"), F.max("total").alias("total")
    )
    return firsts.select(F.posexplode("rows").alias("position", "r"), "total").select(
        (F.col("position") + 1).alias("position"),
        "r.keyword",
        F.when(F.col("position") < split, 1).otherwise(2).alias("display_column"),
        F.greatest(F.col("total") - n, F.lit(0)).alias("remaining"),
    )


def overall_rate(members: DataFrame) -> Column:
    return ratio(F.count_if(F.col("cluster_id") >= 0), F.count("*"))
