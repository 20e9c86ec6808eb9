"""Cluster validation by the overlap of result URLs of its top keywords.

Each cluster contributes at most `n` checked keywords with ten URLs each, so one bounded array per cluster
carries everything the checks need and a single shuffle serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.assemble import top_members

OVERLAP_THRESHOLD = 0.4
VALIDATION_COUNT = 10
URL_DEPTH = 10


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two URL sets; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(
        F.lit(0.0)
    )


def checked_items(members: DataFrame, serps: DataFrame, n: int = VALIDATION_COUNT) -> DataFrame:
    """(cluster_id, items): the top `n` keywords by volume with the first URLs of each.

    A keyword without a result row counts as one with no URLs.
    """
    checked = top_members(members, n).join(serps.select("keyword", "urls"), "keyword", "left")
    no_urls = F.array().cast("array<string>")
    item = F.struct("rank", "keyword", F.slice(F.coalesce("urls", no_urls), 1, URL_DEPTH).alias("urls"))
    return checked.groupBy("cluster_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _pairs(items: Column) -> Column:
    def with_later(a: Column) -> Column:
        later = F.filter(items, lambda b: b["rank"] > a["rank"])
        return F.transform(
            later,
            lambda b: F.struct(
                a["keyword"].alias("keyword_a"),
                b["keyword"].alias("keyword_b"),
                jaccard(a["urls"], b["urls"]).alias("overlap"),
            ),
        )

    return F.flatten(F.transform(items, with_later))


def pairwise_overlap(checked: DataFrame) -> DataFrame:
    """Upper triangle of the overlap matrix in long form, over the bounded checked keywords."""
    return checked.select("cluster_id", F.explode(_pairs(F.col("items"))).alias("pair")).select("cluster_id", "pair.*")


def _average_overlap(items: Column) -> Column:
    pairs = _pairs(items)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["overlap"])
    return F.when(F.size(items) < 2, 1.0).otherwise(total / F.size(pairs))


def common_urls(checked: DataFrame, limit: int = 10) -> DataFrame:
    """URLs listed for at least max(2, 30 %) of the checked keywords, most frequent first."""
    listed = checked.filter(F.size("items") >= 2).select(
        "cluster_id", F.size("items").alias("n"), F.explode("items").alias("item")
    )
    seen = listed.select("cluster_id", "n", "item.rank", F.posexplode("item.urls").alias("pos", "url"))
    counts = seen.groupBy("cluster_id", "url").agg(
        F.count("*").alias("appearances"), F.min(F.struct("rank", "pos")).alias("first"), F.max("n").alias("n")
    )
    frequent = counts.filter(F.col("appearances") >= F.greatest(F.lit(2.0), F.col("n") * 0.3))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("appearances"), "first")
    return (
        frequent.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select("cluster_id", "position", "url", "appearances")
    )


def validate_clusters(checked: DataFrame, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """Average overlap, coherence and confidence per cluster; fewer than two keywords pass with confidence 0."""
    n = F.size("items")
    covered = F.size(F.filter("items", lambda i: F.size(i["urls"]) > 0))
    return checked.select(
        "cluster_id",
        n.alias("keywords_checked"),
        _average_overlap(F.col("items")).alias("average_overlap"),
        F.when(n < 2, 0.0).otherwise(covered / n * F.least(F.lit(1.0), n / 5)).alias("confidence"),
    ).withColumn("is_coherent", F.col("average_overlap") >= threshold)


def suggest_splits(checked: DataFrame, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """(cluster_id, rank, keyword, group): greedy regrouping of incoherent clusters.

    A keyword joins the earliest group seed it overlaps with, else it seeds its own group; `group` is the
    seed's rank. Coherent clusters and those with fewer than three keywords stay whole.
    """
    placed_type = "array<struct<rank:int,keyword:string,urls:array<string>,seed:int>>"

    def place(placed: Column, item: Column) -> Column:
        fits = F.filter(placed, lambda p: (p["rank"] == p["seed"]) & (jaccard(p["urls"], item["urls"]) >= threshold))
        seed = F.coalesce(F.get(fits, F.lit(0))["seed"], item["rank"])
        row = F.struct(item["rank"], item["keyword"], item["urls"], seed.alias("seed"))
        return F.concat(placed, F.array(row).cast(placed_type))

    items = F.col("items")
    whole = (_average_overlap(items) >= threshold) | (F.size(items) < 3)
    greedy = F.aggregate(items, F.array().cast(placed_type), place)
    kept = F.transform(items, lambda i: F.struct(i["rank"], i["keyword"], i["urls"], F.lit(1).alias("seed")))
    grouped = checked.select("cluster_id", F.when(whole, kept.cast(placed_type)).otherwise(greedy).alias("placed"))
    return grouped.select("cluster_id", F.explode("placed").alias("p")).select(
        "cluster_id", "p.rank", "p.keyword", F.col("p.seed").alias("group")
    )
