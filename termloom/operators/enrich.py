"""Metric and result caches, enrichment joins, request batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.numbers import ratio
from termloom.functions.ordering import sparse_chunk, with_row_index

METRICS_TTL = "7 days"
SERP_TTL = "24 hours"
METRICS_COST_PER_1000, SERP_COST = 0.05, 0.001

# Request codes of locations and languages.
LOCATIONS = {
    "United States": 2840, "United Kingdom": 2826, "Canada": 2124, "Australia": 2036, "Germany": 2276, "France": 2250,
    "Spain": 2724, "Italy": 2380, "Netherlands": 2528, "Brazil": 2076, "Mexico": 2484, "India": 2356, "Japan": 2392,
}
LANGUAGES = {
    "English": "en", "Spanish": "es", "French": "fr", "German": "de", "Italian": "it", "Portuguese": "pt",
    "Dutch": "nl", "Japanese": "ja", "Chinese": "zh", "Hindi": "hi",
}
DEFAULT_LOCATION, DEFAULT_LANGUAGE = 2840, "en"


def latest_entries(log: DataFrame, sequence: str | None = None) -> DataFrame:
    """Current cache state of an append-only log: the newest entry per keyword."""
    order = F.struct("fetched_at", *([sequence] if sequence else []))
    return log.groupBy("keyword").agg(F.max_by(F.struct(*log.columns), order).alias("e")).select("e.*")


def fresh_entries(log: DataFrame, as_of: Column, ttl: str = METRICS_TTL, sequence: str | None = None) -> DataFrame:
    """Newest entry per keyword that is no older than `ttl`.

    The age filter runs on the scan: an old entry can only be the newest of a keyword that has no fresh one.
    """
    return latest_entries(log.filter(F.col("fetched_at") >= as_of - F.expr(f"interval {ttl}")), sequence)


def cached(keywords: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache entries of the requested keywords, one per keyword."""
    return fresh.join(keywords.select("keyword"), "keyword", "left_semi")


def uncached(keywords: DataFrame, fresh: DataFrame) -> DataFrame:
    """Requested rows without a fresh entry."""
    return keywords.join(fresh.select("keyword"), "keyword", "left_anti")


def cache_stats(keywords: DataFrame, metrics: DataFrame, serps: DataFrame) -> DataFrame:
    """Hits, misses and hit rates of both caches; rates are 0 for no keywords."""
    hits = (
        keywords.groupBy("keyword")
        .agg(F.count("*").alias("n"))
        .join(metrics.select("keyword", F.lit(1).alias("m")), "keyword", "left")
        .join(serps.select("keyword", F.lit(1).alias("s")), "keyword", "left")
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    m, s = F.count("m"), F.count("s")
    return hits.agg(
        total.alias("total_keywords"),
        m.alias("metrics_cached"),
        (total - m).alias("metrics_uncached"),
        ratio(m, total).alias("metrics_hit_rate"),
        s.alias("serp_cached"),
        (total - s).alias("serp_uncached"),
        ratio(s, total).alias("serp_hit_rate"),
    )


def savings(stats: DataFrame) -> DataFrame:
    cost = F.col("metrics_cached") / 1000 * METRICS_COST_PER_1000 + F.col("serp_cached") * SERP_COST
    return stats.select(
        F.col("metrics_cached").alias("metrics_api_calls_saved"),
        F.col("serp_cached").alias("serp_api_calls_saved"),
        F.bround(cost, 2).alias("estimated_savings_usd"),
    )


def merge_metrics(keywords: DataFrame, *sources: DataFrame) -> DataFrame:
    """Overwrite volume and difficulty where a source knows the keyword; later sources win over earlier ones.

    Within a source the row with the greatest `sequence` wins, if it has that column; equal rows are told apart by value.
    """
    known = None
    for priority, source in enumerate(sources):
        rows = source.select(
            "keyword",
            F.struct(
                F.lit(priority).alias("p"),
                (F.col("sequence") if "sequence" in source.columns else F.lit(0)).cast("long").alias("sequence"),
                F.col("search_volume"),
                F.col("keyword_difficulty"),
            ).alias("m"),
        )
        known = rows if known is None else known.unionByName(rows)
    best = known.groupBy("keyword").agg(F.max("m").alias("m"))
    return keywords.join(best, "keyword", "left").select(
        *[
            F.when(F.col("m").isNotNull(), F.coalesce(f"m.{c}", F.lit(0))).otherwise(F.col(c)).alias(c)
            if c in ("search_volume", "keyword_difficulty")
            else c
            for c in keywords.columns
        ]
    )


def has_all_metrics(keywords: DataFrame) -> DataFrame:
    """One boolean: there are rows and every one has a positive volume."""
    positive = F.coalesce(F.col("search_volume"), F.lit(0)) > 0
    return keywords.agg(F.coalesce(F.bool_and(positive), F.lit(False)).alias("complete"))


def enrichment_summary(keywords: DataFrame) -> DataFrame:
    return keywords.agg(
        F.coalesce(F.sum("search_volume"), F.lit(0)).alias("total_search_volume"),
        F.coalesce(F.avg(F.coalesce("keyword_difficulty", F.lit(0.0))), F.lit(0.0)).alias("avg_difficulty"),
        F.count("*").alias("keywords"),
    )


def top_by_volume(keywords: DataFrame, n: int = 20) -> DataFrame:
    volume = F.coalesce("search_volume", F.lit(0))
    return keywords.orderBy(F.desc(volume), "row_id").limit(n).select(
        "row_id", "keyword", volume.alias("search_volume"), F.coalesce("keyword_difficulty", F.lit(0.0)).alias("kd")
    )


def request_batches(keywords: DataFrame, size: int) -> DataFrame:
    """(batch, keywords): request payloads of `size` consecutive keywords in row order, whatever the spread of row_id."""
    rows = keywords.select("row_id", "keyword")
    numbered = with_row_index(rows, "row_id", "index", chunk=sparse_chunk(rows, "row_id"))
    batch = F.floor((F.col("index") - 1) / size) + 1
    return (
        numbered.groupBy(batch.alias("batch"))
        .agg(F.array_sort(F.collect_list(F.struct("row_id", "keyword"))).alias("rows"))
        .select("batch", F.col("rows.keyword").alias("keywords"))
    )


def _code(name: Column, codes: dict, default: int | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(default))


def location_code(name: Column) -> Column:
    return _code(name, LOCATIONS, DEFAULT_LOCATION)


def language_code(name: Column) -> Column:
    return _code(name, LANGUAGES, DEFAULT_LANGUAGE)
