"""From an upload to a stored job: clean, look metrics up in the cache, merge fetched ones, vectors through their cache, run, store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import enrich
from termloom.operators.embed import Provider, embed_missing, hashed_ngrams
from termloom.operators.merge import cluster_centroids
from termloom.plans.keyword_run import RunResult, RunSettings, clean, run
from termloom.sources.delimited import project_roles, read_delimited
from termloom.sources.responses import parse_labels, parse_metrics, parse_serps
from termloom.sources.tables import JobTables, centroid_keywords
from termloom.session import cut_lineage

METRIC_COLUMNS = ["search_volume", "keyword_difficulty", "cpc", "competition"]


@dataclass(frozen=True)
class Services:
    """What the services around a job know. Tables that are None are empty.

    `metrics_log` (keyword, METRIC_COLUMNS, fetched_at) and `serp_log` (keyword, urls, fetched_at) are append-only caches;
    `metric_responses` (response_id, response), `serp_responses` (keyword, response) and `label_responses` (response_id,
    response) are raw answers as they were received.
    """

    metrics_log: DataFrame | None = None
    serp_log: DataFrame | None = None
    metric_responses: DataFrame | None = None
    serp_responses: DataFrame | None = None
    label_responses: DataFrame | None = None


@dataclass(frozen=True)
class JobSettings:
    run: RunSettings = field(default_factory=RunSettings)
    metrics_ttl: str = enrich.METRICS_TTL
    serp_ttl: str = enrich.SERP_TTL
    request_size: int = 1000


@dataclass(frozen=True)
class Enriched:
    """Keywords with merged metrics, the requests for those the cache lacks, and the entries the cache should gain."""

    keywords: DataFrame
    requests: DataFrame
    new_entries: DataFrame
    stats: DataFrame


def enrich_keywords(keywords: DataFrame, services: Services, as_of: Column, settings: JobSettings = JobSettings()) -> Enriched:
    """Fresh cache entries and fetched metrics merged into `keywords` (row_id, keyword, search_volume, keyword_difficulty, ...).

    Where every keyword has a volume already nothing is looked up. Fetched values win over cached ones, both over the upload.
    `requests` holds what the cache lacks; answers to other keywords are ignored.
    """
    spark = keywords.sparkSession
    entry = "keyword string, search_volume long, keyword_difficulty double, cpc double, competition double"
    nothing = spark.createDataFrame([], entry)
    complete = enrich.has_all_metrics(keywords).first()[0]
    log = services.metrics_log if services.metrics_log is not None and not complete else nothing.withColumn("fetched_at", as_of)
    fresh = cut_lineage(enrich.fresh_entries(log, as_of, settings.metrics_ttl).select("keyword", *METRIC_COLUMNS))
    hits = enrich.cached(keywords, fresh)
    missing = keywords.limit(0) if complete else enrich.uncached(keywords, fresh)
    missing = cut_lineage(missing.select("row_id", "keyword"))
    fetched = nothing
    if services.metric_responses is not None:
        answered = parse_metrics(services.metric_responses).select("keyword", *METRIC_COLUMNS)
        fetched = cut_lineage(answered.join(missing.select("keyword"), "keyword", "left_semi"))
    merged = cut_lineage(enrich.merge_metrics(keywords, hits, fetched))
    counts = [
        merged.agg(F.count("*").alias("total_keywords")),
        hits.agg(F.count("*").alias("from_cache")),
        fetched.agg(F.count("*").alias("fetched")),
        missing.join(fetched.select("keyword"), "keyword", "left_anti").agg(F.count("*").alias("without_answer")),
    ]
    stats = counts[0]
    for one in counts[1:]:
        stats = stats.join(one)  # single rows
    requests = enrich.request_batches(missing, settings.request_size)
    return Enriched(merged, requests, fetched.withColumn("fetched_at", as_of), stats)


def known_serps(keywords: DataFrame, services: Services, as_of: Column, settings: JobSettings = JobSettings()) -> DataFrame | None:
    """(keyword, urls) of the asked keywords: received responses, else fresh cache entries; None without any source."""
    found = None
    if services.serp_responses is not None:
        found = parse_serps(services.serp_responses).select("keyword", "urls", F.lit(1).alias("source"))
    if services.serp_log is not None:
        fresh = enrich.fresh_entries(services.serp_log, as_of, settings.serp_ttl).select("keyword", "urls", F.lit(0).alias("source"))
        found = fresh if found is None else found.unionByName(fresh)
    if found is None:
        return None
    best = found.groupBy("keyword").agg(F.max_by("urls", "source").alias("urls"))
    return cut_lineage(enrich.cached(keywords, best))


def through_cache(path: str, provider: Provider) -> Provider:
    """A provider that vectorises only texts the cache at `path` lacks."""

    def embed(texts: DataFrame) -> DataFrame:
        return embed_missing(texts, path, provider, "text").join(texts.select("text").distinct(), "text", "left_semi")

    return embed


def run_job(
    spark: SparkSession,
    upload: str,
    tables: JobTables,
    job_id: str,
    as_of: Column,
    vector_cache: str,
    services: Services = Services(),
    settings: JobSettings = JobSettings(),
    provider: Provider | None = None,
) -> tuple[Enriched, RunResult]:
    """Run the delimited files at `upload` as job `job_id` and store its keywords, vectors, clusters and state in `tables`."""
    created = spark.range(1).select(F.lit(job_id).alias("job_id"), as_of.cast("timestamp_ntz").alias("created_at"))
    tables.add_job(created.withColumns({"status": F.lit("processing"), "current_phase": F.lit("enrichment")}))
    keywords = cut_lineage(clean(project_roles(read_delimited(spark, upload)), settings.run.rules))
    enriched = enrich_keywords(keywords, services, as_of, settings)
    cached_provider = through_cache(vector_cache, provider or hashed_ngrams())
    model_labels = parse_labels(services.label_responses).select("cluster_id", "label") if services.label_responses is not None else None
    serps = known_serps(enriched.keywords, services, as_of, settings)
    result = run(enriched.keywords, settings.run, cached_provider, serps, model_labels)

    members = result.members
    texts = members.select(F.col("keyword").alias("text")).distinct()
    vectors = cut_lineage(cached_provider(texts))
    points = members.join(vectors.withColumnRenamed("text", "keyword"), "keyword").withColumn("vec", F.col("vec").cast("array<double>"))
    centre = centroid_keywords(points.filter("cluster_id >= 0"), cluster_centroids(points))
    clusters = result.report.select(
        F.col("id").cast("long").alias("cluster_id"),
        "label",
        "intent",
        F.col("size").cast("long").alias("keyword_count"),
        F.col("total_volume").cast("long").alias("total_search_volume"),
        F.col("avg_difficulty").alias("avg_keyword_difficulty"),
        "quality_score",
    )
    if result.validations is not None:
        scores = result.validations.select("cluster_id", F.col("average_overlap").alias("serp_validation_score"))
        clusters = clusters.join(scores, "cluster_id", "left")
    tables.insert_keywords(job_id, members)
    tables.save_vectors(job_id, vectors)
    tables.save_clusters(job_id, clusters.join(centre, "cluster_id", "left"))
    done = members.agg(F.count("*").alias("total_keywords"), F.count("*").alias("processed_keywords")).join(created)
    tables.add_job(done.withColumns({"status": F.lit("completed"), "current_phase": F.lit("labeling")}))
    return enriched, result
