"""Job state and progress from append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.numbers import ratio

# Phases of a run and the statuses that can be resumed.
PHASES = ["upload", "enrichment", "embedding", "clustering", "serp_validation", "labeling"]
RESUMABLE = ["processing", "paused"]


def _last(name: str, order: str) -> Column:
    """Most recent non-null value."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order)))


def job_states(updates: DataFrame, order: str = "seq") -> DataFrame:
    """Current row per job: each update changes the status and the other fields it carries."""
    fields = ["status", "current_phase", "processed_keywords", "error_message"]
    return updates.groupBy("job_id").agg(*[_last(f, order).alias(f) for f in fields], F.max(order).alias("updated"))


def resumable_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    return jobs.filter(F.col("status").isin(RESUMABLE)).orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def job_statistics(keywords: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per job: clusters, keywords, clustered share, total volume, mean cluster difficulty."""
    k = keywords.groupBy("job_id").agg(
        F.count("*").alias("total_keywords"), F.count_if(F.col("cluster_id") >= 0).alias("clustered_keywords")
    )
    c = clusters.groupBy("job_id").agg(
        F.count("*").alias("total_clusters"),
        F.sum("total_search_volume").alias("total_search_volume"),
        F.avg(F.coalesce("avg_keyword_difficulty", F.lit(0.0))).alias("avg_keyword_difficulty"),
    )
    joined = k.join(c, "job_id", "full").na.fill(0)
    return joined.select(
        "job_id",
        "total_clusters",
        "total_keywords",
        "clustered_keywords",
        (F.col("total_keywords") - F.col("clustered_keywords")).alias("unclustered_keywords"),
        ratio(F.col("clustered_keywords"), F.col("total_keywords")).alias("cluster_rate"),
        "total_search_volume",
        "avg_keyword_difficulty",
    )


def phase_progress(events: DataFrame, as_of: Column) -> DataFrame:
    """Latest state per (job, phase) with elapsed seconds and the estimated rest of running phases.

    `events` has job_id, phase, seq, ts, status and progress; a phase starts at its first event.
    """
    latest = events.groupBy("job_id", "phase").agg(
        F.min("ts").alias("started"),
        F.max_by(F.struct("status", "progress", "ts"), "seq").alias("last"),
    )
    ended = F.col("last.status").isin("completed", "failed")
    until = F.when(ended, F.col("last.ts")).otherwise(as_of)
    elapsed = F.timestamp_diff("MICROSECOND", F.col("started"), until) / 1e6
    rows = latest.select(
        "job_id", "phase", "last.status", "last.progress", elapsed.alias("elapsed_seconds")
    )
    running = (F.col("status") == "running") & (F.col("progress") > 0) & (F.col("elapsed_seconds") > 0)
    rest = F.col("elapsed_seconds") / F.col("progress") - F.col("elapsed_seconds")
    return rows.withColumn("eta_seconds", F.when(running, rest))


def job_progress(phases: DataFrame) -> DataFrame:
    """Overall progress over the six phases (unseen ones count 0), completion and failure per job."""
    known = phases.filter(F.col("phase").isin(PHASES))
    return known.groupBy("job_id").agg(
        (F.sum("progress") / len(PHASES)).alias("overall_progress"),
        (F.count_if(F.col("status") == "completed") == len(PHASES)).alias("is_completed"),
        F.bool_or(F.col("status") == "failed").alias("is_failed"),
    )
