"""Persistent job tables as parquet folders partitioned by job."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.vectors import cosine
from termloom.operators.sizing import broadcast_if_small

SCHEMAS = {
    "keywords": "row_id bigint, keyword string, search_volume bigint, keyword_difficulty double, cpc double, "
    "cluster_id bigint, version bigint, job_id string",
    "vectors": "keyword string, embedding array<float>, version bigint, job_id string",
    "clusters": "cluster_id bigint, label string, intent string, centroid_keyword string, keyword_count bigint, "
    "total_search_volume bigint, avg_keyword_difficulty double, serp_validation_score double, quality_score double, "
    "parent_cluster_id bigint, version bigint, job_id string",
    "jobs": "job_id string, status string, current_phase string, total_keywords bigint, processed_keywords bigint, "
    "error_message string, created_at timestamp_ntz, version bigint",
    "deleted": "job_id string, version bigint",
    "commits": "table_name string, job_id string, replaces boolean, version bigint",
}
BY_JOB = ("keywords", "vectors", "clusters")


class JobTables:
    """Reads and writes of the job tables below one root folder.

    Vectors live in their own table so that keyword scans never read them. Every write has a version, the time of
    the write, and its rows count only once the version is listed in `commits`, so a write that fails half-way is never
    seen. An update writes the job's rows anew; its commit hides all older versions of them. Deleting a job appends its id
    and a version to a list; reads leave out the job's rows up to that version, so a job inserted again is visible.
    `compact` rewrites a table without the rows that reads leave out.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, name: str, df: DataFrame) -> None:
        self._write(name, df.withColumn("version", F.lit(time.time_ns())))

    def _write(self, name: str, df: DataFrame) -> None:
        columns = [c.strip().rsplit(" ", 1)[0] for c in SCHEMAS[name].split(", ")]
        shaped = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
        shaped = self.spark.createDataFrame([], SCHEMAS[name]).unionByName(shaped)
        writer = shaped.write.mode("append")
        (writer.partitionBy("job_id") if name in BY_JOB else writer).parquet(f"{self.root}/{name}")

    def _write_job(self, name: str, job_id: str, df: DataFrame, replaces: bool = False) -> None:
        """Write rows of a job and then list their version; the list grows by one small file."""
        version = time.time_ns()
        self._write(name, df.withColumns({"job_id": F.lit(job_id), "version": F.lit(version)}))
        listed = [(name, job_id, replaces, version)]
        self._write("commits", self.spark.createDataFrame(listed, SCHEMAS["commits"]).coalesce(1))

    def read(self, name: str) -> DataFrame:
        """All live rows of a table."""
        return self._live(name).drop("version")

    def _live(self, name: str) -> DataFrame:
        rows = self._stored(name)
        if name in BY_JOB:
            listed = self._stored("commits").filter(F.col("table_name") == name)
            last = listed.groupBy("job_id").agg(F.max(F.when(F.col("replaces"), F.col("version"))).alias("last"))
            shown = listed.join(last, "job_id").filter("last is null or version >= last")
            rows = rows.join(broadcast_if_small(shown.select("job_id", "version")), ["job_id", "version"], "left_semi")
        if name in ("deleted", "commits"):
            return rows
        gone = self._stored("deleted").groupBy("job_id").agg(F.max("version").alias("gone"))
        gone = broadcast_if_small(gone)
        return rows.join(gone, (rows["job_id"] == gone["job_id"]) & (rows["version"] <= gone["gone"]), "left_anti")

    def _stored(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def add_job(self, job: DataFrame) -> None:
        self._append("jobs", job)

    def insert_keywords(self, job_id: str, keywords: DataFrame) -> None:
        self._write_job("keywords", job_id, keywords)

    def save_vectors(self, job_id: str, vectors: DataFrame) -> None:
        """(text, vec) rows of a job."""
        rows = vectors.select(F.col("text").alias("keyword"), F.col("vec").alias("embedding"))
        self._write_job("vectors", job_id, rows)

    def save_clusters(self, job_id: str, clusters: DataFrame) -> None:
        self._write_job("clusters", job_id, clusters)

    def update_keywords(self, job_id: str, changes: DataFrame, sequence: str | None = None) -> None:
        """Set the columns of `changes` (keyword, ...) on matching keywords of a job; unmatched changes are ignored.

        Of several changes to one keyword the last by the column `sequence` counts, else the one with the greatest values.
        """
        fields = [c for c in changes.columns if c not in ("keyword", sequence)]
        last = F.max(F.struct(*([sequence] if sequence else []), *fields)).alias("_last")
        new = changes.groupBy("keyword").agg(last)
        new = new.select("keyword", *[F.col(f"_last.{c}").alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
        old = self._live("keywords").filter(F.col("job_id") == job_id)

        def value(c: str) -> Column:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)

        changed = old.join(new, "keyword", "left").select(*[value(c) for c in old.columns])
        self._write_job("keywords", job_id, changed, replaces=True)

    def delete_job(self, job_id: str) -> None:
        self._append("deleted", self.spark.createDataFrame([(job_id,)], "job_id string"))

    def compact(self, name: str, target: str) -> None:
        """Write the live rows of a table to a new root, one folder per job, and list their versions there."""
        new = JobTables(self.spark, target)
        new._write(name, self._live(name))
        if name in BY_JOB:
            kept = new._stored(name).select("job_id", "version").distinct()
            new._write("commits", kept.select(F.lit(name).alias("table_name"), "job_id", F.lit(False).alias("replaces"), "version"))

    def keywords(self, job_id: str, with_embeddings: bool = False, limit: int | None = None) -> DataFrame:
        rows = self.read("keywords").filter(F.col("job_id") == job_id)
        if limit:
            rows = rows.orderBy("row_id").limit(limit)
        columns = ["keyword", "search_volume", "keyword_difficulty", "cluster_id"]
        if not with_embeddings:
            return rows.select(*columns)
        vectors = self.read("vectors").filter(F.col("job_id") == job_id).select("keyword", "embedding")
        return rows.select(*columns).join(vectors, "keyword", "left")

    def clusters(self, job_id: str) -> DataFrame:
        rows = self.read("clusters").filter(F.col("job_id") == job_id)
        return rows.orderBy(F.desc("total_search_volume"), "cluster_id")

    def cluster_keywords(self, job_id: str, cluster_id: int) -> DataFrame:
        rows = self.read("keywords").filter((F.col("job_id") == job_id) & (F.col("cluster_id") == cluster_id))
        return rows.orderBy(F.desc("search_volume"), "row_id").select("keyword", "search_volume", "keyword_difficulty")

    def job(self, job_id: str) -> DataFrame:
        return self.read("jobs").filter(F.col("job_id") == job_id)


def centroid_keywords(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, centroid_keyword): the member most similar to its centroid, ties to the earliest row."""
    own = points.join(centroids.select("cluster_id", "centroid"), "cluster_id")
    closeness = F.struct(cosine(F.col("vec"), F.col("centroid")), -F.col("row_id"))
    return own.groupBy("cluster_id").agg(F.max_by("keyword", closeness).alias("centroid_keyword"))
