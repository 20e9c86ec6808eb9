"""Session builder and the few session-level helpers every job shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def build_session(app: str = "termloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; `conf` entries override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about BATCH_BYTES from now on, unless the session says how large they are.

    A batch is held several times, outside the heap of the executor and in the worker, and the default is set for short rows.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or the checkpoint folder set on the context."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that loops neither recompute nor lose it.

    A written table also carries its true size. A checkpoint keeps the planner's estimate, and estimates of joins
    multiply from round to round.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step.step_path = path
    return step


def drop_steps(*steps: DataFrame) -> None:
    """Delete the folders of steps that `cut_lineage` wrote. Nothing may read them any more, later results included."""
    for step in steps:
        hadoop = step.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(step.step_path)
        hadoop.getFileSystem(step.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


BUCKET_BYTES = 128 << 20
MOST_BUCKETS = 100_000


def store_bucketed(df: DataFrame, key: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write `df` bucketed by `key` into the shared folder and return the table.

    Joins of other tables on `key` then shuffle only the other side. The number of buckets follows the counted bytes, but
    there are enough of them for the cores at hand. `drop_bucketed` removes the table.
    """
    spark = df.sparkSession
    elements = [F.coalesce(F.size(c), F.lit(0)) * 8 for c, kind in df.dtypes if kind.startswith("array")]
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = sum([*elements, *texts], F.lit(8 * len(df.columns))).cast("long")
    counted = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-counted // bucket_bytes)))
    name = f"stored_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.table_name, table.step_path = name, path
    return table


def drop_bucketed(table: DataFrame) -> None:
    """Remove a table of `store_bucketed` from the catalog and its files. Nothing may read it any more."""
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.table_name}")
    drop_steps(table)
