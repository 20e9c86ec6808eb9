"""Incremental assignment: new vectors arriving as files are placed on stored centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.assemble import OUTLIER
from termloom.operators.similarity import nearest_centroid


def assign_batch(points: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """(row_id, cluster_id, similarity); -1 below the threshold."""
    found = nearest_centroid(points, centroids)
    return found.select(
        "row_id",
        F.when(F.col("score") >= threshold, F.col("cluster_id")).otherwise(OUTLIER).alias("cluster_id"),
        F.col("score").alias("similarity"),
    )


def stream_assignments(
    points: DataFrame, centroids: DataFrame, threshold: float, output: str, checkpoint: str
) -> StreamingQuery:
    """Start a stream over (row_id, vec) that processes what is available and stops.

    Each micro-batch overwrites its own folder, so a batch replayed after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        assign_batch(batch, centroids, threshold).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        points.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
