"""Two-dimensional projection of vectors for scatter views."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.assemble import OUTLIER


def project_2d(points: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(row_id, cluster_id, name, x, y) on the two leading principal components.

    The fit only exchanges one dim x dim matrix per task, so it does not depend on the row count.
    """
    features = points.select("row_id", "cluster_id", array_to_vector("vec").alias("features"))
    projected = PCA(k=2, inputCol="features", outputCol="xy").fit(features).transform(features)
    placed = projected.withColumn("xy", vector_to_array("xy"))
    if names is not None:
        placed = placed.join(names.select("cluster_id", "label"), "cluster_id", "left")
    else:
        placed = placed.withColumn("label", F.lit(None).cast("string"))
    name = F.when(F.col("cluster_id") == OUTLIER, "Unclustered").otherwise(
        F.coalesce("label", F.format_string("Cluster %d", "cluster_id"))
    )
    return placed.select(
        "row_id", "cluster_id", name.alias("name"), F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y")
    )
