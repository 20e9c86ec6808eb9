"""Dense vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is all zeros."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def mean_vectors(df: DataFrame, keys: list[str], vec_col: str, name: str = "centroid") -> DataFrame:
    """Mean vector and row count per key: one dense buffer per group, merged map-side before the shuffle."""
    return (
        df.groupBy(*keys)
        .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_mean"), F.count("*").alias("size"))
        .select(*keys, "size", vector_to_array("_mean").alias(name))
    )
