"""Text vectors: pluggable providers, a vector cache and alignment with keywords.

A provider maps a DataFrame with a `text` column to (text, vec ARRAY<FLOAT>).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from termloom.functions.text import canonical

Provider = Callable[[DataFrame], DataFrame]

BATCH_SIZE = 100


# Bytes of text that a task turns into hashes at once.
SLICE_BYTES = 1 << 20
HASH_SEED = 42


def _murmur3(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """MurmurHash3 (32 bits, signed) of byte ranges of `data`, which has four bytes to spare; the hash that HashingTF takes."""

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))

    def mixed(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    wide = data.astype(np.uint32)
    words = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    h = np.full(len(starts), HASH_SEED, np.uint32)
    for done in range(0, int(lengths.max(initial=0)) - 3, 4):
        at = np.flatnonzero(lengths >= done + 4)
        h[at] = turned(h[at] ^ mixed(words[starts[at] + done]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    left = lengths & 3
    masks = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)
    h ^= mixed(words[starts + lengths - left] & masks[left])
    h ^= lengths.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _gram_counts(texts: list[bytes], dim: int, gram: int) -> np.ndarray:
    """Rows of `dim` counts: how many runs of `gram` characters of a text have each hash. A shorter text is its only run."""
    data = np.frombuffer(b"".join(texts) + bytes(4), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = np.flatnonzero((data[: ends[-1]] & 0xC0) != 0x80)  # places of characters
    places = np.append(begins, ends[-1])
    last = np.searchsorted(begins, ends)
    first = np.append(0, last[:-1])
    runs = np.maximum(last - first - gram + 1, 1)
    owner = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(len(owner)) + np.repeat(first - np.append(0, np.cumsum(runs)[:-1]), runs)
    starts = places[at]
    lengths = places[np.minimum(at + gram, last[owner])] - starts
    slots = owner * dim + _murmur3(data, starts, lengths) % dim
    return np.bincount(slots, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)


def _counted(dim: int, gram: int) -> Callable:
    """Column function: counts of the hashed character n-grams of a text; a null counts as one term with the seed for a hash."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def counts(texts: pd.Series) -> pd.Series:
        found, waiting, size = [], [], 0
        for text in texts:
            if text is not None:
                waiting.append(text.encode())
                size += len(waiting[-1])
            if waiting and (text is None or size >= SLICE_BYTES):
                found.extend(_gram_counts(waiting, dim, gram))
                waiting, size = [], 0
            if text is None:
                found.append(np.bincount([HASH_SEED % dim], minlength=dim).astype(float))
        return pd.Series(found + (list(_gram_counts(waiting, dim, gram)) if waiting else []), dtype=object)

    return counts


def hashed_ngrams(dim: int = 256, gram: int = 3, weigh_by: DataFrame | None = None) -> Provider:
    """Unit-length hashed character n-gram vectors, idf-weighted over the texts of `weigh_by` when given.

    Counts are those of HashingTF over the n-grams of a text, taken on arrays of bytes.
    """

    def hashed(texts: DataFrame) -> DataFrame:
        padded = F.concat(F.lit(" "), canonical(F.col("text")), F.lit(" "))
        return texts.withColumn("tf", array_to_vector(_counted(dim, gram)(padded)))

    idf = None
    if weigh_by is not None:
        idf = IDF(inputCol="tf", outputCol="weighted").fit(hashed(weigh_by))

    def embed(texts: DataFrame) -> DataFrame:
        counted = hashed(texts.select("text"))
        weighted = idf.transform(counted) if idf else counted.withColumn("weighted", F.col("tf"))
        scaled = Normalizer(inputCol="weighted", outputCol="scaled").transform(weighted)
        return scaled.select("text", vector_to_array("scaled", "float32").alias("vec"))

    return embed


def batch_model(make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = BATCH_SIZE) -> Provider:
    """Vectors from a model loaded once per worker and called on batches of at most `batch_size` texts."""

    def loaded() -> Callable[[np.ndarray], np.ndarray]:
        predict = make_predict()

        def checked(batch: np.ndarray) -> np.ndarray:
            if len(batch) > batch_size:
                raise ValueError(f"batch of {len(batch)} texts exceeds {batch_size}")
            return predict(batch)

        return checked

    vector = predict_batch_udf(loaded, return_type=ArrayType(FloatType()), batch_size=batch_size)

    def embed(texts: DataFrame) -> DataFrame:
        return texts.select("text", vector("text").alias("vec"))

    return embed


def embed_texts(df: DataFrame, provider: Provider, text_col: str = "keyword") -> DataFrame:
    """(text, vec) once per distinct text."""
    return provider(df.select(F.col(text_col).alias("text")).filter("text is not null").distinct())


def embed_missing(df: DataFrame, cache_path: str, provider: Provider, text_col: str = "keyword") -> DataFrame:
    """Vectorise only texts the parquet cache lacks, append them, and return the whole cache.

    A rerun after a failure continues from the texts already stored.
    """
    spark = df.sparkSession
    texts = df.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    schema = "text string, vec array<float>"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path).select("text")
    provider(texts.join(known, "text", "left_anti")).write.mode("append").parquet(cache_path)
    return spark.read.schema(schema).parquet(cache_path)


def align_vectors(keywords: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every keyword row with the vector of its text; a keyword without one is kept with NULL."""
    return keywords.join(vectors.withColumnRenamed("text", "keyword"), "keyword", "left")
