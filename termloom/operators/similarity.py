"""Nearest-centroid search and thresholded similarity pairs as distributed block products.

A side is broadcast only when its counted size fits the budget. Beyond it vectors are dealt to metric cells
(metric_cells) and matched only with cells that the triangle inequality leaves open; each task emits one best match
per row, or only the pairs that reach the threshold. On vectors without structure few cells are left out; then sides of the
vectors meet pairwise, and a vector is sent to each side once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.vectors import norm, unit
from termloom.operators.metric_cells import (
    SIDE_CELLS, against_pivots, crowded, deal_cells, describe_cells, gaps_between, matrix_of, meet, meet_sides, pair_sides,
)
from termloom.session import BROADCAST_BYTES, cut_lineage

BLOCK_BYTES = 32 << 20
SCORE_CELLS = 1 << 22
TIE_DECIMALS = 12
# Distances of nearly equal vectors are off by less than this.
REACH_SLACK = 1e-6


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best_matches(rows: np.ndarray, ids: np.ndarray, centroids: np.ndarray, metric: str):
    """Best centroid id and score per row; `ids` ascend, so ties go to the lowest id."""
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    best = np.empty(len(rows), dtype=np.int64)
    score = np.empty(len(rows))
    target = _unit_rows(centroids) if metric == "cosine" else centroids
    for start in range(0, len(rows), step):
        part = rows[start : start + step]
        if metric == "cosine":
            scores = _unit_rows(part) @ target.T
            pick = scores.argmax(axis=1)
            value = scores[np.arange(len(part)), pick]
        else:
            pick = ((target**2).sum(axis=1) - 2 * part @ target.T).argmin(axis=1)
            value = np.linalg.norm(part - target[pick], axis=1)
        best[start : start + step] = ids[pick]
        score[start : start + step] = value
    return best, score


def _shape(df: DataFrame, vec_col: str) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    return row["n"], row["d"] or 0


def nearest_centroid(
    points: DataFrame,
    centroids: DataFrame,
    id_col: str = "row_id",
    metric: str = "cosine",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, cluster_id, score) of the closest centroid: highest cosine or lowest euclidean distance."""
    n, dim = _shape(centroids, "centroid")
    schema = f"{id_col} long, cluster_id long, score double"
    points = points.select(F.col(id_col).cast("long").alias(id_col), "vec")
    if n == 0:
        return points.select(id_col, F.lit(0).cast("long").alias("cluster_id"), F.lit(0.0).alias("score")).limit(0)
    if n * dim * 8 > budget:
        return _nearest_in_cells(points, centroids, id_col, metric, n, dim, schema, budget)

    listed = centroids.orderBy("cluster_id").select("cluster_id", "centroid").toPandas()
    side = points.sparkSession.sparkContext.broadcast(
        (listed["cluster_id"].to_numpy(dtype=np.int64), _matrix(listed["centroid"]))
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = side.value
        for batch in batches:
            if len(batch):
                best, value = _best_matches(_matrix(batch["vec"]), ids, matrix, metric)
                yield pd.DataFrame({id_col: batch[id_col], "cluster_id": best, "score": value})

    return points.mapInPandas(score, schema)


def _unit_points(df: DataFrame, id_col: str, vec_col: str, scaled: bool = True) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    return df.select(
        F.lit(0).cast("long").alias("coarse_id"),
        F.col(id_col).cast("long").alias("row_id"),
        (unit(vec) if scaled else vec).alias("vec"),
    )


def _in_cells(points: DataFrame, n: int, dim: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Points with their cells and the cells' facts. Cells hold about sqrt(n) points, and no part exceeds the block budget."""
    per_cell = max(1, min(math.isqrt(n) + 1, min(BLOCK_BYTES, budget) // max(1, 2 * dim * 8)))
    points = cut_lineage(points)
    placed = cut_lineage(points.join(deal_cells(points, per_cell), "row_id"))
    return placed, cut_lineage(describe_cells(placed))


def _nearest_in_cells(points, centroids, id_col, metric, n, dim, schema, budget) -> DataFrame:
    """A point is compared only with the cells of centroids that can hold one nearer than the nearest pivot."""
    cosine = metric == "cosine"
    targets = cut_lineage(_unit_points(centroids, "cluster_id", "centroid", cosine))
    rows = cut_lineage(_unit_points(points, id_col, "vec", cosine))
    zero = None
    if cosine:  # the angle to a zero vector is not a distance, but its cosine is always 0
        empty = norm(F.col("vec")) == 0
        zero = targets.filter(empty).agg(F.min("row_id")).first()[0]
        targets = targets.filter(~empty)
    placed, cells = _in_cells(targets, n, dim, budget)

    def open_cells(block: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        gaps = gaps_between(matrix_of(block["vec"]), matrix_of(centres["pivot_"]))
        least = gaps - centres["radius_"].to_numpy()[None, :]
        row, cell = np.nonzero(least <= gaps.min(axis=1)[:, None] + REACH_SLACK)
        return pd.DataFrame(
            {"row_id": block["row_id"].to_numpy()[row], "cell": centres["cell_"].to_numpy()[cell], "part": centres["part_"].to_numpy()[cell]}
        )

    def best_member(block: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("row_id_")
        best, value = _best_matches(matrix_of(block["vec"]), members["row_id_"].to_numpy(), matrix_of(members["vec_"]), metric)
        return pd.DataFrame({id_col: block["row_id"], "cluster_id": best, "score": value})

    if crowded(rows, cells, open_cells).isEmpty():
        visits = against_pivots(rows, cells, open_cells, "row_id long, cell long, part long")
        scored = meet(visits, rows, placed, best_member, schema, ["vec"])
    else:
        scored = meet_sides(rows, placed, best_member, schema, ["vec"])
    if zero is not None:
        scored = scored.unionByName(
            rows.select(F.col("row_id").alias(id_col), F.lit(zero).alias("cluster_id"), F.lit(0.0).alias("score"))
        )
    order = F.round("score", TIE_DECIMALS) if cosine else -F.round("score", TIE_DECIMALS)
    best = F.max_by(F.struct("cluster_id", "score"), F.struct(order, -F.col("cluster_id")))
    return scored.groupBy(id_col).agg(best.alias("best")).select(id_col, "best.*")


def similar_pairs(vectors: DataFrame, threshold: float, budget: int = BROADCAST_BYTES) -> DataFrame:
    """(id_a, id_b, similarity) for all id_a < id_b whose cosine reaches `threshold`.

    `vectors` has cluster_id and centroid. Past the broadcast budget, vectors are dealt to metric cells whose number
    follows n, and a vector is compared only with the cells that can hold one similar enough.
    """
    n, dim = _shape(vectors, "centroid")
    vectors = vectors.select(F.col("cluster_id").cast("long").alias("cluster_id"), "centroid")
    schema = "id_a long, id_b long, similarity double"
    if n * dim * 8 > budget:
        return _pairs_in_cells(vectors, threshold, n, dim, schema, budget)
    if n == 0:
        return vectors.sparkSession.createDataFrame([], schema)

    listed = vectors.orderBy("cluster_id").toPandas()
    side = vectors.sparkSession.sparkContext.broadcast(
        (listed["cluster_id"].to_numpy(dtype=np.int64), _unit_rows(_matrix(listed["centroid"])))
    )

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = side.value
        step = max(1, SCORE_CELLS // len(ids))
        for batch in batches:
            own = batch["cluster_id"].to_numpy()
            rows = _unit_rows(_matrix(batch["centroid"])) if len(batch) else np.empty((0, matrix.shape[1]))
            for start in range(0, len(own), step):
                scores = rows[start : start + step] @ matrix.T
                a, b = np.nonzero((scores >= threshold) & (own[start : start + step, None] < ids[None, :]))
                yield pd.DataFrame({"id_a": own[start + a], "id_b": ids[b], "similarity": scores[a, b]})

    return vectors.repartition("cluster_id").mapInPandas(match, schema)


def _pairs_in_cells(vectors: DataFrame, threshold: float, n: int, dim: int, schema: str, budget: int) -> DataFrame:
    """Unit vectors reach the threshold when they are at most sqrt(2 - 2 threshold) apart, so a vector visits the cells whose
    radius lets a member be that near. Of two parts only the members of the earlier one visit."""
    placed, cells = _in_cells(_unit_points(vectors, "cluster_id", "centroid"), n, dim, budget)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + REACH_SLACK

    def open_cells(block: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        gaps = gaps_between(matrix_of(block["vec"]), matrix_of(centres["pivot_"]))
        cell, part = block["cell"].to_numpy()[:, None], block["part"].to_numpy()[:, None]
        other, other_part = centres["cell_"].to_numpy()[None, :], centres["part_"].to_numpy()[None, :]
        later = (cell < other) | ((cell == other) & (part <= other_part))
        row, at = np.nonzero((gaps - centres["radius_"].to_numpy()[None, :] <= reach) & later)
        return pd.DataFrame(
            {"row_id": block["row_id"].to_numpy()[row], "cell": other[0][at], "part": other_part[0][at]}
        )

    def match(block: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        a_ids, b_ids = block["row_id"].to_numpy(), members["row_id_"].to_numpy()
        scores = matrix_of(block["vec"]) @ matrix_of(members["vec_"]).T
        keep = scores >= threshold
        own = (block["own_cell"].to_numpy() == members["cell_"].iloc[0]) & (block["own_part"].to_numpy() == members["part_"].iloc[0])
        keep &= ~own[:, None] | (a_ids[:, None] < b_ids[None, :])
        i, j = np.nonzero(keep)
        low, high = np.minimum(a_ids[i], b_ids[j]), np.maximum(a_ids[i], b_ids[j])
        return pd.DataFrame({"id_a": low, "id_b": high, "similarity": scores[i, j]})

    def match_sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        ids, matrix, side = rows["row_id"].to_numpy(), matrix_of(rows["vec"]), rows["side"].to_numpy()
        first = rows["one"].iloc[0]
        alone = first == rows["two"].iloc[0]
        one, two = (side == first).nonzero()[0], (alone | (side != first)).nonzero()[0]
        others = matrix[two]
        step = max(1, SIDE_CELLS // max(1, len(two)))
        for start in range(0, len(one), step):
            at = one[start : start + step]
            keep = matrix[at] @ others.T
            i, j = np.nonzero(keep >= threshold)
            a, b, value = ids[at[i]], ids[two[j]], keep[i, j]
            if alone:
                once = a < b
                a, b, value = a[once], b[once], value[once]
            if len(a):
                yield pd.DataFrame({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b), "similarity": value})

    if not crowded(placed, cells, open_cells).isEmpty():
        return pair_sides(placed, match_sides, schema, ["vec"], itself=True)
    visits = against_pivots(placed, cells, open_cells, "row_id long, cell long, part long")
    visitors = placed.withColumnsRenamed({"cell": "own_cell", "part": "own_part"})
    members = placed.withColumns({"own_cell": F.col("cell"), "own_part": F.col("part")})
    return meet(visits, visitors, members, match, schema, ["vec", "own_cell", "own_part"])
