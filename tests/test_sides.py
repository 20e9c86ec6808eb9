"""Blocks whose cells exclude next to nothing: sides that meet pairwise, against brute force and the matrix path."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from termloom.operators import density, metric_cells, similarity
from termloom.session import cut_lineage
from tests.test_clustering import frame


@pytest.fixture
def few_rows_a_side(monkeypatch):
    monkeypatch.setattr(metric_cells, "SIDE_ROWS", 60)


def counted_visits(monkeypatch, module):
    """Visits and rows of every search in cells."""
    seen = []
    original = module.cell_visits

    def counting(rows, cells, own_cell=False):
        visits = original(rows, cells, own_cell)
        seen.append((visits.count(), rows.count()))
        return visits

    monkeypatch.setattr(module, "cell_visits", counting)
    return seen


def test_points_without_structure_are_not_copied_to_every_cell(spark, monkeypatch, few_rows_a_side):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(400, 24))
    points[7] = points[3]
    blocks = np.r_[np.zeros(300), np.ones(100)]
    df = frame(spark, points, coarse_id=blocks)
    seen = counted_visits(monkeypatch, density)
    got = {r.row_id: (r.core_distance, r.nearest) for r in density.reachability(df, min_samples=2, max_block=64).collect()}
    assert all(visits <= metric_cells.VISITS * 400 for visits, _ in seen)
    for block in (0, 1):
        at = np.flatnonzero(blocks == block)
        gaps = np.linalg.norm(points[at][:, None] - points[at][None, :], axis=2)
        np.fill_diagonal(gaps, np.inf)
        core = np.sort(gaps, axis=1)[:, 1]
        mutual = np.maximum(gaps, np.maximum(core[:, None], core[None, :])).min(axis=1)
        for i, row in enumerate(at):
            assert got[row] == (pytest.approx(core[i], abs=1e-7), pytest.approx(mutual[i], abs=1e-7))


def test_labels_without_structure_equal_the_matrix_path(spark, monkeypatch, few_rows_a_side):
    rng = np.random.default_rng(6)
    grid = np.array([[x, y] for x in range(9) for y in range(9)], float)
    points = np.concatenate([rng.normal(size=(150, 20)), np.pad(grid, ((0, 0), (0, 18)))])
    df = frame(spark, points, coarse_id=np.r_[np.zeros(150), np.ones(81)])
    whole = sorted(density.density_labels(df, density.DensitySettings(chunk=2000)).collect())
    seen = counted_visits(monkeypatch, density)
    assert sorted(density.density_labels(df, density.DensitySettings(chunk=64)).collect()) == whole
    assert all(visits <= metric_cells.VISITS * 231 for visits, _ in seen)


@pytest.mark.parametrize("ties", [False, True])
def test_tree_by_sides_is_the_tree_of_all_pairs(spark, ties, few_rows_a_side):
    rng = np.random.default_rng(8)
    points = rng.integers(0, 4, (300, 4)).astype(float) if ties else rng.normal(size=(300, 12))
    points = np.unique(points, axis=0)
    gaps = density._distances(points)
    own = density._core(gaps, np.ones(len(points), int), 2)
    want = density._spanning_tree(np.maximum(gaps, np.maximum(own[:, None], own[None, :])), gaps)
    assert sorted(density._tree_of_points(np.arange(len(points)), points, own)) == want
    rows = [(0, i, [float(x) for x in v], float(c)) for i, (v, c) in enumerate(zip(points, own))]
    core = cut_lineage(spark.createDataFrame(rows, "coarse_id long, row_id long, vec array<double>, core_distance double"))
    edges = density._tree_by_sides(core).select("reach", "gap", "low", "high").collect()
    assert sorted(map(tuple, edges)) == want


def test_pairs_and_nearest_without_structure_meet_by_sides(spark, monkeypatch, few_rows_a_side):
    """No vector is sent to more places than there are sides, and nothing is lost."""
    rng = np.random.default_rng(12)
    cents, rows = rng.normal(size=(400, 10)), rng.normal(size=(150, 10))
    cents[9], cents[70] = cents[5], 0
    monkeypatch.setattr(metric_cells, "VISITS", 2)
    met = []
    original = similarity.meet
    monkeypatch.setattr(similarity, "meet", lambda *a: met.append(a[0].count()) or original(*a))
    centroids = frame(spark, cents).select(F.col("row_id").alias("cluster_id"), F.col("vec").alias("centroid"))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    close = unit(cents) @ unit(cents).T
    pairs = similarity.similar_pairs(centroids, 0.5, budget=4_000).collect()
    assert sorted((r.id_a, r.id_b) for r in pairs) == list(zip(*np.nonzero(np.triu(close >= 0.5, 1))))
    assert all(abs(close[r.id_a, r.id_b] - r.similarity) < 1e-9 for r in pairs)
    got = {r.row_id: r.cluster_id for r in similarity.nearest_centroid(frame(spark, rows), centroids, budget=4_000).collect()}
    assert got == {i: int(np.argmax(s)) for i, s in enumerate(np.round(unit(rows) @ unit(cents).T, 12))}
    assert not met
