"""The distributed density path: cells, spanning tree and leaf clusters against one matrix and a hierarchy in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom.operators import density, metric_cells
from termloom.operators.density_tree import leaf_labels
from termloom.session import cut_lineage
from tests.test_clustering import frame


def random_tree(rng, n, shape):
    """Edges of a tree of n points; chains and stars with rising or repeated weights are the hard shapes."""
    if shape == "chain":
        ends = [(i, i + 1) for i in range(n - 1)]
    elif shape == "star":
        ends = [(0, i) for i in range(1, n)]
    else:
        ends = [(int(rng.integers(0, i)), i) for i in range(1, n)]
    weights = np.sort(rng.random(n - 1)) if shape == "chain" else rng.integers(0, 6, n - 1) / 4 if shape == "tied" else rng.random(n - 1)
    return [(float(w), float(rng.integers(0, 3)), a, b) for w, (a, b) in zip(weights, ends)]


@pytest.mark.parametrize("min_size", [2, 3, 7])
def test_leaf_clusters_equal_the_hierarchy_in_memory(spark, min_size):
    rng = np.random.default_rng(min_size)
    points, edges, want = [], [], {}
    for block in range(40):
        shape = ("random", "chain", "star", "tied")[block % 4]
        n = int(rng.integers(2, 60)) if block else 300
        tree = sorted(random_tree(rng, n, shape))
        weights = rng.choice([1, 1, 1, 2, 8], n)
        weights[0] += max(0, min_size - weights.sum())
        least = np.full(n, np.inf)
        for w, _, a, b in tree:
            least[[a, b]] = np.minimum(least[[a, b]], w)
        core = np.where(rng.random(n) < 0.2, 0.0, least * rng.random(n))
        ids = 1000 * block + np.arange(n)
        block_rows = pd.DataFrame({"coarse_id": block, "row_id": ids, "weight": weights})
        expected = density._block_labels(block_rows, tree, core, min_size)
        want |= {int(r.row_id): (block, int(r.local_id), round(float(r.probability), 12)) for r in expected.itertuples()}
        points += [(block, int(i), int(w), float(c)) for i, w, c in zip(ids, weights, core)]
        edges += [(w, g, 1000 * block + a, 1000 * block + b) for w, g, a, b in tree]
    got = leaf_labels(
        spark.createDataFrame(points, "coarse_id long, row_id long, weight long, core_distance double"),
        cut_lineage(spark.createDataFrame(edges, "reach double, gap double, low long, high long")),
        min_size,
    )
    assert {r.row_id: (r.block_id, r.local_id, round(r.probability, 12)) for r in got.collect()} == want
    assert len({v[:2] for v in want.values() if v[1] >= 0}) > 20


def many_blobs(groups, size, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + rng.normal(0, 0.2, (size, dims)) for c in rng.normal(0, 12, (groups, dims))])


def test_a_point_is_copied_only_to_cells_that_can_hold_a_neighbour(spark, monkeypatch):
    """On blobs the visits are few; what is found is what a matrix of all pairs gives."""
    points = many_blobs(40, 30)
    counted = []
    original = density.cell_visits

    def counting(rows, cells, own_cell=False):
        visits = original(rows, cells, own_cell)
        counted.append((visits.count(), rows.count(), cells.count()))
        return visits

    monkeypatch.setattr(density, "cell_visits", counting)
    df = frame(spark, points, coarse_id=np.zeros(len(points)))
    got = {r["row_id"]: (r["core_distance"], r["nearest"]) for r in density.reachability(df, min_samples=3, max_block=160).collect()}
    gaps = np.linalg.norm(points[:, None] - points[None, :], axis=2)
    np.fill_diagonal(gaps, np.inf)
    core = np.sort(gaps, axis=1)[:, 2]
    mutual = np.maximum(gaps, np.maximum(core[:, None], core[None, :])).min(axis=1)
    for i in range(len(points)):
        assert got[i] == (pytest.approx(core[i], abs=1e-7), pytest.approx(mutual[i], abs=1e-7))
    for visits, rows, cells in counted:
        assert cells > 40 and visits < 0.25 * rows * cells


def test_the_spanning_tree_visits_few_cells_and_is_the_tree_of_all_pairs(spark, monkeypatch):
    points = many_blobs(30, 25)
    visited = []
    original = density.cell_visits

    def counting(rows, cells, own_cell=False):
        visits = original(rows, cells, own_cell)
        visited.append((visits.count(), rows.count() * cells.count()))
        return visits

    df = frame(spark, points, coarse_id=np.zeros(len(points)))
    core = cut_lineage(density._with_core(cut_lineage(density.weighted_points(df)), 2, 120))
    monkeypatch.setattr(density, "cell_visits", counting)
    edges = density._tree_edges(core).select("low", "high").collect()
    gaps = density._distances(points)
    own = density._core(gaps, np.ones(len(points), int), 2)
    want = density._spanning_tree(np.maximum(gaps, np.maximum(own[:, None], own[None, :])), gaps)
    assert {(r.low, r.high) for r in edges} == {e[2:] for e in want}
    assert sum(v for v, _ in visited) < 0.25 * len(visited) * visited[0][1]


def test_one_block_of_equal_distances_and_a_single_point(spark):
    """A grid has only ties; a block of one distinct point has no tree."""
    grid = np.array([[x, y] for x in range(9) for y in range(9)], float)
    points = np.concatenate([grid, np.full((5, 2), 70.0)])
    blocks = np.concatenate([np.zeros(81), np.ones(5)])
    df = frame(spark, points, coarse_id=blocks)
    whole = density.density_labels(df, density.DensitySettings(chunk=2000)).collect()
    cut = density.density_labels(df, density.DensitySettings(chunk=16)).collect()
    assert sorted(cut) == sorted(whole) and len(cut) == 86


def test_cells_hold_all_rows_once(spark):
    df = frame(spark, np.concatenate([many_blobs(5, 40), np.zeros((3, 6))]), coarse_id=np.arange(203) % 2)
    dealt = metric_cells.deal_cells(df, 10)
    assert dealt.count() == dealt.select("row_id").distinct().count() == 203
    largest = dealt.groupBy("cell", "part").count().agg(F.max("count")).first()[0]
    assert largest <= 60
