"""Trees and nearest rows of large sides: picked in single precision, exact all the same."""

import numpy as np
import pandas as pd
import pytest

from termloom.operators import density, metric_cells


def points_of(kind: str) -> np.ndarray:
    rng = np.random.default_rng(21)
    if kind == "ties":
        return np.unique(rng.integers(0, 5, (700, 4)).astype(float), axis=0)
    if kind == "blobs":  # more points a blob than a point keeps edges
        return np.concatenate([rng.normal(size=(90, 6)) + 50 * rng.normal(size=6) for _ in range(7)])
    if kind == "chain":
        return (1.1 ** np.arange(60.0))[:, None] * np.ones((1, 3))
    return rng.normal(size=(1500, 16))


@pytest.mark.parametrize("kind", ["ties", "blobs", "chain", "normal"])
def test_trees_are_those_of_all_distances(kind):
    points = points_of(kind)
    gaps = density._distances(points)
    own = density._core(gaps, np.ones(len(points), int), 2)
    want = density._spanning_tree(np.maximum(gaps, np.maximum(own[:, None], own[None, :])), gaps)
    shuffled = np.random.default_rng(5).permutation(len(points))
    assert sorted(density._tree_of_points(shuffled, points[shuffled], own[shuffled])) == want


def test_a_tree_takes_few_distances_of_a_point(monkeypatch):
    """All pairs are only met in single precision, in products of blocks."""
    points = points_of("normal")
    own = density._core(density._distances(points), np.ones(len(points), int), 2)
    taken = []
    original = density.rounded_roots
    monkeypatch.setattr(density, "rounded_roots", lambda squares: taken.append(squares.size) or original(squares))
    assert len(density._tree_of_points(np.arange(len(points)), points, own)) == len(points) - 1
    assert sum(taken) < 60 * len(points)


@pytest.mark.parametrize("kind", ["ties", "blobs", "normal"])
def test_bounds_hold_for_all_columns_that_are_not_listed(kind, monkeypatch):
    monkeypatch.setattr(metric_cells, "RIGHT_ROWS", 64)
    monkeypatch.setattr(metric_cells, "LEFT_ROWS", 50)
    points = points_of(kind)
    groups = np.random.default_rng(2).integers(0, 5, len(points))
    level = np.random.default_rng(3).random(len(points))
    reach = np.maximum(metric_cells.gaps_between(points[:130], points), level[None, :])
    reach[groups[:130, None] == groups[None, :]] = np.inf
    seen = 0
    for at, columns, bound in metric_cells.least_columns(points[:130], points, 6, level, (groups[:130], groups)):
        rest = reach[at].copy()
        rest[np.arange(len(columns))[:, None], columns] = np.inf
        assert (columns >= 0).all() and all(len(set(c)) == 6 for c in columns)
        assert (rest.min(axis=1) >= bound).all() and (np.sort(reach[at], axis=1)[:, 5] - bound < 0.2).all()
        seen += len(columns)
    assert seen == 130


@pytest.mark.parametrize("kind", ["ties", "normal"])
@pytest.mark.parametrize("size", [1, 3, 400])
def test_nearest_of_a_side_are_those_of_all_distances(kind, size):
    points = points_of(kind)[:400]
    ids = np.arange(len(points))
    left = pd.DataFrame({"row_id": ids, "vec": list(points)})
    right = pd.DataFrame({"row_id_": ids[:size], "vec_": list(points[:size]), "weight_": ids[:size] % 3 + 1})
    got = density._nearest_of_side(2)(left, right)
    gaps = metric_cells.gaps_between(points, points[:size])
    gaps[ids[:, None] == ids[None, :size]] = np.inf
    for row, found in got.groupby("row_id"):
        want = np.sort(gaps[row])[:2]
        assert np.array_equal(np.sort(found["gap"]), want[np.isfinite(want)])
        assert np.array_equal(gaps[row, found["other"]], found["gap"]) and found["other"].is_unique
        assert np.array_equal(found["weight"], found["other"] % 3 + 1)
    assert len(got) == np.isfinite(np.sort(gaps, axis=1)[:, :2]).sum()
