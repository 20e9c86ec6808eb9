"""Density clustering inside coarse blocks.

Copies of a vector are first folded into one weighted point, so a block never holds repeated vectors. A block of at most
`chunk` points is one distance matrix in one task. A larger block is never cut and never meets in a task: its points are dealt
to metric cells (metric_cells), a point looks for neighbours and for edges only in cells that can hold nearer ones, the spanning
tree grows in rounds, and labels are read from the tree's edges by joins and components (density_tree). Where cells exclude next
to nothing, sides of the block meet pairwise instead: neighbours come from every two sides, and the tree of the block is the tree
of the edges in the trees of every two sides together. Edges have a total order (reachability, distance, row ids), so the tree,
and with it every label, is the same for every chunk size and either way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.numbers import ratio
from termloom.functions.ordering import with_running_total
from termloom.operators.assemble import OUTLIER
from termloom.operators.density_tree import leaf_labels
from termloom.operators.merge import connected_components
from termloom.operators.metric_cells import (
    DECIMALS, SIDE_CELLS, SLACK, against_pivots, crowded, deal_cells, describe_cells, gaps_between, least_columns, matrix_of, meet,
    meet_sides, pair_sides, rounded_roots, square_gaps, squares_of,
)
from termloom.operators.sizing import broadcast_if_small
from termloom.session import cut_lineage


@dataclass(frozen=True)
class DensitySettings:
    min_cluster_size: int = 3
    min_samples: int = 2
    chunk: int = 2000


def adaptive_settings(size: Column) -> tuple[Column, Column]:
    """(min_cluster_size, min_samples) suggested for a block of `size` rows."""
    small, medium, large = size < 50, size < 200, size < 1000
    return (
        F.when(small, 2).when(medium, 3).when(large, 4).otherwise(5),
        F.when(small, 1).when(medium, 2).when(large, 2).otherwise(3),
    )


def weighted_points(points: DataFrame) -> DataFrame:
    """One row per distinct vector of a block: lowest row_id, weight, block size in rows."""
    copies = points.groupBy("coarse_id", "vec").agg(F.min("row_id").alias("row_id"), F.count("*").alias("weight"))
    sizes = copies.groupBy("coarse_id").agg(F.sum("weight").alias("block_size"))
    return copies.join(sizes, "coarse_id")


# A block larger than `chunk` points has cells of about chunk / CELLS points.
CELLS = 8
# Lightest edges that a point of a growing tree keeps at hand, and further rows among which the nearest ones are picked exactly.
NEAREST, SPARE = 8, 4
PAIRS_AT_ONCE = 1 << 16


def _distances(vectors: np.ndarray) -> np.ndarray:
    gaps = gaps_between(vectors, vectors)
    np.fill_diagonal(gaps, 0)
    return gaps


def _core(gaps: np.ndarray, weights: np.ndarray, min_samples: int) -> np.ndarray:
    """Distance to the `min_samples`-th other row, counting copies; the farthest row when there are fewer."""
    order = np.argsort(gaps, axis=1, kind="stable")
    reached = np.cumsum(weights[order], axis=1) - 1
    enough = reached >= min(min_samples, int(weights.sum()) - 1)
    return np.take_along_axis(gaps, order, axis=1)[np.arange(len(gaps)), enough.argmax(axis=1)]


def _cross_distances(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Distances between visitors and members of a cell, infinite between a point and itself."""
    gaps = gaps_between(matrix_of(left["vec"]), matrix_of(right["vec_"]))
    gaps[left["row_id"].to_numpy()[:, None] == right["row_id_"].to_numpy()[None, :]] = np.inf
    return gaps


def reachability(points: DataFrame, min_samples: int = 2, max_block: int = 2000) -> DataFrame:
    """Core distance and smallest mutual reachability to another row, per row.

    Exact for blocks of any size: a point visits the cells that can hold a nearer row than the nearest it knows.
    """
    distinct = cut_lineage(weighted_points(points))
    core = cut_lineage(_with_core(distinct, min_samples, max_block))
    others = core.select(F.col("row_id").alias("nearest_id"), F.col("core_distance").alias("other_core"))
    known = core.join(others, "nearest_id", "left")
    reach = F.greatest("core_distance", "other_core", "nearest_gap")
    sure = (F.col("weight") > 1) | (reach <= F.col("core_distance"))
    known = known.withColumn("bound", F.when(sure, F.lit(None)).otherwise(F.coalesce(reach, F.lit(float("inf")))))
    known = cut_lineage(known.drop("other_core"))

    def nearest_reach(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own, other = left["core_distance"].to_numpy(), right["core_distance_"].to_numpy()
        mutual = np.maximum(_cross_distances(left, right), np.maximum(own[:, None], other[None, :]))
        return pd.DataFrame({"row_id": left["row_id"], "nearest": mutual.min(axis=1)})

    cells = cut_lineage(describe_cells(known, F.min("core_distance").alias("least_core_")))
    searching = known.filter("bound is not null")
    dense = crowded(searching, cells, _within(own_cell=True))
    schema, columns = "row_id long, nearest double", ["vec", "core_distance"]
    best = meet(cell_visits(searching.join(dense, "coarse_id", "left_anti"), cells, own_cell=True), known, known, nearest_reach, schema, columns)
    if not dense.isEmpty():
        best = best.unionByName(meet_sides(searching.join(dense, "coarse_id"), known, _least_reach, schema, columns))
    best = best.groupBy("row_id").agg(F.min("nearest").alias("nearest"))
    measured = known.join(best, "row_id", "left").withColumn("nearest", F.coalesce("nearest", "core_distance"))
    return _spread(points, distinct, measured.select("coarse_id", "row_id", "core_distance", "nearest"), ["core_distance", "nearest"])


def _within(own_cell: bool):
    """Which cell parts a point visits, as a match of `against_pivots` (cell_visits)."""

    def within(block: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        gaps = gaps_between(matrix_of(block["vec"]), matrix_of(centres["pivot_"])) - centres["radius_"].to_numpy()[None, :]
        if "least_core_" in centres:
            gaps = np.maximum(gaps, centres["least_core_"].to_numpy()[None, :])
        open_ = gaps <= block["bound"].to_numpy(float)[:, None] + SLACK
        if "one_component_" in centres:
            open_ &= block["component"].to_numpy()[:, None] != centres["one_component_"].fillna(-1).to_numpy(np.int64)[None, :]
        if not own_cell:
            open_ &= (block["cell"].to_numpy()[:, None] != centres["cell_"].to_numpy()[None, :]) | (
                block["part"].to_numpy()[:, None] != centres["part_"].to_numpy()[None, :]
            )
        row, cell = np.nonzero(open_)
        return pd.DataFrame(
            {"row_id": block["row_id"].to_numpy()[row], "cell": centres["cell_"].to_numpy()[cell], "part": centres["part_"].to_numpy()[cell]}
        )

    return within


def cell_visits(points: DataFrame, cells: DataFrame, own_cell: bool = False) -> DataFrame:
    """(row_id, cell, part) of the cell parts that may hold a row within `bound` of a point. A part is left out if its radius and
    least core distance, where `cells` tells it, put every member beyond the bound, or, where `component` is told, if all its
    members are of the point's component."""
    return against_pivots(points, cells, _within(own_cell), "row_id long, cell long, part long")


def _slices(left: pd.DataFrame, right: pd.DataFrame):
    """Slices of the rows of `left` with their squared distances to all rows of `right`, infinite between a point and itself."""
    one, two = matrix_of(left["vec"]), matrix_of(right["vec_"])
    own, other = left["row_id"].to_numpy(), right["row_id_"].to_numpy()
    shared = np.isin(own, other).any()
    step = max(1, SIDE_CELLS // len(two))
    for i in range(0, len(one), step):
        at = slice(i, i + step)
        squares = square_gaps(one[at], two)
        if shared:
            squares[own[at, None] == other[None, :]] = np.inf
        yield at, squares


def _nearest_of_side(min_samples: int):
    """The `min_samples` nearest members of every visitor, as a match of `meet_sides`."""

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, ids, weights = left["row_id"].to_numpy(), right["row_id_"].to_numpy(), right["weight_"].to_numpy()
        one, two = matrix_of(left["vec"]), matrix_of(right["vec_"])
        labels = (rows, ids) if np.isin(rows, ids).any() else None
        found, unsure = [], []
        for at, columns, bound in least_columns(one, two, min_samples + SPARE, labels=labels):
            every = np.arange(len(columns))[:, None]
            flat = np.repeat(one[at], columns.shape[1], axis=0), two[columns.ravel()]
            gaps = np.where(columns < 0, np.inf, rounded_roots(squares_of(*flat)).reshape(columns.shape))
            first = np.argsort(gaps, axis=1, kind="stable")[:, :min_samples]
            gaps, columns = gaps[every, first], columns[every, first]
            sure = gaps[:, -1] < bound
            unsure.append(np.arange(at.start, at.stop)[~sure & np.isfinite(bound)])
            kept = sure | np.isinf(bound)
            part = np.repeat(rows[at][kept], gaps.shape[1]), gaps[kept].ravel(), columns[kept].ravel()
            found.append((part[0], part[1], weights[part[2]], ids[part[2]]))
        unsure = np.concatenate(unsure)
        for at, squares in _slices(left.iloc[unsure], right) if len(unsure) else ():
            every = np.arange(len(squares))
            for _ in range(min(min_samples, len(ids))):
                nearest = squares.argmin(axis=1)
                found.append((rows[unsure][at], rounded_roots(squares[every, nearest]), weights[nearest], ids[nearest]))
                squares[every, nearest] = np.inf
        gathered = pd.DataFrame({name: np.concatenate(part) for name, part in zip(("row_id", "gap", "weight", "other"), zip(*found))})
        return gathered[np.isfinite(gathered["gap"])]

    return match


def _least_reach(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Smallest mutual reachability of every visitor to a member, as a match of `meet_sides`. A minimum can be rounded last."""
    own, other = left["core_distance"].to_numpy(), right["core_distance_"].to_numpy()
    least = [np.maximum(np.sqrt(np.maximum(squares, 0)), other[None, :]).min(axis=1) for _, squares in _slices(left, right)]
    least = np.maximum(np.round(np.concatenate(least), DECIMALS), own)
    return pd.DataFrame({"row_id": left["row_id"], "nearest": least})


def _with_core(distinct: DataFrame, min_samples: int, max_block: int) -> DataFrame:
    """Weighted points with their core distance, cell, part, to_pivot, and the nearest other point (nearest_id, nearest_gap).

    The rows of a point's own cell bound its core distance; then it visits the other cells that can hold a nearer row.
    """

    def nearest_rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        gaps = _cross_distances(left, right)
        order = np.argsort(gaps, axis=1, kind="stable")[:, :min_samples]
        found = pd.DataFrame(
            {
                "row_id": np.repeat(left["row_id"].to_numpy(), order.shape[1]),
                "gap": gaps[np.arange(len(left))[:, None], order].ravel(),
                "weight": right["weight_"].to_numpy()[order].ravel(),
                "other": right["row_id_"].to_numpy()[order].ravel(),
            }
        )
        return found[np.isfinite(found["gap"])]

    dealt = deal_cells(distinct, max(max_block // CELLS, 8))
    placed = cut_lineage(distinct.join(dealt, "row_id"))
    schema, columns = "row_id long, gap double, weight long, other long", ["vec", "weight"]
    near = cut_lineage(meet(placed.select("row_id", "cell", "part"), placed, placed, nearest_rows, schema, columns))
    bounded = placed.join(_reached(near, placed, min_samples).withColumnRenamed("gap", "bound"), "row_id", "left")
    bounded = cut_lineage(bounded.withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    cells = cut_lineage(describe_cells(placed))
    dense = crowded(bounded, cells, _within(own_cell=False))
    visits = cell_visits(bounded.join(dense, "coarse_id", "left_anti"), cells)
    met = meet(visits, placed, placed, nearest_rows, schema, columns)
    if not dense.isEmpty():
        whole = placed.join(dense, "coarse_id")
        near = near.join(whole.select("row_id"), "row_id", "left_anti")
        met = met.unionByName(meet_sides(whole, whole, _nearest_of_side(min_samples), schema, columns))
    near = cut_lineage(near.unionByName(met))
    nearest = near.groupBy("row_id").agg(F.min(F.struct("gap", "other")).alias("n"))
    core = placed.join(_reached(near, placed, min_samples, whole=True), "row_id", "left").join(nearest, "row_id", "left")
    return core.select(
        "coarse_id", "row_id", "vec", "weight", F.coalesce("gap", F.lit(0.0)).alias("core_distance"), "cell", "part", "to_pivot",
        F.col("n.other").alias("nearest_id"), F.col("n.gap").alias("nearest_gap"),
    )


def _reached(near: DataFrame, placed: DataFrame, min_samples: int, whole: bool = False) -> DataFrame:
    """(row_id, gap): distance at which `min_samples` other rows are reached, copies counted, among the rows in `near`.

    Where fewer are there, the farthest one if `whole` (all rows of the block have been seen), else nothing.
    """
    found = near.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("gap", F.col("weight").alias("rows")))).alias("near"))
    found = placed.select("row_id", "weight", "block_size").join(found, "row_id")
    wanted = F.least(F.lit(min_samples), F.col("block_size") - 1)
    reached = F.aggregate(
        "near",
        F.struct((F.col("weight") - 1).alias("seen"), F.lit(0.0).alias("gap")),
        lambda at, n: F.when(at["seen"] >= wanted, at).otherwise(
            F.struct((at["seen"] + n["rows"]).alias("seen"), n["gap"].alias("gap"))
        ),
    )
    enough = found.select("row_id", reached.alias("at"), wanted.alias("wanted"))
    return enough.filter(F.lit(whole) | (F.col("at.seen") >= F.col("wanted"))).select("row_id", F.col("at.gap").alias("gap"))


def _spread(points: DataFrame, distinct: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """Results of the distinct vectors on every row, copies included."""
    on_rows = points.select("coarse_id", "row_id").join(results.drop("coarse_id"), "row_id")
    repeated = distinct.filter("weight > 1").select("coarse_id", "vec", F.col("row_id").alias("first_id"))
    if repeated.isEmpty():
        return on_rows.select("coarse_id", "row_id", *columns)
    copies = (
        points.join(broadcast_if_small(repeated), ["coarse_id", "vec"])
        .filter("row_id <> first_id")
        .join(results.select(F.col("row_id").alias("first_id"), *columns), "first_id")
    )
    return on_rows.select("coarse_id", "row_id", *columns).unionByName(copies.select("coarse_id", "row_id", *columns))


def _first_of(keys: list[np.ndarray], among: np.ndarray) -> int:
    """Index of the smallest combination of keys where `among` holds."""
    for key in keys:
        among = among & (key == key[among].min())
    return int(among.argmax())


def _spanning_tree(mutual: np.ndarray, gaps: np.ndarray) -> list[tuple[float, float, int, int]]:
    """Edges of the minimum spanning tree (reachability, distance, smaller point, larger point), lightest first."""
    n = len(mutual)
    index = np.arange(n)
    reached = np.zeros(n, dtype=bool)
    cost, near, via = np.full(n, np.inf), np.full(n, np.inf), np.full(n, n)
    edges, current = [], 0
    for _ in range(n - 1):
        reached[current] = True
        row, plain = mutual[current], gaps[current]
        tied = (row == cost) & (plain == near)
        earlier = (np.minimum(index, current) < np.minimum(index, via)) | (
            (np.minimum(index, current) == np.minimum(index, via)) & (np.maximum(index, current) < np.maximum(index, via))
        )
        closer = ~reached & ((row < cost) | ((row == cost) & (plain < near)) | (tied & earlier))
        cost[closer], near[closer], via[closer] = row[closer], plain[closer], current
        current = _first_of([cost, near, np.minimum(index, via), np.maximum(index, via)], ~reached)
        ends = sorted((int(via[current]), current))
        edges.append((float(cost[current]), float(near[current]), *ends))
    return sorted(edges)


def _edges_of(pairs: np.ndarray, vectors: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, ...]:
    """(reach, gap, low, high) of the edges between points low * n + high, lightest first, each once."""
    pairs = np.unique(pairs)
    low, high = np.divmod(pairs, len(vectors))
    parts = [slice(i, i + PAIRS_AT_ONCE) for i in range(0, len(pairs), PAIRS_AT_ONCE)]
    gap = np.concatenate([np.zeros(0), *(rounded_roots(squares_of(vectors[low[p]], vectors[high[p]])) for p in parts)])
    reach = np.maximum(gap, np.maximum(core[low], core[high]))
    order = np.lexsort((high, low, gap, reach))
    return reach[order], gap[order], low[order], high[order]


def _lightest_pairs(points: np.ndarray, vectors: np.ndarray, core: np.ndarray, component: np.ndarray) -> np.ndarray:
    """The lightest edge of each point to another component, among all its edges, as low * n + high."""
    step = max(1, SIDE_CELLS // len(vectors))
    pairs = [np.zeros(0, np.int64)]
    for i in range(0, len(points), step):
        at = points[i : i + step]
        gaps = rounded_roots(square_gaps(vectors[at], vectors))
        reach = np.maximum(gaps, np.maximum(core[at, None], core[None, :]))
        reach[component[at, None] == component[None, :]] = np.inf
        row, to = np.nonzero((reach == reach.min(axis=1)[:, None]) & np.isfinite(reach))
        low, high = np.minimum(at[row], to), np.maximum(at[row], to)
        order = np.lexsort((high, low, gaps[row, to], row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        pairs.append(low[first] * len(vectors) + high[first])
    return np.concatenate(pairs)


def _joined_names(count: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest of `count` numbers that each is joined with, by the links of `one` and `two`."""
    names = np.arange(count)
    while (names[one] != names[two]).any():
        sides = names[one], names[two]
        np.minimum.at(names, np.maximum(*sides), np.minimum(*sides))
        while (names[names] != names).any():
            names = names[names]
    return names


def _tree_of_points(rows: np.ndarray, vectors: np.ndarray, core: np.ndarray) -> list[tuple[float, float, int, int]]:
    """Edges of the minimum spanning tree (reachability, distance, smaller row, larger row) without a matrix of distances.

    Every point knows a few of its lightest edges and a limit that all others reach. A component takes its lightest known edge if
    that is below the limits of all its points. Where few components are so sure, the points whose limits are in the way look for
    edges to other components: in single precision, and if limits are in the way still, as with many ties, by all distances. One
    component may wait for the others to join it.
    """
    order = np.argsort(rows, kind="stable")
    rows, vectors, core = rows[order], vectors[order], core[order]
    n = len(rows)
    limit, component = np.zeros(n), np.arange(n)

    def look(points: np.ndarray, labels: tuple | None) -> np.ndarray:
        pairs = [np.zeros(0, np.int64)]
        for at, columns, bound in least_columns(vectors if labels is None else vectors[points], vectors, NEAREST + 1, core, labels):
            limit[points[at]] = np.maximum(bound, core[points[at]])
            one, two = np.repeat(points[at], columns.shape[1]), columns.ravel()
            real = (two >= 0) & (one != two)
            pairs.append(np.minimum(one, two)[real] * n + np.maximum(one, two)[real])
        return np.concatenate(pairs)

    def leaving(pairs: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
        """Edges between components, which of them is the lightest of each component, and that one's reachability."""
        edges = _edges_of(pairs, vectors, core) if len(pairs) else known
        edges = tuple(x[component[edges[2]] != component[edges[3]]] for x in edges)
        best = np.full(component.max() + 1, len(edges[0]))
        for ends in edges[2:]:
            np.minimum.at(best, component[ends], np.arange(len(ends)))
        return edges, best, np.append(edges[0], np.inf)[best]

    def with_known(pairs: np.ndarray) -> np.ndarray:
        return np.concatenate([known[2] * n + known[3], pairs])

    known = _edges_of(look(np.arange(n), None), vectors, core)
    tree = [tuple(x[:0] for x in known)]
    while component.max():
        known, best, level = leaving(np.zeros(0, np.int64))
        doubt = limit <= level[component]
        doubtful = np.bincount(component[doubt], minlength=len(best))
        sure = doubtful == 0
        if 4 * sure.sum() < len(best):
            points = np.flatnonzero(doubt & (component != doubtful.argmax()))
            sure = np.arange(len(best)) != doubtful.argmax()
            known, best, level = leaving(with_known(look(points, (component[points], component))))
            points = points[limit[points] <= level[component[points]]]
            if len(points):
                known, best, level = leaving(with_known(_lightest_pairs(points, vectors, core, component)))
        chosen = np.unique(best[sure])
        tree.append(tuple(x[chosen] for x in known))
        names = _joined_names(len(best), component[known[2][chosen]], component[known[3][chosen]])
        component = np.unique(names[component], return_inverse=True)[1]
    reach, gap, low, high = (np.concatenate(x) for x in zip(*tree))
    return list(zip(reach.tolist(), gap.tolist(), rows[low].tolist(), rows[high].tolist()))


def _tree_by_sides(core: DataFrame) -> DataFrame:
    """Spanning tree edges (coarse_id, reach, gap, low, high) of whole blocks, whatever their vectors.

    An edge of a block's tree is in the tree of every part of the block that holds both its ends, so the trees of every two sides
    together hold all of them. They have few edges a point; the tree of these is grown by joins.
    """

    def trees(sides: pd.DataFrame) -> pd.DataFrame:
        rows, own = sides["row_id"].to_numpy(), sides["core_distance"].to_numpy(float)
        edges = _tree_of_points(rows, matrix_of(sides["vec"]), own)
        found = pd.DataFrame(edges, columns=["reach", "gap", "low", "high"])
        found.insert(0, "coarse_id", sides["coarse_id"].iloc[0])
        return found

    schema = "coarse_id long, reach double, gap double, low long, high long"
    edge = F.struct("reach", "gap", "low", "high")
    joining = cut_lineage(pair_sides(core, trees, schema, ["vec", "core_distance"]).distinct())
    joining = joining.withColumns({"a": F.col("low"), "b": F.col("high")})
    edges = []
    while True:
        ends = joining.select("coarse_id", F.col("a").alias("component"), F.col("b").alias("other"), edge.alias("e"))
        ends = ends.unionByName(ends.select("coarse_id", F.col("other").alias("component"), F.col("component").alias("other"), "e"))
        best = ends.groupBy("component").agg(F.min(F.struct("e", "other", "coarse_id")).alias("b"))
        best = cut_lineage(best.select("component", "b.other", "b.coarse_id", "b.e.*"))
        edges.append(best.select("coarse_id", "reach", "gap", "low", "high").distinct())
        joined = connected_components(best.select(F.col("component").alias("a"), F.col("other").alias("b")))
        for side in ("a", "b"):
            names = joined.select(F.col("id").alias(side), F.col("component").alias(f"{side}_"))
            joining = joining.join(names, side).drop(side).withColumnRenamed(f"{side}_", side)
        joining = joining.filter("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
        joining = joining.groupBy("coarse_id", "a", "b").agg(F.min(edge).alias("e"))
        joining = cut_lineage(joining.select("coarse_id", "a", "b", "e.*"))
        if joining.isEmpty():
            return reduce(DataFrame.unionByName, edges)


def _tree_edges(core: DataFrame) -> DataFrame:
    """Spanning tree edges (coarse_id, reach, gap, low, high) of blocks of any size, from `core` (_with_core).

    In each round every component of a block finds its lightest edge to another one; the chosen edges join components, so
    their number at least halves. A component knows an edge before it searches: to a point's nearest neighbour, or into the
    cell that holds another component nearest by; its points visit only cells that can hold a lighter one. Blocks that turn out
    crowded are left to `_tree_by_sides`.
    """

    def lightest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        gaps = _cross_distances(left, right)
        own, other = left["core_distance"].to_numpy(), right["core_distance_"].to_numpy()
        reach = np.maximum(gaps, np.maximum(own[:, None], other[None, :]))
        one, two = left["component"].to_numpy(), right["component_"].to_numpy()
        open_ = (one[:, None] != two[None, :]) & np.isfinite(gaps)
        rows, ids = left["row_id"].to_numpy(), right["row_id_"].to_numpy()
        low, high = np.minimum(rows[:, None], ids[None, :]), np.maximum(rows[:, None], ids[None, :])
        for key in (reach, gaps, low, high):
            most = np.inf if key.dtype.kind == "f" else np.iinfo(key.dtype).max
            open_ &= key == np.where(open_, key, most).min(axis=1)[:, None]
        at = np.flatnonzero(open_.any(axis=1))
        to = open_[at].argmax(axis=1)
        return pd.DataFrame(
            {
                "coarse_id": left["coarse_id"].to_numpy()[at], "component": one[at], "reach": reach[at, to],
                "gap": gaps[at, to], "low": low[at, to], "high": high[at, to], "other": two[to],
            }
        )

    def known_bound(block: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        gaps = gaps_between(matrix_of(block["vec"]), matrix_of(centres["pivot_"])) + centres["radius_"].to_numpy()[None, :]
        reach = np.maximum(gaps, np.maximum(block["core_distance"].to_numpy()[:, None], centres["most_core_"].to_numpy()[None, :]))
        reach[block["component"].to_numpy()[:, None] == centres["one_component_"].fillna(-1).to_numpy(np.int64)[None, :]] = np.inf
        least = block.assign(bound=reach.min(axis=1)).groupby("component", as_index=False)["bound"].min()
        return least[["component", "bound"]]

    schema = "coarse_id long, component long, reach double, gap double, low long, high long, other long"
    names = core.select("row_id", F.col("row_id").alias("component"))
    nearest = core.select("row_id", "nearest_id", "nearest_gap", "core_distance")
    nearest = nearest.join(core.select(F.col("row_id").alias("nearest_id"), F.col("core_distance").alias("other_core")), "nearest_id")
    nearest = cut_lineage(nearest.select("row_id", "nearest_id", F.greatest("core_distance", "other_core", "nearest_gap").alias("bound")))
    edges, by_sides, points = [], [], core
    while True:
        state = cut_lineage(core.drop("nearest_id", "nearest_gap").join(names, "row_id"))
        one = F.when(F.min("component") == F.max("component"), F.min("component")).alias("one_component_")
        cells = describe_cells(state, F.min("core_distance").alias("least_core_"), F.max("core_distance").alias("most_core_"), one)
        cells = cut_lineage(cells)
        ends = nearest.join(names, "row_id").join(names.select(F.col("row_id").alias("nearest_id"), F.col("component").alias("to")), "nearest_id")
        bounds = ends.filter("component <> to").select("component", "bound")
        bounds = bounds.unionByName(against_pivots(state, cells, known_bound, "component long, bound double"))
        bounds = bounds.groupBy("component").agg(F.min("bound").alias("bound")).filter(F.col("bound") < float("inf"))
        searching = cut_lineage(state.join(bounds, "component").filter(F.col("core_distance") <= F.col("bound") + SLACK))
        dense = crowded(searching, cells, _within(own_cell=True))
        if not dense.isEmpty():
            by_sides.append(dense)
            core, state, searching = (df.join(dense, "coarse_id", "left_anti") for df in (core, state, searching))
        visits = cell_visits(searching, cells, own_cell=True)
        found = meet(visits, state, state, lightest, schema, ["coarse_id", "vec", "core_distance", "component"])
        best = found.groupBy("coarse_id", "component").agg(F.min(F.struct("reach", "gap", "low", "high", "other")).alias("e"))
        best = cut_lineage(best.select("coarse_id", "component", "e.*"))
        if best.isEmpty():
            break
        edges.append(best.select("coarse_id", "reach", "gap", "low", "high").distinct())
        joined = connected_components(best.select(F.col("component").alias("a"), F.col("other").alias("b")))
        joined = joined.select(F.col("id").alias("component"), F.col("component").alias("joined"))
        names = cut_lineage(names.join(joined, "component").select("row_id", F.col("joined").alias("component")))
    if by_sides:
        left = reduce(DataFrame.unionByName, by_sides)
        edges = [e.join(left, "coarse_id", "left_anti") for e in edges] + [_tree_by_sides(points.join(left, "coarse_id"))]
    return reduce(DataFrame.unionByName, edges)


def _leaf_clusters(edges: list[tuple[float, float, int, int]], core: np.ndarray, weights: np.ndarray, min_size: int):
    """Leaf cluster (-1 for noise) and membership probability of every point, from the spanning tree."""
    n = len(core)
    size = list(map(int, weights)) + [0] * (n - 1)
    height = np.zeros(2 * n - 1)
    children: dict[int, tuple[int, int]] = {}
    top = list(range(2 * n - 1))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, (level, _, a, b) in enumerate(edges):
        node, a, b = n + i, find(a), find(b)
        children[node], height[node], size[node] = (a, b), level, size[a] + size[b]
        top[a] = top[b] = node

    def points_below(node: int) -> list[int]:
        found, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                found.append(x)
            else:
                stack.extend(children[x])
        return found

    owner, leave = np.zeros(n, dtype=int), np.zeros(n)
    split, clusters, stack = set(), 1, [(2 * n - 2, 0)]

    def drop(node: int, cluster: int, level: float) -> None:
        for point in points_below(node):
            owner[point], leave[point] = cluster, level

    while stack:
        node, cluster = stack.pop()
        gap = core[node] if node < n else height[node]
        level = 1 / gap if gap > 0 else np.inf
        if node < n:
            drop(node, cluster, level)
            continue
        big = [child for child in children[node] if size[child] >= min_size]
        if len(big) == 2:
            split.add(cluster)
            stack += [(child, clusters + i) for i, child in enumerate(big)]
            clusters += 2
            continue
        for child in children[node]:
            if child in big:
                stack.append((child, cluster))
            else:
                drop(child, cluster, level)

    labels, probability = np.full(n, OUTLIER), np.zeros(n)
    for cluster in sorted(set(range(1, clusters)) - split):
        members = owner == cluster
        levels = leave[members]
        labels[members] = cluster
        probability[members] = np.where(np.isinf(levels), 1.0, np.where(np.isinf(levels), 1.0, levels) / levels.max())
    return labels, probability


def _block_labels(rows: pd.DataFrame, edges: list, core: np.ndarray, min_size: int) -> pd.DataFrame:
    """Labels of a block whose `rows` (coarse_id, row_id, weight) are in order of row_id."""
    labels, probability = _leaf_clusters(edges, core, rows["weight"].to_numpy(), min_size)
    firsts = pd.unique(labels[labels >= 0])
    local = {int(c): i for i, c in enumerate(firsts)}
    return pd.DataFrame(
        {
            "block_id": rows["coarse_id"],
            "row_id": rows["row_id"],
            "local_id": [local.get(int(c), OUTLIER) for c in labels],
            "probability": probability,
        }
    )


def density_labels(points: DataFrame, settings: DensitySettings = DensitySettings()) -> DataFrame:
    """(coarse_id, row_id, local_id, probability) for rows (row_id, vec, coarse_id); -1 is noise.

    Blocks below `min_cluster_size` rows become one cluster. `chunk` bounds the matrix of one task; labels do not depend
    on it.
    """
    distinct = weighted_points(points)
    counts = distinct.groupBy("coarse_id").agg(F.count("*").alias("block_points"))
    distinct = cut_lineage(distinct.join(counts, "coarse_id"))
    min_size, min_samples = settings.min_cluster_size, settings.min_samples

    def cluster(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("row_id")
        gaps = _distances(np.stack(block["vec"].to_numpy()).astype(float))
        core = _core(gaps, block["weight"].to_numpy(), min_samples)
        mutual = np.maximum(gaps, np.maximum(core[:, None], core[None, :]))
        return _block_labels(block, _spanning_tree(mutual, gaps), core, min_size)

    schema = "block_id long, row_id long, local_id int, probability double"
    wide = distinct.filter(F.col("block_size") >= min_size)
    whole = distinct.filter(F.col("block_size") < min_size).select(
        F.col("coarse_id").alias("block_id"), "row_id", F.lit(0).alias("local_id"), F.lit(1.0).alias("probability")
    )
    found = wide.filter(F.col("block_points") <= settings.chunk).groupBy("coarse_id").applyInPandas(cluster, schema)
    results = found.unionByName(whole)
    large = wide.filter(F.col("block_points") > settings.chunk)
    if not large.isEmpty():
        core = cut_lineage(_with_core(large.drop("block_points"), min_samples, settings.chunk))
        grown = leaf_labels(core, cut_lineage(_tree_edges(core)), min_size)
        results = results.unionByName(grown)
    results = cut_lineage(results)
    spread = _spread(points, distinct.select("coarse_id", "row_id", "vec", "weight"), results, ["local_id", "probability"])
    return spread.select("coarse_id", "row_id", "local_id", "probability")


def global_ids(labels: DataFrame) -> DataFrame:
    """Consecutive cluster ids in (coarse_id, local_id) order; noise stays -1.

    Only the distinct id pairs are ordered, block by block, with running totals across blocks.
    """
    pairs = labels.filter("local_id >= 0").select("coarse_id", "local_id").distinct()
    per_block = pairs.groupBy("coarse_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("local_id")).alias("locals")
    )
    offset = with_running_total(per_block, "coarse_id", "n", "offset")
    numbered = offset.select("coarse_id", "offset", F.posexplode("locals").alias("position", "local_id")).select(
        "coarse_id", "local_id", (F.col("offset") + F.col("position")).alias("cluster_id")
    )
    return (
        labels.join(numbered, ["coarse_id", "local_id"], "left")
        .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(OUTLIER).cast("long")))
        .select(*labels.columns, "cluster_id")
    )


def subcluster_ids(labels: DataFrame, base_id: int, min_cluster_size: int = 3) -> DataFrame:
    """Ids from `base_id` per block; a block's noise becomes its own cluster, a small block keeps the base."""
    facts = labels.groupBy("coarse_id").agg(
        F.count("*").alias("size"),
        F.count_distinct(F.when(F.col("local_id") >= 0, F.col("local_id"))).alias("n_clusters"),
    )
    local = F.when(F.col("local_id") >= 0, F.col("local_id")).otherwise(F.col("n_clusters"))
    return labels.join(facts, "coarse_id").select(
        "coarse_id",
        "row_id",
        (F.when(F.col("size") < min_cluster_size, 0).otherwise(local) + base_id).cast("long").alias("cluster_id"),
    )


def outlier_rate(labels: DataFrame, key: str = "local_id") -> DataFrame:
    outliers = F.count_if(F.col(key) == OUTLIER)
    return labels.agg(outliers.alias("n_outliers"), ratio(outliers, F.count("*")).alias("outlier_rate"))
