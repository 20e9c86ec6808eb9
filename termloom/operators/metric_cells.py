"""Metric cells: points around pivots with a radius, so that searches visit only cells that can hold what they look for.

Rows of a block (coarse_id) are dealt to the nearest of a few pivots of the block, which are rows with low hashes. A cell knows
its radius; by the triangle inequality a point at distance d of the pivot is no nearer than d - radius to any member. Cells with
many members are cut in parts by hash, so what one task holds is bounded by `per_cell`.

On vectors without structure radii exclude next to nothing, and one copy of a point per visited cell grows with the square of the
block. Such blocks (`crowded`) are compared whole: rows are dealt to a few sides by hash, and every two sides meet in a task
(`meet_sides`, `pair_sides`), so that a row is sent SIDES times whatever the vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import cut_lineage

PART_ROWS = 5_000
# Visitors of a cell part that one task holds; a part visited by more is met in several tasks.
VISITORS = 10_000
MATRIX_CELLS = 4_000_000
# Distances are compared at this many decimals, so that matrices of different shapes agree.
DECIMALS = 9
SLACK = 1e-8
# Blocks whose points would visit more cells than this, on average, are compared side by side.
VISITS = 16
# Rows of a side, until a block has SIDES of them; sides grow then, up to MOST_ROWS.
SIDE_ROWS, SIDES, MOST_ROWS = 8_000, 8, 80_000
# Distances that a task compares at once: few enough to stay in the processor's cache.
SIDE_CELLS = 1_000_000
# Rows and columns of a product in single precision, few enough to stay there too, and candidates a row that are kept unsorted.
LEFT_ROWS, RIGHT_ROWS, CANDIDATES = 512, 1024, 16


def gaps_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of `a` and `b`, rounded."""
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :]
    return np.round(np.sqrt(np.maximum(squares - 2 * a @ b.T, 0)), DECIMALS)


def matrix_of(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def against_pivots(points: DataFrame, pivots: DataFrame, match: Callable, schema: str) -> DataFrame:
    """`match(points, pivots)` for parts of a block's points and all pivots of the block. Columns of pivots end in `_`."""
    sizes = points.groupBy("coarse_id").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    left = points.join(F.broadcast(sizes) if _few(sizes) else sizes, "coarse_id")
    left = left.withColumn("piece", F.pmod(F.xxhash64("row_id"), F.col("parts"))).drop("parts")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    right = pivots.join(sizes, pivots["coarse_id_"] == sizes["coarse_id"]).select(*pivots.columns, F.explode(every).alias("piece_"))

    def run(block: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(centres):
            return pd.DataFrame({name.split()[0]: [] for name in schema.split(", ")})
        step = max(1, MATRIX_CELLS // len(centres))
        return pd.concat([match(block.iloc[i : i + step], centres) for i in range(0, len(block), step)])

    return left.groupBy("coarse_id", "piece").cogroup(right.groupBy("coarse_id_", "piece_")).applyInPandas(run, schema)


def _few(sizes: DataFrame) -> bool:
    return sizes.limit(100_001).count() <= 100_000


def deal_cells(points: DataFrame, per_cell: int) -> DataFrame:
    """(row_id, cell, part, to_pivot): each row's cell, named by the row_id of its pivot, and its distance to the pivot."""
    sizes = points.groupBy("coarse_id").agg(F.count("*").alias("size"), F.min_by("row_id", F.xxhash64("row_id")).alias("first"))
    share = F.pmod(F.xxhash64("row_id", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    chosen = points.select("coarse_id", "row_id").join(sizes, "coarse_id")
    chosen = chosen.filter((F.col("row_id") == F.col("first")) | (share * F.col("size") * per_cell < F.col("size")))
    pivots = points.join(chosen.select("row_id"), "row_id").select(
        F.col("coarse_id").alias("coarse_id_"), F.col("row_id").alias("cell_"), F.col("vec").alias("pivot_")
    )

    def nearest(block: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        centres = centres.sort_values("cell_")
        gaps = gaps_between(matrix_of(block["vec"]), matrix_of(centres["pivot_"]))
        at = gaps.argmin(axis=1)
        return pd.DataFrame({"row_id": block["row_id"], "cell": centres["cell_"].to_numpy()[at], "to_pivot": gaps.min(axis=1)})

    dealt = against_pivots(points.select("coarse_id", "row_id", "vec"), pivots, nearest, "row_id long, cell long, to_pivot double")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / (2 * per_cell)).alias("parts"))
    return dealt.join(parts, "cell").select("row_id", "cell", F.pmod(F.xxhash64("row_id"), F.col("parts")).alias("part"), "to_pivot")


def describe_cells(placed: DataFrame, *facts) -> DataFrame:
    """Per cell part: coarse_id_, cell_, part_, pivot_, radius_ and `facts`. `placed`: coarse_id, row_id, vec, cell, part, ..."""
    parts = placed.groupBy("coarse_id", "cell", "part").agg(F.max("to_pivot").alias("radius_"), *facts)
    pivots = placed.filter("row_id = cell").select(F.col("cell").alias("cell_"), F.col("vec").alias("pivot_"))
    renamed = parts.withColumnsRenamed({"coarse_id": "coarse_id_", "cell": "cell_", "part": "part_"})
    return renamed.join(pivots, "cell_")


def meet(visits: DataFrame, visitors: DataFrame, placed: DataFrame, match: Callable, schema: str, columns: list[str]) -> DataFrame:
    """`match(visitors, members)` for every cell part that is visited. `visits`: row_id, cell, part; `columns` are carried on
    both sides, those of members end in `_`."""
    visits = cut_lineage(visits)
    sizes = visits.groupBy("cell", "part").agg(F.ceil(F.count("*") / VISITORS).alias("pieces"))
    left = visits.join(F.broadcast(sizes) if _few(sizes) else sizes, ["cell", "part"])
    left = left.withColumn("piece", F.pmod(F.xxhash64("row_id", F.lit(11)), F.col("pieces"))).drop("pieces")
    left = left.join(visitors.select("row_id", *columns), "row_id")
    every = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    right = placed.join(sizes, ["cell", "part"]).select(
        F.col("cell").alias("cell_"), F.col("part").alias("part_"), F.explode(every).alias("piece_"),
        F.col("row_id").alias("row_id_"), *[F.col(c).alias(f"{c}_") for c in columns],
    )

    def run(block: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(members):
            return pd.DataFrame({name.split()[0]: [] for name in schema.split(", ")})
        step = max(1, MATRIX_CELLS // len(members))
        return pd.concat([match(block.iloc[i : i + step], members) for i in range(0, len(block), step)])

    met = left.groupBy("cell", "part", "piece").cogroup(right.groupBy("cell_", "part_", "piece_"))
    return met.applyInPandas(run, schema)


def crowded(points: DataFrame, pivots: DataFrame, match: Callable) -> DataFrame:
    """(coarse_id) of the blocks whose points would visit more than VISITS cells each. `match` as for `against_pivots`."""

    def count(block: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"coarse_id": block["coarse_id"].iloc[:1], "visits": len(match(block, centres)), "rows": len(block)})

    counted = against_pivots(points, pivots, count, "coarse_id long, visits long, rows long")
    total = counted.groupBy("coarse_id").agg(F.sum("visits").alias("visits"), F.sum("rows").alias("rows"))
    return cut_lineage(total.filter(F.col("visits") > VISITS * F.col("rows")).select("coarse_id"))


def _sides(rows: DataFrame) -> DataFrame:
    """(coarse_id, sides): in how many sides the rows of a block are dealt."""
    n = F.count("*")
    sides = F.greatest(F.least(F.ceil(n / SIDE_ROWS), F.lit(SIDES)), F.ceil(n / MOST_ROWS))
    return cut_lineage(rows.groupBy("coarse_id").agg(sides.cast("long").alias("sides")))


def _tasks(n: int) -> int:
    """Partitions for `n` groups of equal work: so many that few groups share one."""
    return max(1, min(4 * n, 4000))


def _every(sides: str):
    return F.sequence(F.lit(0).cast("long"), F.col(sides) - 1)


def _side(sides: str):
    return F.pmod(F.xxhash64("row_id", F.lit(13)), F.col(sides))


def meet_sides(visitors: DataFrame, members: DataFrame, match: Callable, schema: str, columns: list[str]) -> DataFrame:
    """`match(visitors, members)` for every side of a block's visitors and every side of its members; `columns` are carried on
    both sides, those of members end in `_`."""
    counts = _sides(visitors).withColumnRenamed("sides", "left_sides").join(_sides(members).withColumnRenamed("sides", "right_sides"), "coarse_id")
    counts = cut_lineage(counts)
    tasks = _tasks(counts.agg(F.sum(F.col("left_sides") * F.col("right_sides"))).first()[0] or 0)
    left = visitors.join(counts, "coarse_id").select(
        "coarse_id", _side("left_sides").alias("one"), F.explode(_every("right_sides")).alias("two"), "row_id", *columns
    )
    right = members.join(counts, "coarse_id").select(
        F.col("coarse_id").alias("coarse_id_"), F.explode(_every("left_sides")).alias("one_"), _side("right_sides").alias("two_"),
        F.col("row_id").alias("row_id_"), *[F.col(c).alias(f"{c}_") for c in columns],
    )

    def run(block: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(others):
            return pd.DataFrame({name.split()[0]: [] for name in schema.split(", ")})
        return match(block, others)

    met = left.repartition(tasks, "coarse_id", "one", "two").groupBy("coarse_id", "one", "two")
    others = right.repartition(tasks, "coarse_id_", "one_", "two_").groupBy("coarse_id_", "one_", "two_")
    return met.cogroup(others).applyInPandas(run, schema)


def pair_sides(rows: DataFrame, match: Callable, schema: str, columns: list[str], itself: bool = False) -> DataFrame:
    """`match(rows)` for every two sides of a block together, told apart by the column `side`; a block of one side comes alone,
    and with `itself` every side also comes alone."""
    counts = _sides(rows)
    pairs = F.col("sides") * (F.col("sides") + 1) / 2
    tasks = _tasks(int(counts.agg(F.sum(pairs)).first()[0] or 0))
    dealt = rows.join(counts, "coarse_id").select("coarse_id", _side("sides").alias("side"), "sides", "row_id", *columns)
    dealt = dealt.withColumn("other", F.explode(_every("sides")))
    if not itself:
        dealt = dealt.filter((F.col("side") != F.col("other")) | (F.col("sides") == 1))
    keyed = dealt.withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")}).drop("other", "sides")
    return keyed.repartition(tasks, "coarse_id", "one", "two").groupBy("coarse_id", "one", "two").applyInPandas(match, schema)


def square_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of `a` and `b`, as `gaps_between` takes them."""
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T


def rounded_roots(squares: np.ndarray) -> np.ndarray:
    return np.round(np.sqrt(np.maximum(squares, 0)), DECIMALS)


def squares_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of `a` and its row of `b`, as `square_gaps` takes them."""
    return (a**2).sum(axis=1) + (b**2).sum(axis=1) - 2 * np.einsum("ij,ij->i", a, b)


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def _places(marks: np.ndarray) -> np.ndarray:
    """Where few of many marks are set, found eight at once."""
    whole = len(marks) // 8 * 8
    near = (np.flatnonzero(marks[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[marks[near]], whole + np.flatnonzero(marks[whole:])])


def least_columns(one: np.ndarray, two: np.ndarray, count: int, level: np.ndarray | None = None, labels=None):
    """Slices of the rows of `one`, each row's `count` rows of `two` that have the least distance, or greater of distance and
    their `level`, and a bound that all others reach. -1 where there are fewer; of equal `labels` (of `one`, of `two`) are none.

    Rows are picked in single precision, so which come first is not exact, but the bound is: it allows for all rounding.
    """
    centre = two.mean(axis=0)
    scale = max(max(_norms(x[i : i + PART_ROWS] - centre).max() for i in range(0, len(x), PART_ROWS)) for x in (one, two))
    root, eps = max(np.sqrt(scale), 1e-150), float(np.finfo(np.float32).eps)

    def moved(rows: np.ndarray) -> np.ndarray:
        """Rows around the centre, at most 1 long, then 1 and their squared length: so that a product is a squared distance."""
        rows = (rows - centre) / root
        return np.column_stack([rows, np.ones(len(rows)), _norms(rows)]).astype(np.float32)

    right = np.concatenate([moved(two[i : i + PART_ROWS]) for i in range(0, len(two), PART_ROWS)])
    twice = np.array([-2.0] * one.shape[1] + [1, 1], np.float32)
    floor = None if level is None else ((level / root) ** 2).astype(np.float32)
    if labels is not None:
        codes = np.unique(np.concatenate(labels), return_inverse=True)[1].astype(np.int32)
        own, other = codes[: len(one)], codes[len(one) :]
    width = min(count, len(two), RIGHT_ROWS)
    room, marks = (np.empty(LEFT_ROWS * RIGHT_ROWS, kind) for kind in (np.float32, bool))
    for i in range(0, len(one), LEFT_ROWS):
        at = slice(i, min(i + LEFT_ROWS, len(one)))
        n = at.stop - i
        left = moved(one[at])[:, [*range(one.shape[1]), -1, -2]] * twice
        every = np.arange(n)[:, None]
        found: list[tuple] = []
        for j in range(0, len(two), RIGHT_ROWS):
            to = slice(j, j + RIGHT_ROWS)
            shape = n, len(right[to])
            values, below = (x[: shape[0] * shape[1]].reshape(shape) for x in (room, marks))
            np.matmul(left, right[to].T, out=values)
            if floor is not None:
                np.maximum(values, floor[to], out=values)
            if labels is not None:
                values[own[at, None] == other[None, to]] = np.inf
            if not j:
                columns = np.argpartition(values, width - 1, axis=1)[:, :width]
                kept = values[every, columns]
                most = kept.max(axis=1)
                continue
            near = _places(np.less(values, most[:, None], out=below).ravel())
            found.append((near // shape[1], near % shape[1] + j, values.ravel()[near]))
            if sum(len(f[0]) for f in found) > CANDIDATES * n or j + RIGHT_ROWS >= len(two):
                row, column, value = (np.concatenate(x) for x in zip((np.repeat(every, width), columns.ravel(), kept.ravel()), *found))
                order = np.lexsort((value, row))
                first = np.searchsorted(row[order], np.arange(n))[:, None] + np.arange(width)
                columns, kept = column[order][first], value[order][first]
                most, found = kept[:, -1], []
        least = np.sqrt(np.maximum(most.astype(float) * (1 - 4 * eps) - 4 * (one.shape[1] + 16) * eps, 0)) * root
        yield at, np.where(np.isfinite(kept), columns, -1), np.where(np.isfinite(most), np.maximum(least - SLACK, 0), np.inf)
