import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom import session
from termloom.functions import ordering
from termloom.functions.ordering import exact_median, with_row_index, with_running_total
from termloom.operators import coarse, density, merge, outliers, similarity
from termloom.operators.projection import project_2d
from termloom.operators.similarity import nearest_centroid, similar_pairs


def frame(spark, vectors, **columns):
    rows = [(i, [float(x) for x in v], *[int(c[i]) for c in columns.values()]) for i, v in enumerate(vectors)]
    extra = "".join(f", {name} long" for name in columns)
    return spark.createDataFrame(rows, f"row_id long, vec array<double>{extra}")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(7)
    centers = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0], [0, 0, 20]], dtype=float)
    points = np.concatenate([c + rng.normal(0, 0.3, (15, 3)) for c in centers])
    noise = np.array([[60.0, 60, 60], [-70, 10, 0]])
    return np.concatenate([points, noise]), np.repeat(np.arange(4), 15)


def partition_of(rows, key="local_id"):
    groups = {}
    for r in rows:
        groups.setdefault((r["coarse_id"], r[key]), set()).add(r["row_id"])
    return {frozenset(g) for (c, k), g in groups.items() if k >= 0}


def test_blobs_are_recovered_and_noise_is_not(spark, blobs):
    points, truth = blobs
    df = frame(spark, points, coarse_id=np.zeros(len(points)))
    rows = density.density_labels(df).collect()
    assert len(rows) == len(points)
    by_row = {r["row_id"]: r for r in rows}
    assert by_row[60]["local_id"] == -1 and by_row[61]["probability"] == 0
    for cluster in partition_of(rows):
        assert len(cluster) >= 3 and len({truth[i] for i in cluster}) == 1
    assert all(0 <= r["probability"] <= 1 for r in rows)


def test_partition_does_not_depend_on_row_order(spark, blobs):
    points, _ = blobs
    order = np.random.default_rng(1).permutation(len(points))
    first = density.density_labels(frame(spark, points, coarse_id=np.zeros(len(points)))).collect()
    second = density.density_labels(frame(spark, points[order], coarse_id=np.zeros(len(points)))).collect()
    back = {frozenset(int(order[i]) for i in g) for g in partition_of(second)}
    assert partition_of(first) == back


def test_copies_are_folded_and_spread(spark):
    base = np.array([[0.0, 0], [0.2, 0], [0, 0.2], [9, 9], [9.1, 9], [50, 50]])
    copies = np.concatenate([base, np.repeat(base[5:6], 200, axis=0), np.repeat(base[3:4], 4, axis=0)])
    rows = density.density_labels(frame(spark, copies, coarse_id=np.zeros(len(copies)))).collect()
    label = {r["row_id"]: r["local_id"] for r in rows}
    assert len(label) == len(copies)
    assert len({label[i] for i in [5, *range(6, 206)]}) == 1 and label[5] >= 0
    core = {r["row_id"]: r["core_distance"] for r in density.reachability(frame(spark, copies, coarse_id=np.zeros(len(copies)))).collect()}
    assert core[5] == 0 and core[100] == 0
    gaps = np.sort(np.linalg.norm(copies - copies[0], axis=1))
    assert core[0] == pytest.approx(gaps[2], abs=1e-7)


def test_reachability_of_chunked_blocks(spark):
    points = np.random.default_rng(11).normal(size=(90, 4))
    df = frame(spark, points, coarse_id=np.arange(90) % 2)
    for size in (2000, 20):
        got = {r["row_id"]: (r["core_distance"], r["nearest"]) for r in density.reachability(df, max_block=size).collect()}
        for i in range(90):
            own = [j for j in range(90) if j % 2 == i % 2]
            gaps = {j: np.linalg.norm(points[own] - points[j], axis=1) for j in own}
            core = {j: np.sort(gaps[j])[2] for j in own}
            reach = min(max(core[i], core[j], g) for j, g in zip(own, gaps[i]) if j != i)
            assert got[i] == pytest.approx((core[i], reach), abs=1e-6)


def test_labels_do_not_depend_on_the_chunk(spark, blobs):
    points = np.concatenate([blobs[0], np.random.default_rng(3).normal(size=(60, blobs[0].shape[1])), blobs[0][:5]])
    df = frame(spark, points, coarse_id=np.arange(len(points)) % 2)
    whole = density.density_labels(df, density.DensitySettings(chunk=2000)).collect()
    for chunk in (25,):
        cut = density.density_labels(df, density.DensitySettings(chunk=chunk)).collect()
        assert sorted(cut) == sorted(whole)
    assert {r["local_id"] for r in whole} > {-1, 0}


def test_split_large_keeps_rows_and_bounds_blocks(spark):
    points = np.concatenate([np.random.default_rng(2).normal(size=(150, 3)), np.zeros((100, 3))])
    df = frame(spark, points, coarse_id=np.where(np.arange(250) % 5 == 0, 1, 0))
    out = coarse.split_large(df, max_size=60).collect()
    assert sorted(r["row_id"] for r in out) == list(range(250))
    sizes = np.unique([r["coarse_id"] for r in out], return_counts=True)[1]
    assert max(sizes) <= 60


def test_split_large_keeps_neighbours_together(spark):
    """Many copies of 0 between other values: blocks are intervals, and only the copies are cut, in row_id order."""
    rng = np.random.default_rng(5)
    values = np.concatenate([np.zeros(300), rng.normal(size=60), 1e6 + rng.normal(size=60)])
    rng.shuffle(values)
    df = frame(spark, values[:, None], coarse_id=np.zeros(len(values)))
    out = coarse.split_large(df, max_size=20).collect()
    assert sorted(r["row_id"] for r in out) == list(range(len(values)))
    blocks = {}
    for r in out:
        blocks.setdefault(r["coarse_id"], []).append(r["row_id"])
    assert max(map(len, blocks.values())) <= 20
    copies = sorted((rows for rows in blocks.values() if not values[rows].any()), key=min)
    assert sorted(r for rows in copies for r in rows) == list(np.flatnonzero(values == 0))
    assert all(max(a) < min(b) for a, b in zip(copies, copies[1:]))
    others = sorted((values[rows].min(), values[rows].max()) for rows in blocks.values() if values[rows].any())
    assert all(a[1] < b[0] for a, b in zip(others, others[1:]))


def test_fit_is_stable_under_partitioning(spark, blobs):
    points, _ = blobs
    df = frame(spark, points)
    settings = coarse.CoarseSettings(max_iter=5)
    runs = [
        sorted(tuple(np.round(r["centroid"], 9)) for r in coarse.fit_centroids(df.repartition(p), settings).collect())
        for p in (1, 5)
    ]
    assert runs[0] == runs[1]
    assert coarse.fit_centroids(df.limit(0), settings).count() == 0
    assert coarse.fit_centroids(df.filter("row_id = 0"), settings).count() == 1


def test_nearest_and_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, cents = rng.normal(size=(80, 6)), rng.normal(size=(30, 6))
    cents[7] = cents[3]
    points = frame(spark, rows)
    centroids = frame(spark, cents).select(F.col("row_id").alias("cluster_id"), F.col("vec").alias("centroid"))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(rows) @ unit(cents).T
    far = np.linalg.norm(rows[:, None] - cents[None], axis=2)
    for budget in (1 << 20, 500):
        got = {r["row_id"]: r["cluster_id"] for r in nearest_centroid(points, centroids, budget=budget).collect()}
        assert got == {i: int(np.argmax(np.round(s, 12))) for i, s in enumerate(sims)}
        got = {r["row_id"]: r["score"] for r in nearest_centroid(points, centroids, metric="euclidean", budget=budget).collect()}
        assert np.allclose([got[i] for i in range(80)], far.min(axis=1))
        pairs = {(r["id_a"], r["id_b"]) for r in similar_pairs(centroids, 0.5, budget=budget).collect()}
        close = unit(cents) @ unit(cents).T
        assert pairs == {(i, j) for i in range(30) for j in range(i + 1, 30) if close[i, j] >= 0.5}
    empty = centroids.limit(0)
    assert nearest_centroid(points, empty).count() == 0 and similar_pairs(empty, 0.5).count() == 0


def test_cells_leave_out_far_vectors(spark, monkeypatch):
    """Blobs of 60 vectors: results equal brute force, and few of all possible copies and comparisons are made."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    cents = (centres[:, None] + 0.02 * rng.normal(size=(20, 60, 16))).reshape(-1, 16)
    cents[7], cents[300], cents[301] = cents[450], 0, 0
    rows = centres[rng.integers(0, 20, 500)] + 0.02 * rng.normal(size=(500, 16))
    rows[3], rows[4] = 0, cents[7]
    seen = {}
    original = similarity.against_pivots

    def counting(points, pivots, match, schema):
        found = original(points, pivots, match, schema)
        seen["visits"], seen["cells"], seen["points"] = found.count(), pivots.count(), points.count()
        return found

    monkeypatch.setattr(similarity, "against_pivots", counting)
    centroids = frame(spark, cents).select(F.col("row_id").alias("cluster_id"), F.col("vec").alias("centroid"))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    close = unit(cents) @ unit(cents).T
    pairs = {(r["id_a"], r["id_b"]): r["similarity"] for r in similar_pairs(centroids, 0.9, budget=20_000).collect()}
    assert set(pairs) == {(i, j) for i, j in zip(*np.nonzero(np.triu(close >= 0.9, 1)))}
    assert all(abs(close[p] - s) < 1e-9 for p, s in pairs.items())
    assert seen["visits"] < 0.2 * seen["points"] * seen["cells"] / 2
    got = {r["row_id"]: (r["cluster_id"], r["score"]) for r in nearest_centroid(frame(spark, rows), centroids, budget=20_000).collect()}
    sims = np.round(unit(rows) @ unit(cents).T, 12)
    assert {i: g[0] for i, g in got.items()} == {i: int(np.argmax(s)) for i, s in enumerate(sims)}
    assert np.allclose([got[i][1] for i in range(500)], sims.max(axis=1))
    assert seen["visits"] < 0.2 * seen["points"] * seen["cells"]
    opposite = frame(spark, -rows[5:6])
    assert [(r["cluster_id"], r["score"]) for r in nearest_centroid(opposite, centroids.filter("cluster_id in (300, 301)"), budget=1).collect()] == [(300, 0)]


def test_median_by_histograms(spark):
    rng = np.random.default_rng(3)
    for values in (rng.permutation(20_001), rng.permutation(20_000), np.repeat([5, 9], 6_000), np.r_[np.zeros(9_000), rng.normal(size=9_000)],
                   rng.lognormal(0, 40, 15_000), np.r_[[7] * 3], np.r_[1, 2, 1e300, -1e300]):
        df = spark.createDataFrame(pd.DataFrame({"v": values.astype(float)})).unionByName(spark.sql("select cast(null as double) v"))
        assert ordering.exact_median(df, "v", borders=40, small=30).first()[0] == np.median(values)
    assert ordering.exact_median(df.limit(0), "v").first()[0] is None
    million = spark.range(1_000_000).selectExpr("(id * 7919) % 1000003 as v")
    asked = million.agg(F.median("v")).first()[0]
    assert ordering.exact_median(million, "v").first()[0] == asked


def test_buckets_follow_bytes_and_go(spark):
    rows = spark.range(1000).selectExpr("id as row_id", "array_repeat(1.5D, 100) as vec")
    table = session.store_bucketed(rows, "row_id", bucket_bytes=50_000)
    shown = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {table.table_name}").collect()}
    assert shown["Num Buckets"] == "17" and table.count() == 1000
    session.drop_bucketed(table)
    assert not spark.catalog.tableExists(table.table_name)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in merge.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert merge.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_outlier_passes(spark, blobs):
    points, truth = blobs
    labels = np.concatenate([truth, [-1, -1]])
    labels[::5] = -1
    df = frame(spark, points + 1, cluster_id=labels)
    placed = outliers.reassign_outliers(df)
    after = {r["row_id"]: r["cluster_id"] for r in outliers.apply_reassignment(df, placed).collect()}
    assert all(after[i] == labels[i] for i in range(len(labels)) if labels[i] >= 0)
    single = outliers.reassign_outliers(df, aggressive=False)
    assert single.count() <= placed.count()
    none = outliers.reassign_outliers(df.withColumn("cluster_id", F.lit(-1).cast("long")))
    assert none.count() == 0


def test_ordering_helpers(spark):
    df = spark.range(0, 1000).filter("id % 7 <> 3").select((F.col("id") * 13 % 1009).alias("id"), (F.col("id") % 3).alias("g"))
    ids = sorted(r["id"] for r in df.collect())
    got = {r["id"]: r["n"] for r in with_row_index(df, "id", "n", chunk=50).collect()}
    assert got == {x: i + 1 for i, x in enumerate(ids)}
    grouped = with_row_index(df, "id", "n", ["g"], chunk=50).collect()
    for g in range(3):
        mine = sorted((r["id"], r["n"]) for r in grouped if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    totals = {r["id"]: r["before"] for r in with_running_total(df, "id", "g", "before", chunk=50).collect()}
    weight, seen = {r["id"]: r["g"] for r in df.collect()}, 0
    for x in ids:
        assert totals[x] == seen
        seen += weight[x]
    for n in (1, 2, 5, 8, 1001):
        values = np.random.default_rng(n).integers(0, 50, n)
        data = spark.createDataFrame([(int(v),) for v in values], "v long")
        assert exact_median(data, "v").first()["median"] == np.median(values)


def test_projection_keeps_most_variance(spark, blobs):
    points, truth = blobs
    labels = np.concatenate([truth, [-1, -1]])
    rows = project_2d(frame(spark, points, cluster_id=labels)).orderBy("row_id").collect()
    assert rows[60]["name"] == "Unclustered" and rows[0]["name"] == "Cluster 0"
    spread = np.var([[r["x"], r["y"]] for r in rows], axis=0).sum()
    centred = points - points.mean(axis=0)
    for seed in range(20):
        plane, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 2)))
        assert spread >= np.var(centred @ plane, axis=0).sum() - 1e-9
