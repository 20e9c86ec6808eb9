"""Approximate nearest neighbours by cosine with a permutation index.

Every vector is represented by the order in which it meets PIVOTS pivot vectors, nearest first. It is posted in the inverted
files of its POSTED nearest pivots. A query reads the files of its own POSTED nearest pivots, compares orders by the footrule
distance (sum over pivots of how far the places differ; a pivot beyond the ORDERED nearest counts as place ORDERED), keeps
what lies within its radius, and ranks that by the exact cosine of the original vectors.

* Pivots are the vectors with the least hashes: a bounded sample, `PIVOTS` of them. Every vector is indexed.
* A query's radius is the footrule distance that the share SHARE of a bounded sample of SAMPLE vectors lies within, and at
  least enough for LEAST candidates. All candidates within the radius are ranked; nothing is cut off by rank before.
* Files are split into blocks of at most about BLOCK vectors, and so are the queries of a pivot, so that a pivot that is near
  to very many vectors is work for many tasks. A pair that meets at several pivots counts at the first of the query's.
* Equal vectors are one entry with its smallest ids: only `k` + 1 of them can ever be answers.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows with a null id; of rows with one id the greatest vector counts; fewer candidates than `k` give fewer
answers; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut_lineage

PIVOTS = 256
ORDERED = 128
POSTED = 18
SHARE = 0.05
LEAST = 1000
SAMPLE = 4096
BLOCK = 2048
QUERY_BLOCK = 256
ROWS = 4096


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (double) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = rows.filter(f"id is not null and size(vector) > 0 and {finite} and exists(vector, x -> x <> 0)")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return rows
    return rows.filter(F.size("vector") == lengths["n"]).groupBy("id").agg(F.max("vector").alias("vector"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if rows else np.zeros((0, 1))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Directions; scaled first, so that very large or small components neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def orders_of(vectors: np.ndarray, pivots: np.ndarray, ordered: int) -> np.ndarray:
    """The `ordered` nearest pivots of each vector, nearest first."""
    return np.argsort(-(_units(vectors) @ pivots.T), axis=1, kind="stable")[:, :ordered].astype(np.int16)


def places_of(orders: np.ndarray, pivots: int) -> np.ndarray:
    """Place of each pivot in each order; absent pivots stand at the end."""
    out = np.full((len(orders), pivots), orders.shape[1], np.int16)
    np.put_along_axis(out, orders.astype(np.int64), np.arange(orders.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def footrule(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.abs(others - one).sum(axis=1, dtype=np.int64)


def cosines(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision; rows are scaled first."""
    one, other = (v / np.abs(v).max(axis=1, keepdims=True) for v in (one, other))
    return (one * other).sum(axis=1) / (np.sqrt((one * one).sum(axis=1)) * np.sqrt((other * other).sum(axis=1)))


def build_index(vectors: DataFrame, pivots: int = PIVOTS, ordered: int = ORDERED) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Entries (node, vector, order) of distinct vectors `vectors` (node, vector), the pivots and the sampled orders."""
    by_hash = vectors.orderBy(F.xxhash64("vector"), "node").select("vector").limit(SAMPLE).collect()
    sample = np.array([r["vector"] for r in by_hash], dtype=float)
    chosen = _units(sample[:pivots])
    ordered = min(ordered, len(chosen))
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                orders = orders_of(_matrix(part.column("vector"), part.num_rows), shared.value, ordered)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("vector"), pa.array([o.tobytes() for o in orders], pa.binary()),
                     pa.array(orders[:, :POSTED].astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    names=["node", "vector", "order", "nearest"],
                )

    entries = vectors.select("node", "vector").mapInArrow(
        arrange, "node long, vector array<double>, order binary, nearest array<int>"
    )
    return cut_lineage(entries), chosen, orders_of(sample, chosen, ordered)


def _blocks(entries: DataFrame, size: int, name: str) -> DataFrame:
    """Entries posted under each of their nearest pivots, packed in blocks of about `size`: pivot, nodes, orders."""
    posted = entries.select("node", "order", "vector", F.explode("nearest").alias("pivot"))
    counts = posted.groupBy("pivot").count()  # at most PIVOTS rows
    splits = F.broadcast(counts.select("pivot", F.ceil(F.col("count") / size).cast("long").alias("splits")))
    numbered = posted.join(splits, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("splits")))
    packed = numbered.groupBy("pivot", "block").agg(F.collect_list(F.struct("node", "order", "vector")).alias(name))
    return packed.drop("block")


def candidates(
    queries: DataFrame, entries: DataFrame, pivots: int, sample: np.ndarray, share: float, best: int
) -> DataFrame:
    """(query, node, score) of entries within each query's radius that share one of its nearest pivots, the query left out.

    All of them are scored where they are found; the `best` of each block leave it, so each query's `best` do.
    """
    files = _blocks(entries, BLOCK, "posted")
    asked = _blocks(queries, QUERY_BLOCK, "asked")
    shared = entries.sparkSession.sparkContext.broadcast(places_of(sample, pivots))

    def unpack(lists: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fields = lists.values
        nodes = fields.field("node").to_numpy()
        orders = np.frombuffer(b"".join(fields.field("order").to_pylist()), np.int16)
        return nodes, orders.reshape(len(nodes), -1), _matrix(fields.field("vector"), len(nodes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii: dict[int, int] = {}
        sampled = shared.value
        within = min(max(int(np.ceil(share * len(sampled))), 1), len(sampled)) - 1
        for batch in batches:
            for i in range(batch.num_rows):
                pivot = batch.column("pivot")[i].as_py()
                q_nodes, q_orders, q_vectors = unpack(batch.column("asked")[i])
                x_nodes, x_orders, x_vectors = unpack(batch.column("posted")[i])
                q_places, x_places = places_of(q_orders, pivots), places_of(x_orders, pivots)
                found_q, found_x, found_score = [], [], []
                for q in range(len(q_nodes)):
                    node = int(q_nodes[q])
                    if node not in radii:
                        if len(radii) > 100_000:
                            radii.clear()
                        radii[node] = int(np.partition(footrule(q_places[q], sampled), within)[within])
                    near = footrule(q_places[q], x_places) <= radii[node]
                    # the pair belongs to the first of the query's pivots that also posts the entry
                    nearer = q_orders[q][: int(q_places[q][pivot])].astype(np.int64)
                    near &= (x_places[:, nearer] >= POSTED).all(axis=1) & (x_nodes != node)
                    nodes, score = x_nodes[near], cosines(q_vectors[q : q + 1], x_vectors[near])
                    top = np.lexsort((nodes, -score))[:best]
                    found_x.append(nodes[top])
                    found_score.append(score[top])
                    found_q.append(np.full(len(top), node))
                found = (found_q, found_x, found_score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in found], names=["query", "node", "score"]
                )

    return asked.join(files, "pivot").mapInArrow(search, "query long, node long, score double")


def nearest(
    table: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the `k` nearest found of every row that `is_query` (a Column of id) picks."""
    rows = cut_lineage(valid_vectors(table, id_col, vector_col))
    keyed = rows.withColumn("key", F.md5(F.to_json(F.struct("vector")).cast("binary")))
    firsts = keyed.groupBy("key").agg(F.min_by("vector", "id").alias("vector"), F.min("id").alias("node"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    own = keyed.select("key", "id").withColumn("place", place).filter(F.col("place") <= k + 1)
    distinct = cut_lineage(firsts)
    total = distinct.count()
    if not total:
        empty = "query_id long, rank int, vec_id long, score double"
        return table.sparkSession.createDataFrame([], empty)
    entries, pivots, sample = build_index(distinct)
    asking = keyed.filter(is_query(F.col("id"))).select("key", F.col("id").alias("query_id"))
    asking = cut_lineage(asking.join(distinct.select("key", F.col("node").alias("query")), "key").select("query_id", "query"))
    # the smallest ids of each distinct vector
    ids = cut_lineage(own.join(distinct.select("key", "node"), "key").select("node", "id"))
    asked = entries.join(asking.select(F.col("query").alias("node")).distinct(), "node", "left_semi")
    found = candidates(asked, entries, len(pivots), sample, max(share, min(1.0, LEAST / total)), k + 1)
    scored = found.unionByName(_self_scored(asked))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = scored.join(ids, "node").select("query", "id", "score").withColumn("place", F.row_number().over(best))
    lists = cut_lineage(lists.filter(F.col("place") <= k + 1))
    answers = asking.join(lists, "query").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score"
    )


def _self_scored(asked: DataFrame) -> DataFrame:
    """query, node and score of each query entry with itself: its copies are candidates too."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column("vector"), batch.num_rows)
                node = batch.column("node")
                yield pa.RecordBatch.from_arrays([node, node, pa.array(cosines(own, own))], names=["query", "node", "score"])

    return asked.select("node", "vector").mapInArrow(score, "query long, node long, score double")
