"""Near-duplicates: improved consistent weighted sampling of TF-IDF shingles, banded, verified by weighted Jaccard.

Texts are bags of shingles of five words (fewer words: one shingle of all). The weight of a shingle in a text is its count
times its inverse document frequency, which is scaled to (1 + ln(N / df) / ln(1 / COMMON)) / 2 and reaches 1 for every
shingle in at most the share COMMON of the N documents. Two texts are linked when their weighted Jaccard similarity is at
least `similarity`; classes are the connected components of the links; equal texts are always one class.

1. Equal texts become one node (128-bit hash) with its smallest doc_id. All further steps work on distinct texts.
2. Document frequencies above COMMON * N, the only ones that change a weight, are exact: hashed counters over all documents
   pick the counters that could hold such a shingle, a second pass counts the shingles in these. At most
   (mean shingles per document) / COMMON shingles can be that frequent, so they are broadcast.
3. Improved consistent weighted sampling: for each of SAMPLES samples, a shingle of weight w draws r and c from Gamma(2, 1) and
   b from the unit interval, all functions of shingle and sample; t = floor(ln w / r + b), ln y = r (t - b), and the shingle
   with the least ln c - ln y - r over the distinct shingles of the text is sampled, together with t. Two texts agree in a
   sample with the probability of their weighted Jaccard similarity, however their weight is spread. Draws are quantiles of
   2 ** 16 levels picked by 16 hashed bits each. BAND_ROWS samples form a band; texts that share a band meet in a bucket.
4. In each bucket one text is compared with the others: the one that meets most texts over all its buckets, which in a group
   of edited copies is their origin. Only likely pairs are compared on their texts: those that agree in the share of samples
   that is the wanted similarity less DEVIATIONS standard deviations, by one byte of each sample. Samples are independent and
   always filled, so a pair at similarity 0.8 is missed with probability below 1e-5.
5. Texts that are in one component after that need no further comparison. The texts of a bucket that still holds several
   components are packed in blocks of BLOCK_BYTES; every two blocks of a bucket meet in a task, which compares texts of
   different components exactly, each pair in the first bucket it shares, and joins components as it finds links. Only links
   that join two components leave it, so at most one row per component of the blocks, however many pairs are similar.

Texts are fetched for the asked nodes alone, behind a Bloom filter, and steps are deleted once the next one is written.

Defined cases: null texts count as empty; texts without a word equal only texts equal byte by byte; an empty table gives no
rows; repeated rows are members of their class each; a null doc_id never names a class unless all ids are null. Further columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import components
from termloom.llm.membership import with_possible
from termloom.llm.textbytes import HASH_PIECE, Words, mix, pieces, ragged, shingles
from termloom.session import bound_batches, cut_lineage, drop_steps

SIMILARITY = 0.8
COMMON = 0.05
SAMPLES = 96
BAND_ROWS = 4
COUNTER_BITS = 18
FEATURE_BITS = 50
DEVIATIONS = 5
BLOCK_BYTES = 1 << 20
LEVEL_BITS = 16
LANE = 1 << 14
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Features:
    """Distinct shingles of each text: `row`, `feature` (FEATURE_BITS of the hash), `count`; sorted by row and feature."""

    def __init__(self, column: pa.Array):
        hashes, _, offsets = shingles(Words(column))
        self.rows = len(column)
        row = np.repeat(np.arange(self.rows, dtype=np.uint64), np.diff(offsets))
        keys = (row << np.uint64(FEATURE_BITS)) | (hashes >> np.uint64(64 - FEATURE_BITS))
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(first, len(keys)))
        self.keys = keys[first]
        self.row = (self.keys >> np.uint64(FEATURE_BITS)).astype(np.int64)
        self.feature = self.keys & np.uint64((1 << FEATURE_BITS) - 1)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and node, the identity of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("node"))


class Weights:
    """Inverse document frequencies: the frequent shingles and theirs; every other shingle has weight 1."""

    def __init__(self, feature: np.ndarray, frequency: np.ndarray, documents: int):
        order = np.argsort(feature)
        self.feature = feature[order].astype(np.uint64)
        scaled = np.log(documents / frequency[order]) / np.log(1 / COMMON) if len(order) else np.zeros(0)
        self.weight = np.append((1 + np.clip(scaled, 0, 1)) / 2, 1.0)

    def of(self, features: Features) -> np.ndarray:
        if not len(self.feature):
            return features.count.astype(float)
        at = np.minimum(np.searchsorted(self.feature, features.feature), len(self.feature) - 1)
        at = np.where(self.feature[at] == features.feature, at, len(self.feature))
        return features.count * self.weight[at]


def shingle_weights(rows: DataFrame) -> Weights:
    """Weights from the document frequencies of all rows of `rows` (text)."""
    documents = rows.count()
    floor = max(COMMON * documents, 1.0)
    shift = np.uint64(FEATURE_BITS - COUNTER_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << COUNTER_BITS, np.int64)
        for piece in pieces(batches, "text", limit=HASH_PIECE):
            totals += np.bincount((Features(piece.column("text")).feature >> shift).astype(np.int64), minlength=len(totals))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], names=["counter", "n"])

    counters = rows.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    heavy = counters.filter(F.col("n") > floor).select("counter").toPandas()["counter"].to_numpy()  # at most 2 ** COUNTER_BITS
    if not len(heavy):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), documents)
    marked = np.zeros(1 << COUNTER_BITS, bool)
    marked[heavy] = True
    shared = rows.sparkSession.sparkContext.broadcast(marked)

    def count_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", limit=HASH_PIECE):
            feature = Features(piece.column("text")).feature
            feature, n = np.unique(feature[shared.value[(feature >> shift).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int64)), pa.array(n)], names=["feature", "n"])

    exact = rows.select("text").mapInArrow(count_marked, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = exact.filter(F.col("n") > floor).toPandas()
    return Weights(found["feature"].to_numpy(), found["n"].to_numpy(), documents)


def _levels() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms, at 2 ** LEVEL_BITS levels."""
    unit = (np.arange(1 << LEVEL_BITS) + 0.5) / (1 << LEVEL_BITS)
    x = np.geomspace(1e-4, 40, 400_000)
    gamma = np.interp(unit, 1 - (1 + x) * np.exp(-x), x)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32)


_GAMMA, _LOG_GAMMA = _levels()


def samples(features: Features, weight: np.ndarray) -> np.ndarray:
    """SAMPLES 64-bit samples for each row; all bits set for rows without shingles.

    The upper half is the least value as an ordered float, the lower one tells the shingle; t decides the value, so both
    together are the identity of the sample.
    """
    out = np.full((features.rows, SAMPLES), np.iinfo(np.uint64).max, np.uint64)
    low = mix(features.feature).astype(np.uint32)
    log_weight = np.log(weight).astype(np.float32)
    mark = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
    for start in range(0, len(weight), LANE):
        at = slice(start, start + LANE)
        row = features.row[at]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        own = row[first]
        other = np.flatnonzero(log_weight[at])
        feature, identity = features.feature[at], low[at]
        x, y = np.empty_like(feature), np.empty_like(feature)
        lanes = x.view(np.uint16).reshape(-1, 4)
        bits = y.view(np.uint32).reshape(-1, 2)
        gamma, times, value = (np.empty(len(feature), np.float32) for _ in range(3))
        for k in range(SAMPLES):
            np.multiply(feature, mark[k], out=x)
            np.right_shift(x, np.uint64(29), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _STEP, out=x)
            np.right_shift(x, np.uint64(32), out=y)
            np.bitwise_xor(x, y, out=x)
            np.take(_GAMMA, lanes[:, 0], out=gamma, mode="clip")
            np.take(_LOG_GAMMA, lanes[:, 2], out=value, mode="clip")
            beta = lanes[:, 1] * np.float32(2.0**-LEVEL_BITS) + np.float32(2.0 ** -(LEVEL_BITS + 1))
            np.subtract(np.float32(1), beta, out=times)
            if len(other):
                times[other] += np.floor(log_weight[at][other] / gamma[other] + beta[other])
            np.multiply(times, gamma, out=times)
            np.subtract(value, times, out=value)
            np.add(value, np.float32(128), out=value)
            bits[:, 1] = value.view(np.uint32)
            bits[:, 0] = identity
            key = y
            least = np.minimum.reduceat(key, first)
            out[own, k] = np.minimum(out[own, k], least)
    return out


def signatures(rows: DataFrame, weights: Weights) -> DataFrame:
    """node, doc_id, bands (one hash per band) and sketch (a byte of each sample)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", limit=HASH_PIECE):
            features = Features(piece.column("text"))
            sample = samples(features, shared.value.of(features))
            grouped = sample.reshape(len(sample), SAMPLES // BAND_ROWS, BAND_ROWS)
            band = np.tile(np.arange(SAMPLES // BAND_ROWS, dtype=np.uint64), (len(sample), 1))
            for k in range(BAND_ROWS):
                band = mix(band * _STEP + grouped[:, :, k])
            some = sample[:, 0] != np.iinfo(np.uint64).max
            n = np.where(some, band.shape[1], 0)
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(band[some].ravel().view(np.int64))
            )
            sketch = pa.array([r.tobytes() for r in mix(sample).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("node"), bands, sketch], names=["doc_id", "node", "bands", "sketch"]
            )

    return rows.mapInArrow(sign, "doc_id long, node binary, bands array<long>, sketch binary")


def likely(one: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches are as similar as linked texts are, give or take chance. Arrays of bytes."""
    found = np.count_nonzero(one == other, axis=-1) / SAMPLES
    return found >= similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / SAMPLES)


def likely_pairs(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are likely to be linked. `sketches`: node, sketch."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("sketch_a", "sketch_b"))
                kept = likely(*(s.reshape(-1, SAMPLES) for s in sides), similarity)
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    return _with_both(pairs, sketches, "sketch").mapInArrow(choose, "a binary, b binary")


def joining_links(members: DataFrame, weights: Weights, similarity: float, block_bytes: int) -> DataFrame:
    """Links (a, b) between components, enough to join all that links within buckets join. `members`: bucket, node, component,
    bands, text; components of a bucket that are joined already need no link.

    A task compares two blocks of a bucket and hands on fewer links than these have components.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("text")) / block_bytes).cast("int").alias("blocks"))
    sizes = sizes.withColumn("blocks", F.greatest("blocks", F.lit(1)))
    placed = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    shared = members.sparkSession.sparkContext.broadcast(weights)

    def compare(table: pa.Table) -> pa.Table:
        names = table.column("component").to_pylist()
        number = {c: i for i, c in enumerate(dict.fromkeys(names))}
        found = _join_within(
            Features(table.column("text").combine_chunks()),
            shared.value,
            np.array([number[c] for c in names]),
            table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(names), -1),
            table.column("bucket")[0].as_py(),
            table.column("block").to_numpy(),
            similarity,
        )
        known = list(number)
        sides = ([known[pair[side]] for pair in found] for side in (0, 1))
        return pa.Table.from_arrays([pa.array(x, pa.binary()) for x in sides], names=["a", "b"])

    columns = ["bucket", "low", "high", "block", "component", "bands", "text"]
    return met.select(*columns).groupBy("bucket", "low", "high").applyInArrow(compare, "a binary, b binary")


def _join_within(
    features: Features, weights: Weights, component: np.ndarray, bands: np.ndarray, bucket: int, block: np.ndarray, similarity: float
) -> list[tuple[int, int]]:
    """The links that join components, found by exact comparison of the texts of two blocks, or of one with itself."""
    weight = weights.of(features)
    total = np.bincount(features.row, weights=weight, minlength=features.rows)
    known, local = np.unique(features.feature, return_inverse=True)
    own = np.zeros(len(known))
    starts = np.searchsorted(features.row, np.arange(features.rows + 1))
    lengths = np.diff(starts)
    here = int((bands[0] == bucket).argmax())
    links: list[tuple[int, int]] = []
    one_block = block.min() == block.max()
    number = np.arange(features.rows)
    for i in number[:-1] if one_block else np.flatnonzero(block == block.min()):
        near = (number > i) if one_block else (block != block[i])
        near &= component != component[i]
        near[near] = ~(bands[near, :here] == bands[i, :here]).any(axis=1)
        rows = np.flatnonzero(near)
        if not len(rows):
            continue
        at = slice(starts[i], starts[i + 1])
        own[local[at]] = weight[at]
        places = ragged(starts[rows], lengths[rows])
        common = np.minimum(own[local[places]], weight[places])
        both = np.bincount(np.repeat(np.arange(len(rows)), lengths[rows]), weights=common, minlength=len(rows))
        own[local[at]] = 0
        like = both / np.maximum(total[rows] + total[i] - both, 1e-12)
        for j in rows[like >= similarity]:
            if component[j] != component[i]:
                links.append((int(component[j]), int(component[i])))
                component[component == component[j]] = component[i]
    return links


def linked_pairs(pairs: DataFrame, nodes: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach `similarity`. `nodes`: node, text."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text_a", "text_b", limit=HASH_PIECE):
            like = weighted_jaccard(piece.column("text_a"), piece.column("text_b"), shared.value)
            yield piece.select(["a", "b"]).filter(pa.array(like >= similarity))

    return _with_both(pairs, nodes, "text").mapInArrow(compare, "a binary, b binary")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """`pairs` with the column of both nodes."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def weighted_jaccard(one: pa.Array, other: pa.Array, weights: Weights) -> np.ndarray:
    """Similarity of each text with its partner; 0 where both have no word."""
    sums, keys, values = 0.0, [], []
    for column in (one, other):
        features = Features(column)
        weight = weights.of(features)
        sums = sums + np.bincount(features.row, weights=weight, minlength=features.rows)
        keys.append(features.keys)
        values.append(weight)
    _, at, there = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    row = (keys[0][at] >> np.uint64(FEATURE_BITS)).astype(np.int64)
    shared = np.bincount(row, weights=np.minimum(values[0][at], values[1][there]), minlength=len(one))
    return shared / np.maximum(sums - shared, 1e-12)


def _texts_of(nodes: DataFrame, rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """node and text of every node in `nodes` (node, distinct), from the row that names the node. Only rows that pass a Bloom
    filter of the nodes are shuffled."""
    named = distinct.select("node", F.col("first_id").alias("doc_id")).join(nodes, "node")
    possible = with_possible(rows, nodes, "node", "asked").filter("asked").drop("asked")
    found = possible.join(named, (possible["node"] == named["node"]) & possible["doc_id"].eqNullSafe(named["doc_id"]), "left_semi")
    return cut_lineage(found.select("node", "text").dropDuplicates(["node"]))


def text_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node) of `docs`, and per distinct text node, first_id, rows, class_id and kept.

    class_id is the smallest doc_id of the class; `kept` marks the one text of the class that has it as its first.
    """
    bound_batches(docs.sparkSession)
    rows = texts(docs)
    weights = shingle_weights(rows)
    signed = cut_lineage(signatures(rows, weights))
    distinct = cut_lineage(
        signed.groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")
        )
    )
    members = cut_lineage(signed.select("doc_id", "node"))
    drop_steps(signed)
    bands = distinct.select("node", F.explode("bands").alias("bucket"))
    several = bands.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"))
    met = cut_lineage(bands.join(several.filter("least <> most").select("bucket", "n"), "bucket"))

    candidates = met.groupBy("node").agg(F.sum("n").alias("meets"))
    ranked = met.select("bucket", "node").join(candidates, "node")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("centre"))
    pairs = met.join(centres.select("bucket", F.col("centre.node").alias("a")), "bucket").filter("a <> node")
    pairs = pairs.select("a", F.col("node").alias("b")).distinct()
    likely_ones = cut_lineage(likely_pairs(pairs, distinct.select("node", "sketch"), similarity))
    asked = cut_lineage(likely_ones.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    held = _texts_of(asked, rows, distinct)
    links = cut_lineage(linked_pairs(likely_ones, held, weights, similarity))
    drop_steps(likely_ones, asked, held)
    labels = cut_lineage(components(links))
    drop_steps(links)

    labelled = met.select("bucket", "node").join(labels.withColumnRenamed("id", "node"), "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
    # a bucket of two has been compared
    left = cut_lineage(labelled.join(mixed.filter("least <> most and n > 2").select("bucket"), "bucket"))
    asked = cut_lineage(left.select("node").distinct())
    held = _texts_of(asked, rows, distinct)
    whole = left.join(distinct.select("node", "bands"), "node").join(held, "node")
    further = cut_lineage(joining_links(whole, weights, similarity, BLOCK_BYTES))
    drop_steps(met, left, asked, held)
    joined = components(further).select(F.col("id").alias("component"), F.col("component").alias("joined"))

    named = distinct.select("node", "first_id", "rows").join(labels.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node")).join(joined, "component", "left")
    named = cut_lineage(named.withColumn("component", F.coalesce("joined", "component")).drop("joined"))
    drop_steps(distinct, labels, further)
    lead = named.groupBy("component").agg(
        F.min("first_id").alias("class_id"), F.min_by("node", F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("lead")
    )
    classes = named.join(lead, "component")
    return members, classes.select("node", "first_id", "rows", "class_id", (F.col("node") == F.col("lead")).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (smallest doc_id of the class), one row per row of `docs` (doc_id, text)."""
    rows, classes = text_classes(docs, similarity)
    return rows.join(classes, "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs`, all columns, with one row of each class: the one with the smallest doc_id, of repeated rows any one.

    A row whose text is the kept one of its class and stands once is passed on as it is; only rows that a Bloom filter of all
    other texts cannot rule out are shuffled to be decided.
    """
    _, classes = text_classes(docs, similarity)
    classes = cut_lineage(classes.select("node", "first_id", "rows", "kept"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.unhex(F.md5(text.cast("binary"))).alias("node"),
        F.col("doc_id").cast("long").alias("id"),
    )
    marked = with_possible(packed, classes.filter("rows > 1 or not kept").select("node"), "node", "doubtful")
    kept = classes.filter("kept").select("node", "first_id")
    doubtful = marked.filter("doubtful")
    chosen = doubtful.join(kept, (doubtful["node"] == kept["node"]) & doubtful["id"].eqNullSafe(kept["first_id"]), "left_semi")
    return marked.filter("not doubtful").select("row.*").unionByName(chosen.dropDuplicates(["node"]).select("row.*"))
