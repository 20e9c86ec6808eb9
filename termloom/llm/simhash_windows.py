"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check of the candidates.

An item and a text are compared by shingles of five words (an item with fewer words is one shingle of all its words). For an
item of n words every window of n words of a text is a possible copy. A window is reported when its weighted Jaccard
similarity with the item, over shingles with their counts, is at least `similarity`. Weights lie between 1 (shingles of
every item) and 2: 1 + ln(items / items with it) / ln(items) for shingles of at least two items and of more than the share
COMMON of all, 2 for others. So at most (mean shingles per item) / COMMON shingles have a weight of their own; they are counted
over all items and are part of every block.

How windows are found, none of which loses a window that reaches the similarity:
* windows need as many shingles that occur in some item as the similarity and the weight bounds imply; only these windows
  get a fingerprint;
* the fingerprint of a window is looked up among those of the items of its size. 64 bits form 8 blocks; fingerprints within
  `radius` bits agree in some block up to radius // 8 bits, so one table per block finds all of them;
* candidates are then compared exactly.

The fingerprint radius is the one statistical step: 20 of 64 bits is more than three standard deviations beyond the
distance expected at similarity 0.8.

Items come as a table and are processed in blocks of bounded size (`ITEM_BYTES` each), one after the other, one pass over the
texts per block. Results do not depend on the blocks.

Defined cases: null or empty items and texts match nothing; a repeated item row counts once per item_id; each row of a
repeated text is reported; for one row and item the most similar window is reported, the first of equals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.textbytes import SHINGLE_WORDS, Words, pieces, ragged, shingles, short_shingles
from termloom.session import cut_lineage

SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
ITEM_BYTES = 16 << 20
WEIGHT_UNIT = 64
COMMON = 0.001

HITS = "doc_id long, item_id long, first_word long, end_word long, similarity double"


class Frequent:
    """The shingles with a weight below the greatest, ascending, and their weights."""

    def __init__(self, shingles_: np.ndarray, holders: np.ndarray, items: int):
        order = np.argsort(shingles_)
        n = max(items, 2)
        weights = np.rint((1 + np.log(n / holders[order]) / np.log(n)) * WEIGHT_UNIT)
        self.shingles = shingles_[order]
        self.weights = np.clip(weights, WEIGHT_UNIT, 2 * WEIGHT_UNIT).astype(np.int64)


class Items:
    """Fingerprints, shingles and lookup tables of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float, radius: int, frequent: Frequent):
        self.similarity, self.radius = similarity, radius
        words = Words(pa.array(texts, pa.string()))
        hashes, _, offsets = shingles(words)
        kept = np.flatnonzero(words.counts > 0)
        self.ids = np.array(ids, np.int64)[kept]
        self.words = words.counts[kept]
        self.shingle_words = np.minimum(self.words, SHINGLE_WORDS)
        self.shingles = [hashes[offsets[k] : offsets[k + 1]] for k in kept]
        found = [np.unique(s, return_counts=True) for s in self.shingles]
        self.known = np.unique(np.concatenate([frequent.shingles, *(f[0] for f in found)]))
        self.weights = np.full(len(self.known) + 1, 2 * WEIGHT_UNIT, np.int64)
        self.weights[np.searchsorted(self.known, frequent.shingles)] = frequent.weights
        self.places = [np.searchsorted(self.known, f[0]) for f in found]
        self.counts = [f[1] for f in found]
        self.totals = [int((self.weights[p] * c).sum()) for p, c in zip(self.places, self.counts)]
        self.prints = np.array(
            [fingerprints(s, self.weights[np.searchsorted(self.known, s)], np.array([0]), len(s))[0] for s in self.shingles],
            np.uint64,
        )
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True
        near = radius // BLOCKS
        distance = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        self.sizes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted(set(self.words.tolist())):
            members = np.flatnonzero(self.words == size)
            table = np.zeros((BLOCKS, 256, len(members)), bool)
            for block in range(BLOCKS):
                own = (self.prints[members] >> np.uint64(8 * block)) & np.uint64(255)
                table[block] = distance[:, own.astype(np.int64)] <= near
            self.sizes[min(size, SHINGLE_WORDS), size] = (members, table)

    def candidates(self, size: tuple[int, int], prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all pairs within the radius."""
        members, table = self.sizes[size]
        near = np.zeros((len(prints), len(members)), bool)
        for block in range(BLOCKS):
            near |= table[block][((prints >> np.uint64(8 * block)) & np.uint64(255)).astype(np.int64)]
        for window, k in np.argwhere(near):
            item = members[k]
            if np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius:
                yield int(window), int(item)

    def compare(self, item: int, places: np.ndarray, weights: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a window, given as places among the known shingles."""
        own, counts = np.unique(places, return_counts=True)
        at = np.minimum(np.searchsorted(own, self.places[item]), len(own) - 1)
        counts = np.where(own[at] == self.places[item], counts[at], 0)
        shared = int((np.minimum(counts, self.counts[item]) * self.weights[self.places[item]]).sum())
        return shared / (self.totals[item] + int(weights.sum()) - shared)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of the windows of `size` shingles at `starts`: per bit, the sign of the weighted vote."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.zeros((len(hashes) + 1, 64), np.int64)
    np.cumsum(bits * weights[:, None], axis=0, out=votes[1:])
    total = np.concatenate([[0], np.cumsum(weights)])
    ones = votes[starts + size] - votes[starts]
    sign = 2 * ones > (total[starts + size] - total[starts])[:, None]
    return np.packbits(sign, axis=1, bitorder="little").view(np.uint64).ravel()


def find_hits(column: pa.Array, items: Items) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, end word, similarity): the best window of each row and item that reaches the similarity."""
    words = Words(column)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for size in sorted({k for k, _ in items.sizes}):
        hashes, offsets = _runs(words, size)
        hit = items.filter[hashes >> np.uint64(44)]
        possible = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(items.known, hashes[possible]), max(len(items.known) - 1, 0))
        hit[possible] = items.known[place] == hashes[possible] if len(items.known) else False
        total = np.concatenate([[0], np.cumsum(hit)])
        per_row = total[offsets[1:]] - total[offsets[:-1]]
        sizes = [(key, key[1] - size + 1) for key in items.sizes if key[0] == size]
        fewest = min(_fewest(n, items.similarity) for _, n in sizes)
        for row in np.flatnonzero(per_row >= fewest):
            _row_hits(int(row), hashes, hit, offsets, sizes, items, best)
    out = []
    for (row, item), (similarity, start) in best.items():
        out.append((row, item, start, start + int(items.words[item]), similarity))
    return sorted(out)


def _runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of exactly `size` words, as items of that many words have them, and each row's first one."""
    counts = words.counts
    if size == SHINGLE_WORDS:
        hashes, _, offsets = shingles(words)
        enough = np.repeat(counts >= size, np.diff(offsets))
        return np.where(enough, hashes, np.uint64(0)), offsets
    n = np.maximum(counts - size + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    return short_shingles(words, ragged(words.offsets[:-1], n), size), offsets


def _fewest(window: int, similarity: float) -> int:
    """Known shingles that a window of that many shingles needs: weights are between 1 and 2."""
    return max(1, int(np.ceil(similarity * window / 2 - 1e-9)))


def _row_hits(row: int, hashes, hit, offsets, sizes, items: Items, best: dict) -> None:
    first, stop = int(offsets[row]), int(offsets[row + 1])
    total = np.concatenate([[0], np.cumsum(hit[first:stop])])
    longest = max(n for _, n in sizes)
    near = np.flatnonzero(hit[first:stop])
    # regions around known shingles, far shorter than a long text
    for chunk in np.split(near, np.flatnonzero(np.diff(near) > longest) + 1):
        low, high = max(0, int(chunk[0]) - longest), min(stop - first, int(chunk[-1]) + longest + 1)
        region = np.ascontiguousarray(hashes[first + low : first + high])
        places = np.full(len(region), len(items.known))
        at = np.flatnonzero(hit[first + low : first + high])
        places[at] = np.searchsorted(items.known, region[at])
        weights = items.weights[places]
        for key, n in sizes:
            if n > len(region):
                continue
            starts = np.arange(low, high - n + 1)
            starts = starts[total[starts + n] - total[starts] >= _fewest(n, items.similarity)] - low
            if not len(starts):
                continue
            prints = fingerprints(region, weights, starts, n)
            for window, item in items.candidates(key, prints):
                start = int(starts[window])
                similarity = items.compare(item, places[start : start + n], weights[start : start + n])
                known = best.get((row, item))
                if similarity >= items.similarity and (known is None or (-similarity, low + start) < (-known[0], known[1])):
                    best[row, item] = (similarity, low + start)


def frequent_shingles(table: DataFrame) -> Frequent:
    """Frequent shingles of all items (item_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            hashes, _, offsets = shingles(Words(piece.column("text")))
            row = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            first = np.ones(len(row), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            some = np.count_nonzero(np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[first].view(np.int64)), pa.nulls(int(first.sum()), pa.int64())], names=["shingle", "items"]
            )
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([some])], names=["shingle", "items"])

    counted = table.select("text").mapInArrow(read, "shingle long, items long")
    counted = cut_lineage(counted.groupBy("shingle").agg(F.count("*").alias("holders"), F.sum("items").alias("items")))
    items = counted.agg(F.coalesce(F.sum("items"), F.lit(0))).first()[0]
    found = counted.filter(F.col("shingle").isNotNull() & (F.col("holders") > max(1.0, COMMON * items))).toPandas()
    return Frequent(found["shingle"].to_numpy(np.int64).view(np.uint64), found["holders"].to_numpy(np.int64), items)


def item_blocks(items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> Iterator[Items]:
    """The items (item_id, text) in blocks of at most about ITEM_BYTES of text, each small enough to be broadcast."""
    table = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct()
    size = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if not size:
        return
    frequent = frequent_shingles(table)
    blocks = size // ITEM_BYTES + 1
    numbered = table.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).select("item_id", "text").toPandas()
        held = Items(rows["item_id"].tolist(), rows["text"].tolist(), similarity, radius, frequent)
        if len(held.ids):
            yield held


def contaminated_spans(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document row and item found in it: HITS."""
    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    context = docs.sparkSession.sparkContext
    passes = []
    for block in item_blocks(items, similarity, radius):
        shared = context.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text"):
                hits = find_hits(piece.column("text"), shared.value)
                if hits:
                    row, item, first, end, like = (list(x) for x in zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_id").take(pa.array(row)),
                            pa.array(shared.value.ids[item]),
                            pa.array(first),
                            pa.array(end),
                            pa.array(like),
                        ],
                        names=["doc_id", "item_id", "first_word", "end_word", "similarity"],
                    )

        passes.append(columns.mapInArrow(find, HITS))
    if not passes:
        return docs.sparkSession.createDataFrame([], HITS)
    found = reduce(DataFrame.unionAll, passes)
    return found if len(passes) == 1 else found.dropDuplicates(["doc_id", "item_id", "first_word", "end_word"])


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no item. One pass per block of items, no shuffle."""
    context = docs.sparkSession.sparkContext
    names = docs.columns
    # Spark passes columns to Python by name and cannot do so if a name holds a dot
    docs = docs.toDF(*[name if name == "text" else f"_{k}" for k, name in enumerate(names)])
    for block in item_blocks(items, similarity, radius):
        shared = context.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text"):
                clean = np.ones(piece.num_rows, bool)
                clean[[hit[0] for hit in find_hits(piece.column("text"), shared.value)]] = False
                yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*names)
