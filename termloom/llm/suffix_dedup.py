"""Exact substring deduplication: every byte covered by a `WINDOW`-byte string that also starts earlier is removed.

Texts are UTF-8 bytes; earlier means a smaller document, or the same document and a smaller start; strings are judged on the
input. Matches never cross documents. The work is spread by content, so that no text meets all others:

1. Anchors. In each window the GRAM-byte string with the least hash, the leftmost of equals, is the window's anchor. Equal
   windows have equal anchors at equal distance, so windows only ever need to be compared around equal anchors. Consecutive
   windows with one anchor are one occurrence; the bytes they cover are its context.
2. Equal contexts around equal anchors: all occurrences but the first are removed. Tasks resolve their own repeats first, so a
   context reaches the shuffle at most once per chunk of a task, however many copies there are. An anchor with very many
   different contexts in a chunk is not gathered by anchor at all (step 4). Contexts are told apart by 64-bit hashes, and
   collisions are found: inside a chunk the bytes of each removed range are compared with those of its first occurrence, and
   between chunks the SHA-256 of both. If any pair differs, the whole search starts again with other hashes.
3. Different contexts around one anchor: a suffix sort of the contexts from the anchor on. Prefix polynomial hashes and binary
   search give the length of two suffixes' common part, so a comparison takes a logarithmic number of steps; mergesort
   orders them, and neighbours' common lengths split the order into runs that agree on what a window holds after its anchor.
   Within a run, hashes of the bytes before the anchor tell equal windows. These matches are verified byte by byte.
4. Anchors with more than `MOST_CONTEXTS` contexts: their windows become rows and an aggregation by the window's bytes finds
   the first of each, with partial aggregation before the shuffle.
5. The removed ranges meet their texts by document.

Defined cases: null and empty texts have no bytes; texts shorter than a window lose nothing; documents with equal or null ids
are put in order of id (null first) and then of a hash of the text, and the later of two equal rows is a repeat; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.textbytes import (
    BASE_INVERSE, HASH_PIECE, by_name, mix, pieces, powers, prefix_hashes, ragged, span_hashes, text_bytes
)
from termloom.session import BATCH_BYTES, bound_batches, cut_lineage, drop_steps

WINDOW = 100
GRAM = 24
CHUNK_BYTES = 32 << 20
CHUNK_CONTEXTS = 512
MOST_CONTEXTS = 4096
PARTS_PER_PARTITION = 6
PART_BYTES = 16 << 20
CONTEXT_BITS = 64

REMOVED, COMPARE, SPREAD, MARK, CLASH, VERIFY = 0, 1, 2, 3, 4, 5
POSITION_BITS = 24

ENTRY = np.dtype(
    [("key", "<u8"), ("context", "<u8"), ("place", "<i8"), ("low", "<i8"), ("n", "<i2"), ("at", "<i2"), ("kind", "<i2")]
)
FOUND = "kind int, key long, place long, low long, n int, at int"
SOURCE = ", first long, first_low long"


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with `place`, a number that is unique and ordered as the documents are."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows, distinct = ids.groupBy("doc_id").count().agg(F.sum("count"), F.count("doc_id")).first()
    if (rows or 0) == distinct:
        return docs.withColumn("place", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").cast("long").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ordered.withColumn("place", F.monotonically_increasing_id()))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _letters(seed: int) -> np.ndarray:
    """What each byte counts as in the hashes of one search."""
    if seed == 0:
        return np.arange(256, dtype=np.uint8)
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def occurrences(column: pa.Array, seed: int = 0, context_bits: int = CONTEXT_BITS) -> np.ndarray:
    """Entries of all anchors of a column of texts, `place` holding the row.

    `seed` picks the hashes; `context_bits` of the contexts' hashes are used. A text longer than 2 ** POSITION_BITS bytes is
    cut into overlapping stretches, which share no window start.
    """
    data, offsets = text_bytes(column)
    letters = _letters(seed)
    out, step = [], (1 << POSITION_BITS) - WINDOW
    # group whole rows, or stretches of one very long row, below the position limit
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + step, side="right")) - 1)
        for low in range(int(offsets[begin]), max(int(offsets[end]) - WINDOW + 1, int(offsets[begin])), step):
            high = min(int(offsets[end]), low + step + WINDOW - 1)
            out.append(_stretch(data, offsets[begin : end + 1], begin, low, high, letters))
        begin = end
    entries = np.concatenate(out) if out else np.zeros(0, ENTRY)
    entries["context"] >>= np.uint64(64 - context_bits)
    return entries


def _stretch(
    data: np.ndarray, offsets: np.ndarray, first_row: int, low: int, high: int, letters: np.ndarray
) -> np.ndarray:
    """Entries of the windows inside data[low:high]."""
    part = data[low:high]
    if len(part) < WINDOW:
        return np.zeros(0, ENTRY)
    prefix = prefix_hashes(letters[part])
    grams = len(part) - GRAM + 1
    hashes = (prefix[GRAM:] - prefix[:-GRAM]) * powers(BASE_INVERSE, len(prefix))[:grams]
    position = np.uint64((1 << POSITION_BITS) - 1)
    anchor = _least((hashes & ~position) | np.arange(grams, dtype=np.uint64), WINDOW - GRAM + 1) & position
    starts = np.maximum(offsets[:-1] - low, 0)
    lengths = np.maximum(np.minimum(offsets[1:] - low, len(part)) - WINDOW + 1 - starts, 0)
    start = ragged(starts, lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = anchor[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    out = np.zeros(len(first), ENTRY)
    begin = start[first]
    out["key"] = mix(hashes[at[first]])
    out["at"] = at[first] - begin
    out["n"] = n
    shape = mix(out["at"].astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64))
    out["context"] = span_hashes(prefix, begin, begin + n + WINDOW - 1) ^ shape
    out["place"] = row[first] + first_row
    out["low"] = begin + low - offsets[row[first]]
    return out


def _firsts(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by key, context and place, and for each in this order the first one of its key and context."""
    order = np.lexsort((entries["low"], entries["place"], entries["context"], entries["key"]))
    entries = entries[order]
    first = np.ones(len(entries), bool)
    first[1:] = (entries["key"][1:] != entries["key"][:-1]) | (entries["context"][1:] != entries["context"][:-1])
    return order, np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _copied(later: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in which occurrences and their sources go on side by side: the entry each begins with, and its starts."""
    if not len(later):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((later["low"], later["place"]))
    later, source = later[order], source[order]
    stop = later["low"] + later["n"]
    shift = later["low"] - source["low"]
    new = np.ones(len(later), bool)
    new[1:] = (later["place"][1:] != later["place"][:-1]) | (source["place"][1:] != source["place"][:-1])
    new[1:] |= (shift[1:] != shift[:-1]) | (later["low"][1:] != stop[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(later)) - 1
    return order[begin], stop[end] - later["low"][begin]


def _same_shape(one: np.ndarray, other: np.ndarray) -> bool:
    return bool(((one["n"] == other["n"]) & (one["at"] == other["at"])).all())


def _same_bytes(entries: np.ndarray, source: np.ndarray, text_at: np.ndarray, raw: bytearray) -> bool:
    """Whether each entry's context equals the bytes of its source, texts beginning at `text_at` of `raw`."""
    later = np.flatnonzero(source != np.arange(len(source)))
    one, other = entries[later], entries[source[later]]
    if not _same_shape(one, other):
        return False
    at, n = _copied(one, other)
    a = (text_at[later[at]] + one["low"][at]).tolist()
    b = (text_at[source[later[at]]] + other["low"][at]).tolist()
    return all(raw[x : x + size] == raw[y : y + size] for x, y, size in zip(a, b, (n + WINDOW - 1).tolist()))


def _contexts_per_key(entries: np.ndarray) -> np.ndarray:
    """For entries sorted by key: how many have the same key."""
    new = np.ones(len(entries), bool)
    new[1:] = entries["key"][1:] != entries["key"][:-1]
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] if len(run) else np.zeros(0, np.int64)


def _merged(entries: np.ndarray) -> np.ndarray:
    """Occurrences to be removed, those that touch or overlap in one document joined; `n` stays their number of starts."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["low"], entries["place"]))]
    stop = entries["low"] + entries["n"]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["place"][1:] != entries["place"][:-1]) | (entries["low"][1:] > stop[:-1])
    # bounded by the two bytes of n
    room = (entries["low"] - entries["low"][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]) // 30_000
    new[1:] |= room[1:] != room[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(entries)) - 1
    out = entries[first].copy()
    out["n"] = stop[last] - out["low"]
    return out


def find_occurrences(
    docs: DataFrame, parts: int, chunk_contexts: int = CHUNK_CONTEXTS, seed: int = 0, context_bits: int = CONTEXT_BITS
) -> DataFrame:
    """(part, entries): packed entries of every chunk of texts, split by anchor; what a chunk can decide is decided.

    An anchor with more than `chunk_contexts` contexts in a chunk leaves a mark in place of these, so that the contexts of
    other chunks join them. A chunk whose equal hashes do not mean equal bytes says so.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, raw = [], [], bytearray()
        for piece in pieces(batches, "text", limit=HASH_PIECE):
            entries = occurrences(piece.column("text"), seed, context_bits)
            data, offsets = text_bytes(piece.column("text"))
            texts.append(offsets[entries["place"]] + len(raw))
            raw += data.tobytes()
            entries["place"] = piece.column("place").to_numpy()[entries["place"]]
            held.append(entries)
            if len(raw) > CHUNK_BYTES:
                yield from _packed(held, texts, raw, parts, chunk_contexts)
        if held:
            yield from _packed(held, texts, raw, parts, chunk_contexts)

    return docs.select("place", F.col("text").cast("string")).mapInArrow(scan, "part int, entries binary")


def _packed(held: list, texts: list, raw: bytearray, parts: int, chunk_contexts: int) -> Iterator[pa.RecordBatch]:
    """Entries of one chunk, a row for each part, in batches of about BATCH_BYTES. `held`, `texts` and `raw` are emptied as soon
    as they are used, and rows are views, so that at most two copies of the entries are in memory."""
    entries = np.concatenate(held)
    held.clear()
    order, source = _firsts(entries)
    entries = entries[order]
    text_at = np.concatenate(texts)[order]
    texts.clear()
    del order
    first = source == np.arange(len(source))
    clash = entries[:0] if _same_bytes(entries, source, text_at, raw) else entries[:1].copy()
    raw.clear()
    del source, text_at
    clash["kind"] = CLASH
    repeats, entries = _merged(entries[~first]), entries[first]
    repeats["kind"] = REMOVED
    entries["kind"] = np.where(_contexts_per_key(entries) > chunk_contexts, SPREAD, COMPARE)
    spread = entries[entries["kind"] == SPREAD]
    marks = spread[np.unique(spread["key"], return_index=True)[1]]
    marks["kind"] = MARK
    everything = np.concatenate([repeats, entries, marks, clash])
    del repeats, entries, spread, first
    by_key = (everything["kind"] == COMPARE) | (everything["kind"] == MARK)
    part = np.where(by_key, everything["key"], mix(everything["place"].astype(np.uint64))) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    everything, part = everything[order], part[order].astype(np.int32)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    offsets = np.append(at, len(part)).astype(np.int32) * ENTRY.itemsize
    row = 0
    while row < len(at):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BATCH_BYTES, side="right")) - 1)
        low, high = offsets[row] // ENTRY.itemsize, offsets[stop] // ENTRY.itemsize
        blobs = pa.Array.from_buffers(
            pa.binary(), stop - row, [None, pa.py_buffer(offsets[row : stop + 1] - offsets[row]), pa.py_buffer(everything[low:high])]
        )
        yield pa.RecordBatch.from_arrays([pa.array(part[at[row:stop]]), blobs], names=["part", "entries"])
        row = stop


def resolve_contexts(found: DataFrame, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Rows of FOUND and SOURCE: removed ranges, and the occurrences whose windows must be compared.

    `first` and `first_low` say where the bytes of a range stand first, if that was decided here and not inside a chunk.
    """

    def resolve(table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
        decided = entries[np.isin(entries["kind"], (REMOVED, SPREAD, CLASH))]
        compared = entries[entries["kind"] == COMPARE]
        order, source = _firsts(compared)
        compared = compared[order].copy()
        first = source == np.arange(len(source))
        later, origin = compared[~first], compared[source[~first]]
        clash = compared[:0] if _same_shape(later, origin) else later[:1].copy()
        clash["kind"] = CLASH
        at, n = _copied(later, origin)
        later, origin = later[at], origin[at]
        compared = compared[first]
        contexts = _contexts_per_key(compared)
        marked = np.isin(compared["key"], entries["key"][entries["kind"] == MARK])
        compared["kind"] = np.where(marked | (contexts > most_contexts), SPREAD, COMPARE)
        out = np.concatenate([decided, clash, compared[marked | (contexts > 1)]])
        nothing = pa.nulls(len(out), pa.int64())
        return pa.concat_tables([
            _found(out, out["kind"], out["n"]).append_column("first", nothing).append_column("first_low", nothing),
            _found(later, np.full(len(later), REMOVED), n)
            .append_column("first", pa.array(np.ascontiguousarray(origin["place"])))
            .append_column("first_low", pa.array(np.ascontiguousarray(origin["low"]))),
        ])

    return found.groupBy("part").applyInArrow(resolve, FOUND + SOURCE)


def _found(entries: np.ndarray, kind: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "kind": kind.astype(np.int32),
            "key": np.ascontiguousarray(entries["key"]).view(np.int64),
            "place": np.ascontiguousarray(entries["place"]),
            "low": np.ascontiguousarray(entries["low"]),
            "n": n.astype(np.int32),
            "at": entries["at"].astype(np.int32),
        }
    )


def copies_to_verify(found: DataFrame) -> DataFrame:
    """Rows of FOUND of kind VERIFY: each range that was removed by hashes alone, and each of their first occurrences, once."""
    copies = found.filter("first is not null")
    both = copies.select("place", "low", "n").unionByName(copies.selectExpr("first as place", "first_low as low", "n"))
    return both.distinct().selectExpr(f"{VERIFY} as kind", "0L as key", "place", "low", "n", "0 as at")


def collided(found: DataFrame, contexts: DataFrame) -> bool:
    """Whether equal hashes met different bytes anywhere."""
    if not found.filter(F.col("kind") == CLASH).isEmpty():
        return True
    digests = contexts.filter(F.col("kind") == VERIFY)
    own = digests.selectExpr("place", "low", "n", "bytes as own")
    theirs = digests.selectExpr("place as first", "low as first_low", "n", "bytes as theirs")
    copies = found.filter("first is not null").select("place", "low", "n", "first", "first_low")
    met = copies.join(own, ["place", "low", "n"], "left").join(theirs, ["first", "first_low", "n"], "left")
    return not met.filter(~F.coalesce(F.col("own") == F.col("theirs"), F.lit(False))).isEmpty()


def contexts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (FOUND) with the bytes of each context; of ranges of kind VERIFY the SHA-256 of their bytes."""
    asked = wanted.groupBy("place").agg(F.collect_list(F.struct("kind", "key", "low", "n", "at")).alias("asked"))
    both = docs.select("place", F.col("text").cast("string")).join(asked, "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", limit=HASH_PIECE):
            data, offsets = text_bytes(piece.column("text"))
            asked = piece.column("asked")
            fields = asked.flatten()
            row = np.repeat(np.arange(piece.num_rows), asked.value_lengths().to_numpy())
            low, n = fields.field("low").to_numpy(), fields.field("n").to_numpy()
            begin = offsets[row] + low
            raw = data.tobytes()
            verify = (fields.field("kind").to_numpy() == VERIFY).tolist()
            cuts = [
                hashlib.sha256(raw[a:b]).digest() if digest else raw[a:b]
                for a, b, digest in zip(begin.tolist(), (begin + n + WINDOW - 1).tolist(), verify)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(fields.field(c) for c in ("kind", "key")), piece.column("place").take(pa.array(row)),
                 *(fields.field(c) for c in ("low", "n", "at")), pa.array(cuts, pa.binary())],
                names=["kind", "key", "place", "low", "n", "at", "bytes"],
            )

    return both.mapInArrow(cut, FOUND + ", bytes binary")


class Suffixes:
    """Suffixes of contexts from their anchors on, compared through prefix hashes."""

    def __init__(self, contexts: list[bytes], at: np.ndarray, key: np.ndarray):
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, contexts), np.int64, len(contexts)))
        self.begin = ends - np.diff(np.append(0, ends))
        self.anchor = self.begin + at
        self.length = np.minimum(ends - self.anchor, WINDOW)
        self.key = key
        self.prefix = prefix_hashes(self.data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, by binary search over equal hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        a, b = self.anchor[i], self.anchor[j]
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            equal = span_hashes(self.prefix, a, a + middle) == span_hashes(self.prefix, b, b + middle)
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j: by key, then by bytes, a prefix first, then by number."""
        out = self.key[i] < self.key[j]
        same = np.flatnonzero(self.key[i] == self.key[j])
        a, b = i[same], j[same]
        shared = self.common(a, b)
        inside = (shared < self.length[a]) & (shared < self.length[b])
        last = max(len(self.data) - 1, 0)
        x = self.data[np.minimum(self.anchor[a] + shared, last)]
        y = self.data[np.minimum(self.anchor[b] + shared, last)]
        by_length = (self.length[a] < self.length[b]) | ((self.length[a] == self.length[b]) & (a < b))
        out[same] = np.where(inside, x < y, by_length)
        return out

    def sort(self) -> np.ndarray:
        """Mergesort, all merges of a level at once: each element's rank in the sibling run gives its place."""
        n = len(self.key)
        order, width = np.argsort(self.key, kind="stable"), 1
        while width < n:
            index = np.arange(n)
            run = index // width
            sibling = run ^ 1
            low = np.minimum(sibling * width, n)
            high = np.minimum(low + width, n)
            base = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                smaller = self.before(order[middle], order[open_])
                low[open_] = np.where(smaller, middle + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], middle)
            place = (run & ~1) * width + (index - run * width) + (low - base)
            merged = np.empty(n, np.int64)
            merged[place] = order
            order, width = merged, width * 2
        return order


def repeated_windows(
    contexts: list[bytes], key: np.ndarray, place: np.ndarray, low: np.ndarray, n: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(context, start within it) of each window that also stands earlier, in another of the contexts with its key."""
    suffixes = Suffixes(contexts, at, key)
    order = suffixes.sort()
    neighbours = suffixes.common(order[:-1], order[1:])
    neighbours = np.where(key[order[:-1]] == key[order[1:]], neighbours, -1)
    time = np.empty(len(order), np.int64)
    time[np.lexsort((low, place))] = np.arange(len(order))
    found_context, found_start = [], []
    for distance in range(int(at.max(initial=-1)) + 1):
        # windows that start `distance` bytes before the anchor and hold WINDOW - distance from it on
        run = np.concatenate([[0], np.cumsum(neighbours < WINDOW - distance)])
        start = at[order] - distance
        has = (start >= 0) & (start < n[order])
        who, run, start = order[has], run[has], start[has]
        anchor = suffixes.anchor[who]
        left = span_hashes(suffixes.prefix, anchor - distance, anchor)
        sorted_ = np.lexsort((time[who], left, run))
        who, run, left, start = who[sorted_], run[sorted_], left[sorted_], start[sorted_]
        new = np.ones(len(who), bool)
        new[1:] = (run[1:] != run[:-1]) | (left[1:] != left[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
        later = np.flatnonzero(~new)
        equal = _verified(suffixes, who[first[later]], who[later], distance)
        found_context.append(who[later[equal]])
        found_start.append(start[later[equal]])
        for k in later[~equal]:  # hashes met by chance: compare bytes with every earlier member
            group = who[first[k] : k]
            if _verified(suffixes, group, np.repeat(who[k], len(group)), distance).any():
                found_context.append(who[k : k + 1])
                found_start.append(start[k : k + 1])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found_context or empty), np.concatenate(found_start or empty)


def _verified(suffixes: Suffixes, one: np.ndarray, other: np.ndarray, distance: int) -> np.ndarray:
    """Whether the windows at `distance` before the anchors are equal byte by byte."""
    out = np.zeros(len(one), bool)
    view = np.lib.stride_tricks.sliding_window_view(suffixes.data, WINDOW) if len(suffixes.data) >= WINDOW else None
    for a in range(0, len(one), 20_000):
        x, y = one[a : a + 20_000], other[a : a + 20_000]
        out[a : a + 20_000] = (view[suffixes.anchor[x] - distance] == view[suffixes.anchor[y] - distance]).all(axis=1)
    return out


def compare_contexts(contexts: DataFrame, parts: int) -> DataFrame:
    """place, low, n: runs of window starts to be removed, from contexts of kind COMPARE."""

    def compare(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("key", "place", "low", "n", "at")}
        cuts = table.column("bytes").to_pylist()
        who, start = repeated_windows(cuts, *(column[c].astype(np.int64) for c in ("key", "place", "low", "n", "at")))
        return _starts_to_runs(column["place"][who], column["low"][who] + start)

    rows = contexts.filter(F.col("kind") == COMPARE).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    return rows.groupBy("part").applyInArrow(compare, "place long, low long, n int")


def _starts_to_runs(place: np.ndarray, start: np.ndarray) -> pa.Table:
    order = np.lexsort((start, place))
    place, start = place[order], start[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(place))).astype(np.int32)
    return pa.table({"place": place[first].astype(np.int64), "low": start[first].astype(np.int64), "n": n})


def spread_windows(contexts: DataFrame) -> DataFrame:
    """place, low, n (1): windows to be removed, from contexts of kind SPREAD; an aggregation by the window's bytes."""
    rows = contexts.filter(F.col("kind") == SPREAD).select("place", F.posexplode(F.expr(
        f"transform(sequence(1, n), i -> substring(bytes, i, {WINDOW}))")).alias("start", "window"), "low")
    rows = rows.select("window", "place", (F.col("low") + F.col("start")).alias("low"))
    first = rows.groupBy("window").agg(F.min(F.struct("place", "low")).alias("first"), F.count("*").alias("times"))
    later = rows.join(first.filter("times > 1"), "window").filter(F.struct("place", "low") != F.col("first"))
    return later.select("place", "low", F.lit(1).alias("n"))


def repeated_ranges(
    docs: DataFrame,
    chunk_contexts: int = CHUNK_CONTEXTS,
    most_contexts: int = MOST_CONTEXTS,
    context_bits: int = CONTEXT_BITS,
) -> DataFrame:
    """place, low, n: runs of window starts whose windows also start earlier. `docs`: place (unique), text.

    `context_bits` are those of the first search; one that met a collision is done again with other hashes of 64 bits.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    at_least = PARTS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(at_least, -(-size // PART_BYTES))
    seed = 0
    while True:
        entries = find_occurrences(docs, parts, chunk_contexts, seed, context_bits)
        found = cut_lineage(resolve_contexts(entries, most_contexts))
        compared = found.filter(F.col("kind").isin(COMPARE, SPREAD)).drop("first", "first_low")
        contexts = cut_lineage(contexts_of(docs, compared.unionByName(copies_to_verify(found))))
        if not collided(found, contexts):
            break
        drop_steps(found, contexts)
        seed, context_bits = seed + 1, CONTEXT_BITS
    decided = found.filter(F.col("kind") == REMOVED).select("place", "low", "n")
    return decided.unionByName(compare_contexts(contexts, parts)).unionByName(spread_windows(contexts))


def remove_repeats(
    docs: DataFrame, digest: bool = False, chunk_contexts: int = CHUNK_CONTEXTS, most_contexts: int = MOST_CONTEXTS
) -> DataFrame:
    """`docs` without the bytes that repeat earlier ones.

    All columns are kept; `text` loses its repeats, and a character that lost some of its bytes loses the rest. With `digest`:
    doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes) instead.
    """
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*by_name(["doc_id"] if digest else others)).alias("_row")
    rows = numbered(docs.select(row, F.col("doc_id").cast("long"), F.col("text").cast("string")))
    ranges = repeated_ranges(rows, chunk_contexts, most_contexts)
    gathered = ranges.groupBy("place").agg(F.collect_list(F.struct("low", "n")).alias("ranges"))
    both = rows.join(gathered, "place", "left").select("_row", "doc_id", "text", "ranges")
    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        if digest
        else rows.select("_row", "text").schema
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", limit=HASH_PIECE):
            data, offsets = text_bytes(piece.column("text"))
            ranges = piece.column("ranges")
            fields = ranges.flatten()
            lengths = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            begin = np.repeat(offsets[:-1], lengths) + fields.field("low").to_numpy()
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + fields.field("n").to_numpy() + WINDOW - 1, -1)
            kept = np.cumsum(edge[:-1]) == 0
            if digest:
                yield _digest(piece.column("doc_id"), data, offsets, kept)
            else:
                texts = [
                    None if null else data[a:b][kept[a:b]].tobytes().decode("utf-8", "ignore")
                    for a, b, null in zip(offsets[:-1], offsets[1:], piece.column("text").is_null().to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([piece.column("_row"), pa.array(texts, pa.string())], names=["_row", "text"])

    done = both.mapInArrow(apply, schema)
    return done if digest else done.select("_row.*", "text").select(*by_name(docs.columns))


def _digest(doc_id: pa.Array, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
    removed = np.concatenate([[0], np.cumsum(~kept)])
    begins = ~kept
    begins[1:] &= kept[:-1] | np.isin(np.arange(1, len(kept)), offsets)
    spans = np.concatenate([[0], np.cumsum(begins)])
    a, b = offsets[:-1], offsets[1:]
    hashes = [hashlib.sha256(data[x:y][kept[x:y]].tobytes()).hexdigest() for x, y in zip(a, b)]
    return pa.RecordBatch.from_arrays(
        [doc_id.cast(pa.int64()), pa.array(b - a), pa.array(removed[b] - removed[a]), pa.array(spans[b] - spans[a]), pa.array(hashes, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )
