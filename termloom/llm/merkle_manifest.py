"""Merkle manifest of a dataset: a postorder append log of digests, with proofs read at positions known in closed form.

Digests are lowercase hex SHA-256 over concatenated inputs, digests as hex text. A row's leaf is the digest of its `FIELDS`,
each as "-" if null, else its UTF-8 byte count, ":" and the value. The leaves of one lang form a tree in ascending order of
doc_id; on each level every two consecutive nodes, or a lone last one, become their digest, until one node is left, the
subroot. Subroots, ordered by lang (null first, then bytewise), form the tree of the root in the same way.

1. Leaves come from DataFrame functions; only digests and ids are shuffled from there on. A leaf's place in its tree comes
   from a sort by ranges and the row counts of the ranges, so no task sees a whole lang.
2. Builders take aligned blocks of 2 ** BITS nodes and write the nodes they complete in completion order, that is in
   postorder: after leaf e the nodes that end at e, from the lowest level up. The roots of the blocks are the leaves of the
   next round, so there are log(n) / BITS rounds. A segment of the log is one row: tree, round, block, the digests.
3. With subtrees complete but for the right edge, the subtree of a node whose last leaf is e holds all nodes that ended
   before, and the node of level l that ends at leaf e stands at position 2 e - popcount(e) + l. `positions` gives it, so a
   proof is read by addressing siblings; nothing is searched.
4. Proofs go down the same rounds: a block's proof is what its root needs above it, and inside a block the siblings are read
   from the segment. Each leaf's proof is the siblings of its levels, then those of its subroot.

Defined cases: a null doc_id comes first; rows of one doc_id are ordered by their leaves, identical rows are leaves each; null
and empty texts differ ("-" and "0:"); a tree of one leaf is that leaf; an empty table gives no rows. Missing fields are an
error, further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 10
DIGEST = 32
SEGMENT = "tree long, block long, nodes long, leaves long, log binary"


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(row: dict[str, Column]) -> Column:
    """The leaf, as binary, of the values of FIELDS."""
    return F.unhex(F.sha2(F.concat(*[_encoded(row[name]) for name in FIELDS]), 256))


def combine(nodes: list[bytes]) -> bytes:
    """The digest of a node whose children are `nodes`."""
    return hashlib.sha256("".join([n.hex() for n in nodes]).encode()).digest()


def tree_height(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def positions(place: np.ndarray | int, level: int, leaves: int) -> np.ndarray:
    """Position in the postorder log of node number `place` of `level`, in a tree of `leaves` leaves."""
    last = np.minimum((np.asarray(place, np.int64) + 1) << level, leaves) - 1
    return 2 * last - np.bitwise_count(last).astype(np.int64) + level


def grow(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of the levels 0 to `height` over `leaves`, in completion order; the right edge rises to `height`."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(height + 1)]
    for e, node in enumerate(leaves):
        for level in range(height + 1):
            log.append(node)
            waiting[level].append(node)
            if level == height or (len(waiting[level]) < 2 and e < len(leaves) - 1):
                break
            node = combine(waiting[level])
            waiting[level] = []
    return log


def siblings_in(log: bytes, leaves: int, height: int) -> list[list[bytes]]:
    """For each leaf of a segment, the siblings on its way up, read at their positions in the log."""
    found: list[list[bytes]] = [[] for _ in range(leaves)]
    for level in range(height):
        count = -(-leaves >> level)
        sibling = (np.arange(leaves) >> level) ^ 1
        at = (positions(np.minimum(sibling, count - 1), level, leaves) * DIGEST).tolist()
        for leaf in np.flatnonzero(sibling < count).tolist():
            found[leaf].append(log[at[leaf] : at[leaf] + DIGEST])
    return found


def fold(node: bytes, place: int, leaves: int, siblings: Iterator[bytes]) -> bytes:
    """The root that follows from a leaf, its place in a tree of `leaves` leaves, and its siblings from below."""
    while leaves > 1:
        if place ^ 1 < leaves:
            other = next(siblings)
            node = combine([other, node] if place & 1 else [node, other])
        else:
            node = combine([node])
        place, leaves = place >> 1, (leaves + 1) >> 1
    return node


def place_leaves(rows: DataFrame) -> DataFrame:
    """`rows` (lang, doc_id, digest, number, ...) with tree (number of the lang in order), place in its tree and nodes (leaves
    of that tree). `number` is unique."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "digest", "number"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = cut_lineage(ranged.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    langs = counts.groupBy("lang").agg(F.sum("rows").alias("nodes"))
    langs = numbered(langs, [F.col("lang").asc_nulls_first()], "tree")
    start = cut_lineage(
        before.alias("b").join(langs.alias("l"), F.expr("b.lang <=> l.lang")).selectExpr("b.lang", "part", "before - first as shift", "nodes", "tree")
    )
    found = ranged.alias("r").join(start.alias("s"), F.expr("r.part = s.part and r.lang <=> s.lang"))
    return found.select(*[f"r.{c}" for c in rows.columns], "tree", (F.col("at") + F.col("shift")).alias("place"), "nodes")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """`rows` with their number from 0 in `order`, from the row counts of ranges."""
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = cut_lineage(ranged)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return ranged.join(before, "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


@dataclass(frozen=True)
class Log:
    """The log of many trees: per round a table of segments (SEGMENT), and the roots (tree, digest)."""

    rounds: list[DataFrame]
    roots: DataFrame
    bits: int

    def nodes(self) -> DataFrame:
        """Every node of the log: tree, level, place, position (in the log of its tree), digest."""
        bits = self.bits
        whole = None
        for number, segments in enumerate(self.rounds):

            def spread(batches: Iterator[pa.RecordBatch], number: int = number) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for s in batch.to_pylist():
                        height = min(bits, tree_height(s["nodes"]))
                        for level in range(1 if number else 0, height + 1):
                            inside = np.arange(-(-s["leaves"] >> level))
                            place = (s["block"] << (bits - level)) + inside
                            log = [s["log"][p : p + DIGEST] for p in (positions(inside, level, s["leaves"]) * DIGEST).tolist()]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([x] * len(inside), pa.int64()) for x in (s["tree"], level + number * bits)]
                                + [pa.array(place), pa.array(log, pa.binary())],
                                names=["tree", "level", "place", "digest"],
                            )

            found = segments.mapInArrow(spread, "tree long, level long, place long, digest binary")
            whole = found if whole is None else whole.unionByName(found)
        leaves = self.rounds[0].groupBy("tree").agg(F.max("nodes").alias("leaves"))
        last = F.expr("least(shiftleft(place + 1, cast(level as int)), leaves) - 1")
        position = 2 * last - F.bit_count(last) + F.col("level")
        return whole.join(leaves, "tree").select("tree", "level", "place", position.alias("position"), "digest")


def write_log(leaves: DataFrame, bits: int = BITS) -> Log:
    """Build the trees of `leaves` (tree, place, nodes, digest), round by round; each round is a written table."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        nodes = int(block["nodes"].iloc[0])
        log = b"".join(grow([bytes(d) for d in block["digest"]], min(bits, tree_height(nodes))))
        return pd.DataFrame(
            {"tree": block["tree"].iloc[:1], "block": block["block"].iloc[:1], "nodes": nodes, "leaves": len(block), "log": [log]}
        )

    rounds: list[DataFrame] = []
    top = F.substring("log", -DIGEST, DIGEST).alias("digest")
    level = leaves.select("tree", "place", "nodes", "digest")
    largest = leaves.agg(F.coalesce(F.max("nodes"), F.lit(0))).first()[0]
    while True:
        blocks = level.withColumn("block", F.shiftright("place", bits)).groupBy("tree", "block")
        segments = cut_lineage(blocks.applyInPandas(build, SEGMENT))
        rounds.append(segments)
        if largest <= 1 << bits:
            break
        largest = -(-largest >> bits)
        above = F.shiftright(F.col("nodes") - 1, bits) + 1
        level = segments.filter(F.col("nodes") > 1 << bits).select("tree", F.col("block").alias("place"), above.alias("nodes"), top)
    roots = [s.filter(F.col("nodes") <= 1 << bits).select("tree", top) for s in rounds]
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.unionByName(more)
    return Log(rounds, cut_lineage(whole), bits)


def segments_with_proofs(log: Log, tops: DataFrame) -> DataFrame:
    """The segments of the first round with `above`, the siblings that the root of the segment needs, from below.

    `tops`: tree, above (what the root of the tree needs) and further columns, which are kept.
    """
    bits = log.bits
    kept = [c for c in tops.columns if c not in ("tree", "above")]
    handed = None
    for number in range(len(log.rounds) - 1, -1, -1):
        segments = log.rounds[number]
        here = segments.filter(F.col("nodes") <= 1 << bits).join(tops, "tree")
        if handed is not None:
            here = here.unionByName(segments.join(handed, ["tree", "block"]))
        if not number:
            return here

        def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, s in enumerate(batch.to_pylist()):
                    height = min(bits, tree_height(s["nodes"]))
                    found = [b"".join(f) + s["above"] for f in siblings_in(s["log"], s["leaves"], height)]
                    columns = [pa.array([s["tree"]] * len(found), pa.int64())]
                    columns.append(pa.array((s["block"] << bits) + np.arange(len(found))))
                    columns.append(pa.array(found, pa.binary()))
                    columns += [pa.array([s[c]] * len(found), batch.schema.field(c).type) for c in kept]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "above", *kept])

        types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in tops.select(*kept).schema)
        handed = here.mapInArrow(hand_down, f"tree long, block long, above binary{types}")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, bits: int = BITS) -> tuple[DataFrame, Log, Log]:
    """Leaves (doc_id, tree, place, nodes, digest, claimed), the log of the langs' trees and the log of the root's tree.

    `claimed` is the leaf with the columns `changed` over FIELDS put in place of the row's own.
    """
    own = {name: F.col(f"`{name}`") for name in FIELDS}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        leaf_digest(own).alias("digest"),
        leaf_digest(own | (changed or {})).alias("claimed"),
        F.monotonically_increasing_id().alias("number"),
    )
    leaves = cut_lineage(place_leaves(cut_lineage(rows)).drop("number", "lang"))
    log = write_log(leaves, bits)
    count = log.roots.count()
    top = log.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("long").alias("nodes"), "digest")
    return leaves, log, write_log(top, bits)


def proofs(docs: DataFrame, changed: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot, root, proof (siblings from below, 32 bytes each), proof_sha256, folded_root
    (from the claimed leaf and the proof) and verified (it equals root)."""
    leaves, log, top = manifest(docs, changed, bits)
    whole = top.roots.select("digest").first()
    schema = (
        "doc_id long, leaf string, subroot string, root string, proof binary, proof_sha256 string, folded_root string, verified boolean"
    )
    if not whole:
        return docs.sparkSession.createDataFrame([], schema)
    root, langs = bytes(whole[0]), log.roots.count()
    above = segments_with_proofs(top, top.roots.select("tree", F.lit(b"").alias("above")))

    def lang_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                found = siblings_in(s["log"], s["leaves"], min(bits, tree_height(s["nodes"])))
                place = (s["block"] << bits) + np.arange(len(found))
                up = [b"".join(f) + s["above"] for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(up, pa.binary())], names=["tree", "above"])

    tops = above.mapInArrow(lang_proofs, "tree long, above binary").join(log.roots.withColumnRenamed("digest", "subroot"), "tree")
    segments = segments_with_proofs(log, tops)

    def extract(rows: pa.Table, segment: pa.Table) -> pa.Table:
        s = segment.to_pylist()[0]
        nodes, tree, above = s["nodes"], s["tree"], s["above"]
        inside = siblings_in(s["log"], s["leaves"], min(bits, tree_height(nodes)))
        up = [above[i : i + DIGEST] for i in range(0, len(above), DIGEST)]
        out: list[tuple] = []
        places, leaf, claimed = (rows.column(c).to_pylist() for c in ("place", "digest", "claimed"))
        for place, claim in zip(places, claimed):
            own = inside[place & ((1 << bits) - 1)] + up
            rest = iter(own)
            folded = fold(fold(claim, place, nodes, rest), tree, langs, rest)
            out.append((b"".join(own), combine(own).hex(), folded.hex(), folded == root))
        proof, proof_sha256, folded, verified = (list(c) for c in zip(*out))
        columns = [rows.column("doc_id"), [d.hex() for d in leaf], [s["subroot"].hex()] * len(out), [root.hex()] * len(out)]
        return pa.Table.from_arrays(
            [pa.array(c) if isinstance(c, list) else c for c in columns]
            + [pa.array(proof, pa.binary()), pa.array(proof_sha256), pa.array(folded), pa.array(verified)],
            names=["doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"],
        )

    blocks = leaves.withColumn("block", F.shiftright("place", bits)).drop("nodes")
    return blocks.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInArrow(extract, schema)
