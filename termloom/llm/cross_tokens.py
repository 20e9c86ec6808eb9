"""Cross-tokenizer alignment by products of token-byte incidence matrices in hand-built CSR.

A text has two token sequences over the same bytes, a space and the text: A by a byte-level `tokenizers` file, B by a
`sentencepiece` model, which adds the space itself. Names of special tokens in a text are ordinary text.

1. A slice of texts gives two incidence matrices, tokens x bytes, built as CSR from the lengths of the tokens' bytes. Row
   products A . B^T (Gustavson: each entry of a row of A brings its row of B^T, equal columns are summed) give the overlap
   links, valued with the number of shared bytes; a link ends together if both its tokens end at the same byte.
2. Bytes at which tokens of both end cut the tokens into groups. The product of the incidence matrices tokens x groups gives
   the links within shared groups.
3. How many end links of the corpus hold an id pair is counted over blocks of BLOCK_BYTES of text: a block's links become
   places in its list of distinct pairs, so a pair leaves a block once, whatever its texts, and only the lists are shuffled by
   pair. The counts go back to the block, and the sums of each document are taken there. The highest count of each B id is a
   table no longer than B's vocabulary, which is broadcast.

Defined cases: texts that are null, empty, or whose tokens' bytes differ from the space and the text (such as those that hold
U+2581) have no tokens: zeros, '' as groups_sha256, no links; repeated rows are rows each; a null doc_id stays null; an empty
table gives no rows. Further columns are not read, whatever their names. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.bpe import ChunkCache, encoder
from termloom.llm.textbytes import pieces, ragged, text_bytes
from termloom.session import cut_lineage

BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 19
EXPANDED = 4 << 20
PER_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


@dataclass(frozen=True)
class CSR:
    """A sparse matrix by rows: the entries of row i are at indptr[i] to indptr[i + 1], columns ascending."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def incidence(columns_of: np.ndarray, lengths: np.ndarray, columns: int) -> CSR:
    """Ones at the columns of each row; row i has lengths[i] of them."""
    return CSR(np.concatenate([[0], np.cumsum(lengths)]), columns_of, np.ones(len(columns_of), np.int32), columns)


def transposed(m: CSR) -> CSR:
    order = np.argsort(m.indices, kind="stable")
    counts = np.bincount(m.indices, minlength=m.columns)
    return CSR(np.concatenate([[0], np.cumsum(counts)]), m.rows[order], m.data[order], len(m.indptr) - 1)


def product(a: CSR, b: CSR, expanded: int = EXPANDED) -> CSR:
    """a . b by rows: each entry of a row of `a` brings its row of `b`; about `expanded` products are held at once."""
    brought = np.diff(b.indptr)[a.indices]
    ends = np.concatenate([[0], np.cumsum(brought)])[a.indptr]
    parts: list[tuple[np.ndarray, ...]] = []
    row, last = 0, len(a.indptr) - 1
    while row < last:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + expanded, side="right")) - 1)
        at = slice(a.indptr[row], a.indptr[stop])
        n, entries = brought[at], a.indices[at]
        source = ragged(b.indptr[:-1][entries], n)
        rows = np.repeat(np.repeat(np.arange(row, stop), np.diff(a.indptr[row : stop + 1])), n)
        columns, values = b.indices[source], np.repeat(a.data[at], n) * b.data[source]
        key = rows * b.columns + columns
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, rows, columns, values = key[order], rows[order], columns[order], values[order]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            parts.append((rows[first], columns[first], np.add.reduceat(values, first)))
        row = stop
    empty = np.zeros(0, np.int64)
    rows, columns, values = (np.concatenate(p) for p in zip(*parts)) if parts else (empty, empty, empty)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=last))])
    return CSR(indptr, columns, values, b.columns)


class Vocabulary:
    """The bytes of every id: those of id i are pool[starts[i]:starts[i] + lengths[i]]."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.starts[ids], self.lengths[ids])]


@functools.cache
def pair_of(path_a: str, path_b: str) -> "Pair":
    """The worker's tokenizers; Python workers are reused."""
    return Pair(path_a, path_b)


class Pair:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = encoder(path_a, "words", names=False)
        shown = {character: byte for byte, character in self.a.alphabet.items()}
        whole = self.a.tokenizer.get_vocab()
        entries = [b""] * (max(whole.values()) + 1)
        for entry, i in whole.items():
            entries[i] = bytes(shown[ord(c)] if ord(c) in shown else ord(c) for c in entry)
        self.bytes_a = Vocabulary(entries)
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b = PieceEncoder(model)
        self.bytes_b = Vocabulary(
            [
                bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
                for i in range(model.vocab_size())
            ]
        )


class PieceEncoder(ChunkCache):
    """Ids of a space and a text by a `sentencepiece` model, which adds that space.

    Where no piece has its space mark behind another character, no piece reaches from one run of spaces with the word behind it
    into the next, so each such chunk is encoded once per worker. Other models see whole texts.
    """

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.closed = not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.vocab_size()))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`data`: the bytes of a space and its text, text by text; all ids and the offsets of each text's first id."""
        cuts = np.zeros(len(data) + 1, bool)
        cuts[offsets] = True
        if self.closed:
            space = data == 32
            cuts[1:-1] |= space[1:] & ~space[:-1]
        return self.ids_of(data, offsets, np.flatnonzero(cuts[:-1]))

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        alone = [self.model.piece_to_id("▁")]
        return [alone if c == " " and self.closed else ids for c, ids in zip(chunks, found)]


class Aligned:
    """The tokens of a text column that both sides can spell; `offsets_a`, `offsets_b` are the first token of each text."""

    def __init__(self, column: pa.Array, pair: Pair):
        text = pc.fill_null(column.cast(pa.large_string()), "")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))
        data, byte_offsets = text_bytes(spaced)
        ids_a, offsets_a = pair.a.encode(spaced)
        ids_b, offsets_b = pair.b.encode(data, byte_offsets)
        ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        good = np.diff(byte_offsets) > 1
        for ids, offsets, words in ((ids_a, offsets_a, pair.bytes_a), (ids_b, offsets_b, pair.bytes_b)):
            good &= _spell(ids, offsets, words, data, byte_offsets)
        self.ids_a, self.offsets_a = _only(ids_a, offsets_a, good)
        self.ids_b, self.offsets_b = _only(ids_b, offsets_b, good)
        self.length_a, self.length_b = pair.bytes_a.lengths[self.ids_a], pair.bytes_b.lengths[self.ids_b]
        self.end_a, self.end_b = np.cumsum(self.length_a), np.cumsum(self.length_b)
        self.size = int(self.end_a[-1]) if len(self.end_a) else 0
        self.common = np.intersect1d(self.end_a, self.end_b, assume_unique=True)
        self.group_a, self.group_b = (np.searchsorted(self.common, e) for e in (self.end_a, self.end_b))

    def overlap(self) -> CSR:
        """A . B^T: for each A token the B tokens it shares bytes with, and how many."""
        every = np.arange(self.size)
        return product(incidence(every, self.length_a, self.size), transposed(incidence(every, self.length_b, self.size)))

    def shared_groups(self) -> CSR:
        """For each A token the B tokens of its group."""
        one_a, one_b = np.ones(len(self.ids_a), np.int64), np.ones(len(self.ids_b), np.int64)
        groups = len(self.common)
        return product(incidence(self.group_a, one_a, groups), transposed(incidence(self.group_b, one_b, groups)))

    def ending_together(self) -> tuple[np.ndarray, np.ndarray]:
        """A and B tokens of the overlap links whose byte ranges end together."""
        overlap = self.overlap()
        a, b = overlap.rows, overlap.indices
        together = self.end_a[a] == self.end_b[b]
        return a[together], b[together]

    def group_texts(self) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;a3|b2,b3` of all texts one behind the other, a mark after each, and where each text's begins."""
        n_a, n_b = len(self.ids_a), len(self.ids_b)
        groups = len(self.common)
        of_a, of_b = (np.bincount(g, minlength=groups) for g in (self.group_a, self.group_b))
        place = np.empty(n_a + n_b, np.int64)
        place[:n_a] = np.arange(n_a) + (np.cumsum(of_b) - of_b)[self.group_a]
        place[n_a:] = np.arange(n_b) + np.cumsum(of_a)[self.group_b]
        ids, marks = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[place] = np.concatenate([self.ids_a, self.ids_b])
        marks[place[np.cumsum(of_a) - 1]] = ord("|")
        marks[place[n_a + np.cumsum(of_b) - 1]] = ord(";")
        digits = _decimals(int(ids.max()) + 1 if len(ids) else 1)
        lengths = digits.lengths[ids] + 1
        ends = np.cumsum(lengths)
        written = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        inside = np.ones(len(written), bool)
        inside[ends - 1] = False
        written[inside] = digits.bytes_of(ids)
        written[ends - 1] = marks
        return written.tobytes(), np.concatenate([[0], ends])[self.offsets_a + self.offsets_b]


@functools.lru_cache(maxsize=4)
def _decimals(count: int) -> Vocabulary:
    return Vocabulary([b"%d" % i for i in range(count)])


def _spell(ids: np.ndarray, offsets: np.ndarray, words: Vocabulary, data: np.ndarray, byte_offsets: np.ndarray) -> np.ndarray:
    """Whether the tokens of each text spell its bytes."""
    spelled = words.bytes_of(ids)
    ends = np.concatenate([[0], np.cumsum(words.lengths[ids])])[offsets]
    good = np.diff(ends) == np.diff(byte_offsets)
    if good.all() and np.array_equal(spelled, data):
        return good
    for i in np.flatnonzero(good):
        good[i] = np.array_equal(spelled[ends[i] : ends[i + 1]], data[byte_offsets[i] : byte_offsets[i + 1]])
    return good


def _only(ids: np.ndarray, offsets: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(offsets)
    return ids[np.repeat(good, lengths)], np.concatenate([[0], np.cumsum(np.where(good, lengths, 0))])


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignment_links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap") -> DataFrame:
    """All links of each document: doc_id, a_index, b_index (tokens from 0), a_id, b_id and shared.

    `kind` overlap: tokens that share bytes, with their number; end: those that also end together; group: tokens of one group.
    """
    if kind not in ("overlap", "end", "group"):
        raise ValueError(f"unknown kind of links: {kind}")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for piece in pieces(batches, "text", limit=SLICE_BYTES):
            found = Aligned(piece.column("text"), pair)
            links = found.shared_groups() if kind == "group" else found.overlap()
            a, b, shared = links.rows, links.indices, links.data
            if kind == "end":
                together = found.end_a[a] == found.end_b[b]
                a, b, shared = a[together], b[together], shared[together]
            row = np.searchsorted(found.offsets_a, a, side="right") - 1
            columns = [a - found.offsets_a[row], b - found.offsets_b[row], found.ids_a[a], found.ids_b[b], shared]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(row)), *(pa.array(c.astype(np.int64)) for c in columns)],
                names=["doc_id", "a_index", "b_index", "a_id", "b_id", "shared"],
            )

    return _text_rows(docs).mapInArrow(link, "doc_id long, a_index long, b_index long, a_id long, b_id long, shared long")


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: PER_DOCUMENT, n_best (end links whose corpus-wide count is the highest of their B id) and count_sum.

    Blocks are written once, so their numbers are those of the attempt that was kept.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        width = len(pair.bytes_b.lengths)
        block = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        held = 0
        for piece in pieces(batches, "text", limit=min(block_bytes, SLICE_BYTES)):
            found = Aligned(piece.column("text"), pair)
            a, b = found.ending_together()
            links = np.searchsorted(a, found.offsets_a)
            text, at = found.group_texts()
            at = at.tolist()
            sums = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]
            groups = np.diff(np.searchsorted(found.common, np.concatenate([[0], found.end_a])[found.offsets_a], side="right"))
            counts = [np.diff(found.offsets_a), np.diff(found.offsets_b), groups, np.diff(links)]
            waiting.append((piece.column("doc_id"), counts, sums, found.ids_a[a] * width + found.ids_b[b]))
            held += found.size
            if held >= block_bytes:
                yield from _block(block, waiting)
                block, waiting, held = block + 1, [], 0
        if waiting:
            yield from _block(block, waiting)

    schema = f"block long, {PER_DOCUMENT}, links array<int>, pairs array<long>, times array<int>"
    blocks = cut_lineage(_text_rows(docs).mapInArrow(read, schema))
    rows = blocks.filter("pairs is null").drop("pairs", "times")
    listed = blocks.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "e"))
    width = len(pair_of(path_a, path_b).bytes_b.lengths)
    pair = F.col("e.pairs")
    counted = listed.select("block", "at", pair.alias("pair"), (pair % width).alias("b"), F.col("e.times").cast("long").alias("times"))
    counted = counted.withColumn("n", F.sum("times").over(Window.partitionBy("pair")))
    counted = cut_lineage(counted.select("block", "at", "b", "n"))
    best = counted.groupBy("b").agg(F.max("n").alias("most"))  # at most a row per id of B
    answers = counted.join(F.broadcast(best), "b").select("block", "at", "n", (F.col("n") == F.col("most")).alias("best"))

    def add_up(own: pa.Table, told: pa.Table) -> pa.Table:
        at = told.column("at").to_numpy()
        n, top = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], top[at] = told.column("n").to_numpy(), told.column("best").to_numpy(zero_copy_only=False)
        lists = own.column("links").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        places = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        sums = [np.concatenate([[0], np.cumsum(x[places])]) for x in (top, n)]
        n_best, count_sum = (pa.array(s[offsets[1:]] - s[offsets[:-1]]) for s in sums)
        own = own.drop_columns(["block", "links"])
        return own.append_column("n_best", n_best).append_column("count_sum", count_sum)

    schema = f"{PER_DOCUMENT}, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)


def _block(block: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of a block's documents, with their links as places in the block's pairs, and the row of its pairs."""
    pairs, places, times = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True, return_counts=True)
    fields = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "times"]
    done = 0
    for doc_id, counts, sums, keys in parts:
        rows, n = len(doc_id), np.concatenate([[0], np.cumsum(counts[3])])
        links = pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(places[done : done + len(keys)].astype(np.int32)))
        done += len(keys)
        columns = [pa.array(np.full(rows, block)), doc_id.cast(pa.int64()), *(pa.array(c.astype(np.int64)) for c in counts)]
        nulls = [pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.string()), links, *nulls], names=fields)
    lists = [pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int32()))]
    numbers = [pa.nulls(1, pa.int64())] * 5
    empty = [pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays([pa.array([block]), *numbers, *empty, *lists], names=fields)
