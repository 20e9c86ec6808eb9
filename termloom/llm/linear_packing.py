"""Packing of token pieces into sequences of at most `capacity` tokens by linear grouping.

1. Documents become pieces of at most `capacity` tokens; only longer documents are cut.
2. Lengths are counted. There are at most `capacity` different ones, whatever the number of documents, so the counts, and
   the plan made from them, are small. The plan is made on the driver:
   a. large lengths, sorted, form groups of equal cardinality, each rounded up to its largest length and then to a
      multiple of `UNIT`, which keeps the knapsacks of the next step short;
   b. configurations of these few sizes are optimised by column generation on the fractional problem, rounded down;
   c. actual lengths take the slots of their group, largest first, so a sequence holds at most what its configuration says;
   d. what is left, large remainders first and then small lengths, goes by best fit into what room the sequences have.
   Where large lengths begin is a parameter with a few values; the plan with the fewest sequences is taken.
   The plan is a list of runs: pieces number a to b of a length go to sequences number s, s+1, ..., at one offset.
3. Each piece finds its run by its rank among the pieces of its length. Ranks come from counts per task and length and
   their running sums, so no length is ever gathered in one task.

Defined cases: an empty or null text is one piece holding the end id; repeated rows are packed each; a null doc_id keeps
its null; an empty table gives no rows. Sequence numbers are dense from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.bpe import encoder
from termloom.llm.textbytes import SMALL_PIECE, pieces, ragged
from termloom.llm.token_files import crc32_of_runs
from termloom.session import cut_lineage

CAPACITY = 2048
GROUPS = 40
UNIT = 4
LARGE_SHARES = (1 / 2, 1 / 3, 1 / 8)
ROUNDS = 12


def cut_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, cut: str = "words", keep_ids: bool = False
) -> DataFrame:
    """Pieces of every text's ids and `end_id`: doc_id, piece, start, length, ids_crc32 (ids, where kept).

    Further columns `task` and `rank` number the pieces of equal length within each task. The first piece of a cut document
    is the short one. Write the result before use: the numbering holds for one run of the tasks.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, cut)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, "text", limit=SMALL_PIECE):
            ids, offsets = coder.encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], np.uint32(end_id))
            offsets = offsets + np.arange(len(offsets))
            totals = np.diff(offsets)
            n = -(-totals // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = ragged(np.zeros(len(n), np.int64), n)
            head = totals - (n - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            bounds = np.append(offsets[row] + start, len(ids))
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            within = np.arange(len(order)) - np.searchsorted(ordered, ordered)
            rank = np.empty(len(order), np.int64)
            rank[order] = within + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc32_of_runs(ids, bounds)),
                "task": pa.array(np.full(len(row), task)),
                "rank": pa.array(rank),
            }
            if keep_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"
    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(encode, schema + (", ids array<int>" if keep_ids else ""))


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """`cut` (a written table with length, task and rank) with sequence_id and offset instead of task and rank."""
    per_task = cut_lineage(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    before = Window.partitionBy("length").orderBy("task")
    firsts = per_task.select("task", "length", (F.sum("n").over(before) - F.col("n")).alias("_first"))
    ranked = cut.join(firsts, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("_first"))
    ranked = ranked.drop("task", "_first")
    runs = cut.sparkSession.sparkContext.broadcast(plan_runs(counts, capacity, groups))
    names = [f.name for f in ranked.schema.fields if f.name != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, base, offset = runs.value
        key = length * SPAN + first
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            run = np.searchsorted(key, batch.column("length").to_numpy() * SPAN + rank, side="right") - 1
            sequence = pa.array(base[run] + rank - first[run])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), sequence, pa.array(offset[run])], names=[*names, "sequence_id", "offset"]
            )

    out = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, out)


SPAN = np.int64(1) << np.int64(50)


def plan_runs(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Runs for `counts[length]` pieces of each length, as rows length, first rank, count, first sequence, offset.

    Rows are sorted by length and first rank. Every piece is in one run, and no sequence holds more than `capacity`.
    """
    plans = [_Plan(counts, capacity) for _ in LARGE_SHARES]
    for plan, share in zip(plans, LARGE_SHARES):
        sizes, members = plan.group_large(groups, share)
        if len(sizes):
            demand = np.array([sum(n for _, n in m) for m in members], dtype=np.int64)
            for configuration, times in _configurations(-(-sizes // UNIT), demand, capacity // UNIT):
                plan.fill(configuration, times, members)
        plan.best_fit()
    plan = min(plans, key=lambda p: p.next_sequence)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)
    return runs.T.copy()


class _Plan:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        self.left = counts.astype(np.int64).copy()
        self.next_rank = np.zeros(len(counts), np.int64)
        self.next_sequence = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = {}

    def group_large(self, groups: int, share: float) -> tuple[np.ndarray, list[list[list[int]]]]:
        """Rounded sizes, largest first, and the actual lengths with counts of each group, largest first.

        Pieces of full capacity take a sequence each and are placed at once.
        """
        full = int(self.left[self.capacity])
        if full:
            self._emit(self.capacity, full, self.next_sequence, 0)
            self.next_sequence += full
        lengths = [x for x in range(self.capacity - 1, int(self.capacity * share), -1) if self.left[x]]
        total = int(self.left[lengths].sum()) if lengths else 0
        if not total:
            return np.zeros(0, np.int64), []
        size = max(1, -(-total // groups))
        members: list[list[list[int]]] = [[]]
        room = size
        for length in lengths:
            n = int(self.left[length])
            while n:
                if not room:
                    members.append([])
                    room = size
                k = min(n, room)
                members[-1].append([length, k])
                room -= k
                n -= k
        return np.array([m[0][0] for m in members], np.int64), members

    def _emit(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.next_rank[length]), n, sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def fill(self, configuration: list[int], times: int, members: list) -> None:
        """`times` sequences, each with one actual piece of each group named in `configuration`."""
        ranges = [(self.next_sequence, times, 0)]
        self.next_sequence += times
        for group in configuration:
            after = []
            for sequence, n, used in ranges:
                while n:
                    length, there = members[group][0]
                    k = min(n, there)
                    self._emit(length, k, sequence, used)
                    after.append((sequence, k, used + length))
                    members[group][0][1] -= k
                    if not members[group][0][1]:
                        members[group].pop(0)
                    sequence += k
                    n -= k
            ranges = after
        for sequence, n, used in ranges:
            self._keep(self.capacity - used, sequence, n)

    def _keep(self, room: int, sequence: int, n: int) -> None:
        if room and n:
            self.room.setdefault(room, []).append((sequence, n))

    def best_fit(self) -> None:
        """What is left, longest first, each into the fullest sequence that still takes it, else into a new one."""
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                n = int(self.left[length])
                fits = [r for r in self.room if r >= length]
                if fits:
                    room = min(fits)
                    sequence, there = self.room[room].pop()
                    if not self.room[room]:
                        del self.room[room]
                    times = max(1, min(room // length, n // there))
                    k = min(n, there)
                else:
                    room, times = self.capacity, max(1, min(self.capacity // length, n))
                    k = there = n // times
                    sequence = self.next_sequence
                    self.next_sequence += k
                for step in range(times):
                    self._emit(length, k, sequence, self.capacity - room + step * length)
                self._keep(room - times * length, sequence, k)
                self._keep(room, sequence + k, there - k)


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (group numbers with repeats) and whole times each is used, together at most `demand`.

    Column generation: the simplex basis holds as many configurations as there are sizes; the best new one is an unbounded
    knapsack of the dual values. Fractions are rounded down; the few pieces left are packed later.
    """
    g = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(ROUNDS * g):
        inverse = np.linalg.inv(columns)
        value, candidate = _best_knapsack(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + 1e-7:
            break
        direction, times = inverse @ candidate, inverse @ demand
        ratios = np.full(g, np.inf)
        np.divide(times, direction, out=ratios, where=direction > 1e-9)
        leaving = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaving]):
            break
        columns[:, leaving] = candidate
    times = np.floor(np.linalg.solve(columns, demand.astype(float)) + 1e-6).astype(np.int64)
    out, rest = [], demand.copy()
    for column in np.argsort(-times):
        counts = np.rint(columns[:, column]).astype(np.int64)
        used = counts > 0
        whole = int(min(times[column], (rest[used] // counts[used]).min()))
        if whole > 0:
            rest -= whole * counts
            out.append((np.repeat(np.arange(g), counts).tolist(), whole))
    return out


def _best_knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Largest total value of sizes, repeats allowed, within `capacity`, and how often each is taken."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fit = sizes <= room
        gains = np.where(fit, values + best[np.maximum(room - sizes, 0)], -1.0)
        k = int(np.argmax(gains))
        if gains[k] > best[room - 1] + 1e-12:
            best[room], taken[room] = gains[k], k
        else:
            best[room], taken[room] = best[room - 1], -1
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(best[capacity]), counts
