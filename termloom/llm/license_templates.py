"""License scan: fixed phrases, and templates with optional and replaceable regions compiled into token automata.

Template mark-up: plain words are mandatory and must stand as given; `[[ ... ]]` may be left out; `{{m..n}}` stands for
m to n words of any kind. A template is accepted where a run of words of the text takes its automaton from the first to
the final state: all mandatory words, in order, with nothing between them but the replaceable regions.

Only places of the words a template can begin with are tried, so a text without such words costs one comparison per word.
Words are compared by 64-bit hashes.

Defined cases: a null or empty text has no word, no place and score 0; places may overlap and all count; labels are
distinct, sorted and joined by commas; a repeated row gives a repeated result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.textbytes import Words, pieces, word_hash

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, template_spans array<struct<label:string,first_word:long,end_word:long>>"
)

ANY = -1


@dataclass(frozen=True)
class Automaton:
    """States 0..final; `steps[state]` lists (word hash or ANY, next state); `free[state]` lists states reached by no word."""

    label: str
    steps: tuple
    free: tuple
    final: int
    entries: tuple

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return seen

    def match(self, hashes: np.ndarray, start: int, stop: int) -> int:
        """End of the longest accepted run of words from `start`, or -1."""
        states, found = self.closure({0}), -1
        for at in range(start, stop):
            word = int(hashes[at])
            states = self.closure({after for s in states for want, after in self.steps[s] if want in (ANY, word)})
            if not states:
                break
            if self.final in states:
                found = at + 1
        return found


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of one template. A template without any mandatory word is refused."""
    steps: list[list] = [[]]
    free: list[list] = [[]]

    def state() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    current, opened, mandatory = 0, [], 0
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\.\.\d+\}\}|[0-9a-z\x80-\U0010ffff]+", template.lower()):
        if token == "[[":
            opened.append(current)
        elif token == "]]":
            free[opened.pop()].append(current)
        elif token.startswith("{{"):
            low, high = map(int, token[2:-2].split(".."))
            skips = []
            for k in range(high):
                if k >= low:
                    skips.append(current)
                after = state()
                steps[current].append((ANY, after))
                current = after
            for skip in skips:
                free[skip].append(current)
        else:
            after = state()
            steps[current].append((word_hash(token), after))
            current = after
            mandatory += not opened
    if opened or not mandatory:
        raise ValueError(f"template {label}: needs closed brackets and a mandatory word")
    automaton = Automaton(label, tuple(map(tuple, steps)), tuple(map(tuple, free)), current, ())
    entries = {want for s in automaton.closure({0}) for want, _ in steps[s]}
    if ANY in entries:
        raise ValueError(f"template {label}: must start with a word")
    return Automaton(label, automaton.steps, automaton.free, current, tuple(sorted(entries)))


def scan_licenses(docs: DataFrame, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """Per row of `docs` (doc_id, text): see RESULT. `phrases`: words to label; `templates`: label to mark-up.

    score: 1 where a template is accepted, 0.5 where only phrases stand, else 0.
    """
    phrase_hashes = [([word_hash(w) for w in words.split()], label) for words, label in phrases.items()]
    automata = [compile_template(label, text) for label, text in templates.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield _scan_piece(piece, phrase_hashes, automata)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(scan, RESULT)


def _scan_piece(piece: pa.RecordBatch, phrases: list, automata: list[Automaton]) -> pa.RecordBatch:
    words = Words(piece.column("text"))
    hashes, offsets = words.hashes, words.offsets
    n = piece.num_rows
    count = np.zeros(n, np.int64)
    first = np.full(n, np.iinfo(np.int64).max)
    last = np.full(n, -1)
    base: list[set] = [set() for _ in range(n)]
    found: list[list] = [[] for _ in range(n)]
    for want, label in phrases:
        at = np.flatnonzero(hashes[: len(hashes) - len(want) + 1] == np.uint64(want[0])) if len(hashes) >= len(want) else np.zeros(0, np.int64)
        for k, word in enumerate(want[1:], 1):
            at = at[hashes[at + k] == np.uint64(word)]
        rows = np.searchsorted(offsets, at, side="right") - 1
        inside = at + len(want) <= offsets[rows + 1]
        at, rows = at[inside] - offsets[rows[inside]], rows[inside]
        np.add.at(count, rows, 1)
        np.minimum.at(first, rows, at)
        np.maximum.at(last, rows, at)
        for row in np.unique(rows):
            base[row].add(label)
    for automaton in automata:
        entry = np.isin(hashes, np.array(automaton.entries, np.uint64))
        places = np.flatnonzero(entry)
        rows = np.searchsorted(offsets, places, side="right") - 1
        for at, row in zip(places.tolist(), rows.tolist()):
            end = automaton.match(hashes, at, int(offsets[row + 1]))
            if end > 0:
                start = int(offsets[row])
                found[row].append({"label": automaton.label, "first_word": at - start, "end_word": end - start})
    seen = count > 0
    labels = [sorted(b | {f["label"] for f in fs}) for b, fs in zip(base, found)]
    score = [1.0 if fs else 0.5 if b else 0.0 for b, fs in zip(base, found)]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [
            piece.column("doc_id"),
            pa.array(words.counts),
            pa.array(count),
            pa.array(first, mask=~seen),
            pa.array(last, mask=~seen),
            pa.array([",".join(sorted(b)) for b in base], pa.string()),
            pa.array([",".join(x) for x in labels], pa.string()),
            pa.array(score, pa.float64()),
            pa.array(found, spans),
        ],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_spans"],
    )
