"""Language identification by rank-order profiles of character n-grams and the out-of-place distance.

A profile is the list of the most frequent n-grams (1 to `MAX_GRAM` characters) in falling order. Texts are lower-cased;
every run of characters that are no letters counts as one blank, and blanks border each text. The distance of a document to
a language sums, over the n-grams of the document's profile, how far each stands from its place in the language's profile;
an n-gram that the language lacks costs the profile length. The nearest language wins, ties to the smaller name.

Language counts are sums over all training rows: each task adds up its own rows, Spark adds up the tasks.

Defined cases: text null or without a letter: `und`, score 0; training rows with null language or text teach nothing;
without any training row every prediction is `und`. Repeated rows count and are predicted each. Grams of equal
frequency are placed by their code, in documents as in languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.textbytes import pieces

MAX_GRAM = 3
LANGUAGE_GRAMS = 400
DOCUMENT_GRAMS = 300
HELD_GRAMS = 2_000_000
CHARACTER_BITS = 18  # no letter has a code point beyond

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each group of texts: group, exact code of the n-gram, count; sorted by group."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
    letter = _is_letter()[points]
    characters = np.where(letter, points, 0)
    if not len(characters):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet, small = np.unique(characters, return_inverse=True)
    if alphabet[0] != 0:
        alphabet, small = np.concatenate([[0], alphabet]), small + 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    group_of = np.repeat(group, lengths)[: len(points)]
    # one blank between words: drop blanks that follow a blank
    keep = np.ones(len(small), bool)
    keep[1:] = (small[1:] != 0) | (small[:-1] != 0)
    small, group_of = small[keep].astype(np.int64), group_of[keep]
    small = np.concatenate([[0], small, [0]])
    group_of = np.concatenate([group_of[:1], group_of, group_of[-1:]]).astype(np.int64)
    size = np.int64(len(alphabet))
    span = size**MAX_GRAM
    keys = []
    code = np.zeros(len(small), np.int64)
    for n in range(1, MAX_GRAM + 1):
        code = code[: len(small) - n + 1] * size + small[n - 1 :]
        # a gram belongs to the text of its second character; blanks only border it and are no gram alone
        second = min(n - 1, 1)
        whole = small[second : len(code) + second] != 0
        if n == 2:
            whole |= small[: len(code)] != 0
        group_n = group_of[second : len(code) + second] * (MAX_GRAM + 1) + n
        keys.append((group_n * span + code)[whole])
    keys = np.concatenate(keys)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    lead, code = keys // span, keys % span
    n = lead % (MAX_GRAM + 1)
    exact = np.zeros(len(code), np.int64)
    for k in range(MAX_GRAM):
        exact |= alphabet[(code // size**k) % size].astype(np.int64) << np.int64(k * CHARACTER_BITS)
    return lead // (MAX_GRAM + 1), exact | (n << np.int64(MAX_GRAM * CHARACTER_BITS)), counts


def language_profiles(rows: DataFrame, size: int = LANGUAGE_GRAMS) -> DataFrame:
    """lang, gram and place (from 0) of the `size` most frequent n-grams of each language of `rows` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for piece in pieces(batches, "text"):
            languages = pc.dictionary_encode(piece.column("lang"))
            names = languages.dictionary.to_pylist()
            texts = [t.lower() for t in piece.column("text").to_pylist()]
            group, gram, n = _grams(texts, languages.indices.to_numpy())
            for k, name in enumerate(names):
                held.setdefault(name, []).append((gram[group == k], n[group == k]))
            if sum(len(g) for parts in held.values() for g, _ in parts) > HELD_GRAMS:
                held = {name: [_added(parts)] for name, parts in held.items()}
                if sum(len(g) for parts in held.values() for g, _ in parts) > HELD_GRAMS // 2:
                    yield from _counted(held)
                    held = {}
        yield from _counted(held)

    columns = rows.filter("lang is not null and text is not null").select("lang", "text")
    counts = columns.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # the filter is on the bare row number, so that each task passes on at most `size` grams of a language
    ranked = counts.withColumn("place", place).filter(F.col("place") <= size)
    return ranked.select("lang", "gram", (F.col("place") - 1).alias("place"))


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def _counted(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for name, parts in held.items():
        grams, n = _added(parts)
        if len(grams):
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"]
            )


def predict_languages(
    docs: DataFrame, profiles: DataFrame, size: int = LANGUAGE_GRAMS, document_size: int = DOCUMENT_GRAMS
) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs` (doc_id, text).

    `profiles` (language_profiles) has `size` rows per language, so it is collected and broadcast. score: how much nearer
    the winner is than the next language, between 0 and 1.
    """
    table = profiles.toPandas()
    names = sorted(table["lang"].unique())
    known = np.sort(table["gram"].unique()).astype(np.int64)
    places = np.full((len(names), len(known) + 1), -1, np.int64)
    places[table["lang"].map({n: i for i, n in enumerate(names)}).astype(int), np.searchsorted(known, table["gram"])] = table["place"]
    shared = docs.sparkSession.sparkContext.broadcast((names, known, places))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, places = shared.value
        for piece in pieces(batches, "text"):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            best, score = _nearest(texts, names, known, places, size, document_size)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def _nearest(texts: list[str], names: list[str], known: np.ndarray, places: np.ndarray, size: int, document_size: int):
    rows = len(texts)
    best, score = np.full(rows, "und", dtype=object), np.zeros(rows)
    if not names or not rows:
        return best, score
    row, gram, n = _grams([t.lower() for t in texts], np.arange(rows))
    starts = np.searchsorted(row, np.arange(rows + 1))
    order = np.lexsort((gram, -n, row))
    place = np.arange(len(row)) - starts[row[order]]
    top = place < document_size
    order, place = order[top], place[top]
    row, gram = row[order], gram[order]
    at = np.searchsorted(known, gram)
    at = np.where(known[np.minimum(at, len(known) - 1)] == gram, at, len(known))
    distance = np.empty((len(names), rows))
    for k in range(len(names)):
        theirs = places[k][at]
        away = np.where(theirs < 0, size, np.abs(theirs - place))
        distance[k] = np.bincount(row, weights=away, minlength=rows)
    some = np.bincount(row, minlength=rows) > 0
    winner = np.argmin(distance, axis=0)
    first = np.min(distance, axis=0)
    if len(names) > 1:
        second = np.partition(distance, 1, axis=0)[1]
    else:
        second = np.bincount(row, minlength=rows) * float(size)
    best[some] = np.array(names, dtype=object)[winner[some]]
    score[some] = ((second - first) / np.maximum(second, 1e-9))[some]
    return best, np.clip(score, 0.0, 1.0)
