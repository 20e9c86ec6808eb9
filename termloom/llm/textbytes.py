"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a longest run of the bytes 0-9, A-Z (lower-cased), a-z and every byte from 0x80 up, so letters outside ASCII
belong to words. All functions take whole columns: the texts' bytes lie one behind the other in `data`, text i at
`data[offsets[i]:offsets[i + 1]]`. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BYTES = 2 << 20
SMALL_PIECE = 1 << 20  # where tokens are held
HASH_PIECE = 1 << 19  # where many arrays of 64-bit numbers are held per byte
PIECE_ROWS = 8192
SHINGLE_WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHINGLE_STEP = np.uint64(0xD6E8FEB86659FD93)


class _Local(dict):
    """A dict that is empty when it is pickled: workers get the functions of this package with the globals they use, and what
    the driver has kept for itself must not go with each of them."""

    def __reduce__(self):
        return type(self), ()


_powers: dict[int, np.ndarray] = _Local()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def pieces(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes in `columns` and at most PIECE_ROWS rows, so that the arrays made from a
    slice stay small.

    A row longer than `limit` is a slice of its own.
    """
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns)
        ends = np.cumsum(sizes, dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            stop = max(row + 1, min(row + PIECE_ROWS, int(np.searchsorted(ends, before + limit, side="right"))))
            yield batch.slice(row, stop - row)
            row = stop


def by_name(names: list[str]) -> list[Column]:
    """Columns of these very names, which may hold dots and backticks."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least `count` of them; kept for the next call."""
    known = _powers.get(int(base))
    if known is None or len(known) < count:
        size = 1 + max(SMALL_PIECE, 1 << max(count - 2, 0).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[int(base)] = known
    return known[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of each prefix: entry i covers the first i bytes."""
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal spans have equal hashes wherever they stand."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


class Words:
    """All words of a text column: `starts`, `ends` (bytes), `hashes`, and `offsets` (first word of each text)."""

    def __init__(self, column: pa.Array):
        raw, self.text_offsets = text_bytes(column)
        self.raw = raw
        self.data = LOWER[raw]
        inside = IS_WORD[self.data]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[self.text_offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.ends = np.flatnonzero(stops) + 1
        self.offsets = np.searchsorted(self.starts, self.text_offsets)
        self._hashes = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(prefix_hashes(self.data), self.starts, self.ends)
        return self._hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def word_hash(word: str) -> int:
    """The hash `Words` gives to one word."""
    words = Words(pa.array([word]))
    if len(words.hashes) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(words.hashes[0])


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, the word each starts at, and the offsets of each text's first shingle.

    A text with fewer words than `size`, but at least one, has one shingle of all its words; one without words has none.
    """
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    total = int(offsets[-1])
    at = np.arange(total) + np.repeat(words.offsets[:-1] - offsets[:-1], n)
    left = np.repeat(words.offsets[1:], n) - at
    padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
    out = np.zeros(total, dtype=np.uint64)
    short = bool((left < size).any())
    for step in range(size):
        term = padded[at + step]
        if short:
            term = np.where(step < left, term, np.uint64(0))
        out = out * _SHINGLE_STEP + term
    return mix(out), at, offsets


def short_shingles(words: Words, at: np.ndarray, count: int, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of runs of `count` < `size` words at word positions `at`, as `shingles` gives them to texts that short."""
    out = np.zeros(len(at), np.uint64)
    for step in range(size):
        out = out * _SHINGLE_STEP + (words.hashes[at + step] if step < count else np.uint64(0))
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ..., for each run of the given length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
