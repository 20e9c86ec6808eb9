"""Token ids of whole text columns with a `tokenizers` file, encoding each distinct chunk of text once per worker.

Texts are cut where the file's own pre-tokenizer always cuts; each chunk is encoded by the library and the ids are
joined, which gives the ids of the whole text. Cuts in use:

* both: between an ASCII letter and ASCII punctuation other than the apostrophe, in either order.
* `spaces`: before every ASCII white-space byte. For files that lower-case and drop white space; A-Z are lower-cased
  before the cut.
* `words`: before a single space between two characters that are surely not white space. For byte-level files whose
  pattern attaches one leading space to the next word.

A chunk that is one word of Latin letters is what normalizer and pre-tokenizer would hand to the file's model, but for the
byte alphabet, so it goes to the model at once. Every other chunk takes the whole way through the library.

Names of special tokens in a text are found as the library finds them, by encoding the texts that hold one whole; with
`names` off they are ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from termloom.llm.textbytes import LOWER, ragged, text_bytes

CACHE_CHUNKS = 600_000

# Classes of bytes at which both kinds of file always cut.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[39] = 0
_KIND[65:91] = _KIND[97:123] = 1

# One word of letters whose normal form is itself.
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

_encoders: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, cut: str, names: bool = True) -> Encoder:
    """The worker's encoder for a file; Python workers are reused, so its cache serves many tasks."""
    key = (path, cut, names)
    if key not in _encoders:
        _encoders[key] = Encoder(path, cut, names)
    return _encoders[key]


class ChunkCache:
    """Ids of texts cut in chunks; `_encoded` gives the ids of chunks not seen before."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def ids_of(self, data: np.ndarray, offsets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `data`, cut at the ascending places `edges`, and the offsets of each text's first id."""
        if not len(edges):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.append(edges, len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(
            len(edges), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        places = self._places(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        lengths = self.lengths[places]
        ids = self.pool[ragged(self.starts[places], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.searchsorted(edges, offsets)]

    def _places(self, chunks: list[str]) -> np.ndarray:
        get = self.known.get
        places = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        missing = np.flatnonzero(places < 0).tolist()
        if len(self.known) + len(missing) > CACHE_CHUNKS:
            # start anew with the chunks of this call, which hold the common ones
            held = np.flatnonzero(places >= 0)
            starts, lengths, pool = self.starts[places[held]], self.lengths[places[held]], self.pool
            self._reset()
            places[held] = self._add([chunks[i] for i in held.tolist()], lengths, pool[ragged(starts, lengths)])
        if missing:
            new = [chunks[i] for i in missing]
            ids = self._encoded(new)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for one in ids for x in one), np.uint32, int(lengths.sum()))
            places[missing] = self._add(new, lengths, flat)
        return places

    def _add(self, chunks: list[str], lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The places of new chunks, whose ids are `flat`."""
        first, stop = len(self.known), len(self.known) + len(chunks)
        self.starts = _grown(self.starts, stop)
        self.lengths = _grown(self.lengths, stop)
        self.pool = _grown(self.pool, self.used + len(flat))
        self.starts[first:stop] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:stop] = lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(chunks, range(first, stop)))
        return np.arange(first, stop)


class Encoder(ChunkCache):
    def __init__(self, path: str, cut: str, names: bool = True):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not names
        # contents of special tokens; they match the text as it stands, others any case of it
        added = self.tokenizer.get_added_tokens_decoder().values() if names else []
        self.names = [(t.content, t.normalized) for t in added]
        self.cut = {"spaces": _space_cuts, "words": _word_cuts}[cut]
        self.lowers = cut == "spaces"
        self.model = self.tokenizer.model
        # The printable character that stands for each byte in byte-level files.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's first id."""
        named = np.zeros(len(column), bool)
        for name, normalized in self.names:
            found = pc.match_substring(column, name, ignore_case=normalized)
            named |= pc.fill_null(found, False).to_numpy(zero_copy_only=False)
        if not named.any():
            return self._encode(column)
        at = np.flatnonzero(named)
        whole = self.tokenizer.encode_batch_fast(column.take(pa.array(at)).to_pylist(), add_special_tokens=False)
        ids, offsets = self._encode(pc.if_else(pa.array(named), pa.scalar("", column.type), column))
        added = [e.ids for e in whole]
        lengths = np.diff(offsets)
        ids = np.insert(ids, np.repeat(offsets[at], [len(a) for a in added]), np.concatenate(added).astype(np.uint32))
        lengths[at] = [len(a) for a in added]
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        if self.lowers:
            data = LOWER[data]
        cuts = np.zeros(len(data) + 1, dtype=bool)
        cuts[offsets] = True
        cuts[self.cut(data)] = True
        kind = _KIND[data]
        cuts[1:-1] |= kind[1:] * kind[:-1] == 2
        edges = np.flatnonzero(cuts[:-1])
        return self.ids_of(data, offsets, edges)

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        plain, tokenize = _PLAIN.fullmatch, self.model.tokenize
        out: list = [None] * len(chunks)
        other = []
        for i, chunk in enumerate(chunks):
            if plain(chunk):
                if self.lowers:
                    chunk = chunk.strip().lower()
                word = chunk if chunk.isascii() and chunk[0] != " " else self._spelled(chunk)
                out[i] = [t.id for t in tokenize(word)]
            else:
                other.append(i)
        found = self.tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False)
        for i, encoding in zip(other, found):
            out[i] = encoding.ids
        return out

    def _spelled(self, chunk: str) -> str:
        return chunk.encode().decode("latin-1").translate(self.alphabet)


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def _space_cuts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))


def _word_cuts(data: np.ndarray) -> np.ndarray:
    """Spaces between two characters that are visible ASCII or Latin letters of the block that starts with byte 0xC3."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:-1] == 32) + 1
    before, after, lead = data[at - 1], data[at + 1], data[at - 2]
    left = ((before > 32) & (before < 127)) | ((before >= 128) & (lead == 0xC3) & (at >= 2))
    right = ((after > 32) & (after < 127)) | (after == 0xC3)
    return at[left & right]
