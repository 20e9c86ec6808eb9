"""Token ids, token files and packing against the tokenizers library used directly."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD
from termloom.llm.bpe import Encoder
from termloom.llm.linear_packing import cut_tokens, pack, plan_runs
from termloom.llm.token_files import read_tokens, token_digest, write_tokens
from termloom.session import cut_lineage, scratch_path

FILES = {"word_bpe_49k.json": "spaces", "byte_bpe_50k.json": "words"}
TEXT = st.text(alphabet="aB cé 'sS.!\n\t0É́ſµ×— 　日<|>", max_size=40)


def direct(file: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(file))


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=5))
def test_chunks_give_the_ids_of_whole_texts(file, texts):
    encoder, tokenizer = Encoder(public_tokenizers.path(file), FILES[file]), direct(file)
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def digest(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, awkward, documents):
    docs = awkward.select("doc_id", "text").unionByName(documents.selectExpr("doc_id + 100 as doc_id", "text"))
    path = scratch_path(spark, "tokens")
    file = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(docs, path, file, end_id=1, page_rows=50)
    tokenizer = direct("word_bpe_49k.json")
    want = sorted(
        (-1 if i is None else i, len(ids := [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]), digest(ids))
        for i, t in docs.collect()
    )
    got = token_digest(spark, path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_token_files_have_indexes_and_encodings(spark, documents):
    path = scratch_path(spark, "tokens")
    write_tokens(documents, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, page_rows=20)
    name = next(r.file for r in read_tokens(spark, path).select("file").limit(1).collect()).removeprefix("file:")
    group = pq.ParquetFile(name.replace("///", "/")).metadata.row_group(0)
    by_name = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings and by_name["ids"].has_dictionary_page
    assert all(c.has_offset_index and c.has_column_index for c in by_name.values())
    plan = read_tokens(spark, path).filter("doc_id = 3").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan and "ids:array" not in plan.split("ReadSchema")[-1]


def test_token_files_of_an_empty_table(spark, empty):
    path = scratch_path(spark, "tokens")
    write_tokens(empty, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert token_digest(spark, path).count() == 0


def check_plan(counts: np.ndarray, capacity: int) -> int:
    length, first, n, base, offset = plan_runs(counts, capacity)
    for size in np.flatnonzero(counts):
        mine = length == size
        assert np.array_equal(first[mine], np.concatenate([[0], np.cumsum(n[mine])[:-1]])) and n[mine].sum() == counts[size]
    used = np.zeros(int((base + n).max(initial=0)), np.int64)
    for k in np.argsort(offset, kind="stable"):
        assert (used[base[k] : base[k] + n[k]] == offset[k]).all()
        used[base[k] : base[k] + n[k]] += length[k]
    assert (used > 0).all() and used.max(initial=0) <= capacity
    return len(used)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_place_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    sequences = check_plan(counts, 64)
    assert sequences >= -(-int(counts @ np.arange(65)) // 64)


def test_plans_come_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6.2, 1.1, 50_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    assert check_plan(counts, 2048) <= 1.001 * -(-lengths.sum() // 2048)


def test_packing_holds_all_tokens(spark, awkward, empty):
    tokenizer = direct("byte_bpe_50k.json")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack(cut_lineage(cut_tokens(awkward, path, end_id=0, keep_ids=True))).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in AWKWARD}
    copies = {i: sum(1 for j, _, _ in AWKWARD if i == j) for i in want}
    for doc_id, ids in want.items():
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert sum(r.length for r in own) == copies[doc_id] * len(ids)
        for r in own:
            assert r.ids == ids[r.start : r.start + r.length] and r.ids_crc32 == digest(r.ids)
            assert r.length == 2048 or r.piece == 0
    by_sequence: dict = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by_sequence.get(r.sequence_id, 0) == r.offset
        by_sequence[r.sequence_id] = r.offset + r.length
    assert max(by_sequence.values()) <= 2048
    assert pack(cut_lineage(cut_tokens(empty, path, end_id=0))).count() == 0
