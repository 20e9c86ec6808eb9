"""Near-duplicates, substring removal and decontamination against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import termloom.llm.suffix_dedup as suffix
from tests.llm.conftest import AWKWARD, shingles, words
from termloom.llm.components import components
from termloom.llm.icws_dedup import COMMON, keep_one, near_duplicates
from termloom.llm.simhash_windows import contaminated_spans, decontaminate
from termloom.llm.textbytes import text_bytes
from termloom.session import BATCH_BYTES, BATCH_KEY, bound_batches


def near_rows() -> list[tuple[int, str]]:
    """Groups of edited copies, exact copies and texts that only share passages."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    rows, key = [], 0
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([30, 120, 400]))
        for copy in range(rng.choice([1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((key, " ".join(text)))
            key += 1
    for _ in range(25):
        rows.append((key, " ".join(rng.choices(vocabulary, k=80)) + " " + shared))
        key += 1
    return rows + [(key + i, rows[3][1]) for i in range(4)]


def brute_classes(rows: list[tuple[int, str]], similarity: float = 0.8) -> dict[int, int]:
    bags = {i: shingles(t) for i, t in rows}
    frequency = Counter(s for bag in bags.values() for s in bag)
    floor = max(COMMON * len(rows), 1.0)

    def weight(s) -> float:
        if frequency[s] <= floor:
            return 1.0
        return (1 + min(max(math.log(len(rows) / frequency[s]) / math.log(1 / COMMON), 0), 1)) / 2

    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = sum(min(c, bags[b][s]) * weight(s) for s, c in bags[a].items() if s in bags[b])
            total = sum(c * weight(s) for bag in (bags[a], bags[b]) for s, c in bag.items())
            if shared and shared / (total - shared) >= similarity:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_near_duplicate_classes_match_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    kept = sorted(r.doc_id for r in keep_one(docs).collect())
    assert kept == sorted(set(got.values()))


def test_mixed_buckets_lose_no_link(spark, monkeypatch):
    """Copies of one text with up to 14 edits, some of them copied again: no centre is near to all."""
    import termloom.llm.icws_dedup as icws

    monkeypatch.setattr(icws, "BLOCK_BYTES", 6000)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=150)
    texts = []
    for _ in range(70):
        text = list(base)
        for _ in range(rng.randint(0, 14)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        texts.append(text)
    for text in texts[:30]:
        again = list(text)
        again[rng.randrange(len(again))] = "again"
        texts.append(again)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and len(set(want.values())) > 5


def repeated_lines(tag: str, times: int, singles: int, edited: int) -> str:
    """A line of ten words, repeated, before words that stand once, some of them edited under `tag`."""
    line = " ".join(f"line{i}" for i in range(10))
    return " ".join([line] * times + [f"{tag if i < edited else ''}single{i}" for i in range(singles)])


def test_samples_agree_as_often_as_texts_with_repeats_are_similar():
    """One shingle with most of the weight, few shingles, and frequent shingles of lower weight."""
    import pyarrow as pa

    import termloom.llm.icws_dedup as icws

    none = icws.Weights(np.zeros(0, np.uint64), np.zeros(0), 100)
    for times, again, singles, edited in ((30, 30, 64, 30), (100, 100, 204, 50), (40, 46, 0, 0), (1, 1, 20, 4)):
        agree, like = [], []
        for trial in range(60):
            one = pa.array([repeated_lines(f"a{trial}", times, singles, edited).replace("line", f"line{trial}")])
            other = pa.array([repeated_lines(f"b{trial}", again, singles, edited).replace("line", f"line{trial}")])
            features = [icws.Features(text) for text in (one, other)]
            several = features[0].feature[::2]
            for weights in (none, icws.Weights(several, np.full(len(several), 40), 100)):
                a, b = (icws.samples(f, weights.of(f)) for f in features)
                agree.append((a == b).mean())
                like.append(icws.weighted_jaccard(one, other, weights)[0])
        assert abs(np.mean(agree) - np.mean(like)) < 0.02
        assert np.std(np.array(agree) - like) < 1.3 * np.sqrt(0.25 / a.size)


def test_linked_texts_with_repeats_are_likely_pairs():
    import pyarrow as pa

    import termloom.llm.icws_dedup as icws

    weights = icws.Weights(np.zeros(0, np.uint64), np.zeros(0), 100)
    for times, again, singles, edited in ((30, 30, 64, 30), (20, 20, 104, 18), (40, 46, 64, 0), (400, 400, 304, 150)):
        for trial in range(30):
            one = pa.array([repeated_lines(f"a{trial}", times, singles, edited).replace("line", f"line{trial}")])
            other = pa.array([repeated_lines(f"b{trial}", again, singles, edited).replace("line", f"line{trial}")])
            assert icws.weighted_jaccard(one, other, weights)[0] >= 0.8
            both = (icws.samples(f, weights.of(f)) for f in (icws.Features(one), icws.Features(other)))
            a, b = (icws.mix(s).astype(np.uint8) for s in both)
            assert icws.likely(a, b, 0.8).all()


def test_classes_of_texts_with_repeats_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for group in range(30):
        times = rng.choice([5, 30, 100])
        for copy in range(4):
            text = repeated_lines(f"e{group}_{copy}x", times + rng.choice([0, 1, times // 7]), 2 * times, rng.randint(0, times))
            rows.append((len(rows), text.replace("line", f"line{group}x").replace(" single", f" single{group}x")))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and 40 < len(set(want.values())) < 110


def edited_copies(count: int) -> list[tuple[int, str]]:
    """Copies of one text of 120 words with one to five edits."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(count):
        text = list(base)
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(5000)}"
        rows.append((i, " ".join(text)))
    return rows


def test_links_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """What leaves the comparison of blocks is bounded by components, not by pairs; classes are those of all pairs."""
    import termloom.llm.icws_dedup as icws

    monkeypatch.setattr(icws, "BLOCK_BYTES", 64_000)
    counted = []
    original = icws.joining_links

    def counting(members, *rest):
        links = original(members, *rest)
        counted.append((links.count(), members.select("component").distinct().count()))
        return links

    monkeypatch.setattr(icws, "joining_links", counting)
    for count in (250, 500, 1000):
        rows = edited_copies(count)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
        if count <= 500:
            assert got == brute_classes(rows)
        links, components_ = counted[-1]
        assert links < 40 * components_
    assert counted[2][0] < 6 * max(counted[0][0], 20)


def test_many_short_texts_in_one_batch(spark):
    """More texts in a batch than a row number has bits for beside a shingle."""
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(20_000)] + [(20_000 + i, f"A{i} b{i}, c{i} d{i} e{i}") for i in range(19_000, 20_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: i if i < 20_000 else i - 20_000 for i, _ in rows}


def test_keeping_one_of_rows_with_dotted_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "A, b", "y"), (None, None, None)], "doc_id long, text string, `a.b` string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b", "x"), (None, None, None)]


def test_near_duplicates_of_awkward_rows(awkward, empty):
    got = Counter((r.doc_id, r.class_id) for r in near_duplicates(awkward).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (3, 3): 1, (4, 4): 1, (5, 5): 2, (6, 6): 1, (None, None): 1, (8, 8): 1, (9, 8): 1, (10, 10): 1})
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 10]
    assert near_duplicates(empty).count() == keep_one(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_removal(rows: list[tuple[int, str | None]]) -> dict:
    seen: set[bytes] = set()
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - suffix.WINDOW + 1):
            window = data[s : s + suffix.WINDOW]
            if window in seen:
                gone[s : s + suffix.WINDOW] = True
            else:
                seen.add(window)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages() -> list[tuple[int, str | None]]:
    rng = random.Random(9)
    base = ["".join(rng.choices("abcé \n", k=400)) for _ in range(6)]
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (5, "ab" * 300)]
    for i in range(10, 130):
        text = ""
        for _ in range(rng.randint(1, 4)):
            start = rng.randint(0, 300)
            text += rng.choice(base)[start : start + rng.randint(20, 250)]
            if rng.random() < 0.3:
                text += "=" * rng.randint(50, 300)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize(("chunk", "most"), [(suffix.CHUNK_CONTEXTS, suffix.MOST_CONTEXTS), (2, 3), (10**6, 2)])
def test_removed_bytes_match_brute_force(spark, chunk, most):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix.remove_repeats(docs, True, chunk, most).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_removal(rows)


@pytest.mark.parametrize("partitions", [1, 4])
def test_collisions_of_contexts_are_found(spark, monkeypatch, partitions):
    rows = [(i, f"{t} {t} {i % 7}") for i, t in near_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions, "doc_id")
    places = docs.withColumnRenamed("doc_id", "place")
    searches = []
    scan = suffix.find_occurrences
    monkeypatch.setattr(suffix, "find_occurrences", lambda *a: searches.append(a[3:]) or scan(*a))

    def removed(**bits):
        ranges = suffix.repeated_ranges(places, **bits).collect()
        return {(r.place, r.low + k) for r in ranges for k in range(r.n)}

    assert removed(context_bits=1) == removed()
    assert searches == [(0, 1), (1, 64), (0, 64)]


def test_ranges_that_differ_from_their_source_are_a_collision(spark):
    found = spark.createDataFrame(
        [(suffix.REMOVED, 0, 2, 5, 1, 0, 1, 0), (suffix.REMOVED, 0, 3, 0, 1, 0, None, None)], suffix.FOUND + suffix.SOURCE
    )
    text = "".join(random.Random(6).choices("abc", k=100))
    for last, clash in ((text[-1], False), ("-", True)):
        docs = spark.createDataFrame([(1, text), (2, "-----" + text[:-1] + last), (3, text)], "place long, text string")
        wanted = suffix.copies_to_verify(found)
        assert sorted((r.place, r.low, r.n) for r in wanted.collect()) == [(1, 0, 1), (2, 5, 1)]
        assert suffix.collided(found, suffix.contexts_of(docs, wanted)) is clash


def test_removal_across_stretches_of_a_long_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix, "POSITION_BITS", 9)
    text = "".join(random.Random(1).choices("abcdef", k=3000))
    entries = suffix.occurrences(pa.array([text, "short", text[100:]]))
    starts = sorted((int(e["place"]), int(e["low"]) + k) for e in entries for k in range(e["n"]))
    assert starts == [(r, s) for r, n in ((0, 3000), (2, 2900)) for s in range(n - suffix.WINDOW + 1)]


def test_removal_of_awkward_rows(awkward, empty):
    got = sorted(suffix.remove_repeats(awkward, digest=True).collect(), key=lambda r: (r.doc_id or 0, -r.n_removed))
    assert [(r.doc_id, r.n_removed == r.n_bytes > 0) for r in got if r.doc_id == 5] == [(5, True), (5, False)]
    assert len(got) == len(AWKWARD)
    whole = suffix.remove_repeats(awkward)
    assert whole.columns == awkward.columns and whole.schema["text"].dataType == awkward.schema["text"].dataType
    texts = {(r.doc_id, r.text) for r in whole.collect()}
    assert (2, None) in texts and (8, "same text here and there again and again") in texts and (5, "") in texts
    assert suffix.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("item_bytes", [16 << 20, 600])
def test_contaminated_spans_match_brute_force(spark, monkeypatch, item_bytes):
    import termloom.llm.simhash_windows as windows

    monkeypatch.setattr(windows, "ITEM_BYTES", item_bytes)
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 9, 30, 40])))) for i in range(20)] + [(90, None), (91, "")]
    items += [(92, items[0][1])]
    rows = []
    for i in range(120):
        body = rng.choices(vocabulary, k=rng.randint(0, 60))
        planted = words(items[rng.randrange(20)][1])
        if rng.random() < 0.4 and len(planted) > 12:
            planted[rng.choice([0, 1, -1])] = "edited"
        if rng.random() < 0.6:
            body[5:5] = planted
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(items, "item_id long, text string")
    bags = {i: shingles(t) for i, t in items if t}
    holders = Counter(s for bag in bags.values() for s in bag)

    def weight(s) -> float:
        if s not in holders:
            return 2.0
        return round(64 * (1 + math.log(len(bags) / holders[s]) / math.log(len(bags)))) / 64

    want = set()
    for doc_id, text in rows:
        w = words(text)
        for item, bag in bags.items():
            n = len(words(dict(items)[item]))
            for start in range(len(w) - n + 1):
                window = shingles(" ".join(w[start : start + n]))
                shared = sum(min(c, bag[s]) * weight(s) for s, c in window.items() if s in bag)
                total = sum(c * weight(s) for b in (window, bag) for s, c in b.items())
                if shared / (total - shared) >= 0.8:
                    want.add((doc_id, item))
    got = {(r.doc_id, r.item_id) for r in contaminated_spans(docs, known).collect()}
    assert got == want and len(want) > 30
    clean = {r.doc_id for r in decontaminate(docs, known).collect()}
    assert clean == {i for i, _ in rows} - {d for d, _ in want}


def test_decontamination_of_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, "same text here and there again and again"), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in contaminated_spans(awkward, items).collect()) == [8, 9]
    left = decontaminate(awkward, items)
    assert left.columns == awkward.columns and left.count() == len(AWKWARD) - 2
    assert contaminated_spans(awkward, items.limit(0)).count() == 0
    assert decontaminate(awkward, items.limit(0)).count() == len(AWKWARD)
    assert decontaminate(empty, items).count() == 0


def test_a_chunk_of_entries_is_packed_in_little_memory_and_small_batches():
    rng = np.random.default_rng(5)
    texts = pa.array(["".join(map(chr, rng.integers(97, 123, 60_000))) for _ in range(200)])
    entries = suffix.occurrences(texts)
    data, offsets = text_bytes(texts)
    expected, size = np.sort(entries["key"]), entries.nbytes
    held, starts, raw = [entries], [offsets[entries["place"]]], bytearray(data.tobytes())
    del entries
    tracemalloc.start()
    try:
        batches = list(suffix._packed(held, starts, raw, 72, 512))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * size
    assert len(batches) > 1 and max(b.nbytes for b in batches) < BATCH_BYTES + size // 72 * 2
    parts = [p for b in batches for p in b.column("part").to_pylist()]
    assert parts == sorted(set(parts))
    packed = b"".join(x for b in batches for x in b.column("entries").to_pylist())
    found = np.frombuffer(packed, suffix.ENTRY)
    assert np.array_equal(np.sort(found["key"]), expected)
    assert (np.repeat(parts, [len(x) // 38 for b in batches for x in b.column("entries").to_pylist()]) == found["key"] % 72).all()


def test_texts_go_to_workers_in_batches_of_few_bytes(spark, monkeypatch):
    """Long texts: each stage's function gets batches that follow the bytes, not 10,000 rows; a session's own limit holds."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(400, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 8000) as text")

    def largest(batches):
        for batch in batches:
            if batch.nbytes > 3 * BATCH_BYTES:
                seen.add(1)
            yield batch

    before = spark.conf.get(BATCH_KEY, None)
    try:
        spark.conf.unset(BATCH_KEY)
        suffix.remove_repeats(rows.limit(2)).count()
        rows.mapInArrow(largest, rows.schema).agg(F.sum(F.length("text"))).collect()
        assert seen.value == 0 and spark.conf.get(BATCH_KEY) == str(BATCH_BYTES)
        spark.conf.set(BATCH_KEY, "16m")
        bound_batches(spark)
        assert spark.conf.get(BATCH_KEY) == "16m"
    finally:
        spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)
