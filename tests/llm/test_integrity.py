"""Exact groups, cross-tokenizer alignment and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import compare, connect
from termloom.llm import catalog
from termloom.llm.cross_tokens import CSR, align, alignment_links, product, transposed
from termloom.llm.digest_merge import exact_groups, keep_unique, sha256_digest
from termloom.llm.merkle_manifest import FIELDS, fold, grow, manifest, positions, proofs, tree_height

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.oracles()))
def test_matches_sql(spark, name):
    assert compare(catalog.builders()[name](spark, SF), connect(SF), catalog.oracles()[name]) == []


# exact groups


def brute_groups(rows):
    groups: dict = {}
    for doc_id, text in rows:
        text = text or ""
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text), []).append((-len(text), doc_id is None, doc_id or 0, doc_id))
    return sorted(
        ((x[3], min(g)[3], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for x in g), key=str
    )


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    texts = ["a b", "ab", "a\tb", "", "  ", None, "c", "c \n", "zz" * 50, "a b", "あ い", "あい"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts)) for _ in range(400)]
    return rows + [(1000 + i, "hot \x0b line") for i in range(300)] + [(2000, "x" * 200_000), (2001, " " + "x" * 200_000)]


@pytest.mark.parametrize("bits", [1, 3])
@pytest.mark.parametrize(
    "digest", [sha256_digest, lambda t: F.substring(sha256_digest(t), 1, 1), lambda t: F.lit(b"")], ids=["whole", "byte", "none"]
)
def test_groups_equal_brute_force_even_when_digests_collide(spark, copies, digest, bits):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(23)
    got = exact_groups(docs, digest=digest, round_bits=bits).collect()
    want = brute_groups(copies)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert sum(r.kept for r in got) == len({w[3] for w in want})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_groups_of_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = exact_groups(awkward).withColumn("digest", F.lower(F.hex("digest"))).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=str) == brute_groups(rows)
    left = keep_unique(awkward)
    assert left.columns == awkward.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted({re.sub(r"^\s+$", "   \n\t ", t or "   \n\t ") for _, t in rows})
    assert exact_groups(empty).count() == keep_unique(empty).count() == 0


def test_a_hot_digest_reaches_a_holder_few_times(spark):
    """A third of all rows share one text in 64 runs: each round sees it at most once per holder of the round before."""
    docs = spark.range(6400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_groups(docs.repartition(64))
    assert got.filter("not kept").count() == 2133 and got.agg(F.max("group_size")).first()[0] == 2134


# alignment

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute_tokens(texts):
    """Per text: A ids, A ends, B ids, B ends; None for texts without tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    for text in texts:
        if not text:
            yield None
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        spelled_b = [
            bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            yield None
            continue
        yield ids_a, np.cumsum([len(x) for x in spelled_a]).tolist(), ids_b, np.cumsum([len(x) for x in spelled_b]).tolist()


def brute_alignment(rows):
    found = list(brute_tokens([t for _, t in rows]))
    links = [[] if f is None else [(i, j) for i, x in zip(f[0], f[1]) for j, y in zip(f[2], f[3]) if x == y] for f in found]
    count = Counter(x for one in links for x in one)
    best: dict = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (doc_id, _), f, own in zip(rows, found, links):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, "", 0, 0))
            continue
        groups, low = [], 0
        for high in sorted(set(f[1]) & set(f[3])):
            sides = [",".join(str(i) for i, e in zip(ids, ends) if low < e <= high) for ids, ends in (f[:2], f[2:])]
            groups.append("|".join(sides))
            low = high
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        top = sum(count[x] == best[x[1]] for x in own)
        out.append((doc_id, len(f[0]), len(f[2]), len(groups), len(own), digest, top, sum(count[x] for x in own)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def spelled(documents):
    rng = random.Random(3)
    alphabet = "aB cé 'sS.!\n\t0ſµ— 　日<|>▁\x00\U0001f600"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(None, None), (5, ""), (6, " "), (7, "a <|endoftext|> <s> b"), (8, "hello world " * 400)] * 2
    return rows + [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(40).collect()]


@pytest.mark.parametrize("block", [16 << 20, 2000])
def test_alignment_equals_brute_force(spark, spelled, block):
    docs = spark.createDataFrame(spelled, "doc_id long, text string")
    assert sorted((tuple(r) for r in align(docs, A, B, block).collect()), key=str) == brute_alignment(spelled)


def test_links_equal_brute_force(spark, spelled):
    rows = [(i, t) for i, (_, t) in enumerate(spelled[:120])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want: dict = {"overlap": set(), "end": set(), "group": set()}
    for (doc_id, _), f in zip(rows, brute_tokens([t for _, t in rows])):
        if f is None:
            continue
        common = sorted(set(f[1]) & set(f[3]))
        for i, x in enumerate(f[1]):
            for j, y in enumerate(f[3]):
                shared = min(x, y) - max([0, *f[1]][i], [0, *f[3]][j])
                if shared > 0:
                    want["overlap"].add((doc_id, i, j, shared))
                    if x == y:
                        want["end"].add((doc_id, i, j, shared))
                if min(c for c in common if c >= x) == min(c for c in common if c >= y):
                    want["group"].add((doc_id, i, j, 1))
    for kind, expected in want.items():
        got = alignment_links(docs, A, B, kind).select("doc_id", "a_index", "b_index", "shared").collect()
        assert sorted(map(tuple, got)) == sorted(expected), kind


def test_row_products_equal_dense_products():
    rng = np.random.default_rng(1)
    for shape in ((7, 5, 6), (1, 9, 1), (30, 20, 40), (3, 4, 0)):
        dense = [rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in (shape[:2], shape[1:])]
        a, b = (CSR(np.append(0, np.cumsum((d > 0).sum(axis=1))), np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense)
        for expanded in (1, 50, 1 << 20):
            c = product(a, b, expanded)
            out = np.zeros((shape[0], shape[2]), int)
            out[c.rows, c.indices] = c.data
            assert np.array_equal(out, dense[0] @ dense[1])
        t = transposed(a)
        out = np.zeros(dense[0].T.shape, int)
        out[t.rows, t.indices] = t.data
        assert np.array_equal(out, dense[0].T)


def test_alignment_of_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect() if len(r.text or "") < 1000]
    docs = awkward.filter("text is null or length(text) < 1000")
    assert sorted((tuple(r) for r in align(docs, A, B).collect()), key=str) == brute_alignment(rows)
    long = align(awkward.filter("length(text) >= 1000"), A, B).collect()
    assert len(long) == 2 and all(r.n_links == r.n_groups > 60_000 for r in long)
    assert align(empty, A, B).count() == 0


# manifest


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_proofs(rows):
    def leaf(row):
        return digest_of(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest_of(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    langs: dict = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [climb([leaf(r) for r in langs[x]]) for x in order]
    top = climb([t[-1][0] for t in trees])
    out = []
    for number, lang in enumerate(order):
        for place, row in enumerate(langs[lang]):
            claimed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                claimed[3] += 1
            node, siblings = leaf(claimed), []
            for levels, p in ((trees[number], place), (top, number)):
                for level in levels[:-1]:
                    pair = [node]
                    if p ^ 1 < len(level):
                        siblings.append(level[p ^ 1])
                        pair = [level[p ^ 1], node] if p & 1 else [node, level[p ^ 1]]
                    node, p = digest_of(*pair), p >> 1
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[number][-1][0], root, digest_of(*siblings), node, node == root))
    return sorted(out, key=str)


def tampered():
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize("n, bits", [(0, 2), (1, 2), (2, 1), (37, 1), (100, 3), (300, 10)])
def test_proofs_equal_brute_force(spark, n, bits):
    rng = random.Random(n)
    rows = [
        (rng.choice([None, *range(1000), 2**60 + 1]), "s", rng.choice([None, "", "a", "b", "é"]), rng.choice([None, 3, 5]),
         rng.choice([None, "", "x y", "é" * 70_000]), 1, "clash")
        for _ in range(n)
    ]
    rows += rows[:5]
    columns = "doc_id long, source string, lang string, n_chars long, text string, place int, tree string"
    got = proofs(spark.createDataFrame(rows, columns), tampered(), bits).drop("proof")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_proofs([r[:5] for r in rows])


def test_every_changed_field_is_found(spark, documents):
    for name in FIELDS[1:]:
        other = {name: F.lit(-1) if name == "n_chars" else F.concat(F.coalesce(F.col(name), F.lit("")), F.lit("."))}
        assert proofs(documents.limit(20), other).filter("verified").isEmpty(), name


def test_positions_are_the_order_of_completion():
    for leaves in (1, 2, 3, 5, 8, 13, 64, 100):
        nodes = [bytes([i]) * 32 for i in range(leaves)]
        log = grow(nodes, tree_height(leaves))
        at = [positions(np.arange(-(-leaves >> k)), k, leaves) for k in range(tree_height(leaves) + 1)]
        assert sorted(np.concatenate(at).tolist()) == list(range(len(log)))
        assert [log[i] for i in at[0]] == nodes
        for k in range(1, len(at)):
            for j, p in enumerate(at[k].tolist()):
                children = [log[i] for i in at[k - 1][2 * j : 2 * j + 2]]
                assert log[p] == hashlib.sha256("".join(c.hex() for c in children).encode()).digest()
        assert fold(nodes[-1], leaves - 1, leaves, iter([log[at[k][(leaves - 1 >> k) ^ 1]] for k in range(len(at)) if (leaves - 1 >> k) ^ 1 < len(at[k])])) == log[-1]


def test_log_is_gapless_in_postorder(spark, documents):
    leaves, log, top = manifest(documents, bits=3)
    assert len(log.rounds) > 1
    nodes = log.nodes().toPandas()
    for tree, own in nodes.groupby("tree"):
        assert sorted(own["position"]) == list(range(len(own)))
        level = {(x.level, x.place): x for x in own.itertuples()}
        for x in own.itertuples():
            if x.level:
                below = [level[x.level - 1, 2 * x.place + s] for s in (0, 1) if (x.level - 1, 2 * x.place + s) in level]
                assert hashlib.sha256("".join(bytes(c.digest).hex() for c in below).encode()).digest() == bytes(x.digest)
                assert all(c.position < x.position for c in below)
