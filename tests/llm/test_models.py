"""Quality classifier, language identification and nearest neighbours: held-out accuracy, recall, awkward rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from tests.llm.conftest import AWKWARD
from termloom.llm import catalog, icws_dedup, permutation_index, rule_quality, textbytes
from termloom.llm.permutation_index import nearest
from termloom.llm.rank_language import MAX_GRAM, _grams, language_profiles, predict_languages
from termloom.llm.rule_quality import FEATURES, fit_rules, keep_quality, score_documents, text_statistics, tree_rules

SF = "/root/testdata/sf0.01"


def test_rules_are_paths_with_the_tightest_bounds():
    description = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 3 <= 0.25)
      Predict: 0.0
     Else (feature 3 > 0.25)
      Predict: 1.0
    Else (feature 3 > 0.5)
     Predict: 1.0
"""
    assert tree_rules(description) == [
        ((3, "<=", 0.5),), ((3, "<=", 0.25),), ((3, "<=", 0.5), (3, ">", 0.25)), ((3, ">", 0.5),),
    ]


def test_statistics_of_small_texts(spark):
    rows = [(1, "Und Und und!\nUnd Und und!"), (2, None), (3, "AB | 12")]
    got = {r.doc_id: r for r in text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2][f] == 0 for f in FEATURES)
    assert got[1].top_word_share == 1 and got[1].repeated_line_share == pytest.approx(12 / 25)
    assert got[1].again_share == pytest.approx(5 / 6) and got[1].distinct_share == pytest.approx(1 / 6)
    assert got[3].upper_share == 1 and got[3].pipe_share == pytest.approx(1 / 7) and got[3].digit_share == pytest.approx(2 / 7)


def test_quality_on_held_out_rows(spark):
    scored = catalog.op2_rule_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(3, 1), (8, 1), (10, 0), (6, 0), (None, 1), (77, 0), (4, None)], "doc_id long, quality int")
    scored = score_documents(awkward, labels)
    assert scored.count() == len(AWKWARD) and scored.filter("score is null or score < 0 or score > 1").isEmpty()
    kept = keep_quality(awkward, labels, 0.0)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    assert keep_quality(empty, labels, 0.5).count() == 0
    one_class = text_statistics(awkward).selectExpr("1.0D as label", *FEATURES)
    intercept, rules = fit_rules(one_class)
    assert rules == [] and intercept > 1


def brute_grams(text: str) -> Counter:
    plain = " " + " ".join("".join(c if c.isalpha() else " " for c in text).split()) + " "
    found: Counter = Counter()
    for n in range(1, MAX_GRAM + 1):
        for i in range(len(plain) - n + 1):
            gram = plain[i : i + n]
            if plain.strip() and gram != " " and not (n == 3 and gram[1] == " "):
                found[gram] += 1
    return found


def test_grams_match_brute_force():
    texts = ["abc ab", "", "éa!! x", "日本 go", "   ", "a", "\U0001f600"]
    row, code, n = _grams(texts, np.arange(len(texts)))
    for i, text in enumerate(texts):
        got = Counter()
        for gram, times in zip(code[row == i].tolist(), n[row == i].tolist()):
            got["".join(chr((gram >> 18 * k) & 0x3FFFF) for k in reversed(range(gram >> 54))).replace("\0", " ")] = times
        assert got == brute_grams(text)


def test_profiles_and_distance_match_brute_force(spark):
    rows = [("en", "the cat and the hat"), ("en", "that is the one"), ("fr", "le chat et le chapeau"), (None, "zzz"), ("fr", None)]
    profiles = language_profiles(spark.createDataFrame(rows, "lang string, text string"), size=20)
    got: dict = {}
    for r in sorted(profiles.collect(), key=lambda r: r.place):
        got.setdefault(r.lang, []).append(r.gram)
    for lang in ("en", "fr"):
        want = sum((brute_grams(t) for code, t in rows if code == lang and t), Counter())
        assert len(got[lang]) == 20
        text = ["".join(chr((g >> 18 * k) & 0x3FFFF) for k in reversed(range(g >> 54))).replace("\0", " ") for g in got[lang]]
        assert [want[t] for t in text] == sorted(want.values(), reverse=True)[:20]
    docs = spark.createDataFrame([(1, "the hat"), (2, "le chapeau"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    named = {r.doc_id: r.lang_pred for r in predict_languages(docs, profiles, size=20).collect()}
    assert named == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und"}


def test_distances_ties_and_scores_match_brute_force(spark):
    rng = random.Random(9)
    taught = [(lang, "".join(rng.choices("abcd ", k=300))) for lang in ("aa", "bb", "cc")] + [("dd", "zz yy"), ("ee", "zz yy")]
    profiles = language_profiles(spark.createDataFrame(taught, "lang string, text string"), size=60)
    places: dict = {}
    for r in profiles.collect():
        places.setdefault(r.lang, {})[r.gram] = r.place
    texts = ["".join(rng.choices("abcdxy ", k=n)) for n in (1, 3, 8, 40, 400) for _ in range(6)] + ["zz yy", "", "77"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(docs, profiles, size=60, document_size=25).collect()}

    def code(gram: str) -> int:
        letters = [0 if c == " " else ord(c) for c in reversed(gram)]
        return sum(c << 18 * k for k, c in enumerate(letters)) | len(gram) << 54

    for i, text in enumerate(texts):
        grams = {code(g): n for g, n in brute_grams(text).items()}
        best = sorted(grams, key=lambda g: (-grams[g], g))[:25]
        away = {
            lang: sum(abs(at[g] - k) if g in at else 60 for k, g in enumerate(best)) for lang, at in sorted(places.items())
        }
        first, second = sorted(away.values())[:2]
        want = min(away, key=lambda lang: (away[lang], lang)) if best else "und"
        assert got[i][0] == want
        assert abs(got[i][1] - ((second - first) / second if best and second else 0)) < 1e-9


def test_each_task_passes_on_the_best_grams_only(spark):
    rows = spark.createDataFrame([("en", "the cat")], "lang string, text string")
    plan = language_profiles(rows, size=20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_language_on_held_out_rows(spark, awkward, empty):
    rows = catalog.op6_rank_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    got = predict_languages(awkward, language_profiles(awkward)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    nothing = predict_languages(awkward, language_profiles(empty)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    got: dict = {}
    for r in nearest(table, lambda i: i % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append(r)
    found = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = vectors @ vectors[q]
        score[q] = -9
        mine = sorted(got[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and ids[q] not in [r.vec_id for r in mine]
        assert all(abs(score[np.flatnonzero(ids == r.vec_id)[0]] - r.score) < 1e-12 for r in mine)
        found += len(set(ids[np.argsort(-score)[:5]]) & {r.vec_id for r in mine})
    assert found >= 0.9 * 5 * len(got)


def test_neighbours_recall_where_the_radius_rules(spark):
    """20,000 vectors, so that SHARE of them, not LEAST candidates, sets the radius."""
    assert permutation_index.SHARE * 20_000 >= permutation_index.LEAST
    vectors = np.random.default_rng(3).normal(size=(20_000, 32))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v) for i, v in enumerate(vectors.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got: dict = {}
    for r in nearest(table, lambda i: i % 200 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in range(0, 20_000, 200):
        score = units @ units[q]
        score[q] = -9
        found += len(got[q] & set(np.argsort(-score)[:5].tolist()))
    assert len(got) == 100 and found >= 0.9 * 500


def test_neighbours_of_copies_and_awkward_rows(spark):
    base = [[float(x) for x in np.random.default_rng(i).normal(size=6)] for i in range(12)]
    rows = [(i, base[i % 12], "x") for i in range(240)]
    rows += [(500, None, "x"), (550, [0.0] * 6, "x"), (600, [1.0, float("nan")] * 3, "x"), (650, [], "x"), (700, [1.0], "x"), (None, base[0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string").repartition(4)
    got = {(r.query_id, r.rank): r for r in nearest(table, lambda i: i % 50 == 0, 5).collect()}
    assert {q for q, _ in got} == {0, 50, 100, 150, 200}
    for q in (0, 50, 100, 150, 200):
        copies = [i for i in range(q % 12, 240, 12) if i != q][:5]
        assert [got[q, k].vec_id for k in range(1, 6)] == copies and abs(got[q, 1].score - 1) < 1e-12
    two = nearest(table.filter("vec_id < 2"), lambda i: i % 50 == 0, 5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(0, 1, 1)]
    assert nearest(table.limit(0), lambda i: i % 50 == 0, 5).count() == 0


def test_functions_travel_without_the_powers_that_the_driver_has_kept():
    text = pa.array(["one text with some words in it, and again some words in it", None, ""])
    here = rule_quality._statistics(text)
    assert sum(p.nbytes for p in textbytes._powers.values()) > 1 << 24
    for function in (rule_quality._statistics, icws_dedup.Features, textbytes.powers):
        sent = cloudpickle.dumps(function)
        assert len(sent) < 1 << 20
    there = cloudpickle.loads(cloudpickle.dumps(rule_quality._statistics))(text)
    assert all(np.array_equal(a, b) for a, b in zip(here, there))
