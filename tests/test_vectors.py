"""Hashed n-gram vectors against HashingTF over spelled-out n-grams."""

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from termloom.operators import embed

TEXTS = ["", "a", "ab", "Two  Words", "ÀÉ ß straße", "日本語のテキスト", "mixed 日本 é 😀😀 end", "x" * 500, "z😀", "0123456789 " * 40]


@pytest.mark.parametrize("dim,gram", [(64, 3), (256, 3), (50, 1), (33, 5)])
def test_counts_equal_hashing_tf(spark, dim, gram):
    padded = [f" {t} " for t in TEXTS]
    terms = [([p[i : i + gram] for i in range(max(1, len(p) - gram + 1))],) for p in padded] + [([None],)]
    want = HashingTF(inputCol="terms", outputCol="tf", numFeatures=dim).transform(spark.createDataFrame(terms, "terms array<string>"))
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*padded, None])], "i long, p string").repartition(1)
    got = {r.i: r.c for r in df.select("i", embed._counted(dim, gram)("p").alias("c")).collect()}
    assert [got[i] for i in range(len(terms))] == [list(r.tf.toArray()) for r in want.collect()]


def test_slices_of_texts_keep_their_order():
    texts = [f" {t} ".encode() for t in TEXTS]
    whole = embed._gram_counts(texts, 64, 3)
    assert (whole == np.concatenate([embed._gram_counts([t], 64, 3) for t in texts])).all()


def test_texts_are_not_spelled_out_as_terms(spark):
    """No row holds its n-grams one by one."""
    df = spark.createDataFrame([("some text",)], "text string")
    vectors = embed.hashed_ngrams(16)(df)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "array_join" not in plan
    assert np.isclose(np.linalg.norm(vectors.first().vec), 1)
