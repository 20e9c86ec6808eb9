import re

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import intent, labels
from termloom.operators.validate import ValidationRules, with_reason

SAMPLES = [
    "How to train", "show to", "what  is\tthis", "why", "why not", "whynot now", "guide", "Guided", "EXAMPLES", "examplesx",
    "free download app", "sign up", "design up", "log in", "login", "log-in", "log in", "vs", "a vs. b", "vs.b", "avs",
    "top 10", "top ١٠", "stop 10", "top ten", "reviews!", "recommendation", "pros and  cons", "near me", "in paris", "in 5",
    "in É", "bin paris", "12345", "123456", "é12345", "x 12345,", "or", "order", "reorder", "which?", "what?\n", "?", "élan vs été",
    "ſale", "ſITE", "buy ıdeas", "İdeas", "tıps", "a_b vs_", "how", "however", "", "who's", "deal", "deals", "ideal",
    "new-york best", "ünbest", "bestü", "compare", "comparison", "difference", "help   center", "get", "get x", "forget x",
]


def as_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, keyword string")


def test_patterns_equal_python_regex(spark):
    groups = [intent.INFORMATIONAL, intent.TRANSACTIONAL, intent.NAVIGATIONAL, intent.COMMERCIAL, intent.LOCAL,
              intent.COMPARISON, intent.QUESTION]
    patterns = sorted({p for g in groups for p in g})
    df = as_df(spark, SAMPLES).withColumn("_f", T.folded(F.col("keyword")))
    rows = df.select("keyword", *[T.matches(F.col("_f"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for row in rows:
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == bool(re.search(p, row["keyword"], re.IGNORECASE)), (p, row["keyword"])


@pytest.mark.parametrize("pattern,literal", [
    (r"\bhow\s+to\b", "how"), (r"\bexample[s]?\b", "example"), (r"\bvs\.?\b", "vs"), (r"\b\d{5}\b", ""), (r"\?$", "?"),
    (r"\bin\s+[A-Z][a-z]+\b", "in"), (r"\bpros\s+and\s+cons\b", "pros"), (r"^who\b", "who"),
])
def test_required_text(pattern, literal):
    assert T.required_text(pattern) == literal


def test_canonical_equals_python(spark):
    texts = ["  A  b ", " Tab\tsep x ", "\x1cunit\x1fsep\x85", "Ünï  Cöde", "a.b!c", "\n", "x​ "]
    got = as_df(spark, texts).select(
        T.canonical(F.col("keyword")).alias("a"), T.canonical(F.col("keyword"), strip_special=True).alias("b")
    ).collect()
    for text, row in zip(texts, got):
        expected = re.sub(r"\s+", " ", text.strip().lower())
        assert row["a"] == expected
        assert row["b"] == re.sub(r"[^\w\s]", "", expected)


def test_validation_reasons(spark):
    texts = [None, "", "  ", "a", "x" * 200, "x" * 201, "HTTP://a", "https:/a", "123", "١٢٣", "12a", "???", "_", "é", " 7 "]
    rows = as_df(spark, texts)
    got = [r["reason"] for r in with_reason(rows).orderBy("row_id").collect()]
    blank, none = "Empty or whitespace-only", None
    assert got == [blank, blank, blank, none, none, "Too long (max 200 chars)", "URL detected", none, "Pure number",
                   "Pure number", none, "No alphanumeric characters", none, none, "Pure number"]
    rules = ValidationRules(min_length=3, allow_urls=True, allow_numbers=True)
    got = [r["reason"] for r in with_reason(rows, rules).orderBy("row_id").collect()]
    assert got[3] == "Too short (min 3 chars)" and got[6] is None and got[8] is None


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1}, {"b":2}', "[1,2]", "", "nope", " 3 "]
    got = as_df(spark, texts).orderBy("row_id").select(T.strict_json(F.col("keyword")).isNotNull().alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False, True, False, False, True]


def test_generic_labels(spark):
    texts = ["Cluster 3", "cluster", "Clusters", "cluster of 5 things", "Group 1", "grouping", "Category", "misc stuff",
             "Others", "12 keywords", "12 keyword", "Running Shoes"]
    got = as_df(spark, texts).orderBy("row_id").select(labels.is_generic(F.col("keyword")).alias("g")).collect()
    assert [r["g"] for r in got] == [True, True, False, True, True, False, True, True, True, True, True, False]


def test_theme_uses_whole_words_and_first_seen_ties(spark):
    rows = [(0, 1, "élan abc1 beta alpha"), (1, 1, "Alpha beta best"), (2, 2, "12 ??"), (3, 3, "the and")]
    df = spark.createDataFrame(rows, "row_id long, cluster_id int, keyword string")
    assert {r["cluster_id"]: r["theme"] for r in labels.themes(df).collect()} == {1: "Beta Alpha"}
