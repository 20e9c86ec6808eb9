"""Quality classifier: tree paths become rules, a lasso picks and weighs them, the result is one Column expression.

1. Statistics of each whole text (FEATURES) are computed once and written.
2. A random forest is fitted on labelled rows. Each path from a root to any node below it is a rule: a conjunction of
   comparisons of statistics.
3. A logistic regression with an L1 penalty is fitted on the rules' 0/1 values; most weights become zero.
4. The rules that are left are compiled: score = sigmoid(intercept + sum of the weights of the rules that hold).

Fitting uses at most about `max_rows` labelled rows, chosen by a hash of the id; statistics and scores cover every row.

Defined cases: null and empty texts have statistics 0 and get the score the rules give these; rows without a label train
nothing; a label of null is no label; without training rows of both classes every score is the share of label 1 (0.5
without any). Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.textbytes import HASH_PIECE, Words, by_name, mix, pieces, prefix_hashes, span_hashes
from termloom.session import bound_batches, cut_lineage

MAX_ROWS = 40_000
TREES = 24
DEPTH = 4
PENALTY = 0.0005

FEATURES = [
    "log_bytes",
    "log_words",
    "word_bytes",
    "upper_share",
    "symbol_share",
    "digit_share",
    "space_share",
    "pipe_share",
    "bang_share",
    "other_byte_share",
    "distinct_share",
    "top_word_share",
    "again_share",
    "line_bytes",
    "repeated_line_share",
    "long_word_share",
    "wordlike_share",
]

Rule = tuple[tuple[int, str, float], ...]


def with_statistics(rows: DataFrame) -> DataFrame:
    """`rows` with FEATURES of the whole text in place of `text`."""
    others = [c for c in rows.columns if c != "text"]
    bound_batches(rows.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", limit=HASH_PIECE):
            values = _statistics(piece.column("text"))
            columns = [*(piece.column(c) for c in others), *(pa.array(v) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *FEATURES])

    schema = rows.drop("text").schema
    for feature in FEATURES:
        schema = schema.add(feature, "double")
    return rows.mapInArrow(measure, schema)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every row's whole text."""
    return with_statistics(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _statistics(column: pa.Array) -> list[np.ndarray]:
    words = Words(column)
    raw, offsets = words.raw, words.text_offsets
    n_bytes, n_words = np.diff(offsets), words.counts
    rows = len(n_bytes)

    def share(mask: np.ndarray, of: np.ndarray = n_bytes) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)

    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    visible = (raw > 32) & (raw < 127)
    digit = (raw >= 48) & (raw <= 57)
    line_end = raw == 10
    letters = share(upper | lower) * np.maximum(n_bytes, 1)

    row_of_word = np.repeat(np.arange(rows), n_words)
    lengths = words.ends - words.starts
    order = np.argsort(mix(words.hashes + row_of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    key_hash, key_row = words.hashes[order], row_of_word[order]
    new = np.ones(len(order), bool)
    new[1:] = (key_hash[1:] != key_hash[:-1]) | (key_row[1:] != key_row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, key_row[at], times)
    distinct = np.bincount(key_row[at], minlength=rows)
    again = np.zeros(len(row_of_word), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (row_of_word[1:] == row_of_word[:-1])

    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    edge[1:] |= line_end
    line_at = np.flatnonzero(edge)
    line_at, line_stop = line_at[:-1], line_at[1:]
    full = line_stop - line_at > 1
    line_at, line_stop = line_at[full], line_stop[full]
    line_row = np.searchsorted(offsets, line_at, side="right") - 1
    line_text_stop = np.where(raw[line_stop - 1] == 10, line_stop - 1, line_stop) if len(line_at) else line_stop
    line_hash = span_hashes(prefix_hashes(words.data), line_at, line_text_stop)
    _, first, inverse = np.unique(mix(line_hash + line_row.astype(np.uint64)), return_index=True, return_inverse=True)
    repeated = np.ones(len(line_at), bool)
    repeated[first] = False
    size = (line_stop - line_at).astype(float)
    repeated_bytes = np.bincount(line_row, weights=size * repeated, minlength=rows)
    n_lines = np.bincount(line_row, minlength=rows)

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(row_of_word, weights=values, minlength=rows) / np.maximum(n_words, 1)

    bounded = np.ones(len(raw) + 2, bool)
    bounded[1:-1] = (raw <= 32) | (raw == 46) | (raw == 44)
    plain = bounded[words.starts] & bounded[words.ends + 1]
    return [
        np.log1p(n_bytes),
        np.log1p(n_words),
        by_word(lengths),
        share(upper, letters),
        share(visible & ~upper & ~lower & ~digit),
        share(digit),
        share((raw <= 32)),
        share(raw == 124),
        share(raw == 33),
        share(raw >= 128),
        distinct / np.maximum(n_words, 1),
        top / np.maximum(n_words, 1),
        by_word(again),
        n_bytes / np.maximum(n_lines, 1),
        repeated_bytes / np.maximum(n_bytes, 1),
        by_word(lengths > 14),
        by_word(plain),
    ]


def training_rows(statistics: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """FEATURES and `label` (0 or 1) of labelled rows, about `max_rows` of them at most, picked by a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("label"))
    rows = statistics.join(known.filter("label in (0.0, 1.0)"), "doc_id")
    rows = cut_lineage(rows.select("label", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("pick"), *FEATURES))
    n = rows.count()
    return rows.filter(F.col("pick") < int(1_000_000 * min(1.0, max_rows / max(n, 1)))).drop("pick")


def fit_rules(
    rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 7
) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules for `rows` (FEATURES, label)."""
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        share = (ones + 0.5) / (n + 1)
        return float(np.log(share / (1 - share))), []
    vectors = rows.select("label", array_to_vector(F.array(*FEATURES)).alias("features")).coalesce(8).persist()
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed, maxBins=64
    ).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    held = F.array(*(rule_column(r).cast("double") for r in rules))
    tested = rows.select("label", array_to_vector(held).alias("features")).coalesce(8).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(tested)
    vectors.unpersist()
    tested.unpersist()
    weights = lasso.coefficients.toArray()
    return float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w != 0.0]


def tree_rules(description: str) -> list[Rule]:
    """The distinct paths in the printed form of a tree model, in order of appearance."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, str, float]]] = []
    for line in description.splitlines():
        indent = len(line) - len(line.lstrip())
        split = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r"\s*Tree \d+", line):
            path = []
        elif split:
            while path and path[-1][0] >= indent:
                path.pop()
            path.append((indent, (int(split[1]), split[2], float(split[3]))))
            found[_shortened(tuple(p for _, p in path))] = None
    return list(found)


def _shortened(rule: Rule) -> Rule:
    """One bound per statistic and direction: the tightest."""
    kept: dict[tuple[int, str], float] = {}
    for feature, sign, bound in rule:
        tighter = min if sign == "<=" else max
        kept[feature, sign] = tighter(kept.get((feature, sign), bound), bound)
    return tuple(sorted((f, s, b) for (f, s), b in kept.items()))


def rule_column(rule: Rule) -> Column:
    tests = [F.col(FEATURES[f]) <= b if sign == "<=" else F.col(FEATURES[f]) > b for f, sign, b in rule]
    return reduce(lambda a, b: a & b, tests)


def score_column(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """Probability of label 1, between 0 and 1."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, score and FEATURES of every row of `docs`, learnt from the rows that `labels` marks."""
    statistics = cut_lineage(text_statistics(docs))
    intercept, rules = fit_rules(training_rows(statistics, labels, label, max_rows))
    return statistics.select("doc_id", score_column(intercept, rules).alias("score"), *FEATURES)


def keep_quality(
    docs: DataFrame, labels: DataFrame, threshold: float, label: str = "quality", max_rows: int = MAX_ROWS
) -> DataFrame:
    """The rows of `docs`, all columns, whose score is at least `threshold`; learnt from the rows that `labels` marks.

    Texts are read twice and never shuffled: labels join the statistics.
    """
    intercept, rules = fit_rules(training_rows(text_statistics(docs), labels, label, max_rows))
    packed = docs.select(F.struct(*by_name(docs.columns)).alias("_row"), F.col("text").cast("string").alias("text"))
    scored = with_statistics(packed)
    return scored.filter(score_column(intercept, rules) >= threshold).select("_row.*")
