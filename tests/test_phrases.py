"""Most frequent phrases of clusters that are counted in parts, against a count of all phrases."""

from collections import Counter, defaultdict

import numpy as np

from termloom.operators import labels


def brute_force(rows):
    """Of the phrases of two and three words the most frequent, ties to the earliest."""
    counts, first = defaultdict(Counter), {}
    for cluster, row, text in rows:
        w = text.lower().split() if text else []
        grams = [" ".join(w[i : i + 2]) for i in range(len(w) - 1)] + [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        for pos, gram in enumerate(grams):
            counts[cluster][gram] += 1
            first[cluster, gram] = min(first.get((cluster, gram), (row, pos)), (row, pos))
    best = {c: min(n.items(), key=lambda x: (-x[1], first[c, x[0]])) for c, n in counts.items() if c >= 0}
    return {c: phrase for c, (phrase, n) in best.items() if n >= 3}


def test_phrases_of_parts_equal_a_count_of_all(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(600):
        share = rng.dirichlet(np.full(40, (0.05, 1, 50)[i % 3]))
        rows.append((i % 7 - 1, i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30)), p=share))))
    rows += [(20, 1000 + i, "only one two three") for i in range(4)] + [(21, 2000, "once and never again"), (22, 2001, None)]
    df = spark.createDataFrame(rows, "cluster_id long, row_id long, keyword string")
    want = brute_force(rows)
    monkeypatch.setattr(labels, "PART_BYTES", 1500)
    got = labels.common_phrases(df)
    assert {r.cluster_id: r.phrase for r in got.collect()} == want
    assert len(want) >= 7


def test_phrases_are_counted_where_texts_lie(spark, monkeypatch):
    """Only texts are shuffled: phrases are aggregated without an exchange between the explosion and their counts."""
    df = spark.createDataFrame([(1, i, "a b c d") for i in range(50)], "cluster_id long, position long, text string")
    sizes = spark.createDataFrame([(1, 350, 4)], "cluster_id long, bytes long, parts long")
    plan = labels._part_counts(df, sizes)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "HashAggregate" in above and "Exchange" not in above
