import random

from termloom.operators.label_choice import choose_labels, unique_labels


def sequential(choices):
    used, chosen = set(), {}
    for cluster_id, candidates, terminal in sorted(choices):
        text = next((c for c in candidates if c.lower() not in used), None)
        if text is None:
            text, n = terminal, 1
            while text.lower() in used:
                n += 1
                text = f"{terminal} {n}"
        used.add(text.lower())
        chosen[cluster_id] = text
    return chosen


def solve(spark, choices):
    df = spark.createDataFrame(choices, "cluster_id long, candidates array<string>, terminal string")
    return {r["cluster_id"]: r["label"] for r in choose_labels(df).collect()}


def test_equals_sequential_choice(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pool = ["a", "A", "b", "a 2", "a 3", "b 2", "a 2 2", "c", "A 4", "a 02", "b 3"]
        choices = [
            (i * 2, [rng.choice(pool) for _ in range(rng.randrange(0, 4))], rng.choice(["a", "A", "b", "a 2"])) for i in range(30)
        ]
        assert solve(spark, choices) == sequential(choices)


def test_hot_terminal_needs_few_rounds(spark):
    choices = [(i, [], "Topic") for i in range(300)] + [(1000, ["topic 7"], "other"), (-5, ["topic 3"], "x")]
    assert solve(spark, choices) == sequential(choices)


def test_unique_suffixes(spark):
    df = spark.createDataFrame([(0, "Shoes"), (1, "shoes"), (2, "Hats"), (3, "SHOES")], "cluster_id long, label string")
    assert {r["cluster_id"]: r["label"] for r in unique_labels(df).collect()} == {0: "Shoes", 1: "shoes 2", 2: "Hats", 3: "SHOES 3"}
