import random

from termloom.operators import dedup


def expected_merge(rows):
    keys = {}
    for row_id, keyword, vol, kd, cpc in rows:
        key = " ".join(keyword.strip().lower().split())
        new = {"search_volume": vol or 0, "keyword_difficulty": kd or 0.0, "cpc": cpc or 0.0}
        if key not in keys:
            keys[key] = [keyword, 0, new]
            continue
        state = keys[key]
        state[1] += 1
        old = state[2]
        if new["search_volume"] > old["search_volume"]:
            a, b = old["keyword_difficulty"], new["keyword_difficulty"]
            state[0] = keyword
            state[2] = {
                "search_volume": old["search_volume"] + new["search_volume"],
                "keyword_difficulty": (a + b) / 2 if a > 0 and b > 0 else (b or a),
                "cpc": max(old["cpc"], new["cpc"]),
            }
    return {k: (s[0], s[1], s[2]["search_volume"], round(s[2]["keyword_difficulty"], 9), s[2]["cpc"]) for k, s in keys.items()}


def make_rows(seed, n=400):
    rng = random.Random(seed)
    names = ["Hot key"] * 6 + [f"key {i}" for i in range(20)]
    rows = []
    for i in range(n):
        name = rng.choice(names)
        name = rng.choice([name, name.upper(), f"  {name} ", name.replace(" ", "  ")])
        rows.append((i * 3, name, rng.choice([None, 0, i, 2 ** rng.randrange(20)]), rng.choice([None, 0.0, 5.0, 40.0]), rng.choice([None, 0.5, 2.0])))
    return rows


def test_merge_equals_sequential_fold_on_both_paths(spark):
    rows = make_rows(1)
    df = spark.createDataFrame(rows, "row_id long, keyword string, search_volume long, keyword_difficulty double, cpc double")
    for limit in (1000, 5):
        got = {
            r["canonical"]: (r["keyword"], r["duplicate_count"], r["search_volume"], round(r["keyword_difficulty"], 9), r["cpc"])
            for r in dedup.merge_duplicates(df.repartition(5), gather_limit=limit).collect()
        }
        assert got == expected_merge(rows)


def test_ascending_hot_key(spark):
    rows = [(i, "same", i + 1, 10.0, 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, keyword string, search_volume long, keyword_difficulty double, cpc double")
    got = dedup.merge_duplicates(df, gather_limit=10).first()
    assert (got["search_volume"], got["duplicate_count"]) == (expected_merge(rows)["same"][2], 299)


def test_keep_best_prefers_volume_then_first_row(spark):
    rows = [(5, "b", 3), (1, "A", 7), (2, "a", 7), (3, " a ", None), (9, "", 1)]
    df = spark.createDataFrame(rows, "row_id long, keyword string, search_volume long")
    got = {r["canonical"]: (r["row_id"], r["first_row_id"]) for r in dedup.keep_best(df).collect()}
    assert got == {"a": (1, 1), "b": (5, 5)}


def test_empty_input(spark):
    df = spark.createDataFrame([], "row_id long, keyword string, search_volume long, keyword_difficulty double, cpc double")
    stats = dedup.dedup_stats(df).first()
    assert (stats["original_count"], stats["reduction_rate"]) == (0, 0.0)
    assert dedup.merge_duplicates(df).count() == 0
