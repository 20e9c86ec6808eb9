from pyspark.sql import functions as F

from termloom.operators.coarse import CoarseSettings
from termloom.operators.embed import batch_model, embed_missing, embed_texts, hashed_ngrams
from termloom.plans.keyword_run import RunSettings, run

TOPICS = ["red running shoes", "project management software", "chocolate cake recipe", "electric guitar lessons"]


def raw_rows(spark):
    rows, n = [], 0
    for t, topic in enumerate(TOPICS):
        for extra in ["", " online", " best", " cheap", " near me", " guide", " 2024", " for beginners", " reviews"]:
            rows.append((n, topic + extra, 10 * n + t, float(n % 90), 0.5))
            n += 1
    rows += [(n, "  RED running   shoes", 999, 1.0, 2.0), (n + 1, "12345", 5, 1.0, 1.0), (n + 2, "https://x.y", 5, 1.0, 1.0)]
    return spark.createDataFrame(rows, "row_id long, keyword string, search_volume long, keyword_difficulty double, cpc double")


def test_run_end_to_end(spark):
    raw = raw_rows(spark)
    serps = raw.select("keyword", F.array(F.substring("keyword", 1, 3)).alias("urls"))
    result = run(raw, RunSettings(coarse=CoarseSettings(seeds=(42,), max_iter=5)), hashed_ngrams(128), serps)
    members = result.members.collect()
    assert len(members) == 36 and {m["keyword"] for m in members if "RED" in m["keyword"]} == {"  RED running   shoes"}
    report = result.report.collect()
    assert report and sum(r["size"] for r in report) == sum(m["cluster_id"] >= 0 for m in members)
    assert len({r["label"].lower() for r in report}) == len(report)
    assert [r["priority_score"] for r in report] == sorted((r["priority_score"] for r in report), reverse=True)
    summary = result.summary.first()
    assert summary["total_keywords"] == 36 and summary["n_clusters"] == len(report)
    assert result.validations.count() > 0


def test_providers(spark, tmp_path):
    texts = spark.createDataFrame([("alpha",), ("beta",), ("alpha",), (None,)], "keyword string")

    def make_predict():
        import numpy as np

        return lambda batch: np.array([[len(t), 1.0] for t in batch], dtype="float32")

    got = {r["text"]: r["vec"] for r in embed_texts(texts, batch_model(make_predict, 1)).collect()}
    assert got == {"alpha": [5.0, 1.0], "beta": [4.0, 1.0]}
    path = str(tmp_path / "cache")
    assert embed_missing(texts.limit(1), path, hashed_ngrams(16)).count() == 1
    assert embed_missing(texts, path, hashed_ngrams(16)).count() == 2


def test_entry(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert df.columns[0] == "id" and df.count() > 0
