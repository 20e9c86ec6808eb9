"""The keywords of the job tables are cleaned once, however many writes read them."""

from termloom.catalog import fixtures, metrics, storage
from termloom.catalog.registry import builders


def test_keyed_update_cleans_keywords_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"name {i % 40}", f"Brand#{11 + i % 15}", "PROMO", i % 50, 900.0 + i) for i in range(200)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/part.parquet")
    calls = []
    original = fixtures.clean_keywords

    def counting(*args):
        calls.append(args)
        return original(*args)

    for module in (storage, metrics):
        monkeypatch.setattr(module, "clean_keywords", counting)
    updated = builders()["B2_keyed_update"](spark, str(tmp_path))
    assert updated.count() == original(spark, str(tmp_path)).count()
    assert updated.filter("job_id = 'job-a' and keyword like 'buy%' and search_volume > 800").isEmpty()
    assert len(calls) == 1 and not any("part.parquet" in path for path in updated.inputFiles())
