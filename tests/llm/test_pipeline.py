"""The whole pipeline: what each stage keeps and removes, and its registration."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import shingles, words
from termloom.llm import catalog
from termloom.session import cut_lineage

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(cut_lineage(stage(spark, seen[-1], SF)))
    assert all(d.columns == columns for d in seen[:-1])
    before, good, single, cut, clean = ({r.doc_id: r.text for r in d.collect()} for d in seen[:-1])

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    labelled = [i for i in before if i in quality]
    assert sum((i in good) == bool(quality[i]) for i in labelled) >= 0.95 * len(labelled)

    assert len(set(single.values())) == len(single) and set(single) <= set(good)
    bags = {i: shingles(t) for i, t in single.items()}
    for i in set(good) - set(single):
        bag = shingles(good[i])
        near = max((sum((bag & b).values()) / max(sum((bag | b).values()), 1) for b in bags.values()), default=0)
        assert near > 0.5 or not bag

    windows: set[bytes] = set()
    for i in sorted(cut):
        data = single[i].encode()
        own = {data[s : s + 100] for s in range(len(data) - 99)}
        assert cut[i] == single[i] or own & windows or len(own) < len(data) - 99
        windows |= own

    items = [" " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, t in cut.items() if any(item in " " + " ".join(words(t)) + " " for item in items)}
    assert held and not held & set(clean) and len(clean) >= len(cut) - 2 * len(held)

    packed = seen[-1].collect()
    assert {r.doc_id for r in packed} == set(clean)
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= 1.01 * total / 2048 + 1


@pytest.mark.parametrize("rows", ["awkward", "empty"])
def test_awkward_tables(request, spark, tmp_path, rows):
    """Null and repeated ids, null, empty and very long texts, names that stages use inside or that hold a dot, no rows."""
    docs = request.getfixturevalue(rows).withColumn("a.b", F.lit("kept"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = cut_lineage(stage(spark, seen, str(tmp_path)))
        assert seen.columns == docs.columns and seen.filter("`a.b` <> 'kept'").isEmpty(), name
    left = {r.doc_id for r in seen.collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == left and all(0 <= r.offset <= 2048 - r.length for r in packed)
    if rows == "awkward":
        assert len({i for i in left if i in (8, 9)}) <= 1


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and set(catalog.builders()) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.builders()) == list(range(1, 14))
    assert set(catalog.oracles()) <= set(entry.oracle_sql())
