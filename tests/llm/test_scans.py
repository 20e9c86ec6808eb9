"""License scan and URL filter against brute force and SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import AWKWARD, words
from tests.oracle import compare, connect
from termloom.llm import catalog
from termloom.llm.license_templates import compile_template, scan_licenses
from termloom.llm.textbytes import word_hash
from termloom.llm.url_filter import judge_urls

SF = "/root/testdata/sf0.01"


def hashes(text: str) -> np.ndarray:
    return np.array([word_hash(w) for w in words(text)], np.uint64)


@pytest.mark.parametrize(
    ("text", "end"),
    [
        ("released under the mit license", 5),
        ("this is released under the mit license now", 7),
        ("released under a mit license", -1),
        ("licensed by foo bar for use", 6),
        ("licensed by foo for use", 5),
        ("licensed by for use", -1),
        ("licensed by a b c for use", -1),
    ],
)
def test_automata(text, end):
    templates = ["[[this is]] released under the mit license", "licensed by {{1..2}} for use"]
    automata = [compile_template("x", t) for t in templates]
    got = max(a.match(hashes(text), 0, len(words(text))) for a in automata)
    assert got == end


@pytest.mark.parametrize("template", ["[[optional only]]", "{{1..2}} words first", "[[open"])
def test_bad_templates_are_refused(template):
    with pytest.raises(ValueError):
        compile_template("x", template)


def test_places_match_brute_force(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = [(10**6, "CC BY-NC cc by nc; under the MIT license under the mit license"), (10**6 + 1, "under the mit"), (10**6 + 2, "license")]
    docs = docs.union(spark.createDataFrame(planted, "doc_id long, text string")).union(awkward.select("doc_id", "text"))
    got = scan_licenses(docs, catalog.LICENSE_PHRASES, catalog.LICENSE_TEMPLATES).collect()
    want = []
    for doc_id, text in docs.collect():
        w, at, labels = words(text), [], set()
        for phrase, label in catalog.LICENSE_PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.append((doc_id or 0, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    key = lambda r: tuple(-1 if x is None else x for x in r[:3])
    assert sorted(((r.doc_id or 0, *tuple(r)[1:6]) for r in got), key=key) == sorted(want, key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert any("gpl-3-notice" in r.labels for r in got)
    assert scan_licenses(empty, catalog.LICENSE_PHRASES, catalog.LICENSE_TEMPLATES).count() == 0
    assert len(scan_licenses(awkward, {}, catalog.LICENSE_TEMPLATES).collect()) == len(AWKWARD)


def test_url_filter_matches_sql(spark):
    assert compare(catalog.op10_url_filter(spark, SF), connect(SF), catalog.OP10_SQL) == []


def test_urls_of_awkward_rows(spark):
    urls = [None, "", "no scheme", "http://", "http://COM", "http://com/", "ftp://a.Example.com/en/x?q#f", "https://www.example.com/en/",
            "x://notexample.com/en/", "x://net/es", "x://net/es/", "x://a.b.c.net/fr/?", "x://é.net/fr/", "a://b://net/es/", "x://net?/es/"]
    pages = spark.createDataFrame([(i, u, "old", "keep") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string, extra string")
    rules = spark.createDataFrame([*catalog.URL_RULES, catalog.URL_RULES[0], (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = judge_urls(pages, rules)
    assert "extra" in got.columns and got.count() == len(urls) * 2
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.sql(catalog.OP10_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want
    none = judge_urls(pages, rules.limit(0))
    assert none.filter("rule is not null or verdict <> 'allow'").isEmpty()
    assert judge_urls(pages.limit(0), rules).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))
