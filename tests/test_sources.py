import pytest

from termloom.operators.enrich import request_batches
from termloom.sources.delimited import detect_delimiter, detect_format, detect_roles, preview, project_roles, read_delimited
from termloom.sources.responses import parse_labels, parse_metrics, parse_serps
from termloom.sources.tables import JobTables


def write(tmp_path, text, encoding="utf-8"):
    path = tmp_path / "upload.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    lines = [["Keyword", "Volume", "KD"], ["red shoes", "10", "3.5"], ["blue shoes", "20", "4"]]
    path = write(tmp_path, "\n".join(sep.join(line) for line in lines) + "\n")
    assert detect_format(spark, path)[0] == sep
    rows = project_roles(read_delimited(spark, path)).orderBy("row_id").collect()
    assert [(r["keyword"], r["search_volume"], r["keyword_difficulty"]) for r in rows] == [
        ("red shoes", 10, 3.5), ("blue shoes", 20, 4.0)
    ]


def test_batches_of_hashed_row_ids(spark):
    rows = spark.range(1000).selectExpr("xxhash64(id) as row_id", "cast(id as string) as keyword")
    got = sorted(request_batches(rows, 30).collect())
    assert [b.batch for b in got] == list(range(1, 35)) and [len(b.keywords) for b in got] == [30] * 33 + [10]
    order = [r.keyword for r in rows.orderBy("row_id").collect()]
    assert [k for b in got for k in b.keywords] == order


def test_job_tables_delete_and_reinsert(spark, tmp_path):
    tables = JobTables(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "x", 5), (2, "x", 6)], "row_id long, keyword string, search_volume long")
    tables.insert_keywords("a", rows)
    changes = spark.createDataFrame([("x", 7, 1), ("x", 3, 2)], "keyword string, search_volume long, step int")
    tables.update_keywords("a", changes, sequence="step")
    assert [r.search_volume for r in tables.read("keywords").collect()] == [3, 3]
    tables.delete_job("a")
    assert tables.read("keywords").count() == 0
    tables.insert_keywords("a", rows.limit(1))
    assert tables.read("keywords").count() == 1


def test_update_that_fails_is_never_seen(spark, tmp_path, monkeypatch):
    """Rows of an update count only once its version is listed; until then reads give the rows before."""
    tables = JobTables(spark, str(tmp_path / "old"))
    rows = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "row_id long, keyword string, search_volume long")
    tables.insert_keywords("a", rows)
    tables.insert_keywords("b", rows)
    change = spark.createDataFrame([("x", 9)], "keyword string, search_volume long")
    original = tables._write

    def lost(name, df):
        if name == "commits":
            raise RuntimeError("driver lost")
        original(name, df)

    def volumes(of, job):
        return sorted((r.keyword, r.search_volume) for r in of.keywords(job).collect())

    monkeypatch.setattr(tables, "_write", lost)
    with pytest.raises(RuntimeError):
        tables.update_keywords("a", change)
    monkeypatch.undo()
    assert volumes(tables, "a") == volumes(tables, "b") == [("x", 5), ("y", 6)]
    tables.update_keywords("a", change)
    tables.insert_keywords("a", rows.limit(1).selectExpr("3L as row_id", "'z' as keyword", "1L as search_volume"))
    assert volumes(tables, "a") == [("x", 9), ("y", 6), ("z", 1)] and volumes(tables, "b") == [("x", 5), ("y", 6)]
    tables.compact("keywords", str(tmp_path / "new"))
    new = JobTables(spark, str(tmp_path / "new"))
    assert volumes(new, "a") == [("x", 9), ("y", 6), ("z", 1)] and new._stored("keywords").count() == 5


def test_delimiter_of_all_lines(spark):
    def found(*lines):
        return detect_delimiter(spark.createDataFrame([(x,) for x in lines], "value string"))

    assert found() == found("abc") == ","
    assert found("a;b,c", "1;2", "3;4", '"x,y,z";5') == ";"
    assert found(*["a,b"] * 3, *["a;b;c;d"] * 300) == ";"


def test_long_rows_go_short_rows_stay(spark, tmp_path):
    path = write(tmp_path, 'kw,volume\na,1\nb,2,3\nc\n"d, ""x""",4\n"e, f",5,6\n')
    rows = read_delimited(spark, path).orderBy("row_id").collect()
    assert [(r["kw"], r["volume"]) for r in rows] == [("a", "1"), ("c", None), ('d, "x"', "4")]


def test_latin1(spark, tmp_path):
    path = write(tmp_path, "keyword,volume\ncafé,5\nnaïve,6\n", "latin-1")
    assert detect_format(spark, path) == (",", "ISO-8859-1")
    assert {r["keyword"] for r in read_delimited(spark, path).collect()} == {"café", "naïve"}


def test_roles_and_missing_columns(spark):
    assert detect_roles(["Query", " Keyword ", "SV", "vol"]) == {
        "keyword": " Keyword ", "search_volume": "vol", "keyword_difficulty": None
    }
    df = spark.createDataFrame([(0, "a"), (1, "NaN"), (2, " nan "), (3, None)], "row_id long, term string")
    out = project_roles(df)
    assert out.columns == ["row_id", "keyword"] and [r["keyword"] for r in out.orderBy("row_id").collect()] == ["a", "nan"]
    with pytest.raises(ValueError):
        project_roles(df.withColumnRenamed("term", "text"))
    facts, sample = preview(df, 2)
    assert facts["row_count"] == 4 and not facts["has_volume"] and sample.count() == 2


def test_numbers(spark):
    cells = ["12", "12.9", "-3.9", "1,000", "1e3", "inf", "nan", "1_000", " 7 ", "7d", "0x10", None, "."]
    df = spark.createDataFrame([(i, "k", c) for i, c in enumerate(cells)], "row_id long, keyword string, volume string")
    got = [r["search_volume"] for r in project_roles(df).orderBy("row_id").collect()]
    assert got == [12, 12, -3, 0, 1000, 0, 0, 1000, 7, 0, 0, 0, 0]


def test_label_answers(spark):
    answers = [
        '{"labels": [{"cluster_id": 0, "label": "Red Shoes"}, {"cluster_id": 0, "label": "Blue Shoes"}]}',
        'Fine:\n```json\n{"labels": [{"cluster_id": 1, "label": "\'Hats\'"}, {"cluster_id": 2, "label": "misc"}]}\n```',
        'x [{"cluster_id": 3, "label": "Coats"}, {"cluster_id": "4", "label": "Gloves"}] y',
        "Cluster 5: Boots\ncluster 6: \"Bags\"\n7. Ignored",
        "8. Belts\n9) Ties",
        '[{"cluster_id": 10, "label": "Whole array"}]',
        "nothing here",
        "",
        '{"labels": [{"cluster_id": null, "label": "No id"}, {"label": "No id"}, {"cluster_id": 11, "label": "ab"}]}',
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "response_id int, response string")
    expected = {0: "Blue Shoes", 1: "Hats", 3: "Coats", 4: "Gloves", 5: "Boots", 6: "Bags", 8: "Belts", 9: "Ties"}
    assert {r["cluster_id"]: r["label"] for r in parse_labels(df).collect()} == expected
    strict = {r["cluster_id"]: r["label"] for r in parse_labels(df, strict_ids=True).collect()}
    assert strict == {k: v for k, v in expected.items() if k != 4}


def test_service_responses(spark):
    serp = spark.createDataFrame(
        [("a", '{"organic": [{"link": "u1", "title": ""}, {"title": "t2", "position": 2}]}'), ("b", "oops"), ("c", "{}")],
        "keyword string, response string",
    )
    rows = {r["keyword"]: r for r in parse_serps(serp).collect()}
    assert rows["a"]["urls"] == ["u1"] and rows["a"]["titles"] == ["t2"] and len(rows["a"]["organic"]) == 2
    assert rows["b"]["urls"] == [] and rows["c"]["related_searches"] == []
    metrics = spark.createDataFrame(
        [(0, '{"tasks": [{"result": null}, {"result": [{"keyword": "k", "search_volume": 1}, {"keyword": ""}]}]}'),
         (1, '{"tasks": [{"result": [{"keyword": "k", "cpc": 0.5}]}]}'), (2, '{"tasks": null}')],
        "response_id int, response string",
    )
    got = [tuple(r) for r in parse_metrics(metrics).collect()]
    assert got == [("k", 0, 0.0, 0.5, 0.0)]
