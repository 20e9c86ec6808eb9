"""Delimited uploads: format detection, tolerant scan, column roles and typed projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import strip

# Column names per role in order of preference, delimiters, and texts read as missing.
KEYWORD_NAMES = [
    "keyword", "keywords", "query", "queries", "search term", "search_term", "searchterm", "term", "terms",
    "keyphrase", "key phrase", "kw", "word", "words", "top queries",
]
VOLUME_NAMES = [
    "search volume", "searchvolume", "search_volume", "volume", "vol", "monthly searches", "monthly_searches",
    "avg_monthly_searches", "avg monthly searches", "msv", "sv",
]
DIFFICULTY_NAMES = [
    "keyword difficulty", "keyword_difficulty", "kd", "difficulty", "seo difficulty", "seo_difficulty",
]
DELIMITERS = ",;\t|"
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_CORRUPT = "_corrupt_row"


def detect_delimiter(lines: DataFrame) -> str:
    """The delimiter that splits most of `lines` (value) into the same number of fields, two at least.

    Ties go to more fields, then to the order of DELIMITERS. Quoted parts do not count.
    """
    bare = F.regexp_replace("value", '"([^"]|"")*"', "")
    counts = [
        F.struct(F.lit(i).alias("place"), (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"))
        for i, d in enumerate(DELIMITERS)
    ]
    split = lines.select(F.explode(F.array(*counts)).alias("c")).filter("c.n > 0").groupBy("c.place", "c.n").count()
    best = split.orderBy(F.desc("count"), F.desc("n"), "place").first()
    return DELIMITERS[best["place"] if best else 0]


def detect_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """(delimiter, encoding) of a file set, from all its lines."""
    lines = spark.read.text(path)
    encoding = "UTF-8" if lines.filter(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"
    return detect_delimiter(lines.select(F.make_valid_utf8("value").alias("value"))), encoding


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    multiline: bool = False,
    delimiter: str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """All-string rows of a delimited file set with `row_id` in file order.

    Rows with more fields than the header are dropped and short rows padded with NULL. `columns` names the
    fields of files without a header. `multiline` allows line breaks inside quotes and makes files unsplittable.
    Giving both `delimiter` and `encoding` spares the detection pass.
    """
    if delimiter is None or encoding is None:
        found = detect_format(spark, path)
        delimiter, encoding = delimiter or found[0], encoding or found[1]
    options = {
        "sep": delimiter, "encoding": encoding, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _CORRUPT, "multiLine": str(multiline).lower(), "header": str(columns is None).lower(),
    }
    if columns is None:
        columns = spark.read.options(**{**options, "enforceSchema": "false"}).csv(path).columns
    fields = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(f"{fields}, {_CORRUPT} string").options(**options).csv(path)
    bare = F.regexp_replace(_CORRUPT, '"([^"]|"")*"', "")
    field_count = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    kept = rows.withColumn("row_id", F.monotonically_increasing_id()).filter(
        F.col(_CORRUPT).isNull() | (field_count <= len(columns))
    )
    return kept.drop(_CORRUPT)


def detect_roles(columns: list[str]) -> dict[str, str | None]:
    """Keyword, volume and difficulty columns by name, the most preferred name first."""
    normalized = {str(c).lower().strip(): c for c in columns}

    def first(names: list[str]) -> str | None:
        return next((normalized[n] for n in names if n in normalized), None)

    return {
        "keyword": first(KEYWORD_NAMES), "search_volume": first(VOLUME_NAMES), "keyword_difficulty": first(DIFFICULTY_NAMES),
    }


def _number(name: str) -> Column:
    """Cell as a finite double, 0 when missing or malformed."""
    text = F.regexp_replace(strip(F.col(f"`{name}`")), "(?<=[0-9])_(?=[0-9])", "")
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.coalesce(F.when(F.abs(value) < float("inf"), value), F.lit(0.0))


def project_roles(
    raw: DataFrame, keyword: str | None = None, volume: str | None = None, difficulty: str | None = None
) -> DataFrame:
    """Typed keyword rows from a raw upload; unnamed roles are detected, absent ones leave no column.

    Missing and blank keywords are dropped; volumes truncate towards zero; unusable numbers become 0.
    """
    roles = detect_roles([c for c in raw.columns if c != "row_id"])
    keyword = keyword or roles["keyword"]
    if keyword is None or keyword not in raw.columns:
        raise ValueError(f"no keyword column among {raw.columns}")
    cell = F.col(f"`{keyword}`")
    columns = [F.col("row_id")] if "row_id" in raw.columns else []
    columns.append(strip(cell).alias("keyword"))
    volume = volume or roles["search_volume"]
    if volume in raw.columns:
        columns.append(_number(volume).cast("long").alias("search_volume"))
    difficulty = difficulty or roles["keyword_difficulty"]
    if difficulty in raw.columns:
        columns.append(_number(difficulty).alias("keyword_difficulty"))
    return raw.filter(cell.isNotNull() & ~cell.isin(MISSING)).select(*columns).filter(F.col("keyword") != "")


def preview(raw: DataFrame, n: int = 5) -> tuple[dict, DataFrame]:
    """Column facts of an upload and its first `n` rows."""
    columns = [c for c in raw.columns if c != "row_id"]
    roles = detect_roles(columns)
    facts = {
        "columns": columns,
        "total_columns": len(columns),
        "row_count": raw.count(),
        "detected": roles,
        "has_volume": roles["search_volume"] is not None,
        "has_kd": roles["keyword_difficulty"] is not None,
    }
    return facts, raw.orderBy("row_id").limit(n)
