"""Readers of stored service responses: search results, keyword metrics and model label answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import strict_json, strip
from termloom.operators.labels import is_generic

_ORGANIC = "array<struct<link:string,title:string,position:int,snippet:string>>"
SERP_SCHEMA = (
    f"organic {_ORGANIC}, peopleAlsoAsk array<struct<question:string>>, relatedSearches array<struct<query:string>>"
)
METRICS_SCHEMA = (
    "tasks array<struct<result:array<struct<keyword:string,search_volume:bigint,keyword_difficulty:double,cpc:double,"
    "competition:double>>>>"
)


def _texts(items: Column, field: str) -> Column:
    """Non-empty values of one field, in order."""
    picked = F.filter(F.transform(items, lambda i: i[field]), lambda t: t != "")
    return F.coalesce(picked, F.array().cast("array<string>"))


def parse_serps(raw: DataFrame) -> DataFrame:
    """(keyword, response JSON) to result structs, URLs, titles, questions and related queries.

    An unreadable response gives empty lists, like a failed lookup.
    """
    r = raw.select("keyword", F.from_json("response", SERP_SCHEMA).alias("r"))
    organic = F.transform(
        "r.organic",
        lambda o: F.struct(o["link"].alias("url"), o["title"], o["position"], o["snippet"]),
    )
    return r.select(
        "keyword",
        F.coalesce(organic, F.array().cast(_ORGANIC.replace("link", "url"))).alias("organic"),
        _texts(F.col("r.organic"), "link").alias("urls"),
        _texts(F.col("r.organic"), "title").alias("titles"),
        _texts(F.col("r.peopleAlsoAsk"), "question").alias("people_also_ask"),
        _texts(F.col("r.relatedSearches"), "query").alias("related_searches"),
    )


def parse_metrics(raw: DataFrame) -> DataFrame:
    """(response_id, response JSON) to one metrics row per keyword; the latest mention wins."""
    tasks = raw.select("response_id", F.from_json("response", METRICS_SCHEMA).alias("r")).select(
        "response_id", F.posexplode("r.tasks").alias("task", "t")
    )
    items = tasks.select("response_id", "task", F.posexplode("t.result").alias("item", "m")).filter("m.keyword <> ''")
    latest = F.max_by("m", F.struct("response_id", "task", "item"))
    return items.groupBy(F.col("m.keyword").alias("keyword")).agg(latest.alias("m")).select(
        "keyword",
        F.coalesce("m.search_volume", F.lit(0).cast("long")).alias("search_volume"),
        *[F.coalesce(f"m.{c}", F.lit(0.0)).alias(c) for c in ("keyword_difficulty", "cpc", "competition")],
    )


# Line formats a label answer may use when it is not JSON.
LINE_FORMATS = [
    r"""[Cc]luster\s*(\d+)[:\s]+["']?([^"'\n,]+)["']?""",
    r"""(\d+)[.)\s]+["']?([^"'\n,]+)["']?""",
    r'''"cluster_id":\s*(\d+)[^"]*"label":\s*"([^"]+)"''',
]

_ITEM = "array<struct<cluster_id:variant,label:variant>>"


def _truthy_json(text: Column) -> Column:
    value = strict_json(text)
    return F.when(~F.to_json(value).isin("{}", "[]", '""', "null", "false", "0"), value)


def _between(text: Column, opening: str, closing: str) -> Column:
    """Text from the first `opening` to the last `closing` character."""
    start = F.instr(text, opening)
    end = F.length(text) - F.instr(F.reverse(text), closing) + 1
    found = (start > 0) & F.contains(text, F.lit(closing)) & (end > start)
    return F.when(found, F.substring(text, start, end - start + 1))


def _line_labels(text: Column) -> Column:
    """Labels of the first line format with any hit."""
    kind = "array<struct<cluster_id:string,label:string>>"

    def hits(pattern: str) -> Column:
        regex = F.lit("(?U)" + pattern)
        return F.arrays_zip(
            F.regexp_extract_all(text, regex, F.lit(1)).alias("cluster_id"),
            F.regexp_extract_all(text, regex, F.lit(2)).alias("label"),
        ).cast(kind)

    chosen = F.array().cast(kind)
    for pattern in reversed(LINE_FORMATS):
        chosen = F.when(F.size(hits(pattern)) > 0, hits(pattern)).otherwise(chosen)
    return F.filter(
        F.transform(chosen, lambda h: F.struct(h["cluster_id"].alias("cluster_id"), strip(h["label"]).alias("label"))),
        lambda h: F.length(h["label"]) > 2,
    )


def parse_labels(raw: DataFrame, strict_ids: bool = False) -> DataFrame:
    """(response_id, response) to usable (cluster_id, label) pairs; the last mention of a cluster wins.

    Tried in order: the whole text as JSON, its outermost object, its outermost array, then the line formats.
    The first that yields a non-empty value decides. `strict_ids` ignores cluster ids given as JSON strings.
    """
    text = F.col("response")
    whole, inner, listed = (
        _truthy_json(strip(text)),
        _truthy_json(_between(text, "{", "}")),
        _truthy_json(_between(text, "[", "]")),
    )
    read = raw.select("response_id", "response", whole.alias("w"), inner.alias("o"), listed.alias("l"))
    value = F.coalesce("w", "o")
    from_object = F.when(
        F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$.labels", _ITEM)
    )
    items = F.when(value.isNotNull(), from_object).otherwise(F.try_variant_get("l", "$", _ITEM))
    number_only = F.lit(not strict_ids)

    def as_text(item: Column) -> Column:
        usable = number_only | ~F.schema_of_variant(item["cluster_id"]).startswith("STRING")
        return F.struct(
            F.when(usable, F.try_variant_get(item["cluster_id"], "$", "string")).alias("cluster_id"),
            F.try_variant_get(item["label"], "$", "string").alias("label"),
        )

    found = F.when(F.coalesce(value, F.col("l")).isNotNull(), F.transform(items, as_text)).otherwise(_line_labels(text))
    rows = read.select("response_id", F.posexplode(found).alias("pos", "item")).select(
        "response_id", "pos", F.col("item.cluster_id").try_cast("long").alias("cluster_id"), F.col("item.label").alias("label")
    )
    cleaned = F.regexp_replace(F.regexp_replace(strip(F.col("label")), '^"+|"+$', ""), "^'+|'+$", "")
    kept = (
        rows.filter("cluster_id is not null and length(label) > 2")
        .withColumn("label", cleaned)
        .filter(~is_generic(F.col("label")))
    )
    return kept.groupBy("cluster_id").agg(F.max_by("label", F.struct("response_id", "pos")).alias("label"))
