"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join. Spark functions only.

A listed URL is a host and a path prefix. A URL is judged by every listed URL whose host equals its host or is a parent
domain of it and whose path is a prefix of its path; the longest one wins. Each such pair (parent host, path prefix) is
one canonical key, so a listed URL is found by equality. Most keys are not listed: the filter drops them before the join,
and the join drops what the filter lets through by chance.

The filter is a table of blocks. A key's hash picks one block of four 64-bit words and two bits in each word, so one
lookup touches one row. Table and rules are broadcast only while their counted rows stay below `BROADCAST_ROWS`; beyond
that both joins are shuffled joins on well-spread keys.

Defined cases: a null URL or one without `://` has empty host and path and meets no rule; an empty rule table gives every
URL the default verdict; a rule given twice counts once, and of two verdicts for one rule `block` wins; rules with a null
host or path are ignored. Rows of the input are kept as they are, repeated ids included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_BLOCK = 16
BROADCAST_ROWS = 100_000
WORDS = 4


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with columns host, path, rule (the winning listed URL or null) and verdict in place of any of that name.

    `rules`: host, path, verdict.
    """
    listed = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.concat("host", "path").alias("rule"))
        .agg(
            F.max("verdict").alias("verdict"),
            F.first(F.size(F.split("host", r"\."))).alias("labels"),
            F.first(F.length("path")).alias("prefix"),
        )
    )
    n_rules = listed.count()
    parts = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    if not n_rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    places = parts.select("host", "path").distinct()
    hits = _sized(listed.select("rule", "verdict"), n_rules)
    passed = _probe(_keys(places, listed), _filter_blocks(listed, n_rules), n_rules)
    best = (
        passed.join(hits, "rule")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("_best"))
    )
    return (
        parts.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))})
        .drop("_best")
    )


def _keys(places: DataFrame, listed: DataFrame) -> DataFrame:
    """All canonical keys of each place that have as many host labels and path characters as some listed URL.

    The table of shapes is small whatever the number of rules: one row per number of labels with the prefix lengths.
    """
    shapes = listed.groupBy("labels").agg(F.sort_array(F.collect_set("prefix")).alias("prefixes"))
    labels = F.size(F.split("host", r"\."))
    suffix = F.expr("substring_index(host, '.', -labels)")
    tails = places.select("host", "path", F.explode(F.sequence(F.lit(1), labels)).alias("labels"))
    return (
        tails.join(F.broadcast(shapes), "labels")
        .select("host", "path", suffix.alias("tail"), F.explode("prefixes").alias("prefix"))
        .filter(F.length("path") >= F.col("prefix"))
        .select("host", "path", F.concat("tail", F.expr("left(path, prefix)")).alias("rule"))
    )


def _bits(n_rules: int) -> tuple[Column, list[Column]]:
    """Block and word masks of the column `rule`."""
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n_rules:
        blocks *= 2
    pick, bits = F.xxhash64("rule"), F.xxhash64("rule", F.lit(1))
    masks = []
    for word in range(WORDS):
        one, two = (F.shiftright(bits, 12 * word + 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(2))
        masks.append(_bit(one).bitwiseOR(_bit(two)))
    return F.pmod(pick, F.lit(blocks)), masks


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _filter_blocks(listed: DataFrame, n_rules: int) -> DataFrame:
    block, masks = _bits(n_rules)
    named = [m.alias(f"mask{i}") for i, m in enumerate(masks)]
    return (
        listed.select(block.alias("block"), *named)
        .groupBy("block")
        .agg(*(F.bit_or(f"mask{i}").alias(f"word{i}") for i in range(WORDS)))
    )


def _probe(keys: DataFrame, blocks: DataFrame, n_rules: int) -> DataFrame:
    """The keys whose bits are all set in their block."""
    block, masks = _bits(n_rules)
    set_bits = [F.col(f"word{i}").bitwiseAND(m) == m for i, m in enumerate(masks)]
    condition = set_bits[0]
    for more in set_bits[1:]:
        condition = condition & more
    found = keys.withColumn("block", block).join(_sized(blocks, n_rules), "block").filter(condition)
    return found.select("host", "path", "rule")


def _sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table
