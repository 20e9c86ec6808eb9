"""Rows that may have one of many keys, told by a blocked Bloom filter before any exchange. DataFrame functions only.

Used in front of exact joins: rows that surely lack the keys need not be shuffled. The filter is a table of at most MOST_WORDS
words of 64 bits, four bits a key, so it is broadcast. Beyond MOST_WORDS * KEYS_PER_WORD keys it passes more rows by chance and
the join behind it has more to do; results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_WORD = 4
MOST_WORDS = 1 << 18


def with_possible(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with the boolean column `name`: false only if the row's `key` is not among the `key`s of `keys`."""
    wanted, words = min(-(-keys.count() // KEYS_PER_WORD), MOST_WORDS), 1
    while words < wanted:
        words *= 2
    place = F.pmod(F.xxhash64(key), F.lit(words))
    spread = F.xxhash64(key, F.lit(1))
    mask = _bit(spread, 0)
    for k in range(1, 4):
        mask = mask.bitwiseOR(_bit(spread, k))
    table = keys.select(place.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    marked = rows.withColumn("_word", place).join(F.broadcast(table), "_word", "left")
    found = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    return marked.withColumn(name, found).drop("_word", "_bits")


def _bit(spread: Column, number: int) -> Column:
    at = F.shiftright(spread, 6 * number).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)
