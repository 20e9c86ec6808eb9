"""Exact duplicates: sorted digest runs merged in binomial rounds, the smallest identifier of each digest kept at every level.

Two texts are equal when their normal forms are: the text without `DROPPED` characters (null counts as empty). DataFrame
functions only.

1. Every input partition is a run: its rows' digests (SHA-256), each digest once with the number of its rows and the row that
   stays, which has the most code points in its original text and then the smallest doc_id.
2. In round t the runs whose numbers agree but for the last t * ROUND_BITS bits form a group, and each of them holds one slice
   of the group's digests, told by the first t * ROUND_BITS bits of the digest. Every holder sorts and merges the slices of
   2 ** ROUND_BITS holders of the round before (recursive halving). So the number of holders and the size of a slice stay the
   same in all rounds, however many runs there are, and a digest that every row has reaches a holder at most
   2 ** ROUND_BITS times. After the last round one group is left, whose slices hold each digest of the table once.
3. Entries merge only if digest, byte length and an independent 64-bit hash of the normal form all agree, at every level; texts
   that agree in the digest alone stay apart. So a weaker `digest` changes no result.
4. Answers go back the same way: a digest's class reaches each run once, and from there the rows of the run.

Defined cases: null and empty texts and texts of dropped characters only are equal to one another; a null doc_id loses ties;
rows equal in length and doc_id are ordered by a hash of the original text, identical rows are one group of which any one
stays; an empty table gives no rows. Further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import cut_lineage

DROPPED = "\x20\x09\x0a\x0b\x0c\x0d"
ROUND_BITS = 3
HEAD_BITS = 32
KEY = ["digest", "bytes", "witness"]


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def digest_rows(docs: DataFrame, dropped: str = DROPPED, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One narrow row per row of `docs`: run, place (unique), doc_id, chars, original (hash of the text as it stands), KEY."""
    normal = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"), F.translate(_text(), dropped, "").alias("normal")
    )
    return normal.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("place"),
        "doc_id",
        F.length("text").alias("chars"),
        F.xxhash64("text").alias("original"),
        digest(F.col("normal")).alias("digest"),
        F.octet_length("normal").alias("bytes"),
        F.xxhash64("normal").alias("witness"),
    )


def merge_runs(entries: DataFrame, runs: int, round_bits: int = ROUND_BITS) -> DataFrame:
    """KEY, best and n of every class, from `entries` (run, KEY, best, n) of `runs` runs."""
    digit = F.conv(F.hex(F.substring("digest", 1, HEAD_BITS // 8)), 16, 10).cast("long")
    level = entries.withColumn("head", F.coalesce(digit, F.lit(0).cast("long")))
    done = 0
    while runs > 1:
        done = min(done + round_bits, HEAD_BITS)
        runs = ((runs - 1) >> round_bits) + 1
        slice_ = F.shiftright("head", HEAD_BITS - done)
        level = level.withColumn("run", F.shiftright("run", round_bits)).withColumn("slice", slice_)
        level = level.repartition("run", "slice").groupBy("run", "slice", "head", *KEY)
        level = level.agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return level.select(*KEY, "best", "n")


def exact_groups(
    docs: DataFrame,
    dropped: str = DROPPED,
    digest: Callable[[Column], Column] = sha256_digest,
    round_bits: int = ROUND_BITS,
) -> DataFrame:
    """Every row of `docs` (doc_id, text): doc_id, original, keep_id, group_size, kept, digest.

    keep_id is the doc_id of the row that stays of the group, `kept` marks that row, `digest` is binary.
    """
    rows = cut_lineage(digest_rows(docs, dropped, digest))
    best = F.struct(
        (-F.col("chars")).alias("shortness"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "original", "place"
    )
    entries = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    entries = cut_lineage(entries)
    runs = entries.agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
    classes = merge_runs(entries, runs, round_bits)
    several = classes.filter("n > 1").select(
        *KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.place").alias("keep_place"), F.col("n").alias("group_size")
    )
    answers = entries.select("run", *KEY).join(several, KEY)
    found = rows.join(answers, ["run", *KEY], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        "original",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("place") == F.col("keep_place"))).alias("kept"),
        "digest",
    )


def keep_unique(docs: DataFrame, dropped: str = DROPPED) -> DataFrame:
    """`docs`, all columns, with one row of each group: the row that `exact_groups` keeps (of identical texts with one id any)."""
    kept = exact_groups(docs, dropped).filter("kept").select(F.col("doc_id").alias("id"), "original")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(_text()).alias("original"),
    )
    same = packed["id"].eqNullSafe(kept["id"]) & (packed["original"] == kept["original"])
    chosen = packed.join(kept, same, "left_semi")
    return chosen.dropDuplicates(["id", "original"]).select("row.*")
