"""Globally unique label choice as rounds of proposals over the whole cluster table.

Every cluster has ordered candidate texts and a terminal text that may take a numeric suffix. Clusters have
priority by id. In a round each cluster proposes its current text and every text keeps the lowest id that
proposed it; a refused cluster moves on. The fixed point is what a pass over clusters in id order would pick,
because every text ranks clusters alike. Clusters down to their terminal text are placed together: the r-th of
them takes the r-th free suffix, so a terminal shared by many clusters needs no round per cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.ordering import with_row_index
from termloom.session import cut_lineage


def _nth_free(n: Column, taken: Column) -> Column:
    """The n-th positive number not in the ascending array `taken`."""
    return F.aggregate(taken, n.cast("long"), lambda at, t: F.when(t <= at, at + 1).otherwise(at))


def _text(base: Column, slot: Column) -> Column:
    return F.when(slot == 1, base).otherwise(F.concat(base, F.lit(" "), slot.cast("string")))


def _rival_slots(chained: DataFrame, held: DataFrame) -> DataFrame:
    """(base, rivals): suffix positions of a terminal text that other clusters hold for good, by holder id.

    A position only counts when the terminal's own earlier clusters have not passed it.
    """
    bases = chained.select("base").distinct()
    suffix = r"^(.*) ([1-9][0-9]{0,17})$"
    as_first = held.select(F.col("key").alias("base"), F.lit(1).cast("long").alias("slot"), "holder", "owner_base")
    as_later = held.filter(F.col("key").rlike(suffix)).select(
        F.regexp_extract("key", suffix, 1).alias("base"),
        F.regexp_extract("key", suffix, 2).cast("long").alias("slot"),
        "holder",
        "owner_base",
    ).filter("slot >= 2")
    rivals = (
        as_first.unionByName(as_later)
        .join(bases, "base")
        .filter(F.col("owner_base").isNull() | (F.col("owner_base") != F.col("base")))
    )
    both = rivals.select("base", F.col("holder").alias("id"), F.lit(0).alias("own")).unionByName(
        chained.select("base", F.col("cluster_id").alias("id"), F.lit(1).alias("own"))
    )
    positions = with_row_index(both.join(rivals.select("base").distinct(), "base"), "id", "at", ["base"])
    among = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    earlier = positions.filter("own = 0").select("base", F.col("id").alias("holder"), (F.col("at") - among).alias("earlier"))
    listed = (
        rivals.join(earlier, ["base", "holder"])
        .groupBy("base")
        .agg(F.array_sort(F.collect_list(F.struct("holder", "slot", F.col("earlier").cast("long").alias("earlier")))).alias("found"))
    )
    kind = "array<struct<holder:bigint,slot:bigint>>"

    def slots(rows: Column) -> Column:
        return F.array_sort(F.transform(rows, lambda r: r["slot"]))

    def keep(kept: Column, rival: Column) -> Column:
        passed = F.when(rival["earlier"] > 0, _nth_free(rival["earlier"], slots(kept))).otherwise(F.lit(0).cast("long"))
        return F.when(
            rival["slot"] > passed, F.concat(kept, F.array(F.struct(rival["holder"], rival["slot"])).cast(kind))
        ).otherwise(kept)

    return listed.select("base", F.aggregate("found", F.array().cast(kind), keep).alias("rivals"))


def _terminal_texts(chained: DataFrame, held: DataFrame | None) -> DataFrame:
    """(cluster_id, text) of clusters down to their terminal text: the r-th takes the r-th suffix still free to it."""
    ranked = with_row_index(chained, "cluster_id", "rank", ["base"])
    if held is None:
        return ranked.select("cluster_id", _text(F.col("terminal"), F.col("rank")).alias("text"))
    no_rivals = F.array().cast("array<struct<holder:bigint,slot:bigint>>")
    placed = ranked.join(_rival_slots(chained, held), "base", "left")
    ahead = F.filter(F.coalesce("rivals", no_rivals), lambda r: r["holder"] < F.col("cluster_id"))
    taken = F.array_sort(F.transform(ahead, lambda r: r["slot"]))
    return placed.select("cluster_id", _text(F.col("terminal"), _nth_free(F.col("rank"), taken)).alias("text"))


def choose_labels(choices: DataFrame) -> DataFrame:
    """(cluster_id, label) for `choices` (cluster_id, candidates ARRAY<STRING>, terminal); case-insensitively unique.

    Each round is one stored table with every cluster's proposal and whether it stands.
    """
    state = choices.select(
        F.col("cluster_id").cast("long").alias("cluster_id"), "candidates", "terminal", F.lit(1).alias("turn")
    )
    held, before = None, None
    while True:
        searching = F.col("turn") <= F.size("candidates")
        based = state.withColumn("base", F.when(~searching, F.lower("terminal")))
        chained = based.filter("base is not null").select("cluster_id", "terminal", "base")
        proposals = based.join(_terminal_texts(chained, held), "cluster_id", "left").withColumn(
            "text", F.when(searching, F.get("candidates", F.col("turn") - 1)).otherwise(F.col("text"))
        )
        proposals = cut_lineage(proposals.withColumn("key", F.lower("text")))
        winners = proposals.groupBy("key").agg(F.min("cluster_id").alias("holder"))
        judged = cut_lineage(
            proposals.join(winners, "key").withColumn("stands", F.col("holder") == F.col("cluster_id"))
        )
        held = judged.filter("stands").select("key", "holder", F.col("base").alias("owner_base"))
        refused, now = judged.agg(
            F.count_if(~F.col("stands")), F.sum(F.xxhash64("cluster_id", "key", "stands").cast("decimal(38,0)"))
        ).first()
        if not refused and now == before:
            return judged.select("cluster_id", F.col("text").alias("label"))
        before = now
        state = _next_turns(judged, held)


def _next_turns(judged: DataFrame, held: DataFrame) -> DataFrame:
    """Refused clusters move to their next candidate that no lower id holds; such a text stays out of reach."""
    refused = judged.filter(~F.col("stands") & F.col("base").isNull())
    ahead = refused.select("cluster_id", "turn", F.posexplode("candidates").alias("at", "text")).filter("at >= turn")
    blocked = (
        ahead.withColumn("key", F.lower("text"))
        .join(held.select("key", "holder"), "key")
        .filter("holder < cluster_id")
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_set(F.col("at") + 1)).alias("blocked"))
    )
    skipped = F.coalesce("blocked", F.array().cast("array<int>"))
    following = F.aggregate(skipped, F.col("turn") + 1, lambda t, b: F.when(b == t, t + 1).otherwise(t))
    moving = ~F.col("stands") & F.col("base").isNull()
    return judged.join(blocked, "cluster_id", "left").select(
        "cluster_id", "candidates", "terminal", F.when(moving, following).otherwise(F.col("turn")).alias("turn")
    )


def unique_labels(labels: DataFrame) -> DataFrame:
    """Fixed labels (cluster_id, label) made unique by numeric suffixes in cluster order."""
    return choose_labels(
        labels.select("cluster_id", F.array().cast("array<string>").alias("candidates"), F.col("label").alias("terminal"))
    )
