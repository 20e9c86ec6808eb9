"""Keyed deduplication of keywords with metric merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import canonical
from termloom.operators.sizing import broadcast_if_small
from termloom.session import cut_lineage


def _volume() -> Column:
    return F.coalesce(F.col("search_volume"), F.lit(0))


def keep_best(df: DataFrame, **canonical_options: bool) -> DataFrame:
    """One row per canonical keyword: highest volume, ties to the earliest row.

    `first_row_id` gives the position of the key's first appearance, the output order. Plain aggregation, so
    copies of a hot keyword collapse map-side.
    """
    payload = F.struct(*df.columns)
    return (
        df.filter(F.coalesce(F.col("keyword"), F.lit("")) != "")
        .groupBy(canonical(F.col("keyword"), **canonical_options).alias("canonical"))
        .agg(
            F.max_by(payload, F.struct(_volume(), -F.col("row_id"))).alias("best"),
            F.min("row_id").alias("first_row_id"),
        )
        .select("canonical", "first_row_id", "best.*")
    )


def _fold_step(state: Column, row: Column) -> Column:
    """Merge `row` into `state` when its volume exceeds the volume merged so far."""
    difficulty = F.when(
        (state["kd"] > 0) & (row["kd"] > 0), (state["kd"] + row["kd"]) / 2
    ).otherwise(F.when(row["kd"] != 0, row["kd"]).otherwise(state["kd"]))
    merged = F.struct(
        row["row_id"].alias("row_id"),
        row["keyword"].alias("keyword"),
        (state["vol"] + row["vol"]).alias("vol"),
        difficulty.alias("kd"),
        F.greatest(state["cpc"], row["cpc"]).alias("cpc"),
    )
    return F.when(row["vol"] > state["vol"], merged).otherwise(state)


def _merge_in_arrays(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list("row"))
    folded = rows.groupBy("canonical").agg(ordered.alias("rows"), F.count("*").alias("n"))
    return folded.select(
        "canonical",
        "n",
        F.aggregate(F.slice("rows", 2, 1 << 30), F.col("rows")[0], _fold_step).alias("state"),
    )


def _merge_in_rounds(rows: DataFrame) -> DataFrame:
    """Fold for keys too large to gather: every round finds each key's next merging row by aggregation.

    A merge at least doubles the merged volume, so a key needs at most log2(largest volume) rounds, and a
    round only reads rows after the last merge that still exceed the merged volume.
    """
    state = cut_lineage(rows.groupBy("canonical").agg(F.min("row").alias("state"), F.count("*").alias("n")))
    rest = rows
    while True:
        rest = (
            rest.join(broadcast_if_small(state.select("canonical", "state")), "canonical")
            .filter((F.col("row.row_id") > F.col("state.row_id")) & (F.col("row.vol") > F.col("state.vol")))
            .select("canonical", "row")
        )
        rest = cut_lineage(rest)
        if rest.isEmpty():
            return state
        nearest = rest.groupBy("canonical").agg(F.min("row").alias("row"))
        state = cut_lineage(
            state.join(nearest, "canonical", "left").select(
                "canonical",
                F.when(F.col("row").isNotNull(), _fold_step(F.col("state"), F.col("row")))
                .otherwise(F.col("state"))
                .alias("state"),
                "n",
            )
        )


def merge_duplicates(df: DataFrame, gather_limit: int = 1000, **canonical_options: bool) -> DataFrame:
    """One row per canonical keyword with merged metrics, folded in row order.

    A later row merges only when its volume exceeds the volume merged so far: volumes add up, difficulties
    average when both are positive, the higher cpc stays, and the row becomes the representative. Keys with
    up to `gather_limit` rows fold in one array; larger ones use rounds of aggregation.
    """
    rows = df.select(
        canonical(F.col("keyword"), **canonical_options).alias("canonical"),
        F.struct(
            F.col("row_id"),
            F.col("keyword"),
            _volume().cast("long").alias("vol"),
            F.coalesce(F.col("keyword_difficulty"), F.lit(0.0)).alias("kd"),
            F.coalesce(F.col("cpc"), F.lit(0.0)).alias("cpc"),
        ).alias("row"),
    )
    hot = cut_lineage(rows.groupBy("canonical").count().filter(F.col("count") > gather_limit).select("canonical"))
    if hot.isEmpty():
        merged = _merge_in_arrays(rows)
    else:
        hot_side = broadcast_if_small(hot)
        merged = _merge_in_arrays(rows.join(hot_side, "canonical", "left_anti")).unionByName(
            _merge_in_rounds(rows.join(hot_side, "canonical", "left_semi")).select("canonical", "n", "state")
        )
    return merged.select(
        "canonical",
        F.col("state.keyword").alias("keyword"),
        (F.col("n") - 1).alias("duplicate_count"),
        F.col("state.vol").alias("search_volume"),
        F.col("state.kd").alias("keyword_difficulty"),
        F.col("state.cpc").alias("cpc"),
    )


def duplicate_rows(df: DataFrame, **canonical_options: bool) -> DataFrame:
    """Every row that is not the first of its canonical key, one per output row."""
    keyed = df.select(canonical(F.col("keyword"), **canonical_options).alias("canonical"), "row_id", "keyword")
    firsts = keyed.groupBy("canonical").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("n"))
    repeated = firsts.filter("n > 1").drop("n")
    return keyed.join(repeated, "canonical").filter("row_id > first_row_id")


def dedup_stats(df: DataFrame, **canonical_options: bool) -> DataFrame:
    keys = df.groupBy(canonical(F.col("keyword"), **canonical_options).alias("canonical")).count()
    original, unique = F.coalesce(F.sum("count"), F.lit(0)), F.count("*")
    return keys.agg(
        original.alias("original_count"),
        unique.alias("unique_count"),
        (original - unique).alias("duplicate_count"),
        F.coalesce((original - unique) / F.nullif(original, F.lit(0)), F.lit(0.0)).alias("reduction_rate"),
    )


def top_duplicates(df: DataFrame, n: int = 5, shown: int = 3, **canonical_options: bool) -> DataFrame:
    """The `n` keys with most duplicates (ties by first appearance) and their first `shown` duplicates.

    The leading keys are few, so their rows are read back through a broadcast key list; the rank filter
    becomes a per-task group limit, so a hot key never travels whole.
    """
    key = canonical(F.col("keyword"), **canonical_options)
    keyed = df.withColumn("canonical", key)
    leaders = cut_lineage(
        keyed.groupBy("canonical")
        .agg((F.count("*") - 1).alias("duplicate_count"), F.min("row_id").alias("first_row_id"))
        .filter("duplicate_count > 0")
        .orderBy(F.desc("duplicate_count"), "first_row_id")
        .limit(n)
    )
    rows = keyed.join(F.broadcast(leaders.select("canonical")), "canonical")
    rank = F.row_number().over(Window.partitionBy("canonical").orderBy("row_id"))
    listed = (
        rows.withColumn("rank", rank)
        .filter(f"rank <= {shown + 1}")
        .filter("rank > 1")
        .groupBy("canonical")
        .agg(F.array_sort(F.collect_list(F.struct("row_id", "keyword"))).alias("pairs"))
    )
    best = merge_duplicates(rows.drop("canonical"), **canonical_options)
    return (
        leaders.join(listed, "canonical")
        .join(best.select("canonical", "keyword"), "canonical")
        .select("keyword", "canonical", "duplicate_count", "first_row_id", F.col("pairs.keyword").alias("duplicates"))
        .orderBy(F.desc("duplicate_count"), "first_row_id")
    )
