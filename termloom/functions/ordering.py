"""Positions and running sums over whole tables without a single-task window.

Rows are cut into chunks of an integer order column. Per-chunk totals form a table that is `chunk` times
smaller, the only thing a global window ever sees; positions inside a chunk are found in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut_lineage

CHUNK = 1_000_000
MOST_CHUNKS = 100_000


def _chunk_of(order_col: str, chunk: int | Column) -> Column:
    if isinstance(chunk, int):
        return F.expr(f"`{order_col}` div {chunk}")
    return F.floor(F.col(order_col) / chunk)


def sparse_chunk(df: DataFrame, order_col: str) -> Column:
    """A chunk width for order values of any spread, such as hashes: at most about MOST_CHUNKS chunks."""
    spread = F.max(order_col).cast("double") / MOST_CHUNKS - F.min(order_col).cast("double") / MOST_CHUNKS
    return df.agg(F.coalesce(F.greatest(F.ceil(spread), F.lit(CHUNK)), F.lit(CHUNK)).cast("double").alias("width")).scalar()


def _offsets(df: DataFrame, order_col: str, by: list[str], weight: Column, chunk: int | Column) -> DataFrame:
    totals = df.groupBy(*by, _chunk_of(order_col, chunk).alias("_chunk")).agg(F.sum(weight).alias("_total"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).cast("long").alias("_before")
    )


def with_row_index(
    df: DataFrame, order_col: str, name: str, by: list[str] | None = None, chunk: int | Column = CHUNK
) -> DataFrame:
    """Add the 1-based position in `order_col` order, per `by` group when given. `order_col` must be unique there.

    `chunk` suits dense order values; give `sparse_chunk` for others.
    """
    by = by or []
    offsets = _offsets(df, order_col, by, F.lit(1), chunk)
    inside = Window.partitionBy(*by, "_chunk").orderBy(order_col)
    return (
        df.withColumn("_chunk", _chunk_of(order_col, chunk))
        .withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*by, "_chunk"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_chunk", "_inside", "_before")
    )


def with_running_total(df: DataFrame, order_col: str, value_col: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add the sum of `value_col` over all rows with a smaller `order_col` (one row per order value)."""
    offsets = _offsets(df, order_col, [], F.col(value_col), chunk)
    inside = Window.partitionBy("_chunk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_chunk", _chunk_of(order_col, chunk))
        .withColumn("_inside", F.coalesce(F.sum(value_col).over(inside), F.lit(0)))
        .join(offsets, "_chunk")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_chunk", "_inside", "_before")
    )


def exact_median(df: DataFrame, value_col: str, borders: int = 256, small: int = 4_096) -> DataFrame:
    """One-row exact median of the non-null values.

    Histograms over quantile borders narrow the interval that holds the middle until it has at most `small` distinct
    values. The driver sees one histogram per round and the values of the last interval.
    """
    spark = df.sparkSession
    values = df.filter(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("v")).agg(F.count("*").alias("n"))
    values = cut_lineage(values)
    facts = values.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct")).first()
    if not facts["rows"]:
        return spark.createDataFrame([(None,)], "median double")
    ranks = [(facts["rows"] + 1) // 2, (facts["rows"] + 2) // 2]
    part, distinct, below = values, facts["distinct"], 0
    while distinct > small:
        shares = [F.lit(i / borders) for i in range(1, borders)]
        cuts = F.array_distinct(F.percentile_approx("v", F.array(*shares), 10 * borders)).alias("cuts")
        cuts = part.agg(cuts).first()["cuts"]
        at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("v"))).alias("at")
        histogram = part.groupBy(at).agg(
            F.sum("n").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        before, held = below, []
        for bucket in histogram.orderBy("at").collect():
            if any(before < rank <= before + bucket["n"] for rank in ranks):
                held.append(bucket)
            elif not held:
                below = before + bucket["n"]
            before += bucket["n"]
        if len(held) == 2:  # the middle is the border of two buckets
            part = part.filter(F.col("v").isin(held[0]["hi"], held[1]["lo"]))
            below += held[0]["n"] - part.filter(F.col("v") == held[0]["hi"]).agg(F.sum("n")).first()[0]
            break
        part, distinct = part.filter(F.col("v").between(held[0]["lo"], held[0]["hi"])), held[0]["distinct"]
    middle, last = [], below
    for v, n in part.orderBy("v").collect():
        middle += [v for rank in ranks if last < rank <= last + n]
        last += n
    return spark.createDataFrame([(float(middle[0] + middle[1]) / 2,)], "median double")
