"""Checks that decide whether a side may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import BROADCAST_BYTES


ROW_BYTES = 64


def broadcast_if_small(df: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured rows fit the budget; otherwise leave the join to a shuffle."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    nested = [F.length(F.to_json(F.struct(c))) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    size = sum([*text, *nested], F.lit(ROW_BYTES)).cast("long")
    measured = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if measured <= budget else df
