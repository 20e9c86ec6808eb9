"""Keyword validity rules and their statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import DIGIT, WORD, strip


@dataclass(frozen=True)
class ValidationRules:
    min_length: int = 1
    max_length: int = 200
    allow_urls: bool = False
    allow_numbers: bool = False


def invalid_reason(keyword: Column, rules: ValidationRules = ValidationRules()) -> Column:
    """First failing rule, or NULL for a valid keyword."""
    text = strip(keyword)
    size = F.length(text)
    reason = (
        F.when(keyword.isNull() | (size == 0), "Empty or whitespace-only")
        .when(size < rules.min_length, f"Too short (min {rules.min_length} chars)")
        .when(size > rules.max_length, f"Too long (max {rules.max_length} chars)")
    )
    if not rules.allow_urls:
        reason = reason.when(text.rlike("(?i)^https?://"), "URL detected")
    if not rules.allow_numbers:
        reason = reason.when(text.rlike(f"^{DIGIT}+$"), "Pure number")
    return reason.when(~text.rlike(WORD), "No alphanumeric characters")


def with_reason(df: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    return df.withColumn("reason", invalid_reason(F.col("keyword"), rules))


def split_valid(df: DataFrame, rules: ValidationRules = ValidationRules()) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their reason)."""
    checked = with_reason(df, rules)
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def validation_warnings(df: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """One row: filtered count, mean valid length, case-insensitive duplicates, and the warning texts (NULL if none)."""
    checked = with_reason(df, rules)
    valid = F.col("reason").isNull()
    facts = checked.agg(
        F.count_if(~valid).alias("filtered"),
        F.coalesce(F.avg(F.when(valid, F.length("keyword"))), F.lit(0.0)).alias("avg_length"),
        (F.count_if(valid) - F.count_distinct(F.when(valid, F.lower("keyword")))).alias("potential_duplicates"),
    )
    # The warning texts.
    return facts.select(
        "*",
        F.when(F.col("filtered") > 0, F.format_string("%d keywords were filtered out", "filtered")).alias(
            "filtered_warning"
        ),
        F.when(
            F.col("avg_length") > 50,
            "Average keyword length is high (>50 chars). Consider checking for data issues.",
        ).alias("length_warning"),
        F.when(
            F.col("potential_duplicates") > 0,
            F.format_string(
                "%d potential case-insensitive duplicates detected. Consider deduplication.", "potential_duplicates"
            ),
        ).alias("duplicate_warning"),
    )


def validation_stats(df: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """Count per reason, with the table totals on every row."""
    by_reason = with_reason(df, rules).groupBy("reason").agg(F.count("*").alias("n"))
    totals = by_reason.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("reason").isNull(), F.col("n"))).alias("v"))
    total = totals.select("total").scalar()
    valid = F.coalesce(totals.select("v").scalar(), F.lit(0))
    return by_reason.filter("reason is not null").select(
        "reason",
        "n",
        total.alias("total_input"),
        valid.alias("valid"),
        (total - valid).alias("invalid"),
        (valid / total).alias("validity_rate"),
    )
