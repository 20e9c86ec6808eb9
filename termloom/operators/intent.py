"""Search-intent classification by patterns, cluster voting and model responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import folded, matches, strict_json, strip, words
from termloom.operators.assemble import clustered

# Intent names and the patterns that score them.
INTENTS = ["informational", "transactional", "navigational", "commercial", "unknown"]

INFORMATIONAL = [
    r"\bhow\s+to\b", r"\bwhat\s+is\b", r"\bwhat\s+are\b", r"\bwhy\s+", r"\bwhen\s+", r"\bwhere\s+", r"\bguide\b",
    r"\btutorial\b", r"\bexample[s]?\b", r"\bexplain\b", r"\bdefinition\b", r"\bmeaning\b", r"\btips\b", r"\bideas\b",
    r"\blearn\b",
]
TRANSACTIONAL = [
    r"\bbuy\b", r"\bpurchase\b", r"\border\b", r"\bdownload\b", r"\bfree\s+download\b", r"\bget\s+", r"\bsubscribe\b",
    r"\bsign\s+up\b", r"\bdiscount\b", r"\bcoupon\b", r"\bdeal[s]?\b", r"\bsale\b", r"\bprice\b", r"\bcheap\b",
    r"\baffordable\b",
]
NAVIGATIONAL = [
    r"\blogin\b", r"\blog\s*in\b", r"\bsign\s*in\b", r"\bwebsite\b", r"\bofficial\b", r"\bsite\b", r"\bapp\b",
    r"\bdownload\s+app\b", r"\bcontact\b", r"\bsupport\b", r"\bhelp\s+center\b",
]
COMMERCIAL = [
    r"\bbest\b", r"\btop\s+\d+\b", r"\breview[s]?\b", r"\bcompare\b", r"\bcomparison\b", r"\bvs\.?\b", r"\bversus\b",
    r"\balternative[s]?\b", r"\brecommend", r"\brating[s]?\b", r"\bpros\s+and\s+cons\b",
]
LOCAL = [r"\bnear\s+me\b", r"\bin\s+[A-Z][a-z]+\b", r"\blocal\b", r"\b\d{5}\b"]
COMPARISON = [r"\bvs\.?\b", r"\bversus\b", r"\bcompare\b", r"\bor\b", r"\bdifference\b"]
QUESTION = [r"^how\b", r"^what\b", r"^why\b", r"^when\b", r"^where\b", r"^which\b", r"^who\b", r"\?$"]

SCORED = dict(zip(INTENTS, [INFORMATIONAL, TRANSACTIONAL, NAVIGATIONAL, COMMERCIAL]))
MODIFIERS = ["branded", "comparison", "local", "long_tail", "question"]


def _branded(text: Column, brands: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(brand.lower()) for brand in brands], F.lit(False))


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p) for p in patterns])


def intent_scores(text: Column, brands: list[str] | None = None) -> dict[str, Column]:
    """One point per matching pattern of `folded` text; half a navigational point for a brand mention."""
    scores = {
        intent: reduce(lambda a, b: a + b, [matches(text, p).cast("int") for p in patterns]).cast("double")
        for intent, patterns in SCORED.items()
    }
    if brands:
        scores["navigational"] = scores["navigational"] + F.when(_branded(text, brands), 0.5).otherwise(0.0)
    return scores


def modifier_flags(text: Column, brands: list[str] | None = None) -> dict[str, Column]:
    flags = {
        "branded": _branded(text, brands or []),
        "comparison": _any(text, COMPARISON),
        "local": _any(text, LOCAL),
        "long_tail": F.size(words(text)) >= 5,
        "question": _any(text, QUESTION),
    }
    return {name: flags[name] for name in MODIFIERS}


def modifier_list(flags: dict[str, Column]) -> Column:
    """Names of the set flags in alphabetical order."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))


def with_intent(df: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """Add the four scores, modifier flags (`is_*`), intent and confidence to rows with a `keyword`."""
    scores = intent_scores(F.col("_folded"), brands)
    flags = modifier_flags(F.col("_folded"), brands)
    scored = df.withColumn("_folded", folded(F.col("keyword"))).withColumns({f"{name}_score": score for name, score in scores.items()}).withColumns(
        {f"is_{name}": flag for name, flag in flags.items()}
    ).drop("_folded")
    columns = {name: F.col(f"{name}_score") for name in scores}
    total = reduce(lambda a, b: a + b, columns.values())
    highest = F.greatest(*columns.values())
    winner = F.lit(INTENTS[0])
    for name in reversed(list(columns)):
        winner = F.when(columns[name] == highest, name).otherwise(winner)
    share = highest / total
    confidence = F.when(highest >= 2, F.least(F.lit(0.95), share + 0.2)).otherwise(share)
    return scored.withColumns(
        {
            "intent": F.when(total == 0, INTENTS[0]).otherwise(winner),
            "confidence": F.when(total == 0, 0.3).otherwise(confidence),
        }
    )


def classify_keywords(df: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """(keyword, intent, confidence, modifiers) once per distinct keyword."""
    classified = with_intent(df.select("keyword").distinct(), brands)
    flags = {name: F.col(f"is_{name}") for name in MODIFIERS}
    return classified.select("keyword", "intent", "confidence", modifier_list(flags).alias("modifiers"))


def vote_clusters(members: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """Majority intent per cluster over its distinct keywords; ties go to the intent seen first.

    Votes are pre-aggregated per (cluster, intent), five rows at most, before the majority is taken.
    """
    distinct = (
        clustered(members)
        .groupBy("cluster_id", "keyword")
        .agg(F.min("row_id").alias("first"), F.count("*").alias("rows"))
    )
    votes = (
        with_intent(distinct, brands)
        .groupBy("cluster_id", "intent")
        .agg(
            F.count("*").alias("votes"),
            F.min("first").alias("first"),
            F.sum("rows").alias("rows"),
            F.sum("confidence").alias("confidence"),
            *[F.bool_or(f"is_{name}").alias(name) for name in MODIFIERS],
        )
    )
    flags = {name: F.bool_or(name) for name in MODIFIERS}
    n = F.sum("rows")
    return votes.groupBy("cluster_id").agg(
        F.max_by("intent", F.struct("votes", -F.col("first"))).alias("intent"),
        ((F.max("votes") / n + F.sum("confidence") / n) / 2).alias("confidence"),
        modifier_list(flags).alias("modifiers"),
        F.format_string("Based on %d keywords", n).alias("explanation"),
    )


def intents_from_responses(responses: DataFrame, votes: DataFrame) -> DataFrame:
    """Model answers (cluster_id, response JSON) where usable, else the vote.

    An answer is usable when it is a JSON object whose intent is a known name; a missing intent reads as
    unknown, and missing confidence, modifiers and explanation get defaults.
    """
    answer = strict_json(strip(F.col("response")))
    parsed = responses.select("cluster_id", answer.alias("v")).filter(
        F.schema_of_variant("v").startswith("OBJECT")
    )
    named = F.try_variant_get("v", "$.primary_intent", "string")
    missing = F.try_variant_get("v", "$.primary_intent", "variant").isNull()
    usable = parsed.select(
        "cluster_id",
        F.lower(F.when(missing, "unknown").otherwise(named)).alias("m_intent"),
        F.coalesce(F.try_variant_get("v", "$.confidence", "double"), F.lit(0.8)).alias("m_confidence"),
        F.coalesce(
            F.try_variant_get("v", "$.modifiers", "array<string>"), F.array().cast("array<string>")
        ).alias("m_modifiers"),
        F.coalesce(F.try_variant_get("v", "$.explanation", "string"), F.lit("")).alias("m_explanation"),
    ).filter(F.col("m_intent").isin(INTENTS))
    return votes.join(usable, "cluster_id", "left").select(
        "cluster_id",
        *[
            F.when(F.col("m_intent").isNotNull(), F.col(f"m_{name}")).otherwise(F.col(name)).alias(name)
            for name in ("intent", "confidence", "modifiers", "explanation")
        ],
        F.col("m_intent").isNotNull().alias("from_model"),
    )
