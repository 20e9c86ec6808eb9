"""The whole run: clean, embed, cluster, validate, label, score and report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import coarse, density, labels, merge, outliers, overlap
from termloom.operators.assemble import cluster_info, cluster_report, run_summary
from termloom.operators.coarse import TreeSettings
from termloom.operators.dedup import keep_best
from termloom.operators.embed import Provider, align_vectors, embed_texts, hashed_ngrams
from termloom.operators.label_choice import choose_labels
from termloom.operators.validate import ValidationRules, split_valid
from termloom.session import cut_lineage, drop_bucketed, store_bucketed


@dataclass(frozen=True)
class RunSettings:
    """Blocks come from flat k-means while its number of clusters is below the bound of `coarse`, and from the k-means tree
    beyond it, so that they stay small however many rows there are."""

    coarse: coarse.CoarseSettings = field(default_factory=coarse.CoarseSettings)
    tree: TreeSettings = field(default_factory=TreeSettings)
    density: density.DensitySettings = field(default_factory=density.DensitySettings)
    rules: ValidationRules = field(default_factory=ValidationRules)
    merge_threshold: float = merge.MERGE_THRESHOLD
    outlier_threshold: float = outliers.SIMILARITY_THRESHOLD
    aggressive: bool = True
    brands: tuple[str, ...] = ()


@dataclass(frozen=True)
class RunResult:
    """Tables of a finished run; nothing here is collected."""

    members: DataFrame
    report: DataFrame
    labels: DataFrame
    reassigned: DataFrame
    validations: DataFrame | None
    summary: DataFrame


RECORD = {"row_id": "long", "keyword": "string", "search_volume": "long", "keyword_difficulty": "double", "cpc": "double"}


def clean(raw: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """Valid keywords, one row per canonical form; absent metric columns become NULL."""
    record = raw.select(
        *[(F.col(c) if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in RECORD.items()]
    )
    valid, _ = split_valid(record, rules)
    return keep_best(valid).drop("canonical", "first_row_id")


def coarse_blocks(points: DataFrame, settings: RunSettings = RunSettings()) -> DataFrame:
    """(row_id, coarse_id) of flat k-means or, beyond its bound, of the k-means tree."""
    rows, bound = points.count(), settings.coarse.max_clusters
    if rows <= bound**2 * settings.coarse.cluster_ratio:
        found = coarse.assign(points, coarse.fit_centroids(points, settings.coarse))
    else:
        found = coarse.route(points, coarse.fit_tree(points, settings.tree))
    return found.select("row_id", F.col("coarse_id").cast("long").alias("coarse_id"))


def cluster_labels(points: DataFrame, settings: RunSettings = RunSettings()) -> DataFrame:
    """(row_id, cluster_id) after the coarse, density and merge steps; -1 marks outliers.

    Only narrow label tables are stored between steps. `points` should be bucketed by row_id, so that joining
    labels to it moves no vectors.
    """
    blocks = cut_lineage(coarse_blocks(points, settings))
    fine = density.density_labels(points.join(blocks, "row_id"), settings.density)
    numbered = cut_lineage(density.global_ids(fine).select("row_id", "cluster_id"))
    merged = merge.merge_clusters(points.join(numbered, "row_id"), settings.merge_threshold)
    return cut_lineage(merge.apply_merge(numbered, merged).select("row_id", "cluster_id"))


def run(
    raw: DataFrame,
    settings: RunSettings = RunSettings(),
    provider: Provider | None = None,
    serps: DataFrame | None = None,
    model_labels: DataFrame | None = None,
) -> RunResult:
    """Run on raw keyword rows (row_id, keyword, search_volume, keyword_difficulty, cpc).

    `serps` (keyword, urls) switches URL validation on; `model_labels` (cluster_id, label) replaces fallback labels.
    """
    keywords = cut_lineage(clean(raw, settings.rules))
    texts = keywords.select(F.col("keyword").alias("text"))
    vectors = embed_texts(keywords, provider or hashed_ngrams(weigh_by=texts))
    aligned = align_vectors(keywords.select("row_id", "keyword"), vectors)
    points = store_bucketed(aligned.select("row_id", F.col("vec").cast("array<double>").alias("vec")), "row_id")

    first = cluster_labels(points, settings)
    validations = None
    if serps is not None:
        before = keywords.join(first, "row_id")
        validations = cut_lineage(overlap.validate_clusters(overlap.checked_items(before, serps)))
    labelled = points.join(first, "row_id")
    reassigned = outliers.reassign_outliers(labelled, settings.outlier_threshold, settings.aggressive)
    final = cut_lineage(outliers.apply_reassignment(first, reassigned))
    members = cut_lineage(keywords.join(final, "row_id"))
    info = cluster_info(points.join(final, "row_id"), validations)
    quality = cut_lineage(info.select("cluster_id", "quality_score"))
    drop_bucketed(points)

    analyses = cut_lineage(labels.analyze_clusters(members, list(settings.brands)))
    choices = labels.label_candidates(analyses)
    if model_labels is not None:
        choices = labels.with_model_labels(choices, model_labels)
    else:
        choices = choices.withColumn("from_model", F.lit(False))
    chosen = (
        choose_labels(choices)
        .join(choices.select("cluster_id", "from_model"), "cluster_id")
        .join(analyses.select("cluster_id", "intent", "theme", "keyword_count"), "cluster_id")
        .select(
            "cluster_id",
            "label",
            labels.label_confidence(F.col("from_model")).alias("confidence"),
            "intent",
            F.col("theme").alias("summary"),
            labels.description(F.col("intent"), F.col("keyword_count")).alias("description"),
        )
    )
    chosen = cut_lineage(chosen)
    report = cluster_report(members, chosen, quality)
    return RunResult(members, report, chosen, reassigned, validations, run_summary(members, validations))
