"""Label material: themes, phrases, cluster analyses, prompts, scores and descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.numbers import fixed_text
from termloom.functions.text import WORD, capitalize_words, strip, words
from termloom.operators.assemble import clustered, first_members, keyword_lists, top_members
from termloom.operators.intent import vote_clusters
from termloom.operators.sizing import broadcast_if_small
from termloom.session import cut_lineage

PHRASE_MINIMUM = 3

# Words that never form a theme, and texts that say nothing about a cluster.
STOP_WORDS = [
    "the", "and", "for", "are", "with", "you", "this", "that", "from", "have", "your", "what", "how", "why", "when",
    "where", "can", "will", "all", "best", "top", "get", "make", "use", "does", "has", "was", "were", "been", "being",
    "more", "most",
]
GENERIC = [
    r"^cluster\s*\d*$", r"^cluster\s+of\s+\d+", r"^group\s*\d*$", r"^category\s*\d*$", r"^misc", r"^other",
    r"^\d+\s+keywords?",
]


def _first_words(keyword: Column, n: int) -> Column:
    return capitalize_words(words(keyword), n)


def _read_members(members: DataFrame, limit: int | None) -> DataFrame:
    """Members with their position: all of them, or the first `limit` of each cluster."""
    return first_members(members, limit) if limit else clustered(members).withColumn("position", F.col("row_id"))


def _place() -> Column:
    """`position` and `pos` as one number: a minimum of structs would sort every row before it aggregates."""
    return F.col("position").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("pos")


def themes(members: DataFrame, limit: int | None = None) -> DataFrame:
    """(cluster_id, theme) from the two most frequent words of all members, ties to the earliest word.

    `limit` reads only the first so many members of each cluster.

    Clusters without a countable word are absent.
    """
    whole = F.lit(f"(?<!{WORD})([a-z]{{3,}}+)(?!{WORD})")
    tokens = F.regexp_extract_all(F.lower("keyword"), whole, F.lit(1))
    spread = _read_members(members, limit).select(
        "cluster_id", "position", F.posexplode(tokens).alias("pos", "word")
    )
    counted = (
        spread.filter(~F.col("word").isin(STOP_WORDS))
        .groupBy("cluster_id", "word")
        .agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
    )
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "first")
    best = counted.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    pair = F.array_sort(F.collect_list(F.struct("rank", F.initcap("word").alias("word"))))
    return best.groupBy("cluster_id").agg(F.array_join(F.transform(pair, lambda p: p["word"]), " ").alias("theme"))


# Text of a cluster that is counted at once. Larger clusters are counted in parts.
PART_BYTES = 4 << 20
# Most frequent phrases of a part that tell how often the best phrase of the cluster is used at least.
LEADERS = 20


def common_phrases(members: DataFrame, limit: int | None = None) -> DataFrame:
    """(cluster_id, phrase): the most frequent 2- or 3-word phrase of all members, if used three times.

    `limit` reads only the first so many members of each cluster.

    Texts move once, dealt to parts of clusters, and phrases are counted where their part lies. The sums of the parts' leading
    phrases bound the best count from below; a phrase that reaches it has its share of it in some part, and only such phrases
    are summed over the parts. A phrase of three words is never more frequent than its first two, which stand earlier: it has
    no effect on the result and is not counted.
    """
    read = _read_members(members, limit).select("cluster_id", "position", F.lower("keyword").alias("text"))
    read = cut_lineage(read)
    sizes = read.groupBy("cluster_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    sizes = cut_lineage(sizes.withColumn("parts", F.greatest(F.ceil(F.col("bytes") / PART_BYTES), F.lit(1))))
    repeated = cut_lineage(_part_counts(read, sizes).filter("n >= 2"))
    rank = F.row_number().over(Window.partitionBy("cluster_id", "part").orderBy(F.desc("n"), "phrase"))
    leaders = repeated.withColumn("rank", rank).filter(F.col("rank") <= LEADERS)
    leaders = leaders.groupBy("cluster_id", "phrase").agg(F.sum("n").alias("n")).groupBy("cluster_id").agg(F.max("n").alias("most"))
    least = F.greatest(F.coalesce("most", F.lit(0)), F.lit(PHRASE_MINIMUM)).alias("least")
    sizes = cut_lineage(sizes.join(leaders, "cluster_id", "left").select("cluster_id", "bytes", "parts", least))
    often = repeated.join(broadcast_if_small(sizes.select("cluster_id", "least")), "cluster_id")
    often = often.filter(F.col("n") * F.col("parts") >= F.col("least")).select("cluster_id", "phrase")
    spread = sizes.filter("least <= parts")  # a phrase that stands once in every part may do
    if not spread.isEmpty():
        often = often.unionByName(_part_counts(read, spread).select("cluster_id", "phrase"))
    often = broadcast_if_small(cut_lineage(often.distinct()))
    summed = _phrases(read).join(often, ["cluster_id", "phrase"]).groupBy("cluster_id", "phrase")
    summed = summed.agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
    negated = F.struct("n", -F.col("first"))
    best = summed.groupBy("cluster_id").agg(F.max_by("phrase", negated).alias("phrase"), F.max("n").alias("n"))
    return best.filter(F.col("n") >= PHRASE_MINIMUM).select("cluster_id", "phrase")


def _phrases(rows: DataFrame) -> DataFrame:
    """Rows (text, position, ...) by phrase of two words, with its place `pos` in the text."""
    following = F.greatest(F.size("tokens") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("tokens", F.lit(1), following), F.slice("tokens", F.lit(2), following), lambda a, b: F.concat_ws(" ", a, b)
    )
    others = [c for c in rows.columns if c != "text"]
    return rows.withColumn("tokens", words(F.col("text"))).select(*others, F.posexplode(pairs).alias("pos", "phrase"))


def _part_counts(read: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, part, parts, phrase, n) of the phrases of each part, for `clusters` (cluster_id, bytes, parts).

    Counts are taken where a part is laid out, so that only texts are shuffled.
    """
    total = clusters.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(read.sparkSession.sparkContext.defaultParallelism, min(100_000, -(-int(total) // (2 * PART_BYTES))))
    dealt = read.join(broadcast_if_small(clusters.select("cluster_id", "parts")), "cluster_id")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("position", "text"), F.col("parts")))
    laid = _phrases(dealt.repartition(tasks, "cluster_id", "part"))
    return laid.groupBy("cluster_id", "part", "parts", "phrase").agg(F.count("*").alias("n"))


def analyze_clusters(members: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """One row per cluster: intent vote, theme, five top keywords, first keyword, phrase and size."""
    sizes = clustered(members).groupBy("cluster_id").agg(
        F.count("*").alias("keyword_count"), F.min_by("keyword", "row_id").alias("first_keyword")
    )
    top = keyword_lists(top_members(members, 5), "rank", "top_keywords")
    found = (
        sizes.join(vote_clusters(members, brands), "cluster_id")
        .join(top, "cluster_id")
        .join(themes(members), "cluster_id", "left")
        .join(common_phrases(members), "cluster_id", "left")
    )
    return found.withColumn("theme", F.coalesce("theme", _first_words(F.col("top_keywords")[0], 3)))


def is_generic(label: Column) -> Column:
    lowered = F.lower(strip(label))
    return reduce(lambda a, b: a | b, [lowered.rlike("(?U)" + p) for p in GENERIC])


def label_candidates(analyses: DataFrame) -> DataFrame:
    """(cluster_id, candidates, terminal): label texts in order of preference and the one that may get a suffix."""
    top, theme = F.col("top_keywords"), F.col("theme")
    fitting = F.filter(top, lambda k: F.size(words(k)).between(3, 5))
    ordered = F.concat(
        F.array_compact(F.array(F.when(F.length(theme) > 2, F.trim(theme)))),
        F.transform(fitting, lambda k: _first_words(k, 4)),
        F.array_compact(F.array(F.when(F.length("phrase") > 0, _first_words(F.col("phrase"), 4)))),
        F.array(_first_words(top[0], 4)),
    )
    terminal = F.when(F.length(theme) > 0, F.concat(theme, F.lit(" Topics"))).otherwise(
        F.coalesce(
            _first_words(F.col("first_keyword"), 3), F.format_string("Topic Group %d", "cluster_id")
        )
    )
    return analyses.select("cluster_id", ordered.alias("candidates"), terminal.alias("terminal"))


def with_model_labels(candidates: DataFrame, model_labels: DataFrame) -> DataFrame:
    """Where a specific model label exists it is the only choice; it keeps `from_model` for the confidence."""
    joined = candidates.join(
        model_labels.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("label").alias("model_label")),
        "cluster_id",
        "left",
    )
    usable = F.col("model_label").isNotNull() & (F.col("model_label") != "") & ~is_generic(F.col("model_label"))
    return joined.select(
        "cluster_id",
        F.when(usable, F.array().cast("array<string>")).otherwise(F.col("candidates")).alias("candidates"),
        F.when(usable, F.col("model_label")).otherwise(F.col("terminal")).alias("terminal"),
        F.col("model_label").isNotNull().alias("from_model"),
    )


def label_confidence(from_model: Column) -> Column:
    return F.when(from_model, 0.9).otherwise(0.7)


def consistency_score(labels: DataFrame) -> DataFrame:
    """0-1 score of unique share, specific share and even word counts; 0 without labels."""
    n = F.count("label")
    generic = F.count_if(is_generic(F.col("label")))
    evenness = F.greatest(F.lit(0.0), 1 - F.var_pop(F.size(words(F.col("label")))) / 10)
    score = F.count_distinct("label") / n * 0.4 + (1 - generic / n) * 0.4 + evenness * 0.2
    return labels.agg(F.when(n > 0, score).otherwise(0.0).alias("consistency_score"))


def description(intent: Column, count: Column) -> Column:
    return F.format_string("%s content cluster with %d keywords.", F.initcap(intent), count)


def bullet_list(items: Column, limit: int) -> Column:
    return F.array_join(F.transform(F.slice(items, 1, limit), lambda k: F.concat(F.lit("- "), k)), "\n")


def summary_prompts(members: DataFrame, analyses: DataFrame) -> DataFrame:
    """(cluster_id, prompt) asking for a short summary: first 20 members, intent and five top keywords."""
    listed = keyword_lists(first_members(members, 20), "position", "listed")
    text = F.format_string(
        "Summarise this keyword cluster in one or two sentences.\n\nKeywords:\n%s\n\nIntent: %s\nTop keywords: %s\n\nSummary:",
        bullet_list(F.col("listed"), 20),
        F.col("intent"),
        F.array_join(F.slice("top_keywords", 1, 5), ", "),
    )
    return analyses.join(listed, "cluster_id").select("cluster_id", text.alias("prompt"))


def intent_prompts(members: DataFrame) -> DataFrame:
    """(cluster_id, prompt) asking for the intent of the first 30 members as JSON."""
    listed = keyword_lists(first_members(members, 30), "position", "listed")
    text = F.format_string(
        "Name the search intent of these keywords (informational, transactional, navigational or commercial) and any "
        "modifiers.\n\nKeywords:\n%s\n\nAnswer as JSON with primary_intent, confidence, modifiers and explanation:",
        bullet_list(F.col("listed"), 30),
    )
    return listed.select("cluster_id", text.alias("prompt"))


def description_prompts(report: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, prompt) asking for a description: label, metrics and the first 15 members."""
    listed = keyword_lists(first_members(members, 15), "position", "listed")
    text = F.format_string(
        "Describe this keyword cluster in two or three sentences.\n\nLabel: %s\nKeywords (%d):\n%s\nVolume: %s\n"
        "Difficulty: %s\nIntent: %s\n\nDescription:",
        F.col("label"),
        F.col("size"),
        bullet_list(F.col("listed"), 15),
        F.format_number("total_volume", 0),
        fixed_text(F.col("avg_difficulty"), 1),
        F.col("intent"),
    )
    return report.join(listed, F.col("id") == F.col("cluster_id")).select("cluster_id", text.alias("prompt"))


def label_prompts(analyses: DataFrame, batch_size: int = 50) -> DataFrame:
    """(batch, prompt): one labelling prompt per `batch_size` consecutive clusters, so no row holds them all."""
    entry = F.format_string(
        "Cluster %d (%d keywords):\n  Intent: %s\n  Theme: %s\n  Sample: %s",
        "cluster_id",
        "keyword_count",
        "intent",
        F.coalesce("theme", F.lit("")),
        F.array_join(F.slice("top_keywords", 1, 5), ", "),
    )
    return _batched_prompts(
        analyses.select("cluster_id", entry.alias("entry")),
        batch_size,
        "\n",
        'Give each keyword cluster a unique, descriptive topic label of two to four words in title case.\n\nCLUSTERS:\n%s\n\n'
        'Answer as JSON: {"labels": [{"cluster_id": 0, "label": "Topic Name"}]}',
    )


def consistent_label_prompts(summaries: DataFrame, batch_size: int = 50) -> DataFrame:
    """(batch, prompt) that labels clusters from their summaries (cluster_id, summary) under one naming scheme."""
    entry = F.format_string("Cluster %d:\n%s", "cluster_id", "summary")
    return _batched_prompts(
        summaries.select("cluster_id", entry.alias("entry")),
        batch_size,
        "\n\n",
        "Label these keyword clusters with mutually exclusive noun phrases of two to five words.\n\nSUMMARIES:\n%s\n\n"
        'Answer as JSON: {"labels": [{"cluster_id": 0, "label": "Topic Name", "confidence": 0.9}]}',
    )


def _batched_prompts(entries: DataFrame, batch_size: int, separator: str, template: str) -> DataFrame:
    batched = entries.groupBy(F.floor(F.col("cluster_id") / batch_size).alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("cluster_id", "entry"))).alias("rows")
    )
    joined = F.array_join(F.transform("rows", lambda r: r["entry"]), separator)
    return batched.select("batch", F.format_string(template, joined).alias("prompt"))
