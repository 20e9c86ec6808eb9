"""Vector, clustering, merge and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog.fixtures import CLEAN_SQL, clean_keywords, table
from termloom.catalog.metrics import rounded
from termloom.catalog.registry import query
from termloom.functions.vectors import as_doubles, mean_vectors
from termloom.operators import coarse, density, embed, merge, outliers
from termloom.operators.assemble import cluster_info
from termloom.operators.projection import project_2d
from termloom.operators.similarity import similar_pairs
from termloom.session import cut_lineage, scratch_path

# Embeddings pulled towards the first vector of their label; every tenth row is an outlier.
FX2 = """anchors as (select label, arg_min(embedding, vec_id) as anchor from embeddings group by label),
 fx as (select vec_id as row_id, label, case when vec_id % 10 = 0 then -1 else label end as cluster_id,
 list_transform(list_zip(embedding, anchor), lambda p: p[1]::double + (vec_id % 7) * 0.25::double * p[2]::double) as x
 from embeddings join anchors using (label))"""


def vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    anchors = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    pull = (F.col("vec_id") % 7) * 0.25
    return rows.join(anchors, "label").select(
        F.col("vec_id").alias("row_id"),
        "label",
        F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")).alias("cluster_id"),
        F.zip_with(as_doubles(F.col("embedding")), as_doubles(F.col("anchor")), lambda e, a: e + pull * a).alias("vec"),
    )


def centroids_sql(source: str, key: str, name: str) -> str:
    return f"""{name} as (select {key}, list(m order by pos) as c, any_value(n) as n from (select {key}, pos, avg(v) as m,
 count(*) as n from (select {key}, unnest(x) as v, generate_subscripts(x, 1) as pos from {source}) group by 1, 2)
 group by 1)"""


LABELLED = "labelled as (select * from fx where cluster_id >= 0)"
CENTROIDS = f"{FX2}, {LABELLED}, {centroids_sql('labelled', 'cluster_id', 'cents')}"
PAIRS = f"""{CENTROIDS}, pairs as (select a.cluster_id as id_a, b.cluster_id as id_b,
 list_cosine_similarity(a.c, b.c) as s from cents a join cents b on a.cluster_id < b.cluster_id)"""


def label_centroids(spark, sf):
    return cut_lineage(mean_vectors(vectors(spark, sf), ["label"], "vec")).select(
        F.col("label").alias("cluster_id"), "centroid"
    )


def blocks(spark, sf):
    return vectors(spark, sf).select("row_id", "vec", F.col("label").cast("long").alias("coarse_id"))


# Similarity at which centroids of the fixture count as close; higher, none merge.
MERGE = 0.05


@query("F1_text_vectors")
def _(spark, sf):
    texts = clean_keywords(spark, sf)
    provider = embed.hashed_ngrams(64, weigh_by=texts.select(F.col("keyword").alias("text")))
    return embed.embed_texts(texts, provider).select("text", F.array_join("vec", ",").alias("vec"))


@query("F1_document_vectors")
def _(spark, sf):
    texts = table(spark, sf, "documents").select("text")
    vectors_of = embed.embed_texts(texts, embed.hashed_ngrams(256), "text")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    return vectors_of.select(F.sha2("text", 256).alias("text_hash"), F.round(length, 5).alias("length"))


@query("F2_cached_vectors", f"with kw as ({CLEAN_SQL}) select distinct keyword as text, true as unit_length from kw")
def _(spark, sf):
    path, provider = scratch_path(spark, "vectors"), embed.hashed_ngrams(64)
    rows = clean_keywords(spark, sf)
    embed.embed_missing(rows.filter("cluster_id >= 0"), path, provider)
    stored = embed.embed_missing(rows, path, provider)
    length = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    return stored.select("text", (F.abs(length - 1) < 1e-5).alias("unit_length"))


@query(
    "F3_vector_alignment",
    f"""with kw as ({CLEAN_SQL}) select row_id, keyword, round(embedding[1], 5) as first, vec_id is null as missing
from kw left join embeddings on row_id = vec_id""",
)
def _(spark, sf):
    rows = clean_keywords(spark, sf)
    stored = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vec"))
    aligned = embed.align_vectors(
        rows.select("row_id", F.col("row_id").cast("string").alias("keyword"), F.col("keyword").alias("original")), stored
    )
    return aligned.select(
        "row_id",
        F.col("original").alias("keyword"),
        F.round(F.col("vec")[0], 5).alias("first"),
        F.col("vec").isNull().alias("missing"),
    )


@query(
    "G1_cluster_count",
    """select lang, source, count(*) as n, cast(least(greatest(10, least(floor(sqrt(count(*) / 0.5)), 1000)), count(*))
 as int) as k from documents group by lang, source""",
)
def _(spark, sf):
    sizes = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return sizes.withColumn("k", coarse.cluster_count(F.col("n")))


@query("G2_coarse_fit")
def _(spark, sf):
    points = vectors(spark, sf).select("row_id", "vec")
    settings = coarse.CoarseSettings()
    labels = coarse.assign(points, coarse.fit_centroids(points, settings))
    return rounded(labels, "distance")


# Thirteen groups far apart and narrow: k-means finds them whatever the seeds, if it has enough centroids.
FAR_GROUPS = """far as (select e.vec_id as row_id, list_transform(range(1, len(e.embedding) + 1),
 lambda i: 0.001 * e.embedding[i]::double + case when i = 1 + e.vec_id % 13 then 1000 else 0 end) as vec, e.vec_id % 13 as grp from embeddings e)"""


def far_groups(spark, sf):
    rows = table(spark, sf, "embeddings")
    shifted = F.transform("embedding", lambda v, i: 0.001 * v.cast("double") + F.when(i == F.col("vec_id") % 13, 1000).otherwise(0))
    return rows.select(F.col("vec_id").alias("row_id"), shifted.alias("vec"))


def _no_group_mixed(blocks):
    """Per group its rows and whether a block holds rows of another one."""
    per_block = blocks.groupBy("coarse_id").agg(F.count_distinct(F.col("row_id") % 13).alias("groups"), F.count("*").alias("size"))
    return (
        blocks.join(per_block, "coarse_id")
        .groupBy((F.col("row_id") % 13).alias("grp"))
        .agg(F.count("*").alias("n"), F.max("groups").alias("groups"), F.bool_and(F.col("size") <= 60).alias("bounded"))
    )


@query("G2_tree_blocks", "select vec_id % 13 as grp, count(*) as n, 1::bigint as groups, true as bounded from embeddings group by 1")
def _(spark, sf):
    points = far_groups(spark, sf)
    tree = coarse.fit_tree(points, coarse.TreeSettings(max_block=60, branching=32))
    return _no_group_mixed(coarse.route(points, tree))


@query(
    "G3_nearest_assignment",
    f"""with {FX2}, {centroids_sql('fx', 'label', 'lc')} select row_id, lc.label::bigint as coarse_id,
 round(list_distance(x, c), 6) as distance from fx, lc
 qualify row_number() over (partition by row_id order by list_distance(x, c), lc.label) = 1""",
)
def _(spark, sf):
    return rounded(coarse.assign(vectors(spark, sf), label_centroids(spark, sf)), "distance")


@query("G4_cluster_sizes", f"with {FX2} select cluster_id, count(*) as size from fx group by 1")
def _(spark, sf):
    return coarse.cluster_sizes(vectors(spark, sf), "cluster_id")


@query(
    "G4_fine_cluster_sizes",
    f"with {FX2} select cluster_id, count(*) as size from fx where cluster_id >= 0 group by 1",
)
def _(spark, sf):
    return coarse.cluster_sizes(vectors(spark, sf), "cluster_id", keep_outliers=False)


@query(
    "G5_coherence",
    f"""with {CENTROIDS} select cluster_id, round(case when count(*) >= 2 then exp(-avg(list_distance(x, c))) else 0 end, 6)
 as coherence from labelled join cents using (cluster_id) group by 1""",
)
def _(spark, sf):
    points = vectors(spark, sf)
    return rounded(coarse.coherence(points, merge.cluster_centroids(points)), "coherence")


@query(
    "G7_inertia",
    f"""with {CENTROIDS} select round(sum(pow(list_distance(x, c), 2)), 5) as inertia from labelled
 join cents using (cluster_id)""",
)
def _(spark, sf):
    points = vectors(spark, sf)
    return rounded(coarse.inertia(points, merge.cluster_centroids(points)), "inertia", digits=5)


@query("G6_split_large")
def _(spark, sf):
    return coarse.split_large(blocks(spark, sf), max_size=20).select("row_id", "coarse_id")


_CORE = f"""{FX2}, d as (select a.row_id, b.row_id as other, a.label, list_distance(a.x, b.x) as d from fx a join fx b
 on a.label = b.label and a.row_id <> b.row_id), core as (select row_id, d as core from d
 qualify row_number() over (partition by row_id order by d, other) = 2)"""


@query(
    "H1a_core_distance",
    f"""with {_CORE} select label::bigint as coarse_id, row_id, round(core, 6) as core_distance
 from core join fx using (row_id)""",
)
def _(spark, sf):
    return rounded(density.reachability(blocks(spark, sf)).drop("nearest"), "core_distance")


@query(
    "H1b_mutual_reachability",
    f"""with {_CORE} select label::bigint as coarse_id, d.row_id,
 round(min(greatest(d, a.core, b.core)), 6) as nearest from d join core a on d.row_id = a.row_id
 join core b on d.other = b.row_id group by 1, 2""",
)
def _(spark, sf):
    return rounded(density.reachability(blocks(spark, sf)).drop("core_distance"), "nearest")


@query("H1_density_labels")
def _(spark, sf):
    return rounded(density.density_labels(blocks(spark, sf)), "probability")


# Block sizes from 1 to a few hundred rows, with noise, straight from the part table.
_LOCAL = [
    "p_partkey as row_id",
    "cast(floor(sqrt(p_partkey)) as bigint) as coarse_id",
    "cast(case when p_size % 4 = 0 then -1 else p_size % 3 end as int) as local_id",
]


def local_labels(spark, sf):
    return table(spark, sf, "part").selectExpr(*_LOCAL)


LOCAL_SQL = f"loc as (select {', '.join(_LOCAL)} from part)"


@query(
    "H2_small_groups",
    f"""with {FX2}, g as (select row_id, cast(floor(sqrt(row_id * 8)) as bigint) as coarse_id from fx)
select coarse_id, row_id, 0 as local_id, 1.0::double as probability from g
qualify count(*) over (partition by coarse_id) < 40""",
)
def _(spark, sf):
    points = vectors(spark, sf).select("row_id", "vec", F.floor(F.sqrt(F.col("row_id") * 8)).alias("coarse_id"))
    labels = density.density_labels(points, density.DensitySettings(min_cluster_size=40))
    small = points.groupBy("coarse_id").count().filter("count < 40")
    return labels.join(small.select("coarse_id"), "coarse_id", "left_semi")


@query("H1c_density_one_block")
def _(spark, sf):
    points = vectors(spark, sf).select("row_id", "vec", F.lit(0).cast("long").alias("coarse_id"))
    return rounded(density.density_labels(points), "probability")


# Groups of five rows next to one another, far from all others; five rows cannot hold two clusters of three.
PLANTED = """planted as (select e.vec_id as row_id, list_transform(range(1, len(e.embedding) + 1),
 lambda i: 0.01 * e.embedding[i]::double + 100 * g.embedding[i]::double) as vec, e.vec_id // 5 as grp
 from embeddings e join embeddings g on g.vec_id = (e.vec_id // 5) * 5)"""


def planted_groups(spark, sf):
    rows = table(spark, sf, "embeddings")
    lead = rows.filter("vec_id % 5 = 0").select(F.expr("vec_id div 5").alias("grp"), F.col("embedding").alias("lead"))
    vec = F.zip_with("embedding", "lead", lambda own, g: 0.01 * own.cast("double") + 100 * g.cast("double"))
    return rows.withColumn("grp", F.expr("vec_id div 5")).join(lead, "grp").select(F.col("vec_id").alias("row_id"), vec.alias("vec"))


@query(
    "H1c_planted_groups",
    f"""with {PLANTED}, counted as (select row_id, count(*) over w as n, min(row_id) over w as least from planted
 window w as (partition by grp)) select row_id, case when n >= 3 then least else -1 end as least_row from counted""",
)
def _(spark, sf):
    points = planted_groups(spark, sf).withColumn("coarse_id", F.lit(0).cast("long"))
    labels = cut_lineage(density.density_labels(points, density.DensitySettings(chunk=100)))
    least = labels.filter("local_id >= 0").groupBy("local_id").agg(F.min("row_id").alias("least_row"))
    return labels.join(least, "local_id", "left").select("row_id", F.coalesce("least_row", F.lit(-1)).alias("least_row"))


@query(
    "H3_global_ids",
    f"""with {LOCAL_SQL}, ids as (select coarse_id, local_id, row_number() over (order by coarse_id, local_id) - 1 as id
 from (select distinct coarse_id, local_id from loc where local_id >= 0))
select row_id, coarse_id, local_id, coalesce(id, -1) as cluster_id from loc left join ids using (coarse_id, local_id)""",
)
def _(spark, sf):
    return density.global_ids(local_labels(spark, sf))


@query(
    "H4_subcluster_ids",
    f"""with {LOCAL_SQL}, f as (select coarse_id, count(*) as size, count(distinct local_id) filter (local_id >= 0) as n
 from loc group by 1) select coarse_id, row_id, cast(100 + case when size < 3 then 0 when local_id >= 0 then local_id
 else n end as bigint) as cluster_id from loc join f using (coarse_id)""",
)
def _(spark, sf):
    return density.subcluster_ids(local_labels(spark, sf), 100)


@query(
    "H5_adaptive_settings",
    """select lang, count(*) as n, cast(case when count(*) < 50 then 2 when count(*) < 200 then 3 when count(*) < 1000
 then 4 else 5 end as int) as min_cluster_size, cast(case when count(*) < 50 then 1 when count(*) < 1000 then 2
 else 3 end as int) as min_samples from documents group by lang, source union all
 select 'all', count(*), cast(case when count(*) < 50 then 2 when count(*) < 200 then 3 when count(*) < 1000
 then 4 else 5 end as int), cast(case when count(*) < 50 then 1 when count(*) < 1000 then 2 else 3 end as int)
 from documents""",
)
def _(spark, sf):
    documents = table(spark, sf, "documents")
    sizes = documents.groupBy("lang", "source").agg(F.count("*").alias("n")).drop("source")
    sizes = sizes.unionByName(documents.select(F.lit("all").alias("lang")).groupBy("lang").agg(F.count("*").alias("n")))
    size, samples = density.adaptive_settings(F.col("n"))
    return sizes.select("lang", "n", size.alias("min_cluster_size"), samples.alias("min_samples"))


@query(
    "H6_outlier_rate",
    f"""with {LOCAL_SQL} select count(*) filter (local_id = -1) as n_outliers,
 round(count(*) filter (local_id = -1) / count(*), 6) as outlier_rate from loc""",
)
def _(spark, sf):
    return rounded(density.outlier_rate(local_labels(spark, sf)), "outlier_rate")


@query(
    "I1_cluster_centroids",
    f"""with {CENTROIDS} select cluster_id, n as size, unnest(range(len(c)))::int as pos, round(unnest(c), 6) as value
 from cents""",
)
def _(spark, sf):
    centroids = merge.cluster_centroids(vectors(spark, sf))
    return centroids.select("cluster_id", "size", F.posexplode("centroid").alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "I2_centroid_similarity",
    f"with {PAIRS} select id_a::bigint as id_a, id_b::bigint as id_b, round(s, 6) as similarity from pairs where s >= {MERGE}",
)
def _(spark, sf):
    centroids = cut_lineage(merge.cluster_centroids(vectors(spark, sf)))
    return rounded(similar_pairs(centroids, MERGE), "similarity")


_ROW_PAIRS = f"""with {FX2} select a.row_id as id_a, b.row_id as id_b, round(list_cosine_similarity(a.x, b.x), 6)
 as similarity from fx a join fx b on a.row_id < b.row_id where list_cosine_similarity(a.x, b.x) >= 0.6"""


@query("I2_row_similarity", _ROW_PAIRS)
def _(spark, sf):
    rows = cut_lineage(vectors(spark, sf).select(F.col("row_id").alias("cluster_id"), F.col("vec").alias("centroid")))
    return rounded(similar_pairs(rows, 0.6), "similarity")


@query("I2_row_similarity_blocks", _ROW_PAIRS)
def _(spark, sf):
    rows = cut_lineage(vectors(spark, sf).select(F.col("row_id").alias("cluster_id"), F.col("vec").alias("centroid")))
    return rounded(similar_pairs(rows, 0.6, budget=120_000), "similarity")


_COMPONENTS = f"""{PAIRS}, e as (select id_a as a, id_b as b from pairs where s >= {MERGE} union all
 select id_b, id_a from pairs where s >= {MERGE}), reach as (select cluster_id as id, cluster_id as other from cents union
 select reach.id, e.b from reach join e on reach.other = e.a), roots as (select id as cluster_id, min(other) as root
 from reach group by 1)"""


@query(
    "I3_merge_components",
    f"with recursive {_COMPONENTS} select cluster_id::bigint as id, root::bigint as component from roots "
    "where cluster_id in (select a from e)",
)
def _(spark, sf):
    centroids = cut_lineage(merge.cluster_centroids(vectors(spark, sf)))
    pairs = similar_pairs(centroids, MERGE)
    return merge.connected_components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


@query(
    "I3_components_of_chains",
    "select p_partkey as id, p_partkey // 20 * 20 as component from part",
)
def _(spark, sf):
    linked = "p_partkey + case when p_partkey % 20 = 19 then -7 else 1 end as b"
    return merge.connected_components(table(spark, sf, "part").selectExpr("p_partkey as a", linked))


@query(
    "I4_merged_ids",
    f"""with recursive {_COMPONENTS} select cluster_id::bigint as cluster_id, dense_rank() over (order by root) - 1
 as merged_id from roots""",
)
def _(spark, sf):
    return merge.merge_clusters(vectors(spark, sf), MERGE)


@query(
    "I5_similar_clusters",
    f"""with {PAIRS} select id_a::bigint as id_a, id_b::bigint as id_b, round(s, 6) as similarity from pairs
 where s >= {MERGE} order by s desc, 1, 2""",
)
def _(spark, sf):
    return rounded(merge.similar_clusters(vectors(spark, sf), MERGE), "similarity")


_BEST = f"""with {CENTROIDS} select row_id, cents.cluster_id::bigint as cluster_id,
 round(list_cosine_similarity(x, c), 6) as score from fx, cents where fx.cluster_id = -1
 qualify row_number() over (partition by row_id order by list_cosine_similarity(x, c) desc, cents.cluster_id) = 1"""


def _best_clusters(spark, sf, **options):
    points = vectors(spark, sf)
    centroids = cut_lineage(merge.cluster_centroids(points))
    return rounded(
        outliers.nearest_centroid(points.filter("cluster_id = -1"), centroids, **options), "score"
    )


@query("J1_best_cluster", _BEST)
def _(spark, sf):
    return _best_clusters(spark, sf)


@query("J1_best_cluster_blocks", _BEST)
def _(spark, sf):
    return _best_clusters(spark, sf, budget=2_000)


def _passes_sql(bounds: list[float]) -> str:
    parts = ["p0 as (select row_id, x, cluster_id as cl, null::double as sim, null::int as pass_no from fx)"]
    for i, bound in enumerate(bounds, start=1):
        parts.append(f"l{i} as (select * from p{i - 1} where cl >= 0)")
        parts.append(centroids_sql(f"l{i}", "cl", f"c{i}"))
        parts.append(
            f"""b{i} as (select row_id, c{i}.cl as best, list_cosine_similarity(x, c) as s from p{i - 1}, c{i}
 where p{i - 1}.cl = -1 qualify row_number() over (partition by row_id order by s desc, best) = 1)"""
        )
        parts.append(
            f"""p{i} as (select p.row_id, x, case when s >= {bound} then best else cl end as cl,
 case when s >= {bound} then s else sim end as sim, case when s >= {bound} then {i} else pass_no end as pass_no
 from p{i - 1} p left join b{i} using (row_id))"""
        )
    return f"{FX2}, " + ", ".join(parts)


_BANDS = "case when sim >= 0.75 then 'high' when sim >= 0.6 then 'medium' else 'low' end"
_PLACED = """select row_id, -1 as original_cluster, cl::bigint as new_cluster, round(sim, 6) as similarity,
 {bands} as confidence, pass_no from {last} where pass_no is not null"""


@query(
    "J2_reassign_outliers",
    f"with {_passes_sql([0.55, 0.45, 0.35, 0.25])} {_PLACED.format(bands=_BANDS, last='p4')}",
)
def _(spark, sf):
    return rounded(outliers.reassign_outliers(vectors(spark, sf)), "similarity")


@query("J2_reassign_single_pass", f"with {_passes_sql([0.55])} {_PLACED.format(bands=_BANDS, last='p1')}")
def _(spark, sf):
    return rounded(outliers.reassign_outliers(vectors(spark, sf), aggressive=False), "similarity")


@query(
    "J3_confidence_band",
    """select event_id, case when value / 100 >= 0.75 then 'high' when value / 100 >= 0.6 then 'medium' else 'low' end
 as confidence from events""",
)
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", outliers.confidence_band(F.col("value") / 100).alias("confidence")
    )


@query(
    "J4_reassignment_stats",
    f"""with {_passes_sql([0.55, 0.45, 0.35, 0.25])}, f as (select count(*) filter (p0.cl = -1) as o,
 count(*) filter (p4.cl = -1) as r, count(*) as n from p0 join p4 using (row_id))
select o as original_outliers, r as remaining_outliers, o - r as reassigned,
 round((o - r) / o, 6) as reassignment_rate, round(1 - r / n, 6) as final_cluster_rate from f""",
)
def _(spark, sf):
    points = vectors(spark, sf)
    after = outliers.apply_reassignment(points, outliers.reassign_outliers(points))
    stats = outliers.reassignment_stats(points, after)
    return rounded(stats, "reassignment_rate", "final_cluster_rate")


_VALIDATIONS = [
    "label as cluster_id",
    "count(*) / 100.0::double as average_overlap",
    "case when label % 3 = 0 then 0::double else least(1::double, count(*) / 50.0::double) end as confidence",
]

_QUALITY = f"""{CENTROIDS}, v as (select {', '.join(_VALIDATIONS)} from embeddings where label <> 7 group by label),
 q as (select cluster_id, count(*) as size, avg(list_distance(x, c)) as d, any_value(average_overlap) as o,
 any_value(confidence) as f from labelled join cents using (cluster_id) left join v using (cluster_id) group by 1),
 scored as (select *, least(100, 30 * exp(-d) + case when f > 0 then o * 30 else 15 end + case when size between 5 and 100
 then 20 when size < 5 then size * 4 else greatest(10, 20 - (size - 100) * 0.1) end + coalesce(f * 20, 10)) as quality
 from q)"""


def validation_fixture(spark, sf):
    rows = table(spark, sf, "embeddings").filter("label <> 7")
    return rows.groupBy(F.col("label").alias("cluster_id")).agg(
        (F.count("*") / 100.0).alias("average_overlap"),
        F.when(F.first("label") % 3 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.count("*") / 50.0)).alias("confidence"),
    )


@query(
    "L1_cluster_info",
    f"""with {_QUALITY} select cluster_id::bigint as cluster_id, size, round(c[1], 6) as first_coordinate,
 round(o, 6) as average_overlap, round(f, 6) as confidence, round(quality, 6) as quality_score
 from scored join cents using (cluster_id)""",
)
def _(spark, sf):
    info = cluster_info(vectors(spark, sf), validation_fixture(spark, sf))
    info = info.withColumn("first_coordinate", F.col("centroid")[0]).drop("centroid")
    return rounded(info, "first_coordinate", "average_overlap", "confidence", "quality_score")


@query(
    "L2_quality_without_validation",
    f"""with {CENTROIDS}, q as (select cluster_id, count(*) as size, avg(list_distance(x, c)) as d from labelled
 join cents using (cluster_id) group by 1) select cluster_id::bigint as cluster_id, round(least(100, 30 * exp(-d) + 15 + case
 when size between 5 and 100 then 20 when size < 5 then size * 4 else greatest(10, 20 - (size - 100) * 0.1) end + 10), 6)
 as quality_score from q""",
)
def _(spark, sf):
    return rounded(cluster_info(vectors(spark, sf)).select("cluster_id", "quality_score"), "quality_score")


@query("P1_projection")
def _(spark, sf):
    return rounded(project_2d(vectors(spark, sf)), "x", "y")
