"""Cluster metric, ranking and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog.fixtures import CLEAN_SQL, KEYWORDS_SQL, clean_keywords, keywords, table
from termloom.catalog.registry import query
from termloom.operators.assemble import (
    cluster_metrics,
    clustered,
    metrics_summary,
    rank_clusters,
    run_summary,
    top_members,
    unclustered,
    with_priority,
)

METRICS_SQL = f"""kw as ({CLEAN_SQL}), metrics as (select cluster_id,
 cast(sum(coalesce(search_volume, 0)) as bigint) as total_search_volume,
 avg(coalesce(search_volume, 0)) as avg_search_volume,
 max(coalesce(search_volume, 0)) as max_search_volume, min(coalesce(search_volume, 0)) as min_search_volume,
 avg(coalesce(keyword_difficulty, 0)) as avg_keyword_difficulty,
 max(coalesce(keyword_difficulty, 0)) as max_keyword_difficulty,
 min(coalesce(keyword_difficulty, 0)) as min_keyword_difficulty, avg(coalesce(cpc, 0)) as avg_cpc,
 sum(coalesce(search_volume, 0) * coalesce(cpc, 0)) as total_cpc_opportunity, count(*) as keyword_count
 from kw where cluster_id >= 0 group by cluster_id)"""

PRIORITY_SQL = """round_even((least(100, ln(1 + total_search_volume) * 10) * 0.4::double
 + (100 - avg_keyword_difficulty) * 0.3::double + least(100, keyword_count * 2) * 0.3::double) * 10, 0) / 10"""


def metrics(spark, sf):
    return cluster_metrics(clustered(clean_keywords(spark, sf)))


def rounded(df, *names, digits=6):
    return df.withColumns({name: F.round(name, digits) for name in names})


@query(
    "L4_cluster_metrics",
    f"""with {METRICS_SQL} select * replace (round(avg_search_volume, 6) as avg_search_volume,
 round(avg_keyword_difficulty, 6) as avg_keyword_difficulty, round(avg_cpc, 6) as avg_cpc,
 round(total_cpc_opportunity, 4) as total_cpc_opportunity) from metrics""",
)
def _(spark, sf):
    df = rounded(metrics(spark, sf), "avg_search_volume", "avg_keyword_difficulty", "avg_cpc")
    return rounded(df, "total_cpc_opportunity", digits=4)


@query(
    "L5_metrics_summary",
    f"""with {METRICS_SQL} select count(*) as total_clusters, cast(sum(keyword_count) as bigint) as total_keywords,
 cast(sum(total_search_volume) as bigint) as total_search_volume,
 round(sum(keyword_count) / count(*), 6) as avg_cluster_size,
 round(sum(avg_keyword_difficulty * keyword_count) / sum(keyword_count), 6) as avg_keyword_difficulty,
 max(total_search_volume) as largest_cluster_volume, min(total_search_volume) as smallest_cluster_volume,
 round(sum(total_cpc_opportunity), 3) as total_cpc_opportunity from metrics""",
)
def _(spark, sf):
    df = metrics_summary(metrics(spark, sf))
    return rounded(rounded(df, "avg_cluster_size", "avg_keyword_difficulty"), "total_cpc_opportunity", digits=3)


@query(
    "L6_rank_clusters",
    f"""with {METRICS_SQL} select cluster_id, 'volume' as criterion, total_search_volume::double as score from metrics
 union all select cluster_id, 'difficulty', round(100 - avg_keyword_difficulty, 6) from metrics
 union all select cluster_id, 'opportunity', round(total_search_volume / greatest(1, avg_keyword_difficulty), 6)
 from metrics union all select cluster_id, 'size', keyword_count::double from metrics""",
)
def _(spark, sf):
    m = metrics(spark, sf)
    ranked = [
        rank_clusters(m, by).select("cluster_id", F.lit(by).alias("criterion"), F.round("score", 6).alias("score"))
        for by in ("volume", "difficulty", "opportunity", "size")
    ]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).unionByName(ranked[3])


@query("L7_priority_score", f"with {METRICS_SQL} select cluster_id, {PRIORITY_SQL} as priority_score from metrics")
def _(spark, sf):
    return with_priority(metrics(spark, sf)).select("cluster_id", "priority_score")


@query(
    "L3_run_summary",
    f"""with kw as ({KEYWORDS_SQL}), v as (select p_size, avg(p_retailprice) - 1050 as average_overlap from part
 group by p_size) select count(*) as total_keywords,
 count(*) filter (cluster_id = -1) as outlier_keywords, count(*) filter (cluster_id <> -1) as clustered_keywords,
 round(count(*) filter (cluster_id <> -1) / count(*), 6) as cluster_rate,
 count(distinct cluster_id) filter (cluster_id >= 0) as n_clusters,
 round(coalesce((select avg(average_overlap) from v where average_overlap > 0), 0), 6) as avg_serp_overlap from kw""",
)
def _(spark, sf):
    overlaps = (
        table(spark, sf, "part").groupBy("p_size").agg((F.avg("p_retailprice") - 1050).alias("average_overlap"))
    )
    return rounded(run_summary(keywords(spark, sf), overlaps), "cluster_rate", "avg_serp_overlap")


@query("L9_unclustered", f"with kw as ({CLEAN_SQL}) select row_id, keyword from kw where cluster_id = -1")
def _(spark, sf):
    return unclustered(clean_keywords(spark, sf)).select("row_id", "keyword")


TOP_SQL = """select cluster_id, rank, row_id, keyword, search_volume from (select *, cast(row_number() over
 (partition by cluster_id order by coalesce(search_volume, 0) desc, row_id) as int) as rank
 from kw where cluster_id >= 0) where rank <= 10"""


@query("L11_top_keywords", f"with kw as ({CLEAN_SQL}) {TOP_SQL}")
def _(spark, sf):
    return top_members(clean_keywords(spark, sf)).select("cluster_id", "rank", "row_id", "keyword", "search_volume")
