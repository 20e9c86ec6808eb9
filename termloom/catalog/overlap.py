"""URL-overlap validation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.catalog.fixtures import GROUP_SQL, table
from termloom.catalog.metrics import rounded
from termloom.catalog.registry import query
from termloom.operators import overlap
from termloom.operators.assemble import top_members

_MEMBERS = [
    "p_partkey as row_id",
    f"{GROUP_SQL} as cluster_id",
    "'part '||cast(p_partkey as varchar(20)) as keyword",
    "cast(floor(p_retailprice) as bigint) as search_volume",
]

FX3 = f"""members as (select {', '.join(_MEMBERS)} from part), sold as (select l_partkey as row_id, l_suppkey % 17 as site,
 sum(l_quantity) as q from lineitem group by 1, 2), serps as (select row_id,
 list('https://site' || site || '.example.com/' order by q desc, site)[1:10] as urls from sold group by 1),
 top as (select *, row_number() over (partition by cluster_id order by search_volume desc, row_id) as rank from members
 qualify rank <= 10), items as (select top.*, coalesce(urls, []) as urls from top left join serps
 on top.row_id = serps.row_id and top.row_id % 23 <> 0),
 pairs as (select a.cluster_id, a.rank as i, b.rank as j, a.keyword as keyword_a, b.keyword as keyword_b,
 case when len(a.urls) = 0 or len(b.urls) = 0 then 0 else len(list_intersect(a.urls, b.urls)) /
 len(list_distinct(list_concat(a.urls, b.urls))) end as overlap from items a join items b using (cluster_id)
 where a.rank < b.rank), facts as (select cluster_id, count(*) as n, count(*) filter (len(urls) > 0) as covered
 from items group by 1), checks as (select cluster_id, n, case when n < 2 then 1 else (select avg(overlap) from pairs p
 where p.cluster_id = facts.cluster_id) end as average_overlap, case when n < 2 then 0 else covered / n
 * least(1, n / 5) end as confidence from facts)"""


def members(spark, sf):
    return table(spark, sf, "part").selectExpr(*_MEMBERS)


def serps(spark, sf):
    sold = (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey", (F.col("l_suppkey") % 17).alias("site"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    rank = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("q"), "site"))
    url = F.format_string("https://site%d.example.com/", "site")
    best = sold.withColumn("rank", rank).filter("rank <= 10").select("l_partkey", F.struct("rank", url.alias("url")).alias("u"))
    listed = best.groupBy("l_partkey").agg(F.array_sort(F.collect_list("u")).alias("us"))
    # Every 23rd part is stored under another name, so its lookup finds nothing.
    name = F.when(F.col("l_partkey") % 23 == 0, "unlisted %d").otherwise("part %d")
    keyword = F.regexp_replace(name, "%d", F.col("l_partkey").cast("string"))
    return listed.select(keyword.alias("keyword"), F.col("us.url").alias("urls"))


def checked(spark, sf):
    return overlap.checked_items(members(spark, sf), serps(spark, sf))


@query("K1_checked_keywords", f"with {FX3} select cluster_id, cast(rank as int) as rank, keyword from top")
def _(spark, sf):
    return top_members(members(spark, sf), 10).select("cluster_id", "rank", "keyword")


@query(
    "K2_pairwise_overlap",
    f"with {FX3} select cluster_id, keyword_a, keyword_b, round(overlap, 6) as overlap from pairs",
)
def _(spark, sf):
    return rounded(overlap.pairwise_overlap(checked(spark, sf)), "overlap")


@query("K3_average_overlap", f"with {FX3} select cluster_id, round(average_overlap, 6) as average_overlap from checks")
def _(spark, sf):
    return rounded(overlap.validate_clusters(checked(spark, sf)).select("cluster_id", "average_overlap"), "average_overlap")


@query(
    "K4_common_urls",
    f"""with {FX3}, u as (select cluster_id, rank, unnest(urls[1:10]) as url, generate_subscripts(urls[1:10], 1) as pos
 from items), c as (select cluster_id, url, count(*) as appearances, min((rank, pos)) as first from u group by 1, 2)
select cluster_id, cast(row_number() over (partition by cluster_id order by appearances desc, first) as int) as position,
 url, appearances from c join facts using (cluster_id) where n >= 2 and appearances >= greatest(2, n * 0.3)
qualify position <= 10""",
)
def _(spark, sf):
    return overlap.common_urls(checked(spark, sf))


@query(
    "K5_validation",
    f"""with {FX3} select cluster_id, n::int as keywords_checked, round(average_overlap, 6) as average_overlap,
 round(confidence, 6) as confidence, average_overlap >= 0.4 as is_coherent from checks""",
)
def _(spark, sf):
    return rounded(overlap.validate_clusters(checked(spark, sf)), "average_overlap", "confidence")


@query(
    "K6_split_suggestion",
    f"""with recursive {FX3}, near as (select cluster_id, j, list(i order by i) as seeds from pairs where overlap >= 0.4
 group by 1, 2), steps(cluster_id, n, j, g) as (select cluster_id, n, 1, [1::bigint] from facts union all
 select s.cluster_id, s.n, s.j + 1, list_append(g, coalesce(list_filter(seeds, lambda i: g[i] = i)[1], s.j + 1))
 from steps s left join near on near.cluster_id = s.cluster_id and near.j = s.j + 1 where s.j < s.n)
select cluster_id, cast(rank as int) as rank, keyword,
 cast(case when average_overlap >= 0.4 or checks.n < 3 then 1 else g[rank] end as int) as "group"
from items join checks using (cluster_id) join steps using (cluster_id) where steps.j = steps.n""",
)
def _(spark, sf):
    return overlap.suggest_splits(checked(spark, sf))


@query(
    "K7_missing_results",
    f"with {FX3} select cluster_id, keyword, len(urls)::int as urls from items where len(urls) = 0",
)
def _(spark, sf):
    items = checked(spark, sf).select("cluster_id", F.explode("items").alias("i"))
    return items.select("cluster_id", "i.keyword", F.size("i.urls").alias("urls")).filter("urls = 0")
