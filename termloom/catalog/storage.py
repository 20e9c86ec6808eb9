"""Source, cache, enrichment and job-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog.fixtures import CLEAN_SQL, KEYWORDS_SQL, clean_keywords, keywords, strip_sql, table
from termloom.catalog.metrics import METRICS_SQL, rounded
from termloom.catalog.registry import query
from termloom.catalog.vectors import CENTROIDS, vectors
from termloom.operators import enrich
from termloom.operators.assemble import cluster_metrics, clustered
from termloom.operators.merge import cluster_centroids
from termloom.session import cut_lineage, scratch_path
from termloom.sources.delimited import MISSING, NUMBER, detect_roles, preview, project_roles, read_delimited
from termloom.sources.responses import parse_metrics, parse_serps
from termloom.sources.tables import JobTables, centroid_keywords

# Raw lines: quoted keywords, every 17th row with a field too many, every 19th one too short.
_LINE = '''p_partkey || ';"' || p_name || '; ""new""";' || cast(p_size as string) || case when p_partkey % 17 = 0 then ';9;9'
 when p_partkey % 19 = 0 then '' else ';' || p_brand end'''


@query(
    "A1_delimited_scan",
    """select p_partkey::varchar as id, p_name || '; "new"' as keyword, p_size::varchar as volume,
 case when p_partkey % 19 <> 0 then p_brand end as brand from part where p_partkey % 17 <> 0""",
)
def _(spark, sf):
    path = scratch_path(spark, "upload")
    table(spark, sf, "part").select(F.expr(_LINE).alias("value")).write.text(path)
    return read_delimited(spark, path, ["id", "keyword", "volume", "brand"]).drop("row_id")


# An upload with names in mixed case and cells of every awkward kind.
_CELLS = [
    "p_partkey as row_id",
    """case p_partkey % 20 when 0 then 'null' when 1 then 'N/A' when 2 then '' when 3 then '  ' when 4 then ' nan '
 else '  ' || p_name || ' ' end as "Top Queries " """,
    """case p_partkey % 9 when 0 then '1,000' when 1 then '12.7' when 2 then '-3.9' when 3 then '1e3' when 4 then 'inf'
 when 5 then 'NaN' when 6 then '1_500' when 7 then ' 42 ' else null end as "Volume" """,
    "case p_partkey % 7 when 0 then 'hard' when 1 then '7d' else cast(p_size as varchar(10)) || '.5' end as \"KD\"",
    "p_brand as clicks",
]
_NUMBER_SQL = (
    "coalesce(case when regexp_matches({0}, '" + NUMBER + "') then cast({0} as double) end, 0)"
)


def upload(spark, sf):
    return table(spark, sf, "part").selectExpr(
        *[e.replace('as "Top Queries "', "as `Top Queries `").replace('as "Volume"', "as Volume").replace('as "KD"', "as KD") for e in _CELLS]
    )


@query(
    "A2_column_roles",
    """select role, name from (values ('keyword', 'Top Queries '), ('search_volume', 'Volume'), ('keyword_difficulty', 'KD'))
 t(role, name), (select count(*) as n from part) where n > 0""",
)
def _(spark, sf):
    raw = upload(spark, sf)
    roles = detect_roles(raw.columns)
    rows = F.array(*[F.struct(F.lit(k).alias("role"), F.lit(v).alias("name")) for k, v in roles.items()])
    return raw.agg(F.count("*").alias("n")).filter("n > 0").select(F.explode(rows).alias("r")).select("r.*")


@query(
    "A3_role_projection",
    f"""with raw as (select {', '.join(_CELLS)} from part), c as (select row_id, "Top Queries " as k,
 regexp_replace({strip_sql('"Volume"')}, '([0-9])_([0-9])', '\\1\\2', 'g') as v, {strip_sql('"KD"')} as d from raw)
select row_id, {strip_sql('k')} as keyword, trunc({_NUMBER_SQL.format('v')})::bigint as search_volume,
 {_NUMBER_SQL.format('d')}::double as keyword_difficulty from c
where k not in ({', '.join(f"'{m}'" for m in MISSING)}) and {strip_sql('k')} <> ''""",
)
def _(spark, sf):
    return project_roles(upload(spark, sf))


@query(
    "A4_preview",
    """select p_partkey as row_id, p_brand as clicks, (select count(*) from part) as row_count, 4 as total_columns,
 true as has_volume, true as has_kd from part order by p_partkey limit 5""",
)
def _(spark, sf):
    raw = upload(spark, sf)
    facts, sample = preview(raw)
    return sample.select(
        "row_id", "clicks", *[F.lit(facts[k]).alias(k) for k in ("total_columns", "has_volume", "has_kd")],
        F.lit(facts["row_count"]).cast("long").alias("row_count"),
    )


_PAGE_ITEM = """'{"link": ' || case when page_id % 5 = 0 then 'null' when page_id % 5 = 1 then '""' else '"' || url || '"' end
 || ', "title": "T' || page_id || '", "position": ' || cast(page_id % 10 as varchar(10)) || ', "snippet": "s"}'"""


@query(
    "A5_serp_responses",
    """with p as (select *, page_id // 10 as k from pages) select 'k' || k as keyword,
 coalesce(string_agg(case when page_id % 5 > 1 then url end, '|' order by page_id), '') as urls,
 string_agg('T' || page_id, '|' order by page_id) as titles, 'Why k' || k || '?' as people_also_ask,
 '' as related_searches, count(*)::int as organic, sum(page_id % 10)::bigint as positions from p
 where k % 40 <> 7 group by k union all select distinct 'k' || k, '', '', '', '', 0, 0 from p where k % 40 = 7""",
)
def _(spark, sf):
    items = table(spark, sf, "pages").select(
        F.expr("page_id div 10 as k"), "page_id", F.expr(_PAGE_ITEM.replace("varchar(10)", "string")).alias("item")
    )
    joined = items.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("items"))
    text = F.when(F.col("k") % 40 == 7, "<html>busy</html>").otherwise(
        F.format_string(
            '{"organic": [%s], "peopleAlsoAsk": [{"question": "Why k%d?"}, {"question": ""}], "relatedSearches": [{"query": ""}]}',
            F.array_join("items.item", ", "),
            F.col("k"),
        )
    )
    parsed = parse_serps(joined.select(F.concat(F.lit("k"), F.col("k")).alias("keyword"), text.alias("response")))
    positions = F.aggregate("organic", F.lit(0).cast("long"), lambda s, o: s + F.coalesce(o["position"], F.lit(0)))
    lists = ("urls", "titles", "people_also_ask", "related_searches")
    return parsed.select(
        "keyword", *[F.array_join(c, "|").alias(c) for c in lists], F.size("organic").alias("organic"), positions.alias("positions")
    )


_METRIC_ITEM = """'{"keyword": ' || case when p_partkey % 31 = 0 then '""' else '"' || p_name || '"' end || ', "search_volume": '
 || case when p_partkey % 5 = 0 then 'null' else cast(p_size as varchar(10)) end || ', "keyword_difficulty": '
 || cast(p_size as varchar(10)) || '.5' || case when p_partkey % 3 = 0 then ', "cpc": 0.25' else '' end || '}'"""


@query(
    "A6_metrics_responses",
    """select p_name as keyword, case when p_partkey % 5 = 0 then 0 else p_size end::bigint as search_volume,
 p_size + 0.5::double as keyword_difficulty, case when p_partkey % 3 = 0 then 0.25 else 0 end::double as cpc,
 0::double as competition from part where p_partkey % 31 <> 0
qualify row_number() over (partition by p_name order by p_partkey // 20 desc, p_partkey % 2 desc, p_partkey desc) = 1""",
)
def _(spark, sf):
    items = table(spark, sf, "part").selectExpr(
        "p_partkey div 20 as response_id", "p_partkey % 2 as task", "p_partkey", f"{_METRIC_ITEM} as item".replace("varchar(10)", "string")
    )
    tasks = items.groupBy("response_id", "task").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("i"))
    task = F.concat(F.lit('{"result": ['), F.array_join("i.item", ", "), F.lit("]}"))
    responses = tasks.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("task", task.alias("text")))).alias("t"))
    text = F.concat(F.lit('{"tasks": ['), F.array_join("t.text", ", "), F.lit("]}"))
    return parse_metrics(responses.select("response_id", text.alias("response")))


def job_tables(spark, sf, stored=None):
    """A fresh root with the clean keywords of two jobs; `stored` are these keywords where the caller has them written.

    They are cleaned and written once, because five writes read them.
    """
    tables = JobTables(spark, scratch_path(spark, "jobs"))
    stored = cut_lineage(clean_keywords(spark, sf)) if stored is None else stored
    rows, counted = stored.drop("grp"), cut_lineage(cluster_metrics(clustered(stored)))
    for job_id, share in (("job-a", "row_id % 3 = 0"), ("job-b", "row_id % 3 <> 0")):
        tables.insert_keywords(job_id, rows.filter(share))
        jobs = rows.filter(share).agg(
            F.lit(job_id).alias("job_id"), F.lit("processing").alias("status"), F.count("*").alias("total_keywords")
        )
        tables.add_job(jobs)
        tables.save_clusters(
            job_id,
            counted.filter("cluster_id % 3 = 0" if job_id == "job-a" else "cluster_id % 3 <> 0").select(
                "cluster_id", "keyword_count", "total_search_volume", "avg_keyword_difficulty"
            ),
        )
    return tables


_KW = f"kw as ({CLEAN_SQL})"


@query(
    "A7_job_keywords",
    f"""with {_KW} select keyword, search_volume, keyword_difficulty, cluster_id::bigint as cluster_id,
 case when min(row_id) over (partition by keyword) % 2 = 0 then 2 end as dims from kw where row_id % 3 = 0""",
)
def _(spark, sf):
    tables = job_tables(spark, sf)
    vec = F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    rows = clean_keywords(spark, sf).filter("row_id % 3 = 0")
    per_text = rows.groupBy("keyword").agg(F.min("row_id").alias("row_id"))
    tables.save_vectors("job-a", per_text.filter("row_id % 2 = 0").select(F.col("keyword").alias("text"), vec.alias("vec")))
    read = tables.keywords("job-a", with_embeddings=True)
    return read.withColumn("dims", F.when(F.col("embedding").isNotNull(), F.size("embedding"))).drop("embedding")


@query(
    "A7_job_keywords_limited",
    f"""with {_KW} select keyword, search_volume, keyword_difficulty, cluster_id::bigint as cluster_id from kw
 where row_id % 3 <> 0 order by row_id limit 25""",
)
def _(spark, sf):
    return job_tables(spark, sf).keywords("job-b", limit=25)


@query(
    "A8_job_clusters",
    f"""with {METRICS_SQL} select cluster_id::bigint as cluster_id, keyword_count, total_search_volume,
 round(avg_keyword_difficulty, 6) as avg_keyword_difficulty from metrics where cluster_id % 3 = 0""",
)
def _(spark, sf):
    rows = job_tables(spark, sf).clusters("job-a")
    return rounded(
        rows.select("cluster_id", "keyword_count", "total_search_volume", "avg_keyword_difficulty"), "avg_keyword_difficulty"
    )


@query(
    "A9_cluster_members",
    f"with {_KW} select keyword, search_volume, keyword_difficulty from kw where row_id % 3 <> 0 and cluster_id = 40",
)
def _(spark, sf):
    return job_tables(spark, sf).cluster_keywords("job-b", 40)


@query(
    "A10_job_row",
    f"""with {_KW} select 'job-b' as job_id, 'processing' as status, count(*) as total_keywords from kw where row_id % 3 <> 0""",
)
def _(spark, sf):
    tables = job_tables(spark, sf)
    found = tables.job("job-b").unionByName(tables.job("job-missing"))
    return found.select("job_id", "status", "total_keywords")


@query(
    "B1_bulk_insert",
    f"""with {_KW} select case when row_id % 3 = 0 then 'job-a' else 'job-b' end as job_id, row_id, keyword,
 search_volume, cluster_id::bigint as cluster_id from kw""",
)
def _(spark, sf):
    return job_tables(spark, sf).read("keywords").select("job_id", "row_id", "keyword", "search_volume", "cluster_id")


@query(
    "B2_keyed_update",
    f"""with {_KW}, last as (select keyword, arg_max(length(keyword) + row_id % 5, row_id) as v from kw group by 1)
select case when row_id % 3 = 0 then 'job-a' else 'job-b' end as job_id, row_id, keyword,
 case when row_id % 3 = 0 and keyword like 'buy%' then v else search_volume end::bigint as search_volume,
 case when row_id % 3 <> 0 and keyword like 'how%' then 7 else cluster_id end::bigint as cluster_id, cpc
 from kw join last using (keyword)""",
)
def _(spark, sf):
    rows = cut_lineage(clean_keywords(spark, sf))
    tables = job_tables(spark, sf, rows)
    volumes = rows.filter("keyword like 'buy%'").select(
        "keyword", (F.length("keyword") + F.col("row_id") % 5).cast("long").alias("search_volume"), F.col("row_id").alias("step")
    )
    missing = rows.limit(1).select(
        F.lit("not a keyword").alias("keyword"), F.lit(1).cast("long").alias("search_volume"), F.col("row_id").alias("step")
    )
    tables.update_keywords("job-a", volumes.unionByName(missing), sequence="step")
    labels = rows.filter("keyword like 'how%'").select("keyword", F.lit(7).cast("long").alias("cluster_id"))
    tables.update_keywords("job-b", labels)
    return tables.read("keywords").select("job_id", "row_id", "keyword", "search_volume", "cluster_id", "cpc")


_LOG = """log as (select 'user ' || user_id as keyword, ts as fetched_at, event_id, cast(floor(value) as bigint) as search_volume,
 value / 4 as keyword_difficulty from events where event_type = 'signup'),
 serp as (select 'user ' || user_id as keyword, ts as fetched_at, event_id from events where event_type = 'purchase'),
 probe as (select c_custkey as row_id, 'user ' || c_custkey as keyword, cast(floor(c_acctbal) as bigint) as search_volume,
 c_acctbal / 100 as keyword_difficulty from customer),
 fresh as (select * from log where fetched_at >= timestamp '2024-01-28'
  qualify row_number() over (partition by keyword order by fetched_at desc, event_id desc) = 1),
 fresh_serp as (select * from serp where fetched_at >= timestamp '2024-01-30'
  qualify row_number() over (partition by keyword order by fetched_at desc, event_id desc) = 1)"""

AS_OF, SERP_AS_OF = "timestamp_ntz '2024-02-04'", "timestamp_ntz '2024-01-31'"


def cache_log(spark, sf, kind="signup"):
    return (
        table(spark, sf, "events")
        .filter(F.col("event_type") == kind)
        .select(
            F.format_string("user %d", "user_id").alias("keyword"),
            F.col("ts").cast("timestamp_ntz").alias("fetched_at"),
            "event_id",
            F.floor("value").alias("search_volume"),
            (F.col("value") / 4).alias("keyword_difficulty"),
        )
    )


def probe(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.format_string("user %d", "c_custkey").alias("keyword"),
        F.floor("c_acctbal").alias("search_volume"),
        (F.col("c_acctbal") / 100).alias("keyword_difficulty"),
    )


def fresh_metrics(spark, sf):
    return enrich.fresh_entries(cache_log(spark, sf), F.expr(AS_OF), sequence="event_id")


def fresh_serps(spark, sf):
    return enrich.fresh_entries(cache_log(spark, sf, "purchase"), F.expr(SERP_AS_OF), enrich.SERP_TTL, "event_id")


@query(
    "B3_cache_upsert",
    f"""with {_LOG} select keyword, event_id, search_volume from log
 qualify row_number() over (partition by keyword order by fetched_at desc, event_id desc) = 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "metrics-cache")
    log = cache_log(spark, sf)
    for share in (0, 1):
        log.filter(F.col("event_id") % 2 == share).write.mode("append").parquet(path)
    stored = spark.read.schema(log.schema).parquet(path)
    return enrich.latest_entries(stored, "event_id").select("keyword", "event_id", "search_volume")


@query(
    "B4_cluster_rows",
    f"""with {CENTROIDS} select cluster_id::bigint as cluster_id, 'part ' || row_id as centroid_keyword, n as keyword_count
 from labelled join cents using (cluster_id)
 qualify row_number() over (partition by cluster_id order by list_cosine_similarity(x, c) desc, row_id) = 1""",
)
def _(spark, sf):
    points = vectors(spark, sf).withColumn("keyword", F.format_string("part %d", "row_id"))
    centroids = cut_lineage(cluster_centroids(points))
    named = centroid_keywords(points, centroids).join(centroids.select("cluster_id", "size"), "cluster_id")
    tables = JobTables(spark, scratch_path(spark, "clusters"))
    tables.save_clusters("job-a", named.select("cluster_id", "centroid_keyword", F.col("size").alias("keyword_count")))
    return tables.clusters("job-a").select("cluster_id", "centroid_keyword", "keyword_count")


@query(
    "B5_delete_job",
    f"""with {METRICS_SQL} select 'keywords' as source, count(*) as n from kw where row_id % 3 <> 0 or row_id % 6 = 0 union all
 select 'clusters', count(*) from metrics where cluster_id % 3 <> 0 union all select 'jobs', 1 union all
 select 'compacted', count(*) from kw where row_id % 3 <> 0 or row_id % 6 = 0""",
)
def _(spark, sf):
    tables = job_tables(spark, sf)
    tables.delete_job("job-a")
    tables.insert_keywords("job-a", clean_keywords(spark, sf).drop("grp").filter("row_id % 6 = 0"))
    target = scratch_path(spark, "compacted")
    tables.compact("keywords", target)
    counts = [
        tables.read(name).agg(F.lit(name).alias("source"), F.count("*").alias("n")) for name in ("keywords", "clusters", "jobs")
    ]
    counts.append(
        JobTables(spark, target).read("keywords").agg(F.lit("compacted").alias("source"), F.count("*").alias("n"))
    )
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(
    "E1_fresh_metrics",
    f"with {_LOG} select keyword, search_volume, event_id from fresh where keyword in (select keyword from probe)",
)
def _(spark, sf):
    hits = enrich.cached(probe(spark, sf), fresh_metrics(spark, sf))
    return hits.select("keyword", "search_volume", "event_id")


@query("E2_fresh_serps", f"with {_LOG} select keyword, event_id from fresh_serp where keyword in (select keyword from probe)")
def _(spark, sf):
    return enrich.cached(probe(spark, sf), fresh_serps(spark, sf)).select("keyword", "event_id")


@query(
    "E3_uncached_keywords",
    f"""with {_LOG} select row_id, keyword, 'metrics' as cache from probe where keyword not in (select keyword from fresh)
 union all select row_id, keyword, 'serp' from probe where keyword not in (select keyword from fresh_serp)""",
)
def _(spark, sf):
    asked = probe(spark, sf).select("row_id", "keyword")
    metrics_missing = enrich.uncached(asked, fresh_metrics(spark, sf)).withColumn("cache", F.lit("metrics"))
    serp_missing = enrich.uncached(asked, fresh_serps(spark, sf)).withColumn("cache", F.lit("serp"))
    return metrics_missing.unionByName(serp_missing)


_STATS = f"""{_LOG}, f as (select count(*) as t, (select count(*) from fresh where keyword in (select keyword from probe)) as m,
 (select count(*) from fresh_serp where keyword in (select keyword from probe)) as s from probe)"""


@query(
    "E4_cache_stats",
    f"""with {_STATS} select t as total_keywords, m as metrics_cached, t - m as metrics_uncached, round(m / t, 6) as metrics_hit_rate,
 s as serp_cached, t - s as serp_uncached, round(s / t, 6) as serp_hit_rate from f""",
)
def _(spark, sf):
    stats = enrich.cache_stats(probe(spark, sf), fresh_metrics(spark, sf), fresh_serps(spark, sf))
    return rounded(stats, "metrics_hit_rate", "serp_hit_rate")


@query(
    "E5_savings",
    f"""with {_STATS} select m as metrics_api_calls_saved, s as serp_api_calls_saved,
 round_even(m / 1000 * 0.05 + s * 0.001, 2)::double as estimated_savings_usd from f""",
)
def _(spark, sf):
    return enrich.savings(enrich.cache_stats(probe(spark, sf), fresh_metrics(spark, sf), fresh_serps(spark, sf)))


@query(
    "E6_metric_merge",
    f"""with {_LOG} select row_id, p.keyword, coalesce(f.search_volume, p.search_volume) as search_volume,
 round(coalesce(f.keyword_difficulty, p.keyword_difficulty), 6) as keyword_difficulty
 from probe p left join fresh f using (keyword)""",
)
def _(spark, sf):
    old = probe(spark, sf).select("keyword", F.lit(-1).alias("search_volume"), F.lit(-1.0).alias("keyword_difficulty"))
    fresh = fresh_metrics(spark, sf).withColumnRenamed("event_id", "sequence")
    stale = old.join(fresh.select("keyword"), "keyword", "left_semi")
    earlier = fresh.withColumns({"sequence": F.col("sequence") - 1, "search_volume": F.col("search_volume") + 1000})
    merged = enrich.merge_metrics(probe(spark, sf), stale, fresh.unionByName(earlier))
    return rounded(merged, "keyword_difficulty")


@query(
    "E7_metrics_present",
    f"""with kw as ({KEYWORDS_SQL}) select 'all' as part, count(*) > 0 and bool_and(coalesce(search_volume, 0) > 0) as complete
 from kw union all select 'known', bool_and(search_volume > 0) from kw where search_volume is not null""",
)
def _(spark, sf):
    rows = keywords(spark, sf)
    whole = enrich.has_all_metrics(rows).select(F.lit("all").alias("part"), "complete")
    known = enrich.has_all_metrics(rows.filter("search_volume is not null"))
    return whole.unionByName(known.select(F.lit("known").alias("part"), "complete"))


@query(
    "E8_enrichment_summary",
    f"""with {_KW} select cast(sum(search_volume) as bigint) as total_search_volume,
 round(avg(coalesce(keyword_difficulty, 0)), 6) as avg_difficulty, count(*) as keywords from kw""",
)
def _(spark, sf):
    return rounded(enrich.enrichment_summary(clean_keywords(spark, sf)), "avg_difficulty")


@query(
    "E8_top_keywords",
    f"""with {_KW} select row_id, keyword, coalesce(search_volume, 0) as search_volume, coalesce(keyword_difficulty, 0) as kd
 from kw order by 3 desc, row_id limit 20""",
)
def _(spark, sf):
    return enrich.top_by_volume(clean_keywords(spark, sf))


@query(
    "E9_request_batches",
    f"""with {_KW}, n as (select *, (row_number() over (order by row_id) - 1) // 100 + 1 as batch from kw)
select batch, count(*)::int as size, string_agg(keyword, '|' order by row_id) as payload from n group by batch""",
)
def _(spark, sf):
    batches = enrich.request_batches(clean_keywords(spark, sf), 100)
    return batches.select("batch", F.size("keywords").alias("size"), F.array_join("keywords", "|").alias("payload"))


_PLACE = "case c_nationkey % 8 when 0 then 'Germany' when 1 then 'United Kingdom' when 2 then 'Japan' when 3 then 'Atlantis' else c_name end"
_TONGUE = "case c_nationkey % 8 when 0 then 'German' when 1 then 'English' when 2 then 'Japanese' else null end"


@query(
    "E11_request_codes",
    f"""select c_custkey, case {_PLACE} when 'Germany' then 2276 when 'United Kingdom' then 2826 when 'Japan' then 2392
 else 2840 end as location_code, case {_TONGUE} when 'German' then 'de' when 'Japanese' then 'ja' else 'en' end
 as language_code from customer""",
)
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        enrich.location_code(F.expr(_PLACE)).alias("location_code"),
        enrich.language_code(F.expr(_TONGUE)).alias("language_code"),
    )
