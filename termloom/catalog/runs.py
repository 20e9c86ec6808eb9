"""Job state, progress and end-to-end run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog.fixtures import GROUP_SQL, keywords, table
from termloom.catalog.metrics import rounded
from termloom.catalog.registry import query
from termloom.catalog.vectors import FX2, centroids_sql, label_centroids
from termloom.operators import jobs
from termloom.plans.keyword_run import run
from termloom.session import scratch_path
from termloom.streaming.assign import stream_assignments

_UPDATES = [
    "user_id as job_id",
    "event_id as seq",
    "case event_type when 'view' then 'pending' when 'click' then 'processing' when 'signup' then 'paused' "
    "when 'purchase' then 'completed' else 'failed' end as status",
    "case when value > 60 then event_type end as current_phase",
    "case when event_id % 4 = 0 then cast(floor(value) as bigint) end as processed_keywords",
    "case when event_type = 'error' then 'e' || event_id end as error_message",
]


@query(
    "Q1_job_states",
    f"""with u as (select {', '.join(_UPDATES)} from events) select job_id, arg_max(status, seq) as status,
 arg_max(current_phase, seq) filter (current_phase is not null) as current_phase,
 arg_max(processed_keywords, seq) filter (processed_keywords is not null) as processed_keywords,
 arg_max(error_message, seq) filter (error_message is not null) as error_message, max(seq) as updated from u group by 1""",
)
def _(spark, sf):
    return jobs.job_states(table(spark, sf, "events").selectExpr(*_UPDATES))


_JOB_ROWS = [
    "o_orderkey as job_id",
    "case o_orderstatus when 'O' then 'processing' when 'P' then 'paused' else 'completed' end as status",
    "o_orderdate as created_at",
]


@query(
    "Q2_resumable_jobs",
    f"""with j as (select {', '.join(_JOB_ROWS)} from orders) select job_id, status from j
 where status in ('processing', 'paused') order by created_at desc, job_id desc limit 10""",
)
def _(spark, sf):
    return jobs.resumable_jobs(table(spark, sf, "orders").selectExpr(*_JOB_ROWS)).select("job_id", "status")


_MEMBERS = ["p_brand as job_id", f"case when p_partkey % 13 = 0 then -1 else {GROUP_SQL} end as cluster_id"]


@query(
    "Q3_job_statistics",
    f"""with k as (select {', '.join(_MEMBERS)} from part), c as (select p_brand as job_id, p_type,
 cast(sum(cast(floor(p_retailprice) as bigint)) as bigint) as v, avg(p_size) as d from part where p_brand <> 'Brand#3' group by 1, 2),
 ks as (select job_id, count(*) as n, count(*) filter (cluster_id >= 0) as m from k group by 1),
 cs as (select job_id, count(*) as c, cast(sum(v) as bigint) as v, avg(d) as d from c group by 1)
select job_id, coalesce(c, 0) as total_clusters, n as total_keywords, m as clustered_keywords, n - m as unclustered_keywords,
 round(m / n, 6) as cluster_rate, coalesce(v, 0) as total_search_volume, round(coalesce(d, 0), 6) as avg_keyword_difficulty
from ks left join cs using (job_id)""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    clusters = (
        part.filter("p_brand <> 'Brand#3'")
        .groupBy(F.col("p_brand").alias("job_id"), "p_type")
        .agg(F.sum(F.floor("p_retailprice")).alias("total_search_volume"), F.avg("p_size").alias("avg_keyword_difficulty"))
    )
    return rounded(jobs.job_statistics(part.selectExpr(*_MEMBERS), clusters), "cluster_rate", "avg_keyword_difficulty")


_EVENTS = [
    "user_id as job_id",
    "case event_type when 'view' then 'upload' when 'click' then 'enrichment' when 'signup' then 'embedding' "
    "when 'purchase' then 'clustering' else case when event_id % 2 = 0 then 'labeling' else 'serp_validation' end end as phase",
    "event_id as seq",
    "ts",
    "case when value >= 20 then 'completed' when value < 0.8 then 'failed' else 'running' end as status",
    "case when value >= 20 then 1.0::double else least(1.0::double, value / 100) end as progress",
]

_PHASES = f"""e as (select {', '.join(_EVENTS)} from events), l as (select job_id, phase, min(ts) as started,
 arg_max(status, seq) as status, arg_max(progress, seq) as progress, arg_max(ts, seq) as last from e group by 1, 2),
 p as (select job_id, phase, status, progress, (epoch_us(case when status in ('completed', 'failed') then last
 else timestamp '2024-02-01' end) - epoch_us(started)) / 1e6 as elapsed from l)"""


def phases(spark, sf):
    rows = table(spark, sf, "events").selectExpr(*_EVENTS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return jobs.phase_progress(rows, F.expr("timestamp_ntz '2024-02-01'"))


@query(
    "Q4_phase_progress",
    f"""with {_PHASES} select job_id, phase, status, round(progress, 6) as progress, round(elapsed, 3) as elapsed_seconds,
 round(case when status = 'running' and progress > 0 and elapsed > 0 then elapsed / progress - elapsed end, 2) as eta_seconds
 from p""",
)
def _(spark, sf):
    df = rounded(phases(spark, sf), "progress")
    return rounded(rounded(df, "elapsed_seconds", digits=3), "eta_seconds", digits=2)


@query(
    "Q4_job_progress",
    f"""with {_PHASES} select job_id, round(sum(progress) / 6, 6) as overall_progress,
 count(*) filter (status = 'completed') = 6 as is_completed, bool_or(status = 'failed') as is_failed from p group by 1""",
)
def _(spark, sf):
    return rounded(jobs.job_progress(phases(spark, sf)), "overall_progress")


@query(
    "S1_stream_assignment",
    f"""with {FX2}, {centroids_sql('fx', 'label', 'lc')}, e as (select vec_id as row_id,
 list_transform(embedding, lambda v: v::double) as x from embeddings), s as (select row_id, lc.label,
 list_cosine_similarity(x, c) as s from e, lc qualify row_number() over (partition by row_id order by s desc, lc.label) = 1)
select row_id, case when s >= 0.3 then label else -1 end::bigint as cluster_id, round(s, 6) as similarity from s""",
)
def _(spark, sf):
    schema = table(spark, sf, "embeddings").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/embeddings*.parquet")
    points = arriving.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"))
    output = scratch_path(spark, "assigned")
    stream = stream_assignments(points, label_centroids(spark, sf), 0.3, output, scratch_path(spark, "stream"))
    stream.awaitTermination()
    placed = spark.read.schema("row_id long, cluster_id long, similarity double, batch int").parquet(output)
    return rounded(placed.drop("batch"), "similarity")


def keyword_run(spark, sf):
    return run(keywords(spark, sf))


@query("keyword_report")
def _(spark, sf):
    return rounded(keyword_run(spark, sf).report, "avg_difficulty", "quality_score")
