"""Report, view and export dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog.fixtures import clean_keywords, table
from termloom.catalog.metrics import METRICS_SQL, PRIORITY_SQL, rounded
from termloom.catalog.registry import query
from termloom.functions.numbers import gauge, band
from termloom.operators import reports
from termloom.operators.assemble import cluster_report, report_totals, run_summary
from termloom.session import scratch_path
from termloom.sources.sinks import read_csv_table, write_csv

_LABELS = [
    "cluster_id",
    "max(case when cluster_id % 3 <> 0 then grp end) as label",
    "max(case cluster_id % 5 when 0 then 'informational' when 1 then 'transactional' when 2 then 'commercial' "
    "when 3 then 'navigational' end) as intent",
    "max(case when cluster_id % 7 <> 0 then (cluster_id * 37 % 101)::double + 0.125 end) as quality_score",
]

REPORT_SQL = f"""{METRICS_SQL}, labels_fx as (select {", ".join(_LABELS)} from kw where cluster_id >= 0
 group by cluster_id), report as (select cluster_id as id, coalesce(label, 'Cluster ' || cluster_id) as label,
 keyword_count as size, total_search_volume as total_volume, avg_keyword_difficulty as avg_difficulty,
 coalesce(intent, 'unknown') as intent, coalesce(quality_score, 0) as quality_score,
 {PRIORITY_SQL} as priority_score from metrics join labels_fx using (cluster_id)),
 firsts as (select cluster_id as id, list(keyword order by row_id)[1:5] as f from kw where cluster_id >= 0
 group by cluster_id)"""

_TITLE = "upper(intent[1]) || lower(intent[2:])"


def labels_fixture(spark, sf):
    members = clean_keywords(spark, sf).filter("cluster_id >= 0")
    return members.groupBy("cluster_id").agg(*[F.expr(e.split(" as ")[0]).alias(e.split(" as ")[1]) for e in _LABELS[1:]])


def report(spark, sf):
    labels = labels_fixture(spark, sf)
    return cluster_report(clean_keywords(spark, sf), labels, labels)


@query(
    "L8_cluster_report",
    f"with {REPORT_SQL} select * replace (round(avg_difficulty, 6) as avg_difficulty) from report",
)
def _(spark, sf):
    return rounded(report(spark, sf), "avg_difficulty")


@query(
    "L10_report_totals",
    f"""with {REPORT_SQL} select count(*) as total_clusters, cast(sum(total_volume) as bigint) as total_volume,
 round(sum(avg_difficulty * size) / sum(size), 6) as avg_difficulty, round(avg(quality_score), 6) as avg_quality,
 cast(sum(size) as bigint) as clustered_keywords from report""",
)
def _(spark, sf):
    return rounded(report_totals(report(spark, sf)), "avg_difficulty", "avg_quality")


_EXPORT_SQL = """select id as cluster_id, label as cluster_label, keyword, coalesce(search_volume, 0) as search_volume,
 coalesce(keyword_difficulty, 0) as keyword_difficulty, intent, total_volume as cluster_total_volume,
 round_even(avg_difficulty * 100, 0) / 100 as cluster_avg_difficulty, size as cluster_size,
 round_even(quality_score * 100, 0) / 100 as quality_score from report join kw on cluster_id = id"""


@query("B6_keyword_export", f"with {REPORT_SQL} {_EXPORT_SQL}")
def _(spark, sf):
    export = reports.keyword_export(report(spark, sf), clean_keywords(spark, sf))
    path = scratch_path(spark, "keyword-export")
    write_csv(export, path)
    return read_csv_table(spark, path, export.schema)


@query(
    "B7_cluster_export",
    f"""with {REPORT_SQL} select id as cluster_id, label, size, total_volume,
 round_even(avg_difficulty * 100, 0) / 100 as avg_difficulty, intent,
 round_even(quality_score * 100, 0) / 100 as quality_score, array_to_string(f, ' | ') as top_keywords
from report join firsts using (id)""",
)
def _(spark, sf):
    export = reports.cluster_export(report(spark, sf), clean_keywords(spark, sf))
    path = scratch_path(spark, "cluster-export")
    write_csv(export, path)
    return read_csv_table(spark, path, export.schema)


@query(
    "B8_unclustered_export",
    f"""with {REPORT_SQL} select keyword, coalesce(search_volume, 0) as search_volume,
 coalesce(keyword_difficulty, 0) as keyword_difficulty from kw where cluster_id = -1""",
)
def _(spark, sf):
    export = reports.unclustered_export(clean_keywords(spark, sf))
    path = scratch_path(spark, "unclustered-export")
    write_csv(export, path)
    return read_csv_table(spark, path, export.schema)


@query(
    "B9_report_header",
    f"""with {REPORT_SQL} select count(*) as total_keywords, (select count(*) from report) as total_clusters,
 printf('%.1f%%', count(*) filter (cluster_id >= 0) / count(*) * 100) as cluster_rate from kw""",
)
def _(spark, sf):
    return reports.report_header(run_summary(clean_keywords(spark, sf)))


@query(
    "B10_workbook_summary",
    f"""with {REPORT_SQL}, f as (select (select count(*) from kw) as n, count(*) as c, sum(total_volume) as v,
 sum(avg_difficulty * size) / sum(size) as d, (select count(*) from kw where cluster_id = -1) as o from report)
select 0 as line, 'Total Keywords' as metric, n::varchar as value from f
union all select 1, 'Total Clusters', c::varchar from f
union all select 2, 'Cluster Rate', printf('%.1f%%', (n - o) / n * 100) from f
union all select 3, 'Total Search Volume', format('{{:,}}', v::bigint) from f
union all select 4, 'Average Difficulty', printf('%.1f', d) from f
union all select 5, 'Unclustered Keywords', o::varchar from f""",
)
def _(spark, sf):
    return reports.workbook_summary(run_summary(clean_keywords(spark, sf)), report_totals(report(spark, sf)))


@query(
    "B10_workbook_clusters",
    f"""with {REPORT_SQL}, r as (select *, round_even(quality_score * 10, 0) / 10 as q from report) select id as cluster_id,
 label, size, total_volume, round_even(avg_difficulty * 10, 0) / 10 as avg_difficulty, {_TITLE} as intent,
 q as quality_score, case when q >= 70 then 'green' when q >= 40 then 'orange' else 'red' end as quality_band,
 array_to_string(f, ', ') as top_keywords from r join firsts using (id)""",
)
def _(spark, sf):
    return reports.workbook_clusters(report(spark, sf), clean_keywords(spark, sf))


@query(
    "B10_workbook_keywords",
    f"""with {REPORT_SQL} select keyword, id as cluster_id, label as cluster_label,
 coalesce(search_volume, 0) as search_volume, coalesce(keyword_difficulty, 0) as keyword_difficulty,
 {_TITLE} as intent from report join kw on cluster_id = id""",
)
def _(spark, sf):
    return reports.workbook_keywords(report(spark, sf), clean_keywords(spark, sf))


_INTENT_SQL = f"""with {REPORT_SQL} select {_TITLE} as intent, count(*) as clusters,
 round(count(*) / (select count(*) from report) * 100, 6) as percent from report group by 1"""


@query("P5_intent_breakdown", _INTENT_SQL)
def _(spark, sf):
    return rounded(reports.intent_histogram(report(spark, sf)), "percent")


@query("P2_size_distribution", f"with {REPORT_SQL} select id, label, size from report order by size desc, id limit 20")
def _(spark, sf):
    return reports.size_distribution(report(spark, sf))


@query(
    "P3_treemap",
    f"""with {REPORT_SQL} select id, label || '<br>' || format('{{:,}}', total_volume) || ' vol | ' || size || ' kw' as label,
 total_volume as volume, cast((select sum(total_volume) from report) as bigint) as overall_volume from report""",
)
def _(spark, sf):
    return reports.treemap(report(spark, sf))


@query(
    "P4_opportunity_matrix",
    f"""with {REPORT_SQL}, f as (select max(size) as s, avg(avg_difficulty) as d, median(total_volume) as v from report)
select id, label, round(avg_difficulty, 6) as difficulty, total_volume as volume,
 round(10 + size / s * 40, 6) as marker_size, round(d, 6) as difficulty_split, v::double as volume_split,
 case when total_volume >= v and avg_difficulty < d then 'Quick Wins' when total_volume >= v then 'High Value'
 else '' end as quadrant from report, f""",
)
def _(spark, sf):
    df = reports.opportunity_matrix(report(spark, sf))
    return rounded(df, "difficulty", "marker_size", "difficulty_split")


@query(
    "P6_quality_leaders",
    f"""with {REPORT_SQL} select id, label, quality_score, case when quality_score >= 70 then 'green'
 when quality_score >= 40 then 'orange' else 'red' end as band, printf('%.0f', quality_score) as text
from report order by quality_score desc, id limit 20""",
)
def _(spark, sf):
    return reports.quality_leaders(report(spark, sf))


_GAUGE_INPUT = (
    "case event_id % 50 when 0 then null when 1 then cast('NaN' as double) when 2 then cast('Infinity' as double) "
    "when 3 then cast('-Infinity' as double) when 4 then -value else value end as raw"
)


@query(
    "P7_gauge_values",
    f"""with e as (select event_id, {_GAUGE_INPUT} from events), g as (select event_id, case when raw is null or
 isnan(raw) or isinf(raw) then 0 else greatest(0, least(100, raw)) end as value from e)
select event_id, value, case when value >= 70 then 'green' when value >= 40 then 'orange' else 'red' end as band from g""",
)
def _(spark, sf):
    raw = table(spark, sf, "events").selectExpr("event_id", _GAUGE_INPUT)
    return raw.select("event_id", gauge(F.col("raw")).alias("value")).withColumn("band", band(F.col("value")))


@query(
    "P7_kpi_gauges",
    f"""with {REPORT_SQL}, f as (select (select count(*) filter (cluster_id >= 0) / count(*) from kw) as r,
 avg(quality_score) as q, count(distinct label) / count(*) as c from report), g as (
 select 'Cluster Rate' as gauge, r * 100 as value from f union all select 'Avg Quality', q from f
 union all select 'SERP Coherence', 0.0 from f union all select 'Label Consistency', c * 100 from f)
select gauge, round(value, 6) as value, case when value >= 70 then 'green' when value >= 40 then 'orange'
 else 'red' end as band from g""",
)
def _(spark, sf):
    rate = run_summary(clean_keywords(spark, sf)).select("cluster_rate").scalar()
    kpis = report(spark, sf).agg(
        rate.alias("cluster_rate"),
        F.avg("quality_score").alias("avg_quality"),
        F.lit(None).cast("double").alias("serp_overlap"),
        (F.count_distinct("label") / F.count("*")).alias("consistency_score"),
    )
    return rounded(reports.gauges(kpis), "value")


@query(
    "P8_kpi_badges",
    f"""with {REPORT_SQL}, k as (select cluster_id, count(*) as n from kw group by 1) select id,
 format('{{:,}}', total_volume) as volume, case when avg_difficulty < 30 then 'Easy' end as easy, case when
 avg_difficulty < 30 then 'green' when avg_difficulty < 60 then 'orange' else 'red' end as difficulty_band,
 case when quality_score / 100 > 0.8 then 'Good' else 'Low' end as rate_badge from report""",
)
def _(spark, sf):
    return report(spark, sf).select(
        "id",
        F.format_number("total_volume", 0).alias("volume"),
        reports.easy_badge(F.col("avg_difficulty")).alias("easy"),
        reports.difficulty_band(F.col("avg_difficulty")).alias("difficulty_band"),
        reports.rate_badge(F.col("quality_score") / 100).alias("rate_badge"),
    )


@query(
    "P9_cluster_table",
    f"""with {REPORT_SQL} select label as "Cluster", size as "Keywords", total_volume as "Volume",
 round(avg_difficulty, 6) as "Avg. KD", {_TITLE} as "Intent", quality_score as "Quality" from report""",
)
def _(spark, sf):
    df = reports.cluster_table(report(spark, sf))
    return df.withColumn("Avg. KD", F.round(F.col("`Avg. KD`"), 6))


@query(
    "P10_member_preview",
    f"""with {REPORT_SQL} select cluster_id, cast(row_number() over (partition by cluster_id order by row_id) as int)
 as position, keyword, greatest(count(*) over (partition by cluster_id) - 5, 0) as remaining from kw
where cluster_id >= 0 qualify position <= 5""",
)
def _(spark, sf):
    return reports.member_preview(clean_keywords(spark, sf), 5)


@query(
    "P10_unclustered_preview",
    f"""with {REPORT_SQL}, u as (select *, row_number() over (order by row_id) as p, count(*) over () as total from kw
 where cluster_id = -1) select cast(p as int) as position, keyword, case when p - 1 < least(25, total // 2) then 1 else 2
 end as display_column, greatest(total - 50, 0) as remaining from u where p <= 50""",
)
def _(spark, sf):
    return reports.unclustered_preview(clean_keywords(spark, sf))
