"""Validation and deduplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog.fixtures import KEYWORDS_SQL, canonical_sql, keywords, strip_sql
from termloom.catalog.registry import query
from termloom.functions.text import DIGIT, SPECIAL, WORD, canonical
from termloom.operators.dedup import dedup_stats, duplicate_rows, keep_best, merge_duplicates, top_duplicates
from termloom.operators.validate import split_valid, validation_stats, validation_warnings, with_reason

TEXT = strip_sql("keyword")
CANON = canonical_sql("keyword")

REASONED = f"""kw as ({KEYWORDS_SQL}), checked as (select *, case
  when keyword is null or {TEXT} = '' then 'Empty or whitespace-only'
  when length({TEXT}) > 200 then 'Too long (max 200 chars)'
  when regexp_matches({TEXT}, '(?i)^https?://') then 'URL detected'
  when regexp_matches({TEXT}, '^{DIGIT}+$') then 'Pure number'
  when not regexp_matches({TEXT}, '{WORD}') then 'No alphanumeric characters' end as reason from kw)"""


@query("C1_invalid_reason", f"with {REASONED} select row_id, keyword, reason from checked")
def _(spark, sf):
    return with_reason(keywords(spark, sf)).select("row_id", "keyword", "reason")


@query(
    "C2_valid_invalid_split",
    f"with {REASONED} select row_id, keyword, reason is null as valid from checked",
)
def _(spark, sf):
    valid, invalid = split_valid(keywords(spark, sf))
    return valid.select("row_id", "keyword", F.lit(True).alias("valid")).unionByName(
        invalid.select("row_id", "keyword", F.lit(False).alias("valid"))
    )


@query(
    "C3_validation_warnings",
    f"""with {REASONED}, facts as (select count(*) filter (reason is not null) as filtered,
  coalesce(avg(length(keyword)) filter (reason is null), 0) as avg_length,
  count(*) filter (reason is null) - count(distinct lower(keyword)) filter (reason is null) as potential_duplicates
  from checked)
select filtered, round(avg_length, 6) as avg_length, potential_duplicates,
 case when filtered > 0 then filtered || ' keywords were filtered out' end as filtered_warning,
 case when avg_length > 50 then 'Average keyword length is high (>50 chars). Consider checking for data issues.' end
   as length_warning,
 case when potential_duplicates > 0 then potential_duplicates ||
   ' potential case-insensitive duplicates detected. Consider deduplication.' end as duplicate_warning
from facts""",
)
def _(spark, sf):
    return validation_warnings(keywords(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


@query(
    "C4_validation_stats",
    f"""with {REASONED}, t as (select count(*) as total, count(*) filter (reason is null) as valid from checked)
select reason, count(*) as n, any_value(total) as total_input, any_value(valid) as valid,
 any_value(total - valid) as invalid, round(any_value(valid / total), 6) as validity_rate
from checked, t where reason is not null group by reason""",
)
def _(spark, sf):
    return validation_stats(keywords(spark, sf)).withColumn("validity_rate", F.round("validity_rate", 6))


@query(
    "D1_canonical_key",
    f"""with kw as ({KEYWORDS_SQL}) select row_id, {CANON} as canonical,
 regexp_replace({TEXT}, '[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}]+', ' ', 'g') as cased,
 regexp_replace({CANON}, '{SPECIAL}', '', 'g') as plain from kw""",
)
def _(spark, sf):
    keyword = F.col("keyword")
    return keywords(spark, sf).select(
        "row_id",
        canonical(keyword).alias("canonical"),
        canonical(keyword, case_sensitive=True).alias("cased"),
        canonical(keyword, strip_special=True).alias("plain"),
    )


@query(
    "D2_keep_best",
    f"""with kw as ({KEYWORDS_SQL}), k as (select {CANON} as canonical, * from kw where keyword <> '')
select canonical, min(row_id) over (partition by canonical) as first_row_id, row_id, keyword, search_volume,
 keyword_difficulty, cpc from k
qualify row_number() over (partition by canonical order by coalesce(search_volume, 0) desc, row_id) = 1""",
)
def _(spark, sf):
    return keep_best(keywords(spark, sf)).select(
        "canonical", "first_row_id", "row_id", "keyword", "search_volume", "keyword_difficulty", "cpc"
    )


_FOLDED = f"""kw as ({KEYWORDS_SQL}), k as (select {CANON} as canonical, {{'row_id': row_id, 'keyword': keyword,
  'vol': coalesce(search_volume, 0), 'kd': coalesce(keyword_difficulty, 0.0), 'cpc': coalesce(cpc, 0.0)}} as r from kw),
 g as (select canonical, list(r order by r.row_id) as rows from k group by canonical),
 folded as (select canonical, len(rows) - 1 as duplicate_count, list_reduce(rows, lambda s, r: case when r.vol > s.vol
  then {{'row_id': r.row_id, 'keyword': r.keyword, 'vol': s.vol + r.vol,
   'kd': case when s.kd > 0 and r.kd > 0 then (s.kd + r.kd) / 2 when r.kd <> 0 then r.kd else s.kd end,
   'cpc': greatest(s.cpc, r.cpc)}} else s end) as s from g)"""

_MERGED_SQL = f"""with {_FOLDED} select canonical, s.keyword as keyword, duplicate_count, s.vol as search_volume,
 round(s.kd, 6) as keyword_difficulty, s.cpc as cpc from folded"""


@query("D3_merge_duplicates", _MERGED_SQL)
def _(spark, sf):
    return merge_duplicates(keywords(spark, sf)).withColumn("keyword_difficulty", F.round("keyword_difficulty", 6))


@query("D3_merge_duplicates_hot_keys", _MERGED_SQL)
def _(spark, sf):
    merged = merge_duplicates(keywords(spark, sf), gather_limit=4)
    return merged.withColumn("keyword_difficulty", F.round("keyword_difficulty", 6))


@query(
    "D3_duplicate_rows",
    f"""with kw as ({KEYWORDS_SQL}), k as (select {CANON} as canonical, row_id, keyword from kw),
 f as (select *, min(row_id) over (partition by canonical) as first_row_id from k)
select canonical, row_id, keyword, first_row_id from f where row_id > first_row_id""",
)
def _(spark, sf):
    return duplicate_rows(keywords(spark, sf))


@query(
    "D4_dedup_stats",
    f"""with kw as ({KEYWORDS_SQL}) select count(*) as original_count, count(distinct {CANON}) as unique_count,
 count(*) - count(distinct {CANON}) as duplicate_count,
 round((count(*) - count(distinct {CANON})) / count(*), 6) as reduction_rate from kw""",
)
def _(spark, sf):
    return dedup_stats(keywords(spark, sf)).withColumn("reduction_rate", F.round("reduction_rate", 6))


@query(
    "D4_top_duplicates",
    f"""with {_FOLDED} select s.keyword as keyword, canonical, duplicate_count, rows[1].row_id as first_row_id,
 array_to_string(list_transform(rows[2:4], lambda r: r.keyword), ' | ') as duplicates
from folded join g using (canonical) where duplicate_count > 0
order by duplicate_count desc, first_row_id limit 5""",
)
def _(spark, sf):
    return top_duplicates(keywords(spark, sf)).withColumn("duplicates", F.array_join("duplicates", " | "))
