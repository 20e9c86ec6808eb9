"""Input views derived from the given tables, as Spark DataFrames with their SQL twins for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.functions.text import EDGE_SPACE, SPACE
from termloom.operators.validate import split_valid


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Cluster id from brand number and type: 0..149, with every 13th part unclustered.
GROUP_SQL = (
    "(cast(substr(p_brand, 7) as int) - 1) * 6 + case p_type when 'ECONOMY' then 0 when 'LARGE' then 1 "
    "when 'MEDIUM' then 2 when 'PROMO' then 3 when 'SMALL' then 4 else 5 end"
)

_KEYWORD_COLUMNS = [
    "p_partkey as row_id",
    "p_brand||'|'||p_type as grp",
    f"case when p_partkey % 13 = 0 then -1 else {GROUP_SQL} end as cluster_id",
    """case when p_partkey % 97 = 5 then repeat('x',201) when p_partkey % 89 = 7 then '  '
  when p_partkey % 10 = 0 then 'buy '||p_name when p_partkey % 10 = 1 then 'Best  '||p_name||' reviews'
  when p_partkey % 10 = 2 then 'how to use '||p_name when p_partkey % 10 = 3 then p_name||' login'
  when p_partkey % 10 = 4 then upper(p_name) when p_partkey % 10 = 5 then '  '||p_name||' '
  when p_partkey % 10 = 6 then 'https://example.com/'||cast(p_partkey as varchar(20))
  when p_partkey % 10 = 7 then cast(p_partkey as varchar(20)) when p_partkey % 10 = 8 then '???'
  else p_name||' vs '||lower(p_type)||' for small homes' end as keyword""",
    "case when p_partkey % 11 = 0 then null else cast(floor(p_retailprice) as bigint) end as search_volume",
    "cast(p_size as double)*2 as keyword_difficulty",
    "round(p_retailprice/1000,2) as cpc",
]


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*_KEYWORD_COLUMNS)


KEYWORDS_SQL = "select " + ",\n ".join(_KEYWORD_COLUMNS) + " from part"

# Keywords keep their cluster but lose invalid texts: the input of labelling and reporting.
CLEAN_FILTER = "length(keyword) <= 200 and trim(keyword) <> '' and p_tag not in (6, 7, 8)"


def clean_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The valid keywords by the rules; the SQL twin names them by how `_KEYWORD_COLUMNS` makes them."""
    return split_valid(keywords(spark, sf))[0]


CLEAN_SQL = (
    "select row_id, grp, cluster_id, keyword, search_volume, keyword_difficulty, cpc from (select "
    + ",\n ".join(_KEYWORD_COLUMNS)
    + f", p_partkey % 10 as p_tag from part) where {CLEAN_FILTER}"
)

# Text pieces shared by oracle statements.
def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '{EDGE_SPACE}', '', 'g')"


def canonical_sql(col: str) -> str:
    return f"regexp_replace(lower({strip_sql(col)}), '{SPACE}+', ' ', 'g')"


def words_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{SPACE}+'), lambda w: w <> '')"
