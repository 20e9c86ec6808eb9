"""The registered queries of the corpus operators, with the SQL that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.cross_tokens import align
from termloom.llm.digest_merge import exact_groups
from termloom.llm.icws_dedup import near_duplicates
from termloom.llm.license_templates import scan_licenses
from termloom.llm.linear_packing import cut_tokens, pack
from termloom.llm.merkle_manifest import proofs
from termloom.llm.permutation_index import nearest
from termloom.llm.rank_language import language_profiles, predict_languages
from termloom.llm.rule_quality import score_documents
from termloom.llm.simhash_windows import contaminated_spans
from termloom.llm.suffix_dedup import remove_repeats
from termloom.llm.token_files import token_digest, write_tokens
from termloom.llm.url_filter import judge_urls
from termloom.session import cut_lineage, scratch_path

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

LICENSE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

LICENSE_TEMPLATES = {
    "mit-notice": "[[this software is]] released under the mit license",
    "apache-2-notice": "licensed under the apache license version 2 [[0]]",
    "cc-by-nc-4-notice": "licensed under [[the]] [[creative commons]] cc by nc 4 0 [[{{0..2}} license]]",
    "gpl-3-notice": "[[this {{1..2}} is]] licensed under the gnu general public license [[gpl]] version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this {{1..12}} to deal in the "
    "{{1..6}} without restriction",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def _remainder(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def _held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning; one without an id always is."""
    return F.coalesce(_remainder(modulus) == remainder, F.lit(True))


QUALITY_THRESHOLD = 0.3


def op2_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt = _table(spark, sf_dir, "labels").filter(~_held_out(5, 0))
    scored = score_documents(_table(spark, sf_dir, "documents"), learnt)
    return scored.select(
        "doc_id",
        _held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_digest(spark, path)


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op6_rank_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language_profiles(docs.filter(~_held_out(4, 2)))
    return predict_languages(docs, profiles).select(
        "doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score"
    )


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), LICENSE_PHRASES, LICENSE_TEMPLATES)


def op8_linear_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pack(cut_lineage(cut_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)))


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op11_digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(_remainder(7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return proofs(_table(spark, sf_dir, "documents"), {"n_chars": tampered}).drop("proof")


OP10_SQL = """
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut
), judged as (
  select page_id, host, path, case
    when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
    when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
    when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
    when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
    when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/'
  end as rule from parts
)
select page_id, host, path, rule,
  case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
from judged
"""


OP11_SQL = """
with plain as (
  select doc_id, coalesce(text, '') as t,
    translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as s
  from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by s) as group_size,
  row_number() over w = 1 as kept, sha256(s) as text_sha256
from plain window w as (partition by s order by length(t) desc, doc_id nulls last)
"""

MERKLE_LEVELS = 24


def _merkle_sql() -> str:
    """Trees level by level; a tree of one node stays as it is. Enough levels for 2 ** MERKLE_LEVELS rows."""

    def part(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    def climb(name: str, levels: int) -> list[str]:
        """Per level: tree, place, size of the level, digest; then per leaf its proof and its digest folded."""
        out = []
        for k in range(1, levels + 1):
            below = f"{name}{k - 1}"
            out.append(
                f"{name}{k} as materialized (select tree, place // 2 as place, (any_value(size) + 1) // 2 as size,"
                " case when any_value(size) > 1 then sha256(string_agg(h, '' order by place)) else any_value(h) end as h"
                f" from {below} group by tree, place // 2)"
            )
        return out

    def fold(leaves: str, name: str, out: str, levels: int) -> list[str]:
        steps = [f"{out}0 as (select *, start as p from {leaves})"]
        for k in range(1, levels + 1):
            steps.append(
                f"{out}{k} as materialized (select f.id, f.tree, f.start, f.top, f.p // 2 as p, f.proof || coalesce(n.h, '') as proof,"
                " case when f.size = 1 then f.node when n.h is null then sha256(f.node)"
                " when f.p % 2 = 1 then sha256(n.h || f.node) else sha256(f.node || n.h) end as node, (f.size + 1) // 2 as size"
                f" from {out}{k - 1} f left join {name}{k - 1} n on n.tree = f.tree and n.place = xor(f.p, 1) and f.size > 1)"
            )
        return steps

    n, m = MERKLE_LEVELS, 8
    steps = [
        f"d as (select row_number() over () as id, doc_id, coalesce('1' || lang, '0') as key, {leaf('n_chars')} as leaf,"
        f" {leaf('case when crc % 7 = 0 then n_chars + 1 else n_chars end')} as claim"
        " from (select *, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(doc_id::varchar))),"
        " lambda i: ord(substr(doc_id::varchar, (i + 1)::int, 1))::ubigint)),"
        f" lambda c, x: {_crc_byte('c', 'x')}) as rest, xor(rest, 4294967295) as crc from documents))",
        "e as materialized (select *, dense_rank() over (order by encode(key)) - 1 as tree,"
        " row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by key) as size from d)",
        "a0 as (select tree, place, size, leaf as h from e)",
        *climb("a", n),
        "subroots as materialized (select tree, h from a%d)" % n,
        "b0 as (select 0 as tree, tree as place, count(*) over () as size, h from subroots)",
        *climb("b", m),
        "f as (select id, tree, place as start, tree as top, '' as proof, claim as node, size from e)",
        *fold("f", "a", "g", n),
        f"t as (select id, 0 as tree, tree as start, tree as top, proof, node, (select count(*) from subroots) as size from g{n})",
        *fold("t", "b", "u", m),
    ]
    return (
        "with " + ",\n".join(steps) + "\nselect e.doc_id, e.leaf, s.h as subroot, r.h as root, sha256(u.proof) as proof_sha256,"
        " u.node as folded_root, u.node = r.h as verified"
        f" from e join subroots s on s.tree = e.tree join u{m} u on u.id = e.id cross join (select h from b{m}) r"
    )


def _crc_byte(crc: str, byte: str) -> str:
    """CRC-32 of one more byte, bit by bit."""
    value = f"xor({crc}, {byte})"
    steps = f"list_reduce([{value}, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)"
    return steps


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_icws_near_dedup,
        op2_rule_quality,
        op3_token_files,
        op4_permutation_index,
        op5_suffix_dedup,
        op6_rank_language,
        op7_license_templates,
        op8_linear_packing,
        op9_simhash_windows,
        op10_url_filter,
        op11_digest_merge,
        op12_cross_tokens,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in named}


def oracles() -> dict[str, str]:
    return {"op10_url_filter": OP10_SQL, "op11_digest_merge": OP11_SQL, "op13_merkle_manifest": _merkle_sql()}
