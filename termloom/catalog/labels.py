"""Intent, theme, phrase, prompt and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog.fixtures import CLEAN_SQL, clean_keywords, table, words_sql
from termloom.catalog.metrics import TOP_SQL, rounded
from termloom.catalog.registry import query
from termloom.catalog.reports import REPORT_SQL, report
from termloom.functions.text import WORD, boundary_pattern
from termloom.operators import intent, labels
from termloom.operators.assemble import default_label
from termloom.operators.label_choice import choose_labels, unique_labels
from termloom.sources.responses import parse_labels

BRANDS = ["widget", "bolt"]


def _count_sql(patterns: list[str], col: str) -> str:
    tests = [f"regexp_matches({col}, '(?i){boundary_pattern(p)}')::int" for p in patterns]
    return "(" + " + ".join(tests) + ")::double"


def _intent_sql(source: str, col: str, brands: list[str]) -> str:
    """CTEs `scored` and `classified` over `source`, keeping all its columns."""
    brand = " or ".join(f"contains(lower({col}), '{b}')" for b in brands) or "false"
    names = dict(zip("itnc", intent.INTENTS))
    score = {short: _count_sql(intent.SCORED[name], col) for short, name in names.items()}
    flags = {
        "branded": f"({brand})",
        "comparison": f"{_count_sql(intent.COMPARISON, col)} > 0",
        "local": f"{_count_sql(intent.LOCAL, col)} > 0",
        "long_tail": f"len({words_sql(col)}) >= 5",
        "question": f"{_count_sql(intent.QUESTION, col)} > 0",
    }
    half = f"case when {brand} then 0.5 else 0 end"
    return f"""scored as (select *, {score['i']} as i, {score['t']} as t, {score['n']} + {half} as n, {score['c']} as c,
 {', '.join(f'{test} as is_{name}' for name, test in flags.items())} from {source}),
 classified as (select *, case when i + t + n + c = 0 or i = greatest(i, t, n, c) then 'informational'
 when t = greatest(i, t, n, c) then 'transactional' when n = greatest(i, t, n, c) then 'navigational'
 else 'commercial' end as intent, case when i + t + n + c = 0 then 0.3 when greatest(i, t, n, c) >= 2
 then least(0.95, greatest(i, t, n, c) / (i + t + n + c) + 0.2) else greatest(i, t, n, c) / (i + t + n + c) end
 as confidence from scored)"""


def _flags_sql(wrap: str = "{}") -> str:
    tests = ", ".join(f"case when {wrap.format('is_' + m)} then '{m}' end" for m in intent.MODIFIERS)
    return f"concat_ws(',', {tests})"


# Texts that touch every pattern family: keywords of the part table and whole documents.
_TEXTS = f"""texts as (select 'p' || row_id as id, keyword from ({CLEAN_SQL}) union all select 'd' || doc_id, text
 from documents union all select 'c' || c_custkey, case c_custkey % 12 when 0 then 'What is the price of ' || c_name
 when 1 then 'restaurants in Boston' when 2 then 'best VS. worst ' || c_mktsegment when 3 then 'top 10 Reviews, compared'
 when 4 then 'log in to the official site' when 5 then 'plumber 90210 near me?' when 6 then 'recommended by ' || c_name
 when 7 then 'preorder or reorder' when 8 then 'sign up & get coupons' when 9 then 'pros and cons' when 10 then
 'élan vs. été' else 'how   to explain why we download app' end from customer)"""


def texts(spark, sf):
    parts = clean_keywords(spark, sf).select(F.expr("'p' || row_id as id"), "keyword")
    documents = table(spark, sf, "documents").select(F.expr("'d' || doc_id as id"), F.col("text").alias("keyword"))
    start = _TEXTS.index("case c_custkey")
    customers = table(spark, sf, "customer").select(
        F.expr("'c' || c_custkey as id"), F.expr(_TEXTS[start : _TEXTS.index("from customer")]).alias("keyword")
    )
    return parts.unionByName(documents).unionByName(customers)


_INTENTS = _intent_sql("texts", "keyword", BRANDS)


@query(
    "M1_intent_scores",
    f"""with {_TEXTS}, {_INTENTS} select id, i as informational_score, t as transactional_score, n as navigational_score,
 c as commercial_score from scored""",
)
def _(spark, sf):
    return intent.with_intent(texts(spark, sf), BRANDS).select("id", *[f"{n}_score" for n in intent.INTENTS[:4]])


@query(
    "M2_intent_decision",
    f"with {_TEXTS}, {_INTENTS} select id, intent, round(confidence, 6) as confidence from classified",
)
def _(spark, sf):
    return rounded(intent.with_intent(texts(spark, sf), BRANDS).select("id", "intent", "confidence"), "confidence")


@query("M3_modifiers", f"with {_TEXTS}, {_INTENTS} select id, {_flags_sql()} as modifiers from scored")
def _(spark, sf):
    flags = {name: F.col(f"is_{name}") for name in intent.MODIFIERS}
    rows = intent.with_intent(texts(spark, sf), BRANDS)
    return rows.select("id", F.array_join(intent.modifier_list(flags), ",").alias("modifiers"))


@query(
    "M4_classify_keywords",
    f"""with kw as (select distinct keyword from ({CLEAN_SQL})), {_intent_sql('kw', 'keyword', [])}
select keyword, intent, round(confidence, 6) as confidence, {_flags_sql()} as modifiers from classified""",
)
def _(spark, sf):
    df = intent.classify_keywords(clean_keywords(spark, sf)).withColumn("modifiers", F.array_join("modifiers", ","))
    return rounded(df, "confidence")


VOTES = f"""kw as ({CLEAN_SQL}), dk as (select cluster_id, keyword, min(row_id) as first, count(*) as rows from kw
 where cluster_id >= 0 group by 1, 2), {_intent_sql('dk', 'keyword', [])}, tally as (select cluster_id, intent,
 count(*) as votes, min(first) as first from classified group by 1, 2), facts as (select cluster_id, sum(rows) as n,
 sum(confidence) as conf, {', '.join(f'bool_or(is_{m}) as is_{m}' for m in intent.MODIFIERS)} from classified group by 1),
 votes as (select cluster_id, intent, (votes / n + conf / n) / 2 as confidence, {_flags_sql()} as modifiers,
 'Based on ' || n || ' keywords' as explanation from tally join facts using (cluster_id)
 qualify row_number() over (partition by cluster_id order by votes desc, first) = 1)"""


@query("M5_cluster_vote", f"with {VOTES} select * replace (round(confidence, 9) as confidence) from votes")
def _(spark, sf):
    df = intent.vote_clusters(clean_keywords(spark, sf)).withColumn("modifiers", F.array_join("modifiers", ","))
    return rounded(df, "confidence", digits=9)


_RESPONSES = """case when cluster_id % 9 = 0 then null else case cluster_id % 8
 when 0 then '{"primary_intent": "TRANSACTIONAL", "confidence": 0.9, "modifiers": ["local"], "explanation": "c' || cluster_id || '"}'
 when 1 then '{"primary_intent": "Commercial"}' when 2 then 'Sorry, no answer for ' || cluster_id
 when 3 then '{"primary_intent": "shopping", "confidence": 0.4}' when 4 then '[{"primary_intent": "commercial"}]'
 when 5 then '{"confidence": 0.25}' when 6 then ' {"primary_intent": "Navigational", "explanation": "x"} '
 else '{"primary_intent": "COMMERCIAL", ' end end"""


@query(
    "M6_model_intents",
    f"""with {VOTES}, r as (select cluster_id, {_RESPONSES} as response from votes),
 p as (select cluster_id, lower(coalesce(json_extract_string(trim(response), '$.primary_intent'), 'unknown')) as i,
 coalesce(json_extract_string(trim(response), '$.confidence')::double, 0.8) as f,
 array_to_string(from_json(coalesce(json_extract(trim(response), '$.modifiers'), '[]'), '["VARCHAR"]'), ',') as m,
 coalesce(json_extract_string(trim(response), '$.explanation'), '') as e
 from (select * from r where json_valid(trim(response))) where json_type(trim(response)) = 'OBJECT'),
 u as (select * from p where i in ('informational', 'transactional', 'navigational', 'commercial', 'unknown'))
select cluster_id, coalesce(i, intent) as intent, round(coalesce(f, confidence), 9) as confidence,
 case when i is null then modifiers else m end as modifiers, coalesce(e, explanation) as explanation,
 i is not null as from_model from votes left join u using (cluster_id)""",
)
def _(spark, sf):
    votes = intent.vote_clusters(clean_keywords(spark, sf))
    responses = votes.select("cluster_id", F.expr(_RESPONSES).alias("response"))
    df = intent.intents_from_responses(responses, votes).withColumn("modifiers", F.array_join("modifiers", ","))
    return rounded(df, "confidence", digits=9)


def _capital_sql(word_list: str, n: int) -> str:
    return (
        f"array_to_string(list_transform(({word_list})[1:{n}], lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    )


def _members_sql(source: str, limit: int | None) -> str:
    """All members with their position, or the first `limit` of each cluster."""
    if not limit:
        return f"select *, row_id as position from {source} where cluster_id >= 0"
    return f"""select *, row_number() over (partition by cluster_id order by row_id) as position from {source}
 where cluster_id >= 0 qualify position <= {limit}"""


def _theme_sql(source: str, limit: int | None = None) -> str:
    """CTE `themes` over `source` (cluster_id, row_id, keyword)."""
    stop = ", ".join(f"'{w}'" for w in labels.STOP_WORDS)
    return f"""f50 as ({_members_sql(source, limit)}), toks as (select cluster_id, position,
 unnest(regexp_extract_all(lower(keyword), '{WORD}+')) as word,
 generate_subscripts(regexp_extract_all(lower(keyword), '{WORD}+'), 1) as pos from f50),
 cnt as (select cluster_id, word, count(*) as n, min((position, pos)) as first from toks
 where regexp_matches(word, '^[a-z]{{3,}}$') and word not in ({stop}) group by 1, 2), themes as (select cluster_id,
 string_agg(upper(word[1]) || word[2:], ' ' order by r) as theme from (select *, row_number() over
 (partition by cluster_id order by n desc, first) as r from cnt) where r <= 2 group by 1)"""


def _phrase_sql(source: str, limit: int | None = None) -> str:
    """CTE `phrases` over `source` (cluster_id, row_id, keyword)."""
    return f"""f20 as (select cluster_id, position, {words_sql('lower(keyword)')} as w
 from ({_members_sql(source, limit)})),
 grams as (select cluster_id, position, list_concat(
 list_transform(range(1, greatest(len(w), 1)), lambda k: array_to_string(w[k:k + 1], ' ')),
 list_transform(range(1, greatest(len(w) - 1, 1)), lambda k: array_to_string(w[k:k + 2], ' '))) as g from f20),
 spread as (select cluster_id, position, unnest(g) as phrase, generate_subscripts(g, 1) as pos from grams),
 phrases as (select cluster_id, phrase, count(*) as n from spread group by 1, 2
 qualify row_number() over (partition by cluster_id order by n desc, min((position, pos))) = 1 and n >= 3)"""


# Themes and phrases over documents grouped by language and source: mixed scripts and long texts.
_DOC_GROUPS = "docs as (select hash_id as cluster_id, doc_id as row_id, text as keyword from (select *, " + (
    "ascii(lang) * 1000 + length(source) * 10 + doc_id % 5 as hash_id from documents))"
)


def doc_groups(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "ascii(lang) * 1000 + length(source) * 10 + doc_id % 5 as cluster_id", "doc_id as row_id", "text as keyword"
    )


@query("N1_theme_of_documents", f"with {_DOC_GROUPS}, {_theme_sql('docs')} select cluster_id, theme from themes")
def _(spark, sf):
    return labels.themes(doc_groups(spark, sf))


@query("N1_theme", f"with kw as ({CLEAN_SQL}), {_theme_sql('kw')} select cluster_id, theme from themes")
def _(spark, sf):
    return labels.themes(clean_keywords(spark, sf))


@query(
    "N1_theme_first_members",
    f"with {_DOC_GROUPS}, {_theme_sql('docs', 50)} select cluster_id, theme from themes",
)
def _(spark, sf):
    return labels.themes(doc_groups(spark, sf), limit=50)


@query(
    "N2_common_phrase_first_members",
    f"with {_DOC_GROUPS}, {_phrase_sql('docs', 20)} select cluster_id, phrase from phrases",
)
def _(spark, sf):
    return labels.common_phrases(doc_groups(spark, sf), limit=20)


@query("N2_common_phrase", f"with kw as ({CLEAN_SQL}), {_phrase_sql('kw')} select cluster_id, phrase from phrases")
def _(spark, sf):
    return labels.common_phrases(clean_keywords(spark, sf))


@query(
    "N2_common_phrase_of_documents",
    f"with {_DOC_GROUPS}, {_phrase_sql('docs')} select cluster_id, phrase from phrases",
)
def _(spark, sf):
    return labels.common_phrases(doc_groups(spark, sf))


ANALYSES = f"""{VOTES}, {_theme_sql('kw')}, {_phrase_sql('kw')}, top as ({TOP_SQL}), tops as (select cluster_id,
 list(keyword order by rank)[1:5] as top_keywords from top group by 1), sizes as (select cluster_id,
 count(*) as keyword_count, arg_min(keyword, row_id) as first_keyword from kw where cluster_id >= 0 group by 1),
 analyses as (select cluster_id, keyword_count, first_keyword, votes.intent, votes.confidence, top_keywords,
 coalesce(theme, {_capital_sql(words_sql('top_keywords[1]'), 3)}) as theme, phrase from sizes join votes using (cluster_id)
 join tops using (cluster_id) left join themes using (cluster_id) left join phrases using (cluster_id))"""


def analyses(spark, sf):
    return labels.analyze_clusters(clean_keywords(spark, sf))


@query(
    "N3_cluster_analysis",
    f"""with {ANALYSES} select cluster_id, keyword_count, first_keyword, intent, round(confidence, 9) as confidence,
 array_to_string(top_keywords, '|') as top_keywords, theme, phrase from analyses""",
)
def _(spark, sf):
    df = rounded(analyses(spark, sf), "confidence", digits=9).withColumn("top_keywords", F.array_join("top_keywords", "|"))
    return df.select(
        "cluster_id", "keyword_count", "first_keyword", "intent", "confidence", "top_keywords", "theme", "phrase"
    )


def _bullets_sql(n: int) -> str:
    return f"array_to_string(list_transform(listed[1:{n}], lambda k: '- ' || k), chr(10))"


_LISTED = "listed as (select cluster_id, list(keyword order by row_id) as listed from kw where cluster_id >= 0 group by 1)"


@query(
    "N4_label_prompts",
    f"""with {ANALYSES}, e as (select cluster_id, 'Cluster ' || cluster_id || ' (' || keyword_count || ' keywords):' || chr(10)
 || '  Intent: ' || intent || chr(10) || '  Theme: ' || coalesce(theme, '') || chr(10) || '  Sample: '
 || array_to_string(top_keywords, ', ') as entry from analyses)
select cast(floor(cluster_id / 50) as bigint) as batch,
 'Give each keyword cluster a unique, descriptive topic label of two to four words in title case.' || chr(10) || chr(10)
 || 'CLUSTERS:' || chr(10) || string_agg(entry, chr(10) order by cluster_id) || chr(10) || chr(10)
 || 'Answer as JSON: {{"labels": [{{"cluster_id": 0, "label": "Topic Name"}}]}}' as prompt from e group by 1""",
)
def _(spark, sf):
    return labels.label_prompts(analyses(spark, sf))


@query(
    "N4_consistent_label_prompts",
    f"""with {ANALYSES} select cast(floor(cluster_id / 50) as bigint) as batch,
 'Label these keyword clusters with mutually exclusive noun phrases of two to five words.' || chr(10) || chr(10)
 || 'SUMMARIES:' || chr(10) || string_agg('Cluster ' || cluster_id || ':' || chr(10) || coalesce(theme, ''),
 chr(10) || chr(10) order by cluster_id) || chr(10) || chr(10)
 || 'Answer as JSON: {{"labels": [{{"cluster_id": 0, "label": "Topic Name", "confidence": 0.9}}]}}' as prompt
from analyses group by 1""",
)
def _(spark, sf):
    summaries = analyses(spark, sf).select("cluster_id", F.coalesce("theme", F.lit("")).alias("summary"))
    return labels.consistent_label_prompts(summaries)


@query(
    "N4_summary_prompts",
    f"""with {ANALYSES}, {_LISTED} select cluster_id,
 'Summarise this keyword cluster in one or two sentences.' || chr(10) || chr(10) || 'Keywords:' || chr(10)
 || {_bullets_sql(20)} || chr(10) || chr(10) || 'Intent: ' || intent || chr(10) || 'Top keywords: '
 || array_to_string(top_keywords, ', ') || chr(10) || chr(10) || 'Summary:' as prompt
from analyses join listed using (cluster_id)""",
)
def _(spark, sf):
    return labels.summary_prompts(clean_keywords(spark, sf), analyses(spark, sf))


@query(
    "N4_intent_prompts",
    f"""with kw as ({CLEAN_SQL}), {_LISTED} select cluster_id, 'Name the search intent of these keywords (informational, '
 || 'transactional, navigational or commercial) and any modifiers.' || chr(10) || chr(10) || 'Keywords:' || chr(10)
 || {_bullets_sql(30)} || chr(10) || chr(10)
 || 'Answer as JSON with primary_intent, confidence, modifiers and explanation:' as prompt from listed""",
)
def _(spark, sf):
    return labels.intent_prompts(clean_keywords(spark, sf))


@query(
    "N4_description_prompts",
    f"""with {REPORT_SQL}, {_LISTED} select cluster_id, 'Describe this keyword cluster in two or three sentences.'
 || chr(10) || chr(10) || 'Label: ' || label || chr(10) || 'Keywords (' || size || '):' || chr(10) || {_bullets_sql(15)}
 || chr(10) || 'Volume: ' || format('{{:,}}', total_volume) || chr(10) || 'Difficulty: ' || printf('%.1f', avg_difficulty)
 || chr(10) || 'Intent: ' || intent || chr(10) || chr(10) || 'Description:' as prompt
from report join listed on id = cluster_id""",
)
def _(spark, sf):
    return labels.description_prompts(report(spark, sf), clean_keywords(spark, sf))


# One answer per brand over its six clusters, in the seven shapes an answer can take.
_PIECE = """case cluster_id % 6 when 4 then 'Group 4' when 3 then 'ab' when 2 then ' "Quoted ' || cluster_id || '" '
 else 'Topic ' || grp end"""
_SHAPES = {
    0: ("'{\"labels\": ['", "'{\"cluster_id\": ' || cluster_id || ', \"label\": \"' || replace(label, '\"', '\\\"') || '\"}'", "', '", "']}'"),
    1: ("'Sure! {\"labels\": ['", "'{\"cluster_id\": \"' || cluster_id || '\", \"label\": \"' || replace(label, '\"', '') || '\"}'", "', '", "']} Done.'"),
    2: ("'Labels: ['", "'{\"cluster_id\": ' || cluster_id || ', \"label\": \"' || replace(label, '\"', '') || '\"}'", "', '", "'] end'"),
    3: ("'Here you go'||chr(10)", "'Cluster ' || cluster_id || ': ' || label", "chr(10)", "''"),
    4: ("''", "cluster_id || '. ' || label", "chr(10)", "''"),
    5: ("'['", "'{\"cluster_id\": ' || cluster_id || ', \"label\": \"' || replace(label, '\"', '') || '\"}'", "', '", "']'"),
    6: ("'I cannot label '", "'no idea'", "'; '", "'!'"),
}
_CHOOSE = {
    part: "case brand % 7 " + " ".join(f"when {k} then {v[i]}" for k, v in _SHAPES.items()) + " end"
    for i, part in enumerate(("open", "piece", "sep", "close"))
}


def label_responses(spark, sf):
    rows = (
        table(spark, sf, "part")
        .selectExpr("p_brand||'|'||p_type as grp", "cast(substr(p_brand, 7) as int) as brand", "p_type")
        .distinct()
        .withColumn("cluster_id", F.expr("(brand - 1) * 6 + case p_type when 'ECONOMY' then 0 when 'LARGE' then 1 "
                                         "when 'MEDIUM' then 2 when 'PROMO' then 3 when 'SMALL' then 4 else 5 end"))
        .withColumn("label", F.expr(_PIECE))
    )
    pieces = rows.select("brand", "cluster_id", F.expr(_CHOOSE["piece"].replace("'\\\"'", "'\\\\\"'")).alias("piece"))
    joined = pieces.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "piece"))).alias("ps"))
    text = f"{_CHOOSE['open']} || array_join(ps.piece, {_CHOOSE['sep']}) || {_CHOOSE['close']}"
    return joined.select(F.col("brand").alias("response_id"), F.expr(text).alias("response"))


_PARSED_SQL = f"""rows as (select distinct p_brand||'|'||p_type as grp, cast(substr(p_brand, 7) as int) as brand,
 (cast(substr(p_brand, 7) as int) - 1) * 6 + case p_type when 'ECONOMY' then 0 when 'LARGE' then 1 when 'MEDIUM' then 2
 when 'PROMO' then 3 when 'SMALL' then 4 else 5 end as cluster_id from part),
 expected as (select cluster_id::bigint as cluster_id, case cluster_id % 6 when 2 then 'Quoted ' || cluster_id
 else 'Topic ' || grp end as label, brand % 7 as shape from rows where cluster_id % 6 not in (3, 4) and brand % 7 < 5)"""


@query("N5_parse_label_responses", f"with {_PARSED_SQL} select cluster_id, label from expected")
def _(spark, sf):
    return parse_labels(label_responses(spark, sf))


@query("N5_parse_label_responses_strict", f"with {_PARSED_SQL} select cluster_id, label from expected where shape <> 1")
def _(spark, sf):
    return parse_labels(label_responses(spark, sf), strict_ids=True)


_LABELS_FX = """case p_partkey % 9 when 0 then 'Cluster ' || p_partkey when 1 then 'misc ' || p_name when 2 then
 'Other things' when 3 then p_size || ' keywords' when 4 then 'category' when 5 then 'Cluster of ' || p_size || ' items'
 when 6 then 'Grouping' when 7 then p_name || ' Topics' else ' GROUP 12 ' end"""
_GENERIC_SQL = "(" + " or ".join(f"regexp_matches(lower(trim(label)), '{p}')" for p in labels.GENERIC) + ")"


@query(
    "N6_generic_labels",
    f"with l as (select p_partkey, {_LABELS_FX} as label from part) select p_partkey, label, {_GENERIC_SQL} as generic from l",
)
def _(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_LABELS_FX).alias("label"))
    return rows.withColumn("generic", labels.is_generic(F.col("label")))


_CANDIDATES = f"""{ANALYSES}, cand as (select cluster_id, list_concat(
 case when length(theme) > 2 then [trim(theme)] else [] end,
 list_transform(list_filter(top_keywords, lambda k: len({words_sql('k')}) between 3 and 5),
  lambda k: {_capital_sql(words_sql('k'), 4)}),
 case when phrase is not null then [{_capital_sql(words_sql('phrase'), 4)}] else [] end,
 [{_capital_sql(words_sql('top_keywords[1]'), 4)}]) as cands,
 case when length(theme) > 0 then theme || ' Topics' else {_capital_sql(words_sql('first_keyword'), 3)} end as term,
 row_number() over (order by cluster_id) as turn from analyses)"""

_CHOSEN = """picks(turn, cluster_id, label, used) as (select 0::bigint, -1::bigint, '', []::varchar[] union all
 select turn, cluster_id, label, list_append(used, lower(label)) from (select cand.turn, cand.cluster_id::bigint as cluster_id,
 picks.used, coalesce(list_filter(cands, lambda k: not list_contains(picks.used, lower(k)))[1], list_filter(
 list_transform(range(1, 2000), lambda s: case when s = 1 then term else term || ' ' || s end),
 lambda k: not list_contains(picks.used, lower(k)))[1]) as label from picks join cand on cand.turn = picks.turn + 1))"""


@query(
    "N7_fallback_labels",
    f"with recursive {_CANDIDATES}, {_CHOSEN} select cluster_id, label from picks where turn > 0",
)
def _(spark, sf):
    return choose_labels(labels.label_candidates(analyses(spark, sf)))


_MODEL = """select cluster_id, case when cluster_id % 10 = 0 then 'Cluster 7' when cluster_id % 5 = 0 then 'Model ' || intent
 end as label from {}"""


@query(
    "N9_labels_with_model",
    f"""with recursive {_CANDIDATES.replace('cand as (', 'cand0 as (', 1)}, m as ({_MODEL.format('analyses')}),
 cand as (select cand0.cluster_id, turn, case when m.label like 'Model%' then [] else cands end as cands,
 case when m.label like 'Model%' then m.label else term end as term from cand0 left join m using (cluster_id)), {_CHOSEN}
select picks.cluster_id, picks.label, case when m.label is null then 0.7 else 0.9 end::double as confidence
from picks left join m on m.cluster_id = picks.cluster_id where turn > 0""",
)
def _(spark, sf):
    facts = analyses(spark, sf)
    named = F.when(F.col("cluster_id") % 5 == 0, F.concat(F.lit("Model "), "intent"))
    model = facts.select("cluster_id", F.when(F.col("cluster_id") % 10 == 0, "Cluster 7").otherwise(named).alias("label"))
    choices = labels.with_model_labels(labels.label_candidates(facts), model)
    confidence = choices.select("cluster_id", labels.label_confidence(F.col("from_model")).alias("confidence"))
    return choose_labels(choices).join(confidence, "cluster_id")


_SUFFIXED = """select label_id as cluster_id, case when r = 1 then label else label || ' ' || r end as label from (select
 p_partkey as label_id, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as label,
 row_number() over (partition by lower(p_name) order by p_partkey) as r from part)"""


@query("N8_unique_suffixes", _SUFFIXED)
def _(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey as cluster_id", "case when p_partkey % 2 = 0 then upper(p_name) else p_name end as label"
    )
    return unique_labels(rows)


@query(
    "N10_consistency",
    f"""with l as (select p_partkey, {_LABELS_FX} as label from part) select round(count(distinct label) / count(*) * 0.4
 + (1 - count(*) filter ({_GENERIC_SQL}) / count(*)) * 0.4
 + greatest(0, 1 - var_pop(len({words_sql('label')})) / 10) * 0.2, 6) as consistency_score from l""",
)
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.expr(_LABELS_FX).alias("label"))
    return rounded(labels.consistency_score(rows), "consistency_score")


@query(
    "N11_descriptions",
    f"""with {VOTES}, s as (select cluster_id, count(*) as n from kw group by 1) select cluster_id,
 upper(intent[1]) || intent[2:] || ' content cluster with ' || n || ' keywords.' as description
from votes join s using (cluster_id)""",
)
def _(spark, sf):
    members = clean_keywords(spark, sf)
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    joined = intent.vote_clusters(members).join(sizes, "cluster_id")
    return joined.select("cluster_id", labels.description(F.col("intent"), F.col("n")).alias("description"))


@query(
    "N12_label_lookup",
    f"""with kw as ({CLEAN_SQL}), {_theme_sql('kw')} select distinct kw.cluster_id, coalesce(case when kw.cluster_id % 2 = 0
 then theme end, 'Cluster ' || kw.cluster_id) as label from kw left join themes using (cluster_id) where kw.cluster_id >= 0""",
)
def _(spark, sf):
    members = clean_keywords(spark, sf)
    ids = members.filter("cluster_id >= 0").select("cluster_id").distinct()
    known = F.when(F.col("cluster_id") % 2 == 0, F.col("theme"))
    return ids.join(labels.themes(members), "cluster_id", "left").select(
        "cluster_id", default_label(known, F.col("cluster_id")).alias("label")
    )
