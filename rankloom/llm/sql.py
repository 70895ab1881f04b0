"""SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

TOKEN = r"[a-z0-9_][a-z0-9_./:+#-]*|[\x{4e00}-\x{9fff}]"


def _count(text: str) -> str:
    return f"coalesce(len(regexp_extract_all(lower({text}), '{TOKEN}')), 0)"


FUSED = """
best as (select run_id, qid, route, doc_id, max(score) as score from hits where score is not null and not isnan(score) and doc_id is not null group by all),
ranks as (select *, rank() over (partition by run_id, qid, route order by score desc) as r from best),
fused as (select run_id, qid, doc_id, round(sum(1e0 / (6e1 + r)), 12) as fused from ranks group by all)"""

# The names a language label may have.
NAMES = "map {'eng': 'en', 'english': 'en', 'deu': 'de', 'ger': 'de', 'german': 'de', 'fra': 'fr', 'fre': 'fr', 'french': 'fr', 'spa': 'es', 'spanish': 'es', 'por': 'pt', 'portuguese': 'pt', 'zho': 'zh', 'chi': 'zh', 'chinese': 'zh'}"


def _language(label: str) -> str:
    stems = f"list_transform(regexp_split_to_array(lower(coalesce({label}, '')), '[,;/+&|\\s]+'), lambda p: regexp_extract(p, '^([^_\\-]*)', 1))"
    known = f"list_transform({stems}, lambda p: coalesce({NAMES}[p], p))"
    stated = f"list_sort(list_distinct(list_filter({known}, lambda p: p not in ('', 'und', 'unknown', 'xx'))))"
    return f"nullif(array_to_string({stated}, '+'), '')"


def _budget(corpus: str, rows: str) -> str:
    return f"""
select '{corpus}' as corpus, level, source, language, domain, documents, cast(tokens as bigint) as tokens from (
  with s as ({rows})
  select 'slice' as level, source, language, domain, count(*) as documents, sum(tokens) as tokens from s group by all
  union all select 'total', null, null, null, count(*), coalesce(sum(tokens), 0) from s
  union all select 'unlabelled', null, null, null, count(*), coalesce(sum(tokens), 0) from s where source is null or language is null or domain is null
)"""


BUDGET = (
    _budget(
        "docs",
        f"""select replace(lower(nullif(trim(source_type), '')), ' ', '_') as source, {_language('lang')} as language, nullif(trim(source_dataset), '') as domain, {_count('text')} as tokens
  from docs where doc_id is not null qualify row_number() over (partition by doc_id order by line_no desc) = 1""",
    )
    + " union all "
    + _budget("documents", f"select lower(nullif(trim(source), '')) as source, {_language('lang')} as language, lower(nullif(trim(domain), '')) as domain, {_count('text')} as tokens from documents where doc_id is not null")
)

_DOCS = BUDGET[: BUDGET.index(" union all \nselect 'documents'")]
REMOVED = "select level, source, language, domain, documents, tokens from (" + _DOCS.replace("where doc_id is not null", "where doc_id is not null and lower(trim(doc_id)) not in (select lower(trim(doc_id)) from doc_tombstones where trim(doc_id) <> '')") + ")"

SHORT = f"""
with sized as (select lower(trim(source)) as k, {_count('text')} as n from documents where trim(source) <> ''),
per as (select k, sum(n) as n from sized group by 1), every as (select coalesce(sum(n), 0) as n from sized)
select plan_id, m.source from mix_targets m left join per on lower(trim(m.source)) = per.k, every
where target_share * size_factor * cast(every.n as double) > max_repeats * cast(coalesce(per.n, 0) as double)"""


# The whole draw: Poisson means by bisection, thresholds, and a number from an MD5 for each plan and document.
COPIES = f"""
with recursive sized as (select doc_id, lower(trim(source)) as k, {_count('text')} as tokens from documents where trim(source) <> ''),
per as (select k, sum(tokens) as n from sized group by 1), every as (select coalesce(sum(tokens), 0) as n from sized),
plan as (
  select plan_id, m.source, lower(trim(m.source)) as k, target_share, max_repeats, target_share * size_factor * cast(every.n as double) as needed_tokens, cast(coalesce(per.n, 0) as bigint) as source_tokens
  from mix_targets m left join per on lower(trim(m.source)) = per.k, every
), rates as (
  select plan_id, source, max_repeats as m, case when source_tokens > 0 then needed_tokens / source_tokens else 0e0 end as rate from plan
), halves as (
  select plan_id, source, m, rate, rate as low, 64e0 * (m + 1) as high, 0 as step from rates where rate > 0 and rate < m
  union all
  select plan_id, source, m, rate, case when mean < rate then mid else low end, case when mean < rate then high else mid end, step + 1 from (
    select *, (low + high) / 2 as mid, m - list_sum(list_transform(range(m), lambda j: (m - j) * exp(j * ln((low + high) / 2) - (low + high) / 2 - lgamma(j + 1)))) as mean from halves where step < 80)
), lambdas as (select plan_id, source, high as lam from halves where step = 80),
limits as (
  select r.plan_id, r.source, lower(trim(r.source)) as k, case when rate >= m and m > 0 then list_transform(range(m), lambda j: 0e0)
    when rate > 0 and m > 0 then list_transform(range(m), lambda j: list_sum(list_transform(range(j + 1), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1)))))
    else list_transform(range(m), lambda j: 1e0) end as steps
  from rates r left join lambdas using (plan_id, source)
), copies as (
  select plan_id, source, doc_id, tokens,
    len(list_filter(steps, lambda x: x <= cast(('0x' || substr(md5('0:' || plan_id || ':' || doc_id), 1, 13)) as bigint) / 4503599627370496e0)) as copies
  from sized join limits using (k)
), used as (select * from copies where copies > 0)"""

MIXED = f"""{COPIES},
got as (
  select plan_id, source, count(*) as documents_used, sum(copies) as copies, sum(tokens * copies) as tokens_reached, max(copies) as most_copies from used group by all
), whole as (select plan_id, sum(tokens_reached) as n from got group by 1)
select p.plan_id, p.source, target_share, max_repeats, needed_tokens, source_tokens, needed_tokens > cast(max_repeats * source_tokens as double) as short,
  cast(coalesce(documents_used, 0) as bigint) as documents_used, cast(coalesce(copies, 0) as bigint) as copies, cast(coalesce(most_copies, 0) as bigint) as most_copies,
  cast(coalesce(tokens_reached, 0) as bigint) as tokens_reached, coalesce(cast(tokens_reached as double) / cast(n as double), 0e0) as actual_share
from plan p left join got using (plan_id, source) left join whole using (plan_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {FUSED} select run_id, qid, doc_id from fused qualify row_number() over (partition by run_id, qid order by fused desc, doc_id) = 1",
        "p1_ranking": f"with {FUSED}, placed as (select *, row_number() over (partition by run_id, qid order by fused desc, doc_id) as rank from fused) select run_id, qid, doc_id, fused, rank from placed where rank <= 10",
        "p2_token_budget": BUDGET,
        "p2_after_removals": REMOVED,
        "p6_found": """select run_id, qid, route, doc_id, chunk_id from (
  select run_id, qid, route, doc_id, chunk_id, max(score) as score from hits where score is not null and not isnan(score) group by all)
qualify row_number() over (partition by run_id, qid, route order by score desc, doc_id nulls first, chunk_id nulls first) <= 5""",
        "p8_found": f"select distinct doc_id from documents where {_count('text')} > 512",
        "p9_found": SHORT,
        "p9_report": MIXED,
    }
