"""The core's queries as SQL over the same tables, for an engine of another make."""

from __future__ import annotations

from rankloom.functions.analysis import STANDARD_PATTERN
from rankloom.functions.text import STOPWORDS

TOKEN = r"[a-z0-9_][a-z0-9_./:+#-]*|[\x{4e00}-\x{9fff}]"
TENANT = "tenant_redline"


def _clean(text: str) -> str:
    spaces = f"regexp_replace(regexp_replace(regexp_replace(coalesce({text}, ''), '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({spaces}, '\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g')"


def _collapse(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g')"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


def _terms(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{STANDARD_PATTERN.replace(chr(39), chr(39) * 2)}')"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _keywords(text: str) -> str:
    plain = _collapse(f"coalesce({text}, '')")
    kept = f"list_filter({_tokens(plain)}, lambda t: not list_contains({_STOP}, t) and (length(t) > 1 or regexp_full_match(t, '[0-9\\x{{4e00}}-\\x{{9fff}}]')))"
    return f"case when len({kept}) > 0 then array_to_string({kept}, ' ') else {plain} end"


def _variant(original: str, rewritten: str) -> str:
    return f"coalesce({original} is not null and trim({rewritten}) <> '' and lower({_collapse(original)}) <> lower({rewritten}), false)"


# One row per question id; the last asked counts.
ASKED = """
ordered_q as (
  select *, row_number() over (partition by id order by asked_at desc nulls last) as rn from questions where id is not null
), asked as (
  select id as qid, coalesce(question, '') as question, coalesce(question_type, 'unknown') as question_type,
    list_filter(list_transform(coalesce(source_types, []), lambda s: trim(s)), lambda s: s is not null and s <> '') as scope,
    list_filter(list_transform(coalesce(expected_doc_ids, []), lambda s: lower(trim(s))), lambda s: s is not null and s <> '') as expected
  from ordered_q where rn = 1
)"""

CHUNKS = """
ordered_c as (
  select *, row_number() over (partition by chunk_key order by indexedAt desc nulls last) as rn from chunks where chunk_key is not null
), chunk as (
  select chunk_key, benchmarkDocId as doc_id, coalesce(title, '') as title, coalesce(textContent, '') as text, coalesce(tenantId, '') as tenant,
    coalesce(sourceType, 'unknown') as source, coalesce(allowedGroupIds, []) as allowed, coalesce(deniedGroupIds, []) as denied, vector
  from ordered_c where rn = 1
)"""

DOCS = """
ordered_d as (select *, row_number() over (partition by doc_id order by line_no desc nulls last) as rn from docs where doc_id is not null),
doc as (select doc_id, title, text, source_path, source_dataset, source_type from ordered_d where rn = 1)"""

ACL = """
ordered_a as (
  select *, lower(trim(doc_id)) as k, row_number() over (partition by lower(trim(doc_id)) order by line_no desc nulls last) as rn from acl_docs where trim(doc_id) <> ''
), acl as (
  select k, coalesce(tenant_id, '') as tenant_id, coalesce(classification, '') as classification, coalesce(allowed_group_ids, []) as allowed,
    coalesce(denied_group_ids, []) as denied from ordered_a where rn = 1
)"""


def _visible(scope: str) -> str:
    labels = f"list_transform({scope}, lambda s: 'source:' || s)"
    return (
        f"(len({scope}) = 0 or (c.tenant = '{TENANT}' and list_contains({scope}, c.source) and list_has_any(c.allowed, {labels}) and not list_has_any(c.denied, {labels})))"
    )


def _cuts(source: str, size: int, overlap: int) -> str:
    """Chunks of (doc_id, cleaned) rows by a recursive walk; separators as the definition lists them."""
    seps = ["chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '", "'; '", "', '", "' '"]
    w = f"substr(cleaned, s + 1, {size})"
    last = ", ".join(f"case when position(reverse({x}) in reverse({w})) = 0 then -1 else length({w}) - position(reverse({x}) in reverse({w})) - length({x}) + 1 end" for x in seps)
    step = f"case when s + {size} >= length(cleaned) then length(cleaned) when greatest({last}) >= {int(size * 0.6)} then s + greatest({last}) + 1 else s + {size} end"
    blank = "'\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z'"
    return f"""
starts as (select doc_id, cleaned, 0 as s from ({source}) where cleaned <> ''),
walk as (
  select doc_id, cleaned, s, {step} as e from starts
  union all
  select doc_id, cleaned, s, {step} as e from (select doc_id, cleaned, e - {overlap} as s from walk where e < length(cleaned))
), pieces as (select doc_id, s, regexp_replace(substr(cleaned, s + 1, e - s), {blank}, '', 'g') as text_content from walk),
cut as (
  select doc_id, cast(row_number() over (partition by doc_id order by s) as integer) as chunk_id, text_content from pieces where text_content <> ''
)"""


def _bm25(keyword: bool = False, scoped: bool = True, k: int = 10) -> str:
    question = _keywords("question") if keyword else "question"
    only = f"where {_variant('question', question)}" if keyword else ""
    scope = "a.scope" if scoped else "[]"
    return f"""
with {ASKED}, {CHUNKS}, asked2 as (select qid, scope, {question} as question from asked {only}),
qt as (select qid, term, count(*) as qtf from (select qid, unnest({_terms('question')}) as term from asked2) group by all),
tokens as (
  select chunk_key, 'title' as field, unnest({_terms('title')}) as term from chunk union all
  select chunk_key, 'text', unnest({_terms('text')}) from chunk
), tf as (select chunk_key, field, term, count(*) as tf from tokens group by all),
len as (select chunk_key, field, sum(tf) as len from tf group by all),
stats as (select field, count(*) as n, avg(len) as mean from len group by all),
df as (select field, term, count(*) as df from tf group by all),
part as (
  select qid, tf.chunk_key, tf.field,
    sum(qtf * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * 32e-1 * tf / (tf + 22e-1 * len / mean)) as s
  from qt join tf using (term) join len using (chunk_key, field) join stats using (field) join df using (field, term) group by all
), best as (select qid, chunk_key, round(max(case field when 'title' then 2e0 else 1e0 end * s), 6) as score from part group by all),
seen as (
  select best.qid, c.doc_id, best.chunk_key, best.score from best join chunk c using (chunk_key) join asked2 a on a.qid = best.qid
  where c.doc_id is not null and score > 0 and {_visible(scope)}
), one as (select * from seen qualify row_number() over (partition by qid, doc_id order by score desc, chunk_key) = 1),
ranked as (select *, row_number() over (partition by qid order by score desc, doc_id, chunk_key) as rank from one)
select qid, rank, doc_id, chunk_key, score from ranked where rank <= {k}
"""


def _dense(scoped: bool) -> str:
    scope = "[q.source]" if scoped else "[]"
    return f"""
with {CHUNKS}, good as (
  select * from chunk where vector is not null and len(list_filter(vector, lambda x: x is null)) = 0
    and len(list_filter(vector, lambda x: x <> 0)) > 0
), probe as (select distinct chunk_key from vector_probes),
pairs as (
  select q.chunk_key as qid, c.doc_id, c.chunk_key, round(list_cosine_similarity(cast(q.vector as double[]), cast(c.vector as double[])), 6) as score
  from good q join probe using (chunk_key), good c
  where len(q.vector) = len(c.vector) and c.doc_id is not null and {_visible(scope)}
), near as (select * from pairs qualify row_number() over (partition by qid order by score desc, doc_id, chunk_key) <= 500),
one as (select * from near qualify row_number() over (partition by qid, doc_id order by score desc, chunk_key) = 1),
ranked as (select *, row_number() over (partition by qid order by score desc, doc_id, chunk_key) as rank from one)
select qid, rank, doc_id, chunk_key, score from ranked where rank <= 10
"""


ROUTES = """
best_h as (
  select run_id || '/' || qid as qid, route, route_ord, doc_id, chunk_id, score from hits where score is not null and not isnan(score)
  qualify row_number() over (partition by run_id, qid, route, route_ord, doc_id order by score desc, chunk_id) = 1
), route_hits as (
  select *, doc_id || ':' || printf('%05d', chunk_id) as chunk_key, row_number() over (partition by qid, route order by score desc, doc_id) as rank from best_h
  qualify rank <= 50
)"""


def _fused(where: str, weight: str, k: int, limit: int) -> str:
    return f"""
with {ROUTES}, parts as (select *, ({weight}) / ({k}e0 + rank) as part from route_hits where {where} and trim(doc_id) <> ''),
sums as (
  select qid, doc_id, round(sum(part), 9) as score, min(row(route_ord, rank)) as first, min_by(chunk_key, row(route_ord, rank)) as chunk_key,
    min_by(score, row(route_ord, rank)) as own from parts group by all
), fused as (select *, row_number() over (partition by qid order by score desc, first) as rank from sums)
select qid, rank, doc_id, chunk_key, score from fused where rank <= {limit}
"""


FOUR = "case route when 'dense' then 75e-2 when 'bm25' then 5e-1 when 'keyword' then 125e-2 else 15e-1 end"

PER = """
per as (
  select j.qid, any_value(j.question_type) as question_type, any_value(j.scope) as scope, any_value(len(j.expected) > 0) as evaluable, any_value(latency_ms) as latency_ms,
    coalesce(min(r.rank) filter (list_contains(j.expected, r.doc_id)), -1) as first_rank,
    count(distinct r.doc_id) filter (r.rank <= 10 and list_contains(j.expected, r.doc_id)) = any_value(len(j.expected)) as complete,
    coalesce(bool_or(len(j.scope) > 0 and not coalesce(list_contains(j.scope, r.source_type), false)) filter (r.qid is not null), false) as violated,
    cast(coalesce(sum(r.tokens) filter (r.rank <= 10), 0) as bigint) as context_tokens
  from judged j left join ranked r on r.qid = j.qid group by j.qid
)"""

JUDGED = f"""
with fused_all as ({_fused('true', FOUR, 10, 50)}), {ASKED}, {CHUNKS},
runs as (
  select run_id || '/' || qid as run_qid, qid, max(epoch_us(received_at) - epoch_us(hit_at)) / 1000e0 as latency_ms from hits group by all
), judged as (
  select run_qid as qid, question_type, scope, list_distinct(expected) as expected, latency_ms from runs join asked using (qid)
), ranked as (
  select f.qid, f.rank, lower(trim(f.doc_id)) as doc_id, f.chunk_key, c.source as source_type,
    len(regexp_extract_all(lower(c.title || chr(10) || c.text), '{TOKEN}')) as tokens
  from fused_all f left join chunk c using (chunk_key)
), {PER}"""


def _letters(text: str) -> str:
    return f"list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: length(lower({text})) - length(replace(lower({text}), c, '')))"


# The docs table in two deliveries: of every chunk key the row of the later one.
INGESTED = f"""
with recursive half as (select floor((min(line_no) + max(line_no)) / 2) as h from docs),
given as (
  select case when line_no <= h then 1 else 2 end as part, docs.* from docs, half where doc_id is not null
  qualify row_number() over (partition by doc_id, line_no <= h order by line_no desc) = 1
), {ACL}, {_cuts("select part || ':' || doc_id as doc_id, " + _clean('text') + " as cleaned from given", 1200, 200)},
made as (
  select g.doc_id, g.doc_id || ':' || printf('%05d', chunk_id) as chunk_key, part, coalesce(source_type, 'unknown') as source_type, coalesce(title, '') || chr(10) || text_content as passage,
    sha256(text_content) as content_hash from cut c join given g on c.doc_id = part || ':' || g.doc_id
), last as (select * from made qualify row_number() over (partition by chunk_key order by part desc) = 1)
select chunk_key, doc_id, source_type, coalesce(tenant_id, '') as tenant_id, content_hash, sha256(array_to_string({_letters('passage')}, ',')) as vector_hash
from last left join acl on k = lower(trim(doc_id))"""


def _three_routes() -> str:
    """Letter vectors, BM25 and BM25 on keywords, fused by weights and measured."""
    dense = f"""
with {ASKED}, {CHUNKS}, v as (select *, cast({_letters("title || chr(10) || text")} as double[]) as w from chunk where doc_id is not null),
q as (select qid, scope, cast({_letters('question')} as double[]) as w from asked),
pairs as (
  select qid, c.doc_id, c.chunk_key, round(list_cosine_similarity(q.w, c.w), 6) as score from q, v c
  where list_sum(q.w) > 0 and list_sum(c.w) > 0 and {_visible('q.scope')}
), near as (select * from pairs qualify row_number() over (partition by qid order by score desc, doc_id, chunk_key) <= 500),
one as (select * from near qualify row_number() over (partition by qid, doc_id order by score desc, chunk_key) = 1)
select qid, row_number() over (partition by qid order by score desc, doc_id, chunk_key) as rank, doc_id, chunk_key, score from one qualify rank <= 50"""
    return f"""
with dense_r as ({dense}), bm25_r as ({_bm25(k=50)}), keyword_r as ({_bm25(keyword=True, k=50)}),
every as (
  select 0 as ord, 75e-2 as weight, * from dense_r union all by name select 1 as ord, 5e-1 as weight, * from bm25_r union all by name select 2 as ord, 125e-2 as weight, * from keyword_r
), single as (select qid, count(distinct ord) = 1 as single from every group by 1),
sums as (
  select qid, doc_id, round(sum(weight / (10e0 + rank)), 9) as score, min(row(ord, rank)) as first, min(rank) as rank1, min_by(chunk_key, row(ord, rank)) as chunk_key from every group by all
), fused as (
  select qid, doc_id, chunk_key, row_number() over (partition by qid order by case when single then rank1 end, score desc, first) as rank from sums join single using (qid)
), {ASKED}, {CHUNKS}, judged as (select qid, question_type, scope, list_distinct(expected) as expected, cast(null as double) as latency_ms from asked),
ranked as (
  select f.qid, f.rank, f.doc_id, c.source as source_type, len(regexp_extract_all(lower(c.title || chr(10) || c.text), '{TOKEN}')) as tokens
  from fused f join chunk c using (chunk_key) where f.rank <= 50
), {PER}
{_sliced()}"""


def _sliced() -> str:
    m = _measures()
    return f"""select 'overall' as slice_kind, 'all' as slice, {m} from per
union all select 'by_question_type', question_type, {m} from per group by 2
union all select 'by_source_type', slice, {m} from (select *, unnest(case when len(scope) > 0 then scope else ['unknown'] end) as slice from per) group by 2"""


def _measures() -> str:
    able = "nullif(count(*) filter (evaluable), 0)"
    hit = ", ".join(f"round(count(*) filter (evaluable and first_rank between 1 and {k}) / {able}, 6) as hit_at_{k}" for k in (1, 5, 10, 20))
    return f"""count(*) as questions_total, count(*) filter (evaluable) as questions_evaluable, {hit},
  round(sum(case when evaluable and first_rank between 1 and 10 then 1e0 / first_rank else 0e0 end) / {able}, 6) as mrr_at_10,
  round(count(*) filter (evaluable and first_rank between 1 and 10) / {able}, 6) as expected_doc_hit_at_10,
  round(count(*) filter (evaluable and complete) / {able}, 6) as all_expected_docs_hit_at_10, count(*) filter (not evaluable) as no_gold_doc_count,
  count(*) filter (violated) as source_filter_violation_count, round(coalesce(avg(latency_ms), 0e0), 6) as avg_latency_ms,
  coalesce(percentile_disc(0.95) within group (order by latency_ms), 0e0) as p95_latency_ms, round(coalesce(avg(context_tokens), 0e0), 6) as avg_context_tokens"""


P7_FOUND = """
with refs as (
  select 'questions' as ref_table, id as ref_id, lower(trim(e)) as doc_id, asked_at as ts
  from (select id, asked_at, unnest(expected_doc_ids) as e from questions)
  union all
  select 'acl_docs', cast(line_no as varchar), lower(trim(doc_id)), ingested_at from acl_docs
), parents as (
  select lower(trim(doc_id)) as k, ingested_at as ts from docs where trim(doc_id) <> ''
), firsts as (
  select k, min(ts) as first_ts from parents group by k
), gone as (
  select lower(trim(doc_id)) as k, deleted_at as d from doc_tombstones
), judged as (
  select r.*, case
    when f.k is null then 'missing'
    when f.first_ts > r.ts then 'late'
    when exists (select 1 from gone g where g.k = r.doc_id and g.d <= r.ts
                 and not exists (select 1 from parents p where p.k = r.doc_id and p.ts > g.d and p.ts <= r.ts)) then 'deleted' end as reason
  from refs r left join firsts f on f.k = r.doc_id where r.doc_id <> ''
)
select distinct ref_table, ref_id, doc_id, strftime(ts, '%Y-%m') as period, reason from judged where reason is not null
"""


def oracle_sql() -> dict[str, str]:
    wanted = f"with {ASKED}, {DOCS}, wanted as (select distinct unnest(expected) as doc_id from asked)"
    return {
        "clean_text": f"select line_no, {_clean('text')} as cleaned from docs",
        "content_hash": "select chunk_key, sha256(coalesce(textContent, '')) as sha256, sha256(coalesce(textContent, '')) = contentHash as same from chunks",
        "token_count": f"select line_no, len({_tokens(chr(40) + 'coalesce(title, ' + chr(39) * 2 + ') || chr(10) || coalesce(text, ' + chr(39) * 2 + '))')}) as tokens from docs",
        "keyword_rewrite": f"select id, keywords, {_variant('question', 'keywords')} as is_variant from (select id, question, {_keywords('question')} as keywords from questions)",
        "standard_term_counts": f"select term, count(*) as n from (select unnest({_terms('text')}) as term from docs) group by all",
        "embedding_input": "select chunk_key, sha256(coalesce(title, '') || chr(10) || coalesce(textContent, '')) as passage_sha256 from chunks",
        "chunk_documents": f"with recursive {DOCS}, {_cuts('select doc_id, ' + _clean('text') + ' as cleaned from doc', 400, 80)} select doc_id, chunk_id, doc_id || ':' || printf('%05d', chunk_id) as chunk_key, text_content from cut",
        "chunk_stats_by_source": f"""with recursive {_cuts('select doc_id, ' + _clean('text') + ' as cleaned from documents', 1200, 200)}
select lower(trim(source)) as source, count(distinct doc_id) as documents, count(*) as chunks, cast(sum(length(text_content)) as bigint) as chars, cast(max(chunk_id) as bigint) as most
from cut join documents using (doc_id) group by 1""",
        "chunk_projection": f"""with recursive {DOCS}, {ACL}, {_cuts('select doc_id, ' + _clean('text') + ' as cleaned from doc', 1200, 200)}
select doc_id || ':' || printf('%05d', chunk_id) as chunk_key, coalesce(title, '') as title, coalesce(source_type, 'unknown') as source_type, coalesce(source_path, '') as source_path,
  coalesce(source_dataset, '') as source_dataset, coalesce(tenant_id, '') as tenant_id, coalesce(classification, '') as classification,
  array_to_string(coalesce(allowed, []), ',') as allowed, array_to_string(coalesce(denied, []), ',') as denied, sha256(text_content) as content_hash
from cut join doc using (doc_id) left join acl on k = lower(trim(doc_id))""",
        "acl_join_defaults": f"""with {DOCS}, {ACL} select doc_id, coalesce(tenant_id, '') as tenant_id, coalesce(classification, '') as classification,
  array_to_string(coalesce(allowed, []), ',') as allowed, array_to_string(coalesce(denied, []), ',') as denied from doc left join acl on k = lower(trim(doc_id))""",
        "acl_files_last_wins": f"with {ACL} select k as doc, tenant_id, classification, array_to_string(allowed, ',') as allowed, array_to_string(denied, ',') as denied from acl",
        "ingest_dedupe_last_wins": "select chunk_key, count(*) as times, max_by(contentHash, indexedAt) as content_hash, max(indexedAt) as indexed_at from chunks group by 1",
        "export_filler_quota": f"""{wanted}, usable as (
  select doc_id, source_type, doc_id in (select doc_id from wanted) as expected from doc where trim(doc_id) <> '' and trim(coalesce(text, '')) <> ''
), numbered as (select *, row_number() over (partition by expected order by doc_id) as rn from usable)
select doc_id, coalesce(source_type, 'unknown') as source_type, 'corpus:' || coalesce(source_type, 'unknown') || ':' || doc_id as source_path, expected
from numbered where expected or rn <= 100""",
        "missing_gold": f"{wanted} select doc_id from wanted where doc_id not in (select lower(trim(doc_id)) from doc)",
        "acl_visible_chunks": f"with {ASKED}, {CHUNKS} select qid, count(c.chunk_key) as visible_chunks from asked a left join chunk c on {_visible('a.scope')} where len(a.scope) > 0 group by 1",
        "acl_unscoped_bypass": f"with {ASKED}, {CHUNKS} select qid, (select count(*) from chunk) as visible_chunks from asked where len(scope) = 0",
        "df_idf_stats": f"""with {CHUNKS}, tokens as (
  select chunk_key, 'title' as field, unnest({_terms('title')}) as term from chunk union all select chunk_key, 'text', unnest({_terms('text')}) from chunk
), df as (select field, term, count(distinct chunk_key) as df from tokens group by all), n as (select field, count(distinct chunk_key) as n from tokens group by all)
select field, term, df, round(ln(1 + (n - df + 5e-1) / (df + 5e-1)), 6) as idf from df join n using (field)""",
        "bm25_best_fields": _bm25(scoped=False),
        "bm25_acl_filtered": _bm25(),
        "bm25_keyword_route": _bm25(keyword=True),
        "dense_topk": _dense(False),
        "dense_filtered": _dense(True),
        "collapse_best_chunk": """select run_id, qid, route, doc_id, chunk_id, score from hits where score is not null and not isnan(score)
qualify row_number() over (partition by run_id, qid, route, doc_id order by score desc, chunk_id) = 1""",
        "route_ranks": f"with {ROUTES} select qid, route, rank, doc_id, chunk_key from route_hits",
        "rrf_two_route": _fused("route in ('dense', 'bm25')", "1e0", 60, 20),
        "rrf_weighted_four_route": _fused("true", FOUR, 10, 20),
        "rrf_single_route_bypass": f"""
with {ROUTES}, parts as (select *, 1e0 / (60e0 + rank) as part from route_hits where route in ('bm25', 'english') and trim(doc_id) <> ''),
single as (select qid, count(distinct route) = 1 as single from parts group by 1),
sums as (select qid, doc_id, round(sum(part), 9) as score, min(row(route_ord, rank)) as first, min(rank) as rank1, max(score) as own from parts group by all),
fused as (
  select qid, doc_id, case when single then own else s.score end as score,
    row_number() over (partition by qid order by case when single then rank1 end, s.score desc, first) as rank
  from sums s join single using (qid)
) select qid, rank, doc_id, round(score, 6) as score from fused where rank <= 20""",
        "question_metrics": f"{JUDGED} select qid, question_type, evaluable, first_rank, complete, violated, context_tokens, latency_ms from per",
        "metrics_overall": f"{JUDGED} select {_measures()} from per",
        "metrics_by_type": f"{JUDGED} select question_type as slice, {_measures()} from per group by 1",
        "metrics_by_source": f"{JUDGED}, each as (select *, unnest(case when len(scope) > 0 then scope else ['unknown'] end) as slice from per) select slice, {_measures()} from each group by 1",
        "latency_p95": "select event_type, cast(percentile_disc(0.95) within group (order by value) as double) as p95, count(*) as n from events group by 1",
        "details_flat": f"{JUDGED} select r.qid, len(j.expected) > 0 as evaluable, r.rank, r.doc_id, r.chunk_key, r.source_type from ranked r join judged j on j.qid = r.qid",
        "stream_ingest_resume": INGESTED,
        "hybrid_three_routes": _three_routes(),
        "p7_found": P7_FOUND,
        "p7_report": f'select ref_table, period, reason, count(*) as "references", count(distinct doc_id) as keys from ({P7_FOUND}) group by 1, 2, 3',
    }
