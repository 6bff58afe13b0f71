"""Equivalent SQL of :mod:`lexmill.plans.core`."""

from __future__ import annotations

from dataclasses import replace

from lexmill.functions.tokenizers import ENGLISH_STOP, NAIVE_STOP
from lexmill.operators.search import EXACT, INSIDE, INSIDE_CHARS, LOOK_AHEAD, PREFIX, TIE_DECIMALS, HybridParams
from lexmill.plans.core import CAPS, GRID, QA, SEARCHES


def _words(items: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in items) + ")"


ART = """art as (
  select * exclude (rn) from (
    select *, row_number() over (partition by article_id order by loaded_at desc, coalesce(array_to_string(plain_text_paragraphs, ' '), '') desc) as rn from article)
  where rn = 1)"""
TOKENS = f"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]+'), lambda w: w not in {_words(NAIVE_STOP)})"
WORDS = f"""list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: len(w) <= 50
  and (len(w) <= 20 or len(list_distinct(string_split(w, ''))) >= 0.3 * len(w)) and len(list_distinct(string_split(w, ''))) > 1
  and not (regexp_full_match(w, '\\p{{{{Nd}}}}+') and len(w) > 10) and w not in {_words(ENGLISH_STOP)})"""
TF = f"""{ART},
tok as (select article_id, unnest({TOKENS.format("array_to_string(plain_text_paragraphs, ' ')")}) as term from art),
tf as (select article_id, term, count(*) as tf from tok group by 1, 2),
n as (select count(*) as n from art)"""
POSTINGS = """post as (
  select term, article, tf_idf_score from (
    select *, row_number() over (partition by term, article order by indexed_at desc nulls last, posting_id desc nulls last) as rn from inverted_index)
  where rn = 1 and tf_idf_score is not null and not isnan(tf_idf_score))"""
RANKS = "ranks as (select article, max(score) as pr from pagerank where score is not null and not isnan(score) group by 1)"
BY_TITLE = "by_title as (select title, min(article_id) as article_id from article group by 1)"
SIZE = "coalesce(len(plain_text_paragraphs), 0)"
STRIPPED = "regexp_replace({0}, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"
EDGES = """edges as (
  select from_article as src, to_article as dst, count(*) as w from internal_link
  where from_article is not null and to_article is not null and from_article <> to_article group by 1, 2),
nodes as (select src as node from edges union select dst from edges),
degrees as (select src, sum(w)::bigint as out_degree from edges group by 1)"""
RESOLVED = f"""{BY_TITLE},
pages as (select page_id, min(article_id) as article_id from article group by 1),
resolved as (
  select l.link_id, l.from_page_id, p.article_id is not null and t.article_id is not null as updated,
         case when p.article_id is not null and t.article_id is not null then coalesce(l.from_article, p.article_id) else l.from_article end as from_article,
         case when p.article_id is not null and t.article_id is not null then coalesce(l.to_article, t.article_id) else l.to_article end as to_article
  from internal_link l left join pages p on p.page_id = l.from_page_id left join by_title t on t.title = l.to_title)"""


def _link_counts(source: str) -> str:
    return f"""select count(*) as n_links, count_if((from_article is null and from_page_id is not null) or to_article is null)::bigint as n_unresolved,
  count_if(to_article is null)::bigint as n_to_null, count_if(from_article is not null and to_article is not null)::bigint as n_resolved, min(link_id) as min_id, max(link_id) as max_id from {source}"""


def hybrid(params: HybridParams, queries: str = "select catalog_id as query_id, title as query from title_catalog") -> str:
    """The common table expressions of a search, the last named ``results``."""
    if params.policy == "strict":
        least = "n_terms"
    else:
        least = f"case when n_terms = 1 then 1 {'when n_terms <= 5 then n_terms' if params.strict_and else ''} else 2 end"
    bonus = f"case when coverage > 1 then s + {params.coverage_bonus} * ln(1 + (coverage - 1)) else s end" if params.coverage_bonus else "s"
    partial = f"when starts_with(lower(title), q) then {PREFIX} when length(q) >= {INSIDE_CHARS} and contains(lower(title), q) then {INSIDE}" if params.partial_boost else ""
    r = lambda x: f"round({x}, {TIE_DECIMALS})"
    return f"""{ART}, {POSTINGS}, {RANKS},
queries as ({queries}),
qt as (
  select query_id, len(t) as n_terms, unnest(list_distinct(t)) as term from (select query_id, {TOKENS.format("query")} as t from queries)),
qv as (select *, ceil({params.max_candidates} / count(*) over (partition by query_id)) as n from qt where term in (select term from vocabulary)),
lists as (select *, row_number() over (partition by term order by tf_idf_score desc, article) as place from post),
hits as (
  select query_id, n_terms, article, sum(tf_idf_score) as s, count(*) as coverage from qv join lists using (term) where place <= n group by 1, 2, 3),
cand as (
  select h.query_id, h.article, {bonus} as s, pr from hits h left join ranks using (article) where coverage >= {least}),
tops as (select query_id, max(s) as top_s, max(pr) as top_pr, quantile_cont(pr, 0.5) as mid_pr from cand group by 1),
parts as (
  select query_id, article, case when top_s > 0 then s / top_s else s end as t,
         coalesce(case when top_pr > 0 then coalesce(pr, mid_pr) / top_pr else coalesce(pr, mid_pr) end, 0) as p
  from cand join tops using (query_id)),
mixed as (select query_id, article, {r('t')} as t, {r('p')} as p, {r(f'{params.alpha} * t + {1 - params.alpha} * p')} as h from parts),
first as (select *, row_number() over (partition by query_id order by h desc, t desc, p desc, article) as rn from mixed),
titled as (
  select f.*, title, lower(query) as q, row_number() over (partition by f.query_id order by h desc, t desc, p desc, f.article) as rn2
  from first f join art a on a.article_id = f.article join queries using (query_id) where rn <= {params.limit + LOOK_AHEAD}),
boosted as (
  select *, {r(f"h * case when lower(title) = q then {EXACT} {partial} else 1.0 end")} as score from titled where rn2 <= {params.limit}),
results as (
  select query_id, (row_number() over (partition by query_id order by score desc, t desc, p desc, article))::int as rank, article as article_id, title, score from boosted)"""


def _search(params: HybridParams) -> str:
    return f"with {hybrid(params)} select query_id, rank, article_id, title, round(score, 6) as score from results"


RELEVANT = """relevant as (
  select distinct c.catalog_id as query_id, a.title from title_catalog c join article a on upper(a.title) = upper(c.title))"""
METRICS = f"""{RELEVANT},
rels as (select r.query_id, r.rank, (v.title is not null)::int as rel from results r left join relevant v on v.query_id = r.query_id and v.title = r.title),
ideal as (select *, row_number() over (partition by query_id, rank <= 10 order by rel desc, rank) as irank from rels),
sums as (
  select query_id, sum(case when rank <= 10 then (2.0 ** rel - 1) / log2(rank + 1) end) as dcg, sum(case when rank <= 10 then (2.0 ** rel - 1) / log2(irank + 1) end) as idcg,
         min(case when rel > 0 and rank <= 10 then rank end) as first, count(*) as n,
         sum(rel) filter (rank <= 5) as h5, sum(rel) filter (rank <= 10) as h10, sum(rel) filter (rank <= 20) as h20 from ideal group by 1),
metrics as (
  select query_id, case when idcg > 0 then dcg / idcg else 0 end as ndcg, coalesce(1.0::double / first, 0) as mrr, case when n >= 5 then h5 / 5.0::double else 0 end as p_at_5,
         case when n >= 10 then h10 / 10.0::double else 0 end as p_at_10, coalesce(h20, 0) / n_relevant as r_at_20
  from (select query_id, count(*) as n_relevant from relevant group by 1) left join sums using (query_id))"""
_MEANS = ", ".join(f"round(avg({m}), 6) as {m}" for m in ("ndcg", "mrr", "p_at_5", "p_at_10", "r_at_20"))
GRID_SQL = " union all ".join(f"select * from (with {hybrid(p)}, {METRICS} select {i} as grid_order, {p.alpha}::double as alpha, {p.coverage_bonus}::double as coverage_bonus, count(*) as n_queries, {_MEANS} from metrics)" for i, p in enumerate(GRID))

ENTRIES = f"""{ART}, {BY_TITLE},
entries as (
  select c.catalog_id as qa_id, c.title, b.article_id, f.f.to_title as to_title, 'What is ' || c.title || '?' as question, coalesce(f.f.anchor_text, '') as answer from title_catalog c join by_title b using (title)
  left join (select from_article, arg_min({{'to_title': to_title, 'anchor_text': anchor_text}}, (link_id, to_title, coalesce(anchor_text, ''))) as f from internal_link where from_article is not null group by 1) f on f.from_article = b.article_id),
facts as (
  select qa_id, 0 as pos, title from entries union all select qa_id, 1, to_title from entries where to_title is not null and to_title <> '' union all select qa_id, 2, upper(title) from entries),
named as (select qa_id, pos, title from facts qualify row_number() over (partition by qa_id, lower(title) order by pos) = 1),
sized as (
  select article_id, title, len({TOKENS.format("title")}) + case when coalesce(len(paragraph_token_counts), 0) > 0 then coalesce(list_sum(paragraph_token_counts), 0)
         else len({TOKENS.format("array_to_string(plain_text_paragraphs, chr(10) || chr(10))")}) end as n_tokens from art),
support as (
  select n.qa_id, n.pos, n.title, b.article_id, s.n_tokens::bigint as n_tokens from named n left join by_title b using (title) left join sized s on s.article_id = b.article_id),
status as (
  select qa_id, case when count_if(article_id is null) > 0 then 'skipped_missing' when coalesce(sum(n_tokens), 0) > {max(CAPS)} then 'skipped_overflow' else 'processed' end as status,
         coalesce(sum(n_tokens), 0) as supporting_tokens from support group by 1)"""


#: The settings made up from the line items; ``x`` is the number in a value, ``v`` the value in lower case.
SETTINGS = """settings as (
  select *, lower(value) as v, try_cast(regexp_extract(value, '^[0-9]+') as double) as x from (
    select distinct name, case when name = 'Buffer' then x || size when name = 'pause' then x || time else (['low', 'HIGH', 'x,trace'])[length(x) % 3 + 1] end as value
    from (select (['Buffer', 'pause', 'level', 'modules', 'other'])[l_orderkey % 5 + 1] as name, (l_partkey % 97 + 1)::varchar as x,
                 (['kB', 'MB', ' gb', 'TB', ''])[l_suppkey % 5 + 1] as size, (['s', 'min', 'h', 'd', ''])[l_suppkey % 5 + 1] as time from lineitem)))"""
#: The links of the pages made up from the link table, and what is left of each once it is rewritten.
MARKED = f"""marked as (
  select link_id // 8 as page_id, (link_id // 4) % 2 as part, link_id, to_title, coalesce(anchor_text, '') as a,
         '<a href="' || replace(replace(replace(replace(url_encode(to_title), '+', '%20'), '~', '%7E'), '%2A', '*'), '%2a', '*') || '">' || coalesce(anchor_text, '') || '</a>' as link
  from (select distinct link_id, to_title, anchor_text from internal_link))"""


def _rewritten(titles: str) -> str:
    """Pages with their links rewritten, ``titles`` giving (title, article_id, page)."""
    return f"""{MARKED}, named as ({titles}),
exact as (select title, min(article_id) as article_id from named group by 1), folded as (select lower(title) as k, min(article_id) as article_id from named group by 1),
pages as (select article_id, min(page) as page from named group by 1),
shown as (
  select m.page_id, m.part, link_id, case when a = '' or contains(a, '<') then link when page is null then a else '<a href="/article/' || page || '/">' || a || '</a>' end as piece
  from marked m left join exact e on e.title = m.to_title left join folded f on f.k = lower(m.to_title) left join pages p on p.article_id = coalesce(e.article_id, f.article_id)),
parts as (select page_id, part, 'See ' || string_agg(piece, '; ' order by link_id) || ' and more.' as paragraph from shown group by 1, 2),
rewritten as (select page_id, 'Before.|' || string_agg(paragraph, '|' order by part) || '|' as paragraphs from parts group by 1)"""


def _converged(rounds: int, tail: str, d: float = 0.85, tol: float = 1e-6) -> str:
    """Rounds of PageRank until the change is below ``tol``, then ``tail`` over ``final(node, score)`` and ``ended(i, residual)``."""
    steps = [f"with {EDGES}, n as (select count(*)::double as n from nodes), steps as materialized (select src, dst, w / out_degree as p from edges join degrees using (src)),\nr0 as materialized (select node, 1 / n as r from nodes, n)"]
    for i in range(1, rounds + 1):
        steps.append(f"""u{i} as materialized (
  select node, {1 - d} / n + {d} * coalesce(s, 0) as u from nodes cross join n left join (select dst as node, sum(p * r) as s from steps join r{i - 1} on node = src group by 1) using (node)),
r{i} as materialized (select node, u + {d} * x / n as r from u{i}, (select coalesce(sum(u), 0) as x from u{i} where node not in (select src from degrees)), n),
c{i} as materialized (select {i} as i, sum(abs(a.r - b.r)) as residual from r{i} a join r{i - 1} b using (node))""")
    steps.append("ended as (select * from (" + " union all ".join(f"select * from c{i}" for i in range(1, rounds + 1)) + f") where residual < {tol} order by i limit 1)")
    steps.append("final as (select node, r / sum(r) over () as score from (" + " union all ".join(f"select {i} as i, node, r from r{i}" for i in range(1, rounds + 1)) + ") where i = (select i from ended))")
    return ",\n".join(steps) + f"\n{tail}"


def _pagerank(rounds: int, d: float = 0.85) -> str:
    steps = [f"with {EDGES}, n as (select count(*)::double as n from nodes), steps as (select src, dst, w / out_degree as p from edges join degrees using (src)),\nr0 as (select node, 1 / n as r from nodes, n)"]
    for i in range(1, rounds + 1):
        steps.append(f"""u{i} as (
  select node, {1 - d} / n + {d} * coalesce(s, 0) as u from nodes cross join n left join (select dst as node, sum(p * r) as s from steps join r{i - 1} on node = src group by 1) using (node)),
lost{i} as (select coalesce(sum(u), 0) as x from u{i} where node not in (select src from degrees)),
r{i} as (select node, u + {d} * x / n as r from u{i}, lost{i}, n)""")
    return ",\n".join(steps) + f"\nselect node as article, round(r, 9) as score from r{rounds}"


def _chosen(variant: str) -> str:
    """The distractors of each entry by a recursive walk over its results: ``picked(qa_id, place, ...)`` and ``tried(qa_id, fallbacks)``."""
    params = replace(QA, variant=variant)
    fold = "lower" if variant == "build" else ""
    last = "array_to_string(titles, ' ')[:256]" if variant == "build" else "array_to_string(titles[:3], ' ')"
    most = max(CAPS)
    found = "\nunion all ".join(
        f"select {kind} as kind, * from (with {hybrid(p, f'select distinct query as query_id, query from queries where kind = {kind}')} select query_id as query, rank, article_id, title from results)" for kind, p in ((0, params.search), (1, params.fallback_search))
    )
    return f"""{ENTRIES},
good as (select * from status where status = 'processed'),
facts_of as (select qa_id, list_sort(list(distinct title)) as titles from support group by 1),
wished as (
  select qa_id, 0 as kind, pos, title as query from support semi join good using (qa_id)
  union all select qa_id, 1, 0, question from entries semi join good using (qa_id) where question <> ''
  union all select qa_id, 1, 1, trim(question || ' ' || answer) from entries semi join good using (qa_id) where answer <> '' and not contains(lower(question), lower(answer))
  union all select qa_id, 1, 2, {last} from facts_of semi join good using (qa_id)),
queries as materialized (
  select * exclude (first, turn) from (
    select *, row_number() over (partition by qa_id, kind order by pos) as turn from (select *, row_number() over (partition by qa_id, query order by kind, pos) as first from wished) where kind = 0 or first = 1)
  where kind = 0 or turn <= {params.max_fallbacks}),
found as materialized ({found}),
items as materialized (
  select *, row_number() over (partition by qa_id order by kind, pos, rank) as i from (
    select qa_id, kind, pos, 0 as rank, null::bigint as article_id, null::varchar as title, null::bigint as n_tokens from queries
    union all select q.qa_id, q.kind, q.pos, f.rank, f.article_id, f.title, s.n_tokens from queries q join found f on f.kind = q.kind and f.query = q.query join sized s using (article_id))),
walk as (
  with recursive w as (
    select qa_id, 0::bigint as i, supporting_tokens::bigint as used, list_transform(titles, lambda t: {fold}(t)) as seen, 0 as tried, false as taken, null::bigint as article_id, null::varchar as title, null::bigint as n_tokens
    from good join facts_of using (qa_id)
    union all
    select qa_id, i, case when ok then used + n_tokens else used end, case when ok then list_append(seen, {fold}(title)) else seen end,
           case when used < {most} and article_id is null and kind = 1 then tried + 1 else tried end, ok, article_id, title, n_tokens
    from (select w.qa_id, t.i, t.kind, w.used, w.seen, w.tried, t.article_id, t.title, t.n_tokens,
                 coalesce(w.used < {most} and t.n_tokens >= {params.min_tokens} and w.used + t.n_tokens <= {most} and not list_contains(w.seen, {fold}(t.title)), false) as ok
          from w join items t on t.qa_id = w.qa_id and t.i = w.i + 1))
  select * from w),
tried as (select qa_id, max(tried) as fallbacks from walk group by 1),
picked as (select qa_id, (row_number() over (partition by qa_id order by i) - 1)::int as place, article_id, title, n_tokens from walk where taken)"""


SLICES = f"""run as (select qa_id, place, sum(n_tokens) over (partition by qa_id order by place rows unbounded preceding) as so_far from picked),
slices as (
  select qa_id, cap::bigint as cap, count_if(coalesce(supporting_tokens + so_far <= cap, false))::bigint as n_distractors,
         (any_value(supporting_tokens) + coalesce(max(case when supporting_tokens + so_far <= cap then so_far end), 0))::bigint as context_size
  from good cross join (select unnest([{", ".join(map(str, CAPS))}]) as cap) left join run using (qa_id) group by 1, 2)"""


_HASH = "((((article_id % 2147483647) * 48271 + {0}) % 2147483647) * 69621 + {0}) % 2147483647"
_ANCHOR = STRIPPED.format("coalesce(anchor_text, '')")

ORACLES: dict[str, str] = {
    "tokenize_naive_counts": f"select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_distinct from (select doc_id, {TOKENS.format('text')} as t from documents)",
    "tokenize_word_counts": f"select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_distinct from (select doc_id, {WORDS.format('text')} as t from documents)",
    "paragraph_token_counts": f"with {ART} select article_id, {SIZE}::int as n_paragraphs, coalesce(list_sum(list_transform(plain_text_paragraphs, lambda p: len({TOKENS.format('p')}))), 0)::int as n_tokens from art",
    "snippets": f"""with {ART}, first as (select article_id, list_filter(list_transform(plain_text_paragraphs, lambda p: {STRIPPED.format('p')}), lambda p: p is not null and p <> '')[1] as s from art)
select article_id, coalesce(case when length(s) > 200 then s[:200] || '...' else s end, '') as snippet from first""",
    "html_paragraph_text": "select doc_id, replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') as plain from documents",
    "html_links": f"""with {MARKED} select page_id, (row_number() over (partition by page_id order by part, link_id) - 1)::int as pos, to_title[:512] as to_title, stripped[:512] as anchor_text
from (select *, {STRIPPED.format('a')} as stripped from marked) where to_title <> '' and stripped <> '' and not contains(a, '<')""",
    "decoded_links": "select url_decode(to_title) as decoded, count(*) as n_links from (select distinct link_id, to_title from internal_link) group by 1",
    "term_frequency": f"with {TF} select * from tf",
    "document_frequency": f"with {TF} select term, count(*) as document_frequency from tf group by 1",
    "vocabulary_idf": f"with {TF} select term, count(*) as document_frequency, round(ln(any_value(n) / count(*)), 6) as idf_value from tf, n group by 1",
    "inverted_index": f"with {TF}, df as (select term, count(*) as df from tf group by 1) select term, article_id, round(tf * ln(n / df), 6) as tf_idf_score from tf join df using (term), n",
    "index_summary": f"with {TF} select any_value(n) as n_articles, count(distinct term) as n_terms, count(*) as n_postings, round(count(*) / any_value(n), 6) as avg_terms from tf, n",
    "term_ids": f"with {TF} select term, row_number() over (order by term) as term_id from (select distinct term from tf)",
    "top_postings_per_term": f"""with {POSTINGS} select term, article, round(tf_idf_score, 6) as tf_idf_score, rank from (
  select *, (row_number() over (partition by term order by tf_idf_score desc, article))::int as rank from post) where rank <= 10""",
    "resolve_links": f"with {RESOLVED} select link_id, from_article, to_article, updated from resolved",
    "resolved_link_counts": f"with {RESOLVED} {_link_counts('resolved')}",
    "unresolved_link_counts": _link_counts("internal_link"),
    "unresolved_links": "select link_id, from_page_id, to_title from internal_link where (from_article is null and from_page_id is not null) or to_article is null",
    "missing_titles": "select to_title, count(*) as n_links from internal_link where to_title not in (select title from article) group by 1",
    "resolve_titles": f"""with {BY_TITLE}, folded as (select lower(title) as k, min(article_id) as article_id from article group by 1), asked as (select distinct to_title as title from internal_link)
select a.title, coalesce(b.article_id, f.article_id) as article_id from asked a left join by_title b using (title) left join folded f on f.k = lower(a.title)""",
    "rewrite_links": f"with {_rewritten('select title, article_id, page_id as page from article')} select * from rewritten",
    "article_detail": f"""with {_rewritten("select title, catalog_id as article_id, -catalog_id as page from title_catalog union all select 'Here', 0, min(link_id // 8) from internal_link")}
select page_id, 'Here' as title, paragraphs from rewritten order by page_id limit 1""",
    "admin_search_titles": f"with {ART} select article_id, title from art where contains(lower(title), 'academy')",
    "admin_search_links": """with t as (select article_id, min(title) as title from article group by 1)
select link_id, to_title, f.title as from_title, g.title as target_title from internal_link left join t f on f.article_id = from_article left join t g on g.article_id = to_article
where contains(lower(to_title), 'academy') or coalesce(contains(lower(f.title), 'academy'), false) or coalesce(contains(lower(g.title), 'academy'), false)""",
    "edge_weights": f"with {EDGES} select * from edges",
    "graph_nodes": f"with {EDGES} select * from nodes",
    "out_degree": f"with {EDGES} select * from degrees",
    "dangling_nodes": f"with {EDGES} select node from nodes where node not in (select src from degrees)",
    "pagerank_3_iters": _pagerank(3),
    "pagerank_converged": _converged(60, "select node as article, round(score, 9) as score from final"),
    "pagerank_run": _converged(60, """select count(*) as n_nodes, round(sum(score), 9) as mass, round(max(score), 9) as top, any_value(i)::int as iterations, round(any_value(residual), 12) as residual from final, ended"""),
    "pagerank_top10": f"with {ART}, {RANKS} select article, title, round(pr, 9) as score from ranks join art on article_id = article order by pr desc, article limit 10",
    "pagerank_stats": f"with {RANKS} select count(*) as n, round(avg(pr), 9) as avg_score, round(min(pr), 9) as min_score, round(max(pr), 9) as max_score, round(sum(pr), 9) as sum_score from ranks",
    **{name: _search(params) for name, params in SEARCHES.items()},
    "search_title_exact": f"""with {ART}, hits as (
  select c.catalog_id as query_id, a.article_id, a.title, (row_number() over (partition by c.catalog_id order by a.article_id))::int as rank from title_catalog c join art a on upper(a.title) = upper(c.title))
select query_id, rank, article_id, title from hits where rank <= 20""",
    "search_with_fallback": f"""with {hybrid(HybridParams(policy="strict"))},
exact as (
  select c.query_id, (row_number() over (partition by c.query_id order by a.article_id))::int as rank, a.article_id, a.title from queries c join art a on upper(a.title) = upper(c.query)
  where c.query_id not in (select query_id from results)),
joined as (
  select query_id, rank, article_id, title, round(score, 6) as score, 'hybrid' as via from results union all select query_id, rank, article_id, title, 1.0, 'title' from exact where rank <= 20),
snip as (select article_id, list_filter(list_transform(plain_text_paragraphs, lambda p: {STRIPPED.format('p')}), lambda p: p is not null and p <> '')[1] as s from art)
select b.*, coalesce(case when length(s) > 200 then s[:200] || '...' else s end, '') as snippet from joined b join snip using (article_id)""",
    "search_quality": f"with {hybrid(HybridParams())}, {METRICS} select query_id, {', '.join(f'round({m}, 6) as {m}' for m in ('ndcg', 'mrr', 'p_at_5', 'p_at_10', 'r_at_20'))} from metrics",
    "grid_search": GRID_SQL,
    "grid_best": f"select grid_order, alpha, coverage_bonus, ndcg from ({GRID_SQL}) order by ndcg desc, grid_order limit 1",
    "article_token_totals": f"with {ENTRIES} select article_id, n_tokens::bigint as n_tokens from sized",
    "qa_supporting_docs": f"with {ENTRIES} select qa_id, pos, title, article_id, n_tokens from support",
    "qa_status_counts": f"with {ENTRIES} select status, count(*) as n from status group by 1",
    "qa_context_slices": f"""with {ENTRIES},
first as (select article_id as from_article, min(qa_id) as qa_id from support where pos = 0 group by 1),
far as (
  select f.qa_id, min(l.link_id) as place, any_value(s.n_tokens) as n_tokens from internal_link l join first f on f.from_article = l.from_article join sized s on s.article_id = l.to_article group by f.qa_id, l.to_article),
run as (select qa_id, sum(n_tokens) over (partition by qa_id order by place rows unbounded preceding) as so_far from far),
joined as (select qa_id, cap, supporting_tokens, so_far from status cross join (select unnest([{', '.join(map(str, CAPS))}]) as cap) left join run using (qa_id) where status = 'processed')
select qa_id, cap::bigint as cap, count_if(coalesce(supporting_tokens + so_far <= cap, false))::bigint as n_distractors,
  (any_value(supporting_tokens) + coalesce(max(case when supporting_tokens + so_far <= cap then so_far end), 0))::bigint as context_size from joined group by 1, 2""",
    **{f"qa_distractors_{v}": f"with {_chosen(v)} select * from picked" for v in ("build", "generate")},
    "qa_dataset": f"""with {_chosen("build")}, {SLICES},
docs as (select article_id, title, coalesce(array_to_string(plain_text_paragraphs, chr(10)), '') as text from art),
sup as (select qa_id, string_agg(d.title, '|' order by pos) as supporting_titles, md5(string_agg(text, '|' order by pos)) as supporting_md5 from support join docs d using (article_id) group by 1),
far as (
  select s.qa_id, s.cap, string_agg(d.title, '|' order by place) as distractor_titles, md5(string_agg(text, '|' order by place)) as distractor_md5
  from slices s join picked p on p.qa_id = s.qa_id and p.place < s.n_distractors join docs d on d.article_id = p.article_id group by 1, 2)
select s.cap, s.qa_id as id, question, answer as gold_answer, supporting_titles, supporting_md5, coalesce(distractor_titles, '') as distractor_titles, coalesce(distractor_md5, md5('')) as distractor_md5, context_size
from slices s join entries e using (qa_id) join sup using (qa_id) left join far f on f.qa_id = s.qa_id and f.cap = s.cap""",
    "qa_report": f"""with {_chosen("build")}, {SLICES},
biggest as (select * from slices where cap = {max(CAPS)})
select (select count(*) from entries) as n_entries, count_if(status = 'processed')::bigint as n_processed, count_if(status = 'skipped_missing')::bigint as n_skipped_missing,
  count_if(status = 'skipped_overflow')::bigint as n_skipped_overflow, (select count(*) from entries) - count(*) as n_no_facts,
  (select round(avg(context_size / cap), 9) from biggest) as avg_fill, (select round(avg(n_distractors), 9) from biggest) as avg_distractors, (select round(avg(fallbacks), 9) from tried) as avg_fallbacks
from status""",
    "db_summary": f"""with {ART} select (select count(*) from art) as n_articles, (select count(*) from internal_link) as n_links, (select count(*) from internal_link where to_article is null) as n_unresolved,
  (select round(coalesce(avg({SIZE}), 0), 6) from (select * from art order by article_id limit 1000)) as avg_paragraphs""",
    "mean_paragraphs": f"with {ART} select round(coalesce(avg({SIZE}), 0), 6) as avg_paragraphs from art",
    "status_page": f"""with {ART}, {RANKS},
a as (select count(*) as n_articles from art), k as (select count(*) as n_links, count_if(to_article is null)::bigint as n_unresolved from internal_link),
v as (select count(*) as n_terms, round(avg(document_frequency), 9) as avg_df, max(document_frequency) as max_df, round(avg(idf_value), 9) as avg_idf from vocabulary),
p as (select count(*) as n_postings from inverted_index), r as (select count(*) as n_ranks, round(max(pr), 9) as max_rank, round(min(pr), 9) as min_rank, round(avg(pr), 9) as avg_rank from ranks),
m as (select round(avg({SIZE}), 9) as avg_paragraphs from (select * from art order by article_id limit 100))
select *, round(n_links / n_articles, 9) as links_per_article from a, k, v, p, r, m""",
    "articles_per_source_stats": """with c as (select source, count(*) as n from documents group by 1)
select count(*) as n_sources, sum(n)::bigint as total, round(avg(n), 6) as avg_n, min(n) as min_n, max(n) as max_n, round(avg(n) * count(*))::bigint as estimate from c""",
    "top5_sources": "select source, count(*) as n from documents group by 1 order by n desc, source nulls last limit 5",
    "timing_stats_percentiles": """with ok as (select event_type, value as v from events where value is not null and not isnan(value))
select event_type, count(*) as n, round(sum(v), 4) as total, round(avg(v), 4) as mean, round(median(v), 4) as median, round(case when count(*) < 5 then max(v) else quantile_cont(v, 0.95) end, 4) as p95,
  round(min(v), 4) as least, round(max(v), 4) as greatest from ok group by 1""",
    "event_type_counts": "select event_type, count(*) as n from events group by 1",
    "event_window_counts": "select time_bucket(interval '1 hour', ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "statement_classes": """with t as (
  select (['SELECT a FROM ', 'select b from ', 'INSERT INTO ', 'Update '])[o_orderkey % 4 + 1] || (['Article', 'InvertedIndex', 'Vocabulary', 'PageRank', 'InternalLink', 'article'])[o_custkey % 6 + 1] as s, o_orderkey % 7 as seconds from orders)
select case when not contains(upper(s), 'SELECT') then 'Non-SELECT' when contains(s, 'Article') then 'Article lookup' when contains(s, 'InvertedIndex') then 'Inverted index' when contains(s, 'Vocabulary') then 'Vocabulary'
  when contains(s, 'PageRank') then 'PageRank' else 'Other SELECT' end as query_type, count(*) as n, sum(seconds)::double as seconds, (select count(*) > 10 from t where contains(s, 'Article')) as row_by_row from t group by 1""",
    "cache_hit_ratio": "select l_returnflag, sum(l_partkey)::bigint as hits, sum(l_suppkey)::bigint as reads, round(100.0::double * sum(l_partkey) / sum(l_partkey + l_suppkey), 2) as hit_ratio from lineitem group by 1",
    "blocked_requests": """with locks as (
  select distinct event_type, case when user_id % 10 <> 0 then user_id % 10 end as relation, user_id as pid, coalesce(value, 0) < 50 as granted from events),
owners as (select distinct event_type, relation, pid from locks)
select w.event_type, w.relation, w.pid, count(*) as n_blockers, min(o.pid) as first_blocker
from (select distinct event_type, relation, pid from locks where not granted) w
join owners o on o.event_type = w.event_type and o.relation is not distinct from w.relation and o.pid <> w.pid group by 1, 2, 3""",
    "parsed_settings": f"""with {SETTINGS}
select name, value, trunc(case when name = 'Buffer' then case when v like '%kb' then x / 1024 when v like '%mb' then x when v like '%gb' then x * 1024 when v like '%tb' then x * 1048576 else x / 1048576 end
  else case when v like '%s' then x when v like '%min' then x * 60 when v like '%h' then x * 3600 when v like '%d' then x * 86400 else x end end)::bigint as amount
from settings where name in ('Buffer', 'pause')""",
    "checked_settings": f"""with {SETTINGS}, amounts as (
  select *, case when name = 'Buffer' then trunc(case when v like '%kb' then x / 1024 when v like '%mb' then x when v like '%gb' then x * 1024 when v like '%tb' then x * 1048576 else x / 1048576 end)
    when name = 'pause' then trunc(case when v like '%s' then x when v like '%min' then x * 60 when v like '%h' then x * 3600 when v like '%d' then x * 86400 else x end) end as n,
    case when name = 'Buffer' then 16 when name = 'pause' then 30 end as least, case when name = 'Buffer' then 65536 when name = 'pause' then 7200 end as most from settings)
select name, value, case when name = 'other' then 'unknown' when name = 'level' then case when v = 'high' then 'ok' when v = 'low' then 'warning' else 'error' end
    when name = 'modules' then case when contains(value, 'trace') then 'ok' else 'warning' end when n < least or n > most then 'warning' else 'ok' end as status,
  case when name = 'other' then 'no rule' when name = 'level' then case when v = 'high' then 'best option' when v = 'low' then 'not the best option' else 'no such option' end
    when name = 'modules' then case when contains(value, 'trace') then 'contains one' else 'contains none' end when n < least then 'too small' when n > most then 'too large' else 'within range' end as message
from amounts""",
    "sample_with_repeats": """with shuffled as (select catalog_id, row_number() over (order by (((catalog_id % 2147483647) * 48271 + 42) % 2147483647 * 69621 + 42) % 2147483647, catalog_id) - 1 as spot from title_catalog),
n as (select count(*) as n from title_catalog),
slots as (select i as place, case when i < n then i else ((((i % 2147483647) * 48271 + 42) % 2147483647) * 69621 + 42) % 2147483647 % n end as spot from range(2500) r(i), n)
select place, catalog_id from slots join shuffled using (spot)""",
    "search_tokens": f"select catalog_id as query_id, array_to_string({TOKENS.format('title')}, ' ') as tokens from title_catalog",
    "large_value_percent": "select event_type, case when count(value) > 0 then round(100.0::double * count_if(value > 50) / count(value), 2) else 0 end as percent from events group by 1",
    "sample_queries_seeded": f"with {ART} select article_id, title from art order by {_HASH.format(42)}, article_id limit 100",
    "random_articles": f"with {ART} select article_id, title from art order by {_HASH.format(7)}, article_id limit 2",
    "constraint_report": """with u as (
  select 'unique' as kind, 'article' as table_name, 'page_id' as key, count(*) as n_keys from (select page_id from article where page_id is not null group by 1 having count(*) > 1)
  union all select 'unique', 'vocabulary', 'term', count(*) from (select term from vocabulary group by 1 having count(*) > 1)
  union all select 'unique', 'inverted_index', 'term,article', count(*) from (select term, article from inverted_index group by 1, 2 having count(*) > 1)
  union all select 'unique', 'pagerank', 'article', count(*) from (select article from pagerank group by 1 having count(*) > 1)
  union all select 'foreign', 'inverted_index', 'term', count(distinct term) from inverted_index where term not in (select term from vocabulary)
  union all select 'foreign', 'inverted_index', 'article', count(distinct article) from inverted_index where article not in (select article_id from article)
  union all select 'foreign', 'pagerank', 'article', count(distinct article) from pagerank where article not in (select article_id from article)
  union all select 'foreign', 'internal_link', 'from_article', count(distinct from_article) from internal_link where from_article not in (select article_id from article)
  union all select 'foreign', 'internal_link', 'to_article', count(distinct to_article) from internal_link where to_article not in (select article_id from article))
select * from u""",
    "token_count_parity": f"with {ART} select article_id, {SIZE}::int as n_paragraphs, coalesce(len(paragraph_token_counts), 0)::int as n_counts from art where {SIZE} <> coalesce(len(paragraph_token_counts), 0)",
    "first_load_per_page": "select page_id, article_id, loaded_at from article qualify row_number() over (partition by page_id order by loaded_at, article_id) = 1",
    "cascade_delete_counts": """with g as (select distinct article_id as k from article_deletion)
select 'article' as table_name, count(*) as n from article where article_id not in (select k from g)
union all select 'inverted_index', count(*) from inverted_index where article not in (select k from g)
union all select 'pagerank', count(*) from pagerank where article not in (select k from g)
union all select 'internal_link', count(*) from internal_link where (from_article is null or from_article not in (select k from g)) and (to_article is null or to_article not in (select k from g))""",
    "null_safe_join": "select doc_id, n_same from documents d join (select source, count(*) as n_same from documents group by 1) s on d.source is not distinct from s.source",
}
