"""Equivalent SQL of :mod:`lexmill.plans.round_trips`."""

from lexmill.operators.search import HybridParams
from lexmill.plans.core_sql import ENTRIES, MARKED, POSTINGS, RESOLVED, STRIPPED, WORDS, hybrid
from lexmill.plans.round_trips import LIMIT

_PLAIN = "replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_PAGES = f"""{MARKED},
parts as (select page_id, part, 'See ' || string_agg(link, '; ' order by link_id) || ' and more.' as p from marked group by 1, 2),
pages as (select page_id, list_prepend('Before.', list({_PLAIN.format('p')} order by part)) as paragraphs from parts group by 1)"""
_LINKS = f"""found as (
  select page_id, row_number() over (partition by page_id order by part, link_id) - 1 as pos, to_title[:512] as to_title, stripped[:512] as anchor_text
  from (select *, {STRIPPED.format('a')} as stripped from marked) where to_title <> '' and stripped <> '' and not contains(a, '<'))"""

ORACLES: dict[str, str] = {
    "dump_articles": f"""with {_PAGES} select page_id, 'Page ' || page_id as title, array_to_string(paragraphs, '|') as paragraphs,
  array_to_string(list_transform(paragraphs, lambda p: len({WORDS.format('p')})), ',') as counts, false as is_disambiguation from pages""",
    "dump_links": f"with {MARKED}, {_LINKS} select page_id * 1000000 + pos as link_id, page_id as from_page_id, to_title, anchor_text from found",
    "dump_first_articles": f"""with {MARKED}, {_LINKS}, kept as (select distinct page_id from marked order by 1 limit {LIMIT})
select (select count(*) from kept) as n_articles, count(*) as n_links, max(page_id) as last_page from found where page_id in (select page_id from kept)""",
    "dump_counts": f"""with {MARKED}, n as (select count(distinct page_id) as n from marked)
select 'AA' as folder, n::bigint as n from n union all select 'AB', n from n union all select 'AC', count(*) from region""",
    "dump_lenient_records": f"""with {MARKED}, n as (select count(distinct page_id) as n from marked)
select 'AA' as folder, n::bigint as n, n::bigint as n_titles from n union all select 'AB', n, n from n union all select 'AC', 2 * count(*), 0 from region""",
    "qa_file": f"with {ENTRIES} select qa_id::varchar as qa_id, question, answer, to_title as second from entries",
    "query_file": r"""with lines as (select row_number() over (order by catalog_id) - 1 as i, regexp_replace(title, '^\s+|\s+$', '', 'g') as query from title_catalog where trim(title) <> ''), n as (select count(*) as n from lines)
select r.i as query_id, query from range(2000) r(i), n join lines l on l.i = r.i % n""",
    "results_file": f"with {hybrid(HybridParams())} select query, rank, article_id, title, round(score, 6) as score from results join queries using (query_id)",
    "stored_tables": f"""with {RESOLVED}, {POSTINGS}
select 'article' as table_name, count(*) as n_rows from article union all select 'vocabulary', count(*) from vocabulary union all select 'internal_link', count(*) from resolved where updated
union all select 'inverted_index', count(*) from post union all select 'pagerank', 0""",
    "file_manifest": "with t as (select string_agg(r_name || chr(10), '' order by r_regionkey) as t from region) select strlen(t) as length, sha256(t) as sha256, md5(t) as md5 from t",
    "table_sizes": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, {n} as n_columns from {t}" for t, n in (("region", 2), ("nation", 3), ("customer", 5), ("orders", 6), ("lineitem", 11), ("events", 6), ("documents", 7), ("article", 7))),
}
