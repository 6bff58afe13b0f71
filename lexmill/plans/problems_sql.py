"""Equivalent SQL of :mod:`lexmill.plans.problems`."""

_EVENTS = """
events as (
  select article_id, loaded_at as ts, 1 as alive, page_id, title from article
  union all
  select d.article_id, d.deleted_at, 0, a.page_id, a.title from article_deletion d
  left join (select article_id, min(page_id) as page_id, min(title) as title from article group by 1) a using (article_id)),
links as (
  select * from internal_link
  qualify row_number() over (partition by link_id order by loaded_at, from_article nulls last, from_page_id nulls last, to_article nulls last, to_title nulls last) = 1),
refs as (
  select link_id, 'from_article' as ref_field, 'article' as space, from_article::varchar as key, loaded_at from links where from_article is not null
  union all select link_id, 'from_page_id', 'page', from_page_id::varchar, loaded_at from links where from_page_id is not null
  union all select link_id, 'to_article', 'article', to_article::varchar, loaded_at from links where to_article is not null
  union all select link_id, 'to_title', 'title', to_title, loaded_at from links where to_title is not null)"""

_VERDICTS = f"""{_EVENTS},
names as (
  select distinct 'article' as space, article_id::varchar as key, article_id from article
  union all select distinct 'page', page_id::varchar, article_id from article
  union all select distinct 'title', title, article_id from article),
candidates as (select r.link_id, r.ref_field, r.loaded_at, n.article_id from refs r join names n using (space, key)),
spells as (
  select article_id, ts, alive, lead(ts) over (partition by article_id order by ts) as until
  from (select article_id, ts, max(alive) as alive from events group by 1, 2)),
alive as (
  select distinct c.link_id, c.ref_field from candidates c join spells e using (article_id)
  where e.alive = 1 and c.loaded_at >= e.ts and (e.until is null or c.loaded_at < e.until)),
verdicts as (
  select r.link_id, r.ref_field, r.loaded_at, a.link_id is null as orphan from refs r left join alive a using (link_id, ref_field))"""

_OK = "(case when isnan(tf_idf_score) then null else tf_idf_score end)"


def _per_key(key: str, side: str, value: str, join_key: str, weight: str) -> str:
    return f"""select i.{key}, count(*) as n_rows, count({_OK}) as n_scores, round(sum({_OK}), 4) as sum_score, max({_OK}) as max_score, max(w.{value}) as {value}
from inverted_index i left join (select {join_key} as k, max({weight}) as {value} from {side} group by 1) w on w.k = i.{key} group by 1"""


ORACLES: dict[str, str] = {
    "p3_found": f"with {_VERDICTS} select link_id, ref_field from verdicts where orphan",
    "p3_report": f"""with {_VERDICTS}
select ref_field, strftime(loaded_at, '%Y-%m') as month, count(*) as n_refs, count_if(orphan)::bigint as n_orphans from verdicts group by 1, 2""",
    "p3_current_orphans": f"""with {_EVENTS},
now as (select article_id, arg_max(alive, (ts, alive)) as alive, min(page_id) as page_id, min(title) as title from events group by 1),
there as (
  select 'article' as space, article_id::varchar as key from now where alive = 1
  union select 'page', page_id::varchar from now where alive = 1 union select 'title', title from now where alive = 1)
select r.space, r.key, count(*) as n_refs, 0::bigint as n_existing from refs r anti join there using (space, key) group by 1, 2""",
    "p5_found": """select 'term' as side, term as key_text from inverted_index group by term having count(*) > 0.01 * (select count(*) from inverted_index)
union all select 'article', article::varchar from inverted_index group by article having count(*) > 300""",
    "p5_terms": _per_key("term", "vocabulary", "idf_value", "term", "idf_value"),
    "p5_articles": _per_key("article", "pagerank", "rank_score", "article", "score"),
}
