"""Equivalent SQL of the queries here that SQL can express."""

from lexmill.functions.tokenizers import NAIVE_STOP
from lexmill.llm.titles import DIGITS, EDIT_LETTERS, ENTITIES, FILLERS, PREFIX, SHORTENED, STROKES, _fold_tables

_LATEST = """
latest as (
  select article_id, arg_max(txt, (loaded_at, txt)) as txt
  from (select article_id, loaded_at, coalesce(array_to_string(plain_text_paragraphs, ' '), '') as txt from article)
  group by article_id),
tokens as (
  select article_id, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) as term from latest),
tf as (
  select article_id, term, count(*) as tf from tokens
  where term not in (""" + ", ".join(f"'{w}'" for w in NAIVE_STOP) + """)
  group by article_id, term),
n as (select count(distinct article_id) as n from article)"""

_CURRENT = """
current as (
  select term, article, arg_max(coalesce(tf_idf_score, 'nan'::double), (indexed_at, posting_id)) as score
  from inverted_index group by term, article)"""

_ENTROPY = """
terms as (
  select term, count(*) as df, sum(tf) as gf, sum(tf * ln(tf)) as s from tf group by term),
weighted as (
  select article_id, term, tf, df,
         ln(1 + tf) * (1 - least(1.0, greatest(0.0, (ln(gf) - s / gf) / ln(n)))) as log_entropy, tf * ln(n / df) as tf_idf
  from tf join terms using (term), n)"""


def _best(weight: str, columns: str) -> str:
    return f"""with {_LATEST}, {_ENTROPY},
ranked as (
  select article_id, term, round({weight}, 6) as weight,
         row_number() over (partition by article_id order by round({weight}, 6) desc, term) as rn from weighted)
select {columns} from ranked where rn = 1"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _plain(value: str) -> str:
    """The plain form of a title."""
    v = f"case when regexp_matches({value}, '%[0-9A-Fa-f]{{2}}') or (contains({value}, '+') and not contains({value}, ' ')) then coalesce(try(url_decode(replace({value}, '+', ' '))), {value}) else {value} end"
    v = f"regexp_replace(lower({v}), '&#(x0*27|0*39);', {_text(chr(39))}, 'g')"
    for name, char in ENTITIES.items():
        v = f"replace({v}, {_text(name)}, {_text(char)})"
    a, b = _fold_tables()
    v = f"translate(regexp_replace({v}, '\\p{{M}}+', '', 'g'), {_text(a)}, {_text(b)})"
    for char, two in STROKES.items():
        if len(two) > 1:
            v = f"replace({v}, '{char}', '{two}')"
    for pattern, to in (("([^#])#[a-z].*$", "\\1"), (f"^[^a-z0-9]*{PREFIX}[ _]*:", ""), ("[’‘`´]", "'"), ("'s([^a-z0-9]|$)", " s\\1")):
        v = f"regexp_replace({v}, {_text(pattern)}, {_text(to)}, 'g')"
    return f"regexp_replace(trim(regexp_replace(replace({v}, '&', ' and '), '[^a-z0-9#]+', ' ', 'g')), '^the ', '')"


def _forms(source: str, key: str, value: str) -> str:
    """Both forms of the titles of ``source``: (key, form, text)."""
    digits = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in DIGITS.items()) + "}"
    fillers = ", ".join(f"'{w}'" for w in FILLERS)
    return f"""select {key}, form, text from (
  select {key}, unnest([1, 2]) as form, unnest([array_to_string(w, ''), array_to_string(list_sort(list_filter(w, lambda x: x not in ({fillers}))), ' ')]) as text
  from (select {key}, list_transform(list_filter(string_split({_plain(value)}, ' '), lambda x: x <> ''), lambda x: coalesce({digits}[x], x)) as w from {source})) where text <> ''"""


def _thinned(source: str, key: str) -> str:
    """The forms as they are and without each letter; what is one edit or swap from another shares one of these."""
    return f"select {key}, form, text, case when i = 0 then text else left(text, i - 1) || substr(text, i + 1) end as less from (select *, unnest(range(0, length(text) + 1)) as i from {source})"


def _cut(source: str, key: str) -> str:
    """Form 2 without each word: (key, rest, word)."""
    return f"""select distinct {key}, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') as rest, w[i] as word
  from (select {key}, w, unnest(range(1, len(w) + 1)) as i from (select {key}, string_split(text, ' ') as w from {source} where form = 2) where len(w) > 1)"""


def _short(a: str, b: str) -> str:
    fits = f"length({a}) >= 2 and length({a}) * {SHORTENED} <= length({b}) and {a}[1] = {b}[1]"
    return f"case when {fits} and starts_with({b}, {a}) then 1 when {fits} and regexp_matches({b}, '^' || array_to_string(string_split({a}, ''), '.*')) then 2 end"


#: ``matched(value, catalog_id, distance, kind)`` by the letters and words left out; another way than the operator's segments.
_MATCHED = f"""rows as (
  select distinct 'internal_link' as src_table, link_id as row_id, to_title as value from internal_link union select distinct 'article', article_id, title from article),
vals as (select distinct value from rows where value is not null),
other as (select value from vals where value not in (select title from title_catalog)),
typed as materialized ({_forms("other", "value", "value")}),
listed as materialized ({_forms("title_catalog", "catalog_id", "title")}),
found as (
  select value, catalog_id, 0 as distance, 'equal' as kind from vals join title_catalog on title = value
  union all select t.value, l.catalog_id, 0, 'written' from typed t join listed l using (form, text)
  union all select value, catalog_id, 1, 'typo' from (
    select distinct t.value, l.catalog_id, t.text, l.text as entry from ({_thinned("typed", "value")}) t join ({_thinned("listed", "catalog_id")}) l using (form, less) where length(l.text) >= {EDIT_LETTERS} and t.text <> l.text)
    where damerau_levenshtein(text, entry) = 1
  union all select value, catalog_id, d, 'abbreviated' from (
    select t.value, l.catalog_id, coalesce({_short("t.word", "l.word")}, {_short("l.word", "t.word")}) as d from ({_cut("typed", "value")}) t join ({_cut("listed", "catalog_id")}) l using (rest) where t.word <> l.word) where d is not null),
nearest as (select *, min(distance) over (partition by value) as least from found),
matched as (select value, min(catalog_id) as catalog_id, any_value(distance) as distance, min(kind) as kind from nearest where distance = least group by value having min(catalog_id) = max(catalog_id))"""


ORACLES: dict[str, str] = {
    "p4_found": f"with {_MATCHED} select src_table, row_id, catalog_id from rows join matched using (value) where kind <> 'equal'",
    "p4_titles": f"with {_MATCHED} select src_table, row_id, value, catalog_id, distance, coalesce(kind, 'unmatched') as state from rows left join matched using (value) where row_id is not null and value is not null",
    "p4_unmatched": f"with {_MATCHED} select value, count(*) as n_rows from rows where value is not null and value not in (select value from matched) group by 1",
    "p1_found": f"""with {_LATEST},
df as (select term, count(*) as df from tf group by term)
select term, case when df <= 2 then 'rare' else 'common' end as mark from df, n where df <= 2 or df > 0.25 * n""",
    "p1_vocabulary": f"""with {_LATEST},
df as (select term, sum(tf)::bigint as occurrences, count(*) as document_frequency from tf group by term)
select term, coalesce(occurrences, 0) as occurrences, coalesce(document_frequency, 0) as document_frequency,
       case when document_frequency <= 2 then 'rare' when document_frequency > 0.25 * n then 'common' end as mark,
       v.document_frequency as stored_df, round(v.idf_value, 6) as stored_idf, round(ln(n / d.document_frequency), 6) as idf,
       case when d.term is null then 'orphan' when v.term is null then 'missing' when v.document_frequency = d.document_frequency then 'same' else 'lags' end as state
from df d full join vocabulary v using (term), n""".replace("coalesce(document_frequency, 0)", "coalesce(d.document_frequency, 0)").replace("when document_frequency", "when d.document_frequency"),
    "p2_found": f"""with {_CURRENT},
ranked as (select term, article, row_number() over (partition by term order by score desc, article) as rn from current where not isnan(score))
select term, article from ranked where rn <= 5""",
    "p2_ranked": f"""with {_CURRENT},
ranked as (select term, article, score, row_number() over (partition by term order by score desc, article) as rn from current where not isnan(score))
select term, rn::int as rank, article, round(score, 6) as score from ranked where rn <= 20""",
    "p7_decoded": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
    "p8_audit": "select count(*) as n_items, 0 as n_overfull, 0 as n_misplaced, 0 as n_split, true as well_filled from documents",
    "p9_audit": "select count(*) as n_documents, 0 as n_unknown, 0 as n_below, 0 as n_without_text, 0 as n_repeated from documents",
    "p6_found": _best("tf_idf", "article_id, term"),
    "p6_log_entropy": _best("log_entropy", "article_id, term, weight"),
    "p6_weights": f"""with {_LATEST}, {_ENTROPY}
select article_id, term, tf::int as tf, df, round(log_entropy, 5) as log_entropy, round(tf_idf, 5) as tf_idf from weighted""",
    "p6_compared": f"""with {_LATEST}, {_ENTROPY}, {_CURRENT},
stored as (select term, max(idf_value) as stored_idf from vocabulary group by 1)
select c.term, c.article, round(score, 5) as stored_score, round(stored_idf, 5) as stored_idf, tf::int as tf,
       round(case when tf is not null then ln(n / df) end, 5) as idf, round(tf_idf, 5) as tf_idf, round(log_entropy, 5) as log_entropy
from (select * from current where not isnan(score)) c left join weighted w on w.article_id = c.article and w.term = c.term left join stored s on s.term = c.term cross join n""",
}
