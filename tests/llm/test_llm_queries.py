"""The training-data queries against their SQL on the smallest tables; those without SQL must run."""

import pytest
from compare import compare

from lexmill.llm import queries as llm
from lexmill.llm.articles import STOP_WORDS

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare(df, duck, SQL[name]) == ""
    else:
        assert df.count() > 0


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p1_found", ["term", "mark"]), ("p2_found", ["term", "article"]), ("p4_found", ["src_table", "row_id", "catalog_id"]), ("p6_found", ["article_id", "term"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "subject"])],
)
def test_columns(spark, sf, name, columns):
    assert QUERIES[name](spark, sf).columns == columns


def test_every_term_of_every_article_is_weighed(spark, sf, duck):
    texts = "select article_id, arg_max(txt, (loaded_at, txt)) as txt from (select article_id, loaded_at, coalesce(array_to_string(plain_text_paragraphs, ' '), '') as txt from article) group by 1"
    words = f"select distinct article_id, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) as term from ({texts})"
    pairs = set(duck.execute(f"select * from ({words}) where term not in ('{"', '".join(STOP_WORDS)}')").fetchall())
    rows = QUERIES["p6_weights"](spark, sf).collect()
    assert len(rows) == len(pairs) and {(r["article_id"], r["term"]) for r in rows} == pairs
