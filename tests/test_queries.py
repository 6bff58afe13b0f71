"""Every query of the core against its SQL on the smallest tables; those without SQL must run and have rows."""

import pytest
from compare import compare

from lexmill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare(df, duck, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "article_id", "title", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_llm():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "lexmill"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"lexmill\.llm|from \.llm", path.read_text()), path


def test_mean_paragraphs_is_over_all_articles(spark):
    from lexmill.operators import stats

    rows = [(i, ["x"] if i <= 1000 else ["x"] * 5) for i in range(1, 2001)] + [(2001, None), (2002, [])]
    frame = spark.createDataFrame(rows, "article_id long, plain_text_paragraphs array<string>")
    assert stats.mean_paragraphs(frame).first()["avg_paragraphs"] == 6000 / 2002
    assert "mean_paragraphs" in QUERIES and "limit" not in SQL["mean_paragraphs"]
