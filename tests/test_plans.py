"""What the physical plans must keep: limits before the shuffle, pruned scans, hashed aggregates, no cross joins."""

import re

import pytest

from lexmill.operators import corpus, graph, index, references, search
from lexmill.operators.search import HybridParams
from lexmill.plans import core
from lexmill.session import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_posting_lists_are_cut_before_the_shuffle(spark, sf):
    text = plan(index.top_postings(corpus.current_postings(table(spark, sf, "inverted_index")), 10))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_what_is_needed(spark, sf):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(graph.edges(table(spark, sf, "internal_link"))))
    assert read == ["from_article:bigint,to_article:bigint"]
    text = plan(graph.edges(table(spark, sf, "internal_link")))
    assert "IsNotNull(from_article)" in text and "IsNotNull(to_article)" in text


def test_first_links_are_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(references.first_links(table(spark, sf, "internal_link")))


def test_search_is_one_plan_without_cross_joins(spark, sf):
    rows = search.search_hybrid(core.catalog_queries(spark, sf), *core._index(spark, sf), core.titles(spark, sf), HybridParams())
    text = plan(rows)
    assert "CartesianProduct" not in text and "Python" not in text and text.count("WindowGroupLimit") >= 3


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p5_terms", "p5_articles"])
def test_problems_have_no_cross_join_or_python(spark, sf, name):
    from lexmill.plans import problems

    text = plan(problems.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text
