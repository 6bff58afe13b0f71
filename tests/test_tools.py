"""Settings, locks, samples, exact percentiles, guards, replaced tables and kept counts, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lexmill.operators import corpus, graph, links, qa, references, settings, skew, stats
from lexmill.sources.store import ASIDE, Store


def test_sizes_and_times(spark):
    rows = {"64MB": 64, "512kB": 0, "2048kb": 2, "1.5GB": 1536, "1TB": 1 << 20, " 3 mb ": 3, "3145728": 3, "": 0, None: 0, "many": None}
    found = spark.createDataFrame([(x,) for x in rows], "v string").select("v", settings.size_mb(F.col("v")).alias("mb")).collect()
    assert {r["v"]: r["mb"] for r in found} == rows
    rows = {"30s": 30, "5min": 300, "2h": 7200, "1d": 86400, "15": 15, "1.5h": 5400, "": 0, None: 0, "soon": None}
    found = spark.createDataFrame([(x,) for x in rows], "v string").select("v", settings.seconds(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in found} == rows


def test_settings(spark):
    rules = [("a", "size", 16.0, 64.0, None, None), ("b", "option", None, None, "on", ["on", "off"]), ("c", "contains", None, None, None, ["x"]), ("d", "number", 1.0, None, None, None)]
    have = [("A", "8MB"), ("a", "32MB"), ("a", "1GB"), ("a", "?"), ("b", "ON"), ("b", "off"), ("b", "maybe"), ("b", None), ("c", "wxy"), ("c", ""), ("d", "7"), ("e", "7")]
    out = settings.check_settings(spark.createDataFrame(have, "name string, value string"), spark.createDataFrame(rules, settings.RULES)).collect()
    assert {(r["name"], r["value"]): r["status"] for r in out} == dict(zip(have, ["warning", "ok", "warning", "error", "ok", "warning", "error", "error", "ok", "warning", "ok", "unknown"], strict=True))
    assert settings.session_settings(spark).where("name = 'spark.sql.shuffle.partitions'").count() == 1


def test_blocked(spark):
    locks = [("t", 1, 10, True), ("t", 1, 11, False), ("t", 1, 11, False), ("t", 1, 12, True), ("t", None, 13, False), ("t", None, 14, True), ("u", 1, 15, False), ("u", None, None, False)]
    frame = spark.createDataFrame(locks, "kind string, relation long, pid long, granted boolean")
    found = {(r["kind"], r["relation"], r["pid"], r["n_blockers"], r["first_blocker"]) for r in stats.blocked(frame, ["kind", "relation"]).collect()}
    assert found == {("t", 1, 11, 2, 10), ("t", None, 13, 1, 14)}
    assert stats.blocked(frame.where("false"), ["kind", "relation"]).count() == 0


def test_exact_percentiles(spark):
    rng = random.Random(3)
    data = [("a", rng.lognormvariate(0, 3)) for _ in range(700)] + [("b", 7.0)] * 400 + [(None, float(rng.randint(-5, 5))) for _ in range(333)] + [("c", 0.0), ("c", -1.0), ("d", None)]
    found = {r["k"]: r for r in stats.timing_stats(spark.createDataFrame(data, "k string, v double"), "v", "k").collect()}
    assert set(found) == {"a", "b", None, "c"}
    for key, row in found.items():
        values = [v for k, v in data if k == key]
        assert row["median"] == pytest.approx(statistics.median(values)) and row["mean"] == pytest.approx(statistics.mean(values))
        p95 = statistics.quantiles(values, n=100, method="inclusive")[94] if len(values) >= 5 else max(values)
        assert row["p95"] == pytest.approx(p95), key
    assert stats.timing_stats(spark.createDataFrame(data, "k string, v double").where("false"), "v", "k").count() == 0


def test_sample_to(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, t string")
    found = stats.sample_to(rows, "id", 12).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(12)) and {r["id"] for r in found[:5]} == set(range(5))
    assert found == stats.sample_to(rows.repartition(3), "id", 12).orderBy("place").collect()
    assert stats.sample_to(rows.where("false"), "id", 3).count() == 0 and stats.sample_to(rows, "id", 2).count() == 2


def test_statement_classes(spark):
    data = [("select 1 from Article", 1.0), ("SELECT InvertedIndex, Article", 0.5), ("Select x from PageRank", None), ("select 2", 1.0), ("update Article", 1.0), (None, 2.0)]
    found = {r["query_type"]: (r["n"], r["seconds"], r["row_by_row"]) for r in stats.classify_statements(spark.createDataFrame(data, "statement string, s double"), seconds="s").collect()}
    assert found == {"Article lookup": (2, 1.5, False), "PageRank": (1, 0.0, False), "Other SELECT": (1, 1.0, False), "Non-SELECT": (2, 3.0, False)}
    many = spark.createDataFrame([("insert into Article",)] * 11, "statement string")
    assert stats.classify_statements(many).first()["row_by_row"]


def test_throughput_guard():
    assert qa.Target(20.0).check(19, 100)["below_target"] is False
    assert qa.Target(20.0).check(20, 100) == {"throughput": 0.2, "below_target": True}
    assert qa.Target(20.0).check(40, 1)["below_target"] is False and qa.Target(1.0).check(30, 0)["throughput"] == 0.0


def test_fallbacks_are_counted_and_not_repeated(spark):
    rows = [("q", 0, 0, "T"), ("q", 1, 0, "T"), ("q", 1, 1, "U"), ("q", 1, 2, "V"), ("q", 1, 3, "U")]
    kept = qa.asked_queries(spark.createDataFrame(rows, "qa_id string, kind int, pos int, query string"), 1).collect()
    assert {(r["kind"], r["query"]) for r in kept} == {(0, "T"), (1, "U")}


def test_a_table_moved_aside_is_put_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("pagerank", spark.createDataFrame([(1, 0.5)], "article long, score double"))
    (tmp_path / "s" / "pagerank.parquet").rename(tmp_path / "s" / f"{ASIDE}pagerank")
    assert store.count("pagerank") == 1
    store.write("pagerank", spark.createDataFrame([(1, 0.5), (2, 0.1)], "article long, score double"))
    assert store.count("pagerank") == 2 and not list((tmp_path / "s").glob(f"{ASIDE}*"))


def test_salted_sides(spark):
    """A key with many rows on the one side and several on the other meets each pair once, whatever is called heavy."""
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 400 + [None] * 50 + [2] * 30 + [3])], "k long, i long").repartition(5)
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    expected = sorted(map(tuple, big.join(small, "k").select("k", "i", "v").collect()))
    for heavy in ({}, {1: 400}, {1: 400, 2: 30}, [1, 2]):
        a, b = skew.salted(big, small, "k", heavy)
        assert sorted(map(tuple, a.join(b, ["k", "__salt"]).select("k", "i", "v").collect())) == expected
    a, _ = skew.salted(big, small, "k", {1: 400, 2: 30})
    assert a.where("k = 1").select("__salt").distinct().count() > 5


def test_counts_are_kept_up_to_date(spark):
    counts = "space string, key string, n_refs long, n_existing long"
    old = spark.createDataFrame([("title", "A", 2, 1), ("title", "B", 1, 0), ("title", "C", 1, 1)], counts)
    change = spark.createDataFrame([("title", "A", 0, -1), ("title", "B", -1, 0), ("title", "D", 3, 0)], counts)
    now = references.add_counts(old, change)
    assert {tuple(r) for r in now.collect()} == {("title", "A", 2, 0), ("title", "C", 1, 1), ("title", "D", 3, 0)}
    assert {r["key"] for r in references.orphans_of(now).collect()} == {"A", "D"}


def test_article_detail(spark):
    rows = [(1, 101, "A", ['<a href="B">b</a>', None]), (2, 102, "B", None)]
    articles = spark.createDataFrame(rows, "article_id long, page_id long, title string, plain_text_paragraphs array<string>")
    assert links.article_detail(articles, 101).first()["paragraphs"] == ['<a href="/article/102/">b</a>', ""]
    assert links.article_detail(articles, 102).first()["paragraphs"] == [] and links.article_detail(articles, 9).count() == 0


def test_both_ways_of_pagerank_end_alike(spark):
    rng = random.Random(2)
    data = spark.createDataFrame([(i, rng.randint(1, 12), rng.randint(1, 15)) for i in range(60)], "link_id long, from_article long, to_article long")
    one, many = graph.pagerank(data), graph.pagerank(data, one_task_edges=0)
    assert one.iterations == many.iterations and one.residual == pytest.approx(many.residual)
    assert {r["article"]: r["score"] for r in many.scores.collect()} == pytest.approx({r["article"]: r["score"] for r in one.scores.collect()})


def test_current_columns_are_those_of_the_current_rows(spark):
    rows = [(1, 1, "a", ["x"]), (1, 2, "b", ["y"]), (2, 5, "c", ["p"]), (2, 5, "d", ["q"]), (2, 5, "e", None), (3, None, "f", ["z"]), (3, 1, "g", None), (4, None, "h", None), (5, 7, "i", ["i"]), (5, 7, "i", ["i"]), (None, 1, "n", ["n"])]
    frame = spark.createDataFrame(rows, "article_id long, at long, title string, plain_text_paragraphs array<string>").withColumn("loaded_at", F.timestamp_seconds("at"))
    for data in (frame, frame.where("article_id <> 2"), frame.where("false")):
        whole = {(r["article_id"], r["title"]) for r in corpus.current_articles(data).collect()}
        slim = corpus.current_columns(data, "title").collect()
        assert {tuple(r) for r in slim} == whole and len(slim) == len(whole)


def test_parity_of_nothing(spark):
    assert corpus.parity_errors(spark.createDataFrame([(1, None, None)], "article_id long, plain_text_paragraphs array<string>, paragraph_token_counts array<int>")).count() == 0
