"""Sources, text, links, index, graph and integrity on small fixtures."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text, tokenizers
from lexmill.operators import corpus, graph, index, links, stats
from lexmill.sources import dumps, files
from lexmill.sources.store import Store
from lexmill.streaming.ingest import ingest_new


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "expected"), [("The Quick, brown foxes!", ["quick", "brown", "foxes"]), ("", []), (None, []), ("the cat and the dog", ["cat", "dog"])])
def test_tokens(spark, value, expected):
    assert one(spark, tokenizers.naive, value) == expected
    assert one(spark, tokenizers.word, value) == expected


def test_word_filters(spark):
    assert one(spark, tokenizers.word, "aaaa x 12345678901 1234567890 " + "ab" * 15 + " " + "z1" * 26 + " Déjà") == ["1234567890", "déjà"]


def test_gpt_tokens(spark):
    assert "".join(one(spark, tokenizers.gpt, "Hello  world")).replace(" ", "") == "Helloworld"
    assert one(spark, tokenizers.gpt, None) == []


def test_registry():
    assert tokenizers.tokenizer("naive") is tokenizers.naive
    with pytest.raises(ValueError):
        tokenizers.tokenizer("other")


@pytest.mark.parametrize(("value", "expected"), [("A%20b", "A b"), ("C++", "C++"), ("C%2B%2B", "C++"), ("100%", "100%"), ("", ""), (None, None)])
def test_unquote(spark, value, expected):
    assert one(spark, text.unquote, value) == expected
    assert one(spark, lambda c: text.unquote(c, exact=True), value) == expected


def test_html_and_snippets(spark):
    assert text.html_text("<p>a &amp; <b>b</b></p>") == "a & b" and text.html_text(" ") == "" and text.html_text(None) == ""
    assert one(spark, text.snippet, [None, " \t", " x " + "y" * 300], "array<string>") == "x " + "y" * 198 + "..."
    assert one(spark, text.snippet, None, "array<string>") == ""


@pytest.fixture
def dump(tmp_path):
    def write(folder, name, lines):
        (tmp_path / "dump" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "dump" / folder / name).write_bytes(bz2.compress("\n".join(lines).encode()))

    good = [
        json.dumps({"id": "12", "url": "u", "title": "Anarchism", "text": [["Anarchism"], ["See ", '<a href="Pierre-Joseph%20Proudhon">Proudhon</a> &amp; co'], None, [""]]}),
        "",
        json.dumps({"id": "13", "title": "Proudhon", "text": None}),
    ]
    write("AA", "wiki_00.bz2", good)
    write("AB", "wiki_01.bz2", [json.dumps({"id": "12", "title": "Again", "text": []})])
    write("AB", "other.bz2", ["{}"])
    return str(tmp_path / "dump"), write


def test_dump(spark, dump):
    root, write = dump
    assert [p.split("/")[-2:] for p in dumps.shards(root)] == [["AA", "wiki_00.bz2"], ["AB", "wiki_01.bz2"]]
    assert dumps.shards(root + "x") == [] and dumps.shards(root[:-5] + "none", fallback=True) == []
    articles, found = dumps.ingest(spark, root)
    rows = {r["page_id"]: r for r in articles.collect()}
    assert rows[12]["title"] == "Anarchism" and rows[12]["plain_text_paragraphs"] == ["Anarchism", "See Proudhon & co"] and rows[12]["paragraph_token_counts"] == [1, 3]
    assert rows[13]["plain_text_paragraphs"] == [] and len(rows) == 2
    assert [(r["from_page_id"], r["to_title"], r["anchor_text"]) for r in found.collect()] == [(12, "Pierre-Joseph Proudhon", "Proudhon")]
    assert dumps.ingest(spark, root, limit=1)[0].count() == 1
    with pytest.raises(FileNotFoundError):
        dumps.require_shards(root + "/AA")


def test_bad_records(spark, dump):
    root, write = dump
    write("AC", "wiki_02.bz2", ["{bad json", json.dumps({"id": "x", "title": None}), json.dumps({"id": "1"}), "[1]"])
    paths = dumps.shards(root)
    assert dumps.lines(spark, paths).count() == 7
    counts = {r["source"]: r["n"] for r in dumps.count_by_file(spark, paths).collect()}
    assert counts == {"AA/wiki_00.bz2": 2, "AB/wiki_01.bz2": 1, "AC/wiki_02.bz2": 1}
    assert dumps.records(spark, paths, "skip").count() >= 5
    with pytest.raises(Exception):
        dumps.records(spark, paths).collect()
    with pytest.raises(Exception, match="bad id"):
        dumps.decode(spark.createDataFrame([("x", None, "t", None, "f")], "id string, url string, title string, text array<array<string>>, file string")).collect()
    assert dumps.sample_shards(paths) == dumps.sample_shards(paths) and len(dumps.sample_shards(paths, 2)) == 2


def test_streaming_ingest(spark, dump, tmp_path):
    root, write = dump
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    assert ingest_new(spark, root, out, mark) == 1
    write("AD", "wiki_03.bz2", [json.dumps({"id": "99", "title": "New", "text": [["x"]]})])
    assert ingest_new(spark, root, out, mark) == 1
    assert sorted(r["page_id"] for r in spark.read.parquet(f"{out}/article_load").collect()) == [12, 12, 13, 99]


def test_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" a b \n\n c\n")
    assert [r["query"] for r in files.read_queries(spark, str(tmp_path / "q.txt"), 5).orderBy("query_id").collect()] == ["a b", "c", "a b", "c", "a b"]
    assert files.read_queries(spark, str(tmp_path / "q.txt")).count() == 2
    (tmp_path / "e.txt").write_text("\n")
    assert files.read_queries(spark, str(tmp_path / "e.txt"), 5).count() == 0
    (tmp_path / "qa.json").write_text(json.dumps([{"_id": "x", "question": "Q?", "answer": "A", "supporting_facts": [["T", 0], ["U", 1]], "context": []}, {"id": "y"}]))
    rows = files.qa_entries(spark, str(tmp_path / "qa.json")).orderBy("qa_id").collect()
    assert [r["qa_id"] for r in rows] == ["x", "y"] and rows[0]["supporting_facts"] == [["T", "0"], ["U", "1"]] and rows[1]["question"] == ""
    assert files.qa_entries(spark, str(tmp_path / "qa.json"), 1).count() == 1
    results = spark.createDataFrame([(0, 1, 5, "T", 0.5)], "query_id long, rank int, article_id long, title string, score double")
    files.write_results(results, files.read_queries(spark, str(tmp_path / "q.txt")), str(tmp_path / "csv"))
    assert "a b,1,5,T,0.500000" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    data = spark.createDataFrame([(8, "x", 3)], "cap int, id string, context_size int")
    assert json.loads(open(files.write_dataset_array(data, str(tmp_path / "d"), 8)).read()) == [{"id": "x", "context_size": 3}]
    assert files.write_report(data, str(tmp_path / "r.json"), run=1)["run"] == 1
    assert files.manifest(spark, str(tmp_path / "qa.json")).first()["length"] > 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("pagerank").count() == 0
    store.write("pagerank", spark.createDataFrame([(1, 0.5), (2, 0.5)], "article long, score double"), sort=["score"], partitions=2)
    store.write("pagerank", store.read("pagerank").where("article = 1"))
    assert store.count("pagerank") == 1 and store.statistics().first()["n_rows"] == 1
    assert store.truncate()["pagerank"] == 1 and store.count("pagerank") == 0


def test_resolve_links(spark):
    articles = spark.createDataFrame([(1, 101, "A"), (3, 103, "B"), (2, 102, "B")], "article_id long, page_id long, title string")
    rows = [(1, None, 101, None, "B"), (2, None, 101, None, "b"), (3, None, 999, None, "A"), (4, 3, 101, None, "A"), (5, None, None, None, "A"), (5, None, None, None, "A")]
    data = spark.createDataFrame(rows, "link_id long, from_article long, from_page_id long, to_article long, to_title string")
    found = {r["link_id"]: (r["from_article"], r["to_article"], r["updated"]) for r in links.resolve_links(data, articles).collect()}
    assert found == {1: (1, 2, True), 2: (None, None, False), 3: (None, None, False), 4: (3, 1, True), 5: (None, None, False)}
    assert links.resolve_links(data, articles).count() == 6
    assert links.link_counts(data.where("false")).first()["n_links"] == 0
    titles = spark.createDataFrame([("b",), ("A",), ("zz",)], "title string")
    assert {r["title"]: r["article_id"] for r in links.resolve_titles(titles, articles).collect()} == {"b": 2, "A": 1, "zz": None}


def test_rewrite(spark):
    articles = spark.createDataFrame([(1, 101, "A b")], "article_id long, page_id long, title string")
    pages = spark.createDataFrame([(5, ['x <a href="A%20b">one</a> and <a href="No">two</a>.', None, "plain"])], "page_id long, raw_paragraphs array<string>")
    assert links.rewrite_links(pages, articles).first()["paragraphs"] == ['x <a href="/article/101/">one</a> and two.', "", "plain"]


def test_index(spark):
    articles = spark.createDataFrame([(1, ["x y", None, "x"]), (2, ["x z"]), (3, [" "]), (4, None)], "article_id long, plain_text_paragraphs array<string>")
    tf = index.term_frequencies(articles)
    assert {tuple(r) for r in tf.collect()} == {(1, "x", 2), (1, "y", 1), (2, "x", 1), (2, "z", 1)}
    scores = {(r["article_id"], r["term"]): round(r["tf_idf_score"], 6) for r in index.inverted_index(tf, index.vocabulary(tf, 4)).collect()}
    assert scores[(1, "x")] == round(2 * 0.6931471805599453, 6)
    assert tuple(index.index_summary(tf, 4).first()) == (4, 3, 4, 1.0)


LINKS = [(1, 1, 2), (2, 1, 2), (3, 2, 3), (4, 3, 1), (5, 3, 3), (6, 1, 4), (7, None, 2), (8, 2, None)]


def plain_pagerank(edges, rounds, d=0.85):
    nodes = sorted({x for e in edges for x in e[:2]})
    out = {n: sum(w for s, _, w in edges if s == n) for n in nodes}
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        u = {n: (1 - d) / len(nodes) + d * sum(w / out[s] * r[s] for s, t, w in edges if t == n) for n in nodes}
        lost = sum(u[n] for n in nodes if not out[n])
        r = {n: u[n] + d * lost / len(nodes) for n in nodes}
    return r


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_pagerank(spark, one_task):
    data = spark.createDataFrame(LINKS, "link_id long, from_article long, to_article long")
    expected = plain_pagerank([(1, 2, 2), (2, 3, 1), (3, 1, 1), (1, 4, 1)], 4)
    found = {r["article"]: r["score"] for r in graph.pagerank(data, max_iter=4, tol=0.0, normalise=False, one_task_edges=one_task).scores.collect()}
    assert found == pytest.approx(expected)
    assert {r["node"] for r in graph.dangling(graph.edges(data)).collect()} == {4}
    none = graph.pagerank(data.where("false"), one_task_edges=one_task)
    assert (none.scores.count(), none.iterations, none.residual) == (0, 0, 0.0)


def test_pagerank_converges(spark):
    data = spark.createDataFrame(LINKS, "link_id long, from_article long, to_article long")
    done = graph.pagerank(data)
    assert done.residual < 1e-6 and sum(r["score"] for r in done.scores.collect()) == pytest.approx(1)
    assert graph.rank_stats(done.scores.where("false")).first()["sum_score"] == 0


def test_row_ids(spark):
    rows = spark.range(1000).selectExpr("cast(999 - id as string) as k").repartition(7)
    ids = {r["k"]: r["i"] for r in corpus.with_row_ids(rows, "i", ["k"]).collect()}
    assert [k for k, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(ids) and sorted(ids.values()) == list(range(1, 1001))


def test_two_random_needs_two(spark):
    with pytest.raises(ValueError):
        stats.two_random(spark.createDataFrame([(1, "a")], "article_id long, title string"))


def test_timing_of_few(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "v double")
    row = stats.timing_stats(rows, "v").first()
    assert (row["n"], row["median"], row["p95"]) == (3, 2.0, 4.0)
