"""Hybrid search, evaluation and question answering on small fixtures with known results."""

import math

import pytest

from lexmill.operators import evaluate, qa, search
from lexmill.operators.search import HybridParams

ARTICLES = [(1, "Python Programming", ["Python is a programming language."]), (2, "Snake", ["Pythons are large snakes."]), (3, "Java Programming", ["Java is another programming language."])]
POSTINGS = [("python", 1, 0.8), ("programming", 1, 0.7), ("language", 1, 0.6), ("python", 2, 0.9), ("snake", 2, 0.5), ("java", 3, 0.8), ("programming", 3, 0.7), ("language", 3, 0.6)]
VOCABULARY = [("python", 2, 0.5), ("programming", 2, 0.5), ("language", 2, 0.5), ("snake", 1, 1.0), ("java", 1, 1.0)]
RANKS = [(1, 0.3), (2, 0.1), (3, 0.2)]


@pytest.fixture(scope="module")
def corpus(spark):
    return (
        spark.createDataFrame(VOCABULARY, "term string, document_frequency long, idf_value double"),
        spark.createDataFrame(POSTINGS, "term string, article long, tf_idf_score double"),
        spark.createDataFrame(RANKS, "article long, score double"),
        spark.createDataFrame(ARTICLES, "article_id long, title string, plain_text_paragraphs array<string>"),
    )


def run(spark, corpus, query, **params):
    queries = spark.createDataFrame([(7, query)], "query_id long, query string")
    rows = search.search_hybrid(queries, *corpus, HybridParams(**params)).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["title"], round(r["score"], 6)) for r in rows]


@pytest.mark.parametrize(
    ("query", "params", "expected"),
    [
        ("python", {}, [("Python Programming", 0.996111), ("Snake", 0.9)]),
        ("python programming", {}, [("Python Programming", 1.5)]),
        ("programming", {"limit": 1}, [("Python Programming", 1.05)]),
        ("python", {"alpha": 1.0}, [("Snake", 1.0), ("Python Programming", 0.977778)]),
        ("python", {"alpha": 0.0}, [("Python Programming", 1.1), ("Snake", 0.333333)]),
        ("quantum physics", {}, []),
        ("", {}, []),
        (None, {}, []),
        ("the and or", {}, []),
        ("python zzzz", {}, []),
        ("python python", {}, []),
        ("100% python", {}, []),
    ],
)
def test_goldens(spark, corpus, query, params, expected):
    assert run(spark, corpus, query, **params) == expected


def test_candidate_without_rank_gets_the_median(spark, corpus):
    vocab, postings, _, articles = corpus
    ranks = spark.createDataFrame([(1, 0.3)], "article long, score double")
    assert dict(run(spark, (vocab, postings, ranks, articles), "python", alpha=0.0)) == {"Python Programming": 1.1, "Snake": 1.0}
    none = ranks.where("false")
    assert dict(run(spark, (vocab, postings, none, articles), "python", alpha=0.0)) == {"Python Programming": 0.0, "Snake": 0.0}


def test_posting_lists_are_cut(spark, corpus):
    assert [t for t, _ in run(spark, corpus, "python", max_candidates=1)] == ["Snake"]


def test_unknown_policy():
    with pytest.raises(ValueError):
        HybridParams(policy="any")


def test_fallback_to_titles(spark, corpus):
    queries = spark.createDataFrame([(1, "snake"), (2, "JAVA programming"), (3, "Bird"), (4, "zzz snake")], "query_id long, query string")
    rows = search.search_with_fallback(queries, *corpus, HybridParams(policy="strict")).collect()
    assert {(r["query_id"], r["via"]) for r in rows} == {(1, "hybrid"), (2, "hybrid")}
    empty = corpus[1].where("false")
    rows = search.search_with_fallback(queries, corpus[0], empty, corpus[2], corpus[3]).collect()
    assert {(r["query_id"], r["title"], r["score"], r["via"]) for r in rows} == {(1, "Snake", 1.0, "title"), (2, "Java Programming", 1.0, "title")}


@pytest.mark.parametrize(
    ("rels", "k", "ndcg", "mrr", "p5", "p10", "recall"),
    [
        ([0, 1, 0, 1], 10, (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)), 0.5, 0.0, 0.0, 0.5),
        ([], 10, 0.0, 0.0, 0.0, 0.0, 0.0),
        ([1, 1, 1, 1], 10, 1.0, 1.0, 0.0, 0.0, 1.0),
        ([1, 0, 0, 0, 1] + [0] * 5, 10, (1 + 1 / math.log2(6)) / (1 + 1 / math.log2(3)), 1.0, 0.4, 0.2, 0.5),
    ],
)
def test_metrics(spark, rels, k, ndcg, mrr, p5, p10, recall):
    relevant = spark.createDataFrame([(1, f"t{i}") for i, r in enumerate(rels) if r] + [(1, f"other{i}") for i in range(4 - sum(rels))], "query_id long, title string")
    results = spark.createDataFrame([(1, i + 1, f"t{i}") for i in range(len(rels))], "query_id long, rank int, title string")
    row = evaluate.query_metrics(evaluate.relevances(results, relevant), relevant, k).first()
    assert [round(x, 9) for x in row[1:]] == [round(x, 9) for x in (ndcg, mrr, p5, p10, recall)]


def test_first_best_of_the_grid(spark):
    grid = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.5)], "grid_order int, ndcg double")
    assert evaluate.best_by(grid, "ndcg").first()["grid_order"] == 1
    assert [p.alpha for p in evaluate.parameter_grid(alpha=[0.1, 0.2], limit=[5, 6])] == [0.1, 0.1, 0.2, 0.2]


# --- question answering ---


def entry(spark, *facts, question="What is Alpha?", answer="Alpha"):
    return spark.createDataFrame([("q1", question, answer, [[t, "0"] for t in facts])], "qa_id string, question string, answer string, supporting_facts array<array<string>>")


def test_supporting_titles_once_whatever_the_case(spark):
    assert [(r["pos"], r["title"]) for r in qa.supporting_titles(entry(spark, "Alpha", "ALPHA", "Beta", None)).orderBy("pos").collect()] == [(0, "Alpha"), (2, "Beta")]


def test_status(spark):
    sized = spark.createDataFrame([(10, "Alpha", 50), (11, "Beta", 500)], "article_id long, title string, n_tokens long")
    for facts, status in ((["Alpha"], "processed"), (["Alpha", "Gone"], "skipped_missing"), (["Beta"], "skipped_overflow"), ([], "no_facts")):
        e = entry(spark, *facts)
        assert qa.entry_status(e, qa.supporting_documents(e, sized), (100,)).first()["status"] == status, facts


@pytest.mark.parametrize("variant", ["build", "generate"])
def test_greedy_skips_what_does_not_fit(spark, variant):
    sized = spark.createDataFrame([(1, "Alpha", 3), (2, "A", 5), (3, "B", 9), (4, "C", 2), (5, "D", 4), (6, "E", 1)], "article_id long, title string, n_tokens long")
    e = entry(spark, "Alpha", answer="x")
    support = qa.supporting_documents(e, sized)
    status = qa.entry_status(e, support, (8, 10, 12))
    hits = {"Alpha": [1, 2, 3], "What is Alpha?": [4, 5, 6]}

    def find(queries, params):
        rows = [(q, i + 1, a, {1: "Alpha", 2: "A", 3: "B", 4: "C", 5: "D", 6: "E"}[a]) for q, ids in hits.items() for i, a in enumerate(ids)]
        found = spark.createDataFrame(rows, "query_id string, rank int, article_id long, title string")
        return found.join(queries.select("query_id"), "query_id", "left_semi")

    params = qa.QAParams(caps=(8, 10, 12), min_tokens=2, variant=variant)
    chosen = qa.select_distractors(e, support, status, sized, find, params)
    rows = chosen.orderBy("place").collect()
    assert [r["title"] for r in rows] == ["A", "C"]  # B exceeds the cap, D does not fit after C, E is too short
    slices = {r["cap"]: (r["n_distractors"], r["context_size"]) for r in qa.context_slices(status, chosen, params.caps).collect()}
    assert slices == {8: (1, 8), 10: (2, 10), 12: (2, 10)}
    articles = spark.createDataFrame([(i, t, ["p1", None, "p2"]) for i, t in ((1, "Alpha"), (2, "A"), (4, "C"))], "article_id long, title string, plain_text_paragraphs array<string>")
    done = qa.dataset(e, support, chosen, qa.context_slices(status, chosen, params.caps), articles).where("cap = 12").first()
    assert [d["title"] for d in done["distractor_docs"]] == ["A", "C"] and done["supporting_docs"][0]["text"] == "p1\np2"


def test_support_above_a_cap(spark):
    status = spark.createDataFrame([("q", "processed", 20)], "qa_id string, status string, supporting_tokens long")
    none = spark.createDataFrame([], "qa_id string, place int, n_tokens long")
    assert {r["cap"]: r["context_size"] for r in qa.context_slices(status, none, (8, 32)).collect()} == {8: 20, 32: 20}
    assert {r["cap"] for r in qa.context_slices(status, none, (8, 32), "generate").collect()} == {32}


def test_empty_index(spark, corpus):
    with pytest.raises(ValueError):
        qa.validate_index(corpus[0].where("false"), corpus[1])
    qa.validate_index(corpus[0], corpus[1])
    with pytest.raises(ValueError):
        qa.QAParams(caps=())
