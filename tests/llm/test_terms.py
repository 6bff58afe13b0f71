"""Term counts, weights and top-n against plain Python on tables with every kind of dirt."""

import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.llm import top_n, vocabulary, weights
from lexmill.llm.articles import STOP_WORDS

START = datetime(2024, 1, 1)
ARTICLE = "article_id long, plain_text_paragraphs array<string>, loaded_at timestamp, term string, text string, rn int, df long"
POSTING = "posting_id long, term string, article long, tf_idf_score double, indexed_at timestamp, score string, rank int, __n long"


def articles(spark, rows):
    return spark.createDataFrame([(a, p, None if t is None else START + timedelta(hours=t), "clash", "clash", 1, 2) for a, p, t in rows], ARTICLE)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "Apple", "pear's", "fig", "x1", "über", "K", "kiwi", "a"] + [f"w{i}" for i in range(40)]
    rows = []
    for a in range(60):
        for t in range(rng.choice([1, 1, 2, 3])):
            text = [None if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 3))]
            rows.append((a, rng.choice([text, text, text, None]), t))
    rows += [(a, p, t) for a, p, t in rows[:9]]
    rows += [(None, ["lost"], 1), (70, ["long " * 50_000 + "end"], None), (71, [], 0)]
    return rows


def current(rows):
    best = {}
    for a, p, t in rows:
        key = (-1 if t is None else t, " ".join(x for x in p or [] if x is not None))
        if a is not None and (a not in best or key > best[a]):
            best[a] = key
    return {a: Counter(w for w in re.findall("[a-z0-9]+", k[1].lower()) if w not in STOP_WORDS) for a, k in best.items()}


@pytest.mark.parametrize("max_heavy", [0, 5, 1000])
def test_frequencies(spark, max_heavy):
    rows = corpus(1)
    tf = current(rows)
    df, n = Counter(w for c in tf.values() for w in c), sum(tf.values(), Counter())
    found = {r["term"]: (r["occurrences"], r["document_frequency"]) for r in vocabulary.term_frequencies(articles(spark, rows).repartition(5), max_heavy=max_heavy).collect()}
    assert found == {w: (n[w], df[w]) for w in n}
    marks = {r["term"]: r["mark"] for r in vocabulary.useless_terms(articles(spark, rows)).collect()}
    assert marks == {w: "rare" if c <= 2 else "common" for w, c in df.items() if c <= 2 or c > 0.25 * len(tf)}


def test_many_light_terms_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "LIGHT_TERMS", 3)
    rows = corpus(2)
    n = sum(current(rows).values(), Counter())
    batches = [r for r in vocabulary._counter([])(iter([__import__("pyarrow").record_batch([[" ".join(p or [])]], names=["t"]) for p in (["b c d e"], ["b b"], None)]))]
    assert sum(sum(x for x in b.column(1).to_pylist()) for b in batches) == 6 and len(batches) == 2 and n


def test_vocabulary_states(spark):
    stored = spark.createDataFrame([("fig", 1, 0.5), ("gone", 3, None), ("kiwi", 2, 0.1), ("kiwi", 1, 0.9), (None, 4, 0.0)], "term string, document_frequency long, idf_value double")
    rows = [(1, ["fig kiwi"], 0), (2, ["kiwi new"], 0)]
    found = {r["term"]: (r["state"], r["document_frequency"], r["stored_df"]) for r in vocabulary.vocabulary(articles(spark, rows), stored).collect()}
    assert found == {"fig": ("same", 1, 1), "gone": ("orphan", 0, 3), "kiwi": ("same", 2, 2), "new": ("missing", 1, None)}


def test_empty_articles(spark):
    none = articles(spark, [])
    assert vocabulary.term_frequencies(none).count() == 0 and vocabulary.useless_terms(none).count() == 0
    w = weights.term_weights(none)
    assert weights.most_distinctive(w).count() == 0 and weights.weighted_terms(w).count() == 0
    only = weights.term_weights(articles(spark, [(1, [None, " "], 0), (2, None, 0)]))
    assert weights.most_distinctive(only).count() == 0 and only.n_articles == 2


@pytest.mark.parametrize("max_broadcast", [0, 10, 10**6])
def test_weights(spark, max_broadcast):
    rows = corpus(3)
    tf = current(rows)
    df, gf, n = Counter(w for c in tf.values() for w in c), sum(tf.values(), Counter()), len(tf)
    share = defaultdict(list)
    for c in tf.values():
        for w, k in c.items():
            share[w].append(k / gf[w])
    spread = {w: -sum(p * math.log(p) for p in ps) / math.log(n) for w, ps in share.items()}
    entropy = {(a, w): math.log(1 + k) * (1 - spread[w]) for a, c in tf.items() for w, k in c.items()}
    tf_idf = {(a, w): k * math.log(n / df[w]) for a, c in tf.items() for w, k in c.items()}
    model = weights.term_weights(articles(spark, rows))
    found = weights.weighted_terms(model, max_broadcast).collect()
    assert {(r["article_id"], r["term"]): pytest.approx(r["log_entropy"], abs=1e-9) for r in found} == entropy
    assert {(r["article_id"], r["term"]): pytest.approx(r["tf_idf"], abs=1e-9) for r in found} == tf_idf
    for scheme, values in ((weights.TF_IDF, tf_idf), (weights.LOG_ENTROPY, entropy)):
        best = {a: min((-round(values[a, w], 6), w) for w in c)[1] for a, c in tf.items() if c}
        assert {r["article_id"]: r["term"] for r in weights.most_distinctive(model, scheme, max_broadcast).collect()} == best


def postings(spark, rows):
    return spark.createDataFrame([(i, t, a, s, None if w is None else START + timedelta(hours=w), "x", 9, 1) for i, t, a, s, w in rows], POSTING)


def test_current_scores(spark):
    nan = float("nan")
    rows = [(1, "a", 1, 0.5, 1), (2, "a", 1, 0.7, 2), (3, "a", 2, 0.5, 1), (4, "a", 2, None, 2), (5, "a", 3, nan, 5), (6, "a", 4, 0.1, 1), (7, "a", 4, 0.2, 1), (8, None, 1, 1.0, 1), (9, "b", None, 1.0, 1), (10, "b", 1, -0.0, None), (11, "b", 2, 0.0, None)]
    found = {(r["term"], r["article"]): r["score"] for r in top_n.current_scores(postings(spark, rows)).collect()}
    assert found == {("a", 1): 0.7, ("a", 4): 0.2, ("b", 1): 0.0, ("b", 2): 0.0}
    assert math.copysign(1, found["b", 1]) == 1


@pytest.mark.parametrize(("n", "thresholds"), [(1, 0), (5, 2), (5, 1000), (0, 10)])
def test_top_n(spark, n, thresholds):
    rng = random.Random(n)
    data = [(g, i, rng.choice([0.0, 1.0, -2.5, 1e-300, 1e300, float("inf"), -float("inf"), rng.gauss(0, 10), round(rng.random(), 1)])) for g, size in (("hot", 900), ("warm", 60), ("small", 3)) for i in range(size)]
    data += [("ties", i, 1.0) for i in range(200)]
    frame = spark.createDataFrame([(*x, "clash") for x in data], "g string, i long, s double, item string").repartition(6)
    best = {g: [(r, i) for r, (_, i) in enumerate(sorted((-s, i) for h, i, s in data if h == g)[:n], 1)] for g in ("hot", "warm", "small", "ties")}
    found = defaultdict(list)
    for r in top_n.top_n_per_group(frame, "g", "s", ["i"], n, thresholds).collect():
        found[r["g"]].append((r["rank"], r["i"]))
    assert {g: sorted(v) for g, v in found.items()} == {g: v for g, v in best.items() if v}


def test_score_bins_never_fall(spark):
    values = sorted({x * s for x in [0.0, 5e-324, 1e-300, 1e300, float("inf")] + [1.0 + k * 2**-52 for k in range(5)] + [random.Random(4).lognormvariate(0, 30) for _ in range(500)] for s in (1, -1)})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", top_n.score_bin(F.col("v")).alias("b")).collect()
    bins = [r["b"] for r in sorted(rows, key=lambda r: r["v"])]
    assert bins == sorted(bins)


def test_nulls_and_nothing_to_rank(spark):
    frame = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("g", 3, None), ("g", 4, float("nan")), ("g", 5, 0.1)], "g string, i long, s double")
    found = {(r["g"], r["rank"]): r["i"] for r in top_n.top_n_per_group(frame, "g", "s", ["i"], 2).collect()}
    assert found == {(None, 1): 2, (None, 2): 1, ("g", 1): 4, ("g", 2): 5}
    assert top_n.top_n_per_group(frame.where("false"), "g", "s", ["i"], 2).count() == 0
