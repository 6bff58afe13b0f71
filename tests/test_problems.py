"""References to missing records, and keys that hold most records, against plain Python on random and extreme tables."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.operators import references, skew

START = datetime(2024, 1, 1)
LINK = "link_id long, from_article long, from_page_id long, to_article long, to_title string, loaded_at timestamp, key string, ts long, alive int"
ARTICLE = "article_id long, page_id long, title string, loaded_at timestamp, alive string, delta int"
GONE = "article_id long, page_id long, deleted_at timestamp, key int"


def at(i):
    return None if i is None else START + timedelta(hours=7 * i)


def tables(spark, links, articles, gone):
    return (
        spark.createDataFrame([(*x[:5], at(x[5]), "k", 1, 2) for x in links], LINK),
        spark.createDataFrame([(*x[:3], at(x[3]), "a", 9) for x in articles], ARTICLE),
        spark.createDataFrame([(x[0], x[1], at(x[2]), 4) for x in gone], GONE),
    )


def plain(links, articles, gone):
    """The state of each article at a time decides."""

    def there(ids, when):
        for a in ids:
            events = sorted([(t, 1) for i, _, _, t in articles if i == a and t is not None and t <= when] + [(t, 0) for i, _, t in gone if i == a and t is not None and t <= when])
            if events and events[-1][1]:
                return True
        return False

    out, first = set(), {}
    for x in links:
        if x[0] not in first or (x[5] is not None and (first[x[0]][5] is None or x[5] < first[x[0]][5])):
            first[x[0]] = x
    for link_id, f, p, t, title, when in first.values():
        named = {"from_article": {f}, "from_page_id": {i for i, page, _, _ in articles if page == p}, "to_article": {t}, "to_title": {i for i, _, n, _ in articles if n == title}}
        for field, value in (("from_article", f), ("from_page_id", p), ("to_article", t), ("to_title", title)):
            if value is not None and (when is None or not there(named[field], when)):
                out.add((link_id, field))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_references(spark, seed):
    rng = random.Random(seed)
    names = {i: (100 + i, rng.choice(["A", "B", "C", "D"])) for i in range(8)}
    articles = [(i, *names[i], rng.randint(0, 60)) for i in [rng.randint(0, 7) for _ in range(14)]]
    gone = [(i, rng.choice([None, 100 + i]), rng.randint(0, 60)) for i in [rng.randint(0, 8) for _ in range(14)]] + [(1, None, 5)] * 3
    some = lambda x: rng.choice([None, x, x, x])
    links = [(i, some(rng.randint(0, 9)), some(100 + rng.randint(0, 9)), some(rng.randint(0, 9)), rng.choice("ABCDE"), rng.choice([None, *range(61)])) for i in range(60)]
    links += [(*x[:5], (x[5] or 0) + 1) for x in links[:20]]
    found = references.check_references(*tables(spark, links, articles, gone), orphans_only=True).collect()
    assert {(r["link_id"], r["ref_field"]) for r in found} == plain(links, articles, gone) and len(found) == len({tuple(r) for r in found})


def test_references_to_a_changed_title(spark):
    data = tables(spark, [(1, None, None, None, "Old", 5), (2, None, None, None, "Old", 15), (3, None, None, None, "New", 15)], [(7, 1, "Old", 0), (7, 1, "New", 10)], [])
    assert {r["link_id"] for r in references.check_references(*data, orphans_only=True).collect()} == {2}


def test_references_without_tables(spark):
    links, articles, gone = tables(spark, [(1, 5, None, None, "T", 3)], [], [])
    assert references.check_references(links, articles, gone, True).count() == 2
    assert references.check_references(links.where("false"), articles, gone).count() == 0
    assert references.current_orphans(links, articles, gone).count() == 2


def test_report_and_current_orphans(spark):
    data = tables(spark, [(1, 7, 1, 8, "T", 5), (1, 7, 1, 8, "T", 6), (2, 7, None, None, "Gone", None)], [(7, 1, "T", 0)], [(7, None, 9)])
    report = {(r["ref_field"], r["month"]): (r["n_refs"], r["n_orphans"]) for r in references.orphan_report(*data).collect()}
    assert report[("to_article", "2024-01")] == (1, 1) and report[("to_title", "2024-01")] == (1, 0) and report[("to_title", None)] == (1, 1)
    assert {(r["space"], r["key"], r["n_refs"]) for r in references.current_orphans(*data).collect()} == {("article", "7", 2), ("article", "8", 1), ("page", "1", 1), ("title", "T", 1), ("title", "Gone", 1)}


def test_skew_join(spark):
    rng = random.Random(1)
    keys = [1] * 500 + [None] * 300 + [rng.randint(2, 90) for _ in range(400)]
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(6)
    small = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k long, v string")
    _, heavy = skew.heavy_keys(big, "k", min_share=0.1)
    assert heavy["k"] == [1]
    for how in ("inner", "left"):
        mine = Counter(map(tuple, skew.skew_join(big, small, "k", how, heavy=heavy["k"]).select("k", "i", "v").collect()))
        theirs = Counter(map(tuple, big.join(small, "k", how).select("k", "i", "v").collect()))
        assert mine == theirs
    with pytest.raises(ValueError):
        skew.skew_join(big.withColumn("V", F.lit(1)), small, "k")
    with pytest.raises(ValueError):
        skew.skew_join(big, small, "k", "full")
    assert skew.skew_join(big.where("false"), small, "k", "left").count() == 0


def test_per_key_results(spark):
    keys = ["a"] * 400 + ["b"] * 5 + [None] * 7 + ["c"]
    rows = spark.createDataFrame([(k, float(i)) for i, k in enumerate(keys)], "k string, x double")
    more = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, w double")
    out = {r["k"]: r for r in skew.per_key_results(rows, "k", [F.count(F.lit(1)).alias("n"), F.max("w").alias("w")], more, min_share=0.1).collect()}
    assert {k: (r["n"], r["w"], r["is_heavy"]) for k, r in out.items()} == {"a": (400, 1.5, True), "b": (5, None, False), "c": (1, None, False)}
    assert {tuple(r) for r in skew.frequent_keys(rows, "k", 4).collect()} == {("a", 400), ("b", 5)}
    assert skew.frequent_keys(rows.where("false"), "k", 0).count() == 0
    assert skew.heavy_keys(rows.where("k is null"), "k") == (7, {"k": []})
    with pytest.raises(TypeError):
        skew.heavy_keys(rows.select(F.array("k").alias("k")), "k")


def test_written_tables_are_released(spark):
    import os

    from lexmill import session

    kept = session.materialise(spark.range(5).toDF("i"), "test")
    path = session._WRITTEN[-1].removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(path)
    assert session.release(spark) >= 1 and not os.path.exists(path)
    assert session.release(spark) == 0
