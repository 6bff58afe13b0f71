"""Typed titles against brute force over a catalogue."""

import random

from pyspark.sql import functions as F

from lexmill.llm import titles

CATALOG = ["Wexfalo Theatre", "Kingdom of Nesund", "Torraveth & Smitanast Festival", "Thesbelwick (composer)", "Tansmiik, Lanneseth County", "Mirgrimère Planetarium", "St. Fenlanwick Stadium", "Jorbloia's Courthouse", "Library of the Three Crevmere Kings", "Kin"]


def one_edit(a, b):
    """Whether one insertion, deletion, replacement or swap of neighbours leads from a to b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def match(spark, values, catalog=CATALOG, **options):
    c = spark.createDataFrame([(i, t, "x") for i, t in enumerate(catalog)], "catalog_id long, title string, value string")
    v = spark.createDataFrame([(x,) for x in values], "value string")
    return {r["value"]: (catalog[r["catalog_id"]], r["distance"]) for r in titles.match_values(v, c, **options).collect()}


WRITTEN = [
    ("wexfalo_theatre", 0), (" «Wexfalo Theatre» ", 0), ("[[Wexfalo Theatre]]#Notes", 0), ("WEXFALO THEATRE|", 0), ("Wехfаlо Theatre", 0), ("Wexfalo\xa0Theatre", 0), ("WexfaloTheatre", 0), ("Theatre, Wexfalo", 0),
    ("Wexflao Theatre", 0), ("Wexfalo Theatres", 0), ("exfalo Theatre", 0), ("Theater, Wexfalo", 0), ("Nesund, Kingdom of", 1), ("The Kingdom of Nesund", 1), ("nesund kingdom", 1), ("Kingdom%20of%20Nesund", 1), ("Kingdom+of+Nesund", 1),
    ("en:Kingdom of Nesund", 1), ("Article: Kingdom of Nesund", 1), ("Torraveth and Smitanast Festival", 2), ("Torraveth &amp; Smitanast Festival", 2), ("Thesbelwick, composer", 3), ("(composer), thesbelwick", 3), ("Tansmiik, Lanneseth Co.", 4),
    ("Mirgrimere Planetarium", 5), ("Mirgrimère Planetarium", 5), ("Saint Fenlanwick Stadium", 6), ("Jorbloia&#x27;s Courthouse", 7), ("Jorbloia’s Courthouse", 7), ("Library of the 3 Crevmere Kings", 8), ("Wexfalo Theatre", 0),
]


def test_written_otherwise(spark):
    found = match(spark, sorted({typed for typed, _ in WRITTEN} - set(CATALOG)))
    for typed, title in WRITTEN:
        assert typed in CATALOG or found[typed][0] == CATALOG[title], typed


def test_other_names(spark):
    others = ["Wexfalo Museum", "Wexfalo Theatre (old)", "Nesund", "Kingdom of Torenne", "Thesbelwick (novel)", "Tansmiik, Outer Reach", "Library of the Nine Crevmere Kings", "", " ", "#", "Kib", "&", "%", "😀", "x" * 100_000]
    assert match(spark, others) == {}


def test_names_that_only_look_alike(spark):
    catalog = ["Kingdom of Nesund", "Nesund", "Torvale", "C", "Battle of Jorast", "Wexfalo Museum", "Wexfalo Manuscript"]
    others = ["Alien: Kingdom of Nesund", "Review: Kingdom of Nesund", "C#", "Kingdom of Nesund#2", "Torvall", "Nesond", "Battle of Jo Rast II", "Bottle of Jorast House", "Wexfalo M", "Wexfalo Musing"]
    assert match(spark, others, catalog) == {}
    assert match(spark, ["fr:Nesund", ":C", "Nesund#History", "Btl. of Jorast", "Wexfalo Mus.", "Wexfalo Mnscrpt"], catalog) == {
        "fr:Nesund": ("Nesund", 0), ":C": ("C", 0), "Nesund#History": ("Nesund", 0), "Btl. of Jorast": ("Battle of Jorast", 2), "Wexfalo Mus.": ("Wexfalo Museum", 1),
    }


def test_large_catalogues_take_the_shuffle(spark):
    values = sorted({typed for typed, _ in WRITTEN})
    assert match(spark, values, max_broadcast=1) == match(spark, values)


def test_against_brute_force(spark):
    rng = random.Random(5)
    letters = "abcde"
    catalog = sorted({"".join(rng.choices(letters, k=rng.randint(4, 11))) for _ in range(80)})
    values = {"".join(rng.choices(letters, k=rng.randint(3, 12))) for _ in range(300)}
    for t in catalog:
        for _ in range(6):
            i, c = rng.randrange(len(t)), rng.choice(letters)
            values |= {t[:i] + c + t[i:], t[:i] + t[i + 1 :], t[:i] + c + t[i + 1 :], t[:i] + t[i : i + 2][::-1] + t[i + 2 :]}
    values -= {""}
    expected = {}
    for v in values:
        near = [t for t in catalog if t == v] or [t for t in catalog if one_edit(v, t) and min(len(v), len(t)) >= 4]
        if len(near) == 1:
            expected[v] = near[0]
    found = match(spark, sorted(values), catalog, letters=4)
    assert {v: t for v, (t, _) in found.items() if len(v) >= 4} == {v: t for v, t in expected.items() if len(v) >= 4}


def test_rows(spark):
    links = spark.createDataFrame([(1, "wexfalo theatre", "x"), (1, "wexfalo theatre", "x"), (2, "Wexfalo Theatre", "x"), (3, None, "x"), (None, "Kin", "x"), (4, "Nobody", "x"), (5, "Nobody", "x")], "link_id long, to_title string, value string")
    articles = spark.createDataFrame([(1, "Wexfalo Theater", 1)], "article_id long, title string, catalog_id int")
    catalog = spark.createDataFrame([(8, "Wexfalo Theatre"), (9, None), (None, "Nobody")], "catalog_id long, title string")
    assert {tuple(r) for r in titles.found_titles(links, articles, catalog).collect()} == {("internal_link", 1, 8), ("article", 1, 8)}
    states = {(r["src_table"], r["row_id"]): r["state"] for r in titles.map_titles(links, articles, catalog.where("catalog_id is not null")).collect()}
    assert states == {("internal_link", 1): "written", ("internal_link", 2): "equal", ("internal_link", 4): "unmatched", ("internal_link", 5): "unmatched", ("article", 1): "typo"}
    assert {tuple(r) for r in titles.unmatched_titles(links, articles, catalog).collect()} == {("Nobody", 2)}
    for a, b, c in ((links.where("false"), articles.where("false"), catalog), (links, articles, catalog.where("false"))):
        assert titles.found_titles(a, b, c).count() == 0


def test_the_closest_entry_must_be_one(spark):
    assert match(spark, ["Abcdefgx"], ["Abcdefga", "Abcdefgb"]) == {}
    assert match(spark, ["abcdefga"], ["Abcdefga", "Abcdefgb"]) == {"abcdefga": ("Abcdefga", 0)}


def test_plain_of_null(spark):
    assert spark.range(1).select(titles.plain(F.lit(None).cast("string"))).first()[0] is None
