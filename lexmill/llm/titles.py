"""Mapping freely typed titles to a canonical list, by SQL alone.

Titles are first brought to a plain form (encoding, case, accents, wrapping, order undone). Two partition-based pigeonhole
joins then find the entries that are near:

* within ``k`` edits, a swap of two neighbours being one: an entry's form is cut into ``k + 1`` segments with one letter
  between them, so that no edit touches two of them and one must occur unchanged in any value within ``k`` edits, at a
  position shifted by the edits before it. Equality joins on these positional substrings give the candidates, the built-in
  ``levenshtein`` verifies them.
* with one word abbreviated: the segments are the words; all but one must occur unchanged, so equality joins on what is
  left without each word give the candidates, and the two words left out are compared.

An anti-join reports what is left.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.skew import heavy_counts, salted, skew_join
from lexmill.session import materialise

#: Edits bridged by the pigeonhole join.
EDITS = 1
#: The segments of the list are broadcast if it has at most so many entries, else joined by a shuffle.
MAX_BROADCAST_ENTRIES = 100_000

#: Letters an entry's form must have for an edit to be bridged; a name as short as that is one edit from other names.
EDIT_LETTERS = 8
#: A word may stand for one at least so many times as long, if it begins with the same letter and keeps the order of letters.
SHORTENED = 2
#: English names of the digits.
DIGITS = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))
#: English function words, which do not tell entries apart once the words are put in order (``s`` is left of a genitive).
FILLERS = ("of", "the", "and", "s")
#: Link prefixes that name no part of a title: the main name space, the encyclopedia itself, and two-letter language codes.
PREFIX = "(?:article|w|[a-z]{2})?"
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авеіјкмнорстухѕԁ", "abeijkmhopctyxsd", strict=True))
#: Letters without a decomposition.
STROKES = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d"}
#: Named character references.
ENTITIES = {"&ndash;": "-", "&mdash;": "-", "&nbsp;": " ", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _fold_tables() -> tuple[str, str]:
    """From and to of a letter-by-letter translation to plain lower-case Latin, by Unicode decomposition."""
    pairs = dict(LOOKALIKES) | {a: b for a, b in STROKES.items() if len(b) == 1}
    for start, end in ((0xC0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)):
        for code in range(start, end):
            char = chr(code).lower()
            plain = unicodedata.normalize("NFKD", char)[:1].lower()
            if len(char) == 1 and char != plain and plain.isascii() and char not in pairs:
                pairs[char] = plain
    return "".join(pairs), "".join(pairs.values())


def plain(value: Column) -> Column:
    """Lower-case Latin words of a title, one space apart, with its wrapping removed; null gives null.

    Undone: percent encoding (with + for a space, only if a %xx or a + but no space occurs), character references,
    underscores, look-alike letters, accents, a fragment (``#`` after a title and before a letter; any other ``#`` is part of the name), a link prefix of
    ``PREFIX`` before a colon, quotes and brackets, curly or straight, a leading article, and ``&`` for ``and``.
    """
    v = F.when(value.rlike("%[0-9A-Fa-f]{2}") | (value.contains("+") & ~value.contains(" ")), F.coalesce(F.try_url_decode(value), value)).otherwise(value)
    v = F.lower(v)
    v = F.regexp_replace(v, "&#(x0*27|0*39);", "'")
    for name, char in ENTITIES.items():
        v = F.replace(v, F.lit(name), F.lit(char))
    v = F.translate(F.regexp_replace(v, r"\p{M}+", ""), *_fold_tables())
    for char, two in STROKES.items():
        if len(two) > 1:
            v = F.replace(v, F.lit(char), F.lit(two))
    v = F.regexp_replace(v, "([^#])#[a-z].*$", "$1")
    v = F.regexp_replace(v, f"^[^a-z0-9]*{PREFIX}[ _]*:", "")
    v = F.regexp_replace(v, "[’‘`´]", "'")
    v = F.regexp_replace(v, "'s([^a-z0-9]|$)", " s$1")
    v = F.replace(v, F.lit("&"), F.lit(" and "))
    v = F.trim(F.regexp_replace(v, "[^a-z0-9#]+", " "))
    return F.regexp_replace(v, "^the ", "")


def forms(value: Column) -> Column:
    """The forms of a title in which it is compared: ``ARRAY<STRUCT<form INT, text STRING>>``.

    Form 1: the words in their order, run together; form 2: without fillers, in alphabetical order. Single digits are
    spelled out in both. Forms without a letter are left out.
    """
    spelled = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    words = F.transform(F.filter(F.split(plain(value), " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(spelled, w), w))
    ordered = F.array_sort(F.filter(words, lambda w: ~w.isin(*FILLERS)))
    both = F.array(F.struct(F.lit(1).alias("form"), F.array_join(words, "").alias("text")), F.struct(F.lit(2).alias("form"), F.array_join(ordered, " ").alias("text")))
    return F.filter(both, lambda f: F.length(f["text"]) > 0)


def _cuts(length: str, part: str, k: int) -> tuple[str, str]:
    """SQL for the start (from 0) and the size of a segment of a form of this ``length``; the first segments are longer."""
    room = f"({length} - {k})"  # without the letters between
    size = f"({room} div {k + 1} + if({part} < {room} % {k + 1}, 1, 0))"
    start = f"({part} * ({room} div {k + 1} + 1) + least({part}, {room} % {k + 1}))"
    return start, size


def _with_segments(listed: DataFrame, k: int, letters: int) -> DataFrame:
    """The entries of at least ``letters``, once for each of their segments: ``(catalog_id, form, entry, len, part, seg)``."""
    start, size = _cuts("len", "part", k)
    rows = listed.withColumn("len", F.length("entry")).where(F.col("len") >= max(letters, 2 * k + 2)).withColumn("part", F.explode(F.array(*map(F.lit, range(k + 1)))))
    return rows.withColumn("seg", F.expr(f"substring(entry, cast({start} as int) + 1, cast({size} as int))"))


def _with_probes(typed: DataFrame, k: int) -> DataFrame:
    """The values, once for each substring that may be a segment: ``(value, form, text, len, part, seg)``.

    For an entry ``delta`` letters longer, a segment shifted by ``shift`` takes ``|shift|`` edits before it and
    ``|delta + shift|`` after it; nothing lies before the first segment, and nothing after the last.
    """
    ways = [
        (delta, part, shift)
        for delta in range(-k, k + 1)
        for part in range(k + 1)
        for shift in range(-k, k + 1)
        if abs(shift) + abs(delta + shift) <= k and (part > 0 or shift == 0) and (part < k or shift == -delta)
    ]
    way = F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(p).alias("part"), F.lit(s).alias("shift")) for d, p, s in ways])).alias("w")
    start, size = _cuts("len", "part", k)
    rows = typed.select("value", "form", "text", way).select("value", "form", "text", (F.length("text") + F.col("w.delta")).alias("len"), "w.part", "w.shift").where(F.col("len") >= 2 * k + 2)
    rows = rows.withColumn("at", F.expr(f"cast({start} + shift as int)")).withColumn("size", F.expr(f"cast({size} as int)"))
    return rows.where("at >= 0 and at + size <= length(text)").select("value", "form", "text", "len", "part", F.expr("substring(text, at + 1, size)").alias("seg"))


def _is_swap(a: str, b: str) -> Column:
    """Whether two strings of one length differ by two neighbours swapped, and by nothing else."""
    return F.expr(
        f"length({a}) = length({b}) and exists(array(array_position(transform(sequence(1, length({a})), i -> substring({a}, i, 1) <> substring({b}, i, 1)), true)),"
        f" i -> i > 0 and concat(substring({a}, 1, cast(i as int) - 1), substring({a}, cast(i as int) + 1, 1), substring({a}, cast(i as int), 1), substring({a}, cast(i as int) + 2)) = {b})"
    )


def _without_a_word(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """The rows of form 2, once for each word: what is left without it (``rest``), and the word (``word``)."""
    words = F.split(F.col(text), " ")
    cut = rows.where((F.col("form") == 2) & F.contains(F.col(text), F.lit(" "))).select(*keep, words.alias("__w"), F.posexplode(words).alias("__i", "word"))
    rest = F.array_join(F.filter("__w", lambda w, i: i != F.col("__i")), " ")
    return cut.select(*keep, rest.alias("rest"), "word").distinct()


def _shortening(short: str, whole: str) -> Column:
    """1 if ``short`` is the beginning of ``whole``, 2 if its letters occur there in their order from the first on, else null.

    At least two letters, and no more than one ``SHORTENED``-th of the whole.
    """
    fits = (F.length(short) >= 2) & (F.length(short) * SHORTENED <= F.length(whole)) & (F.left(short, F.lit(1)) == F.left(whole, F.lit(1)))
    ordered = F.expr(f"regexp_like({whole}, concat('^', array_join(split({short}, ''), '.*')))")
    return F.when(fits & F.startswith(whole, F.col(short)), F.lit(1)).when(fits & ordered, F.lit(2))


def _meet(typed: DataFrame, listed: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Equality join of values and entries; a small list is broadcast, else keys that very many values share are salted."""
    if small:
        return typed.join(F.broadcast(listed), keys)
    both = [df.withColumn("__key", F.xxhash64(*keys)) for df in (typed, listed)]
    a, b = salted(*both, "__key", heavy_counts(both[0], "__key")[1]["__key"])
    return a.join(b, [*keys, "__key", "__salt"]).drop("__key", "__salt")


def match_values(values: DataFrame, catalog: DataFrame, k: int = EDITS, max_broadcast: int = MAX_BROADCAST_ENTRIES, letters: int = EDIT_LETTERS) -> DataFrame:
    """The entry that each distinct value denotes: ``(value, catalog_id, distance, kind)``.

    ``values(value)`` without repeats or nulls, ``catalog(catalog_id, title)``. A value equal to a title denotes it at
    distance 0 (``kind`` equal), and so does one that has a form in common with it (written). Otherwise the closest entry
    counts: one edit or one swap of neighbours in either form is distance 1 (typo), and so is one word of form 2 cut short in
    the value or in the entry, or distance 2 if letters within it are missing too (abbreviated). Values whose closest entries
    are several, or that have none, have no row here. Entries whose form has fewer than ``letters`` letters, or ``2 k + 2``,
    bridge no edit, as anything that short is close to anything.
    """
    entries = catalog.where("catalog_id is not null and title is not null").select("catalog_id", "title").dropDuplicates(["title"])
    small = entries.limit(max_broadcast + 1).count() <= max_broadcast
    hint = F.broadcast if small else (lambda df: df)

    def at(rows: DataFrame, distance: Column, kind: str) -> DataFrame:
        return rows.select("value", "catalog_id", distance.alias("distance"), F.lit(kind).alias("kind")).where("distance is not null")

    equal = at(values.join(hint(entries), values.value == entries.title), F.lit(0), "equal")
    other = values.join(hint(entries.select(F.col("title").alias("value"))), "value", "left_anti")
    listed = materialise(entries.select("catalog_id", F.explode(forms(F.col("title"))).alias("f")).select("catalog_id", "f.form", F.col("f.text").alias("entry")), "p4-entries")
    # written out: the forms are dear, and are read three times
    typed = materialise(other.select("value", F.explode(forms(F.col("value"))).alias("f")).select("value", "f.form", F.col("f.text").alias("text")), "p4-forms")
    same = at(_meet(typed, listed.withColumnRenamed("entry", "text"), ["form", "text"], small), F.lit(0), "written")
    near = _meet(_with_probes(typed, k), _with_segments(listed, k, letters), ["form", "len", "part", "seg"], small).withColumn("d", F.levenshtein("text", "entry", k + 1)).where("d > 0")
    near = at(near, F.when(F.col("d") <= k, F.col("d")).when((F.col("d") == 2) & _is_swap("text", "entry"), F.lit(1)), "typo")
    cut = _meet(_without_a_word(typed, "text", "value").withColumnRenamed("word", "a"), _without_a_word(listed, "entry", "catalog_id").withColumnRenamed("word", "b"), ["rest"], small).where("a <> b")
    cut = at(cut, F.coalesce(_shortening("a", "b"), _shortening("b", "a")), "abbreviated")
    found = reduce(DataFrame.unionByName, [equal, same, near, cut]).groupBy("value", "distance").agg(F.min("catalog_id").alias("catalog_id"), F.max("catalog_id").alias("last"), F.min("kind").alias("kind"))
    best = found.groupBy("value").agg(*[F.min_by(c, "distance").alias(c) for c in ("catalog_id", "last", "kind")], F.min("distance").alias("distance"))
    return materialise(best.where("catalog_id = last").select("value", "catalog_id", "distance", "kind"), "p4-matches")


def typed_titles(links: DataFrame, articles: DataFrame) -> DataFrame:
    """The titles with their rows: ``(src_table, row_id, value)``; repeated rows once, null ids and titles left out."""
    a = links.select(F.lit("internal_link").alias("src_table"), F.col("link_id").alias("row_id"), F.col("to_title").alias("value"))
    b = articles.select(F.lit("article").alias("src_table"), F.col("article_id").alias("row_id"), F.col("title").alias("value"))
    return a.unionByName(b).where("row_id is not null and value is not null").distinct()


def _heavy_titles(links: DataFrame) -> dict:
    return heavy_counts(links, "to_title")[1]["to_title"]


def map_titles(links: DataFrame, articles: DataFrame, catalog: DataFrame, k: int = EDITS) -> DataFrame:
    """Every typed title with its entry: ``(src_table, row_id, value, catalog_id, distance, state)``.

    ``state``: ``equal`` (letter for letter), ``written`` (other writing of the name), ``typo``, ``abbreviated``, or
    ``unmatched`` (null entry). Each distinct value is matched once; the matches go back to the rows by a join that keeps values shared by
    very many rows off the shuffle.
    """
    rows = typed_titles(links, articles)
    matched = match_values(rows.select("value").distinct(), catalog, k)
    back = skew_join(rows, matched, "value", "left", heavy=_heavy_titles(links))
    return back.select("src_table", "row_id", "value", "catalog_id", "distance", F.coalesce("kind", F.lit("unmatched")).alias("state"))


def unmatched_titles(links: DataFrame, articles: DataFrame, catalog: DataFrame, k: int = EDITS) -> DataFrame:
    """The values that denote no entry, with their rows: ``(value, n_rows)``, by anti-join against the matches."""
    rows = typed_titles(links, articles)
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(match_values(rows.select("value").distinct(), catalog, k), "value", "left_anti")


def found_titles(links: DataFrame, articles: DataFrame, catalog: DataFrame, k: int = EDITS) -> DataFrame:
    """The rows whose value denotes an entry without being equal to its title: ``(src_table, row_id, catalog_id)``."""
    rows = typed_titles(links, articles)
    matched = match_values(rows.select("value").distinct(), catalog, k)
    different = matched.where("kind <> 'equal'").drop("kind")
    return skew_join(rows, different, "value", "inner", heavy=_heavy_titles(links)).select("src_table", "row_id", "catalog_id")
