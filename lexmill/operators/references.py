"""References to records that do not exist.

Loads and deletions become signed existence changes for each key; references become signed reference changes. Summed for
each key they give the current orphans, and can be kept up to date by adding the counts of later changes. A reference is an
orphan as of its own time if its key had not gained an article by then, or had lost it again: the counts decide that for
keys that never lost one, a running sum for the others.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.skew import fits_broadcast, heavy_counts, salted, skew_join
from lexmill.session import materialise, materialise_by

#: Reference field -> name space of its key.
FIELDS = {"from_article": "article", "from_page_id": "page", "to_article": "article", "to_title": "title"}
#: Name space -> column of the article table.
SPACES = {"article": "article_id", "page": "page_id", "title": "title"}


def article_changes(articles: DataFrame, deletions: DataFrame) -> DataFrame:
    """State changes of the articles: ``(article_id, ts, alive, page_id, title, was, old_page, old_title)``.

    Loads that repeat the state already reached, and deletions of what is not there, change nothing and are left out.
    Events at one time: deletions come first, so the article exists. Rows with a null id or time say nothing and are
    dropped. A first window over (article, day) drops repeats, so an article with very many events is spread over its
    days before the window over the article alone.
    """
    loads = articles.select("article_id", F.col("loaded_at").alias("ts"), F.lit(True).alias("alive"), "page_id", "title")
    gone = deletions.select("article_id", F.col("deleted_at").alias("ts"), F.lit(False).alias("alive"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("title"))
    events = loads.unionByName(gone).where("article_id is not null and ts is not null")
    order = ["ts", "alive", "page_id", "title"]
    state = F.struct("alive", "page_id", "title")
    day = Window.partitionBy("article_id", F.to_date("ts")).orderBy(*order)
    # without a reliable record of the name on a deletion, repeats are told by the flag, and for loads by the names too
    events = events.withColumn("prev", F.lag(state).over(day)).where("prev is null or not (prev <=> struct(alive, page_id, title))").drop("prev")
    whole = Window.partitionBy("article_id").orderBy(*order)
    events = events.withColumn("prev", F.lag(state).over(whole))
    return events.select(
        "article_id", "ts", "alive", "page_id", "title",
        F.coalesce("prev.alive", F.lit(False)).alias("was"), F.col("prev.page_id").alias("old_page"), F.col("prev.title").alias("old_title"),
    ).where("alive or was")


def existence_deltas(articles: DataFrame, deletions: DataFrame) -> DataFrame:
    """Signed existence changes: ``(space, key STRING, ts, delta)``, +1 where a key gains an article, -1 where it loses one.

    One article counts for its id, its page id and its title. Null page ids and titles name nothing.
    """
    gained, lost = [], []
    for space, new, old in (("article", "article_id", "article_id"), ("page", "page_id", "old_page"), ("title", "title", "old_title")):
        moved = f"not ({new} <=> {old})" if space != "article" else "false"
        gained.append(f"if(alive and (not was or {moved}), named_struct('space', '{space}', 'key', cast({new} as string), 'delta', 1L), null)")
        lost.append(f"if(was and (not alive or {moved}), named_struct('space', '{space}', 'key', cast({old} as string), 'delta', -1L), null)")
    steps = F.expr(f"filter(array({', '.join(gained + lost)}), x -> x.key is not null)")
    return article_changes(articles, deletions).select("ts", F.explode(steps).alias("d")).select("d.space", "d.key", "ts", "d.delta")


def existence_moments(deltas: DataFrame) -> DataFrame:
    """The net changes: ``(space, key, ts, delta)``, one row for each time at which the number of articles of a key changes."""
    return deltas.groupBy("space", "key", "ts").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def existence_counts(moments: DataFrame) -> DataFrame:
    """The signed changes summed for each key: ``(space, key, first, n_lost)``.

    ``first`` is the time of the first gain, ``n_lost`` the number of times at which a key lost more articles than it gained.
    A key that never lost one exists from ``first`` on; the others need :func:`existence_intervals`.
    """
    return moments.groupBy("space", "key").agg(F.min(F.when(F.col("delta") > 0, F.col("ts"))).alias("first"), F.count_if(F.col("delta") < 0).alias("n_lost"))


def existence_intervals(moments: DataFrame) -> DataFrame:
    """When each key exists: ``(space, key, since, until)``, ``until`` excluded and null for those that still exist.

    The running sum is taken in two levels, over the days of a key and within each day, so a key with very many changes is
    spread over its days. The last window runs over a key's true switches only and keeps one row at a time.
    """
    moments = moments.withColumn("day", F.to_date("ts"))
    inside = Window.partitionBy("space", "key", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    days = moments.groupBy("space", "key", "day").agg(F.sum("delta").alias("of_day"))
    before = Window.partitionBy("space", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("space", "key", "day", F.coalesce(F.sum("of_day").over(before), F.lit(0)).alias("before"))
    running = moments.join(days, ["space", "key", "day"]).withColumn("now", F.col("before") + F.sum("delta").over(inside))
    switched = running.where("(now > 0) <> (now - delta > 0)").withColumn("until", F.lead("ts").over(Window.partitionBy("space", "key").orderBy("ts")))
    return switched.where("now > 0").select("space", "key", F.col("ts").alias("since"), "until")


def first_links(links: DataFrame) -> DataFrame:
    """One row for each ``link_id``, the one loaded earliest; of rows loaded at one time the smallest in its fields."""
    order = [F.col("loaded_at").asc_nulls_last(), *[F.col(f).asc_nulls_last() for f in FIELDS]]
    ranked = links.select("link_id", *FIELDS, "loaded_at").withColumn("rn", F.row_number().over(Window.partitionBy("link_id").orderBy(*order)))
    return ranked.where("rn = 1").drop("rn")


def check_references(links: DataFrame, articles: DataFrame, deletions: DataFrame, orphans_only: bool = False) -> DataFrame:
    """Every reference of every link with its verdict: ``(link_id, ref_field, loaded_at, orphan)``.

    A reference meets the signed counts of its key, one row of fixed width. A key without a gain was never there; one that
    lost nothing is there from its first gain on; references to keys that also lost articles, and only these, are compared
    with the intervals in which their key exists, both sides cut by month. Hot targets are spread over salts in either join.

    A link whose ``loaded_at`` is null cannot be placed in time: its references are orphans. Null fields are no
    references. Empty tables give no rows (no articles: every reference is an orphan).
    """
    moments = materialise(existence_moments(existence_deltas(articles, deletions)), "moments")
    counts = existence_counts(moments).select("space", "key", "first", (F.col("n_lost") > 0).alias("lossy"))
    counts = materialise_by(counts, "space", list(SPACES), "counts")
    once = materialise(first_links(links), "links")
    lossy = reduce(DataFrame.unionByName, [c.where("lossy").select(F.lit(s).alias("space"), "key") for s, c in counts.items()])
    # an interval has a row for each month it touches, up to the last reference
    last = F.broadcast(once.agg(F.max("loaded_at").alias("last")))
    months = F.sequence(F.trunc("since", "MM"), F.trunc(F.least(F.coalesce("until", "last"), F.col("last")), "MM"), F.expr("interval 1 month"))
    spells = existence_intervals(moments.join(lossy, ["space", "key"], "left_semi"))
    spells = spells.join(last, spells["since"] <= F.col("last")).select("space", F.col("key").alias("held"), F.explode(months).alias("of_month"), "since", "until")
    spells = materialise_by(spells, "space", list(SPACES), "spells")
    heavy: dict[str, dict] = {f: {} for f in FIELDS}
    if not all(map(fits_broadcast, [*counts.values(), *spells.values()])):
        heavy = heavy_counts(links, *FIELDS)[1]
    parts = []
    for space in SPACES:
        fields = [f for f, s in FIELDS.items() if s == space]
        if len(fields) == 1:
            refs = once.select("link_id", F.lit(fields[0]).alias("ref_field"), F.col(fields[0]).alias("key"), "loaded_at")
        else:
            both = F.expr("array(" + ", ".join(f"named_struct('ref_field', '{f}', 'key', {f})" for f in fields) + ")")
            refs = once.select("link_id", F.explode(both).alias("r"), "loaded_at").select("link_id", "r.ref_field", "r.key", "loaded_at")
        refs = refs.where("key is not null")
        kind = refs.schema["key"].dataType
        hot = dict(reduce(Counter.__add__, (Counter(heavy[f]) for f in fields)))
        judged = skew_join(refs, counts[space].withColumn("key", F.col("key").cast(kind)), "key", "left", heavy=hot).withColumn("month", F.trunc("loaded_at", "MM"))
        own = spells[space].withColumn("held", F.col("held").cast(kind))
        inside = (F.col("loaded_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("loaded_at") < F.col("until")))
        same = (F.col("key") == F.col("held")) & (F.col("month") == F.col("of_month")) & inside
        early = F.coalesce(F.col("loaded_at") < F.col("first"), F.lit(True))
        row = ["link_id", "ref_field", "loaded_at"]
        if fits_broadcast(own):
            out = judged.join(F.broadcast(own), same & F.col("lossy"), "left").select(*row, F.when(F.col("lossy"), F.col("since").isNull()).otherwise(early).alias("orphan"))
        else:
            # only references to lossy keys are shuffled again
            a, b = salted(judged.where("lossy"), own.withColumn("key", F.col("held")), "key", hot)
            held = a.join(b.drop("key"), same & (a["__salt"] == b["__salt"]), "left").select(*row, F.col("since").isNull().alias("orphan"))
            out = judged.where("not coalesce(lossy, false)").select(*row, early.alias("orphan")).unionByName(held)
        parts.append(out.where("orphan") if orphans_only else out)
    return reduce(DataFrame.unionByName, parts)


def orphan_report(links: DataFrame, articles: DataFrame, deletions: DataFrame) -> DataFrame:
    """Orphans by field and month of the link: ``(ref_field, month STRING, n_refs, n_orphans)``; an unknown month is null."""
    verdicts = check_references(links, articles, deletions)
    month = F.date_format("loaded_at", "yyyy-MM")
    return verdicts.groupBy("ref_field", month.alias("month")).agg(F.count(F.lit(1)).alias("n_refs"), F.count_if("orphan").alias("n_orphans"))


def reference_counts(links: DataFrame, articles: DataFrame, deletions: DataFrame) -> DataFrame:
    """Signed counts for each key: ``(space, key STRING, n_refs, n_existing)``, from reference and existence changes.

    One aggregation with partial sums, so a hot key costs one row a task. Null fields name nothing.
    """
    once = first_links(links)
    pairs = F.expr("array(" + ", ".join(f"named_struct('space', '{s}', 'key', cast({f} as string))" for f, s in FIELDS.items()) + ")")
    refs = once.select(F.explode(pairs).alias("r")).where("r.key is not null").select("r.space", "r.key", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("delta"))
    exist = existence_deltas(articles, deletions).select("space", "key", F.lit(0).cast("long").alias("refs"), "delta")
    return refs.unionByName(exist).groupBy("space", "key").agg(F.sum("refs").alias("n_refs"), F.sum("delta").alias("n_existing"))


def add_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Signed counts brought up to date with those of later changes; removed references and articles count below zero.

    Both ``(space, key, n_refs, n_existing)``; keys whose counts are both zero in the end are left out.
    """
    both = counts.unionByName(changes.select(*counts.columns))
    return both.groupBy("space", "key").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_existing").alias("n_existing")).where("n_refs <> 0 or n_existing <> 0")


def orphans_of(counts: DataFrame) -> DataFrame:
    """The keys with positive references and zero existence."""
    return counts.where("n_refs > 0 and n_existing <= 0")


def current_orphans(links: DataFrame, articles: DataFrame, deletions: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist now: ``(space, key STRING, n_refs, n_existing)``, from the signed counts."""
    return orphans_of(reference_counts(links, articles, deletions))
