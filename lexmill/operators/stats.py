"""Counts, summaries, samples and timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.corpus import with_row_ids
from lexmill.session import materialise

#: Articles looked at for the mean number of paragraphs, by the status view and by the summary.
STATUS_SAMPLE, SUMMARY_SAMPLE = 100, 1000


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), frames)


def mean_paragraphs(articles: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: the mean number of paragraphs of all articles, or of the ``sample`` of smallest id; null paragraphs count 0."""
    size = F.greatest(F.lit(0), F.coalesce(F.size("plain_text_paragraphs"), F.lit(0)))
    rows = articles if sample is None else articles.orderBy("article_id").limit(sample)
    return rows.agg(F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_paragraphs"))


def summary(articles: DataFrame, links: DataFrame, sample: int = SUMMARY_SAMPLE) -> DataFrame:
    """One row: ``(n_articles, n_links, n_unresolved, avg_paragraphs)``."""
    counts = links.agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("to_article").isNull()).alias("n_unresolved"))
    return _one_row([articles.agg(F.count(F.lit(1)).alias("n_articles")), counts, mean_paragraphs(articles, sample)])


def status(articles: DataFrame, links: DataFrame, vocab: DataFrame, postings: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row with the counts of all tables, unresolved links, rank and vocabulary figures, and links per article."""
    a = articles.agg(F.count(F.lit(1)).alias("n_articles"))
    k = links.agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("to_article").isNull()).alias("n_unresolved"))
    v = vocab.agg(F.count(F.lit(1)).alias("n_terms"), F.avg("document_frequency").alias("avg_df"), F.max("document_frequency").alias("max_df"), F.avg("idf_value").alias("avg_idf"))
    p = postings.agg(F.count(F.lit(1)).alias("n_postings"))
    r = ranks.agg(F.count(F.lit(1)).alias("n_ranks"), F.max("score").alias("max_rank"), F.min("score").alias("min_rank"), F.avg("score").alias("avg_rank"))
    out = _one_row([a, k, v, p, r, mean_paragraphs(articles, STATUS_SAMPLE)])
    return out.withColumn("links_per_article", F.when(F.col("n_articles") > 0, F.col("n_links") / F.col("n_articles")).otherwise(0.0))


def records_by_source(records: DataFrame, source: str = "source") -> DataFrame:
    """``(source, n)``; records without a source form one group of their own."""
    return records.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def source_stats(counts: DataFrame, n_sources: int | None = None) -> DataFrame:
    """One row: ``(n_sources, total, avg_n, min_n, max_n, estimate)``; the estimate is the mean times ``n_sources``."""
    agg = counts.agg(F.count(F.lit(1)).alias("n_sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_n"), F.coalesce(F.min("n"), F.lit(0)).alias("min_n"), F.coalesce(F.max("n"), F.lit(0)).alias("max_n"))
    return agg.withColumn("estimate", F.round(F.col("avg_n") * (F.col("n_sources") if n_sources is None else F.lit(n_sources))).cast("long"))


def top_sources(counts: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` sources with the most records, ties by name."""
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(n)


#: Bins for each doubling of a measure, of which the exact percentiles look at a few.
BINS = 256


def timing_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, total, mean, median, 95th percentile, least and greatest of a measure, nulls and NaN left out.

    The percentiles are exact and interpolate between neighbours; with fewer than five values the 95th is the greatest. A
    histogram with a bounded number of bins tells which bins hold the neighbours; only the values of these bins are counted
    one by one, by group and bin, so that no group, however large, comes together in one task.
    """
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("__v"))
    v = F.col("__v")
    size = F.floor(F.greatest(F.lit(-1100.0), F.least(F.lit(1100.0), F.log2(F.abs(v)))) * BINS) + 1100 * BINS + 1
    binned = ok.withColumn("__bin", F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("int"))
    bins = binned.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__k"), F.sum(v).alias("__s"), F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    bins = materialise(bins, "bins")
    sums = bins.groupBy(*by).agg(F.sum("__k").alias("n"), F.sum("__s").alias("total"), F.min("__lo").alias("least"), F.max("__hi").alias("greatest"))
    above = Window.partitionBy(*by).orderBy("__bin")
    placed = bins.withColumn("__upto", F.sum("__k").over(above.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__k").over(Window.partitionBy(*by)))
    ranks = {name: (F.col("__n") - 1) * F.lit(p) for name, p in (("median", 0.5), ("p95", 0.95))}
    inside = lambda at: (at < F.col("__upto")) & (at >= F.col("__upto") - F.col("__k"))
    wanted = placed.where(reduce(Column.__or__, [inside(f(r)) for r in ranks.values() for f in (F.floor, F.ceil)]))
    wanted = wanted.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__bin").alias("__wanted"), "__n", (F.col("__upto") - F.col("__k")).alias("__before"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], F.col("__bin") == F.col("__wanted"))
    near = binned.join(wanted, same).groupBy(*by, "__bin", "__n", "__before", "__v").agg(F.count(F.lit(1)).alias("__k"))
    near = near.withColumn("__upto", F.col("__before") + F.sum("__k").over(Window.partitionBy(*by, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    ends = {f"{name}_{f.__name__}": F.max(F.when(inside(f(r)), v)) for name, r in ranks.items() for f in (F.floor, F.ceil)}
    found = near.groupBy(*by).agg(*[e.alias(f"__{k}") for k, e in ends.items()], F.max("__n").alias("__n"))
    between = lambda name, r: F.col(f"__{name}_floor") + (r - F.floor(r)) * (F.col(f"__{name}_ceil") - F.col(f"__{name}_floor"))
    found = found.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[between(name, r).alias(name) for name, r in ranks.items()])
    whole = sums.join(found, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], F.lit(True)))
    return whole.select(*by, "n", "total", (F.col("total") / F.col("n")).alias("mean"), "median", F.when(F.col("n") < 5, F.col("greatest")).otherwise(F.col("p95")).alias("p95"), "least", "greatest")


def group_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows by group, most first."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def hash_order(key: Column, seed: int) -> Column:
    """A number that shuffles integer keys the same way in any engine: two rounds of a linear congruence."""
    m = F.lit(2147483647).cast("long")
    once = (F.pmod(key.cast("long"), m) * F.lit(48271).cast("long") + F.lit(seed).cast("long")) % m
    return (once * F.lit(69621).cast("long") + F.lit(seed).cast("long")) % m


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones for a seed however the table is split; fewer rows come out whole."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def sample_to(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows with their ``place`` from 0: as :func:`sample`, and if there are fewer, some again.

    The rows added are drawn with replacement, the same ones for a seed. An empty table gives no row.
    """
    spark = rows.sparkSession
    total = rows.count()
    if not total:
        return rows.withColumn("place", F.lit(0).cast("long")).limit(0)
    shuffled = with_row_ids(rows.withColumn("__h", hash_order(F.col(key), seed)), "__place", ["__h", key]).drop("__h")
    slots = spark.range(n).select(F.col("id").alias("place"), F.when(F.col("id") < total, F.col("id")).otherwise(hash_order(F.col("id"), seed) % total).alias("__at"))
    return slots.join(shuffled, F.col("__at") + 1 == F.col("__place")).drop("__at", "__place")


def two_random(articles: DataFrame, seed: int = 42) -> DataFrame:
    """Two different articles: ``(article_id, title)``; fewer than two raise ``ValueError``."""
    if len(articles.select("article_id").limit(2).take(2)) < 2:
        raise ValueError("at least two articles are needed")
    return sample(articles.select("article_id", "title"), "article_id", 2, seed)


#: The classes of statements that read, by the table named in them, looked for in this order.
READS = {"Article": "Article lookup", "InvertedIndex": "Inverted index", "Vocabulary": "Vocabulary", "PageRank": "PageRank"}
#: Fixed value: more statements than that naming ``Article`` point to look-ups row by row.
LOOKUPS = 10


def classify_statements(statements: DataFrame, column: str = "statement", seconds: str | None = None) -> DataFrame:
    """Statements by class: ``(query_type, n, seconds, row_by_row)``; null statements count as empty ones.

    ``SELECT`` in any case makes a statement a read, classed by the first table of ``READS`` whose name it holds as written
    there, else ``Other SELECT``; all others are ``Non-SELECT``. ``row_by_row``, the same in every row, says whether more than
    ``LOOKUPS`` statements of whatever class name ``Article``.
    """
    text = F.coalesce(column, F.lit(""))
    read = reduce(lambda acc, t: acc.when(F.contains(text, F.lit(t)), READS[t]), READS, F.when(F.lit(False), "")).otherwise("Other SELECT")
    kind = F.when(F.contains(F.upper(text), F.lit("SELECT")), read).otherwise("Non-SELECT")
    took = F.coalesce(F.col(seconds).cast("double"), F.lit(0.0)) if seconds else F.lit(0.0)
    rows = statements.select(kind.alias("query_type"), took.alias("s"), F.contains(text, F.lit("Article")).alias("article"))
    counts = rows.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("seconds"), F.count_if("article").alias("a"))
    total = counts.agg((F.coalesce(F.sum("a"), F.lit(0)) > LOOKUPS).alias("row_by_row"))
    return _one_row([counts.drop("a"), total])


def ratio_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two decimals, 0 for an empty whole."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 2)).otherwise(F.lit(0.0))


def hit_ratio(rows: DataFrame, hits: str, reads: str, *by: str) -> DataFrame:
    """Sums of hits and reads and the share of hits in per cent: ``(*by, hits, reads, hit_ratio)``; nulls count 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = rows.groupBy(*by).agg(total(hits).alias("hits"), total(reads).alias("reads"))
    return sums.withColumn("hit_ratio", ratio_percent(F.col("hits"), F.col("hits") + F.col("reads")))


def blocked(locks: DataFrame, keys: list[str], owner: str = "pid", granted: str = "granted") -> DataFrame:
    """The requests that wait and who stands in their way: ``(*keys, owner, n_blockers, first_blocker)``.

    In the way is every other ``owner`` with a row of the same ``keys``, nulls being equal; ``first_blocker`` is the smallest.
    The owners of a lock are counted, and its two smallest found, once for each lock before they meet the requests, so a
    lock that very many wait for never yields a row for each pair. Requests nobody stands in the way of are left out.
    """
    owners = locks.where(F.col(owner).isNotNull()).select(*keys, owner).distinct()
    place = Window.partitionBy(*keys).orderBy(owner)
    two = owners.withColumn("__place", F.row_number().over(place)).where("__place <= 2")
    first = two.groupBy(*keys).agg(F.min(owner).alias("__a"), F.max(owner).alias("__b"))
    sizes = owners.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    same = lambda mark: reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys])
    marked = lambda df, mark: df.select(*[F.col(k).alias(f"{mark}{k}") for k in keys], *[c for c in df.columns if c not in keys])
    waiting = locks.where(~F.col(granted) & F.col(owner).isNotNull()).select(*keys, owner).distinct()
    both = waiting.join(marked(sizes.where("__n > 1"), "__s_"), same("__s_")).join(marked(first, "__f_"), same("__f_"))
    return both.select(*keys, owner, (F.col("__n") - 1).alias("n_blockers"), F.when(F.col(owner) == F.col("__a"), F.col("__b")).otherwise(F.col("__a")).alias("first_blocker"))
