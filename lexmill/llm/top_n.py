"""Top N items within every group.

A histogram of the scores of each group gives a lower threshold that keeps at least N of its items; rows below it are
dropped, and the survivors are ranked exactly with the tie keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialise

#: Thresholds of so many groups at most, the largest, are broadcast; those of the others are joined by a shuffle.
MAX_THRESHOLDS = 20_000
#: Histogram bins for each doubling of the score.
BINS = 16


def score_bin(score: Column, bins: int = BINS) -> Column:
    """A bin that never falls as the score rises: equal ratios above zero, mirrored below, zero in between."""
    size = F.greatest(F.lit(-1100.0), F.least(F.lit(1100.0), F.log2(F.abs(score))))
    step = (F.floor(size * bins) + 1100 * bins + 1).cast("int")
    return F.when(score > 0, step).when(score < 0, -step).otherwise(F.lit(0))


def current_scores(postings: DataFrame) -> DataFrame:
    """One row for each (term, article): ``(term, article, score)`` of its latest ``indexed_at``.

    Rows indexed at one time: the greater ``posting_id`` counts; a null time is the earliest. Pairs whose current score
    is null or NaN, and rows with a null term or article, are left out. Minus zero becomes zero. The aggregate is hashed
    and partial before the shuffle, so rows of one pair, however many, become one row a task.
    """
    when = F.coalesce(F.unix_micros("indexed_at"), F.lit(-(1 << 62))).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    order = (when.cast("decimal(38,0)") + F.coalesce("posting_id", F.lit(-1)).cast("decimal(38,0)")).cast("decimal(38,0)")
    last = postings.where("term is not null and article is not null").groupBy("term", "article").agg(F.max_by("tf_idf_score", order).alias("score"))
    return last.where("score is not null and not isnan(score)").withColumn("score", F.col("score") + F.lit(0.0))


def top_n_per_group(rows: DataFrame, group: str, score: str, tie: list[str], n: int, max_thresholds: int = MAX_THRESHOLDS) -> DataFrame:
    """The ``n`` rows of each group with the highest score, with their ``rank`` from 1.

    Equal scores: ascending by the ``tie`` columns, which should tell rows apart (else the choice among full copies is
    free). Groups with fewer rows come out whole; ``n`` of 0 or an empty table gives no row. Null groups form one group;
    null scores come last and NaN first, as Spark orders them. The histogram of a group has a bounded number of bins, and
    is summed partially before its shuffle. Every group with more than ``n`` scores has a threshold: rows of the largest
    groups are dropped where they lie, those of the others beside their threshold, in the partitions they are ranked in.
    A group of any size reaches the ranking as its survivors, which a limit inside each task cuts to ``n`` before the
    shuffle, however many scores are equal.
    """
    if n < 1:
        return rows.withColumn("rank", F.lit(1)).limit(0)
    binned = rows.withColumn("__bin", F.when(F.col(score).isNull() | F.isnan(score), F.lit(None)).otherwise(score_bin(F.col(score))))
    histogram = binned.where("__bin is not null").groupBy(group, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy(group).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, 0)
    reached = histogram.withColumn("__sum", F.sum("__n").over(above))
    least = reached.groupBy(group).agg(F.max(F.when(F.col("__sum") >= n, F.col("__bin"))).alias("__least"), F.sum("__n").alias("__size"))
    least = materialise(least.where(F.col("__least").isNotNull() & F.col(group).isNotNull() & (F.col("__size") > n)), "p2-least")
    largest, some = least, least.limit(max_thresholds + 1).count() > max_thresholds
    if some:
        largest = materialise(least.orderBy(F.desc("__size"), group).limit(max_thresholds), "p2-largest")
    above = "__least is null or __bin is null or __bin >= __least"
    kept = binned.join(F.broadcast(largest.drop("__size")), group, "left").where(above)
    if some:
        others = least.join(F.broadcast(largest.select(group)), group, "left_anti").select(group, "__least")
        # rows of the largest groups have been cut, and need not meet the others' thresholds
        met = kept.where("__least is null").drop("__least").join(others, group, "left").where(above)
        kept = kept.where("__least is not null").unionByName(met)
    best = Window.partitionBy(group).orderBy(F.desc(score), *[F.asc(t) for t in tie])
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).drop("__bin", "__least")
