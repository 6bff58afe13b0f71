"""Retrieval quality and parameter grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.search import HybridParams


def relevances(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """``(query_id, rank, rel)``: 1 for a result whose title is among the query's ``relevant(query_id, title)``."""
    truth = relevant.select("query_id", "title").distinct().withColumn("hit", F.lit(1))
    return results.select("query_id", "rank", "title").join(truth, ["query_id", "title"], "left").select("query_id", "rank", F.coalesce("hit", F.lit(0)).alias("rel"))


def query_metrics(rels: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row for each query of ``relevant``: ``(query_id, ndcg, mrr, p_at_5, p_at_10, r_at_20)``.

    nDCG and MRR look at the first ``k``; the ideal order is that of the retrieved ones. Precision at n is 0 with fewer
    than n results. Recall divides by the distinct relevant titles. Queries without results have 0 everywhere.
    """
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    top = rels.withColumn("ideal", F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.row_number().over(Window.partitionBy("query_id", F.col("rank") <= k).orderBy(F.desc("rel"), "rank")) + 1.0)))
    sums = top.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"),
        F.sum("ideal").alias("idcg"),
        F.min(F.when((F.col("rel") > 0) & (F.col("rank") <= k), F.col("rank"))).alias("first"),
        F.count(F.lit(1)).alias("n"),
        *(F.sum(F.when(F.col("rank") <= m, F.col("rel"))).alias(f"hits{m}") for m in (5, 10, 20)),
    )
    size = relevant.groupBy("query_id").agg(F.countDistinct("title").alias("n_relevant"))
    both = size.join(sums, "query_id", "left")

    def precision(m: int) -> Column:
        return F.when(F.col("n") >= m, F.col(f"hits{m}") / F.lit(float(m))).otherwise(0.0)

    return both.select(
        "query_id",
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        precision(5).alias("p_at_5"),
        precision(10).alias("p_at_10"),
        F.when(F.col("n_relevant") > 0, F.coalesce("hits20", F.lit(0)) / F.col("n_relevant")).otherwise(0.0).alias("r_at_20"),
    )


METRICS = ("ndcg", "mrr", "p_at_5", "p_at_10", "r_at_20")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """One row: the number of queries and the mean of each metric, 0 for none."""
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS))


def parameter_grid(**options: list) -> list[HybridParams]:
    """Every combination of the options, the last varying fastest."""
    return [HybridParams(**dict(zip(options, values, strict=True))) for values in product(*options.values())]


def grid_search(results: DataFrame, grid: list[HybridParams], relevant: DataFrame, k: int = 10) -> DataFrame:
    """Mean metrics for each parameter set: ``(grid_order, alpha, max_candidates, coverage_bonus, policy, n_queries, ...)``.

    ``results`` are those of :func:`lexmill.operators.search.search_grid`, one search for all sets; ``relevant`` is repeated
    for each set, of which there are few. A set without any relevant title has no row.
    """
    both = F.struct("point", "query_id").alias("query_id")
    truth = relevant.withColumn("point", F.explode(F.array(*[F.lit(i) for i in range(len(grid))]))).select(both, "title")
    metrics = query_metrics(relevances(results.select(both, "rank", "title"), truth), truth, k)
    means = metrics.groupBy(F.col("query_id.point").alias("grid_order")).agg(F.count(F.lit(1)).alias("n_queries"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS))
    of = lambda name: F.element_at(F.array(*[F.lit(getattr(p, name)) for p in grid]), F.col("grid_order") + 1).alias(name)
    return means.select("grid_order", of("alpha"), of("max_candidates"), of("coverage_bonus"), of("policy"), "n_queries", *METRICS)


def best_by(grid: DataFrame, metric: str) -> DataFrame:
    """The row of the grid with the highest ``metric``, the first of equals."""
    return grid.orderBy(F.desc(F.round(metric, 12)), "grid_order").limit(1)
