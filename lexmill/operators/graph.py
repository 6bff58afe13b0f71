"""The link graph and PageRank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.operators.skew import fits_broadcast, heavy_counts, skew_join
from lexmill.session import discard, materialise


def edges(links: DataFrame) -> DataFrame:
    """``(src, dst, w)``: pairs of different resolved articles with the number of links between them."""
    valid = links.where("from_article is not null and to_article is not null and from_article <> to_article")
    return valid.groupBy(F.col("from_article").alias("src"), F.col("to_article").alias("dst")).agg(F.count(F.lit(1)).alias("w"))


def nodes(graph: DataFrame) -> DataFrame:
    """``(node)``: every article at an end of an edge."""
    return graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()


def out_degrees(graph: DataFrame) -> DataFrame:
    """``(src, out_degree)``, repeated links counted."""
    return graph.groupBy("src").agg(F.sum("w").alias("out_degree"))


def dangling(graph: DataFrame) -> DataFrame:
    """``(node)``: the nodes without an edge out."""
    return nodes(graph).join(graph.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


#: Graphs of at most so many edges (24 bytes each) are iterated within one task; larger ones by a job for each round.
ONE_TASK_EDGES = 2_000_000


def _in_one_task(damping: float, max_iter: int, tol: float):
    """The rounds of :func:`pagerank` over a graph that one task holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        graph = pd.concat(parts, ignore_index=True).sort_values(["src", "dst"])
        ids, at = np.unique(np.concatenate([graph["src"], graph["dst"]]), return_inverse=True)
        src, dst, w = at[: len(graph)], at[len(graph) :], graph["w"].to_numpy(float)
        n = len(ids)
        out = np.bincount(src, w, n)
        p, lost = w / out[src], out == 0
        r = np.full(n, 1 / n)
        residual, done = 0.0, 0
        for done in range(1, max_iter + 1):
            new = (1 - damping) / n + damping * np.bincount(dst, p * r[src], n)
            new += damping * new[lost].sum() / n
            residual, r = float(np.abs(new - r).sum()), new
            if residual < tol:
                break
        yield pd.DataFrame({"article": ids, "score": r, "iterations": done, "residual": residual})

    return run


@dataclass
class PageRank:
    scores: DataFrame
    """``(article, score)``, in sum 1."""
    iterations: int
    residual: float
    n_nodes: int


def pagerank(links: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, normalise: bool = True, one_task_edges: int = ONE_TASK_EDGES) -> PageRank:
    """PageRank of the resolved links.

    Each round takes ``u = (1 - d) / n + d * sum(w / W * r)`` over the edges in, then spreads ``d / n`` times the new mass
    of the dangling nodes over all, until the change in L1 is below ``tol``. Nodes are the ends of edges only; without an
    edge there are no scores, no iterations and no residual. Each round is one job over the edges, joined to the scores by
    source without piling a hot source onto one task, and writes the scores to the shared folder, which keeps the plan short
    and survives lost executors. The sums of a round are taken while it is written: its change is known from the next one, so
    one round more than needed is computed, and dropped. Only the last two rounds stay on disk. A graph counted to have at most ``one_task_edges`` edges is iterated within one task
    instead, with the same steps. ``normalise`` divides by the sum in the end.
    """
    graph = materialise(edges(links), "pr-edges")
    if graph.count() <= one_task_edges:
        found = graph.coalesce(1).mapInPandas(_in_one_task(damping, max_iter, tol), "article long, score double, iterations int, residual double")
        found = materialise(found, "pr-scores")
        total = found.agg(F.count(F.lit(1)), F.sum("score"), F.max("iterations"), F.max("residual")).first()
        final = found.select("article", (F.col("score") / F.lit(total[1] if normalise and total[0] else 1.0)).alias("score"))
        return PageRank(final, total[2] or 0, total[3] or 0.0, total[0])
    points = nodes(graph).join(out_degrees(graph).withColumnRenamed("src", "node"), "node", "left").select("node", F.col("out_degree").isNull().alias("dangling"))
    points = materialise(points, "pr-nodes")
    n = points.count()
    if not n:
        return PageRank(links.sparkSession.createDataFrame([], "article long, score double"), 0, 0.0, 0)
    degrees = out_degrees(graph)
    heavy = {} if fits_broadcast(degrees) else heavy_counts(graph, "src")[1]["src"]
    steps = materialise(skew_join(graph, degrees, "src", "inner", heavy=heavy).select("src", "dst", (F.col("w") / F.col("out_degree")).alias("p")), "pr-steps")
    discard(graph)
    # of a round: u before and r = u + shift after the dangling mass is spread; gap is the change of the round before
    scores = points.select("node", "dangling", F.lit(1.0 / n).alias("u"), F.lit(None).cast("double").alias("before"))
    shift, residual, done = 0.0, 0.0, 0
    while True:
        now = scores.select("node", "dangling", (F.col("u") + F.lit(shift)).alias("r"), "before")
        if done >= max_iter:
            if done:
                residual = now.agg(F.sum(F.abs(F.col("r") - F.col("before")))).first()[0]
            break
        sent = skew_join(steps, now.select(F.col("node").alias("src"), "r"), "src", "inner", heavy=heavy)
        got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("r")).alias("s"))
        new = now.join(got, "node", "left").select("node", "dangling", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("u"), F.col("r").alias("before"), F.abs(F.col("r") - F.col("before")).alias("gap"))
        seen = Observation()
        fresh = materialise(new.observe(seen, F.sum(F.when(F.col("dangling"), F.col("u"))).alias("lost"), F.sum("gap").alias("gap")), "pr-scores")
        if done and seen.get["gap"] < tol:
            residual = seen.get["gap"]
            discard(fresh)
            break
        if done:
            discard(scores)
        scores, shift, done = fresh, damping * (seen.get["lost"] or 0.0) / n, done + 1
    final = scores.select(F.col("node").alias("article"), (F.col("u") + F.lit(shift)).alias("score"))
    if normalise:
        total = final.agg(F.sum("score")).first()[0]
        final = final.withColumn("score", F.col("score") / F.lit(total))
    return PageRank(final, done, residual, n)


def top_articles(ranks: DataFrame, articles: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` articles of highest score with their titles: ``(article, title, score)``, ties by id."""
    return ranks.join(articles.select(F.col("article_id").alias("article"), "title"), "article").orderBy(F.desc("score"), "article").limit(n).select("article", "title", "score")


def rank_stats(ranks: DataFrame) -> DataFrame:
    """One row: ``(n, avg_score, min_score, max_score, sum_score)``, zeros for an empty table."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("n"), zero(F.avg("score")).alias("avg_score"), zero(F.min("score")).alias("min_score"), zero(F.max("score")).alias("max_score"), zero(F.sum("score")).alias("sum_score"))
