"""Batched hybrid search: every query of a table in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import snippet
from lexmill.functions.tokenizers import naive
from lexmill.operators.skew import fits_broadcast, heavy_counts, salted
from lexmill.session import materialise

#: Scores that agree to so many decimals are ties, so that the order of a distributed sum decides nothing.
TIE_DECIMALS = 12
#: Fixed value: articles looked at beyond the limit, as some may not exist.
LOOK_AHEAD = 10
# Factors for a title equal to, beginning with, and containing the query; letters needed for the last.
EXACT, PREFIX, INSIDE, INSIDE_CHARS = 1.5, 1.1, 1.05, 4


@dataclass(frozen=True)
class HybridParams:
    """Parameters of a search; ``policy`` is ``balanced``, ``strict`` or ``len2_strict``."""

    limit: int = 20
    alpha: float = 0.85
    max_candidates: int = 500
    coverage_bonus: float = 0.0
    strict_and: bool = False
    policy: str = "balanced"
    partial_boost: bool = True

    def __post_init__(self):
        if self.policy not in ("balanced", "strict", "len2_strict"):
            raise ValueError(f"unknown policy {self.policy!r}")
        if self.limit < 1 or self.max_candidates < 1:
            raise ValueError("limit and max_candidates must be positive")


def query_terms(queries: DataFrame, tokens: Callable[[Column], Column] = naive) -> DataFrame:
    """``(query_id, n_terms, term)``: the distinct terms of each query; ``n_terms`` counts repeats and unknown ones too."""
    cut = queries.where("query is not null").select("query_id", tokens(F.col("query")).alias("t"))
    return cut.select("query_id", F.size("t").alias("n_terms"), F.explode(F.array_distinct("t")).alias("term"))


def query_tokens(queries: DataFrame, tokens: Callable[[Column], Column] = naive) -> DataFrame:
    """``(query_id, tokens)``: the tokens of each query as they are shown beside its results; null and empty give ``[]``."""
    return queries.select("query_id", tokens(F.col("query")).alias("tokens"))


def least_coverage(n_terms: Column, params: HybridParams) -> Column:
    """Terms of the query that an article must hold."""
    if params.policy == "strict":
        return n_terms
    some = F.when(n_terms == 1, 1)
    if params.strict_and:
        some = some.when(n_terms <= 5, n_terms)
    return some.otherwise(2)


def _of_point(grid: list[HybridParams], value: Callable[[HybridParams], object]) -> Column:
    """A value that depends on the parameters, by the column ``point``; a literal if there is one set only."""
    values = [value(p) for p in grid]
    values = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return values[0] if len(grid) == 1 else F.element_at(F.array(*values), F.col("point") + 1)


def candidates(queries: DataFrame, vocab: DataFrame, postings: DataFrame, grid: list[HybridParams], tokens: Callable[[Column], Column] = naive) -> DataFrame:
    """``(point, query_id, article, coverage, s)`` of the articles that hold enough terms, for each parameter set of ``grid``.

    Each known term brings its best ``ceil(max_candidates / known terms)`` postings. Posting lists are cut to the greatest
    ``max_candidates`` inside the tasks, once for each term of the batch, before they meet the queries; sums are taken once
    for each ``max_candidates`` of the grid, and only then the other parameters come in.
    """
    widths = sorted({p.max_candidates for p in grid})
    terms = query_terms(queries, tokens).join(vocab.select("term").distinct(), "term")
    terms = terms.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    order = Window.partitionBy("term").orderBy(F.desc("tf_idf_score"), F.asc("article"))
    asked = postings.select("term", "article", "tf_idf_score").join(terms.select("term").distinct(), "term", "left_semi")
    lists = asked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= widths[-1])
    if fits_broadcast(queries):
        hits = terms.join(lists, "term")
    else:  # a term that very many queries share is spread, its list repeated
        a, b = salted(terms, lists, "term", heavy_counts(terms, "term")[1]["term"])
        hits = a.join(b, ["term", "__salt"])
    hits = hits.withColumn("width", F.lit(widths[0]) if len(widths) == 1 else F.explode(F.array(*map(F.lit, widths))))
    hits = hits.where(F.col("place") <= F.ceil(F.col("width").cast("double") / F.col("known")))
    found = hits.groupBy("query_id", "n_terms", "width", "article").agg(F.sum("tf_idf_score").alias("s"), F.count(F.lit(1)).alias("coverage"))
    if len(grid) == 1:
        found = found.withColumn("point", F.lit(0))
    else:
        points = [F.array(*[F.lit(i) for i, p in enumerate(grid) if p.max_candidates == w]) for w in widths]
        found = found.withColumn("point", F.explode(F.element_at(F.create_map(*[x for w, ps in zip(widths, points, strict=True) for x in (F.lit(w), ps)]), F.col("width"))))
    found = found.where(F.col("coverage") >= _of_point(grid, lambda p: least_coverage(F.col("n_terms"), p)))
    if any(p.coverage_bonus for p in grid):
        bonus = _of_point(grid, lambda p: float(p.coverage_bonus))
        found = found.withColumn("s", F.when((F.col("coverage") > 1) & (bonus != 0), F.col("s") + bonus * F.log1p(F.col("coverage") - 1)).otherwise(F.col("s")))
    return found.select("point", "query_id", "article", "coverage", "s")


def _over_max(value: Column, top: Column) -> Column:
    return F.when(top > 0, value / top).otherwise(value)


def search_grid(queries: DataFrame, vocab: DataFrame, postings: DataFrame, ranks: DataFrame, articles: DataFrame, grid: list[HybridParams], tokens: Callable[[Column], Column] = naive) -> DataFrame:
    """:func:`search_hybrid` for several parameter sets in one plan: ``(point, query_id, rank, article_id, title, score)``.

    ``point`` is the number of the set in ``grid``. The postings are read and joined once for all of them.
    """
    found = candidates(queries, vocab, postings, grid, tokens)
    key = ["point", "query_id"]
    ranked = found.join(ranks.select("article", F.col("score").alias("pr")), "article", "left")
    tops = ranked.groupBy(*key).agg(F.max("s").alias("top_s"), F.max("pr").alias("top_pr"), F.percentile("pr", F.lit(0.5)).alias("mid_pr"))
    both = ranked.join(tops, key)
    t = _over_max(F.col("s"), F.col("top_s"))
    p = F.coalesce(_over_max(F.coalesce("pr", "mid_pr"), F.col("top_pr")), F.lit(0.0))
    mixed = _of_point(grid, lambda x: float(x.alpha)) * t + _of_point(grid, lambda x: float(1 - x.alpha)) * p
    both = both.select(*key, "article", F.round(t, TIE_DECIMALS).alias("t"), F.round(p, TIE_DECIMALS).alias("p"), F.round(mixed, TIE_DECIMALS).alias("h"))
    order = [F.desc("t"), F.desc("p"), F.asc("article")]
    place = Window.partitionBy(*key).orderBy(F.desc("h"), *order)
    limit, most = _of_point(grid, lambda x: x.limit), max(x.limit for x in grid)
    first = both.withColumn("rn", F.row_number().over(place)).where(F.col("rn") <= most + LOOK_AHEAD).where(F.col("rn") <= limit + LOOK_AHEAD)
    titled = first.join(articles.select(F.col("article_id").alias("article"), "title"), "article").join(queries.select("query_id", F.lower("query").alias("q")), "query_id")
    kept = titled.withColumn("rn", F.row_number().over(place)).where(F.col("rn") <= most).where(F.col("rn") <= limit)
    name = F.lower("title")
    partial = _of_point(grid, lambda x: x.partial_boost)
    boost = F.when(name == F.col("q"), EXACT).when(partial & F.startswith(name, F.col("q")), PREFIX).when(partial & (F.length("q") >= INSIDE_CHARS) & F.contains(name, F.col("q")), INSIDE)
    kept = kept.withColumn("score", F.round(F.col("h") * boost.otherwise(1.0), TIE_DECIMALS))
    final = Window.partitionBy(*key).orderBy(F.desc("score"), *order)
    return kept.select(*key, F.row_number().over(final).alias("rank"), F.col("article").alias("article_id"), "title", "score")


def search_hybrid(queries: DataFrame, vocab: DataFrame, postings: DataFrame, ranks: DataFrame, articles: DataFrame, params: HybridParams = HybridParams(), tokens: Callable[[Column], Column] = naive) -> DataFrame:  # noqa: B008
    """The best articles of each query: ``(query_id, rank, article_id, title, score)``.

    ``queries(query_id, query)``, ``postings(term, article, tf_idf_score)`` and ``ranks(article, score)`` without repeats,
    ``articles(article_id, title)``. Scores are the normalised term scores and ranks blended by ``alpha``, raised by the
    title, in the order score, term part, rank part, article id. An article without a rank has the median of the
    candidates' ranks, or 0 if none has one. Null, empty and unknown queries have no rows. A title boost reorders the best
    ``limit`` and never lifts an article into them.
    """
    return search_grid(queries, vocab, postings, ranks, articles, [params], tokens).drop("point")


def search_titles_exact(queries: DataFrame, articles: DataFrame, limit: int = 20) -> DataFrame:
    """``(query_id, rank, article_id, title)``: articles whose title is the query but for case, by id."""
    asked = queries.where("query is not null").select("query_id", F.upper("query").alias("k"))
    same = asked.join(articles.select(F.upper("title").alias("k"), "article_id", "title"), "k")
    order = Window.partitionBy("query_id").orderBy("article_id")
    return same.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "article_id", "title")


def search_with_fallback(queries: DataFrame, vocab: DataFrame, postings: DataFrame, ranks: DataFrame, articles: DataFrame, params: HybridParams = HybridParams(), tokens: Callable[[Column], Column] = naive) -> DataFrame:  # noqa: B008
    """Hybrid results, and for queries without any the articles of that title with score 1, with snippets.

    ``(query_id, rank, article_id, title, score, snippet, via)``; ``articles`` also has ``plain_text_paragraphs``.
    """
    hybrid = materialise(search_hybrid(queries, vocab, postings, ranks, articles, params, tokens), "hybrid").withColumn("via", F.lit("hybrid"))
    left = queries.join(hybrid.select("query_id").distinct(), "query_id", "left_anti")
    title = search_titles_exact(left, articles, params.limit).withColumn("score", F.lit(1.0)).withColumn("via", F.lit("title"))
    rows = hybrid.unionByName(title)
    return rows.join(articles.select("article_id", snippet(F.col("plain_text_paragraphs")).alias("snippet")), "article_id").select("query_id", "rank", "article_id", "title", "score", "snippet", "via")
