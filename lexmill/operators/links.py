"""Resolution, rewriting and statistics of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import LINK, unquote
from lexmill.operators.skew import skew_join, skew_joins
from lexmill.session import materialise


def by_title(articles: DataFrame) -> DataFrame:
    """``(title, article_id)``, the smallest id of each title; null titles left out."""
    return articles.where("title is not null").groupBy("title").agg(F.min("article_id").alias("article_id"))


def resolve_links(links: DataFrame, articles: DataFrame) -> DataFrame:
    """The links with both ends filled in: all columns, ``from_article`` and ``to_article`` resolved, and ``updated``.

    A link is updated only if its ``from_page_id`` is the page of an article and its ``to_title`` letter for letter a title
    (of several articles, the smallest id); ends already known stay. Otherwise both ends stay as they were. Repeated link
    rows stay. Hot pages and titles are joined without piling onto one task.
    """
    articles = materialise(articles.select("article_id", "page_id", "title"), "names")
    pages = articles.where("page_id is not null").groupBy("page_id").agg(F.min("article_id").alias("__from")).withColumnRenamed("page_id", "from_page_id")
    titles = by_title(articles).select(F.col("title").alias("to_title"), F.col("article_id").alias("__to"))
    both = skew_joins(links, "left", (pages, "from_page_id"), (titles, "to_title"))
    hit = F.col("__from").isNotNull() & F.col("__to").isNotNull()
    return both.withColumns(
        {
            "from_article": F.when(hit, F.coalesce("from_article", "__from")).otherwise(F.col("from_article")),
            "to_article": F.when(hit, F.coalesce("to_article", "__to")).otherwise(F.col("to_article")),
            "updated": hit,
        }
    ).drop("__from", "__to")


def unresolved(links: DataFrame) -> DataFrame:
    """Links with an end that may still be resolved."""
    return links.where("(from_article is null and from_page_id is not null) or to_article is null")


def link_counts(links: DataFrame) -> DataFrame:
    """One row: ``(n_links, n_unresolved, n_to_null, n_resolved, min_id, max_id)``; ids null for an empty table."""
    return links.agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(F.expr("(from_article is null and from_page_id is not null) or to_article is null")).alias("n_unresolved"),
        F.count_if(F.col("to_article").isNull()).alias("n_to_null"),
        F.count_if(F.expr("from_article is not null and to_article is not null")).alias("n_resolved"),
        F.min("link_id").alias("min_id"),
        F.max("link_id").alias("max_id"),
    )


def missing_titles(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Titles linked to that no article bears: ``(to_title, n_links)``."""
    named = links.groupBy("to_title").agg(F.count(F.lit(1)).alias("n_links")).where("to_title is not null")
    return named.join(articles.select(F.col("title").alias("to_title")), "to_title", "left_anti")


def resolve_titles(titles: DataFrame, articles: DataFrame) -> DataFrame:
    """``(title, article_id)`` for each distinct title: the exact bearer, else one that differs in case only, else null.

    Of several bearers the smallest id. Null titles are left out.
    """
    asked = titles.select("title").where("title is not null").distinct()
    exact = by_title(articles).withColumnRenamed("article_id", "exact_id")
    folded = articles.where("title is not null").groupBy(F.lower("title").alias("folded")).agg(F.min("article_id").alias("folded_id"))
    found = asked.join(exact, "title", "left").withColumn("folded", F.lower("title")).join(folded, "folded", "left")
    return found.select("title", F.coalesce("exact_id", "folded_id").alias("article_id"))


def rewrite_links(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """Paragraphs with each link to a known title pointing to ``/article/<page_id>/`` and others reduced to their anchor.

    ``pages(page_id, raw_paragraphs)`` gives ``(page_id, paragraphs)``; null paragraphs become empty. The links of all pages
    are resolved in one join; only pages with links are put together again.
    """
    paragraphs = pages.select("page_id", F.posexplode_outer("raw_paragraphs").alias("pos", "paragraph"))
    # text before, between and after the links, and the links, in turn
    pieces = paragraphs.select("page_id", "pos", F.posexplode(F.arrays_zip(F.split(F.coalesce("paragraph", F.lit("")), LINK, -1).alias("text"), F.regexp_extract_all(F.coalesce("paragraph", F.lit("")), F.lit(LINK), 1).alias("href"), F.regexp_extract_all(F.coalesce("paragraph", F.lit("")), F.lit(LINK), 2).alias("anchor"))).alias("at", "x"))
    pieces = pieces.select("page_id", "pos", "at", "x.text", "x.anchor", unquote(F.col("x.href")).alias("title"))
    ids = resolve_titles(pieces, articles)
    target = ids.join(articles.groupBy("article_id").agg(F.min("page_id").alias("target")), "article_id").select("title", "target")
    found = skew_join(pieces, target, "title", "left")
    link = F.when(F.col("anchor").isNull(), "").when(F.col("target").isNotNull(), F.concat(F.lit('<a href="/article/'), F.col("target").cast("string"), F.lit('/">'), F.col("anchor"), F.lit("</a>"))).otherwise(F.col("anchor"))
    whole = found.withColumn("piece", F.concat(F.coalesce("text", F.lit("")), link)).groupBy("page_id", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]), "").alias("paragraph"))
    return whole.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "paragraph"))), lambda s: s["paragraph"]).alias("paragraphs"))


def article_detail(articles: DataFrame, page_id: int, paragraphs: str = "plain_text_paragraphs") -> DataFrame:
    """The article of one page: ``(page_id, article_id, title, paragraphs)``, its links rewritten; no row if there is none.

    Of several articles of the page that of the smallest id. Null and empty paragraphs arrays give an empty array.
    """
    one = articles.where(F.col("page_id") == page_id).orderBy("article_id").limit(1)
    shown = rewrite_links(one.select("page_id", F.col(paragraphs).alias("raw_paragraphs")).where(F.size(F.col("raw_paragraphs")) > 0), articles)
    none = F.array().cast("array<string>")
    return one.select("page_id", "article_id", "title").join(shown, "page_id", "left").select("page_id", "article_id", "title", F.coalesce("paragraphs", none).alias("paragraphs"))


def search_links(links: DataFrame, articles: DataFrame, text: str) -> DataFrame:
    """Links whose title, source title or target title contains ``text``, whatever its case."""
    titles = materialise(articles.groupBy("article_id").agg(F.min("title").alias("t")), "names")
    sources = titles.select(F.col("article_id").alias("from_article"), F.col("t").alias("from_title"))
    targets = titles.select(F.col("article_id").alias("to_article"), F.col("t").alias("target_title"))
    rows = skew_joins(links, "left", (sources, "from_article"), (targets, "to_article"))
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    return rows.where(has(F.col("to_title")) | has(F.col("from_title")) | has(F.col("target_title")))


def search_titles(articles: DataFrame, text: str) -> DataFrame:
    """Articles whose title contains ``text``, whatever its case."""
    return articles.where(F.contains(F.lower("title"), F.lower(F.lit(text))))

