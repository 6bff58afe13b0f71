"""Term statistics and the inverted index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import body
from lexmill.functions.tokenizers import naive
from lexmill.operators.skew import skew_join


def term_frequencies(articles: DataFrame, tokens: Callable[[Column], Column] = naive) -> DataFrame:
    """``(article_id, term, tf)`` over the joined paragraphs; articles without a term have no row."""
    words = articles.select("article_id", F.explode(tokens(body(F.col("plain_text_paragraphs")))).alias("term"))
    return words.groupBy("article_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """``(term, document_frequency)``."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"))


def vocabulary(tf: DataFrame, n_articles: int) -> DataFrame:
    """``(term, document_frequency, idf_value)`` with idf = ln(N / df), not smoothed: a term of every article has 0."""
    return document_frequencies(tf).withColumn("idf_value", F.ln(F.lit(float(max(n_articles, 1))) / F.col("document_frequency")))


def inverted_index(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(term, article_id, tf_idf_score)``, the score tf * idf; terms unknown to ``vocab`` are left out.

    The join sends no heavy term through one task: its few vocabulary rows are broadcast.
    """
    joined = skew_join(tf, vocab.select("term", "idf_value"), "term", "inner")
    return joined.select("term", "article_id", (F.col("tf") * F.col("idf_value")).alias("tf_idf_score"))


def index_summary(tf: DataFrame, n_articles: int) -> DataFrame:
    """One row: ``(n_articles, n_terms, n_postings, avg_terms)``; articles without a term count in N and in the mean."""
    totals = document_frequencies(tf).agg(F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("document_frequency"), F.lit(0)).alias("n_postings"))
    return totals.select(F.lit(n_articles).cast("long").alias("n_articles"), "n_terms", "n_postings", F.when(F.lit(n_articles > 0), F.col("n_postings") / F.lit(max(n_articles, 1))).alias("avg_terms"))


def top_postings(postings: DataFrame, n: int) -> DataFrame:
    """The ``n`` postings of each term with the highest score, ties by article: ``(term, article, tf_idf_score, rank)``.

    The literal limit lets Spark cut each term inside the tasks, before the shuffle.
    """
    order = Window.partitionBy("term").orderBy(F.desc("tf_idf_score"), F.asc("article"))
    return postings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
