"""Queries of the general data problems: references to missing records, and keys that hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import references, skew
from lexmill.session import table

#: p5: a term is heavy above this share of all rows, an article above this number of rows.
TERM_SHARE, ARTICLE_ROWS = 0.01, 300


def _reference_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "internal_link"), table(spark, d, "article"), table(spark, d, "article_deletion")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.check_references(*_reference_tables(spark, d), orphans_only=True).select("link_id", "ref_field")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(*_reference_tables(spark, d))


def p3_current_orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.current_orphans(*_reference_tables(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "inverted_index")
    total, heavy = skew.heavy_keys(rows, "term", "article")
    terms = skew.frequent_keys(rows, "term", total * TERM_SHARE, heavy["term"])
    articles = skew.frequent_keys(rows, "article", ARTICLE_ROWS, heavy["article"])
    return terms.select(F.lit("term").alias("side"), F.col("term").alias("key_text")).unionByName(articles.select(F.lit("article").alias("side"), F.col("article").cast("string").alias("key_text")))


def _scores(column: str) -> list:
    ok = F.expr(f"if(isnan({column}), null, {column})")
    return [F.count(F.lit(1)).alias("n_rows"), F.count(ok).alias("n_scores"), F.round(F.sum(ok), 4).alias("sum_score"), F.max(ok).alias("max_score")]


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Results per term over all postings, with the stored weight of the term joined in."""
    stored = table(spark, d, "vocabulary").groupBy("term").agg(F.max("idf_value").alias("idf_value"))
    out = skew.per_key_results(table(spark, d, "inverted_index").select("term", "tf_idf_score"), "term", [*_scores("tf_idf_score"), F.max("idf_value").alias("idf_value")], stored)
    return out.drop("is_heavy")


def p5_articles(spark: SparkSession, d: str) -> DataFrame:
    """Results per article over all postings, with its rank joined in."""
    ranks = table(spark, d, "pagerank").groupBy("article").agg(F.max("score").alias("rank_score"))
    out = skew.per_key_results(table(spark, d, "inverted_index").select("article", "tf_idf_score"), "article", [*_scores("tf_idf_score"), F.max("rank_score").alias("rank_score")], ranks)
    return out.drop("is_heavy")


QUERIES = {q.__name__: q for q in (p3_found, p3_report, p3_current_orphans, p5_found, p5_terms, p5_articles)}
