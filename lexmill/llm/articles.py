"""The articles as the term operators see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.tokenizers import NAIVE_STOP

#: The words that are no terms.
STOP_WORDS = tuple(NAIVE_STOP)
TERM = "[a-z0-9]+"


def latest_articles(articles: DataFrame) -> DataFrame:
    """One row for each article id: ``(article_id, text)``, the text of the row with the latest ``loaded_at``.

    The text is the paragraphs that are not null, joined by one space; null or empty arrays give an empty text. Rows
    loaded at one time: the greatest text in byte order counts. A null ``loaded_at`` is earlier than any time. Rows with
    a null id are dropped. The rank is cut to one row before the shuffle, so an id loaded very often does not pile up.
    """
    text = F.coalesce(F.array_join("plain_text_paragraphs", " "), F.lit(""))
    rows = articles.where("article_id is not null").select("article_id", "loaded_at", text.alias("text"))
    order = Window.partitionBy("article_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("text").desc())
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("article_id", "text")


def article_count(articles: DataFrame) -> int:
    """Number of article ids, those without text included."""
    return articles.where("article_id is not null").select("article_id").distinct().count()
