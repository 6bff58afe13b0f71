"""The corpus tables as the operators use them: current articles, current postings, keys and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_articles(articles: DataFrame) -> DataFrame:
    """The row with the latest ``loaded_at`` of each article id; null ids dropped. Tied rows: the greatest text."""
    text = F.coalesce(F.array_join("plain_text_paragraphs", " "), F.lit(""))
    order = Window.partitionBy("article_id").orderBy(F.col("loaded_at").desc_nulls_last(), text.desc())
    return articles.where("article_id is not null").withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def current_columns(articles: DataFrame, *columns: str) -> DataFrame:
    """``article_id`` and these columns of the rows :func:`current_articles` takes, without a shuffle of the texts.

    The latest row of an id is found by its time alone; the texts are looked at, and only of these ids, where several rows
    have the latest time.
    """
    known = articles.where("article_id is not null")
    slim = known.select("article_id", "loaded_at", *[c for c in columns if c != "loaded_at"])
    order = Window.partitionBy("article_id").orderBy(F.col("loaded_at").desc_nulls_last())
    first = slim.withColumns({"__rank": F.rank().over(order), "__rn": F.row_number().over(order)}).where("__rank = 1 and __rn <= 2")
    tied = first.where("__rn = 2").select("article_id")
    alone = first.join(tied, "article_id", "left_anti")
    judged = current_articles(known.join(tied, "article_id", "left_semi"))
    return alone.select("article_id", *columns).unionByName(judged.select("article_id", *columns))


def current_postings(postings: DataFrame) -> DataFrame:
    """The current score of each (term, article): ``(term, article, tf_idf_score)``, null and NaN scores left out.

    The row with the latest ``indexed_at`` counts, of tied ones that with the greatest ``posting_id``.
    """
    order = Window.partitionBy("term", "article").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("posting_id").desc_nulls_last())
    last = postings.where("term is not null and article is not null").withColumn("__rn", F.row_number().over(order)).where("__rn = 1")
    return last.where("tf_idf_score is not null and not isnan(tf_idf_score)").select("term", "article", "tf_idf_score")


def current_ranks(pagerank: DataFrame) -> DataFrame:
    """One score for each article, the greatest that is no NaN: ``(article, score)``; articles without one have no row."""
    return pagerank.where("article is not null and score is not null and not isnan(score)").groupBy("article").agg(F.max("score").alias("score"))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``; a load that keeps what came first."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def with_row_ids(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Surrogate ids 1, 2, 3 ... in ``order``, without gathering the rows in one task.

    Rows are sorted by range; the number of rows before each partition is added to the position within it.
    """
    spark = rows.sparkSession
    ordered = rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__mono", F.monotonically_increasing_id())
    from lexmill.session import materialise

    kept = materialise(ordered, "ids")
    sizes = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    shift = F.broadcast(spark.createDataFrame(offsets, "__part int, __before long"))
    place = F.col("__mono") - F.col("__part").cast("long") * F.lit(1 << 33)
    return kept.join(shift, "__part").withColumn(name, F.col("__before") + place + 1).drop("__part", "__mono", "__before")


#: Keys that must be unique, and references that must be met, by table.
UNIQUE = {"article": [["page_id"]], "vocabulary": [["term"]], "inverted_index": [["term", "article"]], "pagerank": [["article"]]}
FOREIGN = [("inverted_index", "term", "vocabulary", "term"), ("inverted_index", "article", "article", "article_id"), ("pagerank", "article", "article", "article_id"), ("internal_link", "from_article", "article", "article_id"), ("internal_link", "to_article", "article", "article_id")]


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Broken keys: ``(kind, table_name, key, n_keys)``, ``n_keys`` the distinct values repeated, or without their target.

    Rows with a null in the key are no breach. One row for each constraint, with 0 where it holds.
    """
    out = []
    for name, keys in UNIQUE.items():
        for key in keys:
            repeated = tables[name].dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            out.append(repeated.agg(F.count(F.lit(1)).alias("n_keys")).select(F.lit("unique").alias("kind"), F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key"), "n_keys"))
    for name, column, target, target_column in FOREIGN:
        mine = tables[name].where(F.col(column).isNotNull()).select(F.col(column).alias("k")).distinct()
        theirs = tables[target].where(F.col(target_column).isNotNull()).select(F.col(target_column).alias("k")).distinct()
        out.append(mine.join(theirs, "k", "left_anti").agg(F.count(F.lit(1)).alias("n_keys")).select(F.lit("foreign").alias("kind"), F.lit(name).alias("table_name"), F.lit(column).alias("key"), "n_keys"))
    return reduce(DataFrame.unionByName, out)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the articles of ``gone(article_id)`` and all rows that refer to them."""
    gone = gone.select(F.col("article_id").alias("k")).where("k is not null").distinct()
    columns = {"article": ["article_id"], "inverted_index": ["article"], "pagerank": ["article"], "internal_link": ["from_article", "to_article"]}
    out = dict(tables)
    for name, keys in columns.items():
        for key in keys:
            out[name] = out[name].join(gone, out[name][key] == gone["k"], "left_anti")
    return out


def parity_errors(articles: DataFrame) -> DataFrame:
    """Articles whose token counts do not fit their paragraphs: ``(article_id, n_paragraphs, n_counts)``; null is 0 long."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    sized = articles.select("article_id", F.greatest(F.lit(0), size("plain_text_paragraphs")).alias("n_paragraphs"), F.greatest(F.lit(0), size("paragraph_token_counts")).alias("n_counts"))
    return sized.where("n_paragraphs <> n_counts")
