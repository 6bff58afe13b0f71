"""How distinctive a term is for a record.

Log-entropy weighting: ``ln(1 + tf) * (1 - H)``, where ``H`` is the entropy of the term's spread over the records,
divided by ``ln N``. Two SQL aggregations: counts of (article, term), then sums for each term, which give the entropy
(``H = ln gf - sum(tf ln tf) / gf``) and the document frequency together. The same sums serve ``tf * ln(N / df)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.articles import STOP_WORDS, TERM, article_count, latest_articles
from lexmill.operators.skew import fits_broadcast, heavy_counts, skew_join
from lexmill.session import materialise

#: Global weights of so many terms at most are broadcast (those of highest df); terms beyond are joined by a shuffle.
MAX_BROADCAST_TERMS = 20_000


@dataclass
class TermWeights:
    """``counts``: (article_id, term, tf); ``terms``: (term, pos, df, gf, entropy, idf), ``pos`` ascending with the term."""

    counts: DataFrame
    terms: DataFrame
    n_articles: int
    n_terms: int


def term_weights(articles: DataFrame) -> TermWeights:
    """The two aggregations. Terms as in :mod:`lexmill.llm.vocabulary`; N counts articles without text too."""
    n = article_count(articles)
    words = latest_articles(articles).select("article_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0)).alias("term"))
    tf = words.where(~F.col("term").isin(*STOP_WORDS)).groupBy("article_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    tf = materialise(tf, "p6-tf")
    sums = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.ln("tf")).alias("s"))
    total = F.ln(F.lit(float(n)))
    entropy = F.lit(0.0) if n < 2 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.ln("gf") - F.col("s") / F.col("gf")) / total))
    sums = materialise(sums.select("term", "df", "gf", entropy.alias("entropy"), F.ln(F.lit(float(max(n, 1))) / F.col("df")).alias("idf")), "p6-sums")
    terms = materialise(sums.orderBy("term").withColumn("pos", F.monotonically_increasing_id()), "p6-terms")
    return TermWeights(tf, terms, n, terms.count())


LOG_ENTROPY = "ln(1 + tf) * (1 - entropy)"
TF_IDF = "tf * idf"


def _with_terms(w: TermWeights, columns: list[str], max_broadcast: int) -> list[DataFrame]:
    """The counts with ``columns`` of their terms; in two parts if the terms are too many to broadcast: the hottest, which hold most
    counts, are, and the counts of the others meet them by a shuffle."""
    terms = w.terms.select("term", *columns)
    if w.n_terms <= max_broadcast:
        return [w.counts.join(F.broadcast(terms), "term")]
    cut = w.terms.orderBy(F.desc("df"), "term").limit(max_broadcast)
    hot = F.broadcast(materialise(cut.select("term", *columns), "p6-hot"))
    return [w.counts.join(hot, "term"), w.counts.join(F.broadcast(hot.select("term")), "term", "left_anti").join(terms.join(F.broadcast(hot.select("term")), "term", "left_anti"), "term")]


def weighted_terms(w: TermWeights, max_broadcast: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """Every (article, term) with its weights: ``(article_id, term, tf, df, log_entropy, tf_idf)``."""
    out = None
    for part in _with_terms(w, ["df", "entropy", "idf"], max_broadcast):
        part = part.select("article_id", "term", "tf", "df", F.expr(LOG_ENTROPY).alias("log_entropy"), F.expr(TF_IDF).alias("tf_idf"))
        out = part if out is None else out.unionByName(part)
    return out


def compared(w: TermWeights, scores: DataFrame, stored: DataFrame, max_broadcast: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """The stored scores beside the weights: ``(term, article, stored_score, stored_idf, tf, idf, tf_idf, log_entropy)``.

    ``scores(term, article, score)`` without repeats, ``stored(term, idf_value)``, of which the greatest value of a term
    counts. Every row of ``scores`` has one; what the article's text no longer holds has null weights, an unknown term a
    null ``stored_idf``.
    """
    indexed = scores.select("term", F.col("article").alias("article_id"), F.col("score").alias("stored_score"))
    own = TermWeights(w.counts.join(indexed, ["article_id", "term"]), w.terms, w.n_articles, w.n_terms)
    held = None
    for part in _with_terms(own, ["entropy", "idf"], max_broadcast):
        part = part.select("article_id", "term", "tf", "idf", F.expr(TF_IDF).alias("tf_idf"), F.expr(LOG_ENTROPY).alias("log_entropy"))
        held = part if held is None else held.unionByName(part)
    old = stored.where("term is not null").groupBy("term").agg(F.max("idf_value").alias("stored_idf"))
    rows = skew_join(indexed.join(held, ["article_id", "term"], "left"), old, "term", "left", heavy=heavy_counts(scores, "term")[1]["term"])
    return rows.select("term", F.col("article_id").alias("article"), "stored_score", "stored_idf", "tf", "idf", "tf_idf", "log_entropy")


def most_distinctive(w: TermWeights, scheme: str = TF_IDF, max_broadcast: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """For each article its term of highest weight: ``(article_id, term, weight)``.

    The weight is rounded to 6 decimals; of equal weights the term first in byte order. Articles without a term have no
    row. Weight and term position are packed into one fixed-width number, so the aggregate is hashed and each task hands on
    one row for each of its articles.
    """
    step = F.lit("10000000000000000000").cast("decimal(20,0)")
    best = None
    for part in _with_terms(w, ["pos", "entropy", "idf"], max_broadcast):
        micro = F.floor(F.expr(scheme) * 1e6 + 0.5).cast("decimal(18,0)")
        packed = (micro * step - F.col("pos").cast("decimal(20,0)")).cast("decimal(38,0)")
        part = part.select("article_id", packed.alias("packed"))
        best = part if best is None else best.unionByName(part)
    top = best.groupBy("article_id").agg(F.max("packed").alias("packed"))
    micro = F.ceil(F.col("packed") / step)
    top = top.select("article_id", micro.cast("long").alias("micro"), (micro * step - F.col("packed")).cast("long").alias("pos"))
    names = w.terms.select("pos", "term")
    if not fits_broadcast(names):
        top = materialise(top, "p6-best")  # read twice, to find the terms that are best for very many articles
    return skew_join(top, names, "pos").select("article_id", "term", (F.col("micro") / 1e6).alias("weight"))
