"""Frequency of every distinct term.

Heavy-light aggregation: terms found heavy in a small sample are broadcast to the tasks, each of which counts them in
exact local counter arrays; only the other terms are shuffled by term; the two count tables are united. The sample
decides a term's route, never its counts, which cover every article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.articles import STOP_WORDS, TERM, article_count, latest_articles
from lexmill.session import materialise, ship_package

#: At most so many terms are broadcast and counted in arrays.
MAX_HEAVY = 4096
#: Articles looked at to find them, about.
SAMPLE = 4000
#: A task hands its light counts on when it holds so many terms.
LIGHT_TERMS = 200_000
#: Marks: a term is rare up to this df, common above this share of the articles.
RARE_MAX, COMMON_SHARE = 2, 0.25

_PARTIAL = "term string, n long, df long, heavy_n array<long>, heavy_df array<long>"
_ARROW = pa.schema([("term", pa.string()), ("n", pa.int64()), ("df", pa.int64()), ("heavy_n", pa.list_(pa.int64())), ("heavy_df", pa.list_(pa.int64()))])


def _counter(heavy: list[str]):
    """The function that turns a task's texts into partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, stop, slot = re.compile(TERM).findall, frozenset(STOP_WORDS), {t: i for i, t in enumerate(heavy)}
        heavy_n, heavy_df, light_n, light_df, seen = [0] * len(heavy), [0] * len(heavy), Counter(), Counter(), False

        def light() -> pa.RecordBatch:
            terms = list(light_n)
            none = pa.nulls(len(terms), _ARROW.field("heavy_n").type)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([light_n[t] for t in terms], pa.int64()), pa.array([light_df[t] for t in terms], pa.int64()), none, none], schema=_ARROW)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for term, n in Counter(find(text.lower())).items():
                    if term in stop:
                        continue
                    i = slot.get(term)
                    if i is None:
                        light_n[term] += n
                        light_df[term] += 1
                    else:
                        heavy_n[i] += n
                        heavy_df[i] += 1
                        seen = True
            if len(light_n) >= LIGHT_TERMS:
                yield light()
                light_n.clear(), light_df.clear()
        if light_n:
            yield light()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([heavy_n], pa.list_(pa.int64())), pa.array([heavy_df], pa.list_(pa.int64()))], schema=_ARROW)

    return run


def find_heavy_terms(articles: DataFrame, n_articles: int, max_heavy: int = MAX_HEAVY, sample: int = SAMPLE) -> list[str]:
    """The terms most frequent in a sample of about ``sample`` article rows, ``max_heavy`` at most."""
    few = articles if n_articles <= sample else articles.sample(sample / n_articles, seed=7)
    words = few.select(F.explode("plain_text_paragraphs").alias("p")).select(F.explode(F.regexp_extract_all(F.lower("p"), F.lit(TERM), 0)).alias("term"))
    top = words.where(~F.col("term").isin(*STOP_WORDS)).groupBy("term").count().where("count > 1").orderBy(F.desc("count"), "term").limit(max_heavy)
    return [r["term"] for r in top.collect()]


def term_frequencies(articles: DataFrame, n_articles: int | None = None, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """Occurrences and document frequency of every term: ``(term, occurrences, document_frequency)``.

    Terms are the runs of a-z and 0-9 in the lower-cased text of each article's latest row, without the stop words. Null
    and blank paragraphs and texts without a term count nothing; an empty table gives no row. Repeated loads of an
    article count once. Texts are read whole, however long.
    """
    ship_package(articles.sparkSession)
    n_articles = article_count(articles) if n_articles is None else n_articles
    heavy = find_heavy_terms(articles, n_articles, max_heavy)
    partial = materialise(latest_articles(articles).select("text").mapInArrow(_counter(heavy), _PARTIAL), "p1-counts")
    totals = [F.sum("n").alias("occurrences"), F.sum("df").alias("document_frequency")]
    light = partial.where("term is not null").groupBy("term").agg(*totals)
    if not heavy:
        return light
    names = F.broadcast(articles.sparkSession.createDataFrame(list(enumerate(heavy)), "slot int, term string"))
    arrays = partial.where("heavy_n is not null").select(F.posexplode(F.arrays_zip("heavy_n", "heavy_df"))).select(F.col("pos").alias("slot"), F.col("col.heavy_n").alias("n"), F.col("col.heavy_df").alias("df")).where("df > 0")
    hot = arrays.groupBy("slot").agg(*totals).join(names, "slot").select("term", "occurrences", "document_frequency")
    return light.unionByName(hot)


def mark(n_articles: int, rare_max: int = RARE_MAX, common_share: float = COMMON_SHARE):
    """``rare``, ``common`` or null for a ``document_frequency``; what is both (tiny collections) is ``rare``."""
    df = F.col("document_frequency")
    return F.when(df <= rare_max, "rare").when(df > common_share * n_articles, "common")


def vocabulary(articles: DataFrame, stored: DataFrame, rare_max: int = RARE_MAX, common_share: float = COMMON_SHARE) -> DataFrame:
    """The terms of the articles beside a stored vocabulary.

    ``(term, occurrences, document_frequency, mark, stored_df, stored_idf, idf, state)``; ``state`` is ``same``, ``lags``
    (another df is stored), ``missing`` (not stored) or ``orphan`` (stored, but in no article: zero counts, null mark and
    idf). Terms stored more than once: the greatest df counts.
    """
    n = article_count(articles)
    old = stored.where("term is not null").groupBy("term").agg(F.max("document_frequency").alias("stored_df"), F.max_by("idf_value", "document_frequency").alias("stored_idf"))
    both = term_frequencies(articles, n).join(old, "term", "full")
    state = F.when(F.col("document_frequency").isNull(), "orphan").when(F.col("stored_df").isNull(), "missing").when(F.col("stored_df") == F.col("document_frequency"), "same").otherwise("lags")
    return both.select(
        "term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("document_frequency", F.lit(0)).alias("document_frequency"), mark(n, rare_max, common_share).alias("mark"),
        "stored_df", "stored_idf", F.when(F.col("document_frequency") > 0, F.ln(F.lit(float(max(n, 1))) / F.col("document_frequency"))).alias("idf"), state.alias("state"),
    )


def useless_terms(articles: DataFrame, rare_max: int = RARE_MAX, common_share: float = COMMON_SHARE) -> DataFrame:
    """The terms too rare or too common: ``(term, mark)``."""
    n = article_count(articles)
    return term_frequencies(articles, n).select("term", mark(n, rare_max, common_share).alias("mark")).where("mark is not null")
