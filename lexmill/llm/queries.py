"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import encode, packing, subjects, titles, top_n, vocabulary, weights
from lexmill.session import materialise, ship_package, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.useless_terms(table(spark, d, "article"))


def p1_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    rows = vocabulary.vocabulary(table(spark, d, "article"), table(spark, d, "vocabulary"))
    return rows.withColumns({"stored_idf": F.round("stored_idf", 6), "idf": F.round("idf", 6)})


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """The current scores, written out, as they are read twice."""
    return materialise(top_n.current_scores(table(spark, d, "inverted_index")), "scores")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.top_n_per_group(_scores(spark, d), "term", "score", ["article"], 5).select("term", "article")


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = top_n.top_n_per_group(_scores(spark, d), "term", "score", ["article"], 20)
    return rows.select("term", "rank", "article", F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return titles.found_titles(table(spark, d, "internal_link"), table(spark, d, "article"), table(spark, d, "title_catalog"))


def p4_titles(spark: SparkSession, d: str) -> DataFrame:
    return titles.map_titles(table(spark, d, "internal_link"), table(spark, d, "article"), table(spark, d, "title_catalog"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return titles.unmatched_titles(table(spark, d, "internal_link"), table(spark, d, "article"), table(spark, d, "title_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return weights.most_distinctive(weights.term_weights(table(spark, d, "article"))).select("article_id", "term")


def p6_log_entropy(spark: SparkSession, d: str) -> DataFrame:
    return weights.most_distinctive(weights.term_weights(table(spark, d, "article")), weights.LOG_ENTROPY)


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = weights.weighted_terms(weights.term_weights(table(spark, d, "article")))
    return rows.withColumns({"log_entropy": F.round("log_entropy", 5), "tf_idf": F.round("tf_idf", 5)})


def p6_compared(spark: SparkSession, d: str) -> DataFrame:
    rows = weights.compared(weights.term_weights(table(spark, d, "article")), _scores(spark, d), table(spark, d, "vocabulary"))
    return rows.withColumns({c: F.round(c, 5) for c in ("stored_score", "stored_idf", "idf", "tf_idf", "log_entropy")})


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_counts(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The digest of every text got back from its ids."""
    rows = encode.decode(encode.encode(table(spark, d, "documents")))
    return rows.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def p8_assignments(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.pack_documents(table(spark, d, "documents")))


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialise(encode.token_counts(table(spark, d, "documents")), "p8-audit")
    return packing.audit(materialise(packing.pack_items(sizes), "p8-assigned"), sizes)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_area"), table(spark, d, "subject_label"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents").count())


def p9_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the result: known subjects, shares of a quarter at least, documents with a text only, once each."""
    found, documents = _subjects(spark, d), table(spark, d, "documents")
    areas = table(spark, d, "subject_area").select("subject", F.lit(True).alias("known"))
    texts = documents.where("trim(coalesce(text, '')) <> ''").select("doc_id", F.lit(True).alias("has_text"))
    rows = found.join(F.broadcast(areas), "subject", "left").join(texts, "doc_id", "left")
    sums = rows.agg(F.count_if(F.col("known").isNull()).alias("n_unknown"), F.count_if(F.col("share") < subjects.SHARE).alias("n_below"), F.count_if(F.col("has_text").isNull()).alias("n_without_text"), (F.count(F.lit(1)) - F.count_distinct("doc_id", "subject")).alias("n_repeated"))
    return documents.agg(F.count(F.lit(1)).alias("n_documents")).join(F.broadcast(sums), F.lit(True))


NAMES = (p1_found, p1_vocabulary, p2_found, p2_ranked, p4_found, p4_titles, p4_unmatched, p6_found, p6_log_entropy, p6_weights, p6_compared, p7_ids, p7_token_counts, p7_decoded, p8_assignments, p8_containers, p8_audit, p9_found, p9_composition, p9_audit)


def _shipped(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """The query, its Python code sent to the executors first."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return query(spark, d)

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipped(q) for q in NAMES}


def oracle_sql() -> dict[str, str]:
    from lexmill.llm.sql import ORACLES

    return dict(ORACLES)
