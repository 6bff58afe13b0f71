"""Queries of the search engine's own operators over the corpus tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text, tokenizers
from lexmill.operators import corpus, evaluate, graph, index, links, qa, search, settings, stats
from lexmill.operators.search import HybridParams
from lexmill.operators.skew import skew_join
from lexmill.session import materialise, table
from lexmill.streaming.ingest import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def articles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.current_articles(table(spark, d, "article"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """The current articles without their texts."""
    return corpus.current_columns(table(spark, d, "article"), "page_id", "title")


def n_articles(spark: SparkSession, d: str) -> int:
    return table(spark, d, "article").select("article_id").distinct().count()


# --- tokens and text ---


@query
def tokenize_naive_counts(spark, d):
    t = tokenizers.naive(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query
def tokenize_word_counts(spark, d):
    t = tokenizers.word(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query
def tokenize_gpt_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokenizers.gpt(F.col("text"))).alias("n_tokens"))


@query
def paragraph_token_counts(spark, d):
    counts = F.transform(F.coalesce("plain_text_paragraphs", F.array().cast("array<string>")), lambda p: F.size(tokenizers.naive(p)))
    return articles(spark, d).select("article_id", counts.alias("c")).select("article_id", F.size("c").alias("n_paragraphs"), F.aggregate("c", F.lit(0), lambda a, b: a + b).alias("n_tokens"))


@query
def snippets(spark, d):
    return articles(spark, d).select("article_id", text.snippet(F.col("plain_text_paragraphs")).alias("snippet"))


@query
def html_paragraph_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_tags(F.col("text")).alias("plain"))


@query
def html_text_exact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.plain_paragraphs(F.array("text")), "\n").alias("plain"))


def marked_up(spark, d) -> DataFrame:
    """Pages with the links written as a dump has them, up to eight links a page and four a paragraph, by ``link_id``."""
    href = F.replace(F.url_encode("to_title"), F.lit("+"), F.lit("%20"))
    link = F.concat(F.lit('<a href="'), href, F.lit('">'), F.coalesce("anchor_text", F.lit("")), F.lit("</a>"))
    rows = table(spark, d, "internal_link").select("link_id", "to_title", "anchor_text").distinct().select(F.expr("link_id div 8").alias("page_id"), F.expr("(link_id div 4) % 2").alias("part"), "link_id", link.alias("link"))
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    parts = rows.groupBy("page_id", "part").agg(F.concat(F.lit("See "), F.array_join(in_order("link_id", "link"), "; "), F.lit(" and more.")).alias("paragraph"))
    return parts.groupBy("page_id").agg(F.concat(F.array(F.lit("Before.")), in_order("part", "paragraph"), F.array(F.lit(None).cast("string"))).alias("raw_paragraphs"))


@query
def html_links(spark, d):
    return text.extract_links(marked_up(spark, d))


@query
def decoded_links(spark, d):
    rows = table(spark, d, "internal_link").select("link_id", text.unquote(F.col("to_title")).alias("decoded")).distinct()
    return rows.groupBy("decoded").agg(F.count(F.lit(1)).alias("n_links"))


# --- index ---


@query
def term_frequency(spark, d):
    return index.term_frequencies(articles(spark, d))


@query
def document_frequency(spark, d):
    return index.document_frequencies(index.term_frequencies(articles(spark, d)))


@query
def vocabulary_idf(spark, d):
    return index.vocabulary(index.term_frequencies(articles(spark, d)), n_articles(spark, d)).withColumn("idf_value", F.round("idf_value", 6))


@query
def inverted_index(spark, d):
    tf = materialise(index.term_frequencies(articles(spark, d)), "tf")
    return index.inverted_index(tf, index.vocabulary(tf, n_articles(spark, d))).withColumn("tf_idf_score", F.round("tf_idf_score", 6))


@query
def index_summary(spark, d):
    return index.index_summary(index.term_frequencies(articles(spark, d)), n_articles(spark, d)).withColumn("avg_terms", F.round("avg_terms", 6))


@query
def term_ids(spark, d):
    terms = index.term_frequencies(articles(spark, d)).select("term").distinct()
    return corpus.with_row_ids(terms, "term_id", ["term"])


@query
def top_postings_per_term(spark, d):
    top = index.top_postings(corpus.current_postings(table(spark, d, "inverted_index")), 10)
    return top.withColumn("tf_idf_score", F.round("tf_idf_score", 6))


# --- links ---


@query
def resolve_links(spark, d):
    return links.resolve_links(table(spark, d, "internal_link"), names(spark, d)).select("link_id", "from_article", "to_article", "updated")


@query
def resolved_link_counts(spark, d):
    return links.link_counts(links.resolve_links(table(spark, d, "internal_link"), names(spark, d)))


@query
def unresolved_link_counts(spark, d):
    return links.link_counts(table(spark, d, "internal_link"))


@query
def unresolved_links(spark, d):
    return links.unresolved(table(spark, d, "internal_link")).select("link_id", "from_page_id", "to_title")


@query
def missing_titles(spark, d):
    return links.missing_titles(table(spark, d, "internal_link"), table(spark, d, "article"))


@query
def resolve_titles(spark, d):
    return links.resolve_titles(table(spark, d, "internal_link").select(F.col("to_title").alias("title")), table(spark, d, "article"))


@query
def rewrite_links(spark, d):
    return links.rewrite_links(marked_up(spark, d), table(spark, d, "article")).select("page_id", F.array_join("paragraphs", "|").alias("paragraphs"))


@query
def article_detail(spark, d):
    """The page of the smallest number, as a reader sees it; its articles bear the catalogue's titles."""
    named = table(spark, d, "title_catalog").select(F.col("catalog_id").alias("article_id"), "title")
    first = marked_up(spark, d).orderBy("page_id").limit(1).withColumns({"article_id": F.lit(0).cast("long"), "title": F.lit("Here")})
    pages = named.withColumns({"page_id": -F.col("article_id"), "raw_paragraphs": F.array().cast("array<string>")}).unionByName(first)
    shown = links.article_detail(materialise(pages, "pages"), first.first()["page_id"], "raw_paragraphs")
    return shown.select("page_id", "title", F.array_join("paragraphs", "|").alias("paragraphs"))


@query
def admin_search_titles(spark, d):
    return links.search_titles(names(spark, d), "academy").select("article_id", "title")


@query
def admin_search_links(spark, d):
    return links.search_links(table(spark, d, "internal_link"), table(spark, d, "article"), "academy").select("link_id", "to_title", "from_title", "target_title")


# --- graph ---


@query
def edge_weights(spark, d):
    return graph.edges(table(spark, d, "internal_link"))


@query
def graph_nodes(spark, d):
    return graph.nodes(graph.edges(table(spark, d, "internal_link")))


@query
def out_degree(spark, d):
    return graph.out_degrees(graph.edges(table(spark, d, "internal_link")))


@query
def dangling_nodes(spark, d):
    return graph.dangling(graph.edges(table(spark, d, "internal_link")))


@query
def pagerank_3_iters(spark, d):
    return graph.pagerank(table(spark, d, "internal_link"), max_iter=3, tol=0.0, normalise=False, one_task_edges=0).scores.withColumn("score", F.round("score", 9))


@query
def pagerank_converged(spark, d):
    return graph.pagerank(table(spark, d, "internal_link")).scores.withColumn("score", F.round("score", 9))


@query
def pagerank_run(spark, d):
    """How the same run ended."""
    done = graph.pagerank(table(spark, d, "internal_link"))
    return done.scores.agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.sum("score"), 9).alias("mass"), F.round(F.max("score"), 9).alias("top"), F.lit(done.iterations).alias("iterations"), F.lit(round(done.residual, 12)).alias("residual"))


@query
def pagerank_top10(spark, d):
    return graph.top_articles(corpus.current_ranks(table(spark, d, "pagerank")), names(spark, d)).withColumn("score", F.round("score", 9))


@query
def pagerank_stats(spark, d):
    s = graph.rank_stats(corpus.current_ranks(table(spark, d, "pagerank")))
    return s.select("n", *[F.round(c, 9).alias(c) for c in ("avg_score", "min_score", "max_score", "sum_score")])


# --- search ---

#: The searches that differ in their parameters, by query.
SEARCHES = {
    "search_hybrid": HybridParams(),
    "search_hybrid_strict": HybridParams(policy="strict"),
    "search_hybrid_len2_strict": HybridParams(policy="len2_strict"),
    "search_hybrid_and": HybridParams(strict_and=True),
    "search_hybrid_bonus": HybridParams(coverage_bonus=0.15),
    "search_hybrid_alpha0": HybridParams(alpha=0.0),
    "search_hybrid_alpha1": HybridParams(alpha=1.0),
    "search_hybrid_no_boost": HybridParams(partial_boost=False),
    "search_hybrid_few": HybridParams(limit=5, max_candidates=20),
}


def catalog_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "title_catalog").select(F.col("catalog_id").alias("query_id"), F.col("title").alias("query"))


def _index(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "vocabulary"), corpus.current_postings(table(spark, d, "inverted_index")), corpus.current_ranks(table(spark, d, "pagerank"))


def titles(spark, d) -> DataFrame:
    """Ids and titles of the articles; an article's title is that of its latest load."""
    return names(spark, d).select("article_id", "title")


def _searching(params: HybridParams) -> Callable:
    def run(spark, d):
        out = search.search_hybrid(catalog_queries(spark, d), *_index(spark, d), titles(spark, d), params)
        return out.withColumn("score", F.round("score", 6))

    return run


QUERIES.update({name: _searching(params) for name, params in SEARCHES.items()})


@query
def search_title_exact(spark, d):
    return search.search_titles_exact(catalog_queries(spark, d), titles(spark, d))


@query
def search_with_fallback(spark, d):
    rows = search.search_with_fallback(catalog_queries(spark, d), *_index(spark, d), articles(spark, d), HybridParams(policy="strict"))
    return rows.withColumn("score", F.round("score", 6))


@query
def search_tokens(spark, d):
    rows = search.query_tokens(catalog_queries(spark, d))
    return rows.select("query_id", F.array_join("tokens", " ").alias("tokens"))


# --- evaluation ---


def _relevant(spark, d) -> DataFrame:
    """The titles of the articles that a catalogue title names but for case."""
    named = table(spark, d, "article").select(F.upper("title").alias("k"), "title").distinct()
    return catalog_queries(spark, d).select("query_id", F.upper("query").alias("k")).join(named, "k").select("query_id", "title")


GRID = evaluate.parameter_grid(alpha=[0.5, 0.85], coverage_bonus=[0.0, 0.15])


def _grid(spark, d) -> DataFrame:
    queries = catalog_queries(spark, d).join(_relevant(spark, d).select("query_id").distinct(), "query_id", "left_semi")
    queries, relevant = materialise(queries, "queries"), materialise(_relevant(spark, d), "relevant")
    vocab, postings, ranks = _index(spark, d)
    postings, names = materialise(postings, "postings"), materialise(titles(spark, d), "titles")
    rows = evaluate.grid_search(search.search_grid(queries, vocab, postings, ranks, names, GRID), GRID, relevant)
    return rows.select("grid_order", "alpha", "coverage_bonus", "n_queries", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


@query
def search_quality(spark, d):
    relevant = _relevant(spark, d)
    results = search.search_hybrid(catalog_queries(spark, d), *_index(spark, d), titles(spark, d))
    rows = evaluate.query_metrics(evaluate.relevances(results, relevant), relevant)
    return rows.select("query_id", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


@query
def grid_search(spark, d):
    return _grid(spark, d)


@query
def grid_best(spark, d):
    return evaluate.best_by(_grid(spark, d), "ndcg").select("grid_order", "alpha", "coverage_bonus", "ndcg")


# --- question answering ---

CAPS = (500, 2000, 8000)
QA = qa.QAParams(caps=CAPS, min_tokens=16)


def qa_entries(spark: SparkSession, d: str) -> DataFrame:
    """An entry for each catalogue title that an article bears: supported by it and by the target of its first link."""
    named = table(spark, d, "title_catalog").join(links.by_title(table(spark, d, "article")), "title")
    out = table(spark, d, "internal_link").where("from_article is not null").groupBy(F.col("from_article").alias("article_id")).agg(F.min(F.struct("link_id", "to_title", "anchor_text")).alias("first"))
    rows = named.join(out, "article_id", "left")
    facts = F.array(F.array(F.col("title"), F.lit("0")), F.array(F.col("first.to_title"), F.lit("0")), F.array(F.upper("title"), F.lit("1")))
    return rows.select(F.col("catalog_id").alias("qa_id"), F.concat(F.lit("What is "), "title", F.lit("?")).alias("question"), F.coalesce("first.anchor_text", F.lit("")).alias("answer"), facts.alias("supporting_facts"))


def _qa(spark, d) -> tuple[DataFrame, ...]:
    entries = qa_entries(spark, d)
    sized = qa.article_tokens(articles(spark, d))
    support = qa.supporting_documents(entries, sized)
    return entries, sized, support, qa.entry_status(entries, support, CAPS)


@query
def article_token_totals(spark, d):
    return qa.article_tokens(articles(spark, d)).select("article_id", "n_tokens")


@query
def qa_supporting_docs(spark, d):
    return _qa(spark, d)[2]


@query
def qa_status_counts(spark, d):
    return _qa(spark, d)[3].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def qa_context_slices(spark, d):
    """Slices of the articles that a supporting article links to, in the order of the links."""
    entries, sized, support, status = _qa(spark, d)
    first = support.where("pos = 0").select("qa_id", F.col("article_id").alias("from_article"))
    out = table(spark, d, "internal_link").where("from_article is not null and to_article is not null").groupBy("from_article", F.col("to_article").alias("article_id")).agg(F.min("link_id").alias("place"))
    far = skew_join(out, first.groupBy("from_article").agg(F.min("qa_id").alias("qa_id")), "from_article").join(sized.select("article_id", "n_tokens"), "article_id")
    return qa.context_slices(status, far.select("qa_id", "place", "n_tokens"), CAPS)


def _distractors(spark, d, variant: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    entries, sized, support, status = (materialise(x, "qa") for x in _qa(spark, d))
    vocab, postings, ranks = _index(spark, d)
    postings, names = materialise(postings, "postings"), materialise(titles(spark, d), "titles")
    params = replace(QA, variant=variant)
    chosen = qa.choose_distractors(entries, support, status, sized, lambda q, p: search.search_hybrid(q, vocab, postings, ranks, names, p), params)
    return entries, support, status, materialise(chosen, "qa-chosen")


@query
def qa_distractors_build(spark, d):
    return qa.distractors_of(_distractors(spark, d, "build")[3])


@query
def qa_distractors_generate(spark, d):
    return qa.distractors_of(_distractors(spark, d, "generate")[3])


@query
def qa_dataset(spark, d):
    entries, support, status, chosen = _distractors(spark, d, "build")
    chosen = qa.distractors_of(chosen)
    rows = qa.dataset(entries, support, chosen, qa.context_slices(status, chosen, CAPS), articles(spark, d))
    flat = [F.array_join(F.transform(f"{side}_docs", lambda x: x["title"]), "|").alias(f"{side}_titles") for side in ("supporting", "distractor")]
    texts = [F.md5(F.array_join(F.transform(f"{side}_docs", lambda x: x["text"]), "|").cast("binary")).alias(f"{side}_md5") for side in ("supporting", "distractor")]
    return rows.select("cap", "id", "question", "gold_answer", *flat, *texts, "context_size")


@query
def qa_report(spark, d):
    _, _, status, chosen = _distractors(spark, d, "build")
    row = qa.report(status, qa.context_slices(status, qa.distractors_of(chosen), CAPS), chosen)
    return row.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


# --- statistics ---


@query
def db_summary(spark, d):
    return stats.summary(articles(spark, d), table(spark, d, "internal_link")).withColumn("avg_paragraphs", F.round("avg_paragraphs", 6))


@query
def mean_paragraphs(spark, d):
    return stats.mean_paragraphs(articles(spark, d)).withColumn("avg_paragraphs", F.round("avg_paragraphs", 6))


@query
def status_page(spark, d):
    rows = stats.status(articles(spark, d), table(spark, d, "internal_link"), table(spark, d, "vocabulary"), table(spark, d, "inverted_index"), corpus.current_ranks(table(spark, d, "pagerank")))
    return rows.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query
def articles_per_source_stats(spark, d):
    return stats.source_stats(stats.records_by_source(table(spark, d, "documents"))).withColumn("avg_n", F.round("avg_n", 6))


@query
def top5_sources(spark, d):
    return stats.top_sources(stats.records_by_source(table(spark, d, "documents")))


@query
def timing_stats_percentiles(spark, d):
    rows = stats.timing_stats(table(spark, d, "events"), "value", "event_type")
    return rows.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("total", "mean", "median", "p95", "least", "greatest")])


@query
def event_type_counts(spark, d):
    return stats.group_counts(table(spark, d, "events"), "event_type")


@query
def event_window_counts(spark, d):
    return event_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query
def statement_classes(spark, d):
    """Statements made up from the orders: one of six tables, read or written, in upper or lower case."""
    names = F.array(*map(F.lit, ("Article", "InvertedIndex", "Vocabulary", "PageRank", "InternalLink", "article")))
    verb = F.element_at(F.array(*map(F.lit, ("SELECT a FROM ", "select b from ", "INSERT INTO ", "Update "))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text_ = F.concat(verb, F.element_at(names, (F.col("o_custkey") % 6 + 1).cast("int")))
    return stats.classify_statements(table(spark, d, "orders").select(text_.alias("statement"), (F.col("o_orderkey") % 7).alias("seconds")), "statement", "seconds")


@query
def cache_hit_ratio(spark, d):
    return stats.hit_ratio(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


@query
def blocked_requests(spark, d):
    """Requests for locks made up from the events; one key in ten is null."""
    key = F.when(F.col("user_id") % 10 != 0, F.col("user_id") % 10)
    locks = table(spark, d, "events").select("event_type", key.alias("relation"), F.col("user_id").alias("pid"), (F.coalesce("value", F.lit(0.0)) < 50).alias("granted"))
    return stats.blocked(locks, ["event_type", "relation"])


def written_settings(spark, d) -> DataFrame:
    """Settings made up from the line items: sizes and times in all units, names with and without a rule."""
    pick = lambda items, key: F.element_at(F.array(*map(F.lit, items)), (F.col(key) % len(items) + 1).cast("int"))
    number = (F.col("l_partkey") % 97 + 1).cast("string")
    rows = table(spark, d, "lineitem").select(pick(("Buffer", "pause", "level", "modules", "other"), "l_orderkey").alias("name"), number.alias("x"), pick(("kB", "MB", " gb", "TB", ""), "l_suppkey").alias("size"), pick(("s", "min", "h", "d", ""), "l_suppkey").alias("time"))
    other = F.element_at(F.array(*map(F.lit, ("low", "HIGH", "x,trace"))), (F.length("x") % 3 + 1).cast("int"))
    value = F.when(F.col("name") == "Buffer", F.concat("x", "size")).when(F.col("name") == "pause", F.concat("x", "time")).otherwise(other)
    return rows.select("name", value.alias("value")).distinct()


@query
def parsed_settings(spark, d):
    rows = written_settings(spark, d).where("name in ('Buffer', 'pause')")
    return rows.select("name", "value", F.when(F.col("name") == "Buffer", settings.size_mb(F.col("value"))).otherwise(settings.seconds(F.col("value"))).alias("amount"))


RULES = [("buffer", "size", 16.0, 65536.0, None, None), ("pause", "time", 30.0, 7200.0, None, None), ("level", "option", None, None, "high", ["low", "high"]), ("modules", "contains", None, None, None, ["trace", "stat"])]


@query
def checked_settings(spark, d):
    return settings.check_settings(written_settings(spark, d), spark.createDataFrame(RULES, settings.RULES))


@query
def sample_with_repeats(spark, d):
    return stats.sample_to(table(spark, d, "title_catalog"), "catalog_id", 2500, seed=42).select("place", "catalog_id")


@query
def large_value_percent(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("part"), F.count("value").alias("whole"))
    return rows.select("event_type", stats.ratio_percent(F.col("part"), F.col("whole")).alias("percent"))


@query
def sample_queries_seeded(spark, d):
    return stats.sample(titles(spark, d), "article_id", 100, seed=42)


@query
def random_articles(spark, d):
    return stats.two_random(titles(spark, d), seed=7)


# --- integrity ---


@query
def constraint_report(spark, d):
    return corpus.constraint_report({n: table(spark, d, n) for n in ("article", "vocabulary", "inverted_index", "pagerank", "internal_link")})


@query
def token_count_parity(spark, d):
    return corpus.parity_errors(articles(spark, d))


@query
def first_load_per_page(spark, d):
    return corpus.first_by(table(spark, d, "article").select("page_id", "article_id", "loaded_at"), ["page_id"], ["loaded_at", "article_id"])


@query
def cascade_delete_counts(spark, d):
    kept = corpus.cascade_delete({n: table(spark, d, n) for n in ("article", "inverted_index", "pagerank", "internal_link")}, table(spark, d, "article_deletion"))
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in kept.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query
def null_safe_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    sizes = docs.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n_same"))
    return docs.join(sizes, docs["source"].eqNullSafe(sizes["s"])).select("doc_id", "n_same")
