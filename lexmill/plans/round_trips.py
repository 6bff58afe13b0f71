"""Queries that write files and tables into the scratch folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.tokenizers import word
from lexmill.operators import links, search, stats
from lexmill.plans import core
from lexmill.session import scratch_dir, table
from lexmill.sources import dumps, files
from lexmill.sources.store import Store

#: Articles kept by the query that stops early.
LIMIT = 100


def _place(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/lexmill-{tag}-{uuid.uuid4().hex}"


def _paths(spark: SparkSession, d: str, bad: bool = False) -> str:
    """A dump of the marked-up pages, in chunks, each page again in a later folder under another title; its root.

    ``bad`` adds blank lines, lines that are no JSON, and records without a title.
    """
    pages = core.marked_up(spark, d)
    chunks = F.transform("raw_paragraphs", lambda p: F.when(p.isNotNull(), F.array(F.substring(p, F.lit(1), F.lit(9)), F.lit(None).cast("string"), F.substring(p, F.lit(10), F.length(p)))))

    def lines(folder: str, title: str) -> DataFrame:
        record = F.struct(F.col("page_id").cast("string").alias("id"), F.lit("u").alias("url"), F.concat(F.lit(title), "page_id").alias("title"), chunks.alias("text"))
        return pages.select(F.lit(folder).alias("folder"), F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))

    rows = lines("AA", "Page ").unionByName(lines("AB", "Again "))
    if bad:
        some = F.explode(F.array(*map(F.lit, ("  ", "no json", '{"id": "1"}', '{"id": null, "title": null}'))))
        rows = rows.unionByName(table(spark, d, "region").select(F.lit("AC").alias("folder"), some.alias("line")))
    root = _place(spark, "dump")
    dumps.write_shards(rows, root)
    return root


def _ingested(spark: SparkSession, d: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    return dumps.ingest(spark, _paths(spark, d), limit, word, exact_html=False)


def dump_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = _ingested(spark, d)[0]
    return rows.select("page_id", "title", F.array_join("plain_text_paragraphs", "|").alias("paragraphs"), F.array_join(F.col("paragraph_token_counts").cast("array<string>"), ",").alias("counts"), "is_disambiguation")


def dump_links(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d)[1].select("link_id", "from_page_id", "to_title", "anchor_text")


def dump_first_articles(spark: SparkSession, d: str) -> DataFrame:
    articles, found = _ingested(spark, d, LIMIT)
    return articles.agg(F.count(F.lit(1)).alias("n_articles")).join(F.broadcast(found.agg(F.count(F.lit(1)).alias("n_links"), F.max("from_page_id").alias("last_page"))), F.lit(True))


def dump_counts(spark: SparkSession, d: str) -> DataFrame:
    """Articles by folder; what is no article is not counted."""
    rows = dumps.count_by_file(spark, dumps.require_shards(_paths(spark, d, bad=True)))
    return rows.groupBy(F.substring_index("source", "/", 1).alias("folder")).agg(F.sum("n").alias("n"))


def dump_lenient_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that can be read at all, by folder, and how many have a title."""
    rows = dumps.records(spark, dumps.require_shards(_paths(spark, d, bad=True)), "skip")
    folder = F.element_at(F.split("file", "/"), -2)
    return rows.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("n_titles"))


def qa_file(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as one JSON array and read back."""
    rows = core.qa_entries(spark, d).withColumnRenamed("qa_id", "_id").withColumn("_id", F.col("_id").cast("string"))
    path = files.write_array(rows.orderBy("_id"), f"{_place(spark, 'qa').removeprefix('file:')}/qa.json")
    return files.qa_entries(spark, path).select("qa_id", "question", "answer", F.get(F.get("supporting_facts", F.lit(1)), F.lit(0)).alias("second"))


def query_file(spark: SparkSession, d: str) -> DataFrame:
    """Titles written one a line, read back in turn until there are 2000."""
    path = _place(spark, "queries")
    files.write_queries(core.catalog_queries(spark, d), path)
    return files.read_queries(spark, path, 2000)


def results_file(spark: SparkSession, d: str) -> DataFrame:
    """The results of the default search as CSV."""
    path, queries = _place(spark, "results"), core.catalog_queries(spark, d)
    rows = search.search_hybrid(queries, *core._index(spark, d), core.titles(spark, d))
    files.write_results(rows, queries, path)
    return files.read_results(spark, path)


def stored_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables written, one of them replaced and one emptied, with their rows."""
    store = Store(spark, _place(spark, "store"))
    for name in ("article", "vocabulary", "internal_link", "inverted_index", "pagerank"):
        store.write(name, table(spark, d, name))
    store.write("inverted_index", core._index(spark, d)[1], sort=["term", "tf_idf_score"], partitions=4)
    store.write("internal_link", links.resolve_links(store.read("internal_link"), core.names(spark, d)).where("updated").drop("updated"))
    store.truncate("pagerank")
    gone = store.read("pagerank").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("pagerank").alias("table_name"), "n_rows")
    return store.statistics().select("table_name", "n_rows").unionByName(gone)


def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Length and digests of a file of the regions' names."""
    path = _place(spark, "regions")
    table(spark, d, "region").orderBy("r_regionkey").coalesce(1).select("r_name").write.text(path)
    return files.manifest(spark, path).where("path not like '%SUCCESS%' and path not like '%crc'").select("length", "sha256", "md5")


def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a folder with their rows and columns."""
    out = None
    for name in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "article"):
        rows = table(spark, d, name)
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(rows.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return stats.top_sources(out.withColumnsRenamed({"table_name": "source", "n_rows": "n"}), 100).withColumnsRenamed({"source": "table_name", "n": "n_rows"})


QUERIES = {q.__name__: q for q in (dump_articles, dump_links, dump_first_articles, dump_counts, dump_lenient_records, qa_file, query_file, results_file, stored_tables, file_manifest, table_sizes)}
