"""Smaller files: questions, queries, results, reports, manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.corpus import with_row_ids
from lexmill.schemas import QA_ENTRY


#: Options of the CSV files: quotes are doubled, white space and empty strings stay.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def qa_entries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(qa_id, question, answer, supporting_facts)`` of a JSON array; ``limit`` keeps its first entries (0: all)."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{QA_ENTRY}>>")).alias("pos", "e"))
    if limit:
        whole = whole.where(F.col("pos") < limit)
    qa_id = F.coalesce(F.nullif("e._id", F.lit("")), F.nullif("e.id", F.lit("")), F.lit(""))
    return whole.select(qa_id.alias("qa_id"), F.coalesce("e.question", F.lit("")).alias("question"), F.coalesce("e.answer", F.lit("")).alias("answer"), "e.supporting_facts")


def read_queries(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """``(query_id, query)`` of a file, or a folder of files in the order of their names, of one query a line, stripped, blank
    ones dropped, from 0.

    ``count`` cuts them, or repeats them in turn, to that number. A file without a query has no row.
    """
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")).alias("pos", "query"))
    rows = with_row_ids(found, "i", ["file", "pos"]).select((F.col("i") - 1).alias("i"), "query")
    if count is None:
        return rows.select(F.col("i").alias("query_id"), "query")
    total = rows.count()
    if not total:
        return rows.select(F.col("i").alias("query_id"), "query")
    slots = spark.range(count).select(F.col("id").alias("query_id"), (F.col("id") % total).alias("i"))
    return slots.join(rows, "i").select("query_id", "query")


def write_queries(queries: DataFrame, path: str) -> None:
    """One query a line, by id, in a folder of text files."""
    queries.orderBy("query_id").select(F.col("query").alias("value")).write.mode("overwrite").text(path)


def write_results(results: DataFrame, queries: DataFrame, path: str) -> None:
    """CSV ``query,rank,article_id,title,score`` with six decimals."""
    rows = results.join(queries.select("query_id", "query"), "query_id")
    rows.select("query", "rank", "article_id", "title", F.format_string("%.6f", F.col("score")).alias("score")).write.mode("overwrite").options(**CSV).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_results` wrote, the numbers as numbers."""
    return spark.read.schema("query string, rank int, article_id long, title string, score double").options(**CSV, multiLine=True).csv(path)


def write_dataset(rows: DataFrame, path: str) -> None:
    """JSON lines of the finished rows, a folder for each cap."""
    rows.write.mode("overwrite").partitionBy("cap").json(path)


def write_dataset_array(rows: DataFrame, folder: str, cap: int) -> str:
    """The rows of one cap as one pretty JSON array, streamed through the driver row by row; its path."""
    return write_array(rows.where(F.col("cap") == cap).drop("cap").orderBy("id"), f"{folder}/qa_dataset_{cap}.json")


def write_array(rows: DataFrame, path: str) -> str:
    """The rows in their order as one pretty JSON array, streamed through the driver row by row; its path."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    with at.open("w", encoding="utf-8") as file:
        file.write("[")
        for i, row in enumerate(rows.toJSON().toLocalIterator()):
            file.write(",\n" if i else "\n")
            file.write(json.dumps(json.loads(row), indent=2, ensure_ascii=False))
        file.write("\n]\n")
    return str(at)


def write_report(row: DataFrame, path: str, **more) -> dict:
    """A one-row frame as a JSON object, with ``more`` added; what was written."""
    found = row.first()
    out = {**(found.asDict(recursive=True) if found else {}), **more}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2, default=str) + "\n", encoding="utf-8")
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256, md5)`` of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
