"""Compressed JSON-lines dumps: discovery, scans, decoding."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import extract_links, plain_paragraphs, raw_paragraphs
from lexmill.functions.tokenizers import word
from lexmill.schemas import DUMP

#: Fixed value: name pattern of a shard; shards lie exactly one folder below the root.
SHARD = "wiki_*.bz2"


def shards(root: str, fallback: bool = False, spark: SparkSession | None = None) -> list[str]:
    """The shards below ``root`` by folder and name, on any file system Spark knows; a missing root has none.

    ``fallback`` looks into ``<root>-processed`` if the root is missing or holds none.
    """
    spark = spark or SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path
    for place in (root, f"{root.rstrip('/')}-processed") if fallback else (root,):
        found = path(place).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(f"{place.rstrip('/')}/*/{SHARD}"))
        found = sorted((f.getPath().toString() for f in found or () if f.isFile()), key=lambda p: p.split("/")[-2:])
        if found:
            return found
    return []


def require_shards(root: str, fallback: bool = False, spark: SparkSession | None = None) -> list[str]:
    """As :func:`shards`; none raise ``FileNotFoundError``."""
    found = shards(root, fallback, spark)
    if not found:
        raise FileNotFoundError(f"no {SHARD} one folder below {root}")
    return found


def write_shards(lines: DataFrame, root: str) -> list[str]:
    """Write ``(folder, line)`` as compressed shards below ``root``, in the folders named; the shards."""
    spark = lines.sparkSession
    lines.select("folder", F.col("line").alias("value")).write.partitionBy("folder").option("compression", "bzip2").text(root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(path(f"{root}/folder=*")):
        place = path(f"{root}/{folder.getPath().getName().removeprefix('folder=')}")
        fs.mkdirs(place)
        for i, file in enumerate(sorted(f.getPath().toString() for f in fs.globStatus(path(f"{folder.getPath().toString()}/part-*")))):
            fs.rename(path(file), path(place, f"wiki_{i:02d}.bz2"))
        fs.delete(folder.getPath(), True)
    return shards(root, spark=spark)


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(line, file)``: the lines that are not blank."""
    return spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where("trim(line) <> ''")


def records(spark: SparkSession, paths: list[str] | str, mode: str = "strict") -> DataFrame:
    """``(id, url, title, text, file)`` of each line.

    ``strict`` fails on a line that is no JSON object; ``skip`` leaves such lines, and files that cannot be read, out.
    """
    if mode not in ("strict", "skip"):
        raise ValueError(mode)
    reader = spark.read.schema(DUMP).option("mode", "FAILFAST" if mode == "strict" else "DROPMALFORMED")
    if mode == "skip":
        reader = reader.option("ignoreCorruptFiles", "true")
    return reader.json(paths).select("*", F.col("_metadata.file_path").alias("file"))


def is_article(line: Column) -> Column:
    """Whether a line is a JSON object with the keys ``id`` and ``title``, a null value included."""
    keys = F.json_object_keys(line)
    return F.coalesce(F.array_contains(keys, "id") & F.array_contains(keys, "title"), F.lit(False))


def decode(rows: DataFrame, tokens: Callable[[Column], Column] = word, exact_html: bool = True) -> DataFrame:
    """Articles as they are stored, with their raw paragraphs.

    ``(page_id, title, raw_paragraphs, plain_text_paragraphs, paragraph_token_counts, is_disambiguation, file)``. A missing
    id, or one that is no whole number, fails the load; a null text is empty, a null title ``''``.
    """
    page = F.expr("try_cast(trim(id) as bigint)")
    checked = F.when(page.isNull(), F.raise_error(F.concat(F.lit("bad id: "), F.coalesce("id", F.lit("null")))).cast("long")).otherwise(page)
    text = F.coalesce("text", F.array().cast("array<array<string>>"))
    out = rows.select(checked.alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), raw_paragraphs(text).alias("raw_paragraphs"), "file")
    out = out.withColumn("plain_text_paragraphs", plain_paragraphs(F.col("raw_paragraphs"), exact_html))
    counts = F.transform("plain_text_paragraphs", lambda p: F.size(tokens(p)))
    return out.select("page_id", "title", "raw_paragraphs", "plain_text_paragraphs", counts.alias("paragraph_token_counts"), F.lit(False).alias("is_disambiguation"), "file")


def ingest(spark: SparkSession, root: str, limit: int | None = None, tokens: Callable[[Column], Column] = word, exact_html: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(articles, links)`` of a dump.

    Of several records with one page id the first by file and text counts; links are those of the articles kept.
    ``limit`` keeps the articles of smallest page id. Link ends are still open: ``from_article`` and ``to_article`` null.
    """
    from lexmill.operators.corpus import first_by
    from lexmill.session import materialise

    decoded = materialise(decode(records(spark, require_shards(root, spark=spark)), tokens, exact_html), "decoded")
    once = first_by(decoded, ["page_id"], [F.asc("file"), F.asc("title"), F.asc(F.to_json(F.struct("raw_paragraphs")))])
    if limit:
        once = once.orderBy("page_id").limit(limit)
    links = extract_links(once)
    articles = once.select(F.col("page_id").alias("article_id"), "page_id", "title", "plain_text_paragraphs", "paragraph_token_counts", "is_disambiguation")
    none = F.lit(None).cast("long")
    links = links.select((F.col("page_id") * 1_000_000 + F.col("pos")).alias("link_id"), none.alias("from_article"), F.col("page_id").alias("from_page_id"), none.alias("to_article"), "to_title", "anchor_text")
    return articles, links


def count_by_file(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source, n)``: articles of each shard; shards without any have 0."""
    rows = lines(spark, paths).where(is_article(F.col("line"))).groupBy(F.element_at(F.split("file", "/"), -1).alias("name"), F.element_at(F.split("file", "/"), -2).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    listed = spark.createDataFrame([(p.split("/")[-1], p.split("/")[-2], "/".join(p.split("/")[-2:])) for p in paths], "name string, folder string, source string")
    return listed.join(rows, ["name", "folder"], "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def sample_shards(paths: list[str], n: int | None = None, seed: int = 42) -> list[str]:
    """``n`` shards drawn without replacement, by default a hundredth, one at least."""
    n = max(1, len(paths) // 100) if n is None else n
    return sorted(random.Random(seed).sample(paths, min(n, len(paths))))
