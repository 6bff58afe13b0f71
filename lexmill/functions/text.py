"""Paragraph, markup and link expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a link in a dump paragraph, its target and its anchor.
LINK = '<a href="([^"]+)">([^<]+)</a>'
#: Fixed value: characters kept of a link's title and anchor.
LINK_CHARS = 512
#: Fixed value: characters of a snippet.
SNIPPET_CHARS = 200


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_text(value: str | None) -> str:
    """The text of an HTML fragment; null, blank and unreadable ones give an empty string."""
    if value is None or not value.strip():
        return ""
    if "<" not in value and "&" not in value:
        return value
    reader = _Text()
    try:
        reader.feed(value)
        reader.close()
    except Exception:
        return ""
    return "".join(reader.parts)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _texts(paragraphs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in paragraphs:
        yield batch.map(lambda ps: None if ps is None else [html_text(p) for p in ps])


@F.pandas_udf(T.StringType())
def _unquoted(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from urllib.parse import unquote

    for batch in values:
        yield batch.map(lambda v: None if v is None else unquote(v))


def strip(value: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def raw_paragraphs(text: Column) -> Column:
    """Each paragraph of chunks as one string; null paragraphs left out, null chunks skipped."""
    return F.transform(F.filter(text, lambda p: p.isNotNull()), lambda p: F.array_join(p, ""))


def plain_paragraphs(raw: Column, exact: bool = True) -> Column:
    """Paragraphs without markup, the empty ones left out; null gives an empty array.

    ``exact`` reads the markup with an HTML parser (Arrow batches in Python); else tags and the basic character references
    are removed by expressions inside the JVM.
    """
    raw = F.coalesce(raw, F.array().cast("array<string>"))
    if exact:
        # only rows with markup are read in Python; a paragraph without any is its own text, a blank one empty
        marked = F.exists(raw, lambda p: F.coalesce(F.contains(p, F.lit("<")) | F.contains(p, F.lit("&")), F.lit(False)))
        unmarked = F.transform(raw, lambda p: F.when(p.rlike(r"(?U)\S"), p).otherwise(""))
        plain = F.coalesce(_texts(F.when(marked, raw)), unmarked)
    else:
        plain = F.transform(raw, strip_tags)
    return F.filter(plain, lambda p: p.isNotNull() & (p != ""))


def strip_tags(value: Column) -> Column:
    """Tags and basic character references removed by expressions; null stays null."""
    v = F.regexp_replace(value, "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(name), F.lit(char))
    return v


def unquote(value: Column, exact: bool = False) -> Column:
    """Percent decoding as UTF-8; ``+`` stays. A value that is not valid is left as it is, or decoded in part if ``exact``."""
    if exact:
        return _unquoted(value)
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def links_of(raw: Column) -> Column:
    """The links of the paragraphs, in order: ``ARRAY<STRUCT<href, anchor>>``; anchors stripped, none of the two empty."""
    pairs = F.transform(
        F.filter(raw, lambda p: p.isNotNull()),
        lambda p: F.arrays_zip(F.regexp_extract_all(p, F.lit(LINK), 1).alias("href"), F.regexp_extract_all(p, F.lit(LINK), 2).alias("anchor")),
    )
    links = F.transform(F.flatten(pairs), lambda x: F.struct(x["href"].alias("href"), strip(x["anchor"]).alias("anchor")))
    return F.filter(links, lambda x: (x["href"] != "") & (x["anchor"] != ""))


def extract_links(articles: DataFrame, raw: str = "raw_paragraphs", exact: bool = False) -> DataFrame:
    """One row for each link: ``(page_id, pos, to_title, anchor_text)``, both cut to 512 characters; duplicates stay."""
    rows = articles.select("page_id", F.posexplode(links_of(F.col(raw))).alias("pos", "link"))
    title = F.substring(unquote(F.col("link.href"), exact), 1, LINK_CHARS)
    return rows.select("page_id", "pos", title.alias("to_title"), F.substring("link.anchor", 1, LINK_CHARS).alias("anchor_text")).where("to_title <> ''")


def snippet(paragraphs: Column) -> Column:
    """The first paragraph that is not blank, stripped and cut to 200 characters with ``...``; none gives ``''``."""
    first = F.get(F.filter(F.transform(paragraphs, strip), lambda p: p.isNotNull() & (p != "")), F.lit(0))
    return F.coalesce(F.when(F.length(first) > SNIPPET_CHARS, F.concat(F.left(first, F.lit(SNIPPET_CHARS)), F.lit("..."))).otherwise(first), F.lit(""))


def body(paragraphs: Column, separator: str = " ") -> Column:
    """The paragraphs that are not null, joined; null and empty arrays give ``''``."""
    return F.coalesce(F.array_join(paragraphs, separator), F.lit(""))
