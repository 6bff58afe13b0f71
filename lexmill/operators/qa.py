"""Question answering datasets: supporting documents, distractors and context sizes under token budgets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import body
from lexmill.functions.tokenizers import naive
from lexmill.operators.links import by_title
from lexmill.operators.search import HybridParams


@dataclass(frozen=True)
class QAParams:
    """Parameters of a dataset; ``variant`` is ``build`` or ``generate``."""

    caps: tuple[int, ...] = (8000, 32000)
    search: HybridParams = HybridParams(limit=60, max_candidates=2000, coverage_bonus=0.15)
    min_tokens: int = 64
    max_fallbacks: int = 2
    variant: str = "build"

    def __post_init__(self):
        if not self.caps or min(self.caps) < 1:
            raise ValueError("caps must be positive, one at least")
        if self.variant not in ("build", "generate"):
            raise ValueError(f"unknown variant {self.variant!r}")

    @property
    def fallback_search(self) -> HybridParams:
        s = self.search
        most = s.max_candidates * 4 if self.variant == "build" else max(s.max_candidates * 4, 5 * s.limit)
        return replace(s, limit=s.limit * 2, max_candidates=most, coverage_bonus=s.coverage_bonus / 2, policy="balanced", strict_and=False, partial_boost=True)


def article_tokens(articles: DataFrame, tokens: Callable[[Column], Column] = naive) -> DataFrame:
    """``(article_id, title, n_tokens)``: tokens of the title and the stored counts of the paragraphs.

    Where no counts are stored the paragraphs, joined by blank lines, are counted. Null counts count 0.
    """
    stored = F.aggregate(F.transform("paragraph_token_counts", lambda c: F.coalesce(c, F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    counted = F.size(tokens(body(F.col("plain_text_paragraphs"), "\n\n"))).cast("long")
    rest = F.when(F.size(F.coalesce("paragraph_token_counts", F.array().cast("array<int>"))) > 0, stored).otherwise(counted)
    return articles.select("article_id", "title", (F.size(tokens(F.col("title"))) + rest).alias("n_tokens"))


def as_document(title: str = "title", paragraphs: str = "plain_text_paragraphs") -> Column:
    """``STRUCT<title, text>``, the paragraphs joined by line ends."""
    return F.struct(F.col(title).alias("title"), body(F.col(paragraphs), "\n").alias("text"))


def supporting_titles(entries: DataFrame) -> DataFrame:
    """``(qa_id, pos, title)``: the titles of each entry once whatever their case, the first spelling kept.

    ``entries(qa_id, supporting_facts ARRAY<ARRAY<STRING>>)``; null and empty titles are skipped.
    """
    rows = entries.select("qa_id", F.posexplode("supporting_facts").alias("pos", "fact")).select("qa_id", "pos", F.get("fact", F.lit(0)).alias("title")).where("title is not null and title <> ''")
    first = rows.groupBy("qa_id", F.lower("title").alias("k")).agg(F.min(F.struct("pos", "title")).alias("f"))
    return first.select("qa_id", "f.pos", "f.title")


def supporting_documents(entries: DataFrame, sized: DataFrame) -> DataFrame:
    """``(qa_id, pos, title, article_id, n_tokens)``: the article of each title, null if none bears it, letter for letter."""
    ids = by_title(sized)
    rows = supporting_titles(entries).join(ids, "title", "left")
    return rows.join(sized.select("article_id", "n_tokens"), "article_id", "left").select("qa_id", "pos", "title", "article_id", "n_tokens")


def entry_status(entries: DataFrame, support: DataFrame, caps: tuple[int, ...]) -> DataFrame:
    """``(qa_id, status, supporting_tokens)``: ``no_facts``, ``skipped_missing``, ``skipped_overflow`` or ``processed``."""
    sums = support.groupBy("qa_id").agg(F.count_if(F.col("article_id").isNull()).alias("missing"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("supporting_tokens"))
    status = F.when(F.col("missing").isNull(), "no_facts").when(F.col("missing") > 0, "skipped_missing").when(F.col("supporting_tokens") > max(caps), "skipped_overflow").otherwise("processed")
    return entries.select("qa_id").join(sums, "qa_id", "left").select("qa_id", status.alias("status"), "supporting_tokens")


def distractor_queries(entries: DataFrame, support: DataFrame, params: QAParams) -> DataFrame:
    """``(qa_id, kind, pos, query)``: the titles as primary queries (kind 0) and the fallback queries (kind 1).

    Fallbacks: the question; question and answer, unless the answer is in the question; the sorted titles (``build``: all,
    cut to 256 characters; ``generate``: the first three).
    """
    primary = support.select("qa_id", F.lit(0).alias("kind"), "pos", F.col("title").alias("query"))
    titles = support.groupBy("qa_id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    rows = entries.join(titles, "qa_id", "left").withColumns({"q": F.coalesce("question", F.lit("")), "a": F.coalesce("answer", F.lit(""))})
    apart = (F.col("a") != "") & ~F.contains(F.lower("q"), F.lower("a"))
    last = F.substring(F.array_join("titles", " "), 1, 256) if params.variant == "build" else F.array_join(F.slice("titles", 1, 3), " ")
    fallback = F.array(F.when(F.col("q") != "", F.col("q")), F.when(apart, F.trim(F.concat_ws(" ", "q", "a"))), F.when(F.size("titles") > 0, last))
    rows = rows.select("qa_id", F.lit(1).alias("kind"), F.posexplode(F.filter(fallback, lambda x: x.isNotNull())).alias("pos", "query"))
    return primary.unionByName(rows)


def asked_queries(queries: DataFrame, max_fallbacks: int) -> DataFrame:
    """The queries that are asked, in order: all primary ones, and the first fallbacks that repeat no query before them."""
    first = Window.partitionBy("qa_id", "query").orderBy("kind", "pos")
    rows = queries.withColumn("__first", F.row_number().over(first)).where("kind = 0 or __first = 1").drop("__first")
    turn = F.row_number().over(Window.partitionBy("qa_id", "kind").orderBy("pos"))
    return rows.withColumn("__turn", turn).where((F.col("kind") == 0) | (F.col("__turn") <= max_fallbacks)).drop("__turn")


_PICKED = "array<struct<article_id:bigint,title:string,n_tokens:bigint>>"


def _choose(items: Column, params: QAParams) -> Column:
    """What is taken of an entry's ``items`` in their order, and the fallbacks tried: ``STRUCT<used, tried, seen, picked>``.

    Items: ``STRUCT<kind, pos, rank, article_id, title, n_tokens>``; one without an article opens a query. An item is taken if
    its title is not among the supporting or taken ones, it has ``min_tokens`` and fits under the largest cap.
    """
    most = max(params.caps)
    fold = F.lower if params.variant == "build" else (lambda c: c)
    start = F.struct(F.col("supporting_tokens").cast("long").alias("used"), F.lit(0).alias("tried"), F.transform("supporting_titles", fold).alias("seen"), F.array().cast(_PICKED).alias("picked"))

    def step(state: Column, x: Column) -> Column:
        room = state["used"] < most
        fits = room & x["article_id"].isNotNull() & (x["n_tokens"] >= params.min_tokens) & (state["used"] + x["n_tokens"] <= most) & ~F.array_contains(state["seen"], fold(x["title"]))
        taken = F.struct(
            (state["used"] + x["n_tokens"]).alias("used"), state["tried"].alias("tried"), F.array_append(state["seen"], fold(x["title"])).alias("seen"),
            F.array_append(state["picked"], F.struct(x["article_id"].alias("article_id"), x["title"].alias("title"), x["n_tokens"].alias("n_tokens"))).alias("picked"),
        )
        opened = F.struct(state["used"].alias("used"), (state["tried"] + 1).alias("tried"), state["seen"].alias("seen"), state["picked"].alias("picked"))
        return F.when(F.coalesce(fits, F.lit(False)), taken).when(room & x["article_id"].isNull() & (x["kind"] == 1), opened).otherwise(state)

    return F.aggregate(items, start, step)


def choose_distractors(entries: DataFrame, support: DataFrame, status: DataFrame, sized: DataFrame, search: Callable[[DataFrame, HybridParams], DataFrame], params: QAParams) -> DataFrame:
    """One row for each processed entry: ``(qa_id, fallbacks, picked)``, ``picked`` the distractors in the order chosen.

    All primary and fallback searches of all entries run as two batches, each distinct query once; then each entry goes
    through its own results (at most queries x limit rows) by one built-in fold. ``search(queries, params)`` is the batched
    search.
    """
    good = status.where("status = 'processed'").select("qa_id", "supporting_tokens")
    asked = distractor_queries(entries.join(good.select("qa_id"), "qa_id", "left_semi"), support.join(good.select("qa_id"), "qa_id", "left_semi"), params)
    asked = asked_queries(asked, params.max_fallbacks)
    names = support.groupBy("qa_id").agg(F.collect_set("title").alias("supporting_titles"))
    none = {"rank": "int", "article_id": "long", "title": "string", "n_tokens": "long"}
    parts = [asked.select("qa_id", "kind", "pos", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])]
    for kind, p in ((0, params.search), (1, params.fallback_search)):
        own = asked.where(F.col("kind") == kind)
        queries = own.select(F.col("query").alias("query_id"), "query").distinct()
        hits = search(queries, p).select(F.col("query_id").alias("query"), "rank", "article_id", "title")
        hits = hits.join(sized.select("article_id", "n_tokens"), "article_id")
        parts.append(own.join(hits, "query").select("qa_id", "kind", "pos", *[F.col(c).cast(t).alias(c) for c, t in none.items()]))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    items = rows.groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("kind", "pos", F.coalesce("rank", F.lit(0)).alias("rank"), "article_id", "title", "n_tokens"))).alias("items"))
    chosen = good.join(items, "qa_id").join(names, "qa_id").select("qa_id", _choose(F.col("items"), params).alias("c"))
    return chosen.select("qa_id", F.col("c.tried").alias("fallbacks"), F.col("c.picked").alias("picked"))


def select_distractors(entries: DataFrame, support: DataFrame, status: DataFrame, sized: DataFrame, search: Callable[[DataFrame, HybridParams], DataFrame], params: QAParams) -> DataFrame:
    """``(qa_id, place, article_id, title, n_tokens)``: the distractors of each processed entry; see :func:`choose_distractors`."""
    return distractors_of(choose_distractors(entries, support, status, sized, search, params))


def distractors_of(chosen: DataFrame) -> DataFrame:
    """The rows of :func:`choose_distractors`, one for each distractor, with its place from 0."""
    return chosen.select("qa_id", F.posexplode("picked").alias("place", "p")).select("qa_id", "place", "p.article_id", "p.title", "p.n_tokens")


def context_slices(status: DataFrame, distractors: DataFrame, caps: tuple[int, ...], variant: str = "build") -> DataFrame:
    """``(qa_id, cap, n_distractors, context_size)``: for each cap the longest run of distractors that fits.

    ``build`` has a row for every cap, even if the supporting documents alone exceed it; ``generate`` leaves that cap out.
    """
    good = status.where("status = 'processed'").select("qa_id", "supporting_tokens")
    budgets = F.explode(F.array(*[F.lit(c).cast("long") for c in sorted(set(caps))])).alias("cap")
    run = Window.partitionBy("qa_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = distractors.select("qa_id", F.sum("n_tokens").over(run).alias("so_far"))
    both = good.select("qa_id", "supporting_tokens", budgets).join(summed, "qa_id", "left")
    fits = F.col("supporting_tokens") + F.col("so_far") <= F.col("cap")
    out = both.groupBy("qa_id", "cap", "supporting_tokens").agg(F.count_if(fits).alias("n_distractors"), F.coalesce(F.max(F.when(fits, F.col("so_far"))), F.lit(0)).alias("more"))
    out = out.select("qa_id", "cap", "n_distractors", (F.col("supporting_tokens") + F.col("more")).alias("context_size"), "supporting_tokens")
    if variant == "generate":
        out = out.where("supporting_tokens <= cap")
    return out.drop("supporting_tokens")


def dataset(entries: DataFrame, support: DataFrame, distractors: DataFrame, slices: DataFrame, articles: DataFrame) -> DataFrame:
    """The finished rows: ``(cap, id, question, gold_answer, supporting_docs, distractor_docs, context_size)``."""
    docs = articles.select("article_id", as_document().alias("doc"))
    ordered = lambda place: F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), "doc"))), lambda s: s["doc"])
    sup = support.join(docs, "article_id").groupBy("qa_id").agg(ordered("pos").alias("supporting_docs"))
    far = distractors.select("qa_id", "place", "article_id").join(slices.select("qa_id", "cap", "n_distractors"), "qa_id").where(F.col("place") < F.col("n_distractors"))
    far = far.join(docs, "article_id").groupBy("qa_id", "cap").agg(ordered("place").alias("distractor_docs"))
    rows = slices.join(entries.select("qa_id", "question", "answer"), "qa_id").join(sup, "qa_id").join(far, ["qa_id", "cap"], "left")
    none = F.array().cast("array<struct<title:string,text:string>>")
    return rows.select("cap", F.col("qa_id").alias("id"), "question", F.col("answer").alias("gold_answer"), "supporting_docs", F.coalesce("distractor_docs", none).alias("distractor_docs"), "context_size")


def report(status: DataFrame, slices: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """One row: entries by status, and the mean fill, distractors and fallbacks (of ``chosen``) at the largest cap."""
    biggest = slices.groupBy("qa_id").agg(F.max(F.struct("cap", "context_size", "n_distractors")).alias("x"))
    fill = biggest.agg(F.coalesce(F.avg(F.col("x.context_size") / F.col("x.cap")), F.lit(0.0)).alias("avg_fill"), F.coalesce(F.avg("x.n_distractors"), F.lit(0.0)).alias("avg_distractors"))
    counts = status.agg(F.count(F.lit(1)).alias("n_entries"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("processed", "skipped_missing", "skipped_overflow", "no_facts")))
    out = counts.join(F.broadcast(fill), F.lit(True))
    if chosen is not None:
        out = out.join(F.broadcast(chosen.agg(F.coalesce(F.avg("fallbacks"), F.lit(0.0)).alias("avg_fallbacks"))), F.lit(True))
    return out


@dataclass(frozen=True)
class Target:
    """A throughput in entries a second that a run of at least ``least`` entries should reach."""

    per_second: float
    least: int = 20

    def check(self, done: int, seconds: float) -> dict:
        """The throughput, and whether it is below the target; too few entries never are."""
        rate = done / seconds if seconds > 0 else 0.0
        return {"throughput": rate, "below_target": done >= self.least and rate < self.per_second}


#: The throughput each command should reach.
TARGETS = {"build": Target(20.0), "generate": Target(5.0), "profile": Target(800.0, 0)}


def validate_index(vocab: DataFrame, postings: DataFrame) -> None:
    """Raises ``ValueError`` if the vocabulary or the postings are empty."""
    for name, rows in (("vocabulary", vocab), ("inverted index", postings)):
        if rows.isEmpty():
            raise ValueError(f"the {name} is empty; build the index first")
