"""Commands: ``python -m lexmill.cli COMMAND [options]``; the tables lie below ``--store``."""

from __future__ import annotations

import argparse
import csv
import json
import os
import sys
import time
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.tokenizers import tokenizer
from lexmill.operators import evaluate, graph, index, links, qa, search, settings, stats
from lexmill.operators.search import HybridParams
from lexmill.session import get_session, materialise
from lexmill.sources import dumps, files
from lexmill.sources.store import Store


def memory_mb() -> float:
    """The resident memory of the driver's Python process."""
    with open("/proc/self/statm", encoding="ascii") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


class Phases:
    """Wall-clock seconds, memory growth and Spark jobs by phase, in the order of their run."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.rows = spark, []

    @property
    def seconds(self) -> dict[str, float]:
        return {r["phase"]: r["seconds"] for r in self.rows}

    def __call__(self, name: str, work: Callable):
        began, had = time.time(), memory_mb()
        if self.spark:
            self.spark.sparkContext.setJobGroup(f"lexmill-{name}", name)
        out = work()
        jobs = len(self.spark.sparkContext.statusTracker().getJobIdsForGroup(f"lexmill-{name}")) if self.spark else 0
        self.rows.append({"phase": name, "seconds": round(time.time() - began, 3), "memory_mb": round(memory_mb() - had, 2), "jobs": jobs})
        return out

    def report(self) -> list[dict]:
        """The phases with their share of the whole time, in per cent."""
        whole = sum(r["seconds"] for r in self.rows)
        return [r | {"percent": round(100 * r["seconds"] / whole, 1) if whole else 0.0} for r in self.rows]

    def save(self, path: str, top: int | None = None) -> None:
        """Write the phases, the longest first, as text, and as JSON beside it."""
        rows = sorted(self.report(), key=lambda r: -r["seconds"])[:top]
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text("".join(f"{r['seconds']:10.3f} s {r['percent']:5.1f} % {r['memory_mb']:+9.2f} MB {r['jobs']:4d} jobs  {r['phase']}\n" for r in rows), encoding="utf-8")
        Path(f"{path}.json").write_text(json.dumps(rows, indent=2) + "\n", encoding="utf-8")


def load_dump(store: Store, args) -> dict:
    """Read a dump into the article and link tables, then resolve the links."""
    phases = Phases(store.spark)
    articles, found = dumps.ingest(store.spark, args.root, args.limit, tokenizer(args.tokenizer))
    phases("articles", lambda: store.write("article", articles))
    phases("links", lambda: store.write("internal_link", found))
    store.truncate("vocabulary", "inverted_index", "pagerank")  # they belong to the articles of before
    out = phases("resolve", lambda: resolve(store, args))
    if args.profile:
        phases.save(args.profile)
    return out | {"articles": store.count("article"), "seconds": phases.seconds}


def resolve(store: Store, args) -> dict:
    done = links.resolve_links(store.read("internal_link"), store.read("article"))
    store.write("internal_link", done.drop("updated"))
    return {"links": links.link_counts(store.read("internal_link")).first().asDict()}


def build_index(store: Store, args) -> dict:
    """Vocabulary and postings, the postings sorted by term and falling score."""
    articles = store.read("article")
    if args.limit:
        articles = articles.orderBy("article_id").limit(args.limit)
    n = articles.count()
    tf = materialise(index.term_frequencies(articles, tokenizer(args.tokenizer)), "tf")
    vocab = index.vocabulary(tf, n)
    store.write("vocabulary", vocab.withColumn("term_id", F.xxhash64("term")).select("term_id", "term", "document_frequency", "idf_value"))
    postings = index.inverted_index(tf, store.read("vocabulary")).select("term", F.col("article_id").alias("article"), "tf_idf_score")
    store.write("inverted_index", postings, sort=["term", "tf_idf_score"], partitions=args.partitions)
    return index.index_summary(tf, n).first().asDict()


def build_pagerank(store: Store, args) -> dict:
    phases, rows = Phases(store.spark), store.read("internal_link")
    if args.limit:
        rows = rows.orderBy("link_id").limit(args.limit)
    done = phases("compute", lambda: graph.pagerank(rows, args.damping, args.max_iter, args.tol))
    phases("store", lambda: store.write("pagerank", done.scores))
    rate = done.n_nodes / max(sum(phases.seconds.values()), 1e-9)
    out = {"nodes": done.n_nodes, "iterations": done.iterations, "residual": done.residual, "articles_per_s": round(rate, 1), "phases": phases.report(), **graph.rank_stats(store.read("pagerank")).first().asDict()}
    if args.project and rate:
        seconds = args.project / rate
        out["projection"] = {"articles": args.project, "seconds": round(seconds, 2), "target": args.target, "speedup_needed": round(seconds / args.target, 2)}
    return out


def _params(args) -> HybridParams:
    return HybridParams(args.limit, args.alpha, args.max_candidates, args.bonus, args.strict_and, args.policy, not args.no_partial_boost)


def _searcher(store: Store, args) -> Callable[[DataFrame, HybridParams], DataFrame]:
    tables = store.read("vocabulary"), store.read("inverted_index"), store.read("pagerank"), store.read("article")
    qa.validate_index(tables[0], tables[1])

    def find(queries: DataFrame, params: HybridParams | list[HybridParams]) -> DataFrame:
        run = search.search_grid if isinstance(params, list) else search.search_hybrid
        return run(queries, *tables, params, tokenizer(args.tokenizer))

    return find


def run_search(store: Store, args) -> list:
    queries = store.spark.createDataFrame([(0, args.query)], "query_id long, query string")
    rows = search.search_with_fallback(queries, store.read("vocabulary"), store.read("inverted_index"), store.read("pagerank"), store.read("article"), _params(args), tokenizer(args.tokenizer))
    return [r.asDict() for r in rows.orderBy("rank").collect()]


def benchmark(store: Store, args) -> dict:
    """Queries from a file, or sampled titles if it has none; one batch; optional CSV of the results.

    ``--each`` runs that many of them one by one as well, and adds the mean, median and 95th percentile of their seconds.
    """
    queries = None
    if args.queries:
        queries = files.read_queries(store.spark, args.queries, args.count)
    if queries is None or queries.isEmpty():
        picked = stats.sample_to(store.read("article").select("article_id", "title"), "article_id", args.count, args.seed)
        queries = picked.select(F.col("place").alias("query_id"), F.col("title").alias("query"))
    queries = materialise(queries, "queries")
    n, began = queries.count(), time.time()
    results = materialise(_searcher(store, args)(queries, _params(args)), "results")
    took = time.time() - began
    if args.save_queries:
        files.write_queries(queries, args.save_queries)
    if args.out:
        files.write_results(results, queries, args.out)
    out = {"queries": n, "results": results.count(), "seconds": round(took, 3), "searches_per_s": round(n / took, 2), "target_met": n / took >= args.target, "mean_latency_s": round(took / max(n, 1), 6)}
    if args.each:
        find, times = _searcher(store, args), []
        for row in queries.orderBy("query_id").limit(args.each).collect():
            started = time.time()
            find(store.spark.createDataFrame([tuple(row)], queries.schema), _params(args)).collect()
            times.append((time.time() - started,))
        out["each"] = {k: round(v, 4) for k, v in stats.timing_stats(store.spark.createDataFrame(times, "s double"), "s").first().asDict().items()}
    shown = results.where("rank <= 3").orderBy("query_id", "rank").limit(3 * args.examples).collect() if args.examples else []
    return out | ({"examples": [r.asDict() for r in shown]} if shown else {})


def _relevant(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    facts = materialise(qa.supporting_titles(entries), "facts")
    first = facts.groupBy("qa_id").agg(F.min_by("title", "pos").alias("query")).withColumnRenamed("qa_id", "query_id")
    return first, facts.select(F.col("qa_id").alias("query_id"), "title")


def evaluate_search(store: Store, args) -> dict:
    """Retrieval quality over question files; with several alphas or bonuses, over their grid."""
    queries, relevant = _relevant(files.qa_entries(store.spark, args.input, args.entries))
    find = _searcher(store, args)
    numbers = lambda text: [float(x) for x in text.split(",") if x.strip()]
    grid = evaluate.parameter_grid(alpha=numbers(args.alphas), coverage_bonus=numbers(args.bonuses), limit=[max(20, args.k)], partial_boost=[not args.no_partial_boost])
    rows = materialise(evaluate.grid_search(find(queries, grid), grid, relevant, args.k), "grid")
    out = {"k": args.k, "grid_results": [r.asDict() for r in rows.orderBy("grid_order").collect()]}
    out |= {f"best_by_{m}": evaluate.best_by(rows, m).first().asDict() for m in ("ndcg", "mrr")}
    if args.out:
        with open(args.out, "w", encoding="utf-8") as file:
            json.dump(out, file, indent=2)
    return out


def build_qa(store: Store, args) -> dict:
    """A question-answering dataset for each cap, and its report."""
    caps = tuple(int(x) for x in args.caps.split(",") if x.strip())
    params = qa.QAParams(caps=caps, min_tokens=args.min_tokens, max_fallbacks=args.max_fallbacks, variant=args.variant)
    articles = store.read("article")
    phases = Phases(store.spark)
    entries = materialise(files.qa_entries(store.spark, args.input, args.entries), "entries")
    sized = materialise(qa.article_tokens(articles, tokenizer(args.tokenizer)), "sized")
    support = materialise(qa.supporting_documents(entries, sized), "support")
    status = materialise(qa.entry_status(entries, support, caps), "status")
    picked = phases("distractors", lambda: materialise(qa.choose_distractors(entries, support, status, sized, _searcher(store, args), params), "chosen"))
    chosen = qa.distractors_of(picked)
    slices = qa.context_slices(status, chosen, caps, params.variant)
    rows = phases("rows", lambda: materialise(qa.dataset(entries, support, chosen, slices, articles), "qa-rows"))
    phases("files", lambda: [files.write_dataset_array(rows, args.out, cap) for cap in caps])
    seconds, guard = sum(phases.seconds.values()), qa.TARGETS[params.variant].check(picked.count(), sum(phases.seconds.values()))
    samples = [r.asDict(recursive=True) for r in picked.select("qa_id", "fallbacks", F.size("picked").alias("n_picked")).orderBy("qa_id").limit(args.samples).collect()]
    more = {"caps": list(caps), "params": asdict(params), "fallback_params": asdict(params.fallback_search), "phases": phases.report(), "seconds": round(seconds, 3), **guard, "samples": samples}
    return files.write_report(qa.report(status, slices, picked), f"{args.out}/report.json", generated_at=time.strftime("%Y-%m-%dT%H:%M:%S"), **more)


def count_articles(store: Store, args) -> dict:
    paths = dumps.require_shards(args.root, fallback=True)
    some = dumps.sample_shards(paths, args.sample) if args.sample or args.estimate else paths
    counts = materialise(dumps.count_by_file(store.spark, some), "counts")
    return stats.source_stats(counts, len(paths)).first().asDict() | {"top": [r.asDict() for r in stats.top_sources(counts).collect()]}


def article(store: Store, args) -> dict:
    """One article by its page, its links rewritten."""
    found = links.article_detail(store.read("article"), args.page).first()
    if found is None:
        raise SystemExit(f"no article with page id {args.page}")
    return found.asDict()


def sweep(store: Store, args) -> list:
    """Load a dump once for each combination of limits and shuffle partitions; a CSV of the times."""
    rows = []
    for limit in (int(x) for x in args.limits.split(",")):
        for partitions in (int(x) for x in args.shuffles.split(",")):
            store.spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            own, began = Store(store.spark, f"{store.root}/sweep-{limit}-{partitions}"), time.time()
            done = load_dump(own, argparse.Namespace(root=args.root, limit=limit, tokenizer=args.tokenizer, profile=None))
            took = time.time() - began
            own.remove()
            rows.append({"limit": limit, "shuffle_partitions": partitions, "articles": done["articles"], "seconds": round(took, 3), "articles_per_s": round(done["articles"] / took, 1), **{f"{k}_s": v for k, v in done["seconds"].items()}})
    if args.out:
        with open(args.out, "w", encoding="utf-8", newline="") as file:
            writer = csv.DictWriter(file, list(rows[0]))
            writer.writeheader()
            writer.writerows(rows)
    return rows


def tables(store: Store, args) -> list:
    """The tables with their rows, files and bytes; with ``--every`` again and again, ``--times`` times."""
    out = []
    for i in range(max(1, args.times)):
        if i:
            time.sleep(args.every)
        out.append({"at": time.strftime("%Y-%m-%dT%H:%M:%S"), "tables": [r.asDict() for r in store.statistics().collect()], "jobs": len(store.spark.sparkContext.statusTracker().getActiveJobsIds())})
    return out


def check_settings(store: Store, args) -> list:
    """The session's settings held against a JSON file of rules."""
    rules = store.spark.read.schema(settings.RULES).option("multiLine", True).json(args.rules)
    return [r.asDict() for r in settings.check_settings(settings.session_settings(store.spark), rules).where("status <> 'unknown'").orderBy("name").collect()]


def summary(store: Store, args) -> dict:
    return stats.summary(store.read("article"), store.read("internal_link")).first().asDict()


def status(store: Store, args) -> dict:
    return stats.status(*(store.read(n) for n in ("article", "internal_link", "vocabulary", "inverted_index", "pagerank"))).first().asDict()


def random_articles(store: Store, args) -> list:
    return [r.asDict() for r in stats.two_random(store.read("article"), args.seed).collect()]


def clean(store: Store, args) -> dict:
    if not args.yes:
        raise SystemExit("this removes all tables; repeat with --yes")
    return store.truncate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    top.add_argument("--store", required=True)
    top.add_argument("--master")
    top.add_argument("--tokenizer", default="word")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *options: tuple) -> None:
        own = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        own.set_defaults(run=run)
        for flag, kind, default in options:
            if kind is bool:
                own.add_argument(flag, action="store_true")
            elif flag.startswith("--"):
                own.add_argument(flag, type=kind, default=default)
            else:
                own.add_argument(flag, type=kind)

    find = (("--limit", int, 20), ("--alpha", float, 0.85), ("--max-candidates", int, 500), ("--bonus", float, 0.0), ("--strict-and", bool, False), ("--policy", str, "balanced"), ("--no-partial-boost", bool, False))
    command("load", load_dump, ("root", str, None), ("--limit", int, None), ("--profile", str, None))
    command("resolve-links", resolve)
    command("build-index", build_index, ("--partitions", int, None), ("--limit", int, None))
    command("build-pagerank", build_pagerank, ("--damping", float, 0.85), ("--max-iter", int, 100), ("--tol", float, 1e-6), ("--limit", int, None), ("--project", int, 0), ("--target", float, 15.0))
    command("search", run_search, ("query", str, None), *find)
    command("benchmark", benchmark, ("--queries", str, None), ("--count", int, 1000), ("--seed", int, 42), ("--out", str, None), ("--save-queries", str, None), ("--target", float, 20.0), ("--each", int, 0), ("--examples", int, 0), *find)
    command("evaluate", evaluate_search, ("input", str, None), ("--entries", int, None), ("--k", int, 10), ("--alphas", str, "0.85"), ("--bonuses", str, "0.1"), ("--no-partial-boost", bool, False), ("--out", str, None))
    command("build-qa", build_qa, ("input", str, None), ("out", str, None), ("--entries", int, None), ("--caps", str, "8000,32000"), ("--min-tokens", int, 64), ("--max-fallbacks", int, 2), ("--variant", str, "build"), ("--samples", int, 20))
    command("article", article, ("page", int, None))
    command("sweep", sweep, ("root", str, None), ("--limits", str, "1000"), ("--shuffles", str, "8"), ("--out", str, None))
    command("tables", tables, ("--every", float, 5.0), ("--times", int, 1))
    command("check-settings", check_settings, ("rules", str, None))
    command("count-articles", count_articles, ("root", str, None), ("--sample", int, None), ("--estimate", bool, False))
    command("summary", summary)
    command("status", status)
    command("random-articles", random_articles, ("--seed", int, 42))
    command("clean", clean, ("--yes", bool, False))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    spark = spark or get_session("lexmill", args.master)
    return args.run(Store(spark, args.store), args)


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1:]), indent=2, default=str))
