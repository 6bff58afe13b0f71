"""A small corpus from a dump to a dataset, by the commands."""

import bz2
import json

import pytest

from lexmill import cli


def test_pipeline(spark, tmp_path):
    (tmp_path / "dump" / "AA").mkdir(parents=True)
    link = lambda t: f'<a href="{t.replace(" ", "%20")}">{t}</a>'
    pages = [
        {"id": "1", "title": "Copper mine", "text": [["A copper mine near the river."], [link("River town"), " lies close to ", link("Copper mine")]]},
        {"id": "2", "title": "River town", "text": [["The river town trades copper."], [link("Copper mine")]]},
        {"id": "3", "title": "Old abbey", "text": [["An abbey without links, of stone."], [link("Nowhere")]]},
    ]
    (tmp_path / "dump" / "AA" / "wiki_00.bz2").write_bytes(bz2.compress("\n".join(map(json.dumps, pages)).encode()))
    run = lambda *a: cli.main(["--store", str(tmp_path / "store"), *a], spark)
    loaded = run("load", str(tmp_path / "dump"))
    assert loaded["articles"] == 3 and loaded["links"]["n_links"] == 4 and loaded["links"]["n_resolved"] == 3
    assert run("build-index")["n_articles"] == 3
    assert run("build-pagerank")["nodes"] == 2
    assert run("search", "copper mine")[0]["title"] == "Copper mine"
    assert run("search", "old ABBEY")[0]["title"] == "Old abbey"
    assert run("benchmark", "--count", "3", "--out", str(tmp_path / "csv"))["queries"] == 3
    (tmp_path / "none.txt").write_text("\n")
    (tmp_path / "qa.json").write_text(json.dumps([{"_id": "q", "question": "Which river?", "answer": "Town", "supporting_facts": [["Copper mine", 0]]}]))
    assert run("evaluate", str(tmp_path / "qa.json"), "--alphas", "0.5,0.9")["best_by_mrr"]["mrr"] == 1.0
    report = run("build-qa", str(tmp_path / "qa.json"), str(tmp_path / "out"), "--caps", "10,100", "--min-tokens", "1")
    assert report["n_processed"] == 1
    rows = json.loads((tmp_path / "out" / "qa_dataset_100.json").read_text())
    assert rows[0]["supporting_docs"][0]["title"] == "Copper mine" and rows[0]["context_size"] <= 100
    assert run("count-articles", str(tmp_path / "dump"))["total"] == 3
    assert run("summary")["n_articles"] == 3 and run("status")["n_links"] == 4
    assert len(run("random-articles")) == 2
    assert run("article", "1")["title"] == "Copper mine"
    with pytest.raises(SystemExit):
        run("article", "77")
    assert {t["table_name"]: t["n_rows"] for t in run("tables")[0]["tables"]}["article"] == 3
    timed = run("benchmark", "--count", "5", "--each", "2", "--examples", "1", "--queries", str(tmp_path / "none.txt"))
    assert timed["queries"] == 5 and timed["each"]["n"] == 2 and timed["each"]["p95"] >= timed["each"]["least"] and timed["examples"]
    (tmp_path / "rules.json").write_text(json.dumps([{"name": "spark.sql.shuffle.partitions", "kind": "number", "least": 1000.0}]))
    assert [r["message"] for r in run("check-settings", str(tmp_path / "rules.json"))] == ["too small"]
    assert report["avg_fallbacks"] >= 0 and report["below_target"] is False and [p["phase"] for p in report["phases"]] == ["distractors", "rows", "files"]
    ranked = run("build-pagerank", "--limit", "2", "--project", "1000")
    assert ranked["projection"]["articles"] == 1000 and [p["phase"] for p in ranked["phases"]] == ["compute", "store"]
    assert run("build-index", "--limit", "1")["n_articles"] == 1
    swept = run("sweep", str(tmp_path / "dump"), "--limits", "2", "--shuffles", "4", "--out", str(tmp_path / "sweep.csv"))
    assert [r["articles"] for r in swept] == [2] and (tmp_path / "sweep.csv").read_text().startswith("limit,shuffle_partitions")
    run("load", str(tmp_path / "dump"), "--profile", str(tmp_path / "profile.txt"))
    assert "articles" in (tmp_path / "profile.txt").read_text() and json.loads((tmp_path / "profile.txt.json").read_text())
    assert run("status")["n_terms"] == 0  # a new dump empties the index of the old one
    with pytest.raises(SystemExit):
        run("clean")
    assert run("clean", "--yes")["article"] == 3
