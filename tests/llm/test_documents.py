"""Encoding, packing and subjects."""

import random

import pytest

from lexmill.llm import encode, packing, subjects

TEXTS = [None, "", " ", "\n\n  x", "Hello world", "it's 'S 12345 1½ ½", "naïve Ünïcode 漢字 かな 😀👍🏽", "<|endoftext|> a", "\x00\x1f﻿​", "a" * 20_000, "ab" * 5_000 + " " * 3_000, "\t\t\r\n end ", "é" * 50, "Hello world"]


def reference():
    import tiktoken

    with open(encode.TOKENIZER, "rb") as file:
        return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(file.read()), special_tokens={})


def test_encoding(spark):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("ab cé'1.漢 \n-") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    coder = reference()
    expected = {i: coder.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in encode.encode(docs).collect()} == expected
    assert {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(docs).collect()} == {i: len(x) for i, x in expected.items()}
    assert b"".join(coder.decode_single_token_bytes(i) for i in expected[6]).decode() == texts[6]
    assert encode.encode(docs.where("false")).count() == 0


def test_every_token_of_the_vocabulary_and_shared_prefixes():
    with open(encode.TOKENIZER, "rb") as file:
        ranks = encode.read_ranks(file.read())
    coder, trie = reference(), encode.TrieEncoder(ranks)
    words = [t for t in ranks if len(t) > 1][::7] + [b"prefix", b"prefixes", b"prefixed", b"prefixing"]
    found = trie.encode_words(words)
    assert all(found[w] == coder._core_bpe.encode_single_piece(w) for w in words)
    alone = sum(len(w) for w in set(words))
    assert trie.states < alone  # shared prefixes were walked once


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(encode, "MEMORY", 3)
    with open(encode.TOKENIZER, "rb") as file:
        coder = encode.TextEncoder(file.read())
    for text in ("one two three four five", "six one", "seven"):
        assert coder.batch([text.encode()])[0] == reference().encode_ordinary(text)


def test_invalid_bytes_and_long_batches():
    import pyarrow as pa

    with open(encode.TOKENIZER, "rb") as file:
        coder = encode.TextEncoder(file.read())
    assert coder.batch([b"a\xff"])[0] == reference().encode_ordinary("a�")
    batch = pa.record_batch([pa.array(range(5)), pa.array([b"x" * 9, None, b"", b"y" * 30, b"z"])], names=["doc_id", "text"])
    assert [b.num_rows for b in encode._bites(batch, 10)] == [3, 1, 1]


# --- packing ---


def test_differencing_is_even():
    sizes = [random.Random(1).randint(1, 900) for _ in range(400)]
    windows = packing.difference(sizes, 40)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400)) and max(sums) - min(sums) < 0.02 * max(sums)
    assert packing.difference([], 3) == [[], [], []] and packing.difference([5], 2) == [[0], []]


@pytest.mark.parametrize("sizes", [[], [0, 0], [10], [10] * 7, [6] * 5, [0, 10, 1, 9, 2, 8, 3], [7, 7, 7, 3, 3, 3]])
def test_windows_never_overflow(sizes):
    where = packing.pack(sizes, 10)
    assert len(where) == len(sizes)
    assert all(sum(s for s, w in zip(sizes, where, strict=True) if w == k) <= 10 for k in set(where))


def test_pack_items(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 1, rng.randint(1, 99), rng.randint(1, 99), 100, 250])) for i in range(700)] + [(3, 5), (3, 5)]
    items = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, n_tokens long, bin int, container_id int")
    out = packing.pack_items(items, 100, group_items=150).collect()
    used, pieces = {}, {}
    for r in out:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["n_tokens"]))
    assert max(used.values()) <= 100
    assert sum(used.values()) / (100 * len(used)) > 0.97
    for doc, size in rows[:700]:
        if doc == 3:
            continue
        parts = sorted(pieces[doc])
        assert sum(p[2] for p in parts) == (size or 0) and len(parts) == max(1, -(-(size or 0) // 100))
        assert [p[1] for p in parts] == [100 * i for i in range(len(parts))]
    assert len(pieces[3]) >= 3
    assert packing.pack_items(items.where("false"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack_items(items, 0)


def test_a_third_of_the_rows_alike(spark):
    items = spark.createDataFrame([(7, 60)] * 300 + [(i, 40) for i in range(600)], "doc_id long, n_tokens long")
    box = packing.containers(packing.pack_items(items, 100, 100), 100)
    assert box.agg({"used": "max"}).first()[0] <= 100 and box.agg({"used": "sum"}).first()[0] == 300 * 60 + 600 * 40


# --- subjects ---


def test_sentences():
    cut = subjects.Sentences()
    assert cut("Heading\n\nThe noble kings ruled. “A word,” noted St. Abc, “is it.” Was it so?No end") == [["the", "noble", "king", "ruled"], ["word", "noted", "st", "abc", "is", "it"], ["was", "it", "so"]]
    assert cut("Broken wo-\nrds here. <b>It&#x27;s</b> mÃ©dical.") == [["broken", "word", "here"], ["it", "medical"]]
    assert cut("") == [] and cut("12 13\t14") == []


TOPICS = {"law": "court judge verdict appeal statute trial", "food": "dough broth spice butter oven stew", "sport": "match league goal coach stadium team"}
OTHER = "candle ribbon puzzle bead needle yarn"


def make(seed, n=360):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        kind = rng.choice([["law"], ["food"], ["sport"], ["law", "food"], [], []])
        out = [f"The {' '.join(rng.sample(TOPICS[k].split(), 3))} was there in {rng.randint(1, 99)}." for k in kind for _ in range(4)]
        out += [f"The {' '.join(rng.sample(OTHER.split(), 3))} was there." for _ in range(4)] if not kind else []
        out += ["Opinions differ there.", "It remained so then."][: rng.randint(0, 2)]
        rng.shuffle(out)
        docs.append((i, " ".join(out), rng.choice(["en", "EN ", "en-XX", None])))
        truth[i] = set(kind)
    labels = [(i, k.upper() if rng.random() < 0.2 else k) for i in range(0, n, 4) for k in truth[i]] + [(1, "unknown"), (4, None), (None, "law")]
    return docs, truth, labels


def test_subjects(spark):
    docs, truth, labels = make(1)
    docs = docs + [(900, None, "en"), (901, "", None), (902, "no sentence", "en"), (903, "Zzz yyy. " * 3000, "en"), (0, docs[0][1], "en")]
    frame = spark.createDataFrame([(*d, "clash", 0.5) for d in docs], "doc_id long, text string, lang string, terms string, share double")
    areas = spark.createDataFrame([(k, f"about {v.split()[0]}") for k, v in TOPICS.items()] + [(None, "x")], "subject string, description string")
    marks = spark.createDataFrame(labels, "doc_id long, subject string")
    found = {}
    for r in subjects.subject_areas(frame, areas, marks, rank=12).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    held_out = [i for i in truth if i % 4]
    right = sum(found.get(i, set()) == truth[i] for i in held_out) / len(held_out)
    assert right > 0.95 and not {900, 901, 902, 903} & set(found)
    assert subjects.subject_areas(frame.where("false"), areas, marks).count() == 0
    assert subjects.subject_areas(frame.where("doc_id >= 900"), areas.where("false"), marks).count() == 0
    assert subjects.subject_areas(frame, areas, marks.where("false"), rank=12).columns == ["doc_id", "subject", "share", "n_sentences"]


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{d}/subject_label.parquet")
    known = marks.where("doc_id % 2 = 0")
    found = {(r["doc_id"], r["subject"]) for r in subjects.subject_areas(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/subject_area.parquet"), known).collect()}
    unseen = [(r["doc_id"], r["subject"].lower()) for r in marks.where("doc_id % 2 = 1").distinct().collect()]
    assert sum(x in found for x in unseen) / len(unseen) > 0.7


@pytest.mark.parametrize(("labelled", "found_at_least"), [({"law", "food", "sport"}, 1.0), ({"law", "food"}, 0.4), ({"law"}, 0.2)])
def test_a_rare_language_is_seeded(spark, labelled, found_at_least):
    """One label for each area is under 2 % of the labels; areas that have one must not draw the documents of the others."""
    rng, docs, truth, labels = random.Random(1), [], {}, []
    for i in range(720):
        rare, kind = i % 12 == 0, rng.choice([*TOPICS, None])
        text = [f"the {' '.join(rng.sample((TOPICS[kind] if kind else OTHER).split(), 3))} was there with upon every." for _ in range(4)] + ["opinion differ there."]
        text = " ".join(" ".join(w.rstrip(".")[::-1] + "o" + "." * w.endswith(".") for w in t.split()) if rare else t for t in text)
        docs.append((i, text, "pt" if rare else "en"))
        if not rare and kind and i % 4:
            labels.append((i, kind))
        elif rare and kind in labelled and kind not in {truth.get(k) for k in range(0, i, 12)}:
            labels.append((i, kind))
        if rare:
            truth[i] = kind
    assert sum(i % 12 == 0 for i, _ in labels) < 0.02 * len(labels)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    areas = spark.createDataFrame([(k, f"about {v.split()[0]}") for k, v in TOPICS.items()], "subject string, description string")
    found = subjects.subject_areas(frame, areas, spark.createDataFrame(labels, "doc_id long, subject string"), rank=16).where("doc_id % 12 = 0").collect()
    assert all(truth[r["doc_id"]] == r["subject"] for r in found)
    assert len(found) >= found_at_least * sum(k is not None for k in truth.values())
