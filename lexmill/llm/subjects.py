"""Subject areas of documents.

Documents are embedded by term weighting and a truncated singular value decomposition. Labelled documents and the
descriptions of the areas seed one centroid for each area and language; documents go to the nearest centroid by cosine,
and the centroids are taken anew, a few times. Documents that lie outside the span of all centroids found new ones that
stand for no area, so that what is about none of the areas has somewhere to go. What the centroids of one language share (its common words) is then taken
out, sentences are embedded like documents, and each goes to the area of the centroid nearest by cosine, or to none. An
area holds for a document if enough of its sentences are about it.

Every pass goes over all documents. What reaches the driver are the term list and matrices of terms x rank or areas x
languages x rank, whose sizes do not depend on the number of documents.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.session import discard, materialise, ship_package

#: Singular vectors kept.
RANK = 128
#: Passes of the subspace iteration, of each centroid refinement, and of the search for centroids of no area.
POWER_PASSES, REFINE_PASSES, OUTSIDE_PASSES = 4, 2, 2
#: A document is outside if so much of its squared length is.
OUTSIDE = 0.7
#: Terms in fewer documents have no slot of their own in the embedding, nor have those beyond the ``TERMS`` of highest df; they
#: share ``SHARED`` slots by a hash, so that no word is dropped and the matrices are bounded, whatever the number of documents.
MIN_DF, TERMS, SHARED = 3, 100_000, 256
#: Cosines from which a document counts for a centroid, and a sentence for an area.
DOCUMENT_COSINE, SENTENCE_COSINE = 0.5, 0.42
#: Length, against its whole length, that a sentence must have within the span of the centroids; neutral ones have less.
SENTENCE_LENGTH = 0.2
#: Share of a document's sentences from which an area holds for it.
SHARE = 0.25
#: Languages of less than this share of the labelled documents are rare: they are seeded like the others, but the mean of
#: their documents, not of their centroids, is taken as common to them.
RARE = 0.02
#: Length that a seed of a rare language must keep when that mean is taken out; with less, the area cannot be told from the
#: language, and no sentence is assigned to it.
DISTINCT = 0.1


# --- text ---


class Sentences:
    """Cuts a text into sentences of terms."""

    def __init__(self):
        import regex

        self.tags = regex.compile(r"<[^<>]*>").sub
        self.broken = regex.compile("[ÂÃâ][^\\x00-\\x7f]{1,2}")
        self.unseen = regex.compile(r"[^\P{C}\n\t\r]|[  ]").sub
        self.wrapped = regex.compile(r"(?<=\p{L})-\r?\n(?=\p{Ll})").sub
        self.parts = regex.compile(r"\r?\n\s*\n|(?<!\bSt\.)(?<=[.!?])[\"”»’)\]]*(?:\s+|(?=[\p{Lu}“«]))").split
        self.ended = regex.compile(r"[.!?][\"”»’)\]]*$").search
        self.marks = regex.compile(r"\p{M}").sub
        self.words = regex.compile(r"\p{L}{2,}").findall
        # the same for plain ASCII, where they are cheaper
        self.plain_unseen = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]").sub
        self.plain_words = re.compile(r"[a-z]{2,}").findall
        self.plain_parts = re.compile(r"\r?\n\s*\n|(?<!\bSt\.)(?<=[.!?])[\"')\]]*(?:\s+|(?=[A-Z]))".replace("'", "")).split
        self.plain_ended = re.compile(r"[.!?][\")\]]*$").search

    def _mend(self, match) -> str:
        for coding in ("cp1252", "latin-1"):
            try:
                return match.group().encode(coding).decode("utf-8")
            except UnicodeError:
                pass
        return match.group()

    def terms(self, sentence: str) -> list[str]:
        """Lower-case words of two letters or more, without accents and a final s."""
        if sentence.isascii():
            found = self.plain_words(sentence.lower())
        else:
            found = self.words(self.marks("", unicodedata.normalize("NFKD", sentence.lower())))
        return [w[:-1] if len(w) > 3 and w[-1] == "s" else w for w in found]

    def __call__(self, text: str) -> list[list[str]]:
        """The terms of each sentence: what ends with a full stop, ! or ? and has two terms. Headings are no sentences."""
        if "&" in text:
            text = html.unescape(text)
        if "<" in text:
            text = self.tags(" ", text)
        if not text.isascii() and self.broken.search(text):
            text = self.broken.sub(self._mend, text)
        if text.isascii():
            text, parts, ended = self.plain_unseen("", text), self.plain_parts, self.plain_ended
        else:
            text, parts, ended = self.unseen("", unicodedata.normalize("NFKC", text)), self.parts, self.ended
        if "-\n" in text or "-\r\n" in text:
            text = self.wrapped("", text)
        out = []
        for part in parts(text):
            part = part.strip() if part else ""
            if part and ended(part):
                terms = self.terms(part)
                if len(terms) > 1:
                    out.append(terms)
        return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = Sentences()
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            found = [cut(t.decode("utf-8", "replace")) if t else [] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[w for s in ss for w in s] for ss in found], pa.list_(pa.string())), pa.array([[len(s) for s in ss] for ss in found], pa.list_(pa.int32()))],
                names=["doc_id", "lang", "terms", "lens"],
            )


_INDEXED = "doc_id long, lang string, terms array<int>, lens array<int>, used array<int>, weights array<float>"


def _index(shared):
    """Puts slots for words, and adds the distinct slots of each document with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        terms, idf = shared.value
        known = pa.array(terms, pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                words = batch.column(2)
                offsets = words.offsets.to_numpy()
                flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
                slots = pc.index_in(flat, value_set=known)
                rare = np.flatnonzero(pc.is_null(slots).to_numpy(zero_copy_only=False))
                slots = pc.fill_null(slots, 0).to_numpy(zero_copy_only=False).astype(np.int32)
                slots[rare] = [len(terms) + zlib.crc32(w.encode()) % SHARED for w in flat.take(pa.array(rare)).to_pylist()]
                n, sizes = batch.num_rows, np.diff(offsets)
                at, used, weight = _weighted(slots, np.repeat(np.arange(n), sizes), n, idf)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(slots)), batch.column(3)]
                    + [pa.ListArray.from_arrays(ends, pa.array(used.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.float32)))],
                    names=["doc_id", "lang", "terms", "lens", "used", "weights"],
                )

    return run


def _embed(shared):
    """Puts the unit vector of each document for its slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value["basis"]
        for batch, flat, row, weight in _chunks(batches):
            vectors = _unit(_embedded(flat, row, weight, batch.num_rows, basis)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "lang", "area")], pa.array([v.tobytes() for v in vectors], pa.binary())], names=["doc_id", "lang", "area", "vector"])

    return run


# --- matrices ---


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the batches with the distinct slots of their documents, the document of each, and its weight."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            flat, sizes = _flat(batch.column("used"))
            yield batch, flat, np.repeat(np.arange(batch.num_rows), sizes), _flat(batch.column("weights"))[0]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches with the unit vectors of their documents as rows."""
    for batch in batches:
        if batch.num_rows:
            yield batch, np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(batch.num_rows, -1)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in a row, and the length of each list."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _dense(at: np.ndarray, term: np.ndarray, weight: np.ndarray | float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, term, weight) as a dense matrix over the terms that occur here, and these terms."""
    used, column = np.unique(term, return_inverse=True)
    x = np.zeros((n, len(used)), np.float32)
    x[at, column] = weight
    return x, used


def _weighted(flat: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents x terms as (document, term, weight), by document: (1 + ln tf) * idf, each document of length 1."""
    known = flat >= 0
    key, tf = np.unique(row[known] * len(idf) + flat[known], return_counts=True)
    at, term = np.divmod(key, len(idf))
    weight = ((1 + np.log(tf)) * idf[term]).astype(np.float32)
    length = np.sqrt(np.bincount(at, weight**2, n)).astype(np.float32)
    return at, term, weight / np.maximum(length[at], 1e-9)


def _embedded(flat: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The documents in the space of the basis, not yet of length 1."""
    x, used = _dense(row, flat, weight, n)
    return x @ basis[used]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)


_BLOCK = "block int, salt int, data binary"


def _summed(documents: DataFrame, add: Callable, shape: tuple[int, int], spread: int, shared) -> np.ndarray:
    """The sum over all documents of the matrices that ``add(total, batches, model)`` adds up in each task.

    Each task hands on its sum in blocks of about 1 MB; blocks are summed in two levels, first in ``spread`` parts, so that
    no task gets more than about the square root of the number of tasks of them.
    """
    height = max(1, 250_000 // max(1, shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape, np.float32)
        add(total, batches, shared.value)
        starts = range(0, shape[0], height)
        salt = TaskContext.get().partitionId() % spread
        yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([salt] * len(starts), pa.int32()), pa.array([total[s : s + height].tobytes() for s in starts], pa.binary())], names=["block", "salt", "data"])

    def merge(pdf):
        total = np.sum([np.frombuffer(d, np.float32) for d in pdf["data"]], axis=0, dtype=np.float32)
        return pdf.iloc[:1].assign(data=total.tobytes())

    parts = documents.mapInArrow(run, _BLOCK)
    for keys in (["block", "salt"], ["block"]):
        parts = parts.groupBy(*keys).applyInPandas(merge, _BLOCK)
    blocks = {r["block"]: np.frombuffer(bytes(r["data"]), np.float32) for r in parts.collect()}
    shared.destroy()
    out = np.zeros(shape, np.float32)
    for b, data in blocks.items():
        out[b * height : (b + 1) * height] = data.reshape(-1, shape[1])
    return out


def _add_power(total, batches, model):
    for batch, flat, row, weight in _chunks(batches, 64):
        x, used = _dense(row, flat, weight, batch.num_rows)
        total[used] += x.T @ (x @ model["basis"][used])


def _add_seeds(total, batches, model):
    for batch, e in _vectors(batches):
        np.add.at(total, batch.column("seed").to_numpy(zero_copy_only=False).astype(int), e)


def _add_nearest(total, batches, model):
    for _, e in _vectors(batches):
        cosine = e @ model["centroids"].T
        best = cosine.argmax(1)
        near = cosine[np.arange(len(best)), best] > DOCUMENT_COSINE
        np.add.at(total, best[near], e[near])


def _add_outside(total, batches, model):
    for _, e in _vectors(batches):
        away = 1 - ((e @ model["axes"]) ** 2).sum(1)
        at = np.flatnonzero((away > OUTSIDE) & (np.abs(e).sum(1) > 0))
        np.add.at(total, model["language"][(e[at] @ model["centroids"].T).argmax(1)], e[at])


def _axes(vectors: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the span of the rows, as columns."""
    _, size, rows = np.linalg.svd(vectors, full_matrices=False)
    return rows[size > 1e-4 * size[0]].T.astype(np.float32)


def _assign(shared):
    """Counts the sentences of each document about each area."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vectors, axes, areas, names = model["basis"] * model["idf"][:, None], model["axes"], model["areas"], model["names"]
        n_terms, n_areas = len(vectors), len(names)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                flat = _flat(batch.column("terms"))[0]
                lens, n_sentences = _flat(batch.column("lens"))
                sentence = np.repeat(np.arange(len(lens)), lens)
                of = np.repeat(np.arange(batch.num_rows), n_sentences)  # the document of each sentence
                where, term = np.divmod(np.unique(sentence * n_terms + flat), n_terms)
                about = np.full(len(lens), -1)
                steps = np.arange(0, len(lens), 128)  # few sentences have few terms, so that the matrices stay small
                for start, a, b in zip(steps, np.searchsorted(where, steps), np.searchsorted(where, steps + 128), strict=True):
                    x, used = _dense(where[a:b] - start, term[a:b], 1.0, min(128, len(lens) - start))
                    e = x @ vectors[used]
                    inside = e @ axes
                    cosine = _unit(inside) @ model["centred"].T
                    best = cosine.argmax(1)
                    clear = (np.linalg.norm(inside, axis=1) >= SENTENCE_LENGTH * np.linalg.norm(e, axis=1)) & (cosine[np.arange(len(best)), best] >= SENTENCE_COSINE)
                    about[start : start + 128] = np.where(clear, areas[best], -1)
                told = about >= 0
                counts = np.bincount(of[told] * n_areas + about[told], minlength=batch.num_rows * n_areas).reshape(-1, n_areas)
                doc, area = np.nonzero((counts >= model["share"] * n_sentences[:, None]) & (counts > 0))
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc], pa.int64()), pa.array([names[k] for k in area], pa.string()), pa.array(counts[doc, area] / n_sentences[doc]), pa.array(n_sentences[doc], pa.int32())],
                    names=["doc_id", "subject", "share", "n_sentences"],
                )

    return run


_RESULT = "doc_id long, subject string, share double, n_sentences int"


def subject_areas(documents: DataFrame, areas: DataFrame, labels: DataFrame, rank: int = RANK, share: float = SHARE) -> DataFrame:
    """The subject areas of every document: ``(doc_id, subject, share, n_sentences)``.

    ``documents(doc_id, text, lang)``, ``areas(subject, description)``, ``labels(doc_id, subject)``. One row for each
    area that at least ``share`` of a document's sentences are about; documents about none, without a sentence, or with a
    null or empty text have no row. Labels count whatever their case; of labelled documents only those with a single
    area seed a centroid, and unknown areas are ignored. The language only groups the seeds, so a wrong one does little
    harm. Without labels the descriptions alone are seeds. Empty tables give no row. Repeated documents each get rows.
    """
    spark = documents.sparkSession
    ship_package(spark)
    none = spark.createDataFrame([], _RESULT)
    cores = spark.sparkContext.defaultParallelism
    rows = documents.select("doc_id", F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "^([a-z]{2})(?![a-z])", 1).alias("lang"), F.col("text").cast("binary").alias("text"))
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, "doc_id")
    cut = materialise(rows.mapInArrow(_cut, "doc_id long, lang string, terms array<string>, lens array<int>"), "p9-terms")
    n = cut.where(F.size("lens") > 0).count()
    names = sorted({r["subject"] for r in areas.where("subject is not null").select("subject").distinct().collect()})
    if not n or not names:
        return none
    df = materialise(cut.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count(), "p9-df")
    own = df.where(F.col("count") >= MIN_DF).orderBy(F.desc("count"), "term").limit(TERMS)
    used = sorted(own.collect(), key=lambda r: r["term"])
    terms = [r["term"] for r in used]
    pooled = df.join(F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}), "term string")), "term", "left_anti")
    pooled = {r["slot"]: r["n"] for r in pooled.groupBy(F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(SHARED)).alias("slot")).agg(F.sum("count").alias("n")).collect()}
    counts = [r["count"] for r in used] + [pooled.get(i, n) for i in range(SHARED)]
    idf = np.array([math.log(n / c) if c < n else 1e-3 for c in counts], np.float32)
    share_out = spark.sparkContext.broadcast
    vocabulary = share_out((terms, idf))
    indexed = cut.mapInArrow(_index(vocabulary), _INDEXED)
    own = labels.select("doc_id", F.lower(F.trim("subject")).alias("area")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("area").alias("area")).where("n = 1").drop("n")
    indexed = materialise(indexed.join(own, "doc_id", "left").select("doc_id", "lang", "terms", "lens", "used", "weights", "area"), "p9-index")
    vocabulary.destroy()
    discard(cut)

    spread = max(1, math.isqrt(max(1, indexed.rdd.getNumPartitions())))

    # truncated SVD by subspace iteration
    rank = min(rank, len(idf))
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((len(idf), rank)))[0].astype(np.float32)
    for _ in range(POWER_PASSES):
        basis = np.linalg.qr(_summed(indexed.select("used", "weights"), _add_power, (len(idf), rank), spread, share_out({"basis": basis})))[0].astype(np.float32)
    model = {"basis": basis}
    vectors = share_out(model)
    embedded = materialise(indexed.select("doc_id", "lang", "area", "used", "weights").mapInArrow(_embed(vectors), "doc_id long, lang string, area string, vector binary"), "p9-vectors")
    vectors.destroy()

    # seeds
    lower = {s.lower().strip(): i for i, s in enumerate(names)}
    spoken = {r["lang"]: r["count"] for r in embedded.where("area is not null").groupBy("lang").count().collect()}
    languages = sorted(x for x in spoken if x) or [""]
    slots = spark.createDataFrame([(a, s, i * len(languages) + j) for a, i in lower.items() for j, s in enumerate(languages)], T.StructType([T.StructField("area", T.StringType()), T.StructField("slot_lang", T.StringType()), T.StructField("seed", T.IntegerType())]))
    lang = F.lit("") if languages == [""] else F.col("lang")
    seeded = embedded.where("area is not null").withColumn("slot_lang", lang).join(F.broadcast(slots), ["area", "slot_lang"]).select("vector", "seed")
    size = (len(names) * len(languages), rank)
    centroids = _summed(seeded, _add_seeds, size, spread, share_out({}))
    described = languages.index("en") if "en" in languages else 0
    slot, read = {t: i for i, t in enumerate(terms)}, Sentences()
    for r in areas.where("subject is not null").collect():
        known = np.array([slot[w] for w in read.terms(f"{r['subject']} {r['description'] or ''}") if w in slot], int)
        if len(known):
            at, own, weight = _weighted(known, np.zeros(len(known), int), 1, idf)
            centroids[names.index(r["subject"]) * len(languages) + described] += _unit(_embedded(own, at, weight, 1, basis))[0]
    alive = np.flatnonzero(np.linalg.norm(centroids, axis=1) > 0)
    if not len(alive):
        return none
    centroids = _unit(centroids[alive])
    seeds = centroids.copy()

    # refinement, and centroids of no area
    area, language = alive // len(languages), alive % len(languages)

    def refine() -> None:
        for _ in range(REFINE_PASSES):
            sums = _summed(embedded.select("vector"), _add_nearest, centroids.shape, spread, share_out({"centroids": centroids}))
            moved = np.linalg.norm(sums, axis=1) > 0
            centroids[moved] = _unit(sums[moved])

    for _ in range(OUTSIDE_PASSES):
        sums = _summed(embedded.select("vector"), _add_outside, (len(languages), rank), spread, share_out({"centroids": centroids, "axes": _axes(centroids), "language": language}))
        new = np.flatnonzero(np.linalg.norm(sums, axis=1) > 2)
        centroids = np.vstack([centroids, _unit(sums[new])])
        area, language = np.concatenate([area, np.full(len(new), -1)]), np.concatenate([language, new])
        refine()

    # what the centroids of a language have in common is no subject
    centred = centroids.copy()
    for j in set(language):
        same = language == j
        if (same & (area >= 0)).sum() > 1:
            centred[same] -= centroids[same & (area >= 0)].mean(0)
    centred = _unit(centred)
    # the few seeds of a rare language do not tell what is common to it, but its documents do
    rare = [j for j, x in enumerate(languages) if x and spoken[x] < RARE * sum(spoken.values())]
    if rare:
        places = spark.createDataFrame([(languages[j], i) for i, j in enumerate(rare)], "lang string, seed int")
        sums = _summed(embedded.join(F.broadcast(places), "lang").select("vector", "seed"), _add_seeds, (len(rare), rank), spread, share_out({}))
        for j, mean in zip(rare, _unit(sums), strict=True):
            for k in np.flatnonzero(language == j):
                own = seeds[k] if area[k] >= 0 else centroids[k]
                left = own - (own @ mean) * mean
                centred[k] = _unit(left) if np.linalg.norm(left) >= DISTINCT else 0
    discard(embedded)
    axes = _axes(centred)
    final = {"idf": idf, "basis": basis, "axes": axes, "centred": (centred @ axes).astype(np.float32), "areas": area, "names": names, "share": share}
    return indexed.select("doc_id", "lang", "terms", "lens").mapInArrow(_assign(share_out(final)), _RESULT)


def composition(assigned: DataFrame, n_documents: int) -> DataFrame:
    """The share of each subject in the corpus: ``(subject, n_docs, doc_share)``."""
    return assigned.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("doc_share", F.round(F.col("n_docs") / F.lit(max(1, n_documents)), 6))
