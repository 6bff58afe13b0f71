"""Encoding of whole texts with a public byte-level BPE tokenizer.

The distinct words of a batch are walked as a trie, depth first in byte order. The state of a node is the last token of
the encoding of the path to it; a byte further, the last token is the one suffix token that can stand beside the last
token before it. States of shared prefixes are computed once, in time linear in the length, and a word's ids are read
back along the last tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import ship_package

#: Where the vocabulary lies; read by the driver, broadcast to the executors (under 1 MB).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets its words, or its pairs, when it holds so many.
MEMORY = 400_000


class TrieEncoder:
    """Encodes words given as bytes; ``ranks`` maps each token's bytes to its id, lower ids being merged first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._left: dict[bytes, list] = {}
        self._right: dict[bytes, list] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self.states = 0

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens of whose merge ``token`` is made; None for a byte, or a token no merge makes."""
        if token not in self._parts:
            own, found = self.ranks[token], None
            for i in range(1, len(token)):
                a, b = token[:i], token[i:]
                if self.ranks.get(a, own) < own and self.ranks.get(b, own) < own and self.stand(a, b, own):
                    found = a, b
                    break
            self._parts[token] = found
        return self._parts[token]

    def _edge(self, token: bytes, side: int) -> list[bytes]:
        """The tokens at one end of ``token`` while it grows, from the byte to the whole."""
        kept = self._right if side else self._left
        if token not in kept:
            chain, now = [token], token
            while len(now) > 1 and (two := self.parts(now)):
                now = two[side]
                chain.append(now)
            kept[token] = chain[::-1]
        return kept[token]

    def stand(self, a: bytes, b: bytes, before: int | None = None) -> bool:
        """Whether no merge crosses the border while ``a`` and ``b`` grow side by side (and, up to rank ``before``)."""
        ranks, never = self.ranks, 1 << 60
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            next_a = ranks[left[i + 1]] if i + 1 < len(left) else never
            next_b = ranks[right[j + 1]] if j + 1 < len(right) else never
            across = ranks.get(left[i] + right[j])
            # of equal ranks the leftmost pair is merged first
            if across is not None and across < next_a and across <= next_b:
                return before is not None and across == before and next_a == next_b == never
            if next_a == next_b == never:
                return before is None
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def fits(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        ok = self._fits.get(key)
        if ok is None:
            if len(self._fits) > 4 * MEMORY:
                self._fits.clear()
            ok = self._fits[key] = self.stand(a, b)
        return ok

    def encode_words(self, words: Iterator[bytes]) -> dict[bytes, list[int]]:
        """The ids of each distinct word, by one walk of their trie."""
        out: dict[bytes, list[int]] = {}
        ranks, before, last = self.ranks, b"", [b""]  # last[i]: the last token of the encoding of the first i bytes
        for word in sorted(set(words)):
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                low, high = 0, most  # the first byte that differs, by halving
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if word[:middle] == before[:middle] else (low, middle)
                shared = low
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                self.states += 1
                for start in range(max(0, end - self.longest), end):
                    token = word[start:end]
                    if token in ranks and (start == 0 or self.fits(last[start], token)):
                        break
                last.append(token)
            ids, end = [], len(word)
            while end:
                ids.append(ranks[last[end]])
                end -= len(last[end])
            out[word] = ids[::-1]
            before = word
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


_ENCODERS: dict[int, tuple] = {}


class TextEncoder:
    """Encodes texts word by word, remembering the words of former batches."""

    def __init__(self, raw: bytes):
        import regex

        self.words, self.trie, self.known = regex.compile(PATTERN).findall, TrieEncoder(read_ranks(raw)), {}

    def batch(self, texts: list[bytes | None]) -> list[list[int]]:
        """The ids of each text. Null and empty texts have none; bytes that are no UTF-8 count as U+FFFD."""
        cut = [[w.encode("utf-8", "surrogatepass") for w in self.words(t.decode("utf-8", "replace"))] if t else () for t in texts]
        known = self.known
        new = {w for words in cut for w in words if w not in known}
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = {w for words in cut for w in words}
        known.update(self.trie.encode_words(new))
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out


def _encoder(shared) -> TextEncoder:
    """One encoder for each Python worker and vocabulary."""
    raw = shared.value
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(raw)
    return _ENCODERS[key]


def _bites(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most about ``most`` bytes of text, so that long texts do not fill the memory together."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _run(shared, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute  # noqa: F401

        encoder = _encoder(shared)
        for whole in batches:
            for batch in _bites(whole):
                ids = encoder.batch(batch.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if counts_only:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=["doc_id", "n_tokens"])
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return run


def _prepared(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id and text bytes, over at least as many partitions as there are cores (a small table may be one partition)."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "doc_id") if rows.rdd.getNumPartitions() < cores else rows


def _shared(documents: DataFrame, tokenizer: str):
    ship_package(documents.sparkSession)
    with open(tokenizer, "rb") as file:
        return documents.sparkSession.sparkContext.broadcast(file.read())


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The token ids of every text, without special tokens: ``(doc_id, ids ARRAY<INT>)``.

    Null and empty texts give an empty list; blank texts are encoded as they stand; strings that look like special
    tokens are ordinary text. One row for each row of ``documents``, repeated ones too, in one pass without a shuffle.
    """
    return _prepared(documents, doc_id, text).mapInArrow(_run(_shared(documents, tokenizer), False), "doc_id long, ids array<int>")


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in read_ranks(shared.value).items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The texts of ``(doc_id, ids)``: ``(doc_id, text)``; an empty or null list gives an empty text."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoded(_shared(encoded, tokenizer)), "doc_id long, text string")


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The number of tokens of every text: ``(doc_id, n_tokens LONG)``; 0 for null and empty texts."""
    return _prepared(documents, doc_id, text).mapInArrow(_run(_shared(documents, tokenizer), True), "doc_id long, n_tokens long")
