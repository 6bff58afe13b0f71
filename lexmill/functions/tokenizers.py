"""Tokenizers as column expressions, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The stop words of the naive tokenizer.
NAIVE_STOP = "the a an and or is are of to in for on with as by at".split()

# The English stop words of the index tokenizer (public word list, alphanumeric members).
ENGLISH_STOP = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn
wasn weren won wouldn
""".split()


def naive(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, stop words left out; order and repeats stay. Null gives ``[]``."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: ~w.isin(*NAIVE_STOP))


def word(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased, filtered as the index needs it. Null gives ``[]``.

    Left out: words over 50 characters, words of one distinct character, numbers over 10 digits, stop words, and words
    over 20 characters with fewer distinct characters than 0.3 of their length.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)

    def kept(w: Column) -> Column:
        size, distinct = F.length(w), F.size(F.array_distinct(F.split(w, "")))
        return (size <= 50) & ((size <= 20) | (distinct >= 0.3 * size)) & ~w.rlike(r"^(.)\1*$") & ~(w.rlike(r"^\p{Nd}+$") & (size > 10)) & ~w.isin(*ENGLISH_STOP)

    return F.filter(words, kept)


#: Encoders by vocabulary, one for each Python worker.
_CODERS: dict[int, object] = {}


def _coder(raw: bytes):
    """The encoder of a ``.tiktoken`` vocabulary, built once in each worker."""
    import base64

    import tiktoken

    key = hash(raw)
    if key not in _CODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _CODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[key]


def gpt(text: Column, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> Column:
    """Sub-word tokens of a public byte-level BPE vocabulary, decoded one by one, the blank ones left out.

    The driver reads the vocabulary and broadcasts it (under 1 MB), so the executors need no file.
    """
    with open(vocabulary, "rb") as file:
        shared = SparkSession.active().sparkContext.broadcast(file.read())

    @F.pandas_udf("array<string>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from lexmill.functions.tokenizers import _coder

        coder = _coder(shared.value)
        known: dict[int, str] = {}
        for batch in batches:
            out = []
            for ids in coder.encode_ordinary_batch([v or "" for v in batch], num_threads=1):
                for i in set(ids).difference(known):
                    known[i] = coder.decode([i])
                out.append([t for t in map(known.__getitem__, ids) if t.strip()])
            yield pd.Series(out, dtype=object)

    return tokens(text)


def nltk(text: Column) -> Column:
    """The word tokenizer of the nltk library, where it is installed, with the filters of :func:`word`."""

    @F.pandas_udf("array<string>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from nltk.tokenize import word_tokenize

        stop = frozenset(ENGLISH_STOP)

        def kept(t: str) -> bool:
            distinct = len(set(t))
            return len(t) <= 50 and distinct > 1 and not (t.isdigit() and len(t) > 10) and t.isalnum() and t not in stop and not (len(t) > 20 and distinct < 0.3 * len(t))

        for batch in batches:
            yield batch.map(lambda v: [t for t in word_tokenize(v.lower()) if kept(t)] if v else [])

    return tokens(text)


REGISTRY: dict[str, Callable[[Column], Column]] = {"naive": naive, "word": word, "gpt": gpt, "nltk": nltk}


def tokenizer(name: str) -> Callable[[Column], Column]:
    """The tokenizer of this name; unknown names raise ``ValueError``, ``nltk`` without its library ``ImportError``."""
    if name not in REGISTRY:
        raise ValueError(f"unknown tokenizer {name!r}, not one of {sorted(REGISTRY)}")
    if name == "nltk":
        import nltk as _  # noqa: F401
    return REGISTRY[name]
