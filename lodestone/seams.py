"""Seams for models that need weights or a network, each with a deterministic default."""

from __future__ import annotations

import bisect
import random
import re
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from lodestone.functions import rules
from lodestone.functions.text import sentences_of, tokens_for_match


class Embedder(Protocol):
    def column(self, text: Column) -> Column:
        """A vector (array of double) of a text."""

    def one(self, text: str) -> list[float]:
        """The vector of one query."""


class HashingEmbedder:
    """Unit vectors of hashed words, in Arrow batches."""

    def __init__(self, size: int = 64):
        self.size = size

    def one(self, text: str) -> list[float]:
        out = np.zeros(self.size)
        for w in (text or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            out[h % self.size] += 1.0 if h >> 63 else -1.0
        length = float(np.sqrt((out**2).sum()))
        return (out / length if length else out).tolist()

    def column(self, text: Column) -> Column:
        return arrow_udf(lambda t: pa.array([self.one(x) for x in t.to_pylist()], pa.list_(pa.float64())), "array<double>")(text)


class LetterEmbedder:
    """Unit vectors of letter counts a to z, in Arrow batches: the bytes of a text are counted once, not once a letter."""

    letters = "abcdefghijklmnopqrstuvwxyz"

    def one(self, text: str) -> list[float]:
        out = np.array([(text or "").lower().count(c) for c in self.letters], float)
        size = float(np.sqrt((out**2).sum()))
        return (out / size if size else out).tolist()

    def column(self, text: Column) -> Column:
        first = ord(self.letters[0])

        def vectors_of(texts: pa.Array) -> pa.Array:
            # Bytes of a to z stand in no other character of UTF-8.
            counts = np.array([np.bincount(np.frombuffer(t.as_buffer(), np.uint8), minlength=256)[first : first + len(self.letters)] for t in texts], float).reshape(-1, len(self.letters))
            size = np.sqrt((counts**2).sum(1, keepdims=True))
            flat = np.divide(counts, size, out=np.zeros_like(counts), where=size > 0).ravel()
            return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(self.letters), pa.array(flat, pa.float64()))

        return arrow_udf(vectors_of, "array<double>")(F.lower(F.coalesce(text, F.lit(""))))


class TokenCounter(Protocol):
    def column(self, text: Column) -> Column: ...


class QuarterCounter:
    """Tokens as a quarter of the characters, rounded up: a built-in expression."""

    def column(self, text: Column) -> Column:
        return F.ceil(F.length(text) / 4).cast("long")


class BpeCounter:
    """Tokens by a BPE vocabulary file of the tokenizers library, in Arrow batches; a null text has none."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = file.read()

    def column(self, text: Column) -> Column:
        spec = self.spec
        made: list = []  # one tokenizer a worker and query

        def count(texts: pa.Array) -> pa.Array:
            if not made:
                from tokenizers import Tokenizer

                made.append(Tokenizer.from_str(spec))
                made[0].no_truncation()
                made[0].no_padding()
            rows = texts.to_pylist()
            out = []
            for k in range(0, len(rows), 256):
                out += [len(x.ids) for x in made[0].encode_batch([t or "" for t in rows[k : k + 256]], add_special_tokens=False)]
            return pa.array(out, pa.int64())

        return arrow_udf(count, "long")(text)


class CachedEmbedder:
    """Another embedder, asked once for each distinct text of a batch, and once for each query."""

    def __init__(self, inner: Embedder, most: int = 1000):
        self.inner, self.most, self.known = inner, most, {}

    def one(self, text: str) -> list[float]:
        if text not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[text] = self.inner.one(text)
        return self.known[text]

    def column(self, text: Column) -> Column:
        inner = self.inner

        def vectors(texts: pa.Array) -> pa.Array:
            rows = texts.to_pylist()
            made = {t: inner.one(t) for t in dict.fromkeys(rows)}
            return pa.array([made[t] for t in rows], pa.list_(pa.float64()))

        return arrow_udf(vectors, "array<double>")(text)


class Generator(Protocol):
    def answer(self, query: str | Column, context: Column) -> Column:
        """An answer to one question, or to each of a column of them."""


class ExtractiveGenerator:
    """The first sentences of the context, without its source tags: no model, no network."""

    def __init__(self, sentences: int = 3):
        self.sentences = sentences

    def answer(self, query: str | Column, context: Column) -> Column:
        bare = F.regexp_replace(context, "\\[SOURCE filename=.*?; chunk_id=.*?\\]\n?", "")
        return F.array_join(F.slice(sentences_of(bare), 1, self.sentences), " ")


def expand_query(query: str, table: dict[str, str]) -> str:
    """The query unchanged, and at its end the expansions of the abbreviations it holds, each once: no model."""
    low = {k.lower(): v for k, v in table.items()}
    found = dict.fromkeys(low[w] for w in re.findall(r"[a-z0-9]+", query.lower()) if w in low)
    more = [x for x in found if x.lower() not in query.lower()]
    return " ".join([query, *more])


def fact_check(answer: Column, context: Column, least: float = 0.6) -> Column:
    """supported and unsupported sentences of an answer, and whether all are supported.

    A sentence is supported if a share of ``least`` of its distinct match tokens is in the context; one without tokens is.
    """
    held = tokens_for_match(F.regexp_replace(context, "\\[SOURCE filename=.*?; chunk_id=.*?\\]", " "))
    own = lambda s: F.array_distinct(tokens_for_match(s))
    good = lambda s: F.size(F.array_intersect(own(s), held)) >= F.lit(least) * F.size(own(s))
    said, bad = sentences_of(answer), lambda s: ~good(s)
    return F.struct(F.filter(said, good).alias("supported"), F.filter(said, bad).alias("unsupported"), (F.size(F.filter(said, bad)) == 0).alias("accurate"))


def follow_ups(query: str, answer: Column, most: int = 3) -> Column:
    """At most ``most`` questions on the first long words of the answer that the query does not hold."""
    asked = tokens_for_match(F.lit(query))
    new = F.filter(F.array_except(tokens_for_match(answer), asked), lambda t: (F.length(t) > 5) & ~t.isin(*rules.STOP_WORDS))
    return F.transform(F.slice(new, 1, most), lambda t: F.concat(F.lit("What else is known about "), t, F.lit("?")))


Annotator = Callable[[list[str]], list[list[tuple[str, str]]]]
_ANNOTATORS: dict[str, Annotator] = {}


def register_annotator(name: str, fn: Annotator) -> None:
    """Add an entity annotator: texts to lists of (text, label)."""
    _ANNOTATORS[name] = fn


def annotate(text: Column, name: str = "rules") -> Column:
    """Entities of a text as array of (text, label), by a registered annotator, in Arrow batches."""
    fn = _ANNOTATORS[name]
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())]))
    return arrow_udf(lambda t: pa.array([[{"text": a, "label": b} for a, b in x] for x in fn(t.to_pylist())], kind), "array<struct<text:string,label:string>>")(text)


_PATTERNS = [(label, re.compile(p)) for label, p in rules.ENTITY_PATTERNS]


def rule_entities(texts: list[str]) -> list[list[tuple[str, str]]]:
    """Entities by the fixed patterns, in their order; a later one that overlaps an earlier one is dropped."""
    out = []
    for text in texts:
        taken: list[tuple[int, int]] = []  # ascending, and none overlaps another
        found = []
        for label, pattern in _PATTERNS:
            for m in pattern.finditer(text or ""):
                at = bisect.bisect_left(taken, m.span())
                if (at == 0 or taken[at - 1][1] <= m.start()) and (at == len(taken) or m.end() <= taken[at][0]):
                    taken.insert(at, m.span())
                    found.append((m[0], label))
        out.append(found)
    return out


register_annotator("rules", rule_entities)


class RateLimited(Exception):
    """What a remote model raises when it is asked too often."""


def retried(fn, tries: int = 3, wait: float = 2.0, sleep=time.sleep, jitter=random.uniform):
    """``fn`` again after growing waits, for remote models inside a seam; longer ones, and never equal, where it is asked too often."""

    def call(*args, **kwargs):
        for k in range(tries):
            try:
                return fn(*args, **kwargs)
            except Exception as e:
                if k == tries - 1:
                    raise
                sleep(10 * (k + 1) + jitter(1, 5) if isinstance(e, RateLimited) else wait * 2**k)

    return call
