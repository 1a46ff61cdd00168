"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document becomes a few dozen numbers, all taken from its whole text: shares
of character classes, word and line statistics, repetition. Trees are grown
level by level from histograms of quantile bins and kept as perfect binary
trees in flat arrays, so that a batch of documents walks all trees with numpy
indexing and no branching. Scores come from the text alone; labels, lang,
source and doc_id are never inputs.

The model is fitted on at most ``MAX_TRAIN`` labelled rows (a bounded sample in
the order of a hash of doc_id; the bound is a parameter), never on held-out
ones: rows whose crc32(doc_id as text) mod 4 is 2. Scoring is one map over all
documents: nothing is shuffled, nothing but the sample's numbers reaches the
driver.

Defined results: a null text counts as empty and is scored like any text; a
null doc_id is not held out; several labels of one doc_id count by their
majority, ties as 1, and of several texts of a labelled doc_id the smallest is
learnt from, so the model is the same in every run; without any label every score is 0.5; repeated rows give
repeated rows; an empty table gives an empty table; further columns are ignored
by ``scores`` and pass through ``keep``.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 8
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)  # 0 others
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[list(range(128, 256))] = 6
_CLASS[ord("!")] = 7
_CLASS[ord("|")] = 8

FEATURES = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "mark", "high", "shout", "bar", "other", "entropy", "top_byte",
    "mean_word", "sd_word", "max_word", "one_letter", "distinct_words", "distinct_pairs", "same_next", "longest_same", "top_word",
    "log_lines", "mean_line", "distinct_lines", "blank_lines", "odd_ends", "titled", "shouted",
)


def features(text: str) -> list[float]:
    """The numbers of one text, in the order of FEATURES."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words, lines = text.split(), text.split("\n")
    n, m = len(raw), len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    counts = np.bincount(raw, minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=9) / n
    p = counts[counts > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, m)
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    for s in same if any(same) else ():
        run = run + 1 if s else 0
        longest = max(longest, run)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(n)), float(np.log1p(m)), share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[0],
        float(-(p * np.log2(p)).sum()), float(counts.max() / n),
        float(sizes.mean()), float(sizes.std()), float(sizes.max()), float((sizes == 1).mean()),
        len(seen) / m, pairs / max(1, m - 1), sum(same) / max(1, m - 1), longest / m, max(seen.values()) / m,
        float(np.log1p(len(lines))), n / len(lines), len(set(lines)) / len(lines), sum(not x.strip() for x in lines) / len(lines),
        sum(w[-1] in "#&$*%!|^~" for w in words) / m, sum(map(str.istitle, words)) / m, sum(map(str.isupper, words)) / m,
    ]


def matrix(texts) -> np.ndarray:
    rows = [features(t or "") for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


class Forest:
    """Perfect binary trees in flat arrays; ``feature`` and ``threshold`` by inner node, ``value`` by leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (value.shape[0] - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost ``trees`` trees on logistic loss."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        prior = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Forest(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    margin, grown = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            node = at - first
            best = np.full(width, 1e-6)
            split = np.full((width, 2), -1)
            for f in range(len(edges)):
                if not len(edges[f]):
                    continue
                key = node * BINS + binned[f]
                hg, hh, hn = (np.bincount(key, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, np.ones(len(y))))
                tg, th, tn = hg[:, -1:], hh[:, -1:], hn[:, -1:]
                gain = hg**2 / (hh + RIDGE) + (tg - hg) ** 2 / (th - hh + RIDGE) - tg**2 / (th + RIDGE)
                gain = np.where((hn >= LEAST_ROWS) & (tn - hn >= LEAST_ROWS), gain, 0.0)[:, : len(edges[f])]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                split[better] = np.stack([np.full(width, f), top], 1)[better]
            for k in np.flatnonzero(split[:, 0] >= 0):
                f, b = split[k]
                feature[first + k], threshold[first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + RIDGE)
        margin += value[leaf]
        for held, made in zip(grown, (feature, threshold, value)):
            held.append(made)
    return Forest(base, *map(np.stack, grown))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """A forest from at most ``max_train`` labelled documents that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.avg("quality") >= 0.5).cast("int").alias("__label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    # At most max_train rows of two numbers: small enough for every executor, whatever the corpus.
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "__id").groupBy("__id", "__label").agg(F.min("text").alias("text"))
    numbers = arrow_udf(_rows_of_features, "array<double>")
    found = rows.select("__id", "__label", numbers(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("x")).toArrow().sort_by("__id")
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(found.num_rows, len(FEATURES))
    return fit(x, np.array(found.column("__label").to_pylist(), np.float64))


def _rows_of_features(text: pa.Array) -> pa.Array:
    return pa.array(list(matrix(text.to_pylist())), pa.list_(pa.float64()))


def score_column(forest: Forest, text: Column) -> Column:
    """The score of a text, 0 to 1, higher: better quality likelier."""

    def scored(texts: pa.Array) -> pa.Array:
        out = [forest.scores(matrix(texts.slice(k, 1024).to_pylist())) for k in range(0, len(texts), 1024)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return arrow_udf(scored, "double")(F.coalesce(text.cast("string"), F.lit("")))


def scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    forest = train(docs, labels, max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score_column(forest, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    forest = train(docs, labels, max_train)
    rows = docs.select(F.struct("*").alias("__row"), score_column(forest, F.col("text")).alias("__score"))
    return rows.where(F.col("__score") >= threshold).select("__row.*")
