"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what is left.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least max(24, 3 * q) words that no neighbouring word
extends.

Masking. The two ends of a run, without its first and without its last q words,
are the same words, and each has at least length - q of them. Over all q the
least such overlap is 16 words (``least_overlap``), so every 16-gram of either
end stands at least twice in the document, and the two ends cover the run. A
word that no repeated 16-gram of its document covers can therefore join no run.
The 16-grams of a batch of documents are hashed by a rolling hash and found
repeated by one sort; a hash that collides masks too little, never too much.

Search. The stretches of words left are searched by divide and conquer after
Main and Lorentz: at each centre the longest common extensions of every
distance come from Z arrays of the words behind and ahead, which gives all
repetitions that cross the centre in linear time. A repetition that the edge of
its block cuts off is found again, whole, at the centre of a larger block. Of
equal stretches the smallest period stays.

The search is a map over documents: nothing is shuffled, no key can be hot, and a
document's search is n log n in the words that are left.

``tiled`` makes some of the input periodic on purpose, as the query's contract
says; ``find`` takes texts as they are unless told to tile them.

Defined results: words are runs of anything but ASCII white space; a null or
empty text has none, no run, and the hashes of the empty text; a null id tiles
nothing and stays null; repeated rows give repeated rows; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a batch of documents whose k-grams are sorted together; a longer document is a batch of its own.
BATCH_WORDS = 200_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

Run = tuple[int, int, int]  # start, length, period


def least_overlap(words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> int:
    """The fewest words that a run shares with itself moved by its period: the k of the masking."""
    return min(max(words, periods * q) - q for q in range(1, words + 1))


def tiled(words: list, doc_id: int | None) -> list:
    """The words as the contract has them: every tenth document's tail (by a hash of its id) repeats with a period."""
    n, h = len(words), 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    # A tail shorter than its period stays as it is.
    period, left = words[a : a + p], n - a
    return words[:a] + (period * -(-left // len(period)))[:left]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(ids: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Which words a k-gram covers that its document has at least twice; ``of`` is the document of each word, ascending."""
    n = len(ids) - k + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    powers = np.full(len(ids), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, dtype=np.uint64, out=powers)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(_mixed(ids.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64, out=total[1:])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    gram = _mixed((total[k:] - total[:-k]) * np.cumprod(back, dtype=np.uint64)) ^ _mixed(of[:n].astype(np.uint64))
    at = np.flatnonzero(of[:n] == of[k - 1 :])
    gram = gram[at]
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int32)
    edge[at[twice]] += 1
    edge[at[twice] + k] -= 1
    return np.cumsum(edge[:-1]) > 0


def _z(s: list) -> list[int]:
    """Of every place the length of the longest stretch from there that the sequence begins with."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        m = 0
        if i < right:
            m = z[i - left]
            if m < right - i:
                z[i] = m
                continue
            m = right - i
        while i + m < n and s[m] == s[i + m]:
            m += 1
        z[i] = m
        left, right = i, i + m
    return z


def repetitions(s: list, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs of ``s``: maximal stretches of smallest period q with at least max(least, periods * q) values."""
    best: dict[tuple[int, int], int] = {}
    n = len(s)

    def crossing(lo: int, mid: int, hi: int) -> None:
        """Repetitions of ``s[lo:hi]`` across ``mid`` that no edge within ``s`` cuts off."""
        u, v = s[lo:mid], s[mid:hi]
        ahead, behind = _z(v), _z(u[::-1])  # of v in itself; of u in itself, from its end
        ahead_in_all = _z(v + [None] + u + v)  # of v, at any place of the block
        behind_in_all = _z(u[::-1] + [None] + v[::-1] + u[::-1])  # of u from its end, ending at any place
        size_u, size_v, most = len(u), len(v), (hi - lo) // periods
        for q in range(1, most + 1):
            for at_left in (True, False):
                if at_left:  # a period ends at the centre: compare mid - q with mid
                    if q > size_u:
                        continue
                    f = min(ahead_in_all[size_v + 1 + size_u - q], size_v)
                    b = behind[q] if q < size_u else 0
                    start, end = mid - q - b, mid + f
                else:  # a period begins at the centre: compare mid with mid + q
                    if q > size_v:
                        continue
                    f = ahead[q] if q < size_v else 0
                    b = min(behind_in_all[size_u + 1 + size_v - q], size_u)
                    start, end = mid - b, mid + q + f
                size = end - start
                if size < least or size < periods * q:
                    continue
                if start == lo and lo > 0 and s[lo - 1] == s[lo - 1 + q]:
                    continue
                if end == hi and hi < n and s[hi] == s[hi - q]:
                    continue
                if q < best.get((start, end), q + 1):
                    best[start, end] = q

    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= least:
            mid = (lo + hi) // 2
            crossing(lo, mid, hi)
            todo += [(lo, mid), (mid, hi)]
    return sorted((start, end - start, q) for (start, end), q in best.items())


def runs_of(ids: np.ndarray, mask: np.ndarray) -> list[Run]:
    """The runs of one document's words, searched where the mask lets them stand; by start, then period."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    out = []
    for lo, hi in edge.reshape(-1, 2).tolist():
        if hi - lo >= LEAST_WORDS:
            out += [(lo + start, length, q) for start, length, q in repetitions(ids[lo:hi].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def greatest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, compared as fractions; ties to the smallest start, then period."""
    return min(runs, key=cmp_to_key(lambda x, y: y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2]), default=None)


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs", pa.string()), ("collapsed", pa.string())])
_OUT_SQL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


def _rows(tile: bool):
    k = least_overlap()

    def searched(docs: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        index: dict[bytes, int] = defaultdict(count().__next__)
        sizes = [len(w) for _, w in docs]
        ids = np.fromiter((index[w] for _, words in docs for w in words), np.int64, sum(sizes))
        mask = covered(ids, np.repeat(np.arange(len(docs)), sizes), k)
        rows, at = [], 0
        for (doc_id, words), size in zip(docs, sizes):
            own = mask[at : at + size]
            runs = runs_of(ids[at : at + size], own) if own.any() else []
            at += size
            first = greatest(runs)
            best = (*first, 1000 * first[1] // first[2]) if first else (None,) * 4
            rows.append((doc_id, len(runs), *best, "".join(f"{a},{n},{q}\n" for a, n, q in runs), b" ".join(collapsed(words, runs)).decode("utf-8")))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8").split()
                held.append((doc_id, tiled(words, doc_id) if tile else words))
                size += len(words)
                if size >= BATCH_WORDS:
                    yield searched(held)
                    held, size = [], 0
        if held:
            yield searched(held)

    return rows


def find(docs: DataFrame, tile: bool = False) -> DataFrame:
    """Per document its number of runs, the greatest one, every run as ``start,length,period`` lines, and the collapsed text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_rows(tile), _OUT_SQL)
