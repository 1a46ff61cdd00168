"""Periodic runs against a brute force that tries every period at every place."""

import hashlib
import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import periodic_runs as pr
from lodestone.llm import queries


def brute(s, least=24, periods=3):
    """Maximal stretches by comparing every word with the one q places on, for every q."""
    n, found = len(s), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _random(seed):
    r, s = random.Random(seed), []
    while len(s) < r.randint(1, 400):
        p = [r.randint(0, r.choice([1, 2, 9])) for _ in range(r.choice([1, 2, 3, 7, 8, 9, 13, 30]))]
        s += (p * r.randint(1, 12))[: r.randint(1, 160)]
    return s


def test_k_is_the_least_overlap():
    assert pr.least_overlap() == 16 == min(max(24, 3 * q) - q for q in range(1, 1000))


def test_search_finds_every_run():
    seen = 0
    for seed in range(400):
        s = _random(seed)
        want = brute(s)
        seen += len(want)
        assert pr.repetitions(s) == want, seed
    assert seen > 300


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_search_on_two_words(s):
    assert pr.repetitions(s, 6, 3) == brute(s, 6, 3)


def test_masked_search_is_the_plain_one():
    for seed in range(200):
        docs = [_random(1000 * seed + k) for k in range(3)]
        ids, of = np.array(sum(docs, [])), np.repeat(np.arange(3), [len(d) for d in docs])
        mask, at = pr.covered(ids, of, pr.least_overlap()), 0
        for d in docs:
            want = sorted(brute(d), key=lambda r: (r[0], r[2]))
            assert pr.runs_of(ids[at : at + len(d)], mask[at : at + len(d)]) == want
            at += len(d)


def test_a_word_outside_repeated_grams_is_masked():
    s = list(range(100)) + [7] * 30 + list(range(200, 240))
    mask = pr.covered(np.array(s), np.zeros(len(s), int), 16)
    assert mask.nonzero()[0].tolist() == list(range(100, 130))


def _digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tiled(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.queries()["op13_periodic_runs"](spark, sf).collect()}
    rows, runs_seen = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), 0
    assert len(got) == len(rows)
    for doc in rows:
        words = _tiled([w.decode() for w in (doc.text or "").encode().split()], doc.doc_id)
        runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        row = got[doc.doc_id]
        runs_seen += len(runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        assert (row.n_runs, row.runs_sha256) == (len(runs), _digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)))
        assert row.collapsed_sha256 == _digest(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert runs_seen > 5


def test_nulls_repeats_ties_and_clashing_columns(spark):
    twice = "x y " * 13 + "cut here " + "u v " * 13
    rows = [(1, None, "r"), (2, "", "r"), (3, "\n \t", "r"), (None, "a " * 24, "r"), (4, "a " * 23, "r"), (5, twice, "r"), (5, twice, "r"), (6, "é ü " * 12 + "é", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(pr.find(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got] == [(1, 0, *[None] * 4), (2, 0, *[None] * 4), (3, 0, *[None] * 4), (4, 0, *[None] * 4), (5, 2, 0, 26, 2, 13000), (5, 2, 0, 26, 2, 13000), (6, 1, 0, 25, 2, 12500), (None, 1, 0, 24, 1, 24000)]
    assert [r.collapsed for r in got[4:]] == ["x y cut here u v"] * 2 + ["é ü", "a"]
    assert got[0].collapsed == "" and pr.find(docs.limit(0)).count() == 0


def test_very_long_texts_in_linear_time(spark):
    took = []
    for n in (40_000, 80_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{k % 5000}" for k in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        row = pr.find(docs).collect()[0]
        took.append(time.perf_counter() - began)
        assert (row.n_runs, row.start, row.length, row.period) == (1, 0, n, 5000)
        assert len(row.collapsed.split()) == 5000
    assert took[1] < 4 * took[0] + 1
