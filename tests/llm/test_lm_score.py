"""LM scores: counts and base score against plain Python; the coding and the mixing against a walk bit by bit."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import lm_score as lm
from lodestone.llm.packing import squeeze

MASK = (1 << 64) - 1
LONG = "one two three four five six seven eight nine ten " * 30
SCHEMA = "doc_id long, text string, score string, n int"


def plain(rows):
    """The contract's counts and base score."""
    docs = [(i, ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if w] + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, words in docs for w in words if not held(i))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held(i), len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 6)) for i, words in docs)


def _got(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 300, "bucket_words": 10}])
def test_counts_and_base_score(spark, sizes):
    rows = [(k, f"the The {k % 5} é{k} NBSP word\x0bend {'x y z ' * (k % 4)}") for k in range(60)] + [(60, None), (61, ""), (62, " \t\n"), (9, LONG), (9, LONG), (None, "no id here")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    got = lm.scores(docs, **sizes)
    assert _got(got) == plain(rows)
    assert all(r.score <= 0 and r.bits_per_byte >= 0 for r in got.collect())


def test_empty_table_and_no_training_text(spark):
    docs = spark.createDataFrame([(k, "some words", "s", 1) for k in range(100)], SCHEMA)
    assert lm.scores(docs.limit(0)).count() == 0
    held = [(k, "a b") for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2]
    got = lm.scores(spark.createDataFrame([(*r, "s", 1) for r in held], SCHEMA))
    assert _got(got) == plain(held) and all(r.base_score == 0 and r.score < 0 for r in got.collect())


def test_codes_are_prefix_free_and_short():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 700):
        weights = np.sort(r.zipf(1.3, n).clip(0, 10**9)).astype(np.int64)
        codes, lens = lm.huffman(weights)
        texts = [format(int(c), f"0{k}b") if k else "" for c, k in zip(codes, lens)]
        assert not any(b.startswith(a) for a, b in zip(sorted(texts), sorted(texts)[1:]))
        if n > 1:
            assert sum(2.0**-k for k in lens) == 1
            p = weights / weights.sum()
            assert -(p * np.log2(p)).sum() <= (p * lens).sum() < 1 - (p * np.log2(p)).sum()


def _mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def _chunk():
    """A chunk made by hand: known words have a code, the others none."""
    words = [b"the", b"cat", b"sat", lm.END, b"zq", "é".encode()]
    counts, lens = [50, 20, 10, 30, 1, 0], [4, 14, 22, 3, 0, 0]
    codes = [0b1011, 0b10110011100011, 0b1111000011110000110011, 0b110, 0, 0]
    texts = [[0, 1, 2, 3], [4, 0, 5, 1, 3], [3], [0, 1] * 40 + [2, 4, 3]]
    import zstandard

    row = {"digests": bytes(64), "rest": squeeze(np.array([1, 0, 2, 1], np.uint64)), "learn": squeeze(np.array([0, 1, 0, 0], np.uint64)), "sizes": squeeze(np.array([len(t) for t in texts], np.uint64)), "places": squeeze(np.array(sum(texts, []), np.uint64)), "words": zstandard.compress(b"\n".join(words)), "counts": squeeze(np.array(counts, np.uint64)), "codes": squeeze(np.array(codes, np.uint64)), "lens": squeeze(np.array(lens, np.uint64))}
    letters = lm.huffman(np.array([1 + k % 7 for k in range(257)]))
    return lm.Coded(row, letters), words, codes, lens, texts, letters


def _walk(words, codes, lens, text, letters):
    """(token, bit, kind, depth, slots) of one text, bit by bit with plain integers."""
    m1 = 0x9E3779B97F4A7C15
    for t, w in enumerate(text):
        ctx = []
        for k in range(lm.ORDERS):
            key = k + 3
            for back in range(1, k + 2):
                b = text[t - back] if t >= back else None
                own = lm.END if b is None else words[b] if lens[b] and lens[b] <= lm.FREQUENT[k] else None
                name = sum((c + 1) * m1**i for i, c in enumerate(own)) if own else words[b][-1] + 256 * (words[b][-2] if len(words[b]) > 1 else 0)
                key = (key * m1 + _mix(name & MASK)) & MASK
            ctx.append(_mix(key) & 0xFFFFFFFF)
        symbols = [(codes[w], lens[w], 1, ctx)] if lens[w] else [(0, 1, 1, ctx)]
        if not lens[w]:
            spelled = [*words[w], 256]
            for at, c in enumerate(spelled):
                key, own = 7, []
                for k in range(1, lm.LETTERS[-1] + 1):
                    key = (key * 521 + (spelled[at - k] if at >= k else 300)) & 0xFFFFFFFF
                    own += [(key ^ (key >> 15)) * 0x85EBCA6B & 0xFFFFFFFF] if k in lm.LETTERS else []
                symbols.append((int(letters[0][c]), int(letters[1][c]), 2, own))
        for code, size, kind, own in symbols:
            for depth in range(min(size, lm.DEEP)):
                node = ((1 << depth) | (code >> (size - depth))) * 0x85EBCA6B & 0xFFFFFFFF
                slots = [(((c ^ node) * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - lm.SLOT_BITS) for c in own]
                yield t, (code >> (size - depth - 1)) & 1, kind if kind == 2 or depth else 0, depth, slots


def test_decisions_are_those_of_a_walk():
    coded, words, codes, lens, texts, letters = _chunk()
    for n, text in enumerate(texts):
        at = coded.starts[n] + np.arange(len(text))
        token, bit, kind, depth, slots = coded.decisions(at, np.full(len(text), n))
        assert [coded.plain[w] for w in text] == [max(lens[w] - lm.DEEP, 0) + (0 if lens[w] else sum(max(int(letters[1][c]) - lm.DEEP, 0) for c in [*words[w], 256])) for w in text]
        got = list(zip(token.tolist(), bit.tolist(), kind.tolist(), depth.tolist(), zip(*(s.tolist() for s in slots))))
        assert got == [(*x[:4], tuple(x[4])) for x in _walk(words, codes, lens, text, letters)]


def test_scores_are_those_of_a_walk():
    coded, words, codes, lens, texts, letters = _chunk()
    r = np.random.default_rng(3)
    tables = r.integers(0, 256, (lm.ORDERS, 1 << lm.SLOT_BITS)).astype(np.uint8)
    weights, apm = r.normal(0.3, 0.1, (lm.ORDERS + 1, lm.GATES)).astype(np.float32), r.uniform(0.1, 0.9, lm.APM_ROWS * lm.APM_CELLS).astype(np.float32)
    total = np.zeros(len(texts))
    lm._score_texts(lm.Mixer(tables, weights, apm), coded, np.argsort(-coded.sizes), total)
    for n, text in enumerate(texts):
        change, want, pushed, seen, edges = [0.0] * 3, 0.0, [0.0] * 3, 0, list(lm.EDGES)
        for t, bit, kind, depth, slots in _walk(words, codes, lens, text, letters):
            if t >= edges[1]:
                change = [c + lm.OWN_RATE * p / (seen + 64) for c, p in zip(change, pushed)]
                pushed, seen = [0.0] * 3, 0
                edges.pop(0)
            held = [int(tables[k][s]) for k, s in enumerate(slots)]
            gate = (kind * 4 + held[0] % 4) * 4 + held[1] % 4
            x = [((h >> 2) - 32) / 4 for h in held] + [1.0]
            z = max(-11.5, min(11.5, sum((weights[k][gate] + change[k]) * x[k] for k in range(3))))
            p = 1 / (1 + math.exp(-z))
            refined = (p + apm[(kind * 8 + min(depth, 7)) * lm.APM_CELLS + int(2 * z + 24)]) / 2
            want += math.log(refined if bit else 1 - refined)
            pushed, seen = [a + (bit - p) * b for a, b in zip(pushed, x)], seen + 1
        assert total[n] == pytest.approx(want, rel=1e-3), n


def test_equal_texts_count_as_often_as_they_stand(spark):
    rows = [(k, "rare copy of one text" if k % 3 else f"other text {k}", "s", 1) for k in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in lm.scores(docs.repartition(5), chunk_bytes=100).collect()}
    assert len(got) == 80 and len({round(r.score, 9) for r in got.values() if r.doc_id % 3}) == 1
    assert got[1].score > got[3].score


def test_held_out_texts_are_told_better_than_by_counts(spark):
    df = lm.scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    held = df[df.held_out]
    assert len(df) == 10_000 and held.score.sum() > held.base_score.sum()
    assert df.score.sum() > df.base_score.sum() * 0.92


def test_very_long_text(spark):
    text = " ".join(f"w{k * k % 977} v{k % 13}" for k in range(60_000))
    rows = [(k, text if k == 1 else "short text", "s", 1) for k in range(5)]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_tokens == 120_001 and got[1].score < got[0].score < 0
