"""Substring dedup against SQL and a brute-force count of windows."""

import random
import re
from collections import Counter

import pytest

from lodestone.llm import queries, substring_dedup
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def brute(rows, n):
    docs = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + n]) for _, w in docs for k in range(len(w) - n + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_query_matches_sql(spark):
    same(queries.op1_substring_dedup(spark, SF), queries.oracle_sql()["op1_substring_dedup"], SF)


@pytest.mark.parametrize("window,batches,chunk_bytes", [(35, 3, 1), (35, 1, 4_000_000), (6, 2, 300), (1, 2, 300), (3, 6, 300)])
def test_edge_rows(spark, window, batches, chunk_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh")
    passage = " ".join(word() + str(rng.randrange(30)) for _ in range(60))
    rows = [(k, " ".join(word() + str(rng.randrange(200)) for _ in range(rng.randrange(80))) + rng.choice(["", "\n" + passage, " " + passage + "\t" + passage[20:]])) for k in range(60)]
    rows += [(100, passage), (101, passage), (101, passage), (102, ""), (103, None), (None, passage[:90]), (104, "é 　x " * 40), (105, "one " * 500), (106, "\x1c\x85 z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    got = substring_dedup.remove(docs, window, batches, chunk_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute(rows, window)


def test_incremental_batch_is_judged_against_history(spark):
    text = " ".join(f"w{k}" for k in range(50))
    first = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "new start " + text), (4, "fresh text")], "doc_id long, text string")
    log = substring_dedup.FingerprintLog(spark, 35, max_runs=1)
    log.ingest(first)
    assert {r.doc_id: r.n_removed for r in log.resolve().collect()} == {1: 0, 2: 0}
    log.ingest(second)
    assert len(log.runs) == 1
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in log.resolve(only=[1]).collect()} == {3: (50, "new start"), 4: (0, "fresh text")}


def test_a_later_session_opens_the_log_and_reads_few_old_texts(spark, tmp_path):
    """Forty old chunks, of which one shares a passage with the new batch: one is read again."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    old = [(k, words(120)) for k in range(40)]
    new = [(100, "start " + " ".join(old[7][1].split()[20:80]) + " end"), (101, words(90)), (102, words(50)), (103, None)]
    frame = lambda s, rows: s.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    first = substring_dedup.FingerprintLog(spark, 35, chunk_bytes=1, folder=f"{tmp_path}/log")
    first.ingest(frame(spark, old))
    later = substring_dedup.FingerprintLog(spark.newSession(), 35, chunk_bytes=1, folder=f"{tmp_path}/log")
    later.ingest(frame(later.spark, new))
    want = [x for x in brute(old + new, 35) if int(x[0]) >= 100]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in later.resolve(only=[1]).collect()) == want
    assert later.reread == 1
    third = substring_dedup.FingerprintLog(spark, 35, chunk_bytes=1, folder=f"{tmp_path}/log")
    third.ingest(frame(spark, [(200, words(60))]))
    third.compact()
    assert [(r.doc_id, r.n_removed) for r in third.resolve(only=[2]).collect()] == [(200, 0)] and third.reread == 0
    assert sorted((str(r.doc_id), r.n_removed) for r in third.resolve().collect() if r.doc_id < 200) == [(i, n) for i, _, n, _ in brute(old + new, 35)]
    with pytest.raises(ValueError):
        substring_dedup.FingerprintLog(spark, 20, folder=f"{tmp_path}/log")


def test_buckets_follow_the_words(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 10)
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(9)}" for _ in range(30))) for k in range(120)]
    log = substring_dedup.FingerprintLog(spark, 6, chunk_bytes=500)
    before = log.n
    for part in (rows[:30], rows[30:60], rows[60:]):
        log.ingest(spark.createDataFrame(part, "doc_id long, text string"))
    assert log.n >= 4 * before
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in log.resolve().collect()) == brute(rows, 6)
    # One very long text, and a session's own choice of chunks.
    long = " ".join(f"v{rng.randrange(50)}" for _ in range(200_000))
    assert [(r.n_words, r.n_removed) for r in substring_dedup.remove(spark.createDataFrame([(1, long)], "doc_id long, text string"), 35).collect()] == [(200_000, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove(docs).count() == 0
