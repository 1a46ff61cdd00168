"""Exact dedup against SQL and a brute-force grouping."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, queries
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    same(queries.op5_exact_dedup(spark, SF), queries.oracle_sql()["op5_exact_dedup"], SF)


ROWS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b"), (None, "b"), (6, "ab"), (7, "ba"), (8, "ba"), (9, "x" * 100000), (10, "x" * 100000), (10, "x" * 100000)]


def _brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    key = lambda i: -1 if i is None else i
    return sorted((str(i), str(max(by[t or ""], key=key)), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.default_digest, lambda text: F.length(text).cast("string").cast("binary")])
def test_edge_rows_and_colliding_digest(spark, digest):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in ROWS], "doc_id long, text string, keep_id int, group_size int").repartition(4)
    got = exact_dedup.groups(docs, digest, files_per_batch=1).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == _brute(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_hits_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(ROWS + [(k, "hot") for k in range(100, 300)], "doc_id long, text string").repartition(4)
    for digest in (exact_dedup.default_digest, lambda text: F.length(text).cast("string").cast("binary")):
        got = exact_dedup.groups(docs, digest).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == _brute([(r.doc_id, r.text) for r in docs.collect()])


def test_survivors_keep_one_row_and_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "l") for i, t in ROWS], "doc_id long, text string, best string")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    kept = exact_dedup.survivors(spark.read.parquet(str(tmp_path / "docs")))
    assert kept.columns == ["doc_id", "text", "best"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8, 10]
    assert exact_dedup.survivors(docs.limit(0)).count() == 0
    assert exact_dedup.groups(docs.limit(0)).count() == 0


def test_a_second_session_hits_the_state_of_the_first(spark, tmp_path):
    """Batches over two sessions against a grouping of all rows; only the rows that hits name are read again."""
    log, batches = f"{tmp_path}/log", [ROWS[:6], [(20, "a"), (21, "new"), (22, "new"), (0, "ab"), (23, "x" * 100000), (24, None)], [(30, "zz")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, locator string").repartition(2).write.parquet(f"{tmp_path}/docs{k}")
    session, so_far, again = spark, [], []
    for k, rows in enumerate(batches):
        held = exact_dedup.DigestLog(session, log)
        got = held.add(session.read.parquet(f"{tmp_path}/docs{k}")).collect()
        again.append(held.read_again)
        so_far += rows
        want = {(i, t or ""): (keep, n) for (keep, n), i, t in (((max([-1 if j is None else j for j, u in so_far if (u or "") == (t or "")]), sum((u or "") == (t or "") for _, u in so_far)), i, t) for i, t in rows)}
        assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in got) == sorted((str(i), keep, n) for (i, _), (keep, n) in want.items())
        assert all(r.verified and r.kept == (r.doc_id == r.keep_id) for r in got)
        session = spark.newSession()
    assert again == [0, 2, 0]  # of the second batch "a" and the empty text
    assert sorted(r.group_size for r in exact_dedup.DigestLog(session, log).groups().collect()) == [1, 1, 1, 2, 2, 3, 3]


def test_bytes_are_compared_with_the_row_a_locator_names(spark, tmp_path):
    shorter = lambda text: F.length(text).cast("string").cast("binary")
    for k, rows in enumerate(([(1, "aa"), (2, "bbb")], [(3, "aa"), (4, "xy"), (5, "bbb")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d{k}")
    log = exact_dedup.DigestLog(spark, f"{tmp_path}/log")
    log.add(spark.read.parquet(f"{tmp_path}/d0"), shorter).collect()
    got = {r.doc_id: (r.kept, r.verified) for r in log.add(spark.read.parquet(f"{tmp_path}/d1"), shorter).collect()}
    assert got[4] == (True, False) and got[5] == (True, True) and got[3][1]
