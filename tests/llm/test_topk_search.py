"""Top-k search against SQL and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, topk_search
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    same(queries.op3_topk_search(spark, SF), queries.oracle_sql()["op3_topk_search"], SF)


def _brute(rows, k, scale=64.0):
    good = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread,size,passes", [(0.5, 40, 1 << 20), (0.02, 40, 3000), (1e6, 6, 1)])
def test_edge_rows_and_ties(spark, spread, size, passes):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in np.round(rng.normal(0, spread, 24), 2)]) for k in range(size * 4)]
    rows += [(1001, rows[3][1]), (1002, rows[3][1]), (1005, rows[3][1]), (2000, None), (2005, [1.0, None] + [0.0] * 22), (2010, [float("nan")] * 24), (2015, [float("inf")] * 24), (3000, [0.5, 0.25]), (3005, [0.1, -0.9]), (3010, []), (3015, []), (None, rows[0][1])]
    data = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk_search.top_k(data, F.col("vec_id") % 5 == 0, k=4, query_block=7, candidate_block=33, seed_rows=20, pass_bytes=passes).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _brute(rows, 4)
    assert topk_search.top_k(data.limit(0), F.lit(True)).count() == 0


def test_pruning_compacts_and_keeps_the_best():
    rng = np.random.default_rng(3)
    c = np.floor(rng.normal(0, 1, (64, 3000)) * np.geomspace(100, 0.5, 64)[:, None])
    q = np.floor(rng.normal(0, 1, (64, 5)) * np.geomspace(100, 0.5, 64)[:, None])
    r, x, s = topk_search.block_top_k(np.arange(5) + 10**6, q, np.arange(3000), c, 10)
    for k in range(5):
        full = (q[:, k] @ c).astype(int)
        best = sorted(zip(-full, range(3000)))[:10]
        assert [(-a, b) for a, b in best] == list(zip(s[r == k].tolist(), x[r == k].tolist()))


def test_known_scores_prune_the_next_block_and_lose_nothing():
    """Energy in the last dimensions, and a first block that holds the best."""
    rng = np.random.default_rng(4)
    fall = np.geomspace(0.5, 100, 64)[:, None]
    c, q = np.floor(rng.normal(0, 1, (64, 3000)) * fall), np.floor(rng.normal(0, 1, (64, 5)) * fall)
    full = np.sort(q.T @ c, axis=1)
    shares = []
    for known in (None, full[:, -10]):
        kept = []
        r, x, s = topk_search.block_top_k(np.arange(5) + 10**6, q, np.arange(3000), c, 10, known=known, kept=kept)
        assert all(sorted(s[r == k].tolist()) == full[k, -10:].astype(int).tolist() for k in range(5))
        shares.append(kept)
    assert shares[1][-1] <= shares[0][-1] < 0.2


def test_fewer_products_than_brute_force_on_even_vectors():
    """Vectors without any skew, 200 queries in a block: known scores let each query drop most of the last dimensions."""
    rng = np.random.default_rng(6)
    c = np.floor(64 * rng.normal(0, 0.125, (64, 4000)))
    q = c[:, :200] * 1.0
    score = q.T @ c
    score[np.arange(200), np.arange(200)] = -np.inf
    known, kept = np.sort(score, axis=1)[:, -20], []
    r, x, s = topk_search.block_top_k(np.arange(200), q, np.arange(4000), c, 20, known=known, kept=kept)
    assert all(sorted(s[r == n].tolist()) == np.sort(score[n])[-20:].astype(int).tolist() for n in range(200))
    assert kept[-1] < 0.1 and sum(kept) / len(kept) < 0.85


def test_an_invalid_vector_does_not_stand_for_its_query(spark):
    """A query id with several rows, of which some hold what takes no part."""
    inf, nan = float("inf"), float("nan")
    for bad in ([-inf, 1.0], [nan, 1.0], [-1e308, 0.0], [None, 0.0], [inf, nan], None):
        rows = [(20, bad), (20, [0.5, 0.5]), (20, bad), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, bad), (40, bad)]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = topk_search.top_k(vectors, F.col("vec_id") % 20 == 0, k=20).collect()
        assert [tuple(r) for r in got] == [(20, 1, 1, 2048), (20, 2, 2, 2048)], bad
