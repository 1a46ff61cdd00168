"""Near-dedup against SQL and brute-force links and components."""

import random
import re

import numpy as np
import pytest

from lodestone.llm import minhash_dedup, queries
from lodestone.llm.components import components
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(FOLD))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(ids.get(find(k), i), i)
    return sorted(((str(i), len(sets[k]), str(ids.get(find(k)))) for k, (i, _) in enumerate(rows)))


def _rows(seed):
    rng = random.Random(seed)
    out = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            out.append(" ".join(w))
    out += ["", None, "one", "ONE", "one two", "One  two", "É é", "same " * 400, "same " * 900]
    rows = [(k + 5, t) for k, t in enumerate(out)]
    return rows + [(None, out[0]), (3, out[4]), (3, out[4]), (None, None)]


@pytest.mark.parametrize("options", [{}, {"leaf": 3, "deepest": 2, "cluster": 4, "trees": 40}])
def test_edge_rows(spark, options):
    rows = _rows(1)
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string").repartition(3)
    got = minhash_dedup.classes(docs, 3, 85, **options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_matches_sql(spark):
    same(queries.op6_minhash_dedup(spark, SF), queries.oracle_sql()["op6_minhash_dedup"], SF)


def test_survivors(spark):
    rows = _rows(2)
    docs = spark.createDataFrame([(*r, "k") for r in rows if r[0] is not None], "doc_id long, text string, label string")
    left = minhash_dedup.survivors(docs, 3, 85)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({int(c) for _, _, c in brute([r for r in rows if r[0] is not None], 3, 85)})
    assert minhash_dedup.survivors(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(30)) and got[201] == 200


def test_exact_labels_judges_every_pair():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in range(0, 60, 6)]
    assert set(minhash_dedup.exact_labels(sets, 85)) == {0}
    assert list(minhash_dedup.exact_labels(sets[::2], 85)) == list(range(5))


def test_trees_hold_the_miss_at_every_depth():
    for percent in (80, 85):
        lost = [(1 - (percent / 100) ** d) ** minhash_dedup.trees_for(percent, depth=d) for d in range(2, minhash_dedup.DEEPEST + 1)]
        assert sum(lost) <= minhash_dedup.MISS


def test_pairs_in_large_nodes_are_found(spark):
    """Pairs at the threshold among sets that share enough to branch to the last depth."""
    rng = np.random.default_rng(5)
    places, base, rows = minhash_dedup.PLACES, rng.integers(0, 2**31, minhash_dedup.PLACES), []
    for k in range(600):
        a = np.where(rng.random(places) < 0.9, base, rng.integers(0, 2**31, places)) * 2 + rng.integers(0, 2, places)
        b = a.copy()
        b[rng.permutation(places)[:25]] = rng.integers(0, 2**32, 25)
        rows += [(f"{k}-{n}".encode(), bytearray(s.astype(np.uint32).tobytes())) for n, s in (("a", a), ("b", b))]
    sets = spark.createDataFrame([(bytearray(i), s) for i, s in rows], "key binary, sig binary")
    found = components(minhash_dedup.likely_links(sets, 80, 4, 4, 5))
    label = {bytes(r.node).decode(): bytes(r.label) for r in found.collect()}
    lost = [k for k in range(600) if f"{k}-a" not in label or label[f"{k}-a"] != label.get(f"{k}-b")]
    assert len(lost) <= 2 * 600 * (1 - 0.8**2) ** 4  # four trees miss so many by depth 2; deeper nodes add next to none


def test_recall_of_the_default_trees_in_branching_nodes(spark):
    """Thousands of pairs at the threshold, leaves so small that every depth is used: none is missed."""
    rng = np.random.default_rng(8)
    places, base, rows = minhash_dedup.PLACES, rng.integers(0, 2**31, minhash_dedup.PLACES), []
    for k in range(1500):
        a = np.where(rng.random(places) < 0.35, base, rng.integers(0, 2**32, places))
        b = np.where(rng.random(places) < 0.8, a, rng.integers(0, 2**32, places))
        rows += [(bytearray(f"{k}-{n}".encode()), bytearray(s.astype(np.uint32).tobytes())) for n, s in (("a", a), ("b", b))]
    sets = spark.createDataFrame(rows, "key binary, sig binary")
    found = minhash_dedup.likely_links(sets, 80, minhash_dedup.trees_for(80), 4, minhash_dedup.DEEPEST)
    label = {bytes(r.node).decode(): bytes(r.label) for r in components(found).collect()}
    alike = [k for k in range(1500) if (np.frombuffer(bytes(rows[2 * k][1]), np.uint32) == np.frombuffer(bytes(rows[2 * k + 1][1]), np.uint32)).mean() >= 0.8]
    lost = [k for k in alike if f"{k}-a" not in label or label[f"{k}-a"] != label.get(f"{k}-b")]
    assert len(alike) > 600 and not lost


def test_large_clusters_of_several_parts(spark):
    """A cluster far above its bound, of parts that likely links join and full sets keep apart."""
    rng, rows = random.Random(4), []
    base = [f"w{k}" for k in range(120)]
    for part, change in enumerate((0, 14, 30)):
        own = list(base)
        for k in range(change):
            own[7 * k % 120] = f"p{part}-{k}"
        for _ in range(40):
            w = list(own)
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join(base[k : k + 60] + [f"z{k}"] * 9)) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for cluster in (10, 60):
        got = minhash_dedup.classes(docs, 3, 85, cluster=cluster).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 3, 85)


def test_the_smallest_key_names_a_component():
    label, key = np.array([0, 1, 0, 0, 1]), [b"d", b"z", b"b", b"c", b"a"]
    assert minhash_dedup._smallest(label, key, np.arange(5)).tolist() == [2, 4, 2, 2, 4]


def test_survivors_keep_one_row_of_each_component_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(60)) for x in "abcd")
    rows = [(None, a), (None, a + " more"), (None, a), (None, b), (4, b + " more"), (5, c), (5, d), (2, d + " more"), (None, None), (None, None), (None, " "), (7, None), (7, ""), (7, "")]
    left = minhash_dedup.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85)
    got = [(r.doc_id, r.text) for r in left.collect()]
    words = [x for x in got if x[1] and x[1].strip()]
    assert len([i for i, t in words if t.startswith("a0")]) == 1
    assert sorted(x for x in words if not x[1].startswith("a0")) == [(2, d + " more"), (4, b + " more"), (5, c)]
    assert sorted(map(str, (x for x in got if x not in words))) == sorted(map(str, [(None, None), (None, None), (None, " "), (7, None), (7, "")]))


def test_buckets_and_parts_follow_the_shingles(spark, monkeypatch):
    """More rows or longer sets open more buckets, and clusters of long sets are judged in parts: with the same result."""
    assert minhash_dedup.buckets_for(spark, 2, 10**9, 250_000) == 4000 > minhash_dedup.buckets_for(spark, 2, 10, 250_000)
    rng, rows = random.Random(9), []
    for group in range(4):
        base = [f"g{group}-{k}" for k in range(400)]
        for _ in range(12):
            w = list(base)
            w[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, opened, real = brute(rows, 3, 85), [], minhash_dedup.buckets_for
    monkeypatch.setattr(minhash_dedup, "buckets_for", lambda *x: opened.append(real(*x)) or opened[-1])
    for name, most in (("NODE_ROWS", 5), ("BUCKET_SHINGLES", 50), ("CLUSTER_SHINGLES", 2000)):
        monkeypatch.setattr(minhash_dedup, name, most)
        got = minhash_dedup.classes(docs, 3, 85).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want, name
    assert max(opened) > 64
