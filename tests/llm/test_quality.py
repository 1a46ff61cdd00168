"""Quality classifier: held-out accuracy, traversal and edge rows."""

import zlib

import numpy as np

from lodestone.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_columns(spark):
    got = {r.doc_id: r for r in queries.op8_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    out = [(r.quality, got[r.doc_id].score) for r in labels if got[r.doc_id].held_out]
    good, bad = [s for q, s in out if q], [s for q, s in out if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95, auc
    assert np.mean([(s >= 0.7) == bool(q) for q, s in out]) > 0.93


def test_flat_trees_equal_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit(x, y, trees=20)
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95
    for row, margin in zip(x[:50], forest.margins(x[:50])):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += v[k - len(f)]
        assert abs(total - margin) < 1e-9


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 1.0), (2, None, 1.0), (3, "", 1.0), (None, "x", 1.0), (1, "a b c", 1.0), (4, "w " * 60000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 6
    none = quality.scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert quality.keep(docs, labels, threshold=0.0).columns == docs.columns
    assert quality.keep(docs, labels, threshold=0.0).count() == 6


def _best_split(x, y, rows):
    """The best (gain, feature, threshold) of one node by trying every cut of every feature."""
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    g, h = (rate - y)[rows], np.full(len(rows), max(rate * (1 - rate), 1e-9))
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS)[1:-1])):
            left = x[rows, f] <= cut
            if min(left.sum(), (~left).sum()) >= quality.LEAST_ROWS:
                gain = value(left) + value(~left) - value(np.ones(len(rows), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best


def test_histogram_splits_equal_an_exhaustive_search():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 6)), 1)
    y = ((x[:, 2] + 0.5 * x[:, 4] + 0.3 * rng.normal(size=300)) > 0.1).astype(float)
    forest = quality.fit(x, y, trees=1, depth=2)
    _, f, cut = _best_split(x, y, np.arange(300))
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == (f, cut)
    for node, rows in ((1, np.flatnonzero(x[:, f] <= cut)), (2, np.flatnonzero(x[:, f] > cut))):
        _, g, below = _best_split(x, y, rows)
        assert (forest.feature[0, node], forest.threshold[0, node]) == (g, below)
    rate = y.mean()
    for leaf in range(4):
        at = np.zeros(300, int)
        for _ in range(2):
            at = 2 * at + 1 + (x[np.arange(300), forest.feature[0][at]] > forest.threshold[0][at])
        rows = at - 3 == leaf
        want = quality.RATE * (y - rate)[rows].sum() / (rows.sum() * rate * (1 - rate) + quality.RIDGE)
        assert abs(forest.value[0, leaf] - want) < 1e-9


def test_some_features_by_hand():
    named = dict(zip(quality.FEATURES, quality.features("Aa aa aa!\n\nBB")))
    assert named["log_words"] == float(np.log1p(4)) and named["same_next"] == 0 and named["distinct_words"] == 1.0
    assert named["blank_lines"] == 1 / 3 and named["shouted"] == 0.25 and named["titled"] == 0.25 and named["odd_ends"] == 0.25
    assert named["max_word"] == 3.0 and named["mean_word"] == 2.25 and named["lower"] == 5 / 13 and named["shout"] == 1 / 13
    assert quality.features("")[1:] == [0.0] * (len(quality.FEATURES) - 1)


def test_a_repeated_id_learns_from_its_smallest_text(spark):
    rng = np.random.default_rng(1)
    rows = [(k, ("good plain words " if k % 2 else "x! y! ") * int(rng.integers(3, 9))) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    again = [(k, t + " zz") for k, t in rows]
    frames = [spark.createDataFrame(x, "doc_id long, text string").repartition(5) for x in (rows + again, again + rows)]
    a, b = (quality.train(f, labels) for f in frames)
    assert all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("feature", "threshold", "value"))
    assert np.array_equal(a.value, quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels).value)
