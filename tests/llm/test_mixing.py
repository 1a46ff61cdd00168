"""Mixing against SQL, iterative water filling and a plain ordered prefix."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, queries
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    same(queries.op2_mixing(spark, SF), queries.oracle_sql()["op2_mixing"], SF)


def _fill(nodes, total):
    """Proportional shares, again and again, until nobody overflows."""
    out, open_, left = {k: 0.0 for k in nodes}, {k for k, (w, _) in nodes.items() if w > 0}, total
    while open_ and left > 1e-9:
        weight = sum(nodes[k][0] for k in open_)
        full = {k for k in open_ if out[k] + left * nodes[k][0] / weight >= nodes[k][1]}
        if not full:
            for k in open_:
                out[k] += left * nodes[k][0] / weight
            return out
        for k in full:
            left -= nodes[k][1] - out[k]
            out[k] = nodes[k][1]
        open_ -= full
        if full:
            for k in open_:
                left += out[k]
                out[k] = 0.0
    return out


@pytest.mark.parametrize("total", [0.0, 35.0, 400.0, 4000.0, 1e9])
def test_budgets_match_iterative_filling(spark, total):
    sizes = {("a", "en", "s1"): 100, ("a", "en", "s2"): 5, ("a", "de", "s1"): 40, ("b", "en", "s3"): 7, ("b", "fr", "s1"): 300, ("b", "fr", "s9"): 0, ("c", "en", "s1"): 1000}
    weights = {("a",): 5.0, ("b",): 2.0, ("c",): 0.5, ("a", "en"): 0.1, ("b", "fr", "s1"): 0.0, ("b", "en"): 3.0}
    can = lambda k: all(weights.get(k[:d], 1.0) > 0 for d in (1, 2, 3))
    leaves = spark.createDataFrame([(*k, 1, n) for k, n in sizes.items()], "domain string, lang string, source string, n_docs long, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.allocate(leaves, total, weights, 3).collect()}
    budgets = {(): total}
    for depth in (1, 2, 3):
        level = {}
        for path, budget in budgets.items():
            kids = {k[:depth] for k in sizes if k[: depth - 1] == path}
            level.update(_fill({k: (weights.get(k, 1.0), 3.0 * sum(n for x, n in sizes.items() if x[:depth] == k and can(x))) for k in kids}, budget))
        budgets = level
    assert got.keys() == budgets.keys()
    assert all(abs(got[k] - budgets[k]) < 1e-6 for k in got), (got, budgets)


def _pour(path, amount, sizes, weights, epochs, got):
    """Pour tokens into a node of the tree again and again; what it cannot take comes back."""
    if len(path) == 3:
        taken = min(amount, epochs * sizes[path] - got[path])
        got[path] += taken
        return amount - taken
    open_ = {k[: len(path) + 1] for k in sizes if k[: len(path)] == path and weights.get(k[: len(path) + 1], 1.0) > 0}
    while amount > 1e-9 and open_:
        total = sum(weights.get(k, 1.0) for k in open_)
        back = {k: _pour(k, amount * weights.get(k, 1.0) / total, sizes, weights, epochs, got) for k in open_}
        amount = sum(back.values())
        open_ -= {k for k, x in back.items() if x > 1e-9}
    return amount


ZERO_LEAF = ({("a", "en", "s1"): 1000, ("a", "en", "s2"): 10, ("b", "en", "s1"): 1000}, {("a", "en", "s1"): 0.0}, 1500.0, 1)
ZERO_NODES = ({(d, x, s): 10 * n + 5 for n, (d, x, s) in enumerate((d, x, s) for d in "abc" for x in ("en", "de") for s in ("s1", "s2", "s3"))}, {("a",): 3.0, ("b", "en"): 0.0, ("c", "de", "s2"): 0.0, ("c", "de", "s3"): -1.0, ("a", "en", "s1"): 0.0}, 1200.0, 2)


@pytest.mark.parametrize("sizes,weights,total,epochs", [ZERO_LEAF, ZERO_NODES, (*ZERO_NODES[:2], 300.0, 1), (*ZERO_NODES[:2], 1e9, 3)])
def test_no_budget_is_lost_while_a_sibling_has_room(spark, sizes, weights, total, epochs):
    leaves = spark.createDataFrame([(*k, 1, n) for k, n in sizes.items()], "domain string, lang string, source string, n_docs long, tokens long")
    found = {(r.domain, r.lang, r.source): r.budget for r in mixing.allocate(leaves, total, weights, epochs).collect()}
    want = dict.fromkeys(sizes, 0.0)
    _pour((), total, sizes, weights, epochs, want)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want), (found, want)
    room = sum(epochs * n for k, n in sizes.items() if all(weights.get(k[:d], 1.0) > 0 for d in (1, 2, 3)))
    assert abs(sum(found.values()) - min(total, room)) < 1e-6


def test_prefix_and_edge_rows(spark):
    rows = [(k, "w " * (k % 7), "en", "s1", "x") for k in range(300)] + [(None, None, None, None, "x"), (5, "w " * 5, "en", "s1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies string")
    got = mixing.plan(docs, F.lit("d"), 1000.0, {}, seed=3, max_epochs=4).collect()
    tokens = sum(k % 7 for k in range(300)) + 5
    share = 1000  # the null leaf has no tokens, so all goes to the other leaf
    whole, rest = divmod(share, tokens)
    ordered = sorted((hashlib.md5(f"3:{whole}:{r.doc_id}".encode()).hexdigest(), r.doc_id, r.n_tokens, r.copies) for r in got if r.doc_id is not None)
    total, seen = 0, {}
    for _, i, n, _ in ordered:
        seen[i] = seen.get(i, 0) + n
    for h, i, n, copies in ordered:
        upto = sum(m for g, j, m, _ in ordered if (g, j) <= (h, i))
        assert copies == whole + (upto <= rest)
        total += n * copies
    assert share - 7 * 2 <= total <= share
    mixed = mixing.sample(docs, F.lit("d"), 1000.0, {}, seed=3, max_epochs=4)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id is not null").count() == sum(c for *_, c in ordered)
    assert mixing.plan(docs.limit(0), F.lit("d"), 10.0, {}).count() == 0


def test_very_long_texts_and_many_slices(spark):
    rows = [(k, "w " * 200, "en", "s1") for k in range(400)] + [(1000, "long " * 300_000, "en", "s2"), (1001, "é" * 1_000_000, None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    got = {r.doc_id: (r.n_tokens, r.copies) for r in mixing.plan(docs, F.lit("d"), 60_000.0, {("d", "en", "s2"): 0.0}, seed=5, max_epochs=2).collect()}
    assert got[1000] == (300_000, 0) and got[1001][0] == 1
    # The leaf without a language takes its 2 tokens, the other language's only open leaf the rest: 299 texts of 200 words.
    assert got[1001] == (1, 2)
    taken = [got[k][1] for _, k in sorted((hashlib.md5(f"5:0:{k}".encode()).hexdigest(), k) for k in range(400))]
    assert taken == sorted(taken, reverse=True) and sum(taken) == 299
