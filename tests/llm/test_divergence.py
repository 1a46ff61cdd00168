"""The divergence audit against its SQL and against plain Python with whole numbers."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import divergence
from tests.llm.oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank int"


def plain(rows, least_docs, top=50):
    """What the contract says, term by term."""
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    df, tf = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        tf[lang][source].update(terms)
    out = []
    for lang, by in tf.items():
        kept = [t for t, n in df[lang].items() if n >= least_docs]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(c) for s, c in by.items()}, share(sum(by.values(), Counter()))
        for s, c in by.items():
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in by if o != s)
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if c[t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -value, rank) for part, found in (("pair", pairs), ("term", more)) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def _got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def _rows(seed, n, sources, words):
    r = random.Random(seed)
    return [(k, " ".join(f"{chr(97 + r.randint(0, words) % 26)}{chr(97 + r.randint(0, words) // 26 % 26)}" for _ in range(r.randint(0, 30))), r.choice(["en", "de"]), f"s{min(r.randint(0, sources - 1), r.randint(0, sources - 1))}", "v", 1) for k in range(n)]


def test_matches_sql_on_the_given_tables(spark):
    from lodestone.llm import queries

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        same(queries.queries()["op11_divergence"](spark, sf), queries.oracle_sql()["op11_divergence"], sf)


def test_small_units_and_many_rounds(spark):
    rows = _rows(1, 500, 13, 60)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain(rows, 3, 7)
    assert len({r[1] for r in want}) == 13 and sum(r[2] == "term" for r in want) > 100
    for segment, block in ((7, 1), (50, 2), (4096, 5)):
        assert _got(divergence.audit(docs, least_docs=3, top=7, segment=segment, block=block, held_terms=100)) == want


def test_every_two_blocks_meet_once(spark):
    for blocks in range(1, 9):
        seats = spark.range(blocks).withColumnRenamed("id", "block").withColumn("blocks", F.lit(blocks).cast("long"))
        met = []
        for turn in range(9):
            rows = seats.withColumn("to", divergence.opponent(F.col("block"), F.col("blocks"), turn)).withColumn("stays", divergence._stays(F.col("block"), F.col("to"))).where("to IS NOT NULL").collect()
            faced = {r.block: r.to for r in rows}
            assert all(faced[b] == a for a, b in faced.items())
            assert {r.block: r.stays for r in rows} == {r.block: not {x.block: x.stays for x in rows}[r.to] for r in rows}
            met += [tuple(sorted(x)) for x in faced.items()]
        assert sorted(met) == sorted(2 * [(a, b) for b in range(blocks) for a in range(b)])


def test_nulls_ties_repeats_and_groups_without_terms(spark):
    rows = [(k, "Ähm x x y", "en", "a", "v", 1) for k in range(3)] + [(3, "x y y", "en", "b", "v", 1)] * 2 + [(None, None, "en", None, "v", 1), (5, "", None, "a", "v", 1), (6, "12 [] {}", None, "z", "v", 1), (7, "only once", "fr", "a", "v", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = _got(divergence.audit(docs, least_docs=2))
    assert got == plain(rows, 2)
    assert [r for r in got if r[0] == ""] == [("", "a", "pair", "z", 0, 1), ("", "z", "pair", "a", 0, 1)]
    assert not [r for r in got if r[0] == "fr"]
    assert divergence.audit(docs.limit(0), least_docs=2).count() == 0


def test_very_long_texts_and_a_hot_source(spark):
    rows = [(k, f"{'lang ' * 3 * k} w{'abc'[k % 3]}", "en", "hot" if k % 3 else f"s{k % 12}", "v", 1) for k in range(120)] + [(200, "deep " * 300_000, "en", "hot", "v", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _got(divergence.audit(docs, block=2)) == plain(rows, 30)


def test_shares_beyond_a_long(spark):
    big = spark.sql("SELECT 900000000000000L AS c, 1000000000000000L AS n, 7L AS v").select(divergence._share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first().p
    assert big == 1 + 10**9 * (900000000000000 + 5) // (1000000000000000 + 35)
