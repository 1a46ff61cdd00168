"""Source divergence audit by systolic rotation.

Every (lang, source) group has a smoothed share of each term that its language
keeps. The audit tells how far each two sources of a language lie apart, and
which terms a source has more of than its language.

1. Tasks count terms and documents by group in dictionaries, so what is shuffled
   is one row per group, term and task. A window over (lang, term) keeps the
   terms that stand in enough documents of the language.
2. The terms of a language are dealt to segments of about ``SEGMENT`` terms, its
   groups to blocks of ``BLOCK`` groups. A unit is one block's shares of one
   segment, packed into compressed arrays, and written once, dealt by its key.
   So a unit is small whatever the data: a hot source or a large vocabulary is
   more units, never a larger one.
3. Home round: each unit meets its own groups and its language's vector of the
   segment; local heaps keep the terms of greatest surplus.
4. Rotation: blocks play a round-robin tournament (circle method). In each round
   every block meets one other of its language; of the two one stays where it is
   written and the packed vectors of the other travel to it, and the meeting is
   judged in both directions. A round moves at most half of the packed vectors,
   and its sums are written before the next one starts.
5. Sums over segments, and ranks.

All arithmetic is on whole numbers. A term's place in its segment follows the
order of terms, so the heaps' ties are already those of the result.

Defined results: null text, lang and source count as ''; every row is a document
of its own, repeated rows too; a group without terms is there with counts of 0;
in a language that keeps no term all distances are 0; a language of one source
has no pair; an empty table gives an empty table; ids and further columns are
not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bucketed, materialize, scratch
from lodestone.llm.packing import expand, squeeze

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a segment (about), and groups of a block.
SEGMENT, BLOCK = 4096, 8
#: Entries of a task's dictionaries that are sent on together.
HELD_TERMS = 1_000_000

#: Letters A-Z to lower case, other ASCII characters to blanks; bytes of other characters stay.
_FOLD = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 128 else 32 for k in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64())])
_UNIT = pa.schema([("lang", pa.string()), ("seg", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("slots", pa.binary()), ("zeros", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("shares", pa.binary())])
_VECTOR = pa.schema([("lang", pa.string()), ("seg", pa.int64()), ("own", pa.binary())])
_MET = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("seg", pa.int64()), ("id", pa.int64()), ("value", pa.int64())])
_SQL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def terms_of(text: str) -> list[bytes]:
    """Runs of letters and of any characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8").translate(_FOLD).split()


def _count(held_terms: int):
    """Counts by group and term of what a task reads; a row without a term says that a group is there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (tf, df) in groups.items():
                n = len(tf) + 1
                terms = [b"", *tf]
                cols = [pa.array([lang] * n), pa.array([source] * n), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *tf.values()], pa.int64()), pa.array([0, *(df[t] for t in terms[1:])], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=_COUNTED)
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tf, df = groups.setdefault((lang, source), (Counter(), Counter()))
                words = terms_of(text.as_py())
                tf.update(words)
                df.update(set(words))
            if sum(len(tf) for tf, _ in groups.values()) > held_terms:
                yield from told()
        yield from told()

    return rows


def _share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * n_terms)); 1 where nothing is kept."""
    above = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTH * n_terms).cast("decimal(20,0)")
    return F.when(below > 0, 1 + F.call_function("div", above, below)).otherwise(F.lit(1)).cast("long")


def _unit(key, rows):
    """A block's shares of one segment: per group its share of absent terms, and the places and shares of its own."""
    lang, seg, block = (k.as_py() for k in key)
    slot, at, share = (rows.column(c).to_numpy() for c in ("slot", "id", "share"))
    order = np.lexsort((at, slot))
    slot, at, share = slot[order], at[order], share[order]
    own = at >= 0  # a group's row without a place has its share of absent terms
    slots = slot[~own]
    counts = np.diff(np.append(np.flatnonzero(~own), len(slot))) - 1
    packed = [squeeze(x.astype(np.uint64)) for x in (slots, share[~own], counts, at[own], share[own])]
    cols = [[lang], [seg], [block], [rows.column("size").to_numpy()[order][~own][0]], *([x] for x in packed)]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _UNIT)], schema=_UNIT)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots, the shares of all terms by group, and group and place of each share that is no group's default."""
    slots, zeros, counts, ids, shares = (expand(row[c]).astype(np.int64) for c in ("slots", "zeros", "counts", "ids", "shares"))
    of = np.repeat(np.arange(len(slots)), counts)
    full = np.repeat(zeros[:, None], row["size"], axis=1)
    full[of, ids] = shares
    return slots, full, of, ids


def _meetings(lang: str, a_slots, a, b_slots, b, both: bool) -> list[tuple]:
    rows = []
    for slot, own in zip(a_slots.tolist(), a):
        for other, value in zip(b_slots.tolist(), np.abs(b - own).sum(axis=1).tolist()):
            if other != slot:
                rows.append((lang, slot, other, None, None, value))
                if both:
                    rows.append((lang, other, slot, None, None, value))
    return rows


def _met(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(_MET)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _MET)], schema=_MET)


def _home(top: int):
    """A unit with itself and with its language's vector."""

    def answer(units: pa.Table, vectors: pa.Table) -> pa.Table:
        rows = []
        own = {(r["lang"], r["seg"]): expand(r["own"]).astype(np.int64) for r in vectors.to_pylist()}
        for unit in units.to_pylist():
            slots, full, of, ids = _opened(unit)
            rows += _meetings(unit["lang"], slots, full, slots, full, both=False)
            if not unit["size"]:
                continue
            above = full[of, ids] - own[unit["lang"], unit["seg"]][ids]
            for k, slot in enumerate(slots.tolist()):
                here = (of == k) & (above > 0)
                rows += [(unit["lang"], slot, None, unit["seg"], at, -value) for value, at in heapq.nsmallest(top, zip((-above[here]).tolist(), ids[here].tolist()))]
        return _met(rows)

    return lambda units, vectors: answer(units, vectors)


def _round(stay: pa.Table, travel: pa.Table) -> pa.Table:
    """Units that stay, each with the unit that came to it: both directions of every two groups."""
    came = {(r["lang"], r["seg"], r["to"]): r for r in travel.to_pylist()}
    rows = []
    for unit in stay.to_pylist():
        if (other := came.get((unit["lang"], unit["seg"], unit["block"]))) is not None:
            a_slots, a, *_ = _opened(unit)
            b_slots, b, *_ = _opened(other)
            rows += _meetings(unit["lang"], a_slots, a, b_slots, b, both=True)
    return _met(rows)


def opponent(block: Column, blocks: Column, turn: int) -> Column:
    """Whom a block meets in a round of the circle method, or null: with an odd number one rests, and small languages end early."""
    ring = blocks + blocks % 2 - 1  # all seats but the last one
    last = ring
    seat = F.pmod(F.lit(turn) - block, ring)
    # The last seat meets the one whose double is the turn; ring is odd, so halving is a product with (ring + 1) / 2.
    faced = F.when(block == last, F.pmod(F.lit(turn) * ((ring + 1) / 2).cast("long"), ring)).when(seat == block, last).otherwise(seat)
    return F.when((blocks > 1) & (F.lit(turn) < ring) & (faced < blocks), faced)


def _stays(block: Column, faced: Column) -> Column:
    """Which of two blocks stays: by turns, so that no block is always at home."""
    return F.when((block + faced) % 2 == 0, block < faced).otherwise(block > faced)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, segment: int = SEGMENT, block: int = BLOCK, held_terms: int = HELD_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    spark = docs.sparkSession
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    by_group = texts.mapInArrow(_count(held_terms), _ddl(_COUNTED)).groupBy("lang", "term", "source").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    in_lang = F.sum("df").over(Window.partitionBy("lang", "term"))
    kept = materialize(by_group.withColumn("df", in_lang).where((F.col("df") >= least_docs) | (F.col("term") == "")).drop("df"), "audit-counts")

    groups = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"))
    groups = groups.withColumn("slot", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1).withColumn("block", F.floor(F.col("slot") / block))
    groups = materialize(groups, "audit-groups")
    terms = kept.where("term <> ''").groupBy("lang", "term").agg(F.sum("tf").alias("tf"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), (F.max("block") + 1).alias("blocks"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"))
    langs = langs.join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0))).withColumn("segs", F.greatest(F.lit(1), F.ceil(F.col("v") / segment)))
    langs = materialize(langs, "audit-langs")
    place = Window.partitionBy("lang", "seg").orderBy("term")
    terms = terms.join(langs, "lang").withColumn("seg", F.pmod(F.xxhash64("term"), "segs")).withColumn("id", F.row_number().over(place).cast("long") - 1)
    terms = materialize(terms.select("lang", "seg", "id", "term", _share(F.col("tf"), F.col("lang_n"), F.col("v")).alias("own")), "audit-terms")

    segs = terms.groupBy("lang", "seg").agg(F.count("*").alias("size"))
    segs = langs.select("lang", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segs") - 1)).alias("seg")).join(segs, ["lang", "seg"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    sources = groups.join(langs.select("lang", "v"), "lang")
    absent = sources.drop("v").join(segs, "lang").select("lang", "seg", "block", "slot", F.lit(-1).cast("long").alias("id"), _share(F.lit(0), F.col("n"), F.col("v")).alias("share"), "size")
    present = kept.where("term <> ''").join(terms.select("lang", "term", "seg", "id"), ["lang", "term"]).join(sources, ["lang", "source"])
    present = present.select("lang", "seg", "block", "slot", "id", _share(F.col("tf"), F.col("n"), F.col("v")).alias("share"), F.lit(0).cast("long").alias("size"))
    units = absent.unionByName(present).groupBy("lang", "seg", "block").applyInArrow(_unit, _ddl(_UNIT)).join(langs.select("lang", "blocks"), "lang")
    units = bucketed(units.withColumn("home", F.to_json(F.struct("lang", "seg", "block"))), "home", "audit_units")

    vectors = terms.groupBy("lang", "seg").applyInArrow(_vector, _ddl(_VECTOR)).join(langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "lang")
    vectors = vectors.withColumn("home", F.to_json(F.struct("lang", "seg", "block")))
    path = scratch(spark, "audit-met")
    units.groupBy("home").cogroup(vectors.groupBy("home")).applyInArrow(_home(top), _ddl(_MET)).write.parquet(f"{path}/home")
    # One number a language: the most blocks that any has.
    most = langs.agg(F.max("blocks")).first()[0] or 0
    rounds = range(most + most % 2 - 1) if most > 1 else range(0)
    for turn in rounds:
        faced = opponent(F.col("block"), F.col("blocks"), turn)
        here = units.withColumn("to", faced).where(F.col("to").isNotNull())
        stay, travel = here.where(_stays(F.col("block"), F.col("to"))).drop("to"), here.where(~_stays(F.col("block"), F.col("to")))
        travel = travel.withColumn("home", F.to_json(F.struct("lang", "seg", F.col("to").alias("block"))))
        stay.groupBy("home").cogroup(travel.groupBy("home")).applyInArrow(_round, _ddl(_MET)).write.parquet(f"{path}/round-{turn}")
    met = spark.read.schema(_ddl(_MET)).parquet(*[f"{path}/home", *(f"{path}/round-{turn}" for turn in rounds)])

    name = groups.select("lang", "slot", "source")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = met.where("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.join(name.withColumnRenamed("slot", "a"), ["lang", "a"]).join(name.select("lang", F.col("slot").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    best = met.where("id IS NOT NULL").join(terms.select("lang", "seg", "id", F.col("term").alias("item")), ["lang", "seg", "id"]).join(name.withColumnRenamed("slot", "a"), ["lang", "a"])
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(best)


def _vector(key, rows):
    """A language's shares of one segment, by place."""
    order = np.argsort(rows.column("id").to_numpy())
    own = squeeze(rows.column("own").to_numpy()[order].astype(np.uint64))
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([own], pa.binary())], schema=_VECTOR)


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """DuckDB SQL for ``audit`` over ``documents``."""
    return f"""
WITH doc AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found FROM documents),
word AS (SELECT rid, lang, source, unnest(found) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c FROM word GROUP BY lang, term HAVING count(DISTINCT rid) >= {least_docs}),
whole AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
own AS (SELECT source, lang, term, count(*) AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY source, lang, term),
grp AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN own USING (lang, source) GROUP BY g.lang, g.source),
share AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(o.c, 0) + {SMOOTH})::HUGEINT) // (g.n + {SMOOTH} * w.v)::HUGEINT AS p,
          1 + ({SCALE}::HUGEINT * (k.c + {SMOOTH})::HUGEINT) // (w.n + {SMOOTH} * w.v)::HUGEINT AS q
          FROM grp g JOIN whole w USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
more AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM share WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
