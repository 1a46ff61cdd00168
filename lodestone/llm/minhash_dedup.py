"""MinHash near-dedup by chosen paths.

A document is the set of its distinct word shingles. Documents with the same
set are one set from here on. A set becomes a minwise signature; a tree of
paths branches the sets: at a node one signature place is chosen by a hash of
the node's path, and sets go to children by their minwise token at that place.
A node that is small enough is a leaf; a larger one is branched again. Two sets
of similarity J share a child with probability J, so trees are repeated until a
pair at the threshold is missed with probability ``MISS`` at most, taking trees as
independent. The chance to stay together falls with every branching, so the sets
of a node that is still large after two get further trees of their own, placed at
the next depth at once, as many as that depth asks for (``trees_for``).

Leaves are compared exhaustively on 128-bit sketches, many leaves at once, and
give a forest of likely links (at most one row per set and tree), not pairs. A
node that stays large after ``DEEPEST`` branchings is split into blocks that
meet block by block, so it too is compared in full. Likely links only group
sets into clusters, a superset of the true groups; each cluster is then judged
on the full shingle sets, all against all within the cluster's task. In a cluster
larger than ``CLUSTER`` the likely links themselves are judged first, one by one:
mostly they hold the cluster together and it is done. Where several parts are
left, blocks of the cluster meet, except two blocks of the same part. A link
holds if 100 times the intersection is at least ``percent`` times the union.
Nothing is capped or dropped; nothing but counts reaches the driver.

Defined results: A-Z lower-cased, words are runs of anything but ASCII white
space; with fewer words than a shingle the whole sequence is one shingle; a null
or wordless text has the empty set, is linked with nothing and stays;
component_id is the smallest doc_id of the component, null if it has none;
in ``classes`` a row is kept if its doc_id is the component's, so rows that share
the doc_id, or have none, share that. ``survivors`` returns exactly one row of each
component, named by doc_id and a 128-bit digest of its text: the smallest doc_id, a
row without one only where the component has none, then the smallest digest. Of
wordless rows with equal doc_id and text it returns one, those without a doc_id all.
An empty table gives an empty table; further columns are ignored by ``classes`` and
pass through ``survivors``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import buckets, give_back, materialize
from lodestone.llm.components import components, written_edges

SHINGLE, PERCENT = 5, 80
PLACES = 128
#: Probability at which a pair that should be linked may be missed by all trees.
MISS = 1e-9
#: Sets in a leaf, branchings before a node is compared in blocks, sets in a cluster's task.
#: A full leaf is under 1 MB of sketches and at most about half a second of comparisons.
LEAF, DEEPEST, CLUSTER = 8192, 5, 2048
#: Rows of nodes, and shingles of full sets (8 bytes each), of a bucket that a task takes as a whole; shingles above which a cluster is judged in parts.
NODE_ROWS, BUCKET_SHINGLES, CLUSTER_SHINGLES = 250_000, 8_000_000, 8_000_000
#: Documents up to which the ids to fetch are sent to every executor (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
NO_ID = -(2**63)
#: Words whose hashes a task remembers (about 150 bytes each).
KNOWN_WORDS = 100_000

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**64, PLACES, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, PLACES, np.uint64)
_B = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, index: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes; ``index`` remembers word hashes."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((index[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = _mixed(out * _B + h[k : k + n])
    return np.unique(out)


class _Words(dict):
    """Word hashes, at most ``KNOWN_WORDS`` at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), 4096):
        part = (s[None, k : k + 4096] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)
        out = np.minimum(out, part.min(1).astype(np.uint32))
    return out


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


_SKETCH = pa.schema([("id", pa.int64()), ("mark", pa.binary()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])
_NODE = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("key", pa.binary()), ("bits", pa.binary())])
_EDGE = pa.schema([("u", pa.binary()), ("v", pa.binary())])
_SET = pa.schema([("key", pa.binary()), ("shingles", pa.binary())])
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _sketch(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part, out = batch.slice(at, 2048), ([], [], [])
                for text in part.column(2):
                    s = shingles(text.as_py(), size, index)
                    out[0].append(len(s))
                    out[1].append(_key(s) if len(s) else None)
                    out[2].append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, f.type) for c, f in zip(out, list(_SKETCH)[2:]))], schema=_SKETCH)
        index.clear()
        give_back()

    return rows


def _walk(depth: int):
    """Rows (tree, key, sig) to the node at ``depth`` of their tree's path, with the sketch's bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, PLACES)
            tree = batch.column("tree").to_numpy().astype(np.uint64)
            path, at = _mixed(tree * _B + np.uint64(1)), np.arange(len(sig))
            for _ in range(depth):
                token = sig[at, (path >> np.uint64(40)) % np.uint64(PLACES)].astype(np.uint64)
                path = _mixed(path * _B + token + np.uint64(1))
            bits = np.packbits((sig & np.uint32(1)).astype(bool), axis=1)
            cols = [batch.column("tree"), pa.array(path.view(np.int64)), batch.column("key"), pa.array([x.tobytes() for x in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=_NODE)

    return rows


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each item's component under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _smallest(label: np.ndarray, key: list[bytes], order: np.ndarray) -> np.ndarray:
    """``label`` with the smallest key of each component as its name, so that no set has many smaller neighbours."""
    ranked = np.array(sorted(range(len(order)), key=lambda k: key[order[k]]), np.int64)
    place = np.empty(len(order), np.int64)
    place[ranked] = np.arange(len(order))
    first = np.full(len(order), len(order), np.int64)
    np.minimum.at(first, label, place)
    return ranked[first[label]] if len(order) else label


def _likely(least: int):
    """Leaves of one bucket, compared exhaustively on sketches: a forest of likely links."""

    def rows(table: pa.Table) -> pa.Table:
        key = table.column("key").to_pylist()
        node, bits = table.column("node").to_numpy(), np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, 2)
        order = np.argsort(node, kind="stable")
        node, bits = node[order], bits[order]
        n = len(node)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, n))
        left = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows of the same node that follow
        small = np.repeat(sizes, sizes) <= 64
        ones, others = [], []

        def alike(i, j):
            return np.bitwise_count(bits[i] ^ bits[j]).sum(-1) <= 2 * 64 - least

        at = np.flatnonzero(small & (left > 0))
        step = 1
        while len(at):
            good = at[alike(at, at + step)]
            ones.append(good)
            others.append(good + step)
            step += 1
            at = at[left[at] >= step]
        for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
            block = bits[start : start + size]
            label = np.arange(size)
            for k in range(0, size, 128):
                if not label.any():
                    break  # all of them hang together
                far = np.bitwise_count(block[k : k + 128, None, :] ^ block[None, :, :]).sum(-1)
                i, j = np.nonzero(far <= 2 * 64 - least)
                i = i + k
                apart = (i < j) & (label[i] != label[j])
                label = _labels(size, np.concatenate([np.arange(size), i[apart]]), np.concatenate([label, j[apart]]))
            ones.append(np.flatnonzero(label != np.arange(size)) + start)
            others.append(label[ones[-1] - start] + start)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, others))
        label = _smallest(_labels(n, a, b), key, order)
        far = np.flatnonzero(label != np.arange(n))
        u, v = order[label[far]], order[far]
        return pa.table([pa.array([key[i] for i in u], pa.binary()), pa.array([key[i] for i in v], pa.binary())], schema=_EDGE)

    return rows


def _full_sets(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(x.as_py(), size, index) for x in batch.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=_SET)
        index.clear()
        give_back()

    return rows


def exact_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest member of each set's component; every pair not yet connected is judged in full."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    starts = np.searchsorted(inverse[order], np.arange(len(values) + 1))
    ends, label = np.cumsum(sizes), np.arange(n)
    for i in range(n - 1):
        if not label.any():
            break
        mine = inverse[ends[i] - sizes[i] : ends[i]]
        a, m = starts[mine], starts[mine + 1] - starts[mine]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))
        both = np.bincount(posting[at], minlength=n)
        link = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (label != label[i]))
        if len(link):
            old = np.unique(np.append(label[link], label[i]))
            label[np.isin(label, old)] = old[0]
    return label


def _judge(percent: int):
    """Clusters of one bucket, or two blocks of a large cluster: true links as a forest."""

    def rows(table: pa.Table) -> pa.Table:
        u, v = [], []
        by: dict[bytes, dict[bytes, np.ndarray]] = defaultdict(dict)
        for cluster, key, blob in zip(table.column("cluster").to_pylist(), table.column("key").to_pylist(), table.column("shingles").to_pylist()):
            by[cluster][key] = np.frombuffer(blob, np.uint64)
        for held in by.values():
            keys = sorted(held)
            label = exact_labels([held[k] for k in keys], percent)
            for k in np.flatnonzero(label != np.arange(len(keys))).tolist():
                u.append(keys[label[k]])
                v.append(keys[k])
        return pa.table([pa.array(u, pa.binary()), pa.array(v, pa.binary())], schema=_EDGE)

    return rows


def _judge_links(percent: int):
    """The likely links (u, v, with both sets) that hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], schema=_EDGE).filter(pa.array(good, pa.bool_()))

    return rows


def buckets_for(spark: SparkSession, per_partition: int, amount: int, most: int) -> int:
    """Hash buckets for an amount of rows or values of which a bucket shall hold about ``most``: as many as the data needs."""
    return max(buckets(spark, per_partition), -(-amount // most))


def _bucket(of: str, n: int):
    return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")


def _in_blocks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Every two blocks of each large group once: rows with ``pair``, each block of at most about ``size``.

    ``rows`` has ``size_of``, the number of rows of its group.
    """
    n = F.ceil(F.col("size_of") / F.lit(size)).cast("long")
    dealt = rows.withColumn("__n", n).withColumn("__block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("__n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__other")
    met = dealt.select("*", other)
    pair = F.concat_ws(":", F.least("__block", "__other").cast("string"), F.greatest("__block", "__other").cast("string"))
    return met.select(*rows.columns, F.xxhash64(group, pair).alias("pair"))


def trees_for(percent: int, miss: float = MISS, depth: int = 2) -> int:
    """Trees so that a pair at the threshold that must share ``depth`` branchings is missed at most so often.

    A pair that is lost shared no node at some depth from 2 on; each depth has half of the one before, ``miss`` in all.
    """
    return math.ceil(math.log(miss / 2 ** (depth - 1)) / math.log(1 - (percent / 100) ** depth))


def sketch_bits_for(percent: int) -> int:
    """Equal sketch bits that a pair at the threshold has but for chances of 7 deviations."""
    p = (1 + percent / 100) / 2
    return math.floor(PLACES * p - 7 * math.sqrt(PLACES * p * (1 - p)))


def likely_links(sets: DataFrame, percent: int, trees: int, leaf: int, deepest: int) -> DataFrame:
    """u, v: likely links among distinct sets (key, sig), found by all trees; ``trees`` holds down to depth 2."""
    spark = sets.sparkSession
    rows = sets.count() * trees
    judged = _likely(sketch_bits_for(percent))
    open_ = sets.select("key", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    found = None
    for depth in range(1, deepest + 1):
        placed = open_.mapInArrow(_walk(depth), _sql(_NODE))
        large = materialize(placed.groupBy("node").agg(F.count("*").alias("size_of")).where(F.col("size_of") > leaf), "paths-large")
        leaves = placed.join(large, "node", "left_anti")
        n = buckets_for(spark, 2, rows, NODE_ROWS)
        made = leaves.withColumn("bucket", _bucket("node", n)).groupBy("bucket").applyInArrow(_without_bucket(judged), _sql(_EDGE))
        found = made if found is None else found.unionByName(made)
        if large.isEmpty():
            return found
        if depth == deepest:
            rest = _in_blocks(placed.join(large, "node"), "node", leaf).drop("size_of", "node").withColumnRenamed("pair", "node")
            return found.unionByName(rest.select("tree", "node", "key", "bits").groupBy("node").applyInArrow(judged, _sql(_EDGE)))
        kept = materialize(placed.join(large, "node", "left_semi").select("tree", "key"), "paths-open")
        deeper = trees_for(percent, depth=depth + 1)
        if depth > 1 and deeper > trees:
            kept = kept.unionByName(kept.select("key").distinct().select(F.explode(F.sequence(F.lit(trees), F.lit(deeper - 1))).alias("tree"), "key"))
            trees = deeper
        rows = kept.count()
        open_ = kept.join(sets, "key").select("key", "sig", "tree")
    return found


def _without_bucket(judged):
    def rows(table: pa.Table) -> pa.Table:
        return judged(table.drop_columns(["bucket"]))

    return rows


def links(docs: DataFrame, sketches: DataFrame, size: int, percent: int, trees: int | None = None, leaf: int = LEAF, deepest: int = DEEPEST, cluster: int = CLUSTER) -> DataFrame:
    """node, label: the component of every distinct set that is linked with another."""
    spark = docs.sparkSession
    sets = sketches.where("n > 0").dropDuplicates(["key"]).select("key", "sig")
    likely = written_edges(likely_links(sets, percent, trees or trees_for(percent), leaf, deepest))
    rough = components(likely, written=True).select(F.col("node").alias("key"), F.col("label").alias("cluster"))
    own = F.min(F.when(F.col("id") != NO_ID, F.col("id")))
    named = materialize(sketches.where("n > 0").groupBy("key").agg(F.coalesce(own, F.lit(NO_ID)).alias("id"), F.max("n").alias("n")).join(rough, "key"), "near-named")
    # Written, so that the join's members come straight from their own exchange and a large cluster's can be split.
    sizes = materialize(named.groupBy("cluster").agg((F.count("*") <= cluster).alias("few"), F.sum("n").alias("weight")).select("cluster", (F.col("few") & (F.col("weight") <= CLUSTER_SHINGLES)).alias("small"), "weight"), "near-sizes")
    wanted = materialize(named.join(sizes.select("cluster", "small"), "cluster"), "near-wanted")
    weight = sizes.where("small").agg(F.sum("weight")).first()[0] or 0

    def fetched(part: DataFrame) -> DataFrame:
        """key, shingles and cluster of the wanted sets, from one text each."""
        ids = part.select("id").distinct()
        if ids.count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")
        full = texts.select("text").mapInArrow(_full_sets(size), _sql(_SET))
        return full.join(part.select("key", "cluster"), "key").dropDuplicates(["key"])

    small = fetched(wanted.where("small")).withColumn("bucket", _bucket("cluster", buckets_for(spark, 4, weight, BUCKET_SHINGLES)))
    judged = _judge(percent)
    edges = small.groupBy("bucket").applyInArrow(lambda t: judged(t), _sql(_EDGE))
    if not sizes.where("NOT small").isEmpty():
        large = materialize(fetched(wanted.where("NOT small")).select("key", "shingles", "cluster"), "near-large")
        edges = edges.unionByName(_large_edges(large, likely, percent, max(1, cluster // 2)))
    return components(edges)


def _large_edges(large: DataFrame, likely: DataFrame, percent: int, size: int) -> DataFrame:
    """True links of the large clusters (key, shingles, cluster), which join what belongs together.

    The likely links are judged one by one; parts that they leave apart meet in blocks of about ``size`` sets.
    A part of as many sets has blocks of its own, smaller ones share blocks; two blocks of the same part do not meet.
    """
    ends = [large.select(F.col("key").alias(k), F.col("shingles").alias(s)) for k, s in (("u", "a"), ("v", "b"))]
    true = materialize(likely.join(ends[0], "u").join(ends[1], "v").select("u", "v", "a", "b").mapInArrow(_judge_links(percent), _sql(_EDGE)), "near-true")
    label = components(true).select(F.col("node").alias("key"), F.col("label").alias("part"))
    # A set counts as one, and as more where it has more shingles than a block of such sets may hold.
    share = F.greatest(F.lit(1.0), F.length("shingles") / 8 / (CLUSTER_SHINGLES / 2 / size)).alias("share")
    placed = materialize(large.select("key", "cluster", share).join(label, "key", "left").select("key", "cluster", "share", F.coalesce("part", "key").alias("part")), "near-parts")
    parts = placed.groupBy("cluster", "part").agg(F.sum("share").alias("n"))
    few = F.col("n") < size
    whole = parts.groupBy("cluster").agg(F.count("*").alias("n_parts"), F.sum(F.when(few, F.col("n")).otherwise(0)).alias("n_few"))
    apart = materialize(whole.where("n_parts > 1"), "near-apart")
    if apart.isEmpty():
        return true
    blocks = materialize(parts.join(apart, "cluster").select("cluster", "part", few.alias("few"), F.ceil(F.when(few, F.col("n_few")).otherwise(F.col("n")) / F.lit(size)).cast("long").alias("n_blocks")), "near-blocks")
    own = F.concat(F.lit("own:"), F.hex("part"), F.lit(":"), F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("string"))
    shared = F.concat(F.lit("few:"), F.pmod(F.xxhash64("part"), F.col("n_blocks")).cast("string"))
    rows = placed.join(blocks, ["cluster", "part"]).select("key", "cluster", F.when(F.col("few"), shared).otherwise(own).alias("block"), F.when(~F.col("few"), F.col("part")).alias("pure"))
    rows = materialize(rows, "near-dealt")
    named = rows.select("cluster", "block", "pure").distinct()
    other = named.select("cluster", F.col("block").alias("other"), F.col("pure").alias("other_pure"))
    # Blocks, of which there is one for some thousand sets, are paired; sets are not.
    met = named.join(other, "cluster").where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("pure") == F.col("other_pure"), F.lit(False)))
    pair = F.xxhash64("cluster", "block", "other").alias("pair")
    sides = met.select("cluster", F.explode(F.array_distinct(F.array("block", "other"))).alias("block"), pair)
    sets = rows.select("key", "cluster", "block").join(sides, ["cluster", "block"]).join(large.select("key", "shingles"), "key")
    judged = _judge(percent)
    return true.unionByName(sets.select("cluster", "key", "shingles", "pair").groupBy("pair").applyInArrow(lambda t: judged(t), _sql(_EDGE)))


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _mark():
    """A digest of the text: with the id it names a row but for repeats. A null text has an empty one."""
    return F.coalesce(F.unhex(F.md5(F.col("text").cast("string").cast("binary"))), F.lit(b""))


def sketched(docs: DataFrame, size: int, marked: bool = False) -> DataFrame:
    """id, mark (null unless asked for), n, key and sig of every row."""
    mark = _mark() if marked else F.lit(None).cast("binary")
    rows = docs.select(_id().alias("id"), mark.alias("mark"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_sketch(size), _sql(_SKETCH)), "near-sketches")


def _labelled(docs: DataFrame, sketches: DataFrame, size: int, percent: int, **options) -> DataFrame:
    """id, mark, n and label (component) of every row with words."""
    linked = links(docs, sketches, size, percent, **options)
    rows = sketches.where("n > 0").select("id", "mark", "n", "key")
    return rows.join(linked.select(F.col("node").alias("key"), "label"), "key", "left").select("id", "mark", "n", F.coalesce("label", "key").alias("label"))


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    sketches = sketched(docs, size)
    whole = materialize(_labelled(docs, sketches, size, percent, **options).drop("mark"), "near-labels")
    # The smallest id per component from one row per component and task; written, so that the join can split a large one.
    least = materialize(whole.groupBy("label").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("component_id")), "near-least")
    real = F.when(F.col("id") != NO_ID, F.col("id"))
    found = whole.join(least, "label").select(real.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    found = found.unionByName(sketches.where("n = 0").select(real.alias("doc_id"), F.col("n").alias("n_shingles"), real.alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """One document of each component, with all its columns, whatever its id."""
    sketches = sketched(docs, size, marked=True)
    best = F.min(F.struct((F.col("id") == NO_ID).alias("none"), "id", "mark")).alias("best")
    kept = _labelled(docs, sketches, size, percent, **options).groupBy("label").agg(best).select("best.id", "best.mark")
    wordless = sketches.where((F.col("n") == 0) & (F.col("id") != NO_ID)).select("id", "mark").distinct()
    kept = materialize(kept.unionByName(wordless).toDF("__id", "__mark"), "near-kept")
    rows = docs.select(F.struct("*").alias("__row"), _id().alias("__id"), _mark().alias("__mark"))
    # Equality on the same two columns, so that the texts are dealt once for the join and for the repeats.
    held = rows.join(kept, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"])
    unnamed = rows.where((F.col("__id") == NO_ID) & ~F.coalesce(F.col("__row.text").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    return held.unionByName(unnamed).select("__row.*")
