"""Exact top-k inner products by columnar branch and bound.

Candidates are packed into blocks, written once; queries into smaller blocks.
Within a block vectors lie dimension by dimension (vertical layout). Scores
accumulate one block of dimensions at a time, dimensions of most energy first.
After each, a candidate stays only while, for some query of the block, its
partial score plus the most that the remaining dimensions can add (product of
the remaining norms) reaches the query's k-th best lower bound: partial score
minus that mass, the k-th best score among a bounded sample of candidates
(``SEED_ROWS``, asked first), or the k-th best of the blocks that the task saw
before. Survivors are compacted before the next block of dimensions; as soon as
a query has few of them it goes on alone with its own. Bounds are widened by
more than the rounding error of floating point, and final scores are exact
integers, so nothing is lost.

Query blocks go to the executors in passes of ``PASS_BYTES`` at most, and in a
pass every candidate block meets every query block of it where it is read: no
candidate is moved, and the candidates are read once a pass. The work is queries
times candidates by its nature. A pair of blocks gives at most k rows a query;
the best k of a query come from a ranked window over those.

Defined results: vectors that are null or hold null or non-finite components
take no part; a query is compared with candidates of its own dimension; ties go
to the smaller vec_id; repeated rows are candidates of their own, while a query
id is asked once (with the smallest of its vectors); the query's own rows are
excluded by their vec_id; rows with a null vec_id take no part; an
empty vector scores 0; a vector whose scaled components overflow a double takes
no part; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

QUERY_BLOCK, CANDIDATE_BLOCK, DIM_BLOCK = 256, 4096, 8
#: Candidates (by a hash of vec_id) whose exact scores give every query a first bound.
SEED_ROWS = 4096
#: Bytes of query blocks that are sent to every executor at a time; one block at least.
PASS_BYTES = 64 << 20
#: One candidate in so many is looked at to see whether the bounds drop any yet.
PROBE = 16
#: Integer scores below this are exact in doubles.
EXACT = 2.0**52
LONG = 2**63 - 1

_BLOCK = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
_ASKS = pa.schema([("q_block", pa.int64()), ("dim", pa.int32()), ("q_ids", pa.binary()), ("q_values", pa.binary())])
_SEEDED = pa.schema([*_ASKS, ("q_known", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _columns(vectors: list[np.ndarray]) -> bytes:
    """Vectors dimension by dimension; single precision where it holds every value."""
    values = np.ascontiguousarray(np.stack(vectors).T)
    return (values.astype(np.float32) if np.abs(values).max(initial=0.0) < 2**24 else values).tobytes()


def _matrix(blob: bytes, dim: int, n: int) -> np.ndarray:
    kind = np.float32 if len(blob) < 8 * dim * n else np.float64
    return np.frombuffer(blob, kind).reshape(dim, n).astype(np.float64)


def _pack(size: int, scale: float):
    """Vectors to blocks of one dimension each: ids, and floor(scale * x) by dimension."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(dim))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[dim], [np.array(ids, np.int64).tobytes()], [_columns(vectors)]], _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
                with np.errstate(over="ignore"):
                    scaled = np.floor(scale * got)
                if not np.isfinite(scaled).all():
                    continue
                held.setdefault(len(got), []).append((vec_id, scaled))
                if len(held[len(got)]) >= size:
                    yield block(len(got))
        for dim in list(held):
            yield block(dim)

    return rows


def _pack_queries(scale: float):
    """The queries of one block, by dimension."""

    def rows(key, asked):
        by_dim: dict[int, list] = {}
        for vec_id, vector in zip(asked.column("vec_id").to_pylist(), asked.column("embedding").to_pylist()):
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * np.array(vector, np.float64))
            if np.isfinite(scaled).all():
                by_dim.setdefault(len(vector), []).append((vec_id, scaled))
        out = [(key[0].as_py(), dim, np.array([i for i, _ in held], np.int64).tobytes(), _columns([v for _, v in held])) for dim, held in by_dim.items()]
        return pa.table([pa.array([r[n] for r in out], f.type) for n, f in enumerate(_ASKS)], schema=_ASKS)

    return rows


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def block_top_k(q_ids, q, c_ids, c, k: int, dim_block: int = DIM_BLOCK, known=None, kept: list | None = None):
    """(query row, candidate row, score) of each query's best k; ``q`` and ``c`` are dimension by row.

    ``known`` has a score per query that k other candidates reach; those below it may be left out. ``kept`` takes
    the share of all products (queries times candidates) that is done in each block of dimensions.
    """
    dims, n_q = q.shape
    largest = (np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0)) * max(dims, 1)
    if largest >= EXACT:
        return _exact_top_k(q_ids, q, c_ids, c, k)
    known = np.full(n_q, -np.inf) if known is None else known
    # Dimensions of most energy first: scores settle early and little mass remains.
    order = np.argsort(-((q**2).sum(1) * (c**2).sum(1)), kind="stable")
    q, c = q[order], c[order]
    edges = list(range(0, dims, dim_block)) + [dims]
    # Remaining mass after each block of dimensions: norms of what is left.
    q_left, c_left = ([np.sqrt((x[b:] ** 2).sum(0)) for b in edges[1:]] for x in (q, c))
    alive, partial = np.arange(len(c_ids)), np.zeros((n_q, len(c_ids)))
    own = {int(i): r for r, i in enumerate(q_ids)}
    mine = [(own[i], x) for x, i in enumerate(c_ids.tolist()) if i in own]
    alone = None
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        if alone is None:
            partial += q[a:b].T @ c[a:b][:, alive]
            if kept is not None:
                kept.append(len(alive) / max(1, len(c_ids)))
        else:
            for r, (at, p) in enumerate(alone):
                alone[r] = (at, p + q[a:b, r] @ c[a:b][:, at])
            if kept is not None:
                kept.append(sum(len(at) for at, _ in alone) / max(1, n_q * len(c_ids)))
        if b == dims:
            break
        if alone is not None:
            alone = [_compacted(at, p, _widened(q_left[n][r] * c_left[n][at]), c_ids, q_ids[r], k, known[r]) for r, (at, p) in enumerate(alone)]
        elif len(alive) > 4 * k:
            # A few candidates tell whether the bounds drop any yet.
            if np.isfinite(known).all() and _stays(partial[:, ::PROBE], q_left[n], c_left[n][alive[::PROBE]], known).mean() > 0.75:
                continue
            floor = known
            if not np.isfinite(known).all():
                low = partial - _widened(q_left[n][:, None] * c_left[n][alive][None, :])
                for r, x in mine:
                    low[r, np.flatnonzero(alive == x)] = -np.inf
                floor = np.maximum(np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k], known)
            stay = _stays(partial, q_left[n], c_left[n][alive], floor)
            if stay.mean() < 0.5:
                alone = [(alive[s], p[s]) for s, p in zip(stay, partial)]
            elif (union := stay.any(0)).mean() < 0.75:
                alive, partial = alive[union], np.ascontiguousarray(partial[:, union])
    out = []
    for r in range(n_q):
        at, p = alone[r] if alone is not None else (alive, partial[r])
        other = np.flatnonzero(c_ids[at] != q_ids[r])
        best = other[_best(p[other], c_ids[at[other]], k)]
        out.append((np.full(len(best), r), at[best], np.rint(p[best]).astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _stays(partial, q_left, c_left, floor) -> np.ndarray:
    """Which candidates can still reach each query's bound."""
    return partial + _widened(q_left[:, None] * c_left[None, :]) >= floor[:, None]


def _widened(left: np.ndarray) -> np.ndarray:
    return left * (1 + 1e-9) + 1e-6


def _compacted(at, p, left, c_ids, q_id, k: int, known: float):
    """The candidates that one query still needs, with their partial scores."""
    if len(at) > 4 * k:
        low = np.where(c_ids[at] != q_id, p - left, -np.inf)
        known = max(known, np.partition(low, len(low) - k)[len(low) - k])
    stay = p + left >= known
    return at[stay], p[stay]


def _exact_top_k(q_ids, q, c_ids, c, k: int):
    """Components too large for doubles: whole integers, scores held within a long."""
    big_q, big_c = [[int(x) for x in v] for v in q.T], [[int(x) for x in v] for v in c.T]
    rows = []
    for r, v in enumerate(big_q):
        scored = sorted((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(v, w)))), int(c_ids[x]), x) for x, w in enumerate(big_c) if c_ids[x] != q_ids[r])
        rows += [(r, x, -s) for s, _, x in scored[:k]]
    return [np.array(x, np.int64) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3


def _meet(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # each query's best k scores of the blocks before, lowest first
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                seed = np.frombuffer(row["q_known"], np.float64)
                known = np.array([max(s, best[i][0]) if i in best and len(best[i]) == k else s for i, s in zip(q_ids.tolist(), seed)], np.float64)
                r, x, score = block_top_k(q_ids, _matrix(row["q_values"], row["dim"], len(q_ids)), c_ids, _matrix(row["vectors"], row["dim"], len(c_ids)), k, known=known)
                ends = np.searchsorted(r, np.arange(len(q_ids) + 1))
                for y, i in enumerate(q_ids.tolist()):
                    best[i] = np.sort(np.append(best.get(i, np.zeros(0, np.int64)), score[ends[y] : ends[y + 1]]))[-k:]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(c_ids[x]), pa.array(score)], schema=_FOUND)

    return rows


def _seed(k: int):
    """Query blocks with each query's k-th best score in the sample block of their dimension, or minus infinity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                known = np.full(len(q_ids), -np.inf)
                if row["ids"] is not None:
                    c_ids = np.frombuffer(row["ids"], np.int64)
                    r, _, score = block_top_k(q_ids, _matrix(row["q_values"], row["dim"], len(q_ids)), c_ids, _matrix(row["vectors"], row["dim"], len(c_ids)), k)
                    ends = np.searchsorted(r, np.arange(len(q_ids) + 1))
                    for y in np.flatnonzero(np.diff(ends) == k):
                        known[y] = score[ends[y] : ends[y + 1]].min()
                cols = [[row["q_block"]], [row["dim"]], [row["q_ids"]], [row["q_values"]], [known.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, _SEEDED)], schema=_SEEDED)

    return rows


_ASKS_SQL = "q_block long, dim int, q_ids binary, q_values binary"
_BLOCK_SQL = "dim int, ids binary, vectors binary"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, seed_rows: int = SEED_ROWS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's best k other rows."""
    vector = F.col("embedding").cast("array<double>")
    # Before queries are grouped: a vector that takes no part must not stand for its id. NaN is greater than infinity here.
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x * F.lit(float(scale))) < F.lit(float("inf")), F.lit(False)))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), is_query.alias("__query"))
    queries = good.where("__query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_blocks = max(1, -(-queries.count() // query_block))
    dealt = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("q_block"))
    asks = dealt.groupBy("q_block").applyInArrow(_pack_queries(scale), _ASKS_SQL)
    held = materialize(good.select("vec_id", "embedding").mapInArrow(_pack(candidate_block, scale), _BLOCK_SQL), "topk-blocks")
    # At most seed_rows vectors, so one block a dimension.
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(seed_rows).select("vec_id", "embedding").mapInArrow(_pack(seed_rows, scale), _BLOCK_SQL)
    asks = materialize(asks.join(F.broadcast(sample), "dim", "left").select(*(f.name for f in _ASKS), "ids", "vectors").mapInArrow(_seed(k), _ASKS_SQL + ", q_known binary"), "topk-queries")
    size = asks.groupBy("q_block").agg(F.sum(F.length("q_values") + 2 * F.length("q_ids")).alias("size")).agg(F.max("size")).first()[0] or 1
    per_pass = max(1, pass_bytes // size)
    found = None
    for first in range(0, n_blocks, per_pass):
        part = asks.where((F.col("q_block") >= first) & (F.col("q_block") < first + per_pass))
        ranked = _ranked(held.join(F.broadcast(part), "dim").drop("q_block").mapInArrow(_meet(k), "query_id long, vec_id long, score long"), k)
        if per_pass >= n_blocks:
            return ranked
        # Passes are written one by one: neither their plans nor their lineage add up.
        ranked = materialize(ranked, "topk-pass")
        found = ranked if found is None else found.unionByName(ranked)
    return found


def _ranked(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
