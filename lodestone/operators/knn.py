"""A k-nearest join: the most similar rows of a table for every row of a table of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions that meet a block of candidates at once, and bytes of such a block.
QUESTION_BLOCK, CANDIDATE_BYTES = 256, 8 << 20
#: Questions, and bytes of their vectors, that are sent to every executor at a time. They stand beside every block of
#: candidates, so they are fewer than those.
PASS_QUESTIONS, PASS_BYTES = 16_384, 4 << 20
#: By so much a product of blocks may differ from the exact similarity.
SLACK = 1e-9


def _units(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _pack(most: int, key: pa.DataType):
    """Rows to blocks of one dimension and about so many bytes each: keys, and the vectors in one matrix."""
    schema = pa.schema([("dim", pa.int32()), ("keys", pa.list_(key)), ("vectors", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            keys, vectors = zip(*held.pop(dim))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([list(keys)], schema.field("keys").type), pa.array([np.stack(vectors).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for k, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
                held.setdefault(len(got), []).append((k, got))
                if 8 * len(got) * len(held[len(got)]) >= most:
                    yield block(len(got))
        for dim in list(held):
            yield block(dim)

    return rows


def _best(similarity: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k most similar, ties by key."""
    order = np.argsort(keys, kind="stable")
    return order[np.argsort(-similarity[order], kind="stable")][:k]


def nearest_in_blocks(q: np.ndarray, c: np.ndarray, keys: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per question its best k similarities in a block and their keys; those below what it has already (``least``) may be left out.

    One product of the blocks says which rows can matter; their similarity is then taken row by row, so that equal
    vectors have equal similarities wherever they stand.
    """
    near = _units(q) @ _units(c).T
    if near.shape[1] > k:
        least = np.maximum(least, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
    for r in range(len(q)):
        at = np.flatnonzero(near[r] >= least[r] - SLACK)
        size = np.sqrt((q[r] ** 2).sum()) * np.sqrt((c[at] ** 2).sum(axis=1))
        exact = np.divide((c[at] * q[r]).sum(axis=1), size, out=np.zeros(len(at)), where=size > 0)
        best = _best(exact, keys[at], k)
        yield r, exact[best], keys[at[best]]


def _meet(k: int, key: pa.DataType):
    schema = pa.schema([("query_id", pa.int64()), ("key", key), ("similarity", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # each question's best k of all blocks that the task saw
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                asked = np.frombuffer(row["asked"], np.float64).reshape(-1, row["dim"])
                c = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
                keys = np.array(row["keys"], np.int64 if pa.types.is_integer(key) else object)
                for first in range(0, len(asked), QUESTION_BLOCK):
                    q, ids = asked[first : first + QUESTION_BLOCK], row["ids"][first : first + QUESTION_BLOCK]
                    least = np.array([heaps[i][0][-1] if i in heaps and len(heaps[i][0]) == k else -np.inf for i in ids])
                    for r, similarity, found in nearest_in_blocks(q, c, keys, k, least):
                        i = ids[r]
                        if i in heaps:
                            similarity, found = np.append(heaps[i][0], similarity), np.append(heaps[i][1], found)
                            best = _best(similarity, found, k)
                            similarity, found = similarity[best], found[best]
                        heaps[i] = similarity, found
        for first in range(0, len(heaps), 1024):
            part = list(heaps.items())[first : first + 1024]
            ids = np.repeat([i for i, _ in part], [len(s) for _, (s, _) in part])
            cols = [pa.array(ids, pa.int64()), pa.array(np.concatenate([f for _, (_, f) in part]).tolist(), key), pa.array(np.concatenate([s for _, (s, _) in part]), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return rows


def nearest_many(data: DataFrame, questions: DataFrame, k: int, key: str, vector: str = "embedding", n_questions: int | None = None) -> DataFrame:
    """query_id, ``key``, similarity and rank (from 1) of the k rows most similar to each question, ties by ``key``.

    ``questions`` has query_id (long, unique) and vector. Questions go to the executors in passes of a bounded
    size and meet the blocks of candidates where they are read: no candidate is shuffled. A task keeps a heap for each question, and
    a ranked window merges what the tasks kept. ``n_questions`` saves a count where it is known, at least roughly.

    Rows without a key or a vector, or with a null component, are no candidates; a question meets the vectors of its own
    dimension; a vector without a length is similar to nothing (0). Questions without a vector have no rows.
    """
    whole = dict(data.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    kind, arrow = ("long", pa.int64()) if whole else ("string", pa.string())
    listed = lambda c: F.col(c).cast("array<double>")
    good = lambda df, c: df.where(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()))
    rows = good(data.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("key"), listed(vector).alias("v")), "v")
    blocks = rows.mapInArrow(_pack(CANDIDATE_BYTES, arrow), f"dim int, keys array<{kind}>, vectors binary")
    asked = good(questions.select(F.col("query_id").cast("long").alias("query_id"), listed("vector").alias("v")), "v")
    n_questions = asked.count() if n_questions is None else n_questions
    widest = asked.agg(F.max(F.size("v"))).first()[0] or 1
    per_pass = max(1, min(PASS_QUESTIONS, PASS_BYTES // (8 * widest)))
    passes = max(1, -(-n_questions // per_pass))
    dealt = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(passes)).alias("pass"), "query_id", "v")

    def one_pass(nth: int) -> DataFrame:
        part = dealt.where(F.col("pass") == nth).groupBy("pass").applyInArrow(_asked, "dim int, ids array<long>, asked binary")
        return blocks.join(F.broadcast(part), "dim").mapInArrow(_meet(k, arrow), f"query_id long, key {kind}, similarity double")

    met = reduce(DataFrame.unionAll, [one_pass(nth) for nth in range(passes)])
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def _asked(questions: pa.Table) -> pa.Table:
    """The questions of a pass, by dimension."""
    by_dim: dict[int, list] = {}
    for i, v in zip(questions.column("query_id").to_pylist(), questions.column("v").to_pylist()):
        by_dim.setdefault(len(v), []).append((i, v))
    return pa.table({
        "dim": pa.array(by_dim, pa.int32()),
        "ids": pa.array([[i for i, _ in held] for held in by_dim.values()], pa.list_(pa.int64())),
        "asked": pa.array([np.array([v for _, v in held], np.float64).tobytes() for held in by_dim.values()], pa.binary()),
    })
