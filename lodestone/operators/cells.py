"""Cells that grow with the data: approximate nearest vectors with an exact re-rank.

There are about as many cells as the square root of the rows, in two levels: coarse
cells, and cells within each. Both levels are fitted by rounds of k-means in which
tasks add up their rows by cell and only the sums meet; a row is assigned by its
nearest coarse cell and the nearest cell within it, so a round costs about the fourth
root of the rows per row. What every task is sent, and the driver holds, is the centres,
bounded by ``CENTRE_BYTES``: beyond that cells get larger, not more.

A cell's vectors lie together in its coarse cell's folder, in pages of their own, and
beside them a code of one bit a dimension. A question reads the codes of its nearest
cells, ranks them by the sum of its components with the codes' signs, and reads the
vectors of the best few alone, whose exact similarity decides. How many cells are
asked is measured when the cells are fitted: the fewest that hold a share of ``recall``
of the exact neighbours of a sample of the rows.

Rows are appended to the cells they belong to; ``outgrown`` says when the cells should
be fitted again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import knn

CENTRE_BYTES = 64 << 20
#: Rows whose exact neighbours say how many cells are asked; candidates per neighbour that are read in full.
SAMPLE, RERANK = 400, 64


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return _unit(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def assigned(units: np.ndarray, coarse: np.ndarray, fine: np.ndarray | None) -> np.ndarray:
    """Cell of each unit vector: its nearest coarse cell, and there the nearest cell; ``fine`` is coarse by cell by dimension."""
    top = (units @ coarse.T).argmax(1)
    if fine is None:
        return top
    cell = np.empty(len(units), np.int64)
    for c in np.unique(top):
        at = np.flatnonzero(top == c)
        cell[at] = c * fine.shape[1] + (units[at] @ fine[c].T).argmax(1)
    return cell


def _sums(coarse: np.ndarray, fine: np.ndarray | None):
    """A task's sum of unit vectors by cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            units = _matrix(batch.column(0))
            cell = assigned(units, coarse, fine)
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            for c, part in zip(cell[order][first].tolist(), np.add.reduceat(units[order], first) if len(first) else []):
                total[c] = total[c] + part if c in total else part
        # Whole numbers, so that sums do not depend on the order of tasks.
        fixed = [np.rint(v * 2**32).astype(np.int64) for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array([v.tolist() for v in fixed], pa.list_(pa.int64()))], names=["cell", "total"])

    return rows


def _round(vectors: DataFrame, coarse: np.ndarray, fine: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """One round of spherical k-means of the deepest level; a cell without rows keeps its centre."""
    sums = vectors.mapInArrow(_sums(coarse, fine), "cell long, total array<long>").select("cell", F.posexplode("total").alias("d", "x")).groupBy("cell", "d").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e.x).alias("v")).collect()  # a row a cell
    level = (coarse if fine is None else fine).copy()
    flat = level.reshape(-1, level.shape[-1])
    for r in rows:
        flat[r.cell] = _unit(np.array(r.v, np.float64))
    return (level, None) if fine is None else (coarse, level)


@dataclass
class Cells:
    """Vectors by cell in a folder."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        shape = json.loads(self.spark.read.text(f"{self.path}/shape").first()[0])
        self.key, self.probes, self.fitted = shape["key"], shape["probes"], shape["rows"]
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("level", "cell").collect()
        self.coarse = np.array([r.centre for r in rows if r.level == 0])
        self.fine = np.array([r.centre for r in rows if r.level == 1]).reshape(len(self.coarse), -1, self.coarse.shape[1])

    @classmethod
    def fit(cls, data: DataFrame, path: str, key: str, vector: str = "embedding", k: int = 5, recall: float = 0.9, rounds: int = 4) -> Cells:
        """Fit cells on all rows and write them. Rows without a key, or with a vector that is null, of another dimension or without length, are left out."""
        spark = data.sparkSession
        listed = F.col(vector).cast("array<double>")
        dim = data.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0] or 1
        good = data.where(F.col(key).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull())).select(F.col(key).alias("key"), listed.alias("v"))
        good = good.where(F.exists("v", lambda x: x != 0))
        n = good.count()
        n_cells = max(1, min(math.isqrt(max(n, 1)), CENTRE_BYTES // (8 * dim)))
        n_coarse = max(1, math.isqrt(n_cells))
        n_fine = max(1, n_cells // n_coarse)
        first = good.orderBy(F.xxhash64("key"), "key").limit(n_coarse).select("v").collect()
        if not first:
            raise ValueError("there is no vector to fit cells on")
        coarse, vectors = _unit(np.array([r.v for r in first], np.float64)), good.select("v")
        for _ in range(rounds):
            coarse, _ = _round(vectors, coarse, None)
        begin = good.mapInArrow(_cells_of(coarse, None), _cell_sql(good)).withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("key"), "key")))
        fine = np.repeat(coarse[:, None, :], n_fine, axis=1)
        for r in begin.where(F.col("r") <= n_fine).collect():  # a row a cell
            fine[r.cell, r.r - 1] = _unit(np.array(r.v, np.float64))
        for _ in range(rounds):
            _, fine = _round(vectors, coarse, fine)
        centres = [(0, c, v.tolist()) for c, v in enumerate(coarse)] + [(1, c, v.tolist()) for c, v in enumerate(fine.reshape(-1, dim))]
        spark.createDataFrame(centres, "level int, cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
        shape = {"key": key, "rows": n, "probes": len(fine.reshape(-1, dim))}
        spark.createDataFrame([(json.dumps(shape),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/shape")
        cells = cls(spark, path)
        cells._add(good, "overwrite")
        cells.probes = shape["probes"] = cells._probes_for(good, k, recall)
        spark.createDataFrame([(json.dumps(shape),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/shape")
        return cells

    def append(self, data: DataFrame, vector: str = "embedding") -> None:
        """More rows, each to its cell; the centres stay."""
        dim = self.coarse.shape[1]
        good = data.where(F.col(self.key).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))
        good = good.select(F.col(self.key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        self._add(good.where(F.exists("v", lambda x: x != 0)), "append")

    def outgrown(self) -> bool:
        """Whether there are four times as many rows as the cells were fitted on."""
        return self.rows().count() > 4 * self.fitted

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def nearest(self, query: list[float], probes: int | None = None) -> list[int]:
        """The cells to ask, nearest first."""
        near = self.fine.reshape(-1, self.fine.shape[2]) @ np.asarray(query, np.float64)
        return np.argsort(-near, kind="stable")[: probes or self.probes].tolist()

    def candidates(self, query: list[float], k: int, probes: int | None = None, rerank: int = RERANK) -> list:
        """Keys of the rows whose vectors are read: the best ``rerank`` * k by their codes in the nearest cells."""
        cells = self.nearest(query, probes)
        near = self.rows().where(F.col("coarse").isin(sorted({c // self.fine.shape[1] for c in cells})) & F.col("cell").isin(cells))
        top = near.select("key", "cell", "code").mapInArrow(_by_code(np.asarray(query, np.float64), rerank * k), _key_sql(self.rows()) + ", cell int, likely double")
        return top.orderBy(F.desc("likely"), "key").limit(rerank * k).select("key", "cell").collect()

    def search(self, query: list[float], k: int = 5, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
        """``key`` and similarity of the k nearest rows, ties by key."""
        from lodestone.operators.search import top_k

        found = self.candidates(query, k, probes, rerank)
        rows = self.rows().where(F.col("coarse").isin(sorted({r["cell"] // self.fine.shape[1] for r in found})) & F.col("cell").isin(sorted({r["cell"] for r in found})) & F.col("key").isin([r["key"] for r in found]))
        return top_k(rows.select(F.col("key").alias(self.key), F.col("v").alias("embedding")), query, k, self.key).select(self.key, "similarity")

    def _add(self, good: DataFrame, mode: str) -> None:
        placed = good.mapInArrow(_cells_of(self.coarse, self.fine), _cell_sql(good)).withColumn("coarse", F.floor(F.col("cell") / self.fine.shape[1]).cast("int"))
        # Written in the order of cells and keys, in small pages: a filter on them skips the pages of all other rows.
        tidy = placed.repartition("coarse").sortWithinPartitions("coarse", "cell", "key")
        tidy.write.mode(mode).partitionBy("coarse").option("parquet.page.row.count.limit", 64).parquet(f"{self.path}/rows")

    def _probes_for(self, good: DataFrame, k: int, recall: float) -> int:
        """The fewest cells that hold the asked share (and a little more, as codes lose some) of the exact neighbours of a sample, a row itself left out."""
        rows = self.rows().select("key", "cell", "v")
        sample = rows.orderBy(F.xxhash64("key", F.lit(7)), "key").limit(SAMPLE).withColumn("query_id", F.monotonically_increasing_id())
        asked = [(r.query_id, r.key, np.array(r.v)) for r in sample.select("query_id", "key", "v").collect()]
        questions = self.spark.createDataFrame([(i, v.tolist()) for i, _, v in asked], "query_id long, vector array<double>")
        near = knn.nearest_many(rows.select("key", "v"), questions, k + 1, "key", "v", len(asked))
        held = near.join(rows.select("key", "cell"), "key").select("query_id", "key", "cell").collect()  # k + 1 rows a question
        flat, places = self.fine.reshape(-1, self.fine.shape[2]), []
        own = {i: (str(key), np.argsort(np.argsort(-(flat @ v), kind="stable"))) for i, key, v in asked}
        places = sorted(own[r.query_id][1][r.cell] for r in held if str(r.key) != own[r.query_id][0])
        return int(places[min(len(places) - 1, math.ceil(min(1.0, recall + 0.03) * len(places)))]) + 1 if places else len(flat)


def _key_sql(rows: DataFrame) -> str:
    return f"key {dict(rows.dtypes)['key']}"


def _cell_sql(rows: DataFrame) -> str:
    return f"{_key_sql(rows)}, v array<double>, cell int, code binary"


def _cells_of(coarse: np.ndarray, fine: np.ndarray | None):
    """Rows with their cell and the signs of their components."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _matrix(batch.column(1))
            codes = np.packbits(units > 0, axis=1)
            cols = [batch.column(0), batch.column(1), pa.array(assigned(units, coarse, fine), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "v", "cell", "code"])

    return rows


def _by_code(query: np.ndarray, most: int):
    """A task's best rows by the sum of the query's components, signed by the rows' codes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                likely = (2.0 * np.unpackbits(bits, axis=1, count=len(query)) - 1) @ query
                best = np.argsort(-likely, kind="stable")[:most]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(best)), batch.column(1).take(pa.array(best)), pa.array(likely[best])], names=["key", "cell", "likely"])

    return rows
