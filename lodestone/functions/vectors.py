"""Vector expressions on double arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is null or has no length."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def unit(a: Column) -> Column:
    # The vector and its norm are bound as elements of arrays: inside the inner lambda they would be worked out again for each component.
    scaled = lambda y: F.transform(y.v, lambda x: F.when(y.size > 0, x.cast("double") / y.size).otherwise(0.0))
    sized = lambda v: F.get(F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("size"))), scaled), F.lit(0))
    return F.get(F.transform(F.array(a), sized), F.lit(0))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance of the unit vectors."""
    return F.lit(2.0) - F.lit(2.0) * cosine(a, b)


def same_within(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return (F.size(a) == F.size(b)) & F.forall(gaps, lambda d: d <= tolerance)


def is_valid(a: Column, longer_than: int = 15) -> Column:
    return a.isNotNull() & (F.size(a) > longer_than)


def _pack(vectors: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.array([np.nan if x is None else x for x in v], "<f4").tobytes() for v in vectors.to_pylist()], pa.binary())


def _unpack(blobs: pa.Array) -> pa.Array:
    return pa.array([None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4") for b in blobs.to_pylist()], pa.list_(pa.float32()))


def pack(a: Column) -> Column:
    """Four bytes a component, little-endian single precision; a null component is NaN."""
    return arrow_udf(_pack, "binary")(a.cast("array<float>"))


def unpack(blob: Column) -> Column:
    """The vector of ``pack``; bytes past the last whole component are left out."""
    return arrow_udf(_unpack, "array<float>")(blob)
