"""Shared folder, written tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import shared_dir

#: Words of a text: runs of anything but ASCII white space.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Scratch paths and tables of this driver, in the order in which they were made.
_MADE: list[tuple[str | None, str | None]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((path, None))
    system, target = _file_system(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later plan reads."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def made_so_far() -> int:
    return len(_MADE)


def discard(spark: SparkSession, since: int, keep: int) -> None:
    """Delete the scratch made from place ``since`` up to ``keep``, which no later plan reads: files, and tables of the catalog."""
    for path, name in _MADE[since:keep]:
        if name is not None:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        if path is not None:
            remove(spark, path)
    del _MADE[since:keep]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, path: str | None = None, dealt: bool = False) -> DataFrame:
    """As ``materialize``, dealt by ``key`` at writing: a later step by ``key`` reads it without a shuffle.

    With ``dealt`` rows are shuffled by ``key`` first, so a bucket is one file; without, every task writes its own.
    """
    spark = df.sparkSession
    path, name = path or f"{scratch(spark, name)}/rows", f"{name}_{uuid.uuid4().hex}"
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.repartition(n, key) if dealt else df
    _MADE.append((None, name))
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the shared folder, there as a whole or not at all."""
    system, at = _file_system(spark, path)
    _, partial = _file_system(spark, f"{path}.partial")
    out = system.create(partial, True)
    out.write(text.encode("utf-8"))
    out.close()
    if not system.rename(partial, at):
        raise OSError(f"cannot write {path}")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """File names in a folder of the shared file system; none where there is no folder."""
    system, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(at)) if system.exists(at) else []


def buckets(spark: SparkSession, per_partition: int = 1, least: int = 64) -> int:
    """How many hash buckets to deal work into: follows the session's shuffle partitions."""
    return max(least, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers live on, idle, through stages that need none."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
