"""Incremental and data-quality operators: what is new, what differs, what repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return incoming.join(known.select(key), key, "left_anti")


#: Rows of a key, or of a key and a value, that are sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sent_if_few(rows: DataFrame) -> DataFrame:
    """``rows`` marked to be sent to every executor where their number allows it."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def told_apart(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key stands once, and the others (a null key with them); None where there are none.

    Keys alone are counted by shuffle; the rows stay where they are read unless very many keys stand more than once.
    """
    again = rows.groupBy(key).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) | F.col(key).isNull()).select(F.col(key).alias("__again"))
    if again.isEmpty():
        return rows, None
    again, same = sent_if_few(again), F.col(key).eqNullSafe(F.col("__again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def with_new_parts(wholes: DataFrame, parts: DataFrame, known: DataFrame, whole_key: str, part_key: str) -> DataFrame:
    """Wholes (files) that have at least one part (chunk) that is not known yet."""
    return wholes.join(new_rows(parts, known, part_key).select(whole_key), whole_key, "left_semi")


def compare(local: DataFrame, stored: DataFrame, key: str, vector: str = "embedding", tolerance: float = 1e-6) -> DataFrame:
    """``status`` of every local row: match, mismatch (beyond the tolerance or of another length) or missing."""
    there = stored.select(key, F.col(vector).alias("__there"), F.lit(True).alias("__found"))
    same = vectors.same_within(F.col(vector), F.col("__there"), tolerance)
    status = F.when(F.col("__found").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "match").otherwise("mismatch")
    return local.join(there, key, "left").select(key, status.alias("status"))


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row per key; of equal versions the change wins."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank", "__new")


def append_all(known: DataFrame, more: DataFrame) -> DataFrame:
    """All rows of both; columns that one side lacks are null."""
    return known.unionByName(more, allowMissingColumns=True)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    return set(a.columns) == set(b.columns)
