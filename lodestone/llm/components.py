"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.llm.common import materialize


def written_edges(edges: DataFrame) -> DataFrame:
    """Distinct u < v of ``edges``, in the shared folder."""
    return materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components")


def components(edges: DataFrame, max_rounds: int = 60, written: bool = False) -> DataFrame:
    """node and label (smallest node of its component) of every node of ``edges`` (u, v); ``written``: they are from ``written_edges``.

    Each round is two aggregations and joins by node; its edges are written to
    the shared folder, so lineage stays short. A node with very many neighbours
    is aggregated within tasks first. The result, one row a node, is written
    too: so the join's edges come straight from their own exchange, and the
    engine can split a node's edges among tasks, or send the few rows around.
    """
    held = edges if written else written_edges(edges)
    before = None
    for _ in range(max_rounds):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        after = small.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct().select("u", "v")
        # Every node points at one root and no root at anything: a forest of stars. Counted while it is written.
        watch = Observation()
        held = materialize(after.observe(watch, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "components")
        if watch.get == before:
            break
        before = watch.get
    else:
        raise RuntimeError("components did not settle")
    star = held.select(F.col("v").alias("node"), F.col("u").alias("label"))
    return star.unionByName(held.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
