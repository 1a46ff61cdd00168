"""Budgeted context packing: an exact fold over the few ranked candidates of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(ranked: DataFrame, query: str = "query_id", most_tokens: int = 3500, per_file: int | None = 4) -> DataFrame:
    """The accepted candidates of each query, in rank order, with ``position`` (from 1).

    ``ranked`` has query, rank, filename, chunk_id, signature, tokens. A seen
    signature or a full file is skipped; the first candidate over the budget
    ends the packing. Candidates per query are a top-k, so the fold is bounded.
    """
    item = F.struct("rank", "chunk_id", "filename", "signature", "tokens")
    seed = F.struct(
        F.array().cast("array<struct<rank:int,chunk_id:string,filename:string,signature:string,tokens:bigint>>").alias("kept"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(False).alias("stop"),
    )

    def step(acc: Column, x: Column) -> Column:
        seen = F.exists(acc["kept"], lambda k: k.signature == x.signature)
        full = F.lit(False) if per_file is None else F.size(F.filter(acc["kept"], lambda k: k.filename == x.filename)) >= per_file
        over = acc["sum"] + x.tokens > most_tokens
        fits = ~acc["stop"] & ~seen & ~full
        take = fits & ~over
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"), F.when(take, acc["sum"] + x.tokens).otherwise(acc["sum"]).alias("sum"), (acc["stop"] | (fits & over)).alias("stop"))

    typed = ranked.select(query, F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("filename").cast("string").alias("filename"), "signature", F.col("tokens").cast("long").alias("tokens"))
    folded = typed.groupBy(query).agg(F.aggregate(F.array_sort(F.collect_list(item)), seed, step, lambda acc: acc["kept"]).alias("kept"))
    found = folded.select(query, F.posexplode("kept").alias("position", "k"))
    return found.select(query, (F.col("position") + 1).alias("position"), "k.rank", "k.chunk_id", "k.filename", "k.tokens")
