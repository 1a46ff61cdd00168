"""Vector search: exact top-k, thresholds, cells, and lexical ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import rules, vectors
from lodestone.functions.text import normalize_for_match, query_terms, quoted_phrases, tokens_for_match
from lodestone.operators.chunking import passages
from lodestone.session import written


def scored(data: DataFrame, query_vector: list[float], vector: str = "embedding") -> DataFrame:
    """``similarity`` (cosine) of every row to one query: a projection, so nothing is joined or moved."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return data.withColumn("similarity", vectors.cosine(F.col(vector), q))


def named_like(data: DataFrame, part: str | None, column: str = "filename") -> DataFrame:
    """Rows whose file name holds ``part``, whatever the case; all of them without one."""
    return data.where(F.contains(F.lower(column), F.lit(part.lower()))) if part else data


def top_k(data: DataFrame, query_vector: list[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k most similar rows, ties by ``key``: a heap per task, merged."""
    return scored(data, query_vector, vector).orderBy(F.col("similarity").desc(), F.col(key)).limit(k)


def distinct_texts(top: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    """A few ranked rows, of equal texts the first in ``order``: the cut comes before."""
    first = Window.partitionBy(text).orderBy(*order)
    return top.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")


def joined_texts(top: DataFrame, order: list[Column], most: int = 5, text: str = "text", between: str = " ") -> DataFrame:
    """One row ``context``: the texts of the first few rows in order, joined."""
    ranked = top.orderBy(*order).limit(most).select(text, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("__at"))
    entries = F.array_sort(F.collect_list(F.struct("__at", F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return ranked.agg(F.array_join(F.transform(entries, lambda e: e.t), between).alias("context"))


def above(scores: DataFrame, least: float) -> DataFrame:
    """Rows above the larger of ``least`` and the mean; the mean is one number, joined as such."""
    mean = scores.agg(F.avg("similarity").alias("__mean"))
    return scores.join(F.broadcast(mean)).where(F.col("similarity") > F.greatest(F.col("__mean"), F.lit(least))).drop("__mean")


def weighted(top: DataFrame, key: str, text: str) -> DataFrame:
    """weight = similarity over the sum of similarities, and the weighted line, for a few top rows."""
    total = top.agg(F.sum("similarity").alias("__sum"))
    weight = F.col("similarity") / F.col("__sum")
    return top.join(F.broadcast(total)).select(key, weight.alias("weight"), F.concat(F.format_string("%.2f", weight), F.lit(" * "), F.col(text)).alias("line"))


def _unit(rows) -> np.ndarray:
    v = np.asarray(rows, np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_centres(sample: list[list[float]], n: int = 10, rounds: int = 25) -> list[tuple[int, list[float]]]:
    """Spherical k-means of a bounded sample (no zero vectors), begun at its first ``n`` distinct rows."""
    s = _unit(sample)
    first = np.sort(np.unique(s, axis=0, return_index=True)[1])[:n]
    centres = s[first]
    for _ in range(rounds):
        cell = (s @ centres.T).argmax(1)
        sums = np.stack([s[cell == k].sum(0) for k in range(len(centres))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return [(k, c.tolist()) for k, c in enumerate(centres)]


def probes_for(sample: list[list[float]], centres: list[tuple[int, list[float]]], k: int, least: float, queries: int = 512) -> int:
    """The fewest probes with a mean recall of ``least`` among the sample's own k nearest, a query's own row left out."""
    s, c = _unit(sample), _unit([c for _, c in centres])
    near = s @ c.T
    cell, asked = near.argmax(1), min(queries, len(s))
    k = min(k, len(s) - 1)
    if k < 1:
        return len(c)
    sims = s[:asked] @ s.T
    sims[np.arange(asked), np.arange(asked)] = -np.inf
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-near[:asked], axis=1, kind="stable"), axis=1)
    need = np.take_along_axis(place, cell[best], axis=1)
    return next((p for p in range(1, len(c)) if (need < p).mean() >= least), len(c))


def assign_cells(data: DataFrame, centres: list[tuple[int, list[float]]], vector: str = "embedding") -> DataFrame:
    """``cell``: the nearest of a few fixed centres; write partitioned by it to prune at search."""
    dist = [F.struct(vectors.squared_l2(F.col(vector), F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("cell")) for i, c in centres]
    return data.withColumn("cell", F.array_min(F.array(*dist))["cell"])


def nearest_cells(query_vector: list[float], centres: list[tuple[int, list[float]]], probes: int = 1) -> list[int]:
    """The cells to search, nearest first."""
    def far(c):
        d = sum(a * b for a, b in zip(query_vector, c))
        size = (sum(a * a for a in query_vector) * sum(b * b for b in c)) ** 0.5
        return -d / size if size else 0.0

    return [i for i, _ in sorted(centres, key=lambda ic: (far(ic[1]), ic[0]))[:probes]]


def read_cells(spark: SparkSession, path: str, query_vector: list[float], probes: int) -> DataFrame:
    """The vectors of the nearest cells of a table that ``sinks.write_cells`` wrote: only their folders are read."""
    return spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(*nearest_cells(query_vector, stored_centres(spark, path), probes)))


def stored_centres(spark: SparkSession, path: str) -> list[tuple[int, list[float]]]:
    """The centres that lie beside a table of cells: as many rows as cells."""
    return [(r.cell, list(r.centre)) for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]


def cell_search(data: DataFrame, query_vector: list[float], centres: list[tuple[int, list[float]]], k: int, key: str, probes: int = 1) -> DataFrame:
    """Top k among the rows of the nearest cells."""
    return top_k(data.where(F.col("cell").isin(*nearest_cells(query_vector, centres, probes))), query_vector, k, key)


def lexical_score(text: Column, query: Column) -> Column:
    """Query tokens in the text, and 4 for each quoted phrase it holds."""
    norm = normalize_for_match(text)
    overlap = F.size(F.array_intersect(query_terms(query), F.split(norm, " ")))
    phrases = F.filter(F.transform(quoted_phrases(query), normalize_for_match), lambda p: p != "")
    return overlap + 4 * F.size(F.filter(phrases, lambda p: F.contains(norm, p)))


def rank_passages(docs: DataFrame, key: str | list[str], text: str, query: str | Column, most: int = 12, bonuses=rules.PASSAGE_BONUSES) -> DataFrame:
    """Per document, its best passages for a query (one for all, or a column): token rarity within the document, ties by place.

    Rows with a score of 0 are kept only where the document has no other; a query without terms has no rows.
    All of it is local to a document's row: its passages are an array until they are ranked, and nothing is shuffled.
    Terms, passages and rarities are each bound as the one element of an array, so they are worked out once a document.
    """
    keys = [key] if isinstance(key, str) else key
    read = lambda terms: lambda p: F.struct(p.alias("passage"), F.array_intersect(terms, tokens_for_match(p)).alias("hits"), normalize_for_match(p).alias("norm"))
    bound = lambda fields, then: F.get(F.transform(F.array(fields), then), F.lit(0))

    def score(p: Column, rare: Column, terms: Column) -> Column:
        out = F.aggregate(rare, F.lit(0.0), lambda acc, r: acc + F.when(F.array_contains(p.hits, r.t), r.w).otherwise(0.0))
        for word, begins, held, extra in bonuses:
            asked = F.exists(terms, lambda t: F.startswith(t, F.lit(word)) if begins else t == F.lit(word))
            out = out + F.when(asked & F.contains(p.norm, F.lit(held)), extra).otherwise(0.0)
        return F.round(out, 9)

    def ranked_in(x: Column) -> Column:
        share = lambda t: F.lit(1.0) / (F.lit(1.0) + F.size(F.filter(x.read, lambda p: F.array_contains(p.hits, t))))
        rare = F.struct(F.transform(x.terms, lambda t: F.struct(t.alias("t"), share(t).alias("w"))).alias("rare"))
        placed = lambda y: F.transform(x.read, lambda p, i: F.struct((-score(p, y.rare, x.terms)).alias("minus"), i.alias("idx"), p.passage.alias("passage")))
        return F.slice(F.array_sort(bound(rare, placed)), 1, most)

    asked = F.struct(query_terms(F.lit(query) if isinstance(query, str) else query).alias("terms"))
    found = bound(asked, lambda q: bound(F.struct(q.terms.alias("terms"), F.transform(passages(F.col(text)), read(q.terms)).alias("read")), lambda x: F.when(F.size(x.terms) > 0, ranked_in(x))))
    best = docs.select(*keys, found.alias("__best"))
    kept = F.when(F.get("__best", F.lit(0)).minus < 0, F.filter("__best", lambda p: p.minus < 0)).otherwise(F.col("__best"))
    ranked = best.select(*keys, F.posexplode(kept).alias("__at", "__p"))
    return ranked.select(*keys, F.col("__p.idx").alias("idx"), F.col("__p.passage").alias("passage"), (-F.col("__p.minus") + F.lit(0.0)).alias("score"), (F.col("__at") + 1).alias("rank"))


def name_tokens(filename: Column) -> Column:
    """Match tokens of a file name without its ending."""
    return tokens_for_match(F.regexp_replace(F.regexp_replace(filename, "\\.[^.]*$", ""), "_", " "))


def target_score(filename: Column, query: str) -> Column:
    """Largest share of a target's tokens that a file name holds; targets are the quoted phrases, else the query."""
    name = name_tokens(filename)
    q = F.lit(query)
    targets = F.when(F.size(quoted_phrases(q)) > 0, quoted_phrases(q)).otherwise(F.array(q))
    share = lambda t: F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_distinct(tokens_for_match(t)), name)), F.size(F.array_distinct(tokens_for_match(t)))), F.lit(0.0))
    return F.array_max(F.transform(targets, share))


def detect_targets(filenames: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, filename and score of the document that each question is about, where it says so: ``detect_target`` for a table.

    A token join with a prefix filter: a name that holds a share s of a target's n tokens holds one of its n - ceil(s * n) + 1
    rarest, so only those are joined to the names' tokens, and a token that most names hold is looked up only by targets
    that have no rarer ones, or whose rarest leads to no name with all of their tokens. The share itself is taken from the whole
    of both sides.
    """
    quoted, phrases = F.contains("query", F.lit('"')), quoted_phrases(F.col("query"))
    cued = F.exists(F.array(*map(F.lit, rules.DOCUMENT_CUES)), lambda c: F.contains(F.lower("query"), c))
    asked = questions.where(quoted | cued).select("query_id", F.when(quoted, rules.QUOTED_THRESHOLD).otherwise(rules.CUE_THRESHOLD).alias("least"), F.posexplode(F.when(F.size(phrases) > 0, phrases).otherwise(F.array("query"))).alias("nth", "target"))
    asked = asked.select("query_id", "nth", "least", F.array_distinct(tokens_for_match(F.col("target"))).alias("tokens")).where(F.size("tokens") > 0)
    names = filenames.select("filename").distinct().withColumn("held", F.array_distinct(name_tokens(F.col("filename"))))
    held = names.select("filename", "held", F.explode("held").alias("token"))
    rarity = held.groupBy("token").agg(F.count("*").alias("df"))
    spread = asked.select("*", F.explode("tokens").alias("token")).join(rarity, "token", "left")
    by_rarity = Window.partitionBy("query_id", "nth").orderBy(F.coalesce("df", F.lit(0)), "token")
    most = F.size("tokens") - F.greatest(F.ceil(F.col("least") * F.size("tokens") - F.lit(1e-9)), F.lit(1)) + 1
    rarest = written(spread.withColumn("__at", F.row_number().over(by_rarity)).where((F.col("__at") <= most) & F.col("df").isNotNull()).select("query_id", "token", "tokens", "least", "__at"), "rarest")
    share = F.size(F.array_intersect("tokens", "held")) / F.size("tokens")
    meet = lambda rows: rows.join(held, "token").select("query_id", "filename", "least", share.alias("score")).where(F.col("score") >= F.col("least"))
    # A name that holds all of a target holds its rarest token: where one does, no other token is looked up.
    first = written(meet(rarest.where("__at = 1")), "aims")
    whole = first.where("score = 1").select("query_id").distinct()
    met = first.unionByName(meet(rarest.where("__at > 1").join(whole, "query_id", "left_anti")))
    best = met.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "filename")).alias("best"))
    return best.select("query_id", "best.filename", (-F.col("best.minus")).alias("score"))


def detect_target(filenames: DataFrame, query: str) -> DataFrame:
    """At most one row (filename, score): the document that a query is about, if it says so."""
    quoted = '"' in query
    low = query.lower()
    if not quoted and not any(c in low for c in rules.DOCUMENT_CUES):
        return filenames.select("filename", F.lit(0.0).alias("score")).limit(0)
    best = filenames.select("filename", target_score(F.col("filename"), query).alias("score")).orderBy(F.col("score").desc(), "filename").limit(1)
    return best.where((F.col("score") >= (rules.QUOTED_THRESHOLD if quoted else rules.CUE_THRESHOLD)) & (F.col("score") > 0))
