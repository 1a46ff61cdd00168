"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). The token budget goes down the tree one
level at a time. A node's capacity is what its leaves can give: their tokens
times the most epochs, nothing where a weight on the leaf's path is 0. Among siblings the budget is shared in proportion to
their weights; a sibling that cannot take its share takes its capacity, and the
rest is shared anew among its siblings, in closed form over the siblings sorted
by capacity per weight. Only what a whole family cannot take was kept from it a
level above, and went to the family's own siblings.

A leaf's budget is filled by whole epochs and then by the token-prefix of one
more epoch, in the order of a seeded hash of (seed, epoch, doc_id): documents
are taken in that order as long as their tokens fit.

The prefix of a leaf of any size is found without ordering the leaf in one
task: tokens are summed per slice of the hash range (65,536 a leaf), slices are
accumulated in 256 stretches of 256, and only the slice where the budget ends is
ordered row by row. Weights are small tables by their nature: one row per node.

Everything is DataFrame expressions. Defined results: a null text has 0 tokens;
a null domain, language or source is the node ''; a node without a weight has
weight 1 (its siblings' default); a weight of 0 or less gives the node nothing; a
document of 0 tokens costs nothing and is taken with the epoch that its place
belongs to; ties in the hash are ordered by doc_id, and rows that share the
doc_id are taken or left together; an empty table gives an empty table; further
columns pass through ``sample`` and are ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_BREAK, materialize

#: Hex digits of the seeded hash that name a slice: 16 ** 4 slices a leaf, so that the slice that must be ordered is small.
SLICE_DIGITS = 4
LEVELS = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_BREAK), "")).cast("long")


def _weight(names: list[str], weights: dict[tuple, float]) -> Column:
    """The weight of the node whose path is in ``names``; 1 where none is given."""
    out = F.lit(1.0)
    for path, w in sorted(weights.items()):
        if len(path) == len(names):
            hit = F.lit(True)
            for name, value in zip(names, path):
                hit = hit & (F.col(name) == F.lit(value))
            out = F.when(hit, F.lit(float(w))).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def _open(weights: dict[tuple, float]) -> Column:
    """Whether a leaf has a positive weight at every level of its path."""
    out = F.lit(True)
    for depth in range(len(LEVELS)):
        out = out & (_weight(list(LEVELS[: depth + 1]), weights) > 0)
    return out


def _share(nodes: DataFrame, parent: list[str], names: list[str]) -> DataFrame:
    """Give each node its part of ``__budget``, the budget of its parent."""
    siblings = Window.partitionBy(*parent)
    order = Window.partitionBy(*parent).orderBy(F.col("__level"), *names)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rated = nodes.withColumn("__level", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(-1.0)))
    takes = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0.0))
    summed = rated.withColumn("__taken", F.coalesce(F.sum(takes).over(before), F.lit(0.0)))
    summed = summed.withColumn("__left", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The water level if every smaller sibling is full and the others share the rest.
    level = F.when(F.col("__left") > 0, (F.col("__budget") - F.col("__taken")) / F.col("__left"))
    short = F.max(F.when((F.col("weight") > 0) & (F.col("__level") >= level), level)).over(siblings)
    part = F.when(F.col("weight") <= 0, F.lit(0.0)).when(short.isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("weight") * short))
    return summed.withColumn("budget", part).drop("__level", "__taken", "__left", "__budget")


def allocate(leaves: DataFrame, total: float | Column, weights: dict[tuple, float], max_epochs: int) -> DataFrame:
    """domain, lang, source, n_docs, tokens, capacity, budget (double) of every leaf.

    ``leaves`` has domain, lang, source, n_docs, tokens; ``total`` is the token
    budget, or a column of the sum ``tokens`` of the whole tree.
    """
    leaves = leaves.withColumn("capacity", F.when(_open(weights), F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("double"))
    above = leaves.agg(F.sum("tokens").alias("tokens")).select((total if isinstance(total, Column) else F.lit(float(total))).cast("double").alias("budget"))
    for depth in range(len(LEVELS)):
        names, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves if depth == len(LEVELS) - 1 else leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(names, weights))
        held = above.select(*parent, F.col("budget").alias("__budget"))
        nodes = nodes.join(held, parent) if parent else nodes.join(F.broadcast(held))
        above = _share(nodes, parent, names)
    return above.drop("weight")


def _leaf(docs: DataFrame, domain: Column) -> list[Column]:
    named = lambda c, name: F.coalesce(c.cast("string"), F.lit("")).alias(name)
    return [named(domain, "domain"), named(F.col("lang"), "lang"), named(F.col("source"), "source")]


def plan(docs: DataFrame, domain: Column, total: float | Column, weights: dict[tuple, float], seed: int = 17, max_epochs: int = 4) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies (epochs that take it) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), n_words(F.col("text")).alias("__tokens"), *_leaf(docs, domain))
    rows = materialize(rows, "mixing-rows")
    return _chosen(rows, total, weights, seed, max_epochs).select(F.col("__id").alias("doc_id"), "domain", "lang", "source", F.col("__tokens").alias("n_tokens"), "copies")


def _chosen(rows: DataFrame, total: float | Column, weights: dict[tuple, float], seed: int, max_epochs: int) -> DataFrame:
    leaves = rows.groupBy(*LEVELS).agg(F.count("*").alias("n_docs"), F.sum("__tokens").alias("tokens"))
    budgets = materialize(allocate(leaves, total, weights, max_epochs), "mixing-budgets")
    budget = F.floor(F.col("budget") + 1e-6).cast("long")
    whole = F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    budgets = budgets.select(*LEVELS, whole.alias("__whole"), (budget - whole * F.col("tokens")).alias("__rest"))
    epoch = F.col("__whole").cast("string")
    held = rows.join(budgets, list(LEVELS)).withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, F.coalesce(F.col("__id").cast("string"), F.lit(""))).cast("binary")))
    held = held.withColumn("__slice", F.substring("__hash", 1, SLICE_DIGITS))
    slices = materialize(held.groupBy(*LEVELS, "__slice").agg(F.sum("__tokens").alias("__sum"), F.first("__rest").alias("__of")), "mixing-slices")
    slices = _accumulated(slices).select(*LEVELS, "__slice", "__before", (F.col("__before") + F.col("__sum") > F.col("__of")).alias("__ends"))
    held = held.join(slices, [*LEVELS, "__slice"])
    sure = held.where(~F.col("__ends")).select(*rows.columns, (F.col("__whole") + 1).alias("copies"))
    within = Window.partitionBy(*LEVELS, "__slice").orderBy("__hash", "__id")
    # A slice past the budget's end has nothing left; only the slice where it ends is ordered.
    past = held.where(F.col("__ends") & (F.col("__before") > F.col("__rest"))).select(*rows.columns, F.col("__whole").alias("copies"))
    edge = held.where(F.col("__ends") & (F.col("__before") <= F.col("__rest")))
    upto = F.col("__before") + F.sum("__tokens").over(within)
    edge = edge.select(*rows.columns, (F.col("__whole") + (upto <= F.col("__rest")).cast("long")).alias("copies"))
    return sure.unionByName(past).unionByName(edge)


def _accumulated(slices: DataFrame) -> DataFrame:
    """``__before``: the tokens of a leaf's earlier slices, by sums over stretches of slices, so that no task orders a whole leaf's."""
    top = F.substring("__slice", 1, SLICE_DIGITS // 2).alias("__top")

    def earlier(rows: DataFrame, keys: list[str], order: str, size: str, out: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))

    stretches = slices.groupBy(*LEVELS, top).agg(F.sum("__sum").alias("__stretch"))
    stretches = earlier(stretches, list(LEVELS), "__top", "__stretch", "__above").drop("__stretch")
    placed = earlier(slices.select("*", top), [*LEVELS, "__top"], "__slice", "__sum", "__within")
    return placed.join(stretches, [*LEVELS, "__top"]).withColumn("__before", F.col("__above") + F.col("__within")).drop("__top", "__above", "__within")


def sample(docs: DataFrame, domain: Column, total: float | Column, weights: dict[tuple, float], seed: int = 17, max_epochs: int = 4) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as epochs take it, all columns."""
    taken = plan(docs, domain, total, weights, seed, max_epochs).where("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in LEVELS)).agg(F.max("copies").alias("__copies"))
    leaf = [c.alias(f"__of_{n}") for c, n in zip(_leaf(docs, domain), LEVELS)]
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__of_id"), *leaf)
    same = F.col("__of_id").eqNullSafe(F.col("__id"))
    for n in LEVELS:
        same = same & (F.col(f"__of_{n}") == F.col(f"__{n}"))
    return rows.join(taken, same).select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__row.*")


# The production mix of the registered queries.
SEED, MAX_EPOCHS, PART = 17, 4, 0.7
WEIGHTS = {
    ("web",): 0.5, ("books",): 0.2, ("code",): 0.2, ("talk",): 0.1,
    ("web", "en"): 0.6, ("web", "de"): 0.15, ("web", "fr"): 0.15, ("web", "es"): 0.1,
    ("books", "en"): 0.4, ("books", "de"): 0.2, ("books", "fr"): 0.2, ("books", "es"): 0.2,
    ("web", "en", "src0"): 3.0,
}


def domain_of(source: Column) -> Column:
    """The domain that a source's number belongs to."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    n = F.when(n != "", n.cast("int")).otherwise(F.lit(99))
    return F.when(n < 8, "web").when(n < 12, "books").when(n < 16, "code").otherwise("talk")


def _sql_weight(names: tuple[str, ...]) -> str:
    cases = []
    for path, w in WEIGHTS.items():
        if len(path) == len(names):
            cases.append(f"WHEN {' AND '.join(f'{n} = {v!r}' for n, v in zip(names, path))} THEN {w}")
    return f"(CASE {' '.join(cases)} ELSE 1.0 END)::DOUBLE"


def oracle() -> str:
    """The same rows in DuckDB: water levels per family, then one ordered sum per leaf."""
    ctes, parent = [], "root"
    usable = " AND ".join(f"{_sql_weight(LEVELS[: depth + 1])} > 0" for depth in range(len(LEVELS)))
    for depth in range(len(LEVELS)):
        names, above = LEVELS[: depth + 1], LEVELS[:depth]
        link = f"USING ({', '.join(above)})" if above else "ON true"
        over = f"PARTITION BY {', '.join(above)}" if above else ""
        cols = ", ".join(names)
        ctes.append(f"""
n{depth} AS (SELECT {cols}, sum(cap) AS cap, {_sql_weight(names)} AS w FROM leaf GROUP BY {cols}),
r{depth} AS (SELECT n.*, p.budget AS b, CASE WHEN w > 0 THEN cap / w ELSE -1 END AS fill FROM n{depth} n JOIN {parent} p {link}),
s{depth} AS (SELECT *, coalesce(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remain FROM r{depth} WINDOW o AS ({over} ORDER BY fill, {cols})),
t{depth} AS (SELECT *, max(CASE WHEN w > 0 AND fill >= (b - taken) / remain THEN (b - taken) / remain END) OVER ({over}) AS level FROM s{depth}),
b{depth} AS (SELECT {cols}, CASE WHEN w <= 0 THEN 0 WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS budget FROM t{depth})""")
        parent = f"b{depth}"
    return f"""
WITH num AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INTEGER), 99) AS k FROM documents),
doc AS (SELECT doc_id, CASE WHEN k < 8 THEN 'web' WHEN k < 12 THEN 'books' WHEN k < 16 THEN 'code' ELSE 'talk' END AS domain, coalesce(lang, '') AS lang,
        coalesce(source, '') AS source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_tokens FROM num),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, CASE WHEN {usable} THEN sum(n_tokens)::DOUBLE * {MAX_EPOCHS} ELSE 0 END AS cap FROM doc GROUP BY domain, lang, source),
root AS (SELECT (sum(n_tokens)::DOUBLE) * {PART} AS budget FROM doc),{','.join(ctes)},
part AS (SELECT l.*, floor(b.budget + 1e-6)::BIGINT AS b FROM leaf l JOIN b2 b USING (domain, lang, source)),
run AS (SELECT *, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS e FROM part),
ordered AS (SELECT d.*, r.e, r.b - r.e * r.tokens AS rest,
            sum(d.n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5(concat('{SEED}:', r.e, ':', coalesce(d.doc_id::VARCHAR, ''))), d.doc_id) AS upto
            FROM doc d JOIN run r USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, e + (upto <= rest)::BIGINT AS copies FROM ordered
"""
