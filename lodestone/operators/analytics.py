"""Corpus statistics: frequencies, diversity, readability, sentiment, tf-idf, concordance."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from lodestone.functions import rules
from lodestone.functions.text import plain_tokens, words
from lodestone.operators import consistency


def token_rows(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    return docs.select(*keys, F.explode(plain_tokens(F.col(text))).alias("token"))


def top_words(docs: DataFrame, n: int | None = 20) -> DataFrame:
    counts = token_rows(docs).groupBy("token").agg(F.count("*").alias("n"))
    return counts if n is None else counts.orderBy(F.col("n").desc(), "token").limit(n)


def top_words_per(docs: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n most frequent words of every row of ``docs``: counted, ordered and cut within the row."""
    rows = docs.select(key, F.array_sort(plain_tokens(F.col("text"))).alias("__t"))
    last = lambda i: (i == F.size("__t") - 1) | (F.get("__t", i) != F.get("__t", i + 1))
    ends = F.filter(F.transform("__t", lambda t, i: F.when(last(i), F.struct(t.alias("token"), i.alias("end")))), lambda e: e.isNotNull())
    rows = rows.select(key, ends.alias("__e"))
    counted = F.transform("__e", lambda e, k: F.struct((F.coalesce(F.get("__e", k - 1).end, F.lit(-1)) - e.end).cast("long").alias("minus"), e.token.alias("token")))
    best = rows.select(key, F.posexplode(F.slice(F.array_sort(counted), 1, n)).alias("__at", "__c"))
    return best.select(key, "__c.token", (-F.col("__c.minus")).alias("n"), (F.col("__at") + 1).alias("rank"))


def word_category_table(docs: DataFrame, category: str, n: int = 20) -> DataFrame:
    """Counts of the n top words in each category, in long form, zeros included; every text is read for tokens once."""
    counts = token_rows(docs, category).groupBy(category, "token").agg(F.count("*").alias("n"))
    top = counts.groupBy("token").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "token").limit(n).select("token")
    grid = docs.select(category).distinct().join(F.broadcast(top))
    return grid.join(counts, [category, "token"], "left").select(category, "token", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin (from 0) and n of equally wide bins between the least and the greatest value; one bin, null, where all are equal."""
    b = rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.floor((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * bins)
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(b)).groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def box(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """least, q1, median, q3 and most of a value, by the keys; quartiles are interpolated."""
    q = F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    names = ("least", "q1", "median", "q3", "most")
    return rows.groupBy(*keys).agg(q.alias("__q")).select(*keys, *[F.round(F.col("__q")[k], 6).alias(name) for k, name in enumerate(names)])


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """a, b and r (Pearson) of every two of the named columns, in one pass."""
    pairs = [(a, b) for a in names for b in names]
    one = rows.agg(*[F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n random rows without replacement, in the order of a seeded hash of their key: a heap per task, merged."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return rows.withColumn("__place", place).orderBy("__place", key).limit(n).drop("__place")


def diversity(text: Column) -> Column:
    """Distinct tokens per hundred tokens; null without tokens."""
    t = plain_tokens(text)
    return F.try_divide(F.size(F.array_distinct(t)) * F.lit(100.0), F.size(t))


def readability(text: Column) -> Column:
    """Flesch reading ease with vowel groups as syllables; null without words."""
    w = F.size(words(text))
    s = F.greatest(F.size(F.regexp_extract_all(text, F.lit("[.!?]+"), F.lit(0))), F.lit(1))
    y = F.size(F.regexp_extract_all(F.lower(text), F.lit("[aeiouy]+"), F.lit(0)))
    return F.when(w > 0, F.lit(206.835) - F.lit(1.015) * w / s - F.lit(84.6) * y / w)


def sentiment(docs: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """n_hits, valence and compound per document from a (word, valence) table."""
    hits = token_rows(docs, key).join(lexicon, F.col("token") == F.col("word")).groupBy(key).agg(F.count("*").alias("n_hits"), F.sum("valence").alias("valence"))
    rows = docs.select(key).join(hits, key, "left")
    s = F.coalesce("valence", F.lit(0.0))
    return rows.select(key, F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.round(s, 6).alias("valence"), F.round(s / F.sqrt(s * s + F.lit(15.0)), 6).alias("compound"))


def sentiment_shares(docs: DataFrame, key: str, lexicon: DataFrame, most: float = 4.0) -> DataFrame:
    """pos, neg, neu and polarity per document; ``most`` is the lexicon's largest valence.

    As VADER weighs them: a hit counts its valence and one more, any other token one as neutral; the three are shares.
    polarity is the mean valence of the hits over ``most``, 0 without any.
    """
    found = token_rows(docs, key).join(F.broadcast(lexicon), F.col("token") == F.col("word"), "left")
    v = F.coalesce("valence", F.lit(0.0))
    sums = found.groupBy(key).agg(F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("p"), F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("m"), F.sum(F.when(v == 0, 1.0).otherwise(0.0)).alias("z"), F.avg("valence").alias("mean"))
    total = F.col("p") + F.col("m") + F.col("z")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)), 6)
    return docs.select(key).join(sums, key, "left").select(key, share("p").alias("pos"), share("m").alias("neg"), share("z").alias("neu"), F.round(F.coalesce(F.col("mean") / most, F.lit(0.0)), 6).alias("polarity"))


def concordance(docs: DataFrame, key: str, word: str, width: int = 5) -> DataFrame:
    """Each place of a word with ``width`` words on either side."""
    w = words(F.lower(F.col("text")))
    rows = docs.where(F.contains(F.lower("text"), F.lit(word))).select(key, w.alias("__w"))
    hits = rows.select(key, "__w", F.posexplode("__w").alias("place", "word")).where(F.col("word") == word)
    begin = F.greatest(F.col("place") - width, F.lit(0))
    return hits.select(key, "place", F.array_join(F.slice("__w", begin + 1, F.col("place") - begin + width + 1), " ").alias("line"))


#: Rows of an Arrow batch that are opened as Python objects at once.
OPENED = 500


def _in_slices(made) -> Callable[[pa.Array], pa.Array]:
    """``made`` of a batch, a few rows at a time."""
    return lambda rows: pa.concat_arrays([made(rows.slice(k, OPENED)) for k in range(0, max(len(rows), 1), OPENED)])


def token_counts(text: Column) -> Column:
    """(token, tf) of the distinct ``plain_tokens`` of a text, counted within the row in Arrow batches."""
    kind, stop = pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int64())])), frozenset(rules.STOP_WORDS)

    def counted(low: pa.Array) -> pa.Array:
        find, ends, tokens, counts = re.compile("[a-z]+|[0-9]+(?:\\.[0-9]+)*").findall, [0], [], []
        for t in low:
            found = Counter(find(t.as_py() or ""))
            for w in stop & found.keys():
                del found[w]
            tokens += found
            counts += found.values()
            ends.append(len(tokens))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], fields=list(kind.value_type)))

    return arrow_udf(_in_slices(counted), "array<struct<token:string,tf:bigint>>")(F.lower(text))


def tf_idf(docs: DataFrame, key: str, most_terms: int = 1000) -> DataFrame:
    """Smoothed, length-normalised tf-idf over the most frequent terms; one row per document and term.

    Rows of one key are one document; a null key counts as a document and has no weights. A document of one row is
    counted, weighed and normalised within it; only rows whose key stands more than once are counted by shuffle.
    """
    once, again = consistency.told_apart(docs.select(key, "text"), key)
    counts = once.select(key, token_counts(F.col("text")).alias("c"))
    by_token = counts.select(F.explode("c").alias("c")).select("c.*")
    if again is not None:
        more = token_rows(again, key).groupBy(key, "token").agg(F.count("*").alias("tf"))
        by_token = by_token.unionByName(more.select("token", "tf"))
    terms = by_token.groupBy("token").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.col("total").desc(), "token").limit(most_terms)
    n = docs.agg(F.count("*").alias("n_docs"))
    terms = terms.join(F.broadcast(n)).select("token", (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    idf = {r.token: r.idf for r in terms.collect()}  # at most most_terms rows
    kind = pa.list_(pa.struct([("token", pa.string()), ("weight", pa.float64())]))

    def weighed(counts: pa.Array) -> pa.Array:
        tokens, tf = counts.flatten().field("token").to_pylist(), counts.flatten().field("tf").to_numpy()
        weight = tf * np.array([idf.get(t, 0.0) for t in tokens], float)  # an idf is above 0
        row = np.repeat(np.arange(len(counts)), counts.value_lengths().to_numpy())
        size = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(counts)))
        kept = np.flatnonzero(weight)
        ends = np.searchsorted(row[kept], np.arange(len(counts) + 1)).astype(np.int32)
        values = [pa.array([tokens[k] for k in kept.tolist()], pa.string()), pa.array(weight[kept] / size[row[kept]], pa.float64())]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, fields=list(kind.value_type)))

    made = counts.select(key, F.explode(arrow_udf(_in_slices(weighed), "array<struct<token:string,weight:double>>")("c")).alias("w")).select(key, "w.token", "w.weight")
    if again is not None:
        held = more.join(F.broadcast(terms), "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w"))
        size = held.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        made = made.unionByName(held.join(size, key).select(key, "token", (F.col("w") / F.col("size")).alias("weight")))
    return made.select(key, "token", F.round("weight", 6).alias("weight"))


def concordance_lines(docs: DataFrame, key: str, word: str, width: int = 80) -> DataFrame:
    """Each place of a word in a line of about ``width`` characters: what stands before and after it, cut to half of the rest.

    As many as ``width`` / 4 words on either side are looked at. Lines are made within the row; no words leave it.
    """
    half, around = (width - len(word) - 2) // 2, width // 4
    def line(w: Column, i: Column) -> Column:
        left = F.array_join(F.slice(w, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around))), " ")
        right = F.array_join(F.slice(w, i + 2, F.lit(around - 1)), " ")
        return F.concat_ws(" ", F.right(left, F.lit(half)), F.lit(word), F.left(right, F.lit(half)))

    found = F.get(F.transform(F.array(F.struct(words(F.lower(F.col("text"))).alias("w"))), lambda x: F.filter(F.transform(x.w, lambda t, i: F.when(t == word, F.struct(i.alias("place"), line(x.w, i).alias("line")))), lambda h: h.isNotNull())), F.lit(0))
    hits = docs.where(F.contains(F.lower("text"), F.lit(word))).select(key, F.explode(found).alias("__h"))
    return hits.select(key, "__h.place", "__h.line")


def sentiment_in_context(docs: DataFrame, key: str, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """n_hits, valence, compound, pos, neg and neu per document, each hit weighed by the words around it.

    As the published VADER rules have it: a word in capitals in a text that is not all capitals counts more; each of the three
    words before a hit that is a booster adds to it or takes from it, less the further it stands; a negation among them turns
    and weakens it; up to four exclamation marks raise the whole. ``lexicon`` (word, valence) is a table of any size.
    Every token carries the three before it, so tokens are told apart by one join with the lexicon and summed by document: where
    they are read, unless the lexicon is too large to be sent.
    """
    whole, pattern = F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z\\']+")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = docs.select(
        key, F.regexp_extract_all(whole, pattern, F.lit(0)).alias("t"), F.regexp_extract_all(F.translate(whole, upper, upper.lower()), pattern, F.lit(0)).alias("token"),
        whole.rlike("[a-z]").alias("__mixed"), F.least(F.size(F.regexp_extract_all(whole, F.lit("!"), F.lit(0))), F.lit(4)).alias("__marks"),
    )
    # The tokens beside themselves, moved by one, two and three places: what stands before each, nearest first.
    moved = [F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.col("token")).alias(f"b{k}") for k in (1, 2, 3)]
    tokens = rows.select(key, "__mixed", F.explode(F.arrays_zip("token", "t", *moved)).alias("__z")).select(key, "__mixed", "__z.*")
    hits = tokens.join(consistency.sent_if_few(lexicon), F.col("token") == F.col("word"))
    sign, loud = F.signum("valence"), (F.col("t") == F.upper("t")) & (F.length("t") > 1) & F.col("__mixed")
    v = F.col("valence") + F.when(loud, sign * rules.EMPHASIS).otherwise(0.0)
    negated = F.lit(False)
    for place, fades in enumerate(rules.FADING, 1):
        b = F.coalesce(F.col(f"b{place}"), F.lit(""))
        v = v + sign * fades * F.when(b.isin(*rules.BOOSTERS), rules.BOOST).when(b.isin(*rules.DAMPENERS), -rules.BOOST).otherwise(0.0)
        negated = negated | b.isin(*rules.NEGATIONS)
    v = v * F.when(negated, rules.TURN).otherwise(1.0)
    sums = hits.select(key, v.alias("v")).groupBy(key).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("v") < 0, 1 - F.col("v")).otherwise(0.0)).alias("m"), F.count_if(F.col("v") != 0).alias("k"))
    all_rows = rows.select(key, F.size("t").alias("__size"), "__marks").join(sums, key, "left")
    s, k = F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0))
    raised = s + F.signum(s) * rules.MARK * F.col("__marks")
    total = F.coalesce("p", F.lit(0.0)) + F.coalesce("m", F.lit(0.0)) + F.col("__size") - k
    share = lambda c: F.round(F.coalesce(F.try_divide(c, total), F.lit(0.0)), 6)
    return all_rows.select(
        key, F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"), F.round(s, 6).alias("valence"), F.round(raised / F.sqrt(raised * raised + 15.0), 6).alias("compound"),
        share(F.coalesce("p", F.lit(0.0))).alias("pos"), share(F.coalesce("m", F.lit(0.0))).alias("neg"), share(F.col("__size") - k).alias("neu"),
    )
