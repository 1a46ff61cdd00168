"""Corpus statistics, sessions and history, incremental and streaming work."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import plain_tokens
from lodestone.operators import analytics, sessions
from lodestone.plans import ingest
from lodestone.plans.registry import ORACLES, register, sql_list, sql_words
from lodestone.seams import HashingEmbedder, LetterEmbedder
from lodestone.session import shared_dir, table
from lodestone.streaming import incremental

_PLAIN = f"list_filter(regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:\\.[0-9]+)*'), lambda x: NOT list_contains({sql_list(rules.STOP_WORDS)}, x))"
_TOKENS = f"t AS (SELECT doc_id, lang, source, unnest({_PLAIN}) AS token FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@register("SELECT lang AS category, count(*) AS n_docs FROM documents GROUP BY lang")
def category_counts(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n_docs"))


@register()
def prepare_corpus(spark, sf_dir):
    """The whole preparation chain, as sizes of its parts."""
    rows = ingest.prepare(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("filename"), "text"))
    sizes = [F.size(c).alias(f"n_{c}") for c in ("tokens", "entities", "section_references", "personal_names", "pos_tags")]
    return rows.select("filename", *sizes, "metadata.extraction_quality", "category")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_COUNTS = ", ".join(f"len(text) - len(replace(lower(text), '{c}', ''))" for c in _LETTERS)


@register(
    f"""
WITH n AS (SELECT d.doc_id, d.text FROM documents d ANTI JOIN labels USING (doc_id)),
v AS (SELECT doc_id, list_transform([{_COUNTS}], lambda x: x::DOUBLE) AS v FROM n), z AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS z FROM v),
u AS (SELECT doc_id AS chunk_id, list_transform(v, lambda x: CASE WHEN z > 0 THEN x / z ELSE 0 END) AS u FROM z)
SELECT chunk_id, len(u) AS size, round(u[1], 6) + 0.0::DOUBLE AS first, round(list_sum(list_transform(range(1, 27), lambda k: k * u[k])), 6) AS total FROM u
"""
)
def embed_new_chunks(spark, sf_dir):
    """Vectors of the documents that have none yet, by shares of letters; those with a label stand for the ones that have."""
    chunks = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    made = ingest.embed_new(chunks, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")), LetterEmbedder())
    total = F.aggregate(F.transform("embedding", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select("chunk_id", F.size("embedding").cast("long").alias("size"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(total, 6).alias("total"))


@register()
def embed_new_chunk_vectors(spark, sf_dir):
    """The vectors themselves of ``embed_new_chunks``; SQL cannot make them."""
    chunks = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    made = ingest.embed_new(chunks, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")), HashingEmbedder())
    return made.select("chunk_id", "embedding")


@register(f"SELECT doc_id, len(text) AS n_chars, len({_PLAIN}) AS n_tokens FROM documents")
def document_sizes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(plain_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@register(f"SELECT count(*) AS n_docs, sum(len({_PLAIN}))::BIGINT AS n_tokens FROM documents")
def corpus_totals(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.count("*").alias("n_docs"), F.sum(F.size(plain_tokens(F.col("text")))).cast("long").alias("n_tokens"))


@register("SELECT lang AS category, round(sum(len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')))::DOUBLE / count(*), 6) AS names_per_doc FROM documents GROUP BY lang")
def names_per_category(spark, sf_dir):
    """Two capitalised words in a row stand for a personal name."""
    names = F.regexp_count("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"))
    return _docs(spark, sf_dir).groupBy(F.col("lang").alias("category")).agg(F.round(F.sum(names) / F.count("*"), 6).alias("names_per_doc"))


@register(f"WITH {_TOKENS} SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 20")
def top_words(spark, sf_dir):
    return analytics.top_words(_docs(spark, sf_dir), 20)


@register(f"WITH {_TOKENS} SELECT token, count(*) AS n FROM t GROUP BY token")
def word_weights(spark, sf_dir):
    return analytics.top_words(_docs(spark, sf_dir), None)


@register(f"WITH {_TOKENS}, c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY 1, 2) SELECT doc_id, token, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 5")
def top_words_per_document(spark, sf_dir):
    return analytics.top_words_per(_docs(spark, sf_dir), "doc_id", 5)


@register(
    f"""
WITH {_TOKENS}, w AS (SELECT token FROM t GROUP BY token ORDER BY count(*) DESC, token LIMIT 20),
c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY 1, 2)
SELECT l.lang, w.token, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN w LEFT JOIN c ON c.lang = l.lang AND c.token = w.token
"""
)
def word_category_table(spark, sf_dir):
    return analytics.word_category_table(_docs(spark, sf_dir), "lang", 20)


@register(
    """
WITH b AS (SELECT min(len(text))::DOUBLE AS lo, max(len(text))::DOUBLE AS hi FROM documents)
SELECT least(floor((len(text) - lo) / nullif(hi - lo, 0) * 20), 19)::BIGINT AS bin, count(*) AS n FROM documents, b GROUP BY 1
"""
)
def doc_length_histogram(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.length("text").cast("double").alias("x"))
    b = docs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 20)
    return docs.join(F.broadcast(b)).groupBy(F.least(place, F.lit(19)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@register("SELECT lang, round(quantile_cont(len(text)::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(len(text)::DOUBLE, 0.5), 6) AS median, round(quantile_cont(len(text)::DOUBLE, 0.75), 6) AS q3, min(len(text)) AS least, max(len(text)) AS most FROM documents GROUP BY lang")
def length_quartiles(spark, sf_dir):
    n = F.length("text")
    q = F.percentile(n.cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = _docs(spark, sf_dir).groupBy("lang").agg(q.alias("q"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"))
    return found.select("lang", *[F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(("q1", "median", "q3"))], "least", "most")


@register("SELECT round(corr(quality::DOUBLE, toxic::DOUBLE), 6) AS quality_toxic, round(corr(quality::DOUBLE, len(text)::DOUBLE), 6) AS quality_length, round(corr(toxic::DOUBLE, len(text)::DOUBLE), 6) AS toxic_length FROM labels JOIN documents USING (doc_id)")
def label_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", F.length("text").alias("length")), "doc_id")
    pair = lambda a, b: F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(f"{a}_{b}")
    return rows.agg(pair("quality", "toxic"), pair("quality", "length"), pair("toxic", "length"))


@register(f"SELECT lang AS category, round(avg(len(list_distinct(t)) * 100.0::DOUBLE / nullif(len(t), 0)), 6) AS diversity FROM (SELECT lang, {_PLAIN} AS t FROM documents) GROUP BY lang")
def lexical_diversity(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.col("lang").alias("category")).agg(F.round(F.avg(analytics.diversity(F.col("text"))), 6).alias("diversity"))


@register(
    f"""
WITH c AS (SELECT doc_id, len({sql_words('text')}) AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS y FROM documents)
SELECT doc_id, round(CASE WHEN w > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * w / s - 84.6::DOUBLE * y / w END, 6) AS ease FROM c
"""
)
def readability(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(analytics.readability(F.col("text")), 6).alias("ease"))


@register(
    f"""
WITH {_TOKENS}, l(word, valence) AS (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in rules.SENTIMENT.items())}),
h AS (SELECT doc_id, count(*) AS n_hits, sum(valence) AS v FROM t JOIN l ON token = word GROUP BY doc_id)
SELECT doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, round(coalesce(v, 0), 6) AS valence, round(coalesce(v, 0) / sqrt(coalesce(v, 0) * coalesce(v, 0) + 15), 6) AS compound FROM documents LEFT JOIN h USING (doc_id)
"""
)
def sentiment(spark, sf_dir):
    lexicon = spark.createDataFrame(list(rules.SENTIMENT.items()), "word string, valence double")
    return analytics.sentiment(_docs(spark, sf_dir), "doc_id", F.broadcast(lexicon))


@register(
    f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM w)
SELECT doc_id, p::INTEGER AS place, array_to_string(w[greatest(p - 5, 0) + 1 : p + 6], ' ') AS line FROM x WHERE w[p + 1] = 'stupid'
"""
)
def concordance(spark, sf_dir):
    return analytics.concordance(_docs(spark, sf_dir), "doc_id", "stupid", 5)


@register(
    f"""
WITH {_TOKENS}, c AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2),
k AS (SELECT token, sum(tf) AS total, count(*) AS df FROM c GROUP BY token ORDER BY total DESC, token LIMIT 1000),
w AS (SELECT doc_id, token, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0) AS w FROM c JOIN k USING (token)),
z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM w GROUP BY doc_id)
SELECT doc_id, token, round(w / z, 6) AS weight FROM w JOIN z USING (doc_id)
"""
)
def tf_idf_terms(spark, sf_dir):
    return analytics.tf_idf(_docs(spark, sf_dir), "doc_id")


@register("SELECT doc_id FROM documents ORDER BY md5(concat('7:', doc_id)), doc_id LIMIT 100")
def random_sample(spark, sf_dir):
    """A hundred random documents without replacement, the same for the same seed: the sampling operator."""
    return analytics.sampled(_docs(spark, sf_dir), "doc_id", 100, 7).select("doc_id")


@register(
    f"""
WITH {_TOKENS}, l(word, valence) AS (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in rules.SENTIMENT.items())}),
h AS (SELECT doc_id, coalesce(l.valence, 0) AS v, l.valence AS raw FROM t LEFT JOIN l ON token = word),
g AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS m, sum(CASE WHEN v = 0 THEN 1.0::DOUBLE ELSE 0 END) AS z, avg(raw) AS mean FROM h GROUP BY doc_id)
SELECT doc_id, round(coalesce(p / nullif(p + m + z, 0), 0), 6) AS pos, round(coalesce(m / nullif(p + m + z, 0), 0), 6) AS neg, round(coalesce(z / nullif(p + m + z, 0), 0), 6) AS neu,
       round(coalesce(mean / 4.0::DOUBLE, 0), 6) AS polarity FROM documents LEFT JOIN g USING (doc_id)
"""
)
def sentiment_shares(spark, sf_dir):
    lexicon = spark.createDataFrame(list(rules.SENTIMENT.items()), "word string, valence double")
    return analytics.sentiment_shares(_docs(spark, sf_dir), "doc_id", lexicon)


_DIVERSE = f"m AS (SELECT doc_id, lang, len(list_distinct(t)) * 100.0::DOUBLE / nullif(len(t), 0) AS x FROM (SELECT doc_id, lang, {_PLAIN} AS t FROM documents))"


def _diversities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "lang", analytics.diversity(F.col("text")).alias("x"))


@register(f"WITH {_DIVERSE}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM m) SELECT least(floor((x - lo) / nullif(hi - lo, 0) * 20), 19)::BIGINT AS bin, count(*) AS n FROM m, b WHERE x IS NOT NULL GROUP BY 1")
def diversity_histogram(spark, sf_dir):
    return analytics.histogram(_diversities(spark, sf_dir), "x")


@register(f"WITH {_DIVERSE} SELECT lang, {', '.join(f'round(quantile_cont(x, {q}), 6) AS {n}' for q, n in ((0, 'least'), (0.25, 'q1'), (0.5, 'median'), (0.75, 'q3'), (1, 'most')))} FROM m GROUP BY lang")
def diversity_box(spark, sf_dir):
    return analytics.box(_diversities(spark, sf_dir), "x", "lang")


_FEELING = f"""{_TOKENS}, l(word, valence) AS (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in rules.SENTIMENT.items())}),
h AS (SELECT doc_id, sum(valence) AS v FROM t JOIN l ON token = word GROUP BY doc_id),
c AS (SELECT doc_id, lang, round(coalesce(v, 0) / sqrt(coalesce(v, 0) * coalesce(v, 0) + 15), 6) AS x FROM documents LEFT JOIN h USING (doc_id))"""


def _compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(rules.SENTIMENT.items()), "word string, valence double")
    return analytics.sentiment(_docs(spark, sf_dir), "doc_id", F.broadcast(lexicon)).select("doc_id", F.col("compound").alias("x"))


@register(f"WITH {_FEELING}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM c) SELECT least(floor((x - lo) / nullif(hi - lo, 0) * 20), 19)::BIGINT AS bin, count(*) AS n FROM c, b GROUP BY 1")
def compound_histogram(spark, sf_dir):
    return analytics.histogram(_compounds(spark, sf_dir), "x")


@register(f"WITH {_FEELING} SELECT {', '.join(f'round(quantile_cont(x, {q}), 6) AS {n}' for q, n in ((0, 'least'), (0.25, 'q1'), (0.5, 'median'), (0.75, 'q3'), (1, 'most')))} FROM c")
def compound_box(spark, sf_dir):
    return analytics.box(_compounds(spark, sf_dir), "x")


_SHARES_SQL = ORACLES["sentiment_shares"].strip().removeprefix("WITH ")
_FOUR = ("neg", "neu", "pos", "polarity")


@register(
    f"WITH f AS (WITH {_SHARES_SQL}), r AS (SELECT {', '.join(f'corr({a}, {b}) AS {a}_{b}' for a in _FOUR for b in _FOUR)} FROM f) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan({a}_{b}) THEN NULL ELSE {a}_{b} END, 6) AS r FROM r" for a in _FOUR for b in _FOUR)
)
def sentiment_correlation(spark, sf_dir):
    """The sentiment's four parts, each with each."""
    lexicon = spark.createDataFrame(list(rules.SENTIMENT.items()), "word string, valence double")
    return analytics.correlations(analytics.sentiment_shares(_docs(spark, sf_dir), "doc_id", lexicon), list(_FOUR))


@register("SELECT conv_id AS session_id, k FROM (SELECT conv_id, min(conv_id * 31 % 1009 * 1000 + conv_id) AS k FROM conversations GROUP BY conv_id) ORDER BY k DESC LIMIT 5")
def last_sessions(spark, sf_dir):
    """The five sessions that were added last, by an ordinal that stands for the order of adding."""
    k = (F.col("conv_id") * 31 % 1009 * 1000 + F.col("conv_id")).alias("k")
    return sessions.last_added(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), k).distinct(), "k", 5)


# Sessions: a title where a user begins, an index row where there are five turns, pinned where there are seven.
_TITLES = "SELECT 's' || lpad(conv_id::VARCHAR, 6, '0') AS session_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:7], ' ') AS title FROM conversations WHERE turn = 0 AND role = 'user'"
_INDEX = "SELECT 's' || lpad(conv_id::VARCHAR, 6, '0') AS session_id, '2026-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') AS created_at, CASE WHEN max(turn) = 5 THEN '' ELSE '2026-02-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') END AS updated_at, max(turn) >= 6 AS pinned FROM conversations GROUP BY conv_id HAVING max(turn) >= 4"
_MERGED = f"""t AS ({_TITLES}), i AS ({_INDEX}),
m AS (SELECT session_id AS id, coalesce(nullif(trim(title), ''), 'Session ' || left(session_id, 8)) AS title, coalesce(nullif(trim(created_at), ''), nullif(trim(updated_at), ''), '2026-03-01') AS created_at,
      coalesce(nullif(trim(updated_at), ''), nullif(trim(created_at), ''), '2026-03-01') AS updated_at, coalesce(pinned, false) AS pinned FROM t FULL JOIN i USING (session_id))"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("s"), F.lpad(F.col("conv_id").cast("string"), 6, "0")).alias("session_id")
    title = F.array_join(F.slice(F.array_remove(F.split("text", "\\s+"), ""), 1, 7), " ")
    day = F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")
    titles = rows.where("turn = 0 AND role = 'user'").select(key, title.alias("title"))
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last")).where("last >= 4")
    updated = F.when(F.col("last") == 5, "").otherwise(F.concat(F.lit("2026-02-"), day))
    index = last.select(key, F.concat(F.lit("2026-01-"), day).alias("created_at"), updated.alias("updated_at"), (F.col("last") >= 6).alias("pinned"))
    return sessions.merge_sessions(titles, index, "2026-03-01")


@register(f"WITH {_MERGED} SELECT * FROM m")
def session_full_outer(spark, sf_dir):
    return _sessions(spark, sf_dir)


@register(f"WITH {_MERGED} SELECT * FROM m WHERE NOT pinned AND (contains(lower(title), 'th') OR contains(lower(id), 'th')) ORDER BY pinned DESC, updated_at DESC, id LIMIT 20")
def session_list(spark, sf_dir):
    return sessions.list_sessions(_sessions(spark, sf_dir), "TH", "recent", 20)


_EXCHANGES = "e AS (SELECT conv_id AS session_id, turn AS asked, text AS user_query, n AS ai_response FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"


@register(f"WITH {_EXCHANGES} SELECT session_id, asked, user_query, ai_response, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY asked DESC) AS rank FROM e) WHERE rank <= 2")
def history_topk(spark, sf_dir):
    return sessions.latest_per_session(sessions.exchanges(table(spark, sf_dir, "conversations")), 2, "session_id", "asked")


@register(f"WITH {_EXCHANGES} SELECT session_id, asked, user_query, ai_response FROM e WHERE session_id = 3 ORDER BY asked DESC LIMIT 5")
def history_one_session(spark, sf_dir):
    return sessions.latest(sessions.exchanges(table(spark, sf_dir, "conversations")), 3, 5, "session_id", "asked")


@register(f"WITH {_EXCHANGES} SELECT session_id, asked, 0 AS part, 'user' AS role, user_query AS content FROM e WHERE trim(user_query) <> '' UNION ALL SELECT session_id, asked, 1, 'assistant', ai_response FROM e WHERE trim(ai_response) <> ''")
def history_messages(spark, sf_dir):
    return sessions.as_messages(sessions.exchanges(table(spark, sf_dir, "conversations")), "asked")


@register(f"WITH {_EXCHANGES}, p AS (SELECT * FROM e WHERE session_id = 3 ORDER BY asked DESC LIMIT 5) SELECT session_id, asked, user_query, ai_response FROM p ORDER BY asked LIMIT 2")
def history_oldest_of_page(spark, sf_dir):
    return sessions.oldest_of_page(sessions.exchanges(table(spark, sf_dir, "conversations")), 3, 5, 2, "session_id", "asked")


@register("SELECT conv_id AS session_id, count(*) AS n FROM conversations GROUP BY conv_id")
def messages_per_session(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n"))


@register(
    """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS k, 0::BIGINT AS n, NULL::TIMESTAMP AS until, false AS blocked FROM events
      UNION ALL
      SELECT e.user_id, e.event_id, e.k, CASE WHEN o.c >= 2 THEN o.c WHEN e.failed THEN o.c + 1 ELSE 0 END,
             CASE WHEN o.c >= 2 THEN o.u WHEN e.failed THEN coalesce(o.u, e.ts + INTERVAL 1 DAY) END, o.c >= 2
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1,
      LATERAL (SELECT CASE WHEN f.until IS NOT NULL AND e.ts >= f.until THEN 0 ELSE f.n END AS c, CASE WHEN f.until IS NOT NULL AND e.ts >= f.until THEN NULL ELSE f.until END AS u) o)
SELECT user_id, event_id, n, blocked FROM f WHERE event_id IS NOT NULL
"""
)
def login_limiter(spark, sf_dir):
    """Error events as failed attempts, by user: at most two failures a day."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return incremental.login_limits(rows, limit=2, seconds=86400).drop("ts")


@register(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(*) AS n_events, (epoch_us(min(ts)) // 1000000)::BIGINT AS start_s FROM s GROUP BY user_id, s
"""
)
def session_windows(spark, sf_dir):
    found = incremental.session_windows(table(spark, sf_dir, "events"))
    return found.select("user_id", "n_events", F.floor(F.col("session_start").cast("timestamp").cast("double")).cast("long").alias("start_s"))


@register("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def incremental_ingest(spark, sf_dir):
    """The events table taken in as a file stream, each id once."""
    base = f"{shared_dir(spark)}/ingest-{os.getpid()}-{os.urandom(4).hex()}"
    schema = table(spark, sf_dir, "events").schema.simpleString()[len("struct<") : -1]
    incremental.ingest(spark, sf_dir, ", ".join(x.replace(":", " ", 1) for x in schema.split(",")), f"{base}/out", f"{base}/state", "event_id", only="events.parquet")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


_HALF = (80 - len("stupid") - 2) // 2


@register(
    f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM w)
SELECT doc_id, p::INTEGER AS place, concat_ws(' ', right(array_to_string(w[greatest(p - 20, 0) + 1 : p], ' '), {_HALF}), 'stupid', left(array_to_string(w[p + 2 : p + 20], ' '), {_HALF})) AS line FROM x WHERE w[p + 1] = 'stupid'
"""
)
def concordance_lines(spark, sf_dir):
    """Concordance in lines of eighty characters."""
    return analytics.concordance_lines(_docs(spark, sf_dir), "doc_id", "stupid")


_BEFORE = "list_transform(list_reverse(w[greatest(p - 3, 0) + 1 : p]), lambda x: lower(x))"
_BOOSTED = " + ".join(f"sign(valence) * {f}::DOUBLE * CASE WHEN list_contains({sql_list(rules.BOOSTERS)}, b[{k + 1}]) THEN {rules.BOOST} WHEN list_contains({sql_list(rules.DAMPENERS)}, b[{k + 1}]) THEN -{rules.BOOST} ELSE 0 END" for k, f in enumerate(rules.FADING))


@register(
    f"""
WITH l(word, valence) AS (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in rules.SENTIMENT.items())}),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z'']+') AS w, least(len(coalesce(text, '')) - len(replace(coalesce(text, ''), '!', '')), 4) AS marks FROM documents),
t AS (SELECT doc_id, w, unnest(range(len(w))) AS p, len(list_filter(w, lambda x: x <> upper(x))) > 0 AS mixed FROM d),
h AS (SELECT doc_id, mixed, w[p + 1] AS t, {_BEFORE} AS b, valence FROM t JOIN l ON lower(w[p + 1]) = word),
v AS (SELECT doc_id, (valence + CASE WHEN mixed AND t = upper(t) AND len(t) > 1 THEN sign(valence) * {rules.EMPHASIS} ELSE 0 END + {_BOOSTED})
      * CASE WHEN len(list_intersect(b, {sql_list(rules.NEGATIONS)})) > 0 THEN {rules.TURN} ELSE 1.0 END::DOUBLE AS v FROM h),
g AS (SELECT doc_id, count(*) AS n, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS m, count(*) FILTER (v <> 0) AS k FROM v GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS size, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(m, 0) AS m, coalesce(k, 0) AS k, coalesce(s, 0) + sign(coalesce(s, 0)) * {rules.MARK}::DOUBLE * marks AS r FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_hits, round(s, 6) AS valence, round(r / sqrt(r * r + 15.0::DOUBLE), 6) AS compound, round(coalesce(p / nullif(p + m + size - k, 0), 0), 6) AS pos,
       round(coalesce(m / nullif(p + m + size - k, 0), 0), 6) AS neg, round(coalesce((size - k) / nullif(p + m + size - k, 0), 0), 6) AS neu FROM x
"""
)
def sentiment_in_context(spark, sf_dir):
    """Sentiment with negations, boosters, capitals and exclamation marks."""
    lexicon = spark.createDataFrame(list(rules.SENTIMENT.items()), "word string, valence double")
    return analytics.sentiment_in_context(_docs(spark, sf_dir), "doc_id", lexicon)
