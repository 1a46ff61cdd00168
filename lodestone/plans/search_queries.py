"""Vector and lexical search, context packing, answers, consistency."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import engine
from lodestone.functions import intent, rules, text, vectors
from lodestone.operators import consistency, packing, search, sessions
from lodestone.plans.registry import register, sql_list, sql_tokens
from lodestone.session import shared_dir, table
from lodestone.sources import sinks

QUERY = 'According to the document, which of the "and thereon" and thereor requirements shall the andre classify with ingtion edand?'
VECTOR_ID = 0
_COS = "list_sum(list_transform(list_zip(a.v, q.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(q.v, lambda x: x * x))))"
_SCORED = f"""
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT v FROM v WHERE vec_id = {VECTOR_ID}),
s AS (SELECT a.vec_id, a.label, {_COS} AS sim FROM v a, q)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The one row that stands for an embedded query."""
    return [float(x) for x in _vectors(spark, sf_dir).where(F.col("vec_id") == VECTOR_ID).first().embedding]


@register(f"WITH {_SCORED} SELECT vec_id, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return search.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@register(f"WITH {_SCORED} SELECT vec_id, round(sim, 6) AS similarity FROM s WHERE sim > greatest((SELECT avg(sim) FROM s), 0.2)")
def cosine_threshold(spark, sf_dir):
    found = search.above(search.scored(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)), 0.2)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@register(f"WITH {_SCORED} SELECT vec_id, round(sim, 6) AS similarity FROM s WHERE sim >= 0.15 ORDER BY sim DESC, vec_id LIMIT 15")
def dynamic_topn(spark, sf_dir):
    rows = search.scored(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)).where("similarity >= 0.15")
    return rows.orderBy(F.col("similarity").desc(), "vec_id").limit(15).select("vec_id", F.round("similarity", 6).alias("similarity"))


@register(
    f"""
WITH {_SCORED}, t AS (SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 5), z AS (SELECT sum(sim) AS z FROM t)
SELECT t.vec_id, round(sim / z, 6) AS weight, concat(printf('%.2f', sim / z), ' * ', d.text) AS line FROM t, z, documents d WHERE d.doc_id = t.vec_id
"""
)
def weighted_context(spark, sf_dir):
    top = search.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 5, "vec_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    found = search.weighted(top.select("vec_id", "similarity").join(docs, "vec_id", "left"), "vec_id", "text")
    return found.select("vec_id", F.round("weight", 6).alias("weight"), "line").where(F.col("line").isNotNull())


@register(f"WITH {_SCORED} SELECT vec_id, round(2 - 2 * sim, 6) + 0.0::DOUBLE AS distance FROM s ORDER BY round(2 - 2 * sim, 9), vec_id LIMIT 5")
def l2_topk(spark, sf_dir):
    rows = search.scored(_vectors(spark, sf_dir), _query_vector(spark, sf_dir))
    d = F.lit(2.0) - 2 * F.col("similarity")
    return rows.select("vec_id", d.alias("d")).orderBy(F.round("d", 9), "vec_id").limit(5).select("vec_id", (F.round("d", 6) + F.lit(0.0)).alias("distance"))


@register("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length, len(embedding) > 15 AS valid, len(embedding) AS size FROM embeddings")
def vector_validity(spark, sf_dir):
    e = F.col("embedding")
    return _vectors(spark, sf_dir).select("vec_id", F.round(vectors.norm(e), 6).alias("length"), vectors.is_valid(e).alias("valid"), F.size(e).cast("long").alias("size"))


CELLS, SAMPLE, RECALL = 10, 8192, 0.9


def _sample(spark: SparkSession, sf_dir: str, dims: int) -> list[list[float]]:
    """At most ``SAMPLE`` vectors in the order of their id's hash: what the cells are fitted on."""
    good = _vectors(spark, sf_dir).where((F.size("embedding") == dims) & (vectors.norm(F.col("embedding")) > 0))
    return [list(r.embedding) for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()]


@register(
    f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT label AS cell, arg_min(v, vec_id) AS c FROM v GROUP BY label ORDER BY label LIMIT 10),
d AS (SELECT v.vec_id, v.v, c.cell, list_sum(list_transform(list_zip(v.v, c.c), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v.v, lambda x: x * x))) * sqrt(list_sum(list_transform(c.c, lambda x: x * x)))) AS sim FROM v, c),
m AS (SELECT vec_id, v, cell, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cell) AS r FROM d) WHERE r = 1),
near AS (SELECT cell FROM d WHERE vec_id = {VECTOR_ID} ORDER BY sim DESC, cell LIMIT 3),
q AS (SELECT v FROM v WHERE vec_id = {VECTOR_ID}),
s AS (SELECT a.vec_id, {_COS} AS sim FROM m a, q WHERE a.cell IN (SELECT cell FROM near))
SELECT vec_id, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, vec_id LIMIT 5
"""
)
def cell_search(spark, sf_dir):
    """Cells fitted on a sample, as many probed as the sample's own neighbours need; the SQL's are first vectors of labels, three probed.

    The cells are written once for a session and folder; every question reads the folders of its nearest cells.
    """
    query = _query_vector(spark, sf_dir)
    path, probes = _cells(spark, sf_dir, len(query))
    return search.top_k(search.read_cells(spark, path, query, probes), query, 5, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


_WRITTEN: dict[tuple, tuple[str, int]] = {}


def _cells(spark: SparkSession, sf_dir: str, dims: int) -> tuple[str, int]:
    """Where the vectors lie by cell, and how many cells to probe."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        sample = _sample(spark, sf_dir, dims)
        centres = search.fit_centres(sample, CELLS)
        path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
        sinks.write_cells(search.assign_cells(_vectors(spark, sf_dir), centres), path, centres)
        _WRITTEN[key] = path, search.probes_for(sample, centres, 5, RECALL)
    return _WRITTEN[key]


def _terms(q: str) -> str:
    """SQL of ``query_terms``."""
    outside = "regexp_replace('" + q.replace("'", "''") + """', '"[^"]+"', ' ', 'g')"""
    return f"list_filter(list_distinct({sql_tokens(outside)}), lambda x: NOT list_contains({sql_list(rules.STOP_WORDS)}, x))"


_PHRASES = "list_transform(regexp_extract_all('" + QUERY.replace("'", "''") + "', '\"([^\"]+)\"', 1), lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')))"


@register(
    f"""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, (len(list_intersect({_terms(QUERY)}, string_split(t, ' '))) + 4 * len(list_filter({_PHRASES}, lambda p: contains(t, p))))::BIGINT AS score FROM n)
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20
"""
)
def lexical_overlap_rank(spark, sf_dir):
    score = search.lexical_score(F.col("text"), F.lit(QUERY)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20)


@register(
    f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'),
           lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: len(p) > 80) AS ps FROM documents),
n AS (SELECT *, CASE WHEN len(ps) >= 20 THEN len(ps) WHEN len(t) = 0 THEN 0 WHEN len(t) <= 1200 THEN 1 ELSE ceil((len(t) - 200) / 1000.0)::BIGINT END AS n FROM d),
x AS (SELECT doc_id, t, ps, unnest(range(n)) AS i FROM n),
p AS (SELECT doc_id, i, CASE WHEN len(ps) >= 20 THEN ps[i + 1] ELSE substring(t, 1000 * i + 1, 1200) END AS passage FROM x),
h AS (SELECT doc_id, i, passage, list_intersect({_terms(QUERY)}, {sql_tokens('passage')}) AS h FROM p),
u AS (SELECT doc_id, i, unnest(h) AS term FROM h),
df AS (SELECT doc_id, term, count(*) AS df FROM u GROUP BY 1, 2),
o AS (SELECT u.doc_id, u.i, sum(1.0::DOUBLE / (1.0 + df.df)) AS o FROM u JOIN df USING (doc_id, term) GROUP BY 1, 2),
s AS (SELECT h.doc_id, h.i, round(coalesce(o.o, 0) + CASE WHEN contains(trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')), 'classified in two areas') THEN 1.0 ELSE 0 END, 9) AS score FROM h LEFT JOIN o USING (doc_id, i)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank, max(score) OVER (PARTITION BY doc_id) AS top FROM s)
SELECT doc_id, i::INTEGER AS idx, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 12 AND (score > 0 OR top <= 0)
"""
)
def passage_rank(spark, sf_dir):
    found = search.rank_passages(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY)
    return found.select("doc_id", "idx", F.round("score", 6).alias("score"), "rank")


# Stand-in file names: a kind of source by number, the number, and the document's first words.
_KINDS = ("Accident_Report", "Regulation", "Advisory_Circular", "Standard", "Guide", "Report", "Book", "Memo")
_NAME_SQL = "concat('2025_', list_extract(" + sql_list(_KINDS) + ", (doc_id % 8)::INTEGER + 1), '_', doc_id, '_', array_to_string(list_filter(string_split(trim(regexp_replace(lower(left(text, 60)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) > 2)[1:3], '_'), CASE WHEN doc_id % 8 = 7 THEN '.docx' ELSE '.pdf' END)"


def _named(docs: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 8).cast("int") + 1)
    head = F.array_join(F.slice(text.tokens_for_match(F.left("text", F.lit(60))), 1, 3), "_")
    ending = F.when(F.col("doc_id") % 8 == 7, ".docx").otherwise(".pdf")
    return docs.withColumn("filename", F.concat(F.lit("2025_"), kind, F.lit("_"), F.col("doc_id").cast("string"), F.lit("_"), head, ending))


def _target_sql(query: str) -> str:
    """SQL of ``target_score`` for a query with one quoted phrase, against the name's tokens ``t``."""
    asked = f"list_distinct({sql_tokens('regexp_extract(' + chr(39) + query + chr(39) + ', ' + chr(39) + chr(34) + '([^' + chr(34) + ']+)' + chr(34) + chr(39) + ', 1)')})"
    return f"len(list_intersect({asked}, t)) / len({asked})::DOUBLE"


TARGET_QUERY = 'What does "2025 Guide 12 about" say?'


@register(
    f"""
WITH f AS (SELECT {_NAME_SQL} AS filename FROM documents),
t AS (SELECT filename, list_filter(string_split(trim(regexp_replace(lower(replace(regexp_replace(filename, '\\.[^.]*$', ''), '_', ' ')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) > 2) AS t FROM f)
SELECT filename, round({_target_sql(TARGET_QUERY)}, 6) AS score FROM t ORDER BY score DESC, filename LIMIT 1
"""
)
def target_document(spark, sf_dir):
    found = search.detect_target(_named(table(spark, sf_dir, "documents")), TARGET_QUERY)
    return found.select("filename", F.round("score", 6).alias("score"))


_KIND_SQL = "CASE " + " ".join(f"WHEN contains(lower(filename), '{p}') THEN '{k}'" for p, k in rules.SOURCE_KINDS) + " WHEN ends_with(lower(filename), '.pdf') THEN 'reference' ELSE 'other' END"
_INTENT_QUERIES = ("ntsb crash findings", "part 25 compliance", "apart from theory", "how wings lift", "incident report and FAA order")
_INTENTS = ("accident", "regulatory", "regulatory", "neither", "accident")


@register(
    f"""
WITH q(query, intent) AS (VALUES {', '.join(f"('{q}', '{i}')" for q, i in zip(_INTENT_QUERIES, _INTENTS))}),
f AS (SELECT {_NAME_SQL} AS filename FROM documents), k AS (SELECT filename, {_KIND_SQL} AS kind FROM f),
p(intent, kind, priority) AS (VALUES {', '.join(f"('{i}', '{k}', {n})" for i, row in rules.PRIORITY.items() for k, n in row.items())})
SELECT q.query, k.kind, p.priority, (k.kind = 'accident_report' AND q.intent <> 'accident') AS skip, count(*) AS n FROM q, k JOIN p ON p.kind = k.kind WHERE p.intent = q.intent GROUP BY ALL
"""
)
def intent_priority(spark, sf_dir):
    queries = spark.createDataFrame([(q,) for q in _INTENT_QUERIES], "query string").withColumn("intent", intent.intent(F.col("query")))
    kinds = _named(table(spark, sf_dir, "documents")).select(intent.source_kind(F.col("filename")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    met = kinds.join(F.broadcast(queries))
    return met.select("query", "kind", intent.source_priority(F.col("kind"), F.col("intent")).alias("priority"), intent.is_skipped(F.col("kind"), F.col("intent")).alias("skip"), "n")


_SIGNATURE = "left(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 400)"


@register(
    f"""
WITH RECURSIVE {_SCORED}, top AS (SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 60),
c AS (SELECT row_number() OVER (ORDER BY sim DESC, vec_id) AS rank, doc_id::VARCHAR AS chunk_id, source AS filename, {_SIGNATURE} AS sig, ceil(len(text) / 4.0)::BIGINT AS tokens FROM top JOIN documents ON doc_id = vec_id),
f AS (SELECT 0::BIGINT AS rank, []::VARCHAR[] AS sigs, []::VARCHAR[] AS files, 0::BIGINT AS total, false AS stop, false AS took
      UNION ALL
      SELECT c.rank, CASE WHEN t.take THEN list_append(f.sigs, c.sig) ELSE f.sigs END, CASE WHEN t.take THEN list_append(f.files, c.filename) ELSE f.files END,
             CASE WHEN t.take THEN f.total + c.tokens ELSE f.total END, f.stop OR (t.fits AND f.total + c.tokens > 3500), t.take
      FROM f JOIN c ON c.rank = f.rank + 1,
      LATERAL (SELECT NOT f.stop AND NOT list_contains(f.sigs, c.sig) AND len(list_filter(f.files, lambda x: x = c.filename)) < 4 AS fits,
                      NOT f.stop AND NOT list_contains(f.sigs, c.sig) AND len(list_filter(f.files, lambda x: x = c.filename)) < 4 AND f.total + c.tokens <= 3500 AS take) t)
SELECT row_number() OVER (ORDER BY c.rank)::INTEGER AS position, c.rank::INTEGER AS rank, c.chunk_id, c.filename, c.tokens FROM f JOIN c USING (rank) WHERE f.took
"""
)
def context_pack(spark, sf_dir):
    top = search.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 60, "vec_id").select("vec_id", "similarity")
    docs = table(spark, sf_dir, "documents")
    rows = docs.join(top, F.col("doc_id") == F.col("vec_id"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("similarity").desc(), "vec_id")
    ranked = rows.select(F.lit(1).alias("query_id"), F.row_number().over(order).alias("rank"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("filename"), text.dedup_signature(F.col("text")).alias("signature"), F.ceil(F.length("text") / 4).alias("tokens"))
    return packing.pack(ranked).drop("query_id")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, without vectors."""
    return _named(table(spark, sf_dir, "documents")).select("filename", F.col("doc_id").cast("string").alias("chunk_id"), "text")


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the chunks that there are: ids alone are compared, no text is read."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return _vectors(spark, sf_dir).join(ids, "vec_id", "left_semi").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")


@register(
    f"""
WITH RECURSIVE {_SCORED}, j AS (SELECT s.sim, doc_id, text, {_NAME_SQL} AS filename FROM s JOIN documents ON doc_id = vec_id),
top AS (SELECT * FROM j ORDER BY sim DESC, doc_id::VARCHAR LIMIT 20),
k AS (SELECT *, {_KIND_SQL} AS kind FROM top),
p(kind, priority) AS (VALUES {', '.join(f"('{k}', {n})" for k, n in rules.PRIORITY['neither'].items())}),
c AS (SELECT row_number() OVER (ORDER BY p.priority DESC, sim DESC, doc_id::VARCHAR) AS rank, doc_id::VARCHAR AS chunk_id, filename, text, {_SIGNATURE} AS sig, ceil(len(text) / 4.0)::BIGINT AS tokens
      FROM k JOIN p ON p.kind = k.kind WHERE k.kind <> 'accident_report'),
f AS (SELECT 0::BIGINT AS rank, []::VARCHAR[] AS sigs, 0::BIGINT AS total, false AS stop, false AS took
      UNION ALL
      SELECT c.rank, CASE WHEN t.take THEN list_append(f.sigs, c.sig) ELSE f.sigs END, CASE WHEN t.take THEN f.total + c.tokens ELSE f.total END,
             f.stop OR (NOT f.stop AND NOT list_contains(f.sigs, c.sig) AND f.total + c.tokens > 3500), t.take
      FROM f JOIN c ON c.rank = f.rank + 1, LATERAL (SELECT NOT f.stop AND NOT list_contains(f.sigs, c.sig) AND f.total + c.tokens <= 3500 AS take) t)
SELECT row_number() OVER (ORDER BY c.rank)::INTEGER AS position, c.filename, c.chunk_id, c.text FROM f JOIN c USING (rank) WHERE f.took
"""
)
def ask_normal(spark, sf_dir):
    """The flagship: the packed context of one question, end to end."""
    return engine.retrieve(_chunks(spark, sf_dir), "how wings lift", _query_vector(spark, sf_dir), engine.QuarterCounter(), vectors=_chunk_vectors(spark, sf_dir))


STRICT_QUERY = 'What does "2025 Guide 12" say of the andre that shall classify with ingtion edand, and thereon of thereor?'


@register(
    f"""
WITH RECURSIVE f0 AS (SELECT doc_id, text, {_NAME_SQL} AS filename FROM documents),
n0 AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(replace(regexp_replace(filename, '\\.[^.]*$', ''), '_', ' ')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) > 2) AS t FROM f0),
target AS (SELECT * FROM (SELECT doc_id, text, filename, {_target_sql(STRICT_QUERY)} AS score FROM n0) WHERE score >= 0.5 ORDER BY score DESC, filename LIMIT 1),
d AS (SELECT filename, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: len(p) > 80) AS ps FROM target),
n AS (SELECT *, CASE WHEN len(ps) >= 20 THEN len(ps) WHEN len(t) = 0 THEN 0 WHEN len(t) <= 1200 THEN 1 ELSE ceil((len(t) - 200) / 1000.0)::BIGINT END AS n FROM d),
x AS (SELECT filename, t, ps, unnest(range(n)) AS i FROM n),
p AS (SELECT filename, i, CASE WHEN len(ps) >= 20 THEN ps[i + 1] ELSE substring(t, 1000 * i + 1, 1200) END AS passage FROM x),
h AS (SELECT *, list_intersect({_terms(STRICT_QUERY)}, {sql_tokens('passage')}) AS h FROM p),
u AS (SELECT i, unnest(h) AS term FROM h),
df AS (SELECT term, count(*) AS df FROM u GROUP BY term),
o AS (SELECT u.i, sum(1.0::DOUBLE / (1.0 + df.df)) AS o FROM u JOIN df USING (term) GROUP BY u.i),
s AS (SELECT h.filename, h.i, h.passage, round(coalesce(o.o, 0) + CASE WHEN contains(trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')), 'classified in two areas') THEN 1.0 ELSE 0 END, 9) AS score FROM h LEFT JOIN o USING (i)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, i) AS rank, max(score) OVER () AS top FROM s),
c AS (SELECT row_number() OVER (ORDER BY rank) AS rank, filename, concat('raw_passage_', i) AS chunk_id, passage AS text, {_SIGNATURE.replace('text', 'passage')} AS sig, ceil(len(passage) / 4.0)::BIGINT AS tokens FROM r WHERE rank <= 12 AND (score > 0 OR top <= 0)),
f AS (SELECT 0::BIGINT AS rank, []::VARCHAR[] AS sigs, 0::BIGINT AS total, false AS stop, false AS took
      UNION ALL
      SELECT c.rank, CASE WHEN t.take THEN list_append(f.sigs, c.sig) ELSE f.sigs END, CASE WHEN t.take THEN f.total + c.tokens ELSE f.total END,
             f.stop OR (NOT list_contains(f.sigs, c.sig) AND f.total + c.tokens > 3500), t.take
      FROM f JOIN c ON c.rank = f.rank + 1, LATERAL (SELECT NOT f.stop AND NOT list_contains(f.sigs, c.sig) AND f.total + c.tokens <= 3500 AS take) t)
SELECT row_number() OVER (ORDER BY c.rank)::INTEGER AS position, c.filename, c.chunk_id, c.text FROM f JOIN c USING (rank) WHERE f.took
"""
)
def ask_strict(spark, sf_dir):
    """A question about a document that it names: the document is resolved, and its passages are packed."""
    docs = _named(table(spark, sf_dir, "documents")).select("filename", "text")
    target = search.detect_target(docs, STRICT_QUERY).first()
    return engine.retrieve_strict(docs, _chunks(spark, sf_dir), STRICT_QUERY, target.filename if target else "", engine.QuarterCounter())


@register()
def ask_answer(spark, sf_dir):
    docs = _named(table(spark, sf_dir, "documents"))
    made = engine.Engine(docs, _chunks(spark, sf_dir), vectors=_chunk_vectors(spark, sf_dir))
    return made.ask("how wings lift").select("answer", "strict_mode", F.size("citations").alias("n_citations"), F.size("sources").alias("n_sources"))


@register(
    f"""
WITH {_SCORED}, t AS (SELECT vec_id, sim FROM s WHERE sim > greatest((SELECT avg(sim) FROM s), 0.2) AND sim >= 0.15 ORDER BY sim DESC, vec_id LIMIT 15),
j AS (SELECT t.vec_id, t.sim, d.text FROM t JOIN documents d ON d.doc_id = t.vec_id), z AS (SELECT sum(sim) AS z FROM j)
SELECT vec_id::VARCHAR AS chunk_id, round(sim / z, 6) AS weight, concat(printf('%.2f', sim / z), ' * ', text) AS line FROM j, z
"""
)
def threshold_context(spark, sf_dir):
    """The alternate engine's retrieval: everything above the threshold, at most fifteen, weighted."""
    scores = search.scored(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select(F.col("vec_id").cast("long").alias("chunk_id"), "similarity")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = engine.weighted_context(scores, texts, "chunk_id")
    return found.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.round("weight", 6).alias("weight"), "line")


@register(
    f"""
WITH {_SCORED}, t AS (SELECT s.sim, d.doc_id::VARCHAR AS id, d.text FROM s JOIN documents d ON d.doc_id = s.vec_id ORDER BY sim DESC, id LIMIT 15),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY sim DESC, id) AS r FROM t) WHERE r = 1)
SELECT string_agg(text, chr(10) ORDER BY sim DESC, id) AS context FROM k
"""
)
def checked_search(spark, sf_dir):
    """Search, each text once, answer, fact check and follow-ups; the context is what SQL can say."""
    made = engine.checked_answer(_chunks(spark, sf_dir), "how wings lift", _query_vector(spark, sf_dir), engine.ExtractiveGenerator(), vectors=_chunk_vectors(spark, sf_dir))
    return made.where(F.col("check").isNotNull() & F.col("follow_ups").isNotNull()).select("context")


@register()
def checked_answer(spark, sf_dir):
    """All that the alternate engine says of a question: context, answer, its fact check and the follow-up questions."""
    return engine.checked_answer(_chunks(spark, sf_dir), "how wings lift", _query_vector(spark, sf_dir), engine.ExtractiveGenerator(), vectors=_chunk_vectors(spark, sf_dir))


@register("SELECT vec_id, 4 * len(embedding) AS n_bytes, round(list_sum(embedding::FLOAT[]::DOUBLE[]), 6) AS total FROM embeddings")
def float32_pack(spark, sf_dir):
    """Vectors packed to bytes and read back."""
    blob = _vectors(spark, sf_dir).select("vec_id", vectors.pack(F.col("embedding")).alias("blob"))
    total = F.aggregate(vectors.unpack(F.col("blob")), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return blob.select("vec_id", F.length("blob").cast("long").alias("n_bytes"), F.round(total, 6).alias("total"))


@register("SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l USING (doc_id)")
def new_chunks(spark, sf_dir):
    return consistency.new_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@register("SELECT DISTINCT d.source FROM documents d ANTI JOIN labels l USING (doc_id)")
def files_with_new_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return consistency.with_new_parts(docs.select("source").distinct(), docs, table(spark, sf_dir, "labels"), "source", "doc_id").orderBy("source")


@register(
    """
WITH stored AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN label = 5 THEN 1e-3 ELSE 0 END) AS e FROM embeddings WHERE label <> 3),
gap AS (SELECT l.vec_id, s.vec_id AS there, len(l.embedding) = len(s.e) AS same, list_max(list_transform(list_zip(l.embedding, s.e), lambda p: abs(p[1]::DOUBLE - p[2]))) AS most FROM embeddings l LEFT JOIN stored s USING (vec_id))
SELECT CASE WHEN there IS NULL THEN 'missing' WHEN same AND most <= 1e-6 THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n FROM gap GROUP BY 1
"""
)
def consistency_check(spark, sf_dir):
    """Local vectors against a store that lacks one label and differs in another."""
    local = _vectors(spark, sf_dir)
    off = F.transform("embedding", lambda x: x + F.when(F.col("label") == 5, F.lit(1e-3)).otherwise(F.lit(0.0)))
    stored = local.where(F.col("label") != 3).select("vec_id", off.alias("embedding"))
    return consistency.compare(local, stored, "vec_id").groupBy("status").agg(F.count("*").alias("n"))


@register("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates_having(spark, sf_dir):
    return consistency.repeated(table(spark, sf_dir, "documents"), "text")


@register("SELECT label::VARCHAR AS filename, count(*) AS n, count(DISTINCT len(embedding)) AS n_sizes, round(avg(len(embedding)), 6) AS mean_size FROM embeddings GROUP BY label")
def embeddings_per_file(spark, sf_dir):
    name = F.coalesce(F.col("label").cast("string"), F.lit("Unknown")).alias("filename")
    return _vectors(spark, sf_dir).groupBy(name).agg(F.count("*").alias("n"), F.count_distinct(F.size("embedding")).alias("n_sizes"), F.round(F.avg(F.size("embedding")), 6).alias("mean_size"))


@register("SELECT count(*) AS n, count(*) FILTER (source = 'added') AS n_added, count(*) FILTER (lang IS NULL) AS n_null FROM (SELECT source, lang FROM documents UNION ALL SELECT 'added', NULL FROM pages)")
def corpus_append(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("added").alias("source"))
    both = consistency.append_all(table(spark, sf_dir, "documents"), pages)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("source") == "added").alias("n_added"), F.count_if(F.col("lang").isNull()).alias("n_null"))


@register(
    """
WITH c AS (SELECT conv_id, turn, role, 0 AS new FROM conversations UNION ALL SELECT conv_id, turn, upper(role), 1 FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, new DESC) AS r FROM c) WHERE r = 1
"""
)
def upsert_latest(spark, sf_dir):
    now = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    changes = now.where("role = 'assistant'").withColumn("role", F.upper("role"))
    return consistency.upsert(now, changes, "conv_id", "turn")


@register(
    """
SELECT source AS filename, doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN text ELSE 'Source text is not available.' END AS text FROM documents
"""
)
def citation_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("filename"), F.col("doc_id").cast("string").alias("chunk_id"), "text", "doc_id")
    return sessions.cited(docs.select("filename", "chunk_id"), docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"))


@register()
def lsh_search(spark, sf_dir):
    """Approximate nearest vectors by random projections: the alternative to cells."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = _vectors(spark, sf_dir).select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=6, seed=11).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense(_query_vector(spark, sf_dir)), 5, distCol="distance")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))
