"""Tables of questions: one plan answers all of them; lexical and cell indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import engine
from lodestone.functions import rules
from lodestone.operators import cells, lexical_index
from lodestone.operators.keyed_table import KeyedTable
from lodestone.plans.registry import ORACLES, register, sql_list, sql_tokens
from lodestone.plans.search_queries import QUERY, _KIND_SQL, _KINDS, _NAME_SQL, _SIGNATURE, _chunk_vectors, _chunks, _named, _query_vector
from lodestone.session import shared_dir, table

# The questions: what users say in conversations, each with a vector of the table; every fourth conversation's name a document.
_QUESTIONS_SQL = f"""
asked AS (SELECT c.conv_id * 1000 + c.turn AS query_id, CASE WHEN c.conv_id % 4 = 1 THEN concat('What does "2025 ', replace(list_extract({sql_list(_KINDS)}, (d.doc_id % 8)::INTEGER + 1), '_', ' '), ' ', d.doc_id, '" say of ', c.text)
                 ELSE c.text END AS query, e.embedding::DOUBLE[] AS v
          FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id + c.turn JOIN documents d ON d.doc_id = c.conv_id + 100 WHERE c.role = 'user')"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    kind = F.translate(F.element_at(F.array(*map(F.lit, _KINDS)), ((F.col("conv_id") + 100) % 8).cast("int") + 1), "_", " ")
    named = F.concat(F.lit('What does "2025 '), kind, F.lit(" "), (F.col("conv_id") + 100).cast("string"), F.lit('" say of '), F.col("text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__vec"), F.col("embedding").alias("vector"))
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") - 100).alias("conv_id"))
    rows = said.join(vectors, F.col("__vec") == F.col("conv_id") + F.col("turn")).join(ids, "conv_id", "left_semi")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.when(F.col("conv_id") % 4 == 1, named).otherwise(F.col("text")).alias("query"), "vector")


def _cues_sql(words, cues) -> str:
    """SQL of a rule of ``intent`` for a column ``query`` with its terms ``terms``."""
    return f"(len(list_intersect(terms, {sql_list(words)})) > 0 OR " + " OR ".join(f"contains(lower(query), '{c}')" for c in cues) + ")"


_TERMS_SQL = f"list_filter(list_distinct({sql_tokens("regexp_replace(query, '\"[^\"]+\"', ' ', 'g')")}), lambda x: NOT list_contains({sql_list(rules.STOP_WORDS)}, x))"
_COS_SQL = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))))"

#: Accepted candidates of every query: ``c`` has query_id, rank, filename, chunk_id, sig, tokens and cap (per file).
_PACK_SQL = """
f AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, []::VARCHAR[] AS sigs, []::VARCHAR[] AS files, 0::BIGINT AS total, false AS stop, false AS took FROM c
      UNION ALL
      SELECT c.query_id, c.rank, CASE WHEN t.take THEN list_append(f.sigs, c.sig) ELSE f.sigs END, CASE WHEN t.take THEN list_append(f.files, c.filename) ELSE f.files END,
             CASE WHEN t.take THEN f.total + c.tokens ELSE f.total END, f.stop OR (t.fits AND f.total + c.tokens > 3500), t.take
      FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.rank + 1,
      LATERAL (SELECT NOT f.stop AND NOT list_contains(f.sigs, c.sig) AND len(list_filter(f.files, lambda x: x = c.filename)) < c.cap AS fits,
                      NOT f.stop AND NOT list_contains(f.sigs, c.sig) AND len(list_filter(f.files, lambda x: x = c.filename)) < c.cap AND f.total + c.tokens <= 3500 AS take) t)"""

_CONTEXTS_SQL = f"""
WITH RECURSIVE {_QUESTIONS_SQL},
doc AS (SELECT doc_id, text, {_NAME_SQL} AS filename FROM documents),
name AS (SELECT DISTINCT filename, list_distinct({sql_tokens("replace(regexp_replace(filename, '\\.[^.]*$', ''), '_', ' ')")}) AS held FROM doc),
aim AS (SELECT query_id, contains(query, '"') AS quoted, unnest(CASE WHEN contains(query, '"') THEN regexp_extract_all(query, '"([^"]+)"', 1) ELSE [query] END) AS target FROM asked
        WHERE contains(query, '"') OR {' OR '.join(f"contains(lower(query), '{c}')" for c in rules.DOCUMENT_CUES)}),
toks AS (SELECT query_id, quoted, list_distinct({sql_tokens('target')}) AS tokens FROM aim),
fit AS (SELECT query_id, quoted, filename, len(list_intersect(tokens, held)) / len(tokens)::DOUBLE AS score FROM toks, name WHERE len(tokens) > 0 AND len(list_intersect(tokens, held)) > 0),
target AS (SELECT query_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filename) AS r FROM fit)
           WHERE r = 1 AND score >= CASE WHEN quoted THEN {rules.QUOTED_THRESHOLD} ELSE {rules.CUE_THRESHOLD} END),
normal AS (SELECT *, CASE WHEN {_cues_sql(rules.ACCIDENT_WORDS, rules.ACCIDENT_CUES)} THEN 'accident' WHEN {_cues_sql(rules.REGULATORY_WORDS, rules.REGULATORY_CUES)} THEN 'regulatory' ELSE 'neither' END AS intent
           FROM (SELECT *, {_TERMS_SQL} AS terms FROM asked ANTI JOIN target USING (query_id))),
sims AS (SELECT b.query_id, b.intent, a.vec_id, {_COS_SQL} AS sim FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings SEMI JOIN documents ON doc_id = vec_id) a, normal b),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id::VARCHAR) AS r FROM sims) WHERE r <= 20),
kinds AS (SELECT query_id, intent, sim, filename, doc_id::VARCHAR AS chunk_id, text, {_KIND_SQL} AS kind FROM top JOIN doc ON doc_id = vec_id WHERE text <> ''),
prio(intent, kind, priority) AS (VALUES {', '.join(f"('{i}', '{k}', {n})" for i, row in rules.PRIORITY.items() for k, n in row.items())}),
c1 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, round(sim, 12) DESC, chunk_id) AS rank, filename, chunk_id, text, 4 AS cap
       FROM kinds JOIN prio USING (intent, kind) WHERE kind <> 'accident_report' OR intent = 'accident'),
d AS (SELECT t.query_id, {_TERMS_SQL} AS terms, filename, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: len(p) > 80) AS ps
      FROM target t JOIN asked USING (query_id) JOIN doc USING (filename)),
n AS (SELECT *, CASE WHEN len(ps) >= 20 THEN len(ps) WHEN len(t) = 0 THEN 0 WHEN len(t) <= 1200 THEN 1 ELSE ceil((len(t) - 200) / 1000.0)::BIGINT END AS n FROM d WHERE len(terms) > 0),
x AS (SELECT *, unnest(range(n)) AS i FROM n),
p AS (SELECT query_id, filename, terms, i, CASE WHEN len(ps) >= 20 THEN ps[i + 1] ELSE substring(t, 1000 * i + 1, 1200) END AS passage FROM x),
h AS (SELECT *, list_intersect(terms, {sql_tokens('passage')}) AS h FROM p),
u AS (SELECT query_id, i, unnest(h) AS term FROM h),
df AS (SELECT query_id, term, count(*) AS df FROM u GROUP BY ALL),
o AS (SELECT u.query_id, u.i, sum(1.0::DOUBLE / (1.0 + df.df)) AS o FROM u JOIN df USING (query_id, term) GROUP BY ALL),
s AS (SELECT h.query_id, h.filename, h.i, h.passage, round(coalesce(o.o, 0)
      + CASE WHEN len(list_filter(terms, lambda t: starts_with(t, 'classif'))) > 0 AND contains(trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')), 'classified in two areas') THEN 1.0 ELSE 0 END
      + CASE WHEN list_contains(terms, 'measurand') AND contains(trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')), 'measurand list') THEN 1.0 ELSE 0 END, 9) AS score FROM h LEFT JOIN o USING (query_id, i)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM s),
c2 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, filename, concat('raw_passage_', i) AS chunk_id, passage AS text, 1000000 AS cap FROM r WHERE rank <= 12 AND (score > 0 OR top <= 0)),
c AS (SELECT *, {_SIGNATURE} AS sig, ceil(len(text) / 4.0)::BIGINT AS tokens FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2)),
{_PACK_SQL}
SELECT c.query_id, t.filename AS target_filename, row_number() OVER (PARTITION BY c.query_id ORDER BY c.rank)::INTEGER AS position, c.filename, c.chunk_id, md5(c.text) AS text_md5
FROM f JOIN c USING (query_id, rank) LEFT JOIN target t USING (query_id) WHERE f.took
"""


def _engine(spark: SparkSession, sf_dir: str) -> engine.Engine:
    return engine.Engine(_named(table(spark, sf_dir, "documents")).select("filename", "text"), _chunks(spark, sf_dir), vectors=_chunk_vectors(spark, sf_dir))


@register(_CONTEXTS_SQL)
def ask_many(spark, sf_dir):
    """The packed contexts of a table of questions, those about a named document included, in one plan."""
    return _engine(spark, sf_dir).contexts(_questions(spark, sf_dir), texts=False)


_INDEXES: dict[tuple, lexical_index.LexicalIndex] = {}


def _lexical_index(spark: SparkSession, sf_dir: str) -> lexical_index.LexicalIndex:
    """The index of a folder's documents, written once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = lexical_index.write_index(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}")
    return _INDEXES[key]


@register(ORACLES["lexical_overlap_rank"])
def lexical_index_rank(spark, sf_dir):
    """``lexical_overlap_rank`` from the written index: only the postings of the question's tokens are read."""
    return _lexical_index(spark, sf_dir).rank(QUERY).select(F.col("doc").alias("doc_id"), "score")


@register(
    """
WITH last AS (SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1),
said AS (SELECT conv_id, turn, upper(role) AS role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant') WHERE r = 1)
SELECT conv_id, coalesce(s.turn, l.turn) AS turn, coalesce(s.role, l.role) AS role FROM last l LEFT JOIN said s USING (conv_id) WHERE conv_id % 7 <> 0
"""
)
def merged_on_read(spark, sf_dir):
    """A keyed table of conversations' last rows, with changes and tombstones beside its base."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    held = KeyedTable.create(rows, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", "conv_id", "turn", buckets=16)
    held.upsert(rows.where("role = 'assistant'").withColumn("role", F.upper("role")))
    held.delete(rows.where("conv_id % 7 = 0"))
    return held.read()


_FITTED: dict[tuple, cells.Cells] = {}


def _grown_cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    """The cells of a folder's vectors, fitted and written once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = cells.Cells.fit(table(spark, sf_dir, "embeddings"), f"{shared_dir(spark)}/grown-{uuid.uuid4().hex}", "vec_id")
    return _FITTED[key]


@register()
def grown_cell_search(spark, sf_dir):
    """The five nearest of a vector from its nearest cells; approximate, so recall over many questions is what tests look at."""
    return _grown_cells(spark, sf_dir).search(_query_vector(spark, sf_dir), 5).select("vec_id", F.round("similarity", 6).alias("similarity"))
