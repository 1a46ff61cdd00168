"""Registered queries of the training-data operators and their SQL twins.

Each query reads its whole tables with production parameters.
"""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat_format, divergence, exact_dedup, license_scan, lm_score, minhash_dedup, mixing, periodic_runs, quality, secrets, substring_dedup, topk_search
from lodestone.llm.common import sha256_hex

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _ORACLES[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    """
WITH held AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
place AS (SELECT rid, unnest(range(len(words) - 34)) AS pos FROM held WHERE len(words) >= 35),
win AS (SELECT p.rid, p.pos, array_to_string(h.words[p.pos + 1 : p.pos + 35], ' ') AS run FROM place p JOIN held h USING (rid)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY run) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT rid, pos + s.k AS pos FROM twice, range(35) AS s(k)),
word AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS pos FROM held),
kept AS (SELECT word.rid, count(*) AS n, string_agg(w, ' ' ORDER BY pos) AS kept_text FROM word ANTI JOIN gone USING (rid, pos) GROUP BY word.rid)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM held LEFT JOIN kept USING (rid)
"""
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


@_query(mixing.oracle())
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.plan(docs, mixing.domain_of(F.col("source")), F.col("tokens") * mixing.PART, mixing.WEIGHTS, mixing.SEED, mixing.MAX_EPOCHS)


@_query(
    """
WITH vec AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM vec q JOIN vec c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
)
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


@_query(license_scan.oracle())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("matches")


@_query(
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query(
    """
WITH RECURSIVE held AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k : k + 2], ' '))) END AS s FROM held),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM grams),
link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM item a JOIN item b ON a.g = b.g AND a.doc_id <> b.doc_id
         GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM grams UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT g.doc_id, len(g.s) AS n_shingles, r.component_id, g.doc_id = r.component_id AS kept
FROM grams g JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) r ON r.u = g.doc_id
"""
)
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(_table(spark, sf_dir, "documents"), size=3, percent=85)


@_query()
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.conversations(_table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "position", "turn", "role", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked", sha256_hex(F.col("text")).alias("text_sha256"))


@_query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query()
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sha256_hex(F.col("base_spans")).alias("base_sha256"), "spans")


@_query()
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), TOKENIZER, ids_as_text=True))


@_query(divergence.oracle())
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


@_query()
def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(_table(spark, sf_dir, "documents"))


@_query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(_table(spark, sf_dir, "documents"), tile=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", sha256_hex(F.col("runs")).alias("runs_sha256"), sha256_hex(F.col("collapsed")).alias("collapsed_sha256"))


@_query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
