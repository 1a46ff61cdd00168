"""The engine's API: ask, history and sessions over tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import intent
from lodestone.functions.text import citations, context_text, dedup_signature, nfkc, normalize_output
from lodestone.operators import knn, packing, search, sessions
from lodestone.seams import Embedder, ExtractiveGenerator, Generator, HashingEmbedder, QuarterCounter, TokenCounter, fact_check, follow_ups
from lodestone.session import written


def nearest(chunks: DataFrame, query_vector: list[float], k: int, vectors: DataFrame | None = None) -> DataFrame:
    """filename, chunk_id, text and similarity of the k nearest chunks.

    Ids and vectors alone are ranked; the texts of the k that are left are fetched by a broadcast join, so a
    question moves no text but theirs. ``vectors`` (chunk_id, embedding) may stand apart from ``chunks``.
    """
    vectors = chunks.select("chunk_id", "embedding") if vectors is None else vectors
    top = search.top_k(vectors.select("chunk_id", "embedding"), query_vector, k, "chunk_id").select("chunk_id", "similarity")
    return chunks.select("filename", "chunk_id", "text").join(F.broadcast(top), "chunk_id")


def retrieve(chunks: DataFrame, query: str, query_vector: list[float], tokens: TokenCounter, k: int = 20, most_tokens: int = 3500, per_file: int = 4, vectors: DataFrame | None = None) -> DataFrame:
    """The packed context rows of a query: top k by similarity, ordered by the intent's source priority, deduplicated, capped, budgeted.

    ``chunks`` has filename, chunk_id, text, and embedding unless ``vectors`` holds it.
    """
    top = nearest(chunks, query_vector, k, vectors).where(F.coalesce("text", F.lit("")) != "")
    of = intent.intent(F.lit(query))
    kind = intent.source_kind(F.col("filename"))
    rated = top.select("*", intent.source_priority(kind, of).alias("priority"), intent.is_skipped(kind, of).alias("skip")).where("NOT skip")
    return pack_rows(rated, [F.col("priority").desc(), F.col("similarity").desc(), F.col("chunk_id")], tokens, most_tokens, per_file)


def retrieve_strict(docs: DataFrame, chunks: DataFrame, query: str, filename: str, tokens: TokenCounter, most_tokens: int = 3500, query_vector: list[float] | None = None, k: int = 60, vectors: DataFrame | None = None) -> DataFrame:
    """The packed passages of one document; where there are none, its chunks by words in common; where it has none, its chunks among the k nearest.

    A way is planned only where the one before has no row, which one row of it tells.
    """
    name = F.col("chunk_id").cast("string").alias("chunk_id")
    mine = (F.col("filename") == filename) & (F.coalesce("text", F.lit("")) != "")
    found = search.rank_passages(docs.where(F.col("filename") == filename), "filename", "text", query)
    chosen = found.select("filename", F.concat(F.lit("raw_passage_"), F.col("idx").cast("string")).alias("chunk_id"), F.col("passage").alias("text"), F.col("rank").cast("double").alias("order"))
    if chosen.isEmpty():
        chosen = chunks.where(mine).select("filename", name, "text", (-search.lexical_score(F.col("text"), F.lit(query))).cast("double").alias("order"))
        if query_vector is not None and chosen.isEmpty():
            hits = nearest(chunks, query_vector, k, vectors).where(mine)
            chosen = hits.select("filename", name, "text", (-F.col("similarity")).alias("order"))
    return pack_rows(chosen.orderBy("order", "chunk_id").limit(k), [F.col("order"), F.col("chunk_id")], tokens, most_tokens, None)


#: Hits of a table of questions that are sent to every executor to fetch their texts; more are joined by shuffle.
BROADCAST_HITS = 200_000


def told(chunks: DataFrame, tokens: TokenCounter) -> DataFrame:
    """filename, chunk_id, signature, tokens and text_md5 of every chunk with a text: what packing asks of it, taken where the text is read."""
    name = F.col("chunk_id").cast("string").alias("chunk_id")
    return chunks.where(F.coalesce("text", F.lit("")) != "").select("filename", name, F.md5(dedup_signature(F.col("text")).cast("binary")).alias("signature"), tokens.column(F.col("text")).alias("tokens"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def nearest_many(chunks: DataFrame, questions: DataFrame, tokens: TokenCounter, k: int, n_questions: int, vectors: DataFrame | None = None) -> DataFrame:
    """query_id and similarity, with ``told``, of the k chunks nearest to each question; see ``nearest``. No text is moved."""
    vectors = chunks.select("chunk_id", "embedding") if vectors is None else vectors
    top = knn.nearest_many(vectors.withColumn("chunk_id", F.col("chunk_id").cast("string")), questions, k, "chunk_id", n_questions=n_questions).select("query_id", "chunk_id", "similarity")
    top = F.broadcast(top) if n_questions * k <= BROADCAST_HITS else top
    return told(chunks, tokens).join(top, "chunk_id")


def retrieve_many(chunks: DataFrame, questions: DataFrame, tokens: TokenCounter, k: int = 20, most_tokens: int = 3500, per_file: int = 4, vectors: DataFrame | None = None, n_questions: int | None = None, texts: bool = True) -> DataFrame:
    """``retrieve`` for a table of questions (query_id, query, vector): one plan for all of them.

    With ``text_md5``, and the texts themselves (``texts``) of the rows that are accepted, and of no others.
    """
    n_questions = questions.count() if n_questions is None else n_questions
    top = nearest_many(chunks, questions, tokens, k, n_questions, vectors)
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), intent.intent(F.col("query")).alias("intent"))
    kind = intent.source_kind(F.col("filename"))
    rated = top.join(asked, "query_id").select(*top.columns, intent.source_priority(kind, F.col("intent")).alias("priority"), intent.is_skipped(kind, F.col("intent")).alias("skip")).where("NOT skip")
    found = _pack_many(rated, [F.col("priority").desc(), F.col("similarity").desc(), F.col("chunk_id")], most_tokens, per_file)
    if not texts:
        return found
    return found.join(chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "filename", "text"), ["chunk_id", "filename"]).select(*found.columns, "text")


def retrieve_strict_many(docs: DataFrame, chunks: DataFrame, questions: DataFrame, tokens: TokenCounter, most_tokens: int = 3500, k: int = 60, vectors: DataFrame | None = None, n_questions: int | None = None) -> DataFrame:
    """``retrieve_strict`` for a table of questions (query_id, query, filename, vector): one plan for all of them.

    Only the documents that are asked for are read beyond their names. The passages are written, and the fallbacks are
    planned only if they leave a question without a row, and for those questions alone.
    """
    n_questions = questions.count() if n_questions is None else n_questions
    # A question and a name each.
    few = (lambda df: F.broadcast(df)) if n_questions <= BROADCAST_HITS else (lambda df: df)
    found = search.rank_passages(docs.select("filename", "text").join(few(questions.select("query_id", "query", "filename")), "filename"), ["query_id", "filename"], "text", F.col("query"))
    name = F.col("chunk_id").cast("string").alias("chunk_id")
    every = written(found.select("query_id", "filename", F.concat(F.lit("raw_passage_"), F.col("idx").cast("string")).alias("chunk_id"), F.col("passage").alias("text"), F.col("rank").cast("double").alias("order")), "passages")
    left = written(questions.join(every.select("query_id").distinct(), "query_id", "left_anti"), "unanswered")
    if not left.isEmpty():
        own = chunks.select("filename", "chunk_id", "text").where(F.coalesce("text", F.lit("")) != "")
        by_words = (-search.lexical_score(F.col("text"), F.col("query"))).cast("double").alias("order")
        second = own.join(few(left.select("query_id", "query", "filename")), "filename").select("query_id", "filename", name, "text", by_words)
        every = every.unionByName(second)
        if vectors is not None or "embedding" in chunks.columns:
            left = left.join(second.select("query_id").distinct(), "query_id", "left_anti")
            hits = nearest_many(chunks, left, tokens, k, n_questions, vectors).join(left.select("query_id", "filename"), ["query_id", "filename"])
            every = every.unionByName(hits.join(own.select("filename", name, "text"), ["filename", "chunk_id"]).select("query_id", "filename", "chunk_id", "text", (-F.col("similarity")).alias("order")))
    best = Window.partitionBy("query_id").orderBy("order", "chunk_id")
    chosen = every.withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= k)
    chosen = chosen.select("query_id", "filename", "chunk_id", "order", "text", F.md5(dedup_signature(F.col("text")).cast("binary")).alias("signature"), tokens.column(F.col("text")).alias("tokens"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return _pack_many(chosen, [F.col("order"), F.col("chunk_id")], most_tokens, None)


def weighted_context(scores: DataFrame, texts: DataFrame, key: str, least: float = 0.2, floor: float = 0.15, most: int = 15) -> DataFrame:
    """key, weight and line of the rows above the threshold: at most ``most`` of at least ``floor``, weighted by similarity.

    ``scores`` has key and similarity, ``texts`` key and text; the few rows that are left fetch their texts.
    """
    top = search.above(scores, least).where(F.col("similarity") >= floor).orderBy(F.col("similarity").desc(), key).limit(most)
    return search.weighted(texts.select(key, "text").join(F.broadcast(top), key), key, "text")


def checked_answer(chunks: DataFrame, query: str, query_vector: list[float], generator: Generator, k: int = 15, vectors: DataFrame | None = None, questions: int = 3) -> DataFrame:
    """One row: context of the k nearest chunks with each text once, answer, its fact check and follow-up questions."""
    order = [F.col("similarity").desc(), F.col("chunk_id")]
    distinct = search.distinct_texts(nearest(chunks, query_vector, k, vectors), order)
    context = search.joined_texts(distinct, order, k, between="\n").withColumn("answer", generator.answer(query, F.col("context")))
    return context.select("context", "answer", fact_check(F.col("answer"), F.col("context")).alias("check"), follow_ups(query, F.col("answer"), questions).alias("follow_ups"))


def pack_rows(rows: DataFrame, order: list, tokens: TokenCounter, most_tokens: int, per_file: int | None) -> DataFrame:
    """position, filename, chunk_id and text of the accepted rows; ``rows`` is a top-k."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    ranked = ranked.select(F.lit(1).alias("query_id"), "rank", "filename", F.col("chunk_id").cast("string").alias("chunk_id"), "text", dedup_signature(F.col("text")).alias("signature"), tokens.column(F.col("text")).alias("tokens"))
    kept = packing.pack(ranked, "query_id", most_tokens, per_file).select("position", "rank")
    return ranked.join(kept, "rank").select("position", "filename", "chunk_id", "text")


def _pack_many(rows: DataFrame, order: list, most_tokens: int, per_file: int | None) -> DataFrame:
    """query_id, position, filename, chunk_id, text_md5 (and text, if there) of the accepted rows of each question's top-k."""
    carried = ["text_md5", *(c for c in ("text",) if c in rows.columns)]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    kept = packing.pack(ranked, "query_id", most_tokens, per_file).select("query_id", "position", "rank")
    return ranked.select("query_id", "rank", "filename", "chunk_id", *carried).join(kept, ["query_id", "rank"]).select("query_id", "position", "filename", "chunk_id", *carried)


@dataclass
class Engine:
    """Tables and seams; every method returns a DataFrame or plain values."""

    docs: DataFrame
    chunks: DataFrame
    embedder: Embedder = field(default_factory=HashingEmbedder)
    tokens: TokenCounter = field(default_factory=QuarterCounter)
    generator: Generator = field(default_factory=ExtractiveGenerator)
    vectors: DataFrame | None = None  # chunk_id and embedding, where the chunks do not hold them

    def ask(self, query: str, strict: bool | None = None, target: str | None = None) -> DataFrame:
        """One row: answer, strict_mode, target_filename, citations and sources."""
        if not query or not query.strip():
            raise ValueError("query cannot be empty")
        if target is None:
            found = search.detect_target(self.docs.select("filename").distinct(), query).first()
            target = found.filename if found else None
        strict = target is not None if strict is None else bool(strict)
        if strict and target:
            rows = retrieve_strict(self.docs, self.chunks, query, target, self.tokens, query_vector=self.embedder.one(query), vectors=self.vectors)
        else:
            rows = retrieve(self.chunks, query, self.embedder.one(query), self.tokens, 60 if strict else 20, vectors=self.vectors)
        entry = F.struct("position", "filename", "chunk_id", "text")
        one = rows.agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        one = one.withColumn("context", context_text(F.col("entries")))
        return one.select(
            normalize_output(nfkc(self.generator.answer(query, F.col("context")))).alias("answer"),
            F.lit(strict).alias("strict_mode"),
            F.lit(target).cast("string").alias("target_filename"),
            citations(F.col("context")).alias("citations"),
            F.transform("entries", lambda e: F.struct(e.filename.alias("filename"), e.chunk_id.alias("chunk_id"), e.text.alias("text"))).alias("sources"),
        )

    def _asked(self, questions: DataFrame) -> DataFrame:
        """query_id, query, vector and target_filename (null where it names no document) of the questions that are not blank, written."""
        vector = F.col("vector") if "vector" in questions.columns else self.embedder.column(F.col("query"))
        asked = written(questions.where(F.trim(F.coalesce("query", F.lit(""))) != "").select(F.col("query_id").cast("long").alias("query_id"), "query", vector.alias("vector")), "questions")
        targets = search.detect_targets(self.docs, asked).select("query_id", F.col("filename").alias("target_filename"))
        return written(asked.join(targets, "query_id", "left"), "aimed")

    def _contexts(self, asked: DataFrame, texts: bool) -> DataFrame:
        n_questions = asked.count()
        normal = retrieve_many(self.chunks, asked.where("target_filename IS NULL"), self.tokens, vectors=self.vectors, n_questions=n_questions, texts=texts)
        aimed = asked.where("target_filename IS NOT NULL").withColumnRenamed("target_filename", "filename")
        if aimed.isEmpty():
            return normal
        strict = retrieve_strict_many(self.docs, self.chunks, aimed, self.tokens, vectors=self.vectors, n_questions=n_questions)
        return normal.unionByName(strict if texts else strict.drop("text"))

    def contexts(self, questions: DataFrame, texts: bool = True) -> DataFrame:
        """query_id, target_filename, position, filename, chunk_id, text_md5 and (``texts``) text: what every question of a table is answered from."""
        asked = self._asked(questions)
        found = self._contexts(asked, texts)
        return found.join(asked.select("query_id", "target_filename"), "query_id").select("query_id", "target_filename", *found.columns[1:])

    def ask_many(self, questions: DataFrame) -> DataFrame:
        """A row per question of a table (query_id, query, and vector unless the embedder gives it): what ``ask`` says of each.

        Blank questions have no row; a question without any context has an empty answer. A question names its document itself.
        The questions and what they aim at are written once; nothing depends on how many there are.
        """
        asked = self._asked(questions)
        entry = F.struct("position", "filename", "chunk_id", "text")
        found = self._contexts(asked, True).groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        one = asked.drop("vector").join(found, "query_id", "left")
        one = one.withColumn("entries", F.coalesce("entries", F.array().cast(found.schema["entries"].dataType)))
        one = one.withColumn("context", context_text(F.col("entries")))
        return one.select(
            "query_id",
            normalize_output(nfkc(self.generator.answer(F.col("query"), F.col("context")))).alias("answer"),
            F.col("target_filename").isNotNull().alias("strict_mode"),
            "target_filename",
            citations(F.col("context")).alias("citations"),
            F.transform("entries", lambda e: F.struct(e.filename.alias("filename"), e.chunk_id.alias("chunk_id"), e.text.alias("text"))).alias("sources"),
        )

    def history(self, table: DataFrame, session_id: str, limit: int = 5) -> DataFrame:
        return sessions.latest(table, session_id, limit)

    def list_sessions(self, titles: DataFrame, index: DataFrame, now: str, search_text: str = "", mode: str = "all", limit: int = 50) -> DataFrame:
        return sessions.list_sessions(sessions.merge_sessions(titles, index, now), search_text, mode, limit)

    def upsert_session(self, titles: DataFrame, index: DataFrame, session_id: str, now: str, title: str | None = None, pinned: bool | None = None) -> tuple[DataFrame, DataFrame]:
        return sessions.upsert_session(titles, index, session_id, now, title, pinned)

    def delete_session(self, titles: DataFrame, index: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
        return sessions.delete_session(titles, index, session_id)

    def store(self, history: DataFrame, session_id: str, query: str, answer: str, now: str) -> DataFrame:
        """The history with one exchange more."""
        return history.unionByName(sessions.exchange_row(history, session_id, query, answer, now))

    def store_exchange(self, history: DataFrame, titles: DataFrame, index: DataFrame, session_id: str, query: str, answer: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """History, titles and index with one exchange more; the session's title becomes the beginning of the query."""
        return self.store(history, session_id, query, answer, now), *sessions.upsert_session(titles, index, session_id, now, query.strip()[:80])

    def dispatch(self, action: str, **given):
        """An action by name, as a bridge or a worker calls it: ping, ask, history, sessions_list, session_upsert or session_delete."""
        actions = {
            "ping": lambda: {"ok": True},
            "ask": self.ask,
            "history": self.history,
            "sessions_list": self.list_sessions,
            "session_upsert": self.upsert_session,
            "session_delete": self.delete_session,
        }
        if action not in actions:
            raise ValueError(f"unknown action {action!r}")
        return actions[action](**given)
