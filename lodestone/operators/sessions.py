"""Chat sessions and history on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clamped, session_title, truthy
from lodestone.operators.keyed_table import KeyedTable

SHORT_ANSWER = "No answer could be generated for this question."


def merge_sessions(titles: DataFrame, index: DataFrame, now: str) -> DataFrame:
    """id, title, created_at, updated_at and pinned of every session in either table."""
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c))
    both = titles.select(F.col("session_id"), F.col("title")).where(F.trim("title") != "").join(index, "session_id", "full_outer")
    created, updated = clean(F.col("created_at")), clean(F.col("updated_at"))
    begun = F.coalesce(created, updated, F.lit(now))
    return both.select(F.col("session_id").alias("id"), session_title(F.col("title"), F.col("session_id")).alias("title"), begun.alias("created_at"), F.coalesce(updated, begun).alias("updated_at"), F.coalesce("pinned", F.lit(False)).alias("pinned"))


def list_sessions(sessions: DataFrame, search: str = "", mode: str = "all", limit: int | None = 50) -> DataFrame:
    """Pinned first, then latest, ties by id; pinned, recent or all; title or id contains the search text."""
    found = sessions
    if mode == "pinned":
        found = found.where("pinned")
    elif mode == "recent":
        found = found.where("NOT pinned")
    if needle := search.strip().lower():
        found = found.where(F.contains(F.lower("title"), F.lit(needle)) | F.contains(F.lower("id"), F.lit(needle)))
    return found.orderBy(F.col("pinned").desc(), F.col("updated_at").desc(), "id").limit(clamped(limit, 1, 200, 50))


def upsert_session(titles: DataFrame, index: DataFrame, session_id: str, now: str, title: str | None = None, pinned: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with the session written: creation time kept, pin kept unless given, title kept unless given."""
    if not session_id.strip():
        raise ValueError("session_id is required")
    spark, name = titles.sparkSession, (title or "").strip()
    one = spark.range(1).select(F.lit(session_id).alias("session_id"))
    old_title = one.join(titles, "session_id", "left").groupBy("session_id").agg(F.max("title").alias("title"))
    new_title = old_title.select("session_id", F.coalesce(F.lit(name or None), F.col("title"), F.lit("New Session")).alias("title"))
    old_index = one.join(index, "session_id", "left").groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("pinned").alias("pinned"))
    created = F.coalesce(F.when(F.trim("created_at") != "", F.trim("created_at")), F.lit(now))
    new_index = old_index.select("session_id", created.alias("created_at"), F.lit(now).alias("updated_at"), F.coalesce(F.lit(pinned), F.col("pinned"), F.lit(False)).alias("pinned"))
    other = F.col("session_id") != session_id
    return titles.where(other).unionByName(new_title), index.where(other).unionByName(new_index)


def delete_session(titles: DataFrame, index: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    other = F.col("session_id") != session_id
    return titles.where(other), index.where(other)


class SessionStore:
    """Titles and index of sessions as keyed tables: a session that is written or goes touches its own folders alone."""

    def __init__(self, titles: KeyedTable, index: KeyedTable):
        self.titles, self.index = titles, index

    @classmethod
    def create(cls, titles: DataFrame, index: DataFrame, path: str, buckets: int = 64) -> SessionStore:
        return cls(KeyedTable.create(titles, f"{path}/titles", "session_id", buckets=buckets), KeyedTable.create(index, f"{path}/index", "session_id", "updated_at", buckets=buckets))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SessionStore:
        return cls(KeyedTable.open(spark, f"{path}/titles"), KeyedTable.open(spark, f"{path}/index"))

    def upsert(self, session_id: str, now: str, title: str | None = None, pinned: bool | None = None) -> None:
        """As ``upsert_session``."""
        titles, index = upsert_session(self.titles.lookup([session_id]), self.index.lookup([session_id]), session_id, now, title, pinned)
        self.titles.upsert(titles)
        self.index.upsert(index)

    def delete(self, session_id: str) -> bool:
        """Whether the session was there."""
        there = not (self.titles.lookup([session_id]).isEmpty() and self.index.lookup([session_id]).isEmpty())
        if there:
            for table in (self.titles, self.index):
                table.delete(table.lookup([session_id]).select("session_id"))
        return there

    def merged(self, now: str) -> DataFrame:
        return merge_sessions(self.titles.read(), self.index.read(), now)


def delete_history(history: DataFrame, session_id: str, key: str = "session_id") -> tuple[DataFrame, int]:
    """The history without one session, and how many rows that session had; rows without a session stay."""
    name = session_id.strip()
    return history.where(~F.col(key).eqNullSafe(F.lit(name))), history.where(F.col(key) == name).count()


def exchange_row(history: DataFrame, session_id: str, query: str, answer: str, now: str) -> DataFrame:
    """One exchange as a row of the history: line breaks flattened, answers under 10 characters replaced."""
    if not query.strip() or not answer.strip():
        raise ValueError("query and answer are required")
    flat = lambda t: F.trim(F.regexp_replace(F.lit(t), "[\\r\\n]+", " "))
    reply = F.when(F.length(F.trim(F.lit(answer))) < 10, F.lit(SHORT_ANSWER)).otherwise(flat(answer))
    return history.sparkSession.range(1).select(F.lit(session_id).alias("session_id"), F.to_timestamp(F.lit(now)).alias("ts"), flat(query).alias("user_query"), reply.alias("ai_response"))


def latest(history: DataFrame, session_id, limit: int | None = 5, key: str = "session_id", at: str = "ts") -> DataFrame:
    """The latest exchanges of one session, newest first; the filter reaches the scan."""
    return history.where(F.col(key) == session_id).orderBy(F.col(at).desc()).limit(clamped(limit, 1, 50, 5))


def oldest_of_page(history: DataFrame, session_id, limit: int | None = 5, most: int = 2, key: str = "session_id", at: str = "ts") -> DataFrame:
    """The oldest few of a session's latest page, oldest first."""
    return latest(history, session_id, limit, key, at).orderBy(F.col(at)).limit(most)


def last_added(rows: DataFrame, ordinal: str, n: int = 5) -> DataFrame:
    """The last few rows by the order in which they were added, in that order."""
    return rows.orderBy(F.col(ordinal).desc()).limit(n).orderBy(ordinal)


def parse_sessions(raw: DataFrame, now: str) -> DataFrame:
    """id, title, created_at, updated_at and pinned of rows whose columns may be in snake or camel case, or be missing."""

    def of(*names: str) -> Column:
        return F.coalesce(*[F.when(F.trim(F.col(n).cast("string")) != "", F.trim(F.col(n).cast("string"))) for n in names if n in raw.columns], F.lit(None).cast("string"))

    rows = raw.select(of("id", "session_id", "sessionId").alias("id"), of("title").alias("title"), of("created_at", "createdAt").alias("c"), of("updated_at", "updatedAt").alias("u"), truthy(of("pinned", "isPinned")).alias("p"))
    begun = F.coalesce("c", "u", F.lit(now))
    return rows.where("id IS NOT NULL").select("id", session_title(F.col("title"), F.col("id")).alias("title"), begun.alias("created_at"), F.coalesce("u", begun).alias("updated_at"), F.coalesce("p", F.lit(False)).alias("pinned"))


def latest_per_session(history: DataFrame, limit: int = 5, key: str = "session_id", at: str = "ts") -> DataFrame:
    """``rank`` 1 to ``limit`` by time, newest first, in every session."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc())
    return history.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def exchanges(messages: DataFrame) -> DataFrame:
    """session_id, asked, user_query, ai_response: each user turn with the assistant turn that follows it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    follows = messages.withColumn("__role", F.lead("role").over(order)).withColumn("__text", F.lead("text").over(order))
    return follows.where((F.col("role") == "user") & (F.col("__role") == "assistant")).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("asked"), F.col("text").alias("user_query"), F.col("__text").alias("ai_response"))


def as_messages(history: DataFrame, at: str = "ts") -> DataFrame:
    """Each exchange as a user and an assistant row, blank ones dropped; order by ``at`` and ``part``."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("user_query").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("ai_response").alias("content")))
    rows = history.select("session_id", at, F.posexplode(pair).alias("part", "m"))
    return rows.select("session_id", at, "part", "m.role", "m.content").where(F.trim("content") != "")


def cited(citations: DataFrame, sources: DataFrame, missing: str = "Source text is not available.") -> DataFrame:
    """Citations with the text of their source by (filename, chunk_id)."""
    return citations.join(sources.select("filename", "chunk_id", "text"), ["filename", "chunk_id"], "left").withColumn("text", F.coalesce("text", F.lit(missing)))
