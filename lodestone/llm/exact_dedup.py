"""Exact deduplication with streaming keyed state.

A stream of document digests feeds a keyed aggregate whose state lives in
RocksDB on the executors' disks and in the shared checkpoint folder. State is
kept per digest and never expires: the digest, the group's size, the stable
identifier (largest doc_id) and the content locator of that row (file and row,
or the identifier where the rows come from no file). The state holds no text.
Rows of a digest are counted within each task before they are shuffled, so a
digest that a third of all rows share is one small row per task.

A hit (a digest whose group has more than one row) is then checked in full:
the bytes of every row of the group are compared, as the least and the greatest
text of the digest, which each task finds for its own rows first, so that a
large group is a few rows a task. Should two texts share a digest and differ,
the group is split by the texts themselves, so a collision cannot drop a
document.

``DigestLog`` keeps the state in a folder of its own, for batches that come in over
many sessions: nothing is read again of the rows before but the one row that a hit's
locator names, whose bytes every new row of the digest is compared with.

Defined results: a null text counts as empty and equals an empty text. The row
with the largest doc_id stays; of rows that share it, the one with the largest
locator; rows that come from no file and share both id and text are one
document stored more than once and share their fate. A null doc_id is smaller
than any other. An empty table gives an empty table. Further columns pass
through ``survivors`` and are ignored by ``groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestone.llm.common import materialize, names_in, scratch, sha256_hex

#: State on disk; changes rather than whole files go to the checkpoint folder; no disk space is set aside ahead of use, as state is spread over many small
#: stores; memory outside the heap is bounded for all stores of an executor together.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Bytes of staged digests that one micro-batch takes.
BATCH_BYTES = 4 << 30
#: Groups with hits up to which their digests (about 200 bytes a group) are sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Parts that the rows of a digest are dealt to where hits are joined by shuffle.
SALTS = 16

_EVENT = "digest binary, doc_id long, locator string, n long"


def default_digest(text: Column) -> Column:
    return F.unhex(sha256_hex(text))


def _locator(docs: DataFrame) -> Column:
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 19, "0"))


def located(docs: DataFrame, digest=default_digest) -> DataFrame:
    """__row (all columns), __id, __text (never null), __digest and __locator of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), text.alias("__text"), digest(text).alias("__digest"), _locator(docs).alias("__locator"))


def update_state(events: DataFrame) -> DataFrame:
    """Keyed state over a stream (or a table) of ``digest, doc_id, locator, n`` events."""
    best = F.max(F.struct(F.col("doc_id"), F.col("locator")))
    return events.groupBy("digest").agg(best.alias("best"), F.sum("n").alias("group_size"))


def _with_state_conf(spark: SparkSession, run) -> None:
    """Run with the state store's settings; the session's own come back."""
    held = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        run()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_stream(spark: SparkSession, events_dir: str, batch_bytes: int = BATCH_BYTES, files_per_batch: int | None = None) -> DataFrame:
    """Feed the events under ``events_dir`` through the keyed state; the state at the end.

    Each micro-batch appends the groups it changed; the latest version of a
    digest is the one with the largest group.
    """
    out = scratch(spark, "exact-state")
    reader = spark.readStream.schema(_EVENT).option("maxBytesPerTrigger", batch_bytes)
    if files_per_batch:
        reader = spark.readStream.schema(_EVENT).option("maxFilesPerTrigger", files_per_batch)
    state = update_state(reader.parquet(events_dir))

    def append(changed: DataFrame, batch_id: int) -> None:
        rows = changed.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")
        rows.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")

    writer = state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    _with_state_conf(spark, lambda: writer.start().awaitTermination())
    changes = "digest binary, keep_id long, keep_locator string, group_size long"
    if not _exists(spark, f"{out}/changes"):
        return spark.createDataFrame([], changes)
    rows = spark.read.schema(changes).parquet(f"{out}/changes/*")
    latest = rows.groupBy("digest").agg(F.max(F.struct("group_size", "keep_id", "keep_locator")).alias("last"))
    return latest.select("digest", "last.keep_id", "last.keep_locator", "last.group_size")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _stage_events(rows: DataFrame) -> str:
    """Write one event per digest and task: the stream's source in the shared folder."""
    spark = rows.sparkSession
    path = scratch(spark, "exact-events")
    events = rows.select(F.col("__digest").alias("digest"), F.col("__id").alias("doc_id"), F.col("__locator").alias("locator"), F.lit(1).cast("long").alias("n"))
    events.write.option("compression", "zstd").parquet(f"{path}/rows")
    return f"{path}/rows"


def _is_kept() -> Column:
    return F.col("__id").eqNullSafe(F.col("__keep_id")) & (F.col("__locator") == F.col("__keep_locator"))


def _held_state(rows: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    state = run_stream(rows.sparkSession, _stage_events(rows), files_per_batch=files_per_batch)
    return materialize(state.toDF("__digest", "__keep_id", "__keep_locator", "__size"), "exact-groups")


def verify(rows: DataFrame, state: DataFrame) -> DataFrame | None:
    """Full bytes of every row of every hit; the digests that hold different texts.

    None when there is none, which is the case with any cryptographic digest.
    """
    hits = state.where("__size > 1").select("__digest")
    if hits.count() <= BROADCAST_ROWS:
        members = rows.select("__digest", "__text").join(F.broadcast(hits), "__digest", "left_semi")
    else:
        salt = F.pmod(F.xxhash64("__locator", "__id"), F.lit(SALTS)).cast("int")
        hits = hits.select("__digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        members = rows.select("__digest", "__text", salt.alias("__salt")).join(hits, ["__digest", "__salt"], "left_semi")
    # All texts of a digest are equal in every byte if its least and its greatest are; both are found within each task first.
    ends = members.groupBy("__digest").agg(F.min("__text").alias("__low"), F.max("__text").alias("__high"))
    wrong = materialize(ends.where(F.col("__low") != F.col("__high")).select("__digest"), "exact-collisions")
    return None if wrong.isEmpty() else wrong


def _resolved(rows: DataFrame, state: DataFrame, wrong: DataFrame | None) -> DataFrame:
    """``rows`` with their group's __keep_id, __keep_locator and __size."""
    good = rows.join(state, "__digest")
    if wrong is None:
        return good
    mixed = rows.join(wrong, "__digest", "left_semi")
    exact = mixed.groupBy("__text").agg(F.max(F.struct("__id", "__locator")).alias("__best"), F.count("*").alias("__size"))
    exact = exact.select("__text", F.col("__best.__id").alias("__keep_id"), F.col("__best.__locator").alias("__keep_locator"), "__size")
    split = mixed.join(exact, "__text")
    return good.join(wrong, "__digest", "left_anti").unionByName(split)


def groups(docs: DataFrame, digest=default_digest, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, locator and text_sha256 of every row of ``docs``."""
    rows = located(docs, digest)
    state = _held_state(rows, files_per_batch)
    wrong = verify(rows, state)
    lean = rows.withColumn("__sha", sha256_hex(F.col("__text")))
    lean = lean.drop("__row") if wrong is not None else lean.drop("__row", "__text")
    found = _resolved(lean, state, wrong)
    return found.select(F.col("__id").alias("doc_id"), F.col("__keep_id").alias("keep_id"), F.col("__size").alias("group_size"), _is_kept().alias("kept"), F.col("__locator").alias("locator"), F.col("__sha").alias("text_sha256"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = located(docs)
    state = _held_state(rows)
    return _resolved(rows, state, verify(rows, state)).where(_is_kept()).select("__row.*")


class DigestLog:
    """Exact deduplication of batches that come in one after another, in a folder that outlives the session.

    The folder holds the staged digests, the stream's checkpoint with the keyed state, and the groups that every
    micro-batch changed. A batch must be rows of files that stay where they are, since later hits are checked against them.
    One writer at a time; a batch that broke off may be added again once the rows staged for it are ``resumed``.
    """

    CHANGES = "digest binary, keep_id long, keep_locator string, first_batch long, first_locator string, group_size long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        #: Rows of earlier batches that the last ``add`` read again.
        self.read_again = 0

    def _names(self, folder: str, sign: str) -> list[int]:
        return [int(n.removeprefix(sign)) for n in names_in(self.spark, f"{self.path}/{folder}") if n.startswith(sign)]

    def resumed(self) -> int:
        """Take in what is staged and not in the state yet; the number of the last micro-batch before."""
        before = max(self._names("changes", "batch="), default=-1)
        if not self._names("events", "part-"):
            return before
        events = self.spark.readStream.schema(f"{_EVENT}, part long").option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{self.path}/events/*")
        first = F.min(F.struct("part", "locator"))
        state = events.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("best"), first.alias("first"), F.sum("n").alias("group_size"))

        def append(changed: DataFrame, batch_id: int) -> None:
            rows = changed.selectExpr("digest", "best.doc_id keep_id", "best.locator keep_locator", "first.part first_batch", "first.locator first_locator", "group_size")
            rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

        writer = state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True)
        _with_state_conf(self.spark, lambda: writer.start().awaitTermination())
        return before

    def _changed(self, after: int) -> DataFrame:
        """The latest state of the digests that micro-batches after a number changed."""
        paths = [f"{self.path}/changes/batch={b}" for b in self._names("changes", "batch=") if b > after]
        rows = self.spark.read.schema(self.CHANGES).parquet(*paths) if paths else self.spark.createDataFrame([], self.CHANGES)
        last = F.max_by(F.struct("keep_id", "keep_locator", "first_batch", "first_locator", "group_size"), "group_size")
        return rows.groupBy("digest").agg(last.alias("s")).select("digest", "s.*")

    def groups(self) -> DataFrame:
        """digest, keep_id, keep_locator and group_size of every text so far."""
        return self._changed(-1).select("digest", "keep_id", "keep_locator", "group_size")

    def add(self, docs: DataFrame, digest=default_digest) -> DataFrame:
        """doc_id, keep_id, group_size, kept, locator and verified of every row of a batch, after it.

        ``verified`` is false for a row whose digest is that of an earlier row with other bytes: it is kept.
        """
        self.resumed()
        part = max(self._names("events", "part-"), default=-1) + 1
        rows = materialize(located(docs, digest).drop("__row"), "exact-batch")
        events = rows.select(F.col("__digest").alias("digest"), F.col("__id").alias("doc_id"), F.col("__locator").alias("locator"), F.lit(1).cast("long").alias("n"), F.lit(part).cast("long").alias("part"))
        events.write.option("compression", "zstd").parquet(f"{self.path}/events/part-{part}")
        state = materialize(self._changed(self.resumed()), "exact-changed").withColumnRenamed("digest", "__digest")
        old = materialize(state.where(F.col("first_batch") < part).select("__digest", "first_locator"), "exact-hits")
        named = self._named(old)
        self.read_again = named.count()
        texts = named.select("__digest", F.col("__text").alias("__first"))
        inside = state.where((F.col("first_batch") == part) & (F.col("group_size") > 1)).select("__digest", F.col("first_locator").alias("__locator"))
        texts = texts.unionByName(rows.join(inside, ["__digest", "__locator"]).select("__digest", F.col("__text").alias("__first")).dropDuplicates(["__digest"]))
        found = rows.join(state, "__digest").join(texts, "__digest", "left")
        verified = F.coalesce(F.col("__text") == F.col("__first"), F.lit(True))
        best = F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__locator") == F.col("keep_locator"))
        return found.select(F.col("__id").alias("doc_id"), F.when(verified, F.col("keep_id")).otherwise(F.col("__id")).alias("keep_id"), F.when(verified, F.col("group_size")).otherwise(1).alias("group_size"), (best | ~verified).alias("kept"), F.col("__locator").alias("locator"), verified.alias("verified"))

    def _named(self, hits: DataFrame) -> DataFrame:
        """__digest and __text of the rows that locators name: only the files that hold one are read."""
        places = hits.select("__digest", F.col("first_locator").alias("__locator"), F.regexp_extract("first_locator", "^(.*)#[0-9]+$", 1).alias("__file"))
        files = [r[0] for r in places.select("__file").distinct().collect() if r[0]]  # names of files, not of rows
        if not files:
            return places.select("__digest", F.lit("").alias("__text")).limit(0)
        held = self.spark.read.parquet(*files)
        rows = held.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), _locator(held).alias("__locator"))
        return materialize(rows.join(places, "__locator").select("__digest", "__text"), "exact-named")
