"""Incremental ingest as a file stream, session windows, and the login limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMITER_SCHEMA = "user_id long, ts timestamp, n long, blocked boolean"


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, transform=None, files_per_batch: int | None = None, only: str | None = None) -> None:
    """Take in what is new under the folder ``source`` (files named like ``only``), each key once, and stop.

    The checkpoint remembers files and keys.
    """
    reader = spark.readStream.schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source).dropDuplicates([key])
    rows = transform(rows) if transform else rows
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def session_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each key: start, end and number of events. With ``late`` as a watermark on a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    found = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def _folded(limit: int, micros: int):
    """The limiter over rows in order: its state is three values, whatever a key's number of attempts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, until = None, 0, None
        for batch in batches:
            counts, stops = [], []
            keys, pieces, times, failures = (batch.column(c).to_pylist() for c in ("key", "piece", "at", "failed"))
            for key, piece, at, failed in zip(keys, pieces, times, failures):
                if (key, piece) != held:
                    held, n, until = (key, piece), 0, None
                if until is not None and at is not None and at >= until:
                    n, until = 0, None
                stop = n >= limit
                if not stop:
                    n, until = (n + 1, at + micros if until is None and at is not None else until) if failed else (0, None)
                counts.append(n)
                stops.append(stop)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), batch.column("ts"), pa.array(counts, pa.int64()), pa.array(stops)], names=["key", "event_id", "ts", "n", "blocked"])

    return rows


def login_limits(attempts: DataFrame, key: str = "user_id", limit: int = 10, seconds: int = 900) -> DataFrame:
    """``n`` and ``blocked`` of every attempt (key, event_id, ts, failed): a success clears, an expired window is dropped, a blocked attempt changes nothing.

    A window ends ``seconds`` after the failure that began it, so nothing is carried over a pause as long as that: a key's
    attempts are cut at such pauses, the pieces are dealt to tasks, and each task walks its rows in order, in linear time
    and with a state of three values: a key without any pause is never held as a whole.
    """
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    pause = F.coalesce(at - F.lag(at).over(order) >= seconds * 1_000_000, F.lit(True))
    rows = attempts.select(F.col(key).alias("key"), F.sum(pause.cast("long")).over(order).alias("piece"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), at.alias("at"), F.coalesce("failed", F.lit(False)).alias("failed"))
    sorted_rows = rows.repartition("key", "piece").sortWithinPartitions("key", "piece", "ts", "event_id")
    kind = dict(rows.dtypes)["key"]
    found = sorted_rows.mapInArrow(_folded(limit, seconds * 1_000_000), f"key {kind}, event_id long, ts timestamp, n long, blocked boolean")
    return found.withColumnRenamed("key", key)


def login_limits_stream(attempts: DataFrame, limit: int = 10, seconds: int = 900, late: str = "1 minute") -> DataFrame:
    """The same on a stream, with (count, window end) as keyed state that goes when the watermark passes the window's end."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def one(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for ts, failed in rows[["ts", "failed"]].itertuples(index=False):
            now = int(ts.value // 1000)
            if until and now >= until:
                count, until = 0, 0
            blocked = count >= limit
            if not blocked:
                count, until = (count + 1, until or now + seconds * 1_000_000) if failed else (0, 0)
            out.append((key[0], ts, count, blocked))
        if until:
            state.update((count, until))
            state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "ts", "n", "blocked"])

    held = attempts.withWatermark("ts", late)
    return held.groupBy("user_id").applyInPandasWithState(one, LIMITER_SCHEMA, "count long, until long", "append", GroupStateTimeout.EventTimeTimeout)


def sessions_by_gap(events: DataFrame, key: str = "user_id", ts: str = "ts", minutes: int = 30) -> DataFrame:
    """Session number of every event by the gap to the one before: for ordered batch work."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.col(ts).cast("timestamp").cast("long") - F.lag(F.col(ts).cast("timestamp").cast("long")).over(order)
    return events.withColumn("session_no", F.sum(F.when(gap.isNull() | (gap > minutes * 60), 1).otherwise(0)).over(order))
