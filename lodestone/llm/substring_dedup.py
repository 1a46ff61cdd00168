"""Substring dedup with a log-structured fingerprint index.

A window is ``window`` consecutive words of one document. Every word is removed
that is covered by a window whose word sequence also starts anywhere else, in
the same document or another; windows are judged on the input.

Index. Of every window the smallest hash among its shorter sub-windows is kept
(a minimiser: any two equal windows keep the same one, and neighbouring windows
mostly share theirs, so about one word in eight is kept). A batch of documents
becomes an immutable run: per hash bucket its sorted fingerprints, each with the
chunks of documents that hold it and a mark if it was seen before, found by
merging the sorted batch with the runs so far. Runs are compacted into one when
they become many. So history is never rewritten when a batch comes in, and no
text is compared that shares no fingerprint. The number of buckets follows the
words taken in (``BUCKET_WORDS``): compaction deals the runs to twice as many
when they outgrow it.

The log lives in a folder: chunks, runs and a manifest, a small file written as a
whole after every step, so a later session opens the folder and goes on. A new
batch is judged against history by its runs alone; of the old texts only those
chunks are read again that share a fingerprint with it.

Verification. Windows whose fingerprint is marked are judged by a 128-bit hash
of their words. Both steps are questions from chunks of documents to hash
buckets: a chunk asks once for each distinct hash, and the bucket answers with
one bit per question. A passage that a third of all rows share is one question
per chunk, so no bucket and no task is hot, and no pair of documents is formed.

Texts are gathered into chunks, written once to the shared folder and dealt by
chunk at writing, so the answers meet their chunk without moving the texts
again.

Defined results: words are runs of anything but ASCII white space; a null text
has none; documents shorter than a window lose nothing; repeated rows are
documents of their own, so they cover each other's windows; null ids stay null;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bucketed, buckets, materialize, names_in, scratch, write_text
from lodestone.llm.packing import expand, expand_sorted, squeeze, squeeze_sorted

WINDOW = 35
#: Bytes of text that close a chunk after the document that reaches them.
CHUNK_BYTES = 4_000_000
#: Runs that may stand side by side before they are compacted.
MAX_RUNS = 4
#: Words of all batches for which one hash bucket is opened (about one in eight becomes a fingerprint).
BUCKET_WORDS = 32_000_000
#: Old chunks named in the scan's filter, and sent to every executor (8 bytes each); more are joined by shuffle.
NAMED_CHUNKS, BROADCAST_CHUNKS = 1000, 1_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive values."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h), _BASE), dtype=np.uint64, out=total[1:])
    return (total[size:] - total[:-size]) * _powers(len(h) - size + 1, _INVERSE)


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` consecutive values."""
    step, n = 1, len(x) - size + 1
    while 2 * step <= size:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[:n], x[size - step : size - step + n])


class Chunk:
    """The documents of a chunk as words, word hashes and window hashes."""

    def __init__(self, blob: bytes, sizes: bytes, window: int):
        raw = zstandard.decompress(blob)
        self.words, self.window = raw.split(), window
        self.sizes = expand(sizes).astype(np.int64)
        index: dict[bytes, int] = defaultdict(count().__next__)
        at = np.fromiter(map(index.__getitem__, self.words), np.int64, len(self.words))
        table = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in index]), np.uint64).reshape(-1, 2)
        self.low, self.high = (np.ascontiguousarray(table[at, k]) for k in (0, 1))
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.n = max(0, len(self.words) - window + 1)
        self.inside = self.of[: self.n] == self.of[window - 1 :] if self.n else np.zeros(0, bool)

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every window its fingerprint (0 across documents); the hashes of all kept places."""
        if not self.n:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        among = min(16, max(1, self.window // 2))
        size = self.window - among + 1
        grams = np.maximum(_mixed(_rolling(self.low, size)), np.uint64(1))
        least = np.where(self.inside, _sliding(grams, among, np.minimum), np.uint64(0))
        pad = np.zeros(among - 1, np.uint64)
        kept = grams[_sliding(np.concatenate([pad, least, pad]), among, np.maximum) == grams]
        return least, kept

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return _mixed(_rolling(self.low, self.window)), _mixed(_rolling(self.high, self.window))


def _of_bucket(x: np.ndarray, n: int) -> np.ndarray:
    return ((x * np.uint64(_BASE)) >> np.uint64(33)).astype(np.int64) % n


_CHUNK = pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary())])
_ASK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("twice", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("seen", pa.binary())])
#: ``many``: chunks of each fingerprint; ``of``: their places in ``chunks``, fingerprint by fingerprint.
_RUN = pa.schema([("bucket", pa.int32()), ("low", pa.binary()), ("twice", pa.binary()), ("many", pa.binary()), ("chunks", pa.binary()), ("of", pa.binary())])
#: Bits of a chunk's number below its batch, and below its task.
BATCH_BITS, TASK_BITS = 46, 22


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _gather(chunk_bytes: int, batch_no: int):
    """Documents to chunks, numbered by batch, task and order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, doc_ids, sizes = TaskContext.get().partitionId(), 0, [], [], []
        total = 0

        def chunk() -> pa.RecordBatch:
            return _batch([((batch_no << BATCH_BITS) | (task << TASK_BITS) | made, sum(sizes), doc_ids, squeeze(np.array(sizes, np.uint64)), zstandard.compress(b"\n".join(held), 3))], _CHUNK)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8").split()
                doc_ids.append(doc_id)
                sizes.append(len(words))
                held.append(b" ".join(words))
                total += len(held[-1])
                if total >= chunk_bytes:
                    yield chunk()
                    made, held, doc_ids, sizes, total = made + 1, [], [], [], 0
        if doc_ids:
            yield chunk()

    return rows


def _dealt(chunk: int, low: np.ndarray, high: np.ndarray | None, twice: np.ndarray, n: int) -> list[tuple]:
    """Distinct ascending hashes as one row per bucket."""
    at = _of_bucket(low, n)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(n + 1))
    out = []
    for b in np.flatnonzero(np.diff(ends)):
        k = order[ends[b] : ends[b + 1]]
        out.append((chunk, int(b), squeeze_sorted(low[k]), None if high is None else high[k].tobytes(), np.packbits(twice[k]).tobytes()))
    return out


def _ask_minimisers(window: int, n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kept = Chunk(row["words"], row["sizes"], window).minimisers()[1]
                low, times = np.unique(kept, return_counts=True)
                yield _batch(_dealt(row["chunk"], low, None, times > 1, n), _ASK)

    return rows


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _merged(lows: list[np.ndarray], marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists merged: distinct values, marked if marked anywhere or in more than one list."""
    if not lows:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low, mark = np.concatenate(lows), np.concatenate(marks)
    order = np.argsort(low, kind="stable")
    low, mark = low[order], mark[order]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    if not len(low):
        return low, mark
    times = np.diff(np.append(first, len(low)))
    return low[first], (np.add.reduceat(mark, first) > 0) | (times > 1)


def _lists(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    lows = [expand_sorted(x) for x in rows.column("low").to_pylist()]
    return lows, [_bits(x, len(low)) for x, low in zip(rows.column("twice").to_pylist(), lows)]


def _holders(lows: list[np.ndarray], chunks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every (fingerprint, chunk) once, ascending."""
    low, chunk = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (lows, chunks))
    order = np.lexsort((chunk, low))
    return low[order], chunk[order]


def _held_by(runs: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Every run's fingerprints, each as often as chunks hold it, and those chunks."""
    lows, chunks = [], []
    for row in runs.to_pylist():
        lows.append(np.repeat(expand_sorted(row["low"]), expand(row["many"]).astype(np.int64)))
        chunks.append(expand_sorted(row["chunks"])[expand(row["of"]).astype(np.int64)])
    return lows, chunks


def _run(bucket: int, low: np.ndarray, mark: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> tuple:
    names, of = np.unique(held[1], return_inverse=True)
    many = np.diff(np.append(np.searchsorted(held[0], low), len(held[0])))
    return bucket, squeeze_sorted(low), np.packbits(mark).tobytes(), squeeze(many.astype(np.uint64)), squeeze_sorted(names), squeeze(of.astype(np.uint64))


def _new_run(asked: pa.Table, runs: pa.Table) -> pa.Table:
    """A batch's sorted fingerprints of one bucket, merge-joined with the runs so far."""
    if not asked.num_rows:
        return _RUN.empty_table()
    lists, marks = _lists(asked)
    low, mark = _merged(lists, marks)
    before, _ = _merged(*_lists(runs))
    if len(before):
        at = np.minimum(np.searchsorted(before, low), len(before) - 1)
        mark = mark | (before[at] == low)
    held = _holders(lists, [np.full(len(x), c, np.uint64) for x, c in zip(lists, asked.column("chunk").to_pylist())])
    return pa.Table.from_batches([_batch([_run(asked.column("bucket")[0].as_py(), low, mark, held)], _RUN)])


def _compacted(n: int):
    """All runs of one bucket as one, dealt to ``n`` buckets in all."""

    def rows(runs: pa.Table) -> pa.Table:
        low, mark = _merged(*_lists(runs))
        held = _holders(*_held_by(runs))
        of, of_held, out = _of_bucket(low, n), _of_bucket(held[0], n), []
        for b in np.unique(of).tolist():
            out.append(_run(b, low[of == b], mark[of == b], tuple(x[of_held == b] for x in held)))
        return pa.Table.from_batches([_batch(out, _RUN)])

    return rows


def _sharing(asked: pa.Table, runs: pa.Table) -> pa.Table:
    """The chunks in the runs that hold a fingerprint of the chunks that ask."""
    lists, _ = _lists(asked)
    low, chunk = _holders(*_held_by(runs))
    wanted = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    if not len(wanted) or not len(low):
        return pa.table([pa.array([], pa.int64())], names=["chunk"])
    at = np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)
    return pa.table([pa.array(np.unique(chunk[wanted[at] == low]).astype(np.int64))], names=["chunk"])


def _answer_minimisers(asked: pa.Table, runs: pa.Table) -> pa.Table:
    held, mark = _merged(*_lists(runs))
    held = held[mark]
    seen = []
    for low in _lists(asked)[0]:
        at = np.minimum(np.searchsorted(held, low), max(0, len(held) - 1))
        seen.append(np.packbits(held[at] == low if len(held) else np.zeros(len(low), bool)).tobytes())
    return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(seen, pa.binary())], schema=_ANSWER)


def _told(answers: pa.Table, n: int, of_bucket: np.ndarray) -> np.ndarray:
    """The answers to a chunk's distinct ascending hashes, in their order."""
    out, order = np.zeros(len(of_bucket), bool), np.argsort(of_bucket, kind="stable")
    ends = np.searchsorted(of_bucket[order], np.arange(n + 1))
    for b, seen in zip(answers.column("bucket").to_pylist(), answers.column("seen").to_pylist()):
        at = order[ends[b] : ends[b + 1]]
        out[at] = _bits(seen, len(at))
    return out


def _suspects(chunk: Chunk, answers: pa.Table, n: int):
    """Places of the windows whose fingerprint is marked, and their hashes."""
    least, kept = chunk.minimisers()
    low = np.unique(kept)
    marked = low[_told(answers, n, _of_bucket(low, n))]
    if not len(marked):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(chunk.inside & (marked[np.minimum(np.searchsorted(marked, least), len(marked) - 1)] == least))
    low, high = chunk.hashes()
    return at, low[at], high[at]


def _distinct(low: np.ndarray, high: np.ndarray):
    """Distinct 128-bit hashes ascending, whether each comes more than once, and each input's place."""
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(low) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.empty(len(low), np.int64)
    place[order] = np.cumsum(new) - 1
    return low[first], high[first], np.diff(np.append(first, len(low))) > 1, place


def _ask_windows(window: int, n: int):
    def rows(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            _, low, high = _suspects(Chunk(row["words"], row["sizes"], window), answers, n)
            low, high, twice, _ = _distinct(low, high)
            out += _dealt(row["chunk"], low, high, twice, n)
        return pa.Table.from_batches([_batch(out, _ASK)])

    return rows


def _answer_windows(asked: pa.Table) -> pa.Table:
    lows, marks = _lists(asked)
    highs = [np.frombuffer(x, np.uint64) for x in asked.column("high").to_pylist()]
    sizes = [len(x) for x in lows]
    _, _, twice, place = _distinct(np.concatenate(lows), np.concatenate(highs))
    mark = np.concatenate(marks)
    seen = twice[place]
    any_mark = np.zeros(len(twice), bool)
    any_mark[place[mark]] = True
    seen = seen | any_mark[place]
    parts = np.split(seen, np.cumsum(sizes)[:-1])
    return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())], schema=_ANSWER)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _remove(window: int, n: int):
    def rows(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        first = answers.filter(pa.compute.equal(answers.column("step"), 1))
        second = answers.filter(pa.compute.equal(answers.column("step"), 2))
        out = []
        for row in chunks.to_pylist():
            chunk = Chunk(row["words"], row["sizes"], window)
            at, low, high = _suspects(chunk, first, n)
            low, high, _, place = _distinct(low, high)
            found = at[_told(second, n, _of_bucket(low, n))[place]] if len(at) else at
            edge = np.zeros(len(chunk.words) + 1, np.int64)
            np.add.at(edge, found, 1)
            np.add.at(edge, found + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            starts = np.concatenate([[0], np.cumsum(chunk.sizes)])
            kept = keep.tolist()
            for k, doc_id in enumerate(row["doc_ids"]):
                a, b = int(starts[k]), int(starts[k + 1])
                left = [w for w, good in zip(chunk.words[a:b], kept[a:b]) if good]
                out.append((doc_id, b - a, b - a - len(left), b" ".join(left).decode("utf-8")))
        return pa.Table.from_batches([_batch(out, _OUT)])

    return rows


class FingerprintLog:
    """Batches of documents and their runs of fingerprints, in a folder that later sessions can open.

    Without ``folder`` the log is a scratch folder, deleted when the driver ends. One writer at a time.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, max_runs: int = MAX_RUNS, chunk_bytes: int = CHUNK_BYTES, folder: str | None = None):
        self.spark, self.window, self.max_runs, self.chunk_bytes = spark, window, max_runs, chunk_bytes
        self.folder = (folder or scratch(spark, "fingerprints")).rstrip("/")
        self.n, self.steps = buckets(spark), 0
        self.words: list[int] = []
        self.batches: list[DataFrame] = []
        self.paths: list[str] = []
        self.runs: list[str] = []
        self.reread = 0  # old chunks that the last ``resolve`` read again
        if found := [x for x in names_in(spark, f"{self.folder}/manifest") if x.endswith(".json")]:
            held = json.loads(spark.read.option("wholetext", True).text(f"{self.folder}/manifest/{found[-1]}").first().value)
            if held["window"] != window:
                raise ValueError(f"the log in {self.folder} has windows of {held['window']} words")
            self.n, self.steps, self.words, self.paths, self.runs = held["n"], held["steps"], held["words"], held["batches"], held["runs"]
            self.batches = [spark.read.schema(_sql(_CHUNK)).parquet(f"{self.folder}/{x}") for x in self.paths]

    def _commit(self) -> None:
        self.steps += 1
        held = {"window": self.window, "n": self.n, "steps": self.steps, "words": self.words, "batches": self.paths, "runs": self.runs}
        write_text(self.spark, f"{self.folder}/manifest/{self.steps:08d}.json", json.dumps(held))

    def _held(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], _sql(_RUN))
        return self.spark.read.schema(_sql(_RUN)).parquet(*(f"{self.folder}/{x}" for x in self.runs))

    def _marks(self) -> DataFrame:
        return self._held().select("bucket", "low", "twice")

    def _write_run(self, run: DataFrame) -> str:
        """The run's place in the folder; a place that a lost driver left unfinished is written over."""
        name = f"runs/{self.steps:08d}"
        run.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return name

    def _asked(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk", "sizes", "words").mapInArrow(_ask_minimisers(self.window, self.n), _sql(_ASK)).select("chunk", "bucket", "low", "twice")

    def ingest(self, docs: DataFrame) -> None:
        """Add a batch: its texts as chunks, its fingerprints as a new run merged against the runs so far."""
        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        # A step that a lost driver began has no manifest; its chunks stay unread under another name.
        name = f"chunks/{self.steps:08d}-{uuid.uuid4().hex[:8]}"
        gathered = rows.mapInArrow(_gather(self.chunk_bytes, len(self.batches)), _sql(_CHUNK))
        chunks = bucketed(gathered, "chunk", "substring_chunks", f"{self.folder}/{name}", dealt=True)
        words = chunks.agg(F.sum("n_words")).first()[0] or 0
        n = self.n
        while n * BUCKET_WORDS < sum(self.words) + words:
            n *= 2
        if n > self.n:
            self._compact(n)
        asked = self._asked(chunks)
        run = asked.groupBy("bucket").cogroup(self._marks().groupBy("bucket")).applyInArrow(_new_run, _sql(_RUN))
        self.runs = [*self.runs, self._write_run(run)]
        self.batches, self.paths, self.words = [*self.batches, chunks], [*self.paths, name], [*self.words, words]
        self._commit()
        if len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            self._compact(self.n)

    def _compact(self, n: int) -> None:
        if self.runs:
            self.runs = [self._write_run(self._held().groupBy("bucket").applyInArrow(_compacted(n), _sql(_RUN)))]
        self.n = n
        self._commit()

    def _old_chunks(self, asked: DataFrame, only: list[int]) -> list[DataFrame]:
        """Chunks of the other batches that share a fingerprint with those that ask."""
        batch = F.shiftright("chunk", BATCH_BITS)
        shared = asked.groupBy("bucket").cogroup(self._held().groupBy("bucket")).applyInArrow(_sharing, "chunk long").distinct()
        shared = materialize(shared.where(~batch.isin(only)), "fingerprint-shared")
        counts = {r.batch: r.n for r in shared.groupBy(batch.alias("batch")).agg(F.count("*").alias("n")).collect()}
        self.reread, out = sum(counts.values()), []
        for k, n in sorted(counts.items()):
            wanted = shared.where(batch == k)
            if n <= NAMED_CHUNKS:
                out.append(self.batches[k].where(F.col("chunk").isin([r.chunk for r in wanted.collect()])))
            else:
                out.append(self.batches[k].join(F.broadcast(wanted) if n <= BROADCAST_CHUNKS else wanted, "chunk", "left_semi"))
        return out

    def resolve(self, only: list[int] | None = None) -> DataFrame:
        """doc_id, n_words, n_removed and kept_text of the documents of all batches, or of those numbered.

        For some batches, the others' texts are read only where the runs name a chunk that shares a fingerprint.
        """
        self.reread = 0
        asking = list(range(len(self.batches))) if only is None else only
        mine = [self.batches[k] for k in asking]
        if not mine:
            return self.spark.createDataFrame([], _sql(_OUT))
        old = []
        if only is not None and len(only) < len(self.batches):
            asked = None
            for chunks in mine:
                asked = self._asked(chunks) if asked is None else asked.unionByName(self._asked(chunks))
            old = self._old_chunks(asked, only)
        questions, firsts = None, []
        for chunks in mine + old:
            first = self._asked(chunks).groupBy("bucket").cogroup(self._marks().groupBy("bucket")).applyInArrow(_answer_minimisers, _sql(_ANSWER))
            firsts.append(materialize(first, "fingerprint-answers"))
        for chunks, first in zip(mine + old, firsts):
            texts = chunks.select("chunk", "sizes", "words")
            asks = texts.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_ask_windows(self.window, self.n), _sql(_ASK))
            questions = asks if questions is None else questions.unionByName(asks)
        second = materialize(questions.groupBy("bucket").applyInArrow(_answer_windows, _sql(_ANSWER)), "window-answers")
        out = None
        for k, chunks, first in zip(asking, mine, firsts):
            told = first.withColumn("step", F.lit(1)).unionByName(second.where(F.shiftright("chunk", BATCH_BITS) == k).withColumn("step", F.lit(2)))
            texts = chunks.select("chunk", "doc_ids", "sizes", "words")
            found = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_remove(self.window, self.n), _sql(_OUT))
            out = found if out is None else out.unionByName(found)
        return out


def remove(docs: DataFrame, window: int = WINDOW, n_batches: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document, taken in as ``n_batches`` batches."""
    log = FingerprintLog(docs.sparkSession, window, chunk_bytes=chunk_bytes)
    batch = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("batch")), F.lit(n_batches))
    for k in range(n_batches):
        log.ingest(docs.select("doc_id", "text").where(batch == k))
    log.compact()
    return log.resolve()
