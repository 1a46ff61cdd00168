"""Operators whose time must follow the input, and reads that must leave known files alone."""

import time

from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import chunking, search
from lodestone.plans import ingest
from lodestone.seams import LetterEmbedder
from lodestone.sources import files
from lodestone.streaming import incremental


def _seconds(make, sizes):
    """Seconds of an action by size, after one run that warms up."""
    make(sizes[0]).write.format("noop").mode("overwrite").save()
    out = []
    for n in sizes:
        df = make(n)
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - began)
    return out


def test_attempts_of_one_user_in_linear_time(spark):
    def make(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3 != 0).alias("failed"))
        return incremental.login_limits(rows, limit=3)

    small, large = _seconds(make, (100_000, 400_000))
    assert large < 4 * 1.6 * small + 2


def test_a_long_document_in_linear_time(spark):
    def text(n):
        return spark.range(1).select(F.lit("d").alias("filename"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word"), (i % 97).cast("string"), F.when(i % 11 == 0, ". ").otherwise(""))), " ").alias("text"))

    for make in (
        lambda n: chunking.chunk_sentences(text(n), "filename", "text"),
        lambda n: chunking.chunk_words(text(n), "filename", "text"),
        lambda n: search.rank_passages(text(n), "filename", "text", "word11 word12 word13 word14 word15 word16 word17"),
    ):
        small, large = _seconds(make, (60_000, 240_000))
        assert large < 4 * 1.6 * small + 2


def test_known_files_are_not_read(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.pdf").write_bytes(b"%PDF" + bytes([65 + k]))
    (tmp_path / "other.txt").write_bytes(b"x")
    known = spark.createDataFrame([(f"f{k}.pdf",) for k in range(5)], "filename string")
    got = files.scan(spark, str(tmp_path), known)
    assert [(r.filename, r.kind, bytes(r.content)) for r in got.collect()] == [("f5.pdf", "pdf", b"%PDFF")]
    assert [p.rsplit("/", 1)[1] for p in got.inputFiles()] == ["f5.pdf"]
    assert files.scan(spark, str(tmp_path), got.select("filename").unionByName(known)).count() == 0
    assert files.scan(spark, str(tmp_path)).count() == 6


def test_only_repeated_new_texts_are_shuffled(spark, monkeypatch):
    rows = [("a", "aa"), ("b", "bb"), ("c", "cc"), ("c", "cc"), ("d", "dd")]
    chunks, known = spark.createDataFrame(rows, "chunk_id string, text string"), spark.createDataFrame([("a",)], "chunk_id string")
    for most in (1_000_000, 1):
        monkeypatch.setattr(ingest, "BROADCAST_IDS", most)
        got = ingest.embed_new(chunks, known, LetterEmbedder())
        assert sorted((r.chunk_id, r.text, round(sum(r.embedding), 3)) for r in got.collect()) == [("b", "bb", 1.0), ("c", "cc", 1.0), ("d", "dd", 1.0)]


def test_letters_are_counted_once_a_text(spark, tmp_path):
    texts = [None, "", "  ", "aBKé zZz", *[f"{k} Some words of a longer text, " * 400 for k in range(300)]]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    rows, embedder = spark.read.parquet(str(tmp_path / "t")), LetterEmbedder()
    began = time.perf_counter()
    got = {r.id: r.v for r in rows.select("id", embedder.column(F.col("text")).alias("v")).collect()}
    assert time.perf_counter() - began < 15  # worked out again for each component, 4 MB took over a minute
    assert all(got[k] == embedder.one(t) for k, t in enumerate(texts))


def test_a_norm_is_worked_out_once_a_vector(spark):
    text = F.repeat(F.lit("some words "), 4000)
    slow = F.array(*[F.regexp_count(F.concat(text, F.col("id").cast("string")), F.lit(c)).cast("double") for c in "abcdefghij"])
    began = time.perf_counter()
    got = spark.range(0, 400, 1, 4).select(vectors.unit(slow).alias("v")).collect()
    assert time.perf_counter() - began < 15
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in got)
