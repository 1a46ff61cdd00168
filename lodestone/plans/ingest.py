"""The batch pipeline: prepare documents, chunk, embed what is new, and a runner of named steps."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import cleaning, intent, rules, segment, text
from lodestone.operators import chunking, consistency
from lodestone.seams import Embedder, annotate
from lodestone.session import file_system
from lodestone.sources import document_source, files, sinks


def prepare(docs: DataFrame, abbreviations: dict[str, str] | None = None, annotator: str = "rules", words: list[str] | None = None, lemma: Callable[[str], str] | None = None) -> DataFrame:
    """filename, text, tokens, section_references, personal_names, entities, pos_tags, metadata and category of every document (filename, text; method and extraction_quality where the docs have them).

    References, names, entities and tags read the text as it came. The text is expanded, its connected words are split
    by case and by a word list in falling frequency, and what is left of the filter and the stop words stands as lemmas; tokens
    and category are those of this text. Persons are those of the annotator, or by default two capitalised words in a row.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    clean = cleaning.preprocessed(raw, abbreviations or rules.ABBREVIATIONS, segment.costs(words) if words else segment.english_costs(), lemma)
    refs = text.section_references(raw)
    kind = F.lower(F.regexp_extract("filename", "\\.([^./]+)$", 1))
    method = F.col("method") if "method" in docs.columns else kind
    score = F.col("extraction_quality") if "extraction_quality" in docs.columns else F.when(kind == "docx", 1.0).otherwise(text.quality_score(raw))
    fields = [text.metadata_field(raw, n).alias(a) for n, a in (("Title", "title"), ("Author\\(s\\)", "authors"), ("Tags", "tags"))]
    named = F.struct(*fields, kind.alias("source_type"), method.alias("extraction_method"), F.round(score, 3).alias("extraction_quality"), text.needs_review(kind, score).alias("needs_manual_review"))
    rows = docs.where(F.coalesce(F.col("filename"), F.lit("")) != "").select("filename", raw.alias("__raw"), clean.alias("text"), refs.alias("section_references"), annotate(raw, annotator).alias("__entities"), named.alias("metadata"))
    marked = F.transform("section_references", lambda r: F.struct(r.alias("text"), F.lit("SECTION_REF").alias("label")))
    persons = F.transform(F.filter("__entities", lambda e: e.label == "PERSON"), lambda e: e.text)
    names = F.when(F.size(persons) > 0, persons).otherwise(text.personal_names(F.col("__raw")))
    return rows.select(
        "filename", "text", cleaning.tokens(F.col("text")).alias("tokens"), "section_references", names.alias("personal_names"), F.concat("__entities", marked).alias("entities"),
        text.pos_tags(F.col("__raw")).alias("pos_tags"), "metadata", intent.category(F.col("text")).alias("category"),
    )


def chunk(prepared: DataFrame, known: DataFrame | None = None, most: int = 500) -> DataFrame:
    """Chunks of the documents whose file name is not known yet."""
    new = prepared if known is None else consistency.new_rows(prepared, known, "filename")
    return chunking.chunk_words(new, "filename", "text", most)


#: New ids that are sent to every executor, so that the texts of known chunks are left where they are read.
BROADCAST_IDS = 1_000_000


def embed_new(chunks: DataFrame, known: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors of the chunks that have none yet, each id once.

    Ids alone are compared with the known ones. The texts of new ids are then taken where they are read, and only
    those of an id that stands more than once are shuffled.
    """
    ids = consistency.new_rows(chunks.select("chunk_id").groupBy("chunk_id").agg(F.count("*").alias("__n")), known, "chunk_id")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    new = chunks.join(ids, "chunk_id")
    once = new.where("__n = 1").unionByName(new.where("__n > 1").dropDuplicates(["chunk_id"])).select(*chunks.columns)
    return once.withColumn("embedding", embedder.column(F.col("text")))


def embed_in_parts(chunks: DataFrame, path: str, embedder: Embedder, by: str = "filename", parts: int = 16) -> int:
    """Embed what is new, a part of the files at a time, each appended to ``path`` as a whole; how many parts were written.

    A run that was broken off goes on with the chunks that have no vector at ``path`` yet.
    """
    spark, made = chunks.sparkSession, 0
    for k in range(parts):
        part = chunks.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k)
        known = spark.read.parquet(path).select("chunk_id") if sinks.folder_exists(spark, path) else part.select("chunk_id").limit(0)
        new = embed_new(part, known, embedder)
        if not consistency.new_rows(part, known, "chunk_id").isEmpty():
            new.write.mode("append").parquet(path)
            made += 1
    return made


def embedded(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """What ``embed_stream`` wrote: the batches before a number, or all of them."""
    system, at = file_system(spark, target)
    found = sorted(int(x.getPath().getName().split("=")[1]) for x in system.listStatus(at) if x.getPath().getName().startswith("batch=")) if system.exists(at) else []
    paths = [f"{target}/batch={b}" for b in found if before is None or b < before]
    return spark.read.schema(EMBEDDED).parquet(*paths) if paths else spark.createDataFrame([], EMBEDDED)


EMBEDDED = "chunk_id string, filename string, chunk_no int, text string, tokens long, embedding array<double>"


def embed_stream(spark: SparkSession, path: str, target: str, checkpoint: str, embedder: Embedder, most: int = 500, files_per_batch: int = 1000, extractors=None, kinds: str = "docx,pdf") -> None:
    """Take in what is new under a folder of documents, from file to vector, in one stream, and stop.

    Every micro-batch (at most ``files_per_batch`` files) extracts, prepares, chunks and embeds its files and writes a
    folder of its own number. A batch that broke off is run again by the stream under the same number and replaces what
    it had written; an id that an earlier batch holds is left out: so nothing is there twice, wherever a run ends.
    """
    document_source.register(spark)

    def write(batch: DataFrame, number: int) -> None:
        texts = files.best(files.extract(batch, extractors))
        new = embed_new(chunk(prepare(texts), most=most), embedded(spark, target, number), embedder)
        new.selectExpr(*[f"cast({f.split()[0]} AS {f.split()[1]}) AS {f.split()[0]}" for f in EMBEDDED.split(", ")]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    there = document_source.listed(path, set(kinds.split(",")))
    done = {r.filename for r in embedded(spark, target).select("filename").distinct().collect()}  # names, as many as are listed
    first = next((k for k, f in enumerate(there) if f.filename not in done), len(there))
    for k in range(first, len(there), files_per_batch):
        last = there[min(k + files_per_batch, len(there)) - 1]
        rows = spark.readStream.format(document_source.NAME).option("path", path).option("kinds", kinds).option("upto", json.dumps({"time": last.time, "path": last.path})).load()
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def observed(rows: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """``rows`` with named aggregates that are counted while they are written."""
    watch = Observation(name)
    return rows.observe(watch, F.count("*").alias("rows"), *[c.alias(n) for n, c in metrics.items()]), watch


def run_steps(steps: list[tuple[str, Callable[[], None]]], tries: int = 3, wait: float = 5.0, only: str | None = None, sleep=time.sleep) -> list[tuple[str, bool, float, str]]:
    """(name, done, seconds, error) of every step; a step is tried again, and a failed one does not stop the next."""
    out = []
    for name, step in steps:
        if only is not None and name != only:
            continue
        began, done, error = time.monotonic(), False, ""
        for k in range(tries):
            try:
                step()
                done, error = True, ""
                break
            except Exception as e:  # the report carries it
                error = f"{type(e).__name__}: {e}"
                if k < tries - 1:
                    sleep(wait)
        out.append((name, done, time.monotonic() - began, error))
    return out
