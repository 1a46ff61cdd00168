"""Files to text: directory scans, DOCX, pluggable PDF extractors, best extraction; JSON and CSV tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.text import quality_score
from lodestone.sources import pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, one a line; '' where it can't be read."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


#: kind -> extractors in order; of equally good texts the first wins.
EXTRACTORS: dict[str, list[tuple[str, Callable[[bytes], str]]]] = {"docx": [("docx", docx_text)], "pdf": [("order", pdf.text_in_order), ("lines", pdf.text_by_lines)]}


def _head_field(lines: str, name: str) -> str:
    m = re.search(rf"{name}:[ \t]*(.*)", lines)
    return m[1].strip() if m else ""


def docx_metadata(content: bytes) -> dict[str, str]:
    """What the first five paragraphs say after Title:, Author(s):, Category: and Tags:."""
    head = "\n".join(docx_text(content).split("\n")[:5])
    return {field: _head_field(head, re.escape(name)) for field, name in (("title", "Title"), ("authors", "Author(s)"), ("category", "Category"), ("tags", "Tags"))}


METADATA: dict[str, Callable[[bytes], dict[str, str]]] = {"pdf": pdf.metadata, "docx": docx_metadata}
_FIELDS = ("title", "authors", "category", "tags")


def metadata(files: DataFrame) -> DataFrame:
    """filename, title, authors, category and tags of the scanned files, '' where a file says nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(f, METADATA.get(kind, lambda c: {})(bytes(c))) for f, kind, c in batch.itertuples(index=False)]
            yield pd.DataFrame([(f, *(m.get(x, "") for x in _FIELDS)) for f, m in found], columns=["filename", *_FIELDS])

    return files.select("filename", "kind", "content").mapInPandas(run, "filename string, title string, authors string, category string, tags string")


#: New files that are named to the reader one by one; more are told apart by a join after they are read.
NAMED_FILES = 50_000


def scan(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """filename, kind and content of the DOCX and PDF files under a folder that are not known yet.

    Names are compared first, without any content; only the files that are new are read.
    """
    name, kind = F.regexp_extract("path", "[^/]+$", 0), F.lower(F.regexp_extract("path", "\\.([^.]+)$", 1))
    columns = [name.alias("filename"), kind.alias("kind"), "content"]
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(kind.isin(*EXTRACTORS))
    if known is None:
        return every.select(*columns)
    new = every.select("path", name.alias("filename")).join(known.select("filename"), "filename", "left_anti")
    paths = [r.path for r in new.select("path").limit(NAMED_FILES + 1).collect()]
    if not paths:
        return every.select(*columns).limit(0)
    if len(paths) > NAMED_FILES:
        return every.select(*columns).join(known.select("filename"), "filename", "left_anti")
    return spark.read.format("binaryFile").load(paths).select(*columns)


def extract(files: DataFrame, extractors=None) -> DataFrame:
    """filename, method, ord and text: one row per file and extractor."""
    table = extractors or EXTRACTORS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, m, k, fn(bytes(c))) for f, kind, c in batch.itertuples(index=False) for k, (m, fn) in enumerate(table.get(kind, []))]
            yield pd.DataFrame(rows, columns=["filename", "method", "ord", "text"])

    return files.select("filename", "kind", "content").mapInPandas(run, "filename string, method string, ord int, text string")


def best(extracted: DataFrame) -> DataFrame:
    """Per file the text with the highest quality, earlier methods first among equals."""
    rows = extracted.withColumn("score", quality_score(F.col("text")))
    top = rows.groupBy("filename").agg(F.max_by(F.struct("method", "text", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return top.select("filename", "b.method", "b.text", F.round("b.score", 3).alias("extraction_quality"))


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """key and value of a two-column CSV, trimmed; rows without a second column dropped, the last of a key kept."""
    rows = spark.read.schema("key string, value string").csv(path)
    rows = rows.where(F.col("value").isNotNull()).select(F.trim("key").alias("key"), F.trim("value").alias("value"), F.monotonically_increasing_id().alias("__at"))
    return rows.groupBy("key").agg(F.max_by("value", "__at").alias("value"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files, files that aren't JSON dropped; an empty table where the path is missing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target):
        return spark.createDataFrame([], schema)
    # Whole files as text: what is no JSON of this shape becomes null, and nothing has to be held in memory.
    whole = spark.read.option("wholetext", "true").text(path)
    return whole.select(F.inline(F.from_json("value", f"array<struct<{_as_fields(schema)}>>")))


def _as_fields(schema: str) -> str:
    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def version(spark: SparkSession) -> str:
    """What the store says of itself."""
    return spark.version


def first_entries(spark: SparkSession, path: str, n: int = 500) -> DataFrame:
    """filename and chunk_id of any n stored chunks."""
    return spark.read.parquet(path).select("filename", "chunk_id").limit(n)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
