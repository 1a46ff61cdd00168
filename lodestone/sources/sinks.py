"""Writers: corpus, chunks, reports; never over the path that is being read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import stem as stem_of


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_corpus(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_texts(docs: DataFrame, path: str) -> None:
    """The raw and the processed text of every document (filename, raw, text), a folder each, one row a document."""
    stem = F.concat(stem_of(F.col("filename")), F.lit(".txt")).alias("name")
    for kind, column in (("raw", "raw"), ("processed", "text")):
        docs.select(stem, F.col(column).alias("text")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{kind}")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_chunk_files(chunks: DataFrame, path: str) -> None:
    """One JSON file's worth of rows per document, under its stem; documents whose stem is there already are left."""
    spark = chunks.sparkSession
    named = chunks.withColumn("stem", stem_of(F.col("filename")))
    if folder_exists(spark, path):
        named = named.join(spark.read.json(path).select("stem").distinct(), "stem", "left_anti")
    named.write.mode("append").partitionBy("stem").json(path)


def create_table(rows: DataFrame, name: str, path: str) -> bool:
    """A table of these columns and no rows: made where there is none (True), emptied where there is one."""
    made = not rows.sparkSession.catalog.tableExists(name)
    rows.limit(0).write.mode("overwrite").option("path", path).saveAsTable(name)
    return made


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_new(rows: DataFrame, known: DataFrame | None, key: str, path: str) -> None:
    """Append rows whose key is not known yet."""
    (rows if known is None else rows.join(known.select(key), key, "left_anti")).write.mode("append").parquet(path)


def report(chunks: DataFrame) -> DataFrame:
    """chunk_id, filename, tokens and the first 100 characters, for a CSV report."""
    return chunks.select("chunk_id", "filename", "tokens", F.concat(F.left("text", F.lit(100)), F.lit("...")).alias("preview"))


def write_report(chunks: DataFrame, path: str) -> None:
    report(chunks).write.mode("overwrite").option("header", "true").csv(path)


def write_cells(vectors: DataFrame, path: str, centres: list[tuple[int, list[float]]] | None = None) -> None:
    """Vectors partitioned by cell, and the centres beside them: a search that names cells reads only theirs."""
    vectors.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    rows = vectors.sparkSession.createDataFrame(centres or [], "cell int, centre array<double>")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def flat_for_csv(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, which CSV can hold."""
    nested = [n for n, t in rows.dtypes if t.startswith(("array", "map", "struct"))]
    return rows.withColumns({n: F.to_json(n) for n in nested}) if nested else rows
