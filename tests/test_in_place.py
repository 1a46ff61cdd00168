"""Tokens are counted and weighed where they are read; what must be shuffled is no more than that."""

import duckdb
from pyspark.sql import functions as F

from lodestone.operators import analytics, consistency
from lodestone.plans import catalogue

SCHEMA = "doc_id long, text string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _as_sql(name, docs, tmp_path):
    """Rows of a registered query and of its SQL over ``docs``."""
    path = str(tmp_path / "documents.parquet")
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = catalogue.queries()[name](docs.sparkSession, str(tmp_path)).select(*names)
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, found.fetchall()))


def _odd(spark):
    rows = [(k, f"Word {k % 7} the Cat {'sat on 3.14 mats ' * (k % 4)}") for k in range(40)]
    return spark.createDataFrame([*rows, (3, "cat cat again"), (3, "word"), (None, "a null Cat"), (None, "cat"), (41, None), (42, ""), (43, "the of and")], SCHEMA).repartition(3)


def test_tf_idf_of_repeated_and_null_keys(spark, tmp_path, monkeypatch):
    for k, most in enumerate((1_000_000, 1)):
        monkeypatch.setattr(consistency, "BROADCAST_ROWS", most)
        got, want = _as_sql("tf_idf_terms", _odd(spark), tmp_path / str(k))
        assert got == want and len(got) > 100


def test_tf_idf_moves_no_counts_of_a_document(spark, tmp_path):
    spark.range(3000).select("id", F.concat(F.lit("some words w"), F.col("id")).alias("text")).write.parquet(str(tmp_path / "d"))
    made = analytics.tf_idf(spark.read.parquet(str(tmp_path / "d")).withColumnRenamed("id", "doc_id"), "doc_id", 50)
    assert "Exchange" not in _plan(made)
    assert made.count() == 3000 * 3 + 47  # some, words, w and the first 47 numbers


def test_hits_of_a_lexicon_are_found_where_texts_are_read(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "not very GOOD, rather bad and good! x y z") for k in range(50)] + [(3, "good")], SCHEMA)
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    made = analytics.sentiment_in_context(docs, "doc_id", lexicon)
    by_token = lambda df: any("hashpartitioning(token" in line for line in _plan(df).split("\n"))
    assert not by_token(made)
    monkeypatch.setattr(consistency, "BROADCAST_ROWS", 1)
    moved = analytics.sentiment_in_context(docs, "doc_id", lexicon)
    assert by_token(moved) and sorted(moved.collect()) == sorted(made.collect())
