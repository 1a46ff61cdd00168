"""Merge-on-read tables against a dictionary; which folders a change writes."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.keyed_table import KeyedTable
from lodestone.operators.sessions import SessionStore, delete_session, merge_sessions, upsert_session

SCHEMA = "id long, name string, at long"


def _rows(table):
    return sorted(tuple(r) for r in table.read().select("id", "name", "at").collect())


def test_changes_against_a_dictionary(spark, tmp_path):
    r = random.Random(2)
    want = {k: (k, f"n{k}", 0) for k in range(50)}
    table = KeyedTable.create(spark.createDataFrame(list(want.values()), SCHEMA), f"{tmp_path}/t", "id", "at", buckets=8, most_changes=25)
    for at in range(1, 5):
        rows = [(r.randint(0, 70), f"m{at}.{k}", at * 100 + k) for k in range(9)]
        table.upsert(spark.createDataFrame(rows, SCHEMA))
        for row in sorted(rows, key=lambda x: x[2]):
            want[row[0]] = row
        gone = [(r.randint(0, 90),) for _ in range(4)]
        table.delete(spark.createDataFrame(gone, "id long"))
        for (k,) in gone:
            want.pop(k, None)
        assert _rows(table) == sorted(want.values())
    assert _rows(KeyedTable.open(spark, f"{tmp_path}/t")) == sorted(want.values())
    some = sorted(want)[:3]
    assert sorted(tuple(x) for x in table.lookup([*some, 999]).select(*SCHEMA.replace(",", "").split()[::2]).collect()) == [want[k] for k in some]
    table.compact()
    assert table.state["changes"] == [] and _rows(table) == sorted(want.values())


def test_an_upsert_of_ten_keys_writes_ten_folders_at_most(spark, tmp_path):
    table = KeyedTable.create(spark.range(5000).select("id", F.lit("x").alias("name"), F.lit(0).cast("long").alias("at")), f"{tmp_path}/t", "id", "at", buckets=64)
    before = dict(table.state["base"])
    table.upsert(spark.range(10).select(F.col("id") * 37, F.lit("y").alias("name"), F.lit(1).cast("long").alias("at")).toDF("id", "name", "at"))
    (change,) = table.state["changes"]
    assert table.state["base"] == before and len(change["buckets"]) <= 10 and change["rows"] == 10
    touched = table.compact()
    assert touched == change["buckets"]
    assert {b for b, n in table.state["base"].items() if n != before[b]} == set(map(str, touched))
    assert table.read().count() == 5000 and table.read().where("name = 'y'").count() == 10


def test_base_is_not_shuffled_by_readers(spark, tmp_path):
    table = KeyedTable.create(spark.range(100).selectExpr("id", "'x' name", "id at"), f"{tmp_path}/t", "id", "at", buckets=4)
    table.delete(spark.range(3))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_nulls_ties_empty_tables_and_a_second_writer(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    table = KeyedTable.create(empty, f"{tmp_path}/t", "id", "at", buckets=4)
    assert _rows(table) == [] and table.compact() == []
    other = KeyedTable.open(spark, f"{tmp_path}/t")
    table.upsert(spark.createDataFrame([(None, "none", 1), (1, "a", 5), (1, "b", 5), (2, None, None)], SCHEMA))
    assert _rows(table) == [(1, "b", 5), (2, None, None)]
    table.upsert(empty)
    table.upsert(spark.createDataFrame([(2,)], "id long"))
    assert _rows(table) == [(1, "b", 5), (2, None, None)]
    with pytest.raises(RuntimeError):
        other.upsert(spark.createDataFrame([(3, "late", 1)], SCHEMA))
    assert _rows(KeyedTable.open(spark, f"{tmp_path}/t")) == [(1, "b", 5), (2, None, None)]


def test_sessions_as_keyed_tables(spark, tmp_path):
    titles = spark.createDataFrame([("a", "first"), ("b", "second")], "session_id string, title string")
    index = spark.createDataFrame([("a", "t1", "t1", False), ("c", "t2", "t3", True)], "session_id string, created_at string, updated_at string, pinned boolean")
    store = SessionStore.create(titles, index, f"{tmp_path}/s", buckets=4)
    t, i = titles, index
    for name, title, pinned in (("a", None, True), ("n", "new", None), ("c", "third", None)):
        store.upsert(name, "t9", title, pinned)
        t, i = upsert_session(t, i, name, "t9", title, pinned)
    assert store.delete("b") and not store.delete("zz")
    t, i = delete_session(t, i, "b")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(store.merged("now")) == rows(merge_sessions(t, i, "now")) == rows(SessionStore.open(spark, f"{tmp_path}/s").merged("now"))
