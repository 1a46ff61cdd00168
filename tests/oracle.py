"""Compare a registered query with its SQL twin on one data folder."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(df, sql: str, sf_dir: str) -> None:
    """Equal column names and equal rows, in any order."""
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    cols = sorted(names)
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)
