"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Add a function under its name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def sql_tokens(c: str) -> str:
    """SQL of ``tokens_for_match``."""
    return f"list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) > 2)"


def sql_words(c: str) -> str:
    """SQL of ``words``."""
    return f"list_filter(string_split_regex(coalesce({c}, ''), '\\s+'), lambda x: x <> '')"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def sql_unescape(c: str) -> str:
    """SQL of ``web.unescape``."""
    from lodestone.sources.web import ENTITIES

    for name, char in ENTITIES:
        c = "replace({}, '{}', '{}')".format(c, name, char.replace("'", "''"))
    return c
