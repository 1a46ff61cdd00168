"""The catalogue of registered queries and their SQL twins."""

from __future__ import annotations

from lodestone.plans import corpus_queries, question_queries, search_queries, text_queries  # noqa: F401  register their queries
from lodestone.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "ask_normal"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
