"""Query intent, kind of source, priority and category, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from lodestone.functions import rules
from lodestone.functions.text import query_terms


def _any(c: Column, cues) -> Column:
    return reduce(or_, [F.contains(c, F.lit(x)) for x in cues])


def _holds(query: Column, listed, cues) -> Column:
    return F.arrays_overlap(query_terms(query), F.array(*map(F.lit, listed))) | _any(F.lower(query), cues)


def is_accident(query: Column) -> Column:
    return _holds(query, rules.ACCIDENT_WORDS, rules.ACCIDENT_CUES)


def is_regulatory(query: Column) -> Column:
    return _holds(query, rules.REGULATORY_WORDS, rules.REGULATORY_CUES)


def intent(query: Column) -> Column:
    return F.when(is_accident(query), "accident").when(is_regulatory(query), "regulatory").otherwise("neither")


def source_kind(filename: Column) -> Column:
    name = F.lower(F.coalesce(filename, F.lit("")))
    out = F.when(F.lit(False), "")
    for part, kind in rules.SOURCE_KINDS:
        out = out.when(F.contains(name, F.lit(part)), kind)
    return out.when(F.endswith(name, F.lit(".pdf")), "reference").otherwise("other")


def source_priority(kind: Column, of: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, row in rules.PRIORITY.items() for k, p in row.items() for x in (f"{i}/{k}", p)])
    return F.element_at(table, F.concat(of, F.lit("/"), kind))


def is_skipped(kind: Column, of: Column) -> Column:
    return (kind == "accident_report") & (of != "accident")


def category(text: Column) -> Column:
    """The category with most of its phrases in the text; the first listed wins ties. Phrases in capitals match nothing in a lower-cased text, as listed."""
    listed = [(name, [(p, max(p.split(), key=len)) for p in phrases if p == p.lower()]) for name, phrases in rules.CATEGORIES.items()]

    def best(low: str) -> str:
        # A text is searched for a phrase only where one of its distinct words holds the phrase's longest.
        held = " ".join(set(low.split()))
        scores = [sum(longest in held and (longest == p or p in low) for p, longest in phrases) for _, phrases in listed]
        return listed[scores.index(max(scores))][0]

    # In Arrow batches: as a built-in expression each of the 150 phrases is searched for byte by byte.
    return arrow_udf(lambda texts: pa.array([best(t.as_py() or "") for t in texts], pa.string()), "string")(F.lower(text))
