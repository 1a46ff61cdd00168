"""The text of a document as the corpus keeps it: expanded, split, filtered, without stop words, as lemmas."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from lodestone.functions import rules, segment

#: Numbers with dots stay whole, and so do words; the marks between them are left out.
_TOKENS = re.compile(r"[0-9]+(?:\.[0-9]+)+|\w+")
_CASES = re.compile("[A-Z][a-z]*|[a-z]+|[0-9]+")
_RUNS = re.compile("[a-zA-Z]+|[0-9]+")
#: Words longer than this are split at case and digit changes before they are looked up.
LONGEST = 15
#: The stop word that a text keeps, as the ingest stream's callers have it; the tokens do not.
STAYING = {"more"}
#: Words whose parts a task remembers.
HELD = 1 << 17


def _singular(w: str) -> str:
    """``text.noun_lemma`` of one word."""
    if len(w) < 4:
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith(("sses", "shes", "ches", "xes", "zes")):
        return w[:-2]
    if w.endswith("men"):
        return w[:-2] + "an"
    return w[:-1] if w[-1] == "s" and w[-2] not in "siu" else w


def _infinitive(w: str, known) -> str:
    """The word without -ed or -ing, where the list holds what is then left, first with an e."""
    if w.endswith("ied") and len(w) > 4:
        return w[:-3] + "y"
    stem = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else ""
    bases = (stem + "e", stem, stem[:-1] if stem[-1:] == stem[-2:-1] else "")
    return next((x for x in bases if len(x) > 2 and x in known), w)


def lemma_of(w: str, known) -> str:
    """The lemma of a lower-case word by its ending; a word of the list changes only into another one, and fixed forms stay."""
    if w in rules.FIXED_FORMS:
        return w
    one = _singular(w)
    return _infinitive(w if w in known and one not in known else one, known)


def split_connected(token: str, known: dict[str, float], longest: int) -> list[str]:
    """The parts of one word: at case and digit changes where it is long, then by the word list, whatever its length.

    A number with dots stays whole, and so do letters that the words of the list do not cover.
    """
    if "." in token:
        return [token]
    runs = _CASES.findall(token) if len(token) > LONGEST and token.isalnum() else [token]
    return [part for run in runs for letters in _RUNS.findall(run) for part in (segment.split_covered(letters, known, longest) if letters[0].isalpha() else [letters])]


def preprocessed(c: Column, abbreviations: dict[str, str], known: dict[str, float], lemma: Callable[[str], str] | None = None) -> Column:
    """Abbreviations expanded, connected words split, parts of at most two distinct characters and English stop words left out, the rest as lower-case lemmas joined by one blank."""
    longest = max(map(len, known), default=1)
    stop = frozenset(rules.ENGLISH_STOP_WORDS) - STAYING
    lemma = lemma or (lambda w: lemma_of(w, known))
    made: list = []  # one memory of words a task

    def parts_of(token: str) -> str:
        kept = [p for p in map(str.lower, split_connected(token, known, longest)) if len(set(p)) > 2 and p not in stop]
        return " ".join(map(lemma, kept))

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            parts = lru_cache(HELD)(parts_of)
            # No token reaches over a blank, so that a word between blanks always becomes the same.
            made.append(lru_cache(HELD)(lambda w: " ".join(filter(None, map(parts, _TOKENS.findall(abbreviations.get(w.lower(), w)))))))
        return pa.array([" ".join(filter(None, map(made[0], (t.as_py() or "").split()))) for t in texts], pa.string())

    return arrow_udf(run, "string")(c)


def tokens(preprocessed_text: Column) -> Column:
    """The words of a preprocessed text, duplicates kept; lemmas that are stop words are left out."""
    return F.filter(F.split(preprocessed_text, " "), lambda t: (t != "") & ~t.isin(*rules.ENGLISH_STOP_WORDS))
