"""Connected words split by a dictionary: the likeliest parts, by rank in a word list."""

from __future__ import annotations

import json
import math
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.pandas.functions import arrow_udf

from lodestone.functions import rules


def costs(words: list[str]) -> dict[str, float]:
    """The cost of each word of a list in falling frequency: the k-th is as likely as 1 / (k * log n) (Zipf's law)."""
    out: dict[str, float] = {}
    for k, w in enumerate(words):
        out.setdefault(w, math.log((k + 1) * math.log(len(words) + 1)))
    return out


@cache
def english_costs() -> dict[str, float]:
    """A stand-in for a frequency list of English, as costs.

    It holds the words that two public vocabularies share, one of which marks the beginning of a word and the other its end,
    by the worse of both places; of fewer than four letters, those of a fixed list; then the words of the rules. Longer ones
    of the first vocabulary alone are known, but are part of no other word.
    """
    import public_tokenizers

    def vocabulary(name: str) -> dict[str, int]:
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            return json.load(file)["model"]["vocab"]

    begun: dict[str, int] = {}
    for token, k in vocabulary("byte_bpe_50k.json").items():
        if token.startswith("Ġ"):
            begun[token[1:].lower()] = min(k, begun.get(token[1:].lower(), k))
    ended = {token[:-4]: k for token, k in vocabulary("word_bpe_49k.json").items() if token.endswith("</w>")}
    place = {w: max(begun[w], ended[w]) for w in begun.keys() & ended.keys() if w.isascii() and w.isalpha() and (len(w) > 3 or w in rules.SHORT_WORDS)}
    listed = [w for phrases in rules.CATEGORIES.values() for p in phrases for w in p.lower().replace("-", " ").split()]
    ranked = [*sorted(place, key=lambda w: (place[w], w)), *rules.SHORT_WORDS, *(w for w in (*rules.ENGLISH_STOP_WORDS, *listed) if len(w) > 3)]
    whole = {w: math.inf for w in begun if len(w) > 5 and w.isascii() and w.isalpha()}
    return whole | costs(list(dict.fromkeys(ranked)))


def split_word(word: str, known: dict[str, float], longest: int) -> list[str]:
    """The parts of least cost; a letter that no word covers stands alone at a cost above any word's."""
    low, n = word.lower(), len(word)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            c = best[start] + known.get(low[start:end], 25.0 * (end - start) if end - start == 1 else math.inf)
            if c < best[end]:
                best[end], back[end] = c, start
    return _cut(word, back)


def split_covered(word: str, known: dict[str, float], longest: int) -> list[str]:
    """The parts of least cost that are all known; the word as it is where it is known itself, or has no such parts."""
    low, n = word.lower(), len(word)
    if low in known:
        return [word]
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for start in range(n):
        if (at := best[start]) < math.inf:  # places that no known words lead to are passed over
            for end in range(start + 1, min(n, start + longest) + 1):
                c = known.get(low[start:end])
                if c is not None and at + c < best[end]:
                    best[end], back[end] = at + c, start
    return _cut(word, back) if best[n] < math.inf else [word]


def _cut(word: str, back: list[int]) -> list[str]:
    out, n = [], len(word)
    while n:
        out.append(word[back[n] : n])
        n = back[n]
    return out[::-1]


def split_by_dictionary(text: Column, words: list[str], least: int = 16) -> Column:
    """Alphabetic words of at least ``least`` letters that the list lacks, split; words are joined by one blank. A null text stays null."""
    known = costs(words)
    longest = max(map(len, known), default=1)

    def run(texts: pa.Array) -> pa.Array:
        held: dict[str, str] = {}
        out = []
        for t in texts.to_pylist():
            parts = []
            for w in (t or "").split():
                if len(w) >= least and w.isalpha() and w.lower() not in known:
                    if w not in held:
                        held[w] = " ".join(split_word(w, known, longest))
                    w = held[w]
                parts.append(w)
            out.append(None if t is None else " ".join(parts))
        return pa.array(out, pa.string())

    return arrow_udf(run, "string")(text)
