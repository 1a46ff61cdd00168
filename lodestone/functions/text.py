"""Text expressions: normalising, tokens, cleaning, references, quality, titles."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from lodestone.functions import rules


def words(c: Column) -> Column:
    """White-space separated words; none of a blank text."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), "\\s+"), "")


def normalize_for_match(c: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens_for_match(c: Column) -> Column:
    """Tokens of more than two characters, duplicates kept."""
    return F.filter(F.split(normalize_for_match(c), " "), lambda t: F.length(t) > 2)


def quoted_phrases(c: Column) -> Column:
    """Phrases in double quotes, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")


def query_terms(c: Column) -> Column:
    """Distinct search tokens outside quoted phrases, without stop words."""
    outside = F.regexp_replace(c, '"[^"]+"', " ")
    return F.array_except(tokens_for_match(outside), F.array(*map(F.lit, rules.STOP_WORDS)))


def normalize_output(c: Column) -> Column:
    """Straight quotes, plain dashes, single blanks, trimmed; null gives ''. Input is taken as NFKC already (see ``nfkc``)."""
    plain = F.translate(F.coalesce(c, F.lit("")), "�‘’“”–—", "'''\"\"--")
    return F.trim(F.regexp_replace(plain, "[ \\t]+", " "))


def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Unicode NFKC, in Arrow batches; Spark has no built-in for it."""
    return arrow_udf(_nfkc, "string")(c)


def dedup_signature(c: Column) -> Column:
    """First 400 characters of the lower-cased text with single blanks."""
    return F.left(F.lower(F.trim(F.regexp_replace(c, "\\s+", " "))), F.lit(400))


def expand_abbreviations(c: Column, table: dict[str, str]) -> Column:
    """Words whose lower case is a key are replaced; the words are joined by one blank."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(words(c), lambda w: F.coalesce(F.try_element_at(lookup, F.lower(w)), w)), " ")


def split_connected(c: Column, longest: int = 15) -> Column:
    """Alphanumeric words longer than ``longest`` are split at case and digit changes."""
    parts = lambda w: F.array_join(F.regexp_extract_all(w, F.lit("[A-Z][a-z]*|[a-z]+|[0-9]+"), F.lit(0)), " ")
    long = lambda w: (F.length(w) > longest) & w.rlike("^[A-Za-z0-9]+$")
    return F.array_join(F.transform(words(c), lambda w: F.when(long(w), parts(w)).otherwise(w)), " ")


def drop_nonsense(c: Column) -> Column:
    """Keep words of letters, digits, dots and dashes with more than two distinct characters."""
    good = lambda w: w.rlike("^[a-zA-Z0-9.\\-]+$") & (F.size(F.array_distinct(F.split(F.lower(w), ""))) > 2)
    return F.array_join(F.filter(words(c), good), " ")


def section_references(c: Column) -> Column:
    """Numbers such as 4.1.2, 'Level 1', 'Part 121' and paragraph signs, in that order; a default where there is none."""
    patterns = ("\\b\\d+(?:\\.\\d+)+\\b", "\\b[Ll]evel\\s\\d+\\b", "\\b[Pp]art\\s\\d+\\b", "§\\s*\\d+(?:\\.\\d+)*")
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No References Found")))


def plain_tokens(c: Column) -> Column:
    """Lower-case words and numbers without stop words, duplicates kept."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+|[0-9]+(?:\\.[0-9]+)*"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*rules.STOP_WORDS))


def noun_lemma(w: Column) -> Column:
    """The singular of a lower-case English plural by its ending; other words as they are."""
    cut = lambda n: F.left(w, F.length(w) - n)
    return (
        F.when(F.length(w) < 4, w)
        .when(F.endswith(w, F.lit("ies")), F.concat(cut(3), F.lit("y")))
        .when(w.rlike("(ss|sh|ch|x|z)es$"), cut(2))
        .when(w.rlike("men$"), F.concat(cut(2), F.lit("an")))
        .when(w.rlike("[^siu]s$"), cut(1))
        .otherwise(w)
    )


def lemmas(c: Column) -> Column:
    """``plain_tokens`` as lemmas, duplicates kept."""
    return F.transform(plain_tokens(c), noun_lemma)


def pos_tags(c: Column) -> Column:
    """(text, pos) of every word, number and mark, by closed word classes and endings: a default where no tagger is plugged in."""
    found = F.regexp_extract_all(c, F.lit("\\p{L}+|[0-9]+(?:\\.[0-9]+)*|[^\\p{L}0-9\\s]"), F.lit(0))
    # The tags alone come from Python: an Arrow batch asks once for each distinct token.
    tags = arrow_udf(_tags, "array<string>")(found)
    return F.when(found.isNotNull(), F.zip_with(found, tags, lambda t, pos: F.struct(t.alias("text"), pos.alias("pos"))))


def _tags(tokens: pa.Array) -> pa.Array:
    flat = tokens.flatten().dictionary_encode()
    made = pa.array(list(map(_tag, flat.dictionary.to_pylist())), pa.string()).take(flat.indices)
    ends = np.append(0, np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())).astype(np.int32)
    return pa.ListArray.from_arrays(ends, made)


def _tag(token: str) -> str:
    first, low = unicodedata.category(token[0]), token.lower()
    if "0" <= token[0] <= "9":
        return "NUM"
    if first[0] != "L":
        return "PUNCT"
    for tag, held in rules.CLOSED_CLASSES.items():
        if low in held:
            return tag
    if first == "Lu":
        return "PROPN"
    return next((tag for tag, endings in rules.OPEN_ENDINGS if any(low.endswith(e) and len(low) >= len(e) + 2 for e in endings.split("|"))), "NOUN")


def personal_names(c: Column) -> Column:
    """Runs of two capitalised words: a default where no annotator that knows persons is plugged in."""
    return F.regexp_extract_all(c, F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0))


def quality_score(c: Column) -> Column:
    """0.7 by length up to 2000 characters, 0.3 by the share of letters and digits; 0 for a blank text."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^\\s+|\\s+$", ""))

    def score(t: Column) -> Column:
        share = F.length(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", "")) / F.length(t)
        return F.when(F.length(t) > 0, F.lit(0.7) * F.least(F.length(t) / F.lit(2000.0), F.lit(1.0)) + F.lit(0.3) * share).otherwise(F.lit(0.0))

    # Bound as the one element of an array, so that the text is trimmed once.
    return F.get(F.transform(F.array(t), score), F.lit(0))


def needs_review(source_type: Column, score: Column) -> Column:
    return (source_type == "pdf") & (score < 0.20)


def clipped(c: Column, n: int, tail: str = "...") -> Column:
    """The first ``n`` characters and ``tail`` where more follow."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(tail))).otherwise(c)


def compact_sources(sources: Column, most: int = 20, longest: int = 3000) -> Column:
    """First ``most`` of an array of (filename, chunk_id, text); trimmed, those without name or id dropped, long texts cut."""
    trimmed = F.transform(F.slice(sources, 1, most), lambda s: F.struct(F.trim(s.filename).alias("filename"), F.trim(s.chunk_id).alias("chunk_id"), F.trim(F.coalesce(s.text, F.lit(""))).alias("text")))
    named = F.filter(trimmed, lambda s: (s.filename != "") & (s.chunk_id != ""))
    cut = lambda t: F.when(F.length(t) > longest, F.concat(F.rtrim(F.left(t, F.lit(longest))), F.lit(" ..."))).otherwise(t)
    return F.transform(named, lambda s: F.struct(s.filename.alias("filename"), s.chunk_id.alias("chunk_id"), cut(s.text).alias("text")))


def short_title(c: Column) -> Column:
    """First seven words, 'New Session' where there is none."""
    title = F.array_join(F.slice(words(c), 1, 7), " ")
    return F.when(title != "", title).otherwise(F.lit("New Session"))


def session_title(title: Column, session_id: Column) -> Column:
    return F.coalesce(F.when(F.trim(title) != "", F.trim(title)), F.concat(F.lit("Session "), F.left(session_id, F.lit(8))))


def last_segments(c: Column, n: int = 3, longest: int = 8000) -> Column:
    """The last ``n`` blocks between blank lines, at most the last ``longest`` characters."""
    parts = F.split(c, "\n\n")
    kept = F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n))
    return F.right(F.array_join(kept, "\n\n"), F.lit(longest))


def context_text(entries: Column) -> Column:
    """Entries (filename, chunk_id, text) as tagged blocks, one under the other."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("[SOURCE filename="), e.filename, F.lit("; chunk_id="), e.chunk_id, F.lit("]\n"), e.text)), "\n")


SOURCE_TAG = "\\[SOURCE filename=(.*?); chunk_id=(.*?)\\]"


def citations(context: Column) -> Column:
    """Distinct (filename, chunk_id) of a context's tags, in order."""
    names, ids = (F.transform(F.regexp_extract_all(context, F.lit(SOURCE_TAG), F.lit(k)), lambda x: F.trim(x)) for k in (1, 2))
    return F.array_distinct(F.zip_with(names, ids, lambda a, b: F.struct(a.alias("filename"), b.alias("chunk_id"))))


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "on")


def iso_utc(ts: Column) -> Column:
    """A time stamp as ISO 8601 in UTC, with Z, to the microsecond."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def now_utc() -> Column:
    return iso_utc(F.current_timestamp())


def day(ts: Column) -> Column:
    """yyyy-MM-dd, as log names have it."""
    return F.date_format(ts, "yyyy-MM-dd")


def clock(ts: Column) -> Column:
    """The time of day as it is shown."""
    return F.date_format(ts, "h:mm:ss a")


def merged(a: Column, b: Column, *without: str) -> Column:
    """Two maps as one, entries of ``b`` before those of ``a``; the named keys left out. A null map is empty."""
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(a, none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(b, none)), k))
    both = F.map_concat(kept, F.coalesce(b, none))
    return F.map_filter(both, lambda k, v: ~k.isin(*without)) if without else both


def clamped(n: int | None, least: int, most: int, default: int) -> int:
    return max(least, min(int(default if n is None else n), most))


def first_json_object(c: Column, schema: str) -> Column:
    """The first JSON object in a noisy text."""
    return F.from_json(F.regexp_extract(c, "(?s)\\{.*", 0), schema)


def stem(c: Column) -> Column:
    return F.regexp_extract(c, "^(.*?)(\\.[^.]*)?$", 1)


def basename(c: Column) -> Column:
    return F.regexp_extract(c, "[^/]+$", 0)


def metadata_field(lines: Column, name: str) -> Column:
    """The rest of the line after 'name:' within the first five lines."""
    head = F.array_join(F.slice(F.split(lines, "\n"), 1, 5), "\n")
    return F.trim(F.regexp_extract(head, f"{name}:\\s*(.*)", 1))


def sentences_of(c: Column) -> Column:
    """Sentences at . ! ? followed by white space."""
    return F.filter(F.transform(F.split(c, "(?<=[.!?])\\s+"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")
