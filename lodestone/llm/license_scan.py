"""License scans through a positional index of rare licence words.

Every licence template is a list of words with a mandatory key phrase. The
index holds each template under the two highest-IDF words of its key phrase (IDF
over all documents), each with its positions in the template. A file that can
match a template holds both, so it looks up its own highest-IDF licence words:
each posting gives a template and the relative position at which it would start.
The postings of a template's two words are intersected by that relative
position; where they meet, the key phrase must match word for word, and the
matching words must carry enough of the template's IDF. A base phrase is a
template that is all key.

Everything is DataFrame expressions, local to a row; the only shuffle is the
count of documents per licence word, aggregated within each task first. What
comes to the driver is one number per word of the templates.

Words are runs of anything but ASCII non-alphanumerics, A-Z lower-cased.
Defined results: a null text counts as empty: 0 words, no places, null
first_word and last_word, empty labels, score 0; repeated rows give repeated
rows; null ids stay null; an empty table gives an empty table; further columns
are ignored. Whole texts are read whatever their length.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Part of a template's IDF that the words at their relative positions must carry.
LEAST_MATCH = 0.6

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Wording of public licences, with the key phrase that must be there, and the label.
NOTICES = (
    ("licensed under the gnu general public license version 2", "general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "not use this file except in compliance with the license", "apache-2.0"),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        "unless required by applicable law or agreed to in writing software distributed under the license", "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation", "gpl-notice",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version",
        "gnu lesser general public license as published by the free software foundation", "lgpl",
    ),
    (
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "deal in the software without restriction", "mit",
    ),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement",
        "provided as is without warranty of any kind express or implied", "mit",
    ),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice this list of conditions", "bsd"),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
        "names of its contributors may be used to endorse or promote products", "bsd-3-clause",
    ),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights", "cc0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse public license", "epl"),
    ("in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable for any damages", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software", "bsl-1.0"),
)


def templates() -> list[dict]:
    """label, base, words and the place of the key phrase of every template."""
    out = []
    for text, key, label, base in [(t, t, x, True) for t, x in BASE] + [(*n, False) for n in NOTICES]:
        words, part = text.split(), key.split()
        at = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
        out.append({"label": label, "base": base, "words": words, "key": (at, at + len(part))})
    return out


def lowered(text: Column) -> Column:
    """A-Z lower-cased; the Kelvin sign, whose lower case is an ASCII k, is kept apart."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("�")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of every template word over all documents."""
    held = F.array_intersect(words_of(lowered(F.col("text"))), F.array(*map(F.lit, vocabulary)))
    marked = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word"))
    found = {r.word: r.n for r in marked.groupBy("word").agg(F.count("*").alias("n")).collect()}
    n_docs = found.get("", 0)
    return {w: math.log((n_docs + 1) / (found.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def scan(docs: DataFrame, least_match: float = LEAST_MATCH) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches."""
    listed = templates()
    weight = idf(docs, sorted({w for t in listed for w in t["words"]}))
    first, second = {}, {}
    for k, t in enumerate(listed):
        a, b = t["key"]
        for index, rare in zip((first, second), sorted(set(t["words"][a:b]), key=lambda w: (-weight[w], w))):
            index.setdefault(rare, []).extend({"t": k, "q": q} for q in range(a, b) if t["words"][q] == rare)
    spec = [
        {"label": t["label"], "base": t["base"], "total": sum(weight[w] for w in t["words"]), "words": [{"q": q, "w": w, "idf": weight[w], "key": t["key"][0] <= q < t["key"][1]} for q, w in enumerate(t["words"])]}
        for t in listed
    ]
    shape = "array<struct<label:string,base:boolean,total:double,words:array<struct<q:int,w:string,idf:double,key:boolean>>>>"
    listing = F.from_json(F.lit(json.dumps(spec)), shape)
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.col("text")).alias("__low"))
    holds = F.lit(False)
    for w in sorted(first):
        holds = holds | F.contains(F.col("__low"), F.lit(w))
    split = low.select("doc_id", words_of(F.col("__low")).alias("__words"), holds.alias("__holds"))
    words = F.col("__words")

    def starts(index: dict[str, list[dict]]) -> Column:
        """Templates and the relative positions at which the postings of a file's words say they start."""
        postings = F.from_json(F.lit(json.dumps([{"w": w, "at": at} for w, at in sorted(index.items())])), "array<struct<w:string,at:array<struct<t:int,q:int>>>>")
        rare = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h.w.isin(sorted(index)))
        return F.flatten(F.transform(rare, lambda h: F.transform(F.filter(postings, lambda p: p.w == h.w)[0]["at"], lambda p: F.struct(p.t.alias("t"), (h.i - p.q).alias("o")))))

    def meet(c: Column) -> Column:
        t = F.get(listing, c.t)
        same = lambda x: F.coalesce(F.get(words, c.o + x.q) == x.w, F.lit(False))
        key = F.forall(t.words, lambda x: ~x.key | same(x))
        carried = F.aggregate(t.words, F.lit(0.0), lambda acc, x: acc + F.when(same(x), x.idf).otherwise(0.0))
        return F.struct(t.label.alias("label"), t.base.alias("base"), c.o.alias("start"), key.alias("key"), F.when(t.base, F.lit(1.0)).otherwise(carried / t.total).alias("part"))

    none = F.from_json(F.lit("[]"), "array<struct<label:string,base:boolean,start:int,key:boolean,part:double>>")
    met = F.when(F.col("__holds"), F.filter(F.transform(F.array_intersect(starts(first), starts(second)), meet), lambda m: m.key & (m.part >= least_match))).otherwise(none)
    found = split.select("doc_id", F.size("__words").cast("long").alias("n_words"), met.alias("matches"))
    base = F.filter("matches", lambda m: m.base)
    places = F.transform(base, lambda m: m.start.cast("long"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m.part)), F.lit(0.0)), 6).alias("score"),
        "matches",
    )


def oracle() -> str:
    """The same rows by plain joins in DuckDB: every template at every relative position."""
    rows = []
    for k, t in enumerate(templates()):
        for q, w in enumerate(t["words"]):
            rows.append(f"({k}, '{t['label']}', {str(t['base']).lower()}, {q}, '{w}', {str(t['key'][0] <= q < t['key'][1]).lower()})")
    return f"""
WITH template(t, label, base, q, w, is_key) AS (VALUES {', '.join(rows)}),
held AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
place AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM held),
weight AS (SELECT v.w, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(DISTINCT p.doc_id) + 1)) + 1e-6 AS idf
           FROM (SELECT DISTINCT w FROM template) v LEFT JOIN place p ON p.w = v.w GROUP BY v.w),
sized AS (SELECT t, any_value(label) AS label, any_value(base) AS base, count(*) FILTER (is_key) AS n_key, sum(idf) AS total
          FROM template JOIN weight USING (w) GROUP BY t),
met AS (SELECT p.doc_id, x.t, p.i - x.q AS o, count(*) FILTER (x.is_key) AS n_key, sum(k.idf) AS carried
        FROM place p JOIN template x ON p.w = x.w JOIN weight k ON k.w = x.w GROUP BY 1, 2, 3),
good AS (SELECT m.doc_id, m.o, s.label, s.base, CASE WHEN s.base THEN 1.0 ELSE m.carried / s.total END AS part
         FROM met m JOIN sized s ON m.t = s.t AND m.n_key = s.n_key WHERE s.base OR m.carried / s.total >= {LEAST_MATCH})
SELECT h.doc_id, len(any_value(h.words)) AS n_words, count(g.o) FILTER (g.base) AS n_base,
       min(g.o) FILTER (g.base) AS first_word, max(g.o) FILTER (g.base) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT g.label) FILTER (g.base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT g.label) FILTER (g.label IS NOT NULL)), ','), '') AS labels,
       round(coalesce(max(g.part), 0.0), 6)::DOUBLE AS score
FROM held h LEFT JOIN good g ON g.doc_id = h.doc_id GROUP BY h.doc_id
"""
