"""License scans against SQL and a brute-force scan of word lists."""

import re

from lodestone.llm import license_scan, queries
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"
TEXTS = [
    "Licensed under CC BY-NC 4.0.",
    "MIT license, mit LICENSE; the MIT\nLicense mit license",
    "cc by cc by cc-by",
    "GNU General Public License, version 3. GNU general public license",
    "permission is hereby granted, free of charge, to any person obtaining a copy of these files",
    "redistribution and use in source and binary forms, with or without changes, are permitted",
    "apaché license apache licensé apache license Kit license Mit　license",
    "",
    None,
    "word " * 50000 + "apache license",
    "mit  license " * 3,
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTIES OR CONDITIONS of any kind, either express or implied. You may not use this file except in compliance with the License",
    "licenses and the mit, a license of mit; gnu public general license",
]


def test_templates_are_under_two_words_of_their_key():
    for t in license_scan.templates():
        a, b = t["key"]
        assert len(set(t["words"][a:b])) >= 2


def brute(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(fold))
    places = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_query_matches_sql(spark):
    same(queries.op4_license_scan(spark, SF), queries.oracle_sql()["op4_license_scan"], SF)


def test_base_matches_brute_force(spark):
    docs = spark.createDataFrame([(k, x, "w") for k, x in enumerate(TEXTS)] + [(0, TEXTS[0], "w"), (None, "mit license", "w")], "doc_id long, text string, words string")
    found = license_scan.scan(docs).collect()
    got = sorted(((str(r.doc_id), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found), key=str)
    want = sorted(((str(r.doc_id), brute(r.text)) for r in docs.collect()), key=str)
    assert got == want
    labels = {r.doc_id: r.labels for r in found}
    assert labels[0] == "cc-by,cc-by-nc" and labels[3] == "gpl,gpl-3.0" and labels[4] == "mit" and labels[5] == "bsd" and labels[6] == ""
    assert labels[11] == "apache-2.0" and labels[12] == ""
    assert all(0 <= r.score <= 1 for r in found)
    assert license_scan.scan(docs.limit(0)).count() == 0
