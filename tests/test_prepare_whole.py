"""Every step of the preparation is in the prepared text: expanded, split by case and by words, filtered, without stop words, as lemmas."""

import itertools
import math
import random

import pytest

from lodestone.functions import cleaning, segment
from lodestone.plans import ingest

DOCS = "filename string, text string"


def _prepared(spark, texts, **more):
    docs = spark.createDataFrame([(f"d{k}.txt", t) for k, t in enumerate(texts)], DOCS)
    return [r for r in ingest.prepare(docs, **more).orderBy("filename").collect()]


def test_connected_words_of_any_length_are_split_by_a_word_list(spark):
    rows = _prepared(spark, ["Subpart flightdeck", "airtrafficcontrolsystem", "FlightControlSystem crewmember"])
    assert [r.text for r in rows] == ["sub part flight deck", "air traffic control system", "flight control system crew member"]
    assert [r.tokens for r in rows] == [r.text.split() for r in rows]


def test_words_beside_marks_stay_and_numbers_with_dots_stay_whole(spark):
    [row] = _prepared(spark, ['The "crew", (pilot) required: 5.17; N632SW/wing_tip. Ground-operations, 737 see'])
    assert row.text == "crew pilot require 5.17 632 wing tip ground operation"


def test_stop_words_go_and_lemmas_are_of_nouns_and_verbs(spark):
    [row] = _prepared(spark, ["He was reporting the planned airlines, identified documents and training; avionics carries bodies"])
    assert row.text == "report plan airline identify document training avionics carry body"
    [row] = _prepared(spark, ["no more than one"])
    assert row.text == "more one" and row.tokens == ["one"]
    assert _prepared(spark, ["planes flew"], lemma=str.upper)[0].text == "PLANES FLEW"


def test_words_and_abbreviations_of_the_caller(spark):
    [row] = _prepared(spark, ["zorblek ATC, atc blekzor"], words=["zor", "blek"], abbreviations={"atc": "air traffic control"})
    assert row.text == "zor blek atc air traffic control blek zor"


def test_the_category_is_that_of_the_expanded_text(spark):
    rows = _prepared(spark, ["mx mx", "pax", ""], abbreviations={"mx": "repair overhaul"})
    assert [r.category for r in rows] == ["maintenance", "safety", "safety"]


def test_metadata_name_source_method_and_review(spark):
    docs = spark.createDataFrame([("a.pdf", "x", "two", 0.1), ("b.docx", "Title: B", "docx", 1.0), ("c.pdf", "y", "one", 0.2)], DOCS + ", method string, extraction_quality double")
    got = {r.filename: (r.metadata.source_type, r.metadata.extraction_method, r.metadata.extraction_quality, r.metadata.needs_manual_review) for r in ingest.prepare(docs).collect()}
    assert got == {"a.pdf": ("pdf", "two", 0.1, True), "b.docx": ("docx", "docx", 1.0, False), "c.pdf": ("pdf", "one", 0.2, False)}
    got = {r.filename: r.metadata for r in ingest.prepare(docs.select("filename", "text")).collect()}
    assert got["b.docx"].extraction_quality == 1.0 and not got["a.pdf"].needs_manual_review and got["a.pdf"].extraction_quality == pytest.approx(0.3, abs=0.001)


def test_odd_texts(spark):
    rows = _prepared(spark, [None, "", "  \n", "é ß § 5.1", "a" * 5000, "…" * 50])
    assert [r.text for r in rows] == ["", "", "", "5.1", "", ""] and [r.tokens for r in rows][:3] == [[], [], []]


def test_splits_are_the_cheapest_of_all():
    draw = random.Random(4)
    known = segment.costs(["ab", "a", "ba", "abb", "bab", "aab", "bba"])
    for _ in range(300):
        word = "".join(draw.choice("ab") for _ in range(draw.randint(1, 9)))
        cuts = (sorted(c) for n in range(len(word)) for c in itertools.combinations(range(1, len(word)), n))
        ways = ([word[i:j] for i, j in zip([0, *c], [*c, len(word)])] for c in cuts)
        best = min((sum(known.get(p, math.inf) for p in way) for way in ways), default=math.inf)
        got = segment.split_covered(word, known, 3)
        if word in known or best == math.inf:
            assert got == [word]
        else:
            assert "".join(got) == word and sum(known[p] for p in got) == pytest.approx(best)


def test_the_stand_in_list_splits_no_known_word():
    known = segment.english_costs()
    for word in ("within", "area", "severity", "interface", "takeoff", "applicability", "cybersecurity", "airplane"):
        assert cleaning.split_connected(word, known, max(map(len, known))) == [word]
