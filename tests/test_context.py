"""Sentiment in context and concordance lines on small texts."""

import pytest

from lodestone.operators import analytics

LEXICON = [("good", 2.0), ("bad", -2.5), ("fine", 0.8)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a good day", 2.0),
        ("a not good day", 2.0 * -0.74),
        ("not by any good day", 2.0 * -0.74),
        ("not one of the good days", 2.0),
        ("very good", 2.293),
        ("very much good", 2.0 + 0.293 * 0.95),
        ("really so good", 2.0 + 0.293 + 0.293 * 0.95),
        ("barely bad", -2.5 + 0.293),
        ("a GOOD day", 2.733),
        ("GOOD", 2.0),
        ("not very BAD and fine", (-2.5 - 0.733 - 0.293) * -0.74 + 0.8 + 0.293 * 0.9),
        ("Don't say good", 2.0 * -0.74),
        ("nothing here", 0.0),
        (None, 0.0),
        ("", 0.0),
    ],
)
def test_valence_in_context(spark, text, want):
    row = analytics.sentiment_in_context(spark.createDataFrame([(1, text)], "id long, text string"), "id", spark.createDataFrame(LEXICON, "word string, valence double")).first()
    assert row.valence == pytest.approx(want, abs=1e-6)
    assert row.compound == pytest.approx(want / (want**2 + 15) ** 0.5, abs=1e-6)
    assert row.pos + row.neg + row.neu == pytest.approx(1.0 if text else 0.0, abs=1e-5)


def test_exclamation_marks_raise_the_sum(spark):
    rows = [(1, "good!!"), (2, "bad!!!!!!!"), (3, "day!!!")]
    got = analytics.sentiment_in_context(spark.createDataFrame(rows, "id long, text string"), "id", spark.createDataFrame(LEXICON, "word string, valence double"))
    values = {r.id: r.compound for r in got.collect()}
    for k, s in ((1, 2 + 2 * 0.292), (2, -2.5 - 4 * 0.292), (3, 0.0)):
        assert values[k] == pytest.approx(s / (s * s + 15) ** 0.5, abs=1e-6)


def test_concordance_lines_are_cut_by_characters(spark):
    words = [f"w{k}" for k in range(40)]
    text = " ".join([*words[:30], "Word", *words[30:], "word"])
    got = analytics.concordance_lines(spark.createDataFrame([(1, text), (2, None), (3, "swords")], "id long, text string"), "id", "word", 30).orderBy("place").collect()
    half = (30 - 4 - 2) // 2
    assert [(r.place, r.line) for r in got] == [(30, f"{' '.join(words[23:30])[-half:]} word {' '.join(words[30:36])[:half]}"), (41, f"{' '.join(words[34:40])[-half:]} word ")]
