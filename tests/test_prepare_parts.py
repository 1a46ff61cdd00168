"""Tags and categories of whole texts against the plain expressions they stand for."""

import re

from pyspark.sql import functions as F

from lodestone.functions import intent, rules, text

TEXTS = [None, "", "Été naïve Kg Ⅷ² ǅ 𝔄bc flyly ly bedly aing 3.14.15 x y\u0085z _a-b -- ... The OF OUR", "thing sing ed bed ized ally al pal λογος ЁЖ", "weather Weather\u00a0report safety\tmanual air traffic  control", *[" ".join(p) for p in rules.CATEGORIES.values()]]


def _plain_tags(t):
    low = F.lower(t)
    out = F.when(t.rlike("^[0-9]"), "NUM").when(~t.rlike("^\\p{L}"), "PUNCT")
    for tag, held in rules.CLOSED_CLASSES.items():
        out = out.when(low.isin(*held), tag)
    out = out.when(t.rlike("^\\p{Lu}"), "PROPN")
    for tag, ending in rules.OPEN_ENDINGS:
        out = out.when(low.rlike(f".{{2,}}({ending})$"), tag)
    return out.otherwise("NOUN")


def test_tags_and_categories_of_odd_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").repartition(2)
    tags = text.pos_tags(F.col("t"))
    got = rows.select("t", tags.alias("tags"), F.transform(tags, lambda x: _plain_tags(x.text)).alias("want"), intent.category(F.col("t")).alias("category")).collect()
    for r in got:
        assert (r.tags is None) == (r.t is None) and [x.pos for x in r.tags or []] == (r.want or [])
        scores = {name: sum(p in (r.t or "").lower() for p in phrases if p == p.lower()) for name, phrases in rules.CATEGORIES.items()}
        assert r.category == max(scores, key=scores.get)


def test_no_pattern_is_asked_for_each_token(spark):
    made = spark.createDataFrame([("a b",)], "t string").select(text.pos_tags(F.col("t")).alias("tags"), intent.category(F.col("t")).alias("category"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("RLIKE|contains", plan, re.I)
