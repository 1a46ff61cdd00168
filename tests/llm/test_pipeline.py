"""Every stage of the pipeline on what the one before kept, against brute force."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import mixing, quality
from tests.llm.test_minhash_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        made = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs, made))
        docs = made
    return {name: (before, after) for name, before, after in out}


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(steps):
    assert list(steps) == ["quality", "exact", "near", "mix", "bpe"]
    for name in list(steps)[:-1]:
        before, after = steps[name]
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0


def test_quality_rejects_what_the_classifier_rejects(spark, steps):
    before, after = steps["quality"]
    scored = quality.scores(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert sorted(r.doc_id for r in scored.collect()) == sorted(i for i, _ in _rows(after))
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(before, "doc_id", "left_semi")
    lost = labels.join(after, "doc_id", "left_anti").count()
    assert lost <= 0.05 * labels.count()


def test_exact_keeps_the_largest_id(steps):
    before, after = steps["exact"]
    best = {}
    for i, t in _rows(before):
        best[t] = max(best.get(t, i), i)
    assert sorted(_rows(after)) == sorted((i, t) for t, i in best.items())


def test_near_keeps_one_of_each_group(steps):
    before, after = steps["near"]
    assert sorted(i for i, _ in _rows(after)) == sorted({int(c) for _, _, c in near_brute(_rows(before), 5, 80)})


def test_mix_takes_at_most_one_copy_and_keeps_to_its_budget(steps):
    before, after = steps["mix"]
    ids = [i for i, _ in _rows(after)]
    assert len(ids) == len(set(ids))
    tokens = lambda df: sum(len((t or "").split()) for _, t in _rows(df))
    assert tokens(after) <= mixing.PART * tokens(before) + 1


def test_bpe_matches_the_library(steps):
    from tokenizers import Tokenizer

    before, after = steps["bpe"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: hashlib.sha256(" ".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest() for i, x in _rows(before)}
    assert {r.doc_id: r.ids_sha256 for r in after.collect()} == want


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r.ids_sha256 for r in got.collect()) == sorted(r.ids_sha256 for r in steps["bpe"][1].collect())


def test_stages_stand_nulls_repeats_and_no_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (2, "", "en", "src1", 0), (None, "a b c d e f g", "en", None, 5), (3, "a b c d e f g", None, "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}-{n}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{n}")
            if n < 4:
                assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            if not data:
                assert docs.count() == 0


def test_stages_pass_clashing_columns_and_very_long_texts(spark, tmp_path):
    """Columns named like the operators' own, and a text of 60,000 distinct words with a near copy."""
    long = " ".join(f"word{k}" for k in range(60_000))
    plain = [" ".join(f"{w}{k % 7}" for w in ("the", "plane", "flew", "over", "hills", "and", "rivers", "today")) for k in range(14)]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate([long, long + " more", long, *plain])]
    docs = spark.createDataFrame([(*r, *range(9)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, label int, score int, id int, key int, mark int, copies int, tokens int, domain int, best int")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name != "bpe":
            assert docs.columns == columns and set(docs.select("best").distinct().collect()) <= {(8,)}
        if name == "exact":
            assert docs.count() == 2 + 7
        if name == "near":
            assert docs.where("n_chars > 1000").count() == 1
    kept = quality.keep(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __score int, label int"), spark.read.parquet(f"{SF}/labels.parquet"), threshold=0.0)
    assert kept.columns[-2:] == ["__score", "label"] and kept.count() == len(rows)
