"""Tables of questions, the lexical index and the cells against their one-question and brute-force forms."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import engine
from lodestone.functions.codec import pack_ascending, unpack_ascending
from lodestone.operators import cells, knn, lexical_index, search
from lodestone.plans import catalogue, question_queries

SF = "/root/testdata/sf0.001"


def _exact(keys, c, q, k):
    out = []
    for key, v in zip(keys, c):
        size = np.sqrt((v**2).sum()) * np.sqrt((q**2).sum())
        out.append((-round(float((v * q).sum() / size) if size else 0.0, 12), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


@pytest.mark.parametrize("per_pass", [16_384, 200])
def test_nearest_many_is_brute_force(spark, monkeypatch, per_pass):
    monkeypatch.setattr(knn, "PASS_QUESTIONS", per_pass)
    monkeypatch.setattr(knn, "CANDIDATE_BYTES", 6400)
    r = np.random.default_rng(1)
    c = r.normal(0, 1, (700, 8))
    c[300:350], c[600] = c[0], 0  # ties, and a vector without length
    q = np.concatenate([r.normal(0, 1, (600, 8)), c[:1]])
    keys = [f"k{i:03d}" for i in r.permutation(700)]
    data = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, c)] + [("null", None), (None, [1.0] * 8), ("part", [None, 1.0]), ("short", [1.0])], "id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(9000, None)], "query_id long, vector array<double>")
    got = {}
    for row in knn.nearest_many(data, asked, 7, "id").orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.id, round(row.similarity, 12)))
    assert len(got) == 601
    for i in (*range(0, 600, 40), 600):
        assert got[i] == [(k, pytest.approx(s)) for k, s in _exact(keys, c, q[i], 7)], i


def test_targets_of_many_are_those_of_one(spark):
    r = random.Random(4)
    words = "wing lift report guide stall order icing 2025 2024 flight manual crash".split()
    names = [f"{'_'.join(r.sample(words, 4))}_{k}.pdf" for k in range(200)]
    asked = [(k, f'{r.choice(["About", "According to"])} "{" ".join(r.sample(words, r.randint(1, 4)))} {r.randint(0, 250)}" and "{r.choice(words)} x"') for k in range(25)]
    asked += [(100, "according to the wing report"), (101, "no cue at all"), (102, 'a single " quote of wing'), (103, '"an"'), (104, "according to nothing known"), (105, None)]
    files, questions = spark.createDataFrame([(n,) for n in names + names[:9]], "filename string"), spark.createDataFrame(asked, "query_id long, query string")
    got = {r.query_id: (r.filename, round(r.score, 9)) for r in search.detect_targets(files, questions).collect()}
    for i, query in asked[:-1]:
        one = search.detect_target(files.distinct(), query).first()
        assert got.get(i) == (one and (one.filename, round(one.score, 9))), query
    assert len(got) > 15 and 105 not in got


def _made(spark):
    docs = question_queries._named(spark.read.parquet(f"{SF}/documents.parquet")).select("filename", "text")
    docs = docs.unionByName(spark.createDataFrame([("Guide_only_chunks.pdf", ""), ("Guide_only_vectors.pdf", None)], "filename string, text string"))
    vectors = question_queries._chunk_vectors(spark, SF)
    first = vectors.orderBy("chunk_id").first()
    more = spark.createDataFrame([("Guide_only_chunks.pdf", "c1", "wing wing lift"), ("Guide_only_chunks.pdf", "c2", "lift of a wing and stall"), ("Guide_only_vectors.pdf", "v1", "")], "filename string, chunk_id string, text string")
    return engine.Engine(docs, question_queries._chunks(spark, SF).unionByName(more), vectors=vectors), list(first.embedding)


def test_many_questions_are_answered_as_one_is(spark):
    made, vector = _made(spark)
    texts = ["how wings lift", "ntsb crash findings", "part 25 compliance", 'What does "2025 Guide 12" say of the andre?', 'What of stall does "Guide only chunks" say?', 'And "Guide only vectors" of wings?', "  ", None]
    asked = spark.createDataFrame([(k, t, vector) for k, t in enumerate(texts)], "query_id long, query string, vector array<double>")
    got = {r.query_id: r for r in made.ask_many(asked).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    made.embedder = type("Fixed", (), {"one": lambda self, text: vector})()
    for k in range(6):
        one, many = made.ask(texts[k]).first(), got[k]
        assert (many.answer, many.strict_mode, many.target_filename) == (one.answer, one.strict_mode, one.target_filename), texts[k]
        assert many.sources == one.sources and many.citations == one.citations
    assert [s.chunk_id for s in got[4].sources] == ["c2", "c1"] and not got[5].sources


def test_an_embedder_gives_the_vectors(spark):
    made, _ = _made(spark)
    asked = spark.createDataFrame([(1, "how wings lift")], "query_id long, query string")
    made.vectors = made.chunks.select("chunk_id", made.embedder.column(F.col("text")).alias("embedding"))
    assert made.ask_many(asked).first().sources == made.ask("how wings lift").first().sources
    assert made.ask_many(asked.limit(0)).count() == 0


def test_packed_integers():
    for values in ([], [5], [-3, 0, 9], [0, 1 << 40, (1 << 40) + 1], list(range(0, 70_000, 7))):
        assert unpack_ascending(pack_ascending(np.array(values, np.int64))).tolist() == values


def _texts():
    r, words = random.Random(8), "ab abc abcd bc the and wing lift stall icing order rare1 rare2".split()
    return [(k - 50, " ".join(r.choices(words[: r.choice([6, 13])], k=r.randint(0, 60)))) for k in range(400)] + [(900, None), (901, "Ice-ICING; icing"), (902, "sab cdx")]


QUERIES = ["wing lift rare1", '"ab abc" wing', '"wing lift stall" rare2 "bc"', '"b c"', "rare1 rare2 wing lift stall icing order the", "zzz unknown", "", '"ab"', "icing"]


@pytest.mark.parametrize("shape", [{}, {"slice_docs": 40, "cell_tokens": 200}])
def test_lexical_index_ranks_as_the_scan_does(spark, tmp_path, shape):
    docs = spark.createDataFrame([(*x, "d") for x in _texts()], "doc_id long, text string, doc string").repartition(4)
    index = lexical_index.write_index(docs, f"{tmp_path}/i", **shape)
    again = lexical_index.LexicalIndex(spark, f"{tmp_path}/i")
    for query in QUERIES:
        score = F.coalesce(search.lexical_score(F.col("text"), F.lit(query)), F.lit(0))
        want = [tuple(r) for r in docs.select("doc_id", score.alias("s")).orderBy(F.desc("s"), "doc_id").limit(7).collect()]
        assert [tuple(r) for r in again.rank(query, 7).collect()] == want, query
    assert index.slices == again.slices and (not shape or index.slices > 1)


def test_frequent_tokens_are_read_for_candidates_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "HELD", 50)
    rows = [(k, "common other word here") for k in range(3000)] + [(5000 + k, "rare1 rare2 rare3 common") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = lexical_index.write_index(docs, f"{tmp_path}/i", slice_docs=20)
    got = [tuple(r) for r in index.rank("rare1 rare2 rare3 common other", 2).collect()]
    assert got == [(5000, 4), (5001, 4)] and index.left == ["other", "common"]
    all_blocks, _ = index.blocks_read(["common"])
    few, size = index.blocks_read(["rare1"])
    assert all_blocks > 100 and few <= 3 and size < 1000


def test_lexical_index_of_nothing(spark, tmp_path):
    index = lexical_index.write_index(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/i")
    assert index.rank("wing", 3).count() == 0


def _recall(found, fitted, vectors, ids, k=5):
    keys, c = np.array([r.vec_id for r in vectors]), np.array([r.embedding for r in vectors], np.float64)
    units = c / np.linalg.norm(c, axis=1, keepdims=True)
    hits = 0
    for i in ids:
        sims = units @ units[i]
        sims[i] = -9
        best = set(keys[np.argsort(-sims, kind="stable")[:k]].tolist())
        got = [x["key"] for x in found(c[i].tolist())]
        exact = sorted((x for x in got if x != keys[i]), key=lambda x: -sims[np.flatnonzero(keys == x)[0]])[:k]
        hits += len(best & set(exact))
    return hits / (k * len(ids))


def test_cells_hold_the_neighbours_and_read_a_fifth(spark, tmp_path):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    fitted = cells.Cells.fit(data, f"{tmp_path}/c", "vec_id")
    assert fitted.fine.shape[0] * fitted.fine.shape[1] >= 36
    rows = fitted.rows().select("key", "cell", "code").collect()
    key, cell = np.array([r.key for r in rows]), np.array([r.cell for r in rows])
    codes = np.frombuffer(b"".join(r.code for r in rows), np.uint8).reshape(len(rows), -1)
    signs = 2.0 * np.unpackbits(codes, axis=1, count=64) - 1
    read = []

    def found(query):
        """``candidates`` without a job for each of 400 questions."""
        near = np.flatnonzero(np.isin(cell, fitted.nearest(query)))
        best = near[np.argsort(-(signs[near] @ np.array(query)), kind="stable")[: cells.RERANK * 5]]
        read.append(len(best) / len(rows))
        return [{"key": k} for k in key[best].tolist()]

    vectors = data.orderBy("vec_id").collect()
    assert _recall(found, fitted, vectors, range(0, 2000, 5)) >= 0.9
    assert max(read) <= 0.2
    query = [float(x) for x in vectors[3].embedding]
    assert sorted(x["key"] for x in fitted.candidates(query, 5)) == sorted(x["key"] for x in found(query))
    got = [tuple(r) for r in fitted.search(query, 5).collect()]
    assert got[0][0] == 3 and [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def test_cells_take_in_more_rows(spark, tmp_path):
    r = np.random.default_rng(2)
    make = lambda ids: spark.createDataFrame([(f"k{i}", r.normal(0, 1, 8).tolist()) for i in ids] + [(None, [1.0] * 8), ("z", [0.0] * 8), ("n", None), ("w", [1.0])], "id string, embedding array<double>")
    fitted = cells.Cells.fit(make(range(100)), f"{tmp_path}/c", "id", k=3)
    assert fitted.rows().count() == 100 and not fitted.outgrown()
    more = make(range(100, 420)).cache()
    fitted.append(more)
    again = cells.Cells(spark, f"{tmp_path}/c")
    assert again.rows().count() == 420 and again.outgrown() and again.probes == fitted.probes
    one = more.where("id = 'k300'").first()
    assert again.search(list(one.embedding), 1).first()["id"] == "k300"


def test_registered_cells_return_near_rows(spark):
    got = catalogue.queries()["grown_cell_search"](spark, SF).collect()
    exact = catalogue.queries()["cosine_topk"](spark, SF).collect()
    assert len(got) == 5 and got[0] == exact[0] and {tuple(r) for r in got} <= {tuple(r) for r in exact}


def test_the_whole_checked_answer_is_returned(spark):
    """Answer, check and follow-ups against the same rules in plain Python."""
    import re

    from lodestone.functions import rules

    row = catalogue.queries()["checked_answer"](spark, SF).first()
    assert row.context == catalogue.queries()["checked_search"](spark, SF).first().context
    sentences = lambda t: [x for x in (y.strip() for y in re.split(r"(?<=[.!?])\s+", t)) if x]
    tokens = lambda t: [x for x in re.sub("[^a-z0-9]+", " ", t.lower()).strip().split(" ") if len(x) > 2]
    assert row.answer == " ".join(sentences(row.context)[:3])
    held = set(tokens(row.context))
    good = [s for s in sentences(row.answer) if len(set(tokens(s)) & held) >= 0.6 * len(set(tokens(s)))]
    assert list(row.check.supported) == good and row.check.accurate == (good == sentences(row.answer)) and not set(row.check.unsupported) & set(good)
    new = [t for t in dict.fromkeys(tokens(row.answer)) if t not in tokens("how wings lift") and len(t) > 5 and t not in rules.STOP_WORDS]
    assert list(row.follow_ups) == [f"What else is known about {t}?" for t in new[:3]]


def test_a_cell_is_merged_in_few_bytes_an_occurrence():
    import tracemalloc

    r, n = np.random.default_rng(2), 600_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([0] * 600, pa.int32()), pa.array([" ".join(f"t{k}" for k in r.integers(0, 500, n // 600)) for _ in range(600)])], names=["doc", "slice", "norm"])
    runs = pa.Table.from_batches(list(lexical_index._runs(1)(iter([batch]))))
    tracemalloc.start()
    made = lexical_index._merge(runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(made.column("n_places").to_pylist()) == n and peak < 64 * n, peak / n
