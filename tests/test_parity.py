"""Files, clocks, seams, stores, ranking and the command line: rows of their own, against plain Python."""

import datetime
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import __main__ as cli
from lodestone import engine, seams
from lodestone.functions import segment, text, vectors
from lodestone.operators import analytics, consistency, search, sessions
from lodestone.plans import ingest
from lodestone.sources import files, pdf, sinks, web
from lodestone.streaming import incremental
from tests.test_operators import one

CMAP = b"beginbfchar <0001> <0041> <0002> <00E9> endbfchar beginbfrange <0010> <0012> <0061> endbfrange"


def _stream(data: bytes, flate: bool = True) -> bytes:
    body = zlib.compress(data) if flate else data
    return b"1 0 obj << /Length %d %s >> stream\n" % (len(body), b"/Filter /FlateDecode" if flate else b"") + body + b"\nendstream endobj\n"


def test_pdf_text_and_metadata():
    page = rb"BT /F1 12 Tf 72 700 Td [(Hel) -20 (lo) -300 (wor\154d)] TJ 0 -14 Td (Second \(line\)) Tj T* (third) Tj ET"
    content = b"%PDF-1.4\n" + _stream(page) + b"5 0 obj << /Title (A \\(fine\\) report) /Author <FEFF00C90076> >> endobj\n"
    assert pdf.text_in_order(content) == "Hello world\nSecond (line)\nthird"
    assert pdf.text_by_lines(content) == "Hello world\nSecond (line)\nthird"
    assert pdf.metadata(content) == {"title": "A (fine) report", "authors": "Év"}
    glyphs = b"BT 1 0 0 1 72 700 Tm <00010002> Tj <001000110012> Tj 1 0 0 1 72 680 Tm (x) Tj ET"
    assert pdf.text_by_lines(b"%PDF" + _stream(CMAP) + _stream(glyphs, False)) == "Aé abc\nx"
    assert pdf.text_by_lines(b"%PDF BT (a) Tj (b) Tj (c) Tj ET") == "abc"
    for broken in (b"", b"%PDF", b"%PDF << /Filter /FlateDecode >> stream\nnot flate\nendstream", _stream(b"BT ( ET")):
        assert pdf.text_in_order(broken) == "" and pdf.text_by_lines(broken) == "" and pdf.metadata(broken) == {"title": "", "authors": ""}


def test_file_metadata_and_entries(spark, tmp_path):
    from tests.test_operators import _docx

    _docx(tmp_path / "a.docx", ["Title: T one", "Author(s): A, B", "Tags: x", "Category: safety", "z", "Title: late"])
    (tmp_path / "b.pdf").write_bytes(b"%PDF << /Title (P) >>")
    got = {r.filename: (r.title, r.authors, r.category, r.tags) for r in files.metadata(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": ("T one", "A, B", "safety", "x"), "b.pdf": ("P", "", "", "")}
    rows = spark.createDataFrame([("f", f"f_{k}", "t") for k in range(9)], "filename string, chunk_id string, text string")
    sinks.write_corpus(rows, str(tmp_path / "store"))
    assert files.first_entries(spark, str(tmp_path / "store"), 4).count() == 4 and files.version(spark) == spark.version
    assert sinks.read_corpus(spark, str(tmp_path / "store")).count() == 9


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("a.pdf", "Raw", "raw"), ("b.docx", "x", "y")], "filename string, raw string, text string")
    sinks.write_texts(docs, str(tmp_path / "texts"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "texts/raw")).collect()} == {("a.txt", "Raw"), ("b.txt", "x")}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "texts/processed")).collect()} == {("a.txt", "raw"), ("b.txt", "y")}
    chunks = spark.createDataFrame([("a.pdf", "a_0", "t"), ("a.pdf", "a_1", "u")], "filename string, chunk_id string, text string")
    sinks.write_chunk_files(chunks, str(tmp_path / "chunks"))
    more = chunks.unionByName(spark.createDataFrame([("a.docx", "z", "same stem"), ("c.pdf", "c_0", "v")], chunks.schema))
    sinks.write_chunk_files(more, str(tmp_path / "chunks"))
    assert sorted(r.chunk_id for r in spark.read.json(str(tmp_path / "chunks")).collect()) == ["a_0", "a_1", "c_0"]
    sinks.write_json(chunks, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    name = "parity_chunks"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert sinks.create_table(chunks, name, str(tmp_path / "table")) and files.table_exists(spark, name)
    chunks.write.insertInto(name)
    assert spark.table(name).count() == 2 and not sinks.create_table(chunks, name, str(tmp_path / "table"))
    assert spark.table(name).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_cells_are_pruned(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centres = search.fit_centres([v for _, v in rows], 6)
    sinks.write_cells(search.assign_cells(data, centres), str(tmp_path / "cells"), centres)
    query = rows[5][1]
    near = search.read_cells(spark, str(tmp_path / "cells"), query, 2)
    plan = near._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*cell", plan)
    assert near.select("cell").distinct().count() == 2 and search.top_k(near, query, 1, "vec_id").first().vec_id == 5
    assert search.stored_centres(spark, str(tmp_path / "cells"))[0][1] == pytest.approx(centres[0][1])


def test_sections_nest(spark):
    xml = "<r><content>c</content><section>a<section>b <i>i</i></section></section><section/></r>"
    assert one(spark, web.xml_text(F.col("h")), h=xml) == "a b i\n\nb i\n\nc"
    assert one(spark, web.xml_text(F.col("h")), h="<r><section>") == "" and one(spark, web.xml_text(F.col("h")), h=None) == ""


class _Place(web.Source):
    name, kind = "place", "advisory"

    def read(self, spark):
        return spark.createDataFrame([("a.pdf", "text")], "filename string, text string")


def test_sources_and_dispatch_by_kind(spark):
    row = web.gathered(spark, [_Place(), _Place()]).first()
    assert row.metadata["source"] == "place" and row.metadata["document_type"] == "advisory" and row.metadata["filename"] == "a.pdf"
    assert datetime.datetime.fromisoformat(row.metadata["scrape_date"]) and _Place().documents(spark, extra="e").first().metadata["extra"] == "e"
    with pytest.raises(TypeError):
        web.Source()
    names = spark.createDataFrame([("x.PDF",), ("y.xml",), ("z.txt",)], "filename string")
    got = web.by_kind(names, {".pdf": lambda d: d.withColumn("by", F.lit("p")), ".xml": lambda d: d})
    assert {tuple(r) for r in got.collect()} == {("x.PDF", "p"), ("y.xml", None)}


def test_clocks_maps_and_names(spark):
    ts = F.lit("2026-03-04 15:06:07.5").cast("timestamp")
    got = spark.range(1).select(text.iso_utc(ts), text.day(ts), text.clock(ts), text.now_utc()).first()
    assert got[:3] == ("2026-03-04T15:06:07.500000Z", "2026-03-04", "3:06:07 PM") and got[3].endswith("Z")
    a, b = F.create_map(F.lit("k"), F.lit("1"), F.lit("z"), F.lit("2")), F.create_map(F.lit("k"), F.lit("9"))
    assert spark.range(1).select(text.merged(a, b, "z")).first()[0] == {"k": "9"}
    assert spark.range(1).select(text.merged(a, F.lit(None).cast("map<string,string>"))).first()[0] == {"k": "1", "z": "2"}
    assert [one(spark, text.truthy(F.col("v")), v=v) for v in (" Yes", "on", "0", "false")] == [True, True, False, False]
    assert one(spark, text.basename(F.col("v")), v="a/b/c.pdf") == "c.pdf"
    assert one(spark, text.personal_names(F.col("v")), v="Ann Bell met Carl Dorn") == ["Ann Bell", "Carl Dorn"]


def test_lemmas_tags_and_splits(spark):
    got = one(spark, text.lemmas(F.col("v")), v="The Wings of bodies, churches boxes firemen glass analysis 4.1")
    assert got == ["wing", "body", "church", "box", "fireman", "glass", "analysis", "4.1"]
    tags = one(spark, text.pos_tags(F.col("v")), v="The pilot quickly landed Boeing 737, and it was famous.")
    assert [t.pos for t in tags] == ["DET", "NOUN", "ADV", "VERB", "PROPN", "NUM", "PUNCT", "CCONJ", "PRON", "AUX", "ADJ", "PUNCT"]
    words = ["the", "flight", "control", "system", "air", "traffic", "light"]
    assert one(spark, segment.split_by_dictionary(F.col("v"), words), v="FlightControlSystem airtrafficcontrolsystem short qqqqqqqqqqqqqqqqq") == "Flight Control System air traffic control system short " + " ".join("q" * 17)
    assert one(spark, segment.split_by_dictionary(F.col("v"), words), v=None) is None


def test_float32_bytes(spark):
    rows = [(1, [1.5, -2.25, None]), (2, []), (3, None)]
    got = {r.id: r for r in spark.createDataFrame(rows, "id long, v array<double>").select("id", vectors.pack(F.col("v")).alias("b"), vectors.unpack(vectors.pack(F.col("v"))).alias("u")).collect()}
    assert bytes(got[1].b[:8]) == np.array([1.5, -2.25], "<f4").tobytes() and got[1].u[:2] == [1.5, -2.25] and np.isnan(got[1].u[2])
    assert got[2].u == [] and got[3].b is None and got[3].u is None


def test_token_counter_and_cache(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), ["a few words", "", None, "é\n\n x" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.n for r in rows.select("id", seams.BpeCounter(path).column(F.col("t")).alias("n")).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    asked = []

    class Counted(seams.HashingEmbedder):
        def one(self, text):
            asked.append(text)
            return super().one(text)

    cached = seams.CachedEmbedder(Counted(4))
    assert cached.one("x") == cached.one("x") and asked == ["x"]
    assert rows.select(seams.CachedEmbedder(seams.HashingEmbedder(4)).column(F.col("t")).alias("v")).first().v == seams.HashingEmbedder(4).one("a few words")
    letters = seams.LetterEmbedder()
    assert rows.select(letters.column(F.col("t")).alias("v")).first().v == pytest.approx(letters.one("a few words"))


def test_waits_grow_and_rate_limits_wait_longer():
    waits, calls = [], []

    def busy():
        calls.append(1)
        raise seams.RateLimited if len(calls) == 1 else ValueError

    with pytest.raises(ValueError):
        seams.retried(busy, 3, sleep=waits.append, jitter=lambda a, b: 3)()
    assert waits == [13, 4.0]


def test_annotators_and_persons_in_preparation(spark):
    seams.register_annotator("persons", lambda texts: [[("Zoe", "PERSON")] if t and "Zoe" in t else [] for t in texts])
    docs = spark.createDataFrame([("a", "Zoe flew with Ann Bell."), ("b", "Ann Bell flew planes.")], "filename string, text string")
    rows = {r.filename: r for r in ingest.prepare(docs, annotator="persons").collect()}
    assert rows["a"].personal_names == ["Zoe"] and rows["b"].personal_names == ["Ann Bell"]
    assert "plane" in rows["b"].tokens and [t.pos for t in rows["b"].pos_tags][:2] == ["PROPN", "PROPN"]


def test_embedding_goes_on_where_it_was_broken_off(spark, tmp_path):
    chunks = spark.createDataFrame([(f"f{k % 7}", f"c{k}", f"text {k}") for k in range(40)], "filename string, chunk_id string, text string")
    embedder, path = seams.LetterEmbedder(), str(tmp_path / "vectors")
    assert ingest.embed_in_parts(chunks.where("filename < 'f3'"), path, embedder, parts=3) >= 1
    assert ingest.embed_in_parts(chunks, path, embedder, parts=3) >= 1 and ingest.embed_in_parts(chunks, path, embedder, parts=3) == 0
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == sorted(f"c{k}" for k in range(40))


def test_passages_need_terms_and_whole_bonus_words(spark):
    docs = spark.createDataFrame([("d", "one measurand list here " + "x " * 700 + "measurands elsewhere")], "filename string, text string")
    assert search.rank_passages(docs, "filename", "text", "what is the of?").count() == 0
    scores = lambda q: [r.score for r in search.rank_passages(docs, "filename", "text", q).orderBy("rank").collect()]
    assert max(scores("measurand")) == 1.5 and max(scores("measurands")) == 0.5
    assert "Exchange" not in search.rank_passages(docs, "filename", "text", "measurand")._jdf.queryExecution().toString()


def test_strict_falls_back_to_chunks_and_then_to_hits(spark):
    docs = spark.createDataFrame([("t.pdf", ""), ("o.pdf", "other")], "filename string, text string")
    chunks = spark.createDataFrame([("t.pdf", "t_0", "wing lift", [1.0, 0.0]), ("t.pdf", "t_1", "drag", [0.9, 0.1]), ("o.pdf", "o_0", "wing", [1.0, 0.0])], "filename string, chunk_id string, text string, embedding array<double>")
    ids = lambda rows: [r.chunk_id for r in rows.orderBy("position").collect()]
    assert ids(engine.retrieve_strict(docs, chunks, "wing", "t.pdf", seams.QuarterCounter())) == ["t_0", "t_1"]
    plain, vectors_apart = chunks.drop("embedding"), chunks.select("chunk_id", "embedding")
    assert ids(engine.retrieve_strict(docs, plain, "wing", "t.pdf", seams.QuarterCounter(), query_vector=[0.0, 1.0], vectors=vectors_apart)) == ["t_0", "t_1"]
    assert ids(engine.retrieve(plain, "how wings lift", [1.0, 0.0], seams.QuarterCounter(), vectors=vectors_apart))[0] in {"o_0", "t_0"}


def test_weighted_and_checked_answers(spark):
    chunks = spark.createDataFrame([("a", "a_0", "Wings lift planes.", [1.0, 0.0]), ("b", "b_0", "Wings lift planes.", [0.9, 0.1]), ("c", "c_0", "Engines burn kerosene.", [0.5, 0.5]), ("d", "d_0", "No.", [-1.0, 0.0])], "filename string, chunk_id string, text string, embedding array<double>")
    row = engine.checked_answer(chunks, "what lifts", [1.0, 0.0], seams.ExtractiveGenerator(1), k=3).first()
    assert row.context == "Wings lift planes.\nEngines burn kerosene." and row.answer == "Wings lift planes." and row.check.accurate and row.follow_ups
    scores = search.scored(chunks, [1.0, 0.0]).select("chunk_id", "similarity")
    got = {r.chunk_id: r.weight for r in engine.weighted_context(scores, chunks, "chunk_id").collect()}
    assert set(got) == {"a_0", "b_0", "c_0"} and sum(got.values()) == pytest.approx(1.0)
    assert [r.filename for r in search.named_like(chunks, "A").collect()] == ["a"] and search.named_like(chunks, None).count() == 4
    assert search.joined_texts(chunks, [F.col("chunk_id").desc()], 2).first().context == "No. Engines burn kerosene."


def test_store_and_dispatch(spark):
    history = spark.createDataFrame([("s", None, "q", "a")], "session_id string, ts timestamp, user_query string, ai_response string")
    titles = spark.createDataFrame([("s", "old")], "session_id string, title string")
    index = spark.createDataFrame([("s", "2026-01-01", "2026-01-01", True)], "session_id string, created_at string, updated_at string, pinned boolean")
    made = engine.Engine(history, history)
    h, t, i = made.store_exchange(history, titles, index, "s", "why " * 40, "a long enough answer", "2026-02-02")
    assert h.count() == 2 and t.first().title == ("why " * 40).strip()[:80].strip() and tuple(i.first()) == ("s", "2026-01-01", "2026-02-02", True)
    assert made.dispatch("ping") == {"ok": True} and made.dispatch("history", table=h, session_id="s", limit=1).count() == 1
    with pytest.raises(ValueError):
        made.dispatch("nothing")
    raw = spark.createDataFrame([("x", "T", "2026-01-02", "yes"), (None, "no id", "", "")], "sessionId string, title string, updatedAt string, pinned string")
    assert [tuple(r) for r in sessions.parse_sessions(raw, "now").collect()] == [("x", "T", "2026-01-02", "2026-01-02", True)]


def test_sample_schema_and_gaps(spark):
    rows = spark.createDataFrame([(k, 1) for k in range(500)], "id long, x int")
    a, b = ({r.id for r in analytics.sampled(rows, "id", 100, s).collect()} for s in (1, 2))
    assert len(a) == len(b) == 100 and 5 < len(a & b) < 45
    assert consistency.same_columns(rows, rows.select("x", "id")) and not consistency.same_columns(rows, rows.select("x"))
    base = datetime.datetime(2026, 1, 1)
    events = spark.createDataFrame([(1, k, base + datetime.timedelta(minutes=m)) for k, m in enumerate((0, 10, 50, 60))], "user_id long, event_id long, ts timestamp")
    assert [r.session_no for r in incremental.sessions_by_gap(events).orderBy("event_id").collect()] == [1, 1, 2, 2]


def test_lsh_recall(spark):
    """Nearest by random projections against brute force over the small table."""
    from lodestone.plans import catalogue, search_queries

    sf = "/root/testdata/sf0.01"
    got = {r.vec_id for r in catalogue.queries()["lsh_search"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    query = np.array(search_queries._query_vector(spark, sf))
    best = {rows[k].vec_id for k in np.argsort(((v - query) ** 2).sum(1), kind="stable")[:5]}
    assert len(got & best) >= 4


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    sf = "/root/testdata/sf0.001"
    assert cli.main(["list"]) == 0 and "ask_normal" in capsys.readouterr().out
    assert cli.main(["ask", sf, "how wings lift"]) == 0 and "[doc_" in capsys.readouterr().out
    assert cli.main(["history", sf, "3", "2"]) == 0 and capsys.readouterr().out.startswith("> ")
    assert cli.main(["pipeline", sf, str(tmp_path), "--step", "prepare", "--verbose"]) == 0
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 200 and "prepare: done" in capsys.readouterr().out
    assert cli.main(["pipeline", sf, str(tmp_path), "--step", "none"]) == 2 and cli.main(["what"]) == 2
