"""Operators that need rows of their own: rules, packing, chunking, sessions, files, streams, seams."""

import io
import unicodedata
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import seams
from lodestone.engine import Engine
from lodestone.functions import intent, text, vectors
from lodestone.operators import analytics, chunking, consistency, packing, search, sessions
from lodestone.plans import catalogue, ingest
from lodestone.sources import files, sinks, web
from lodestone.streaming import incremental


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'array<double>' if isinstance(v, list) else 'double'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name,kind",
    [("2025_Accident_Report_X.pdf", "accident_report"), ("Regulation_1.docx", "regulation"), ("Advisory_Circular_2.pdf", "advisory"), ("SARP_3.pdf", "standard"), ("Guide_a.pdf", "guide"), ("Report_b.pdf", "report"), ("Paper_c.docx", "reference"), ("x.PDF", "reference"), ("x.docx", "other"), (None, "other")],
)
def test_source_kinds(spark, name, kind):
    assert one(spark, intent.source_kind(F.col("f")), f=name) == kind


@pytest.mark.parametrize("query,want", [("NTSB findings", "accident"), ("part 25 rules", "regulatory"), ("apart from", "regulatory"), ("how wings lift", "neither"), ("crash under FAA order", "accident")])
def test_intents(spark, query, want):
    assert one(spark, intent.intent(F.col("q")), q=query) == want


def test_query_terms_and_phrases(spark):
    q = 'What is the "flight deck" and " cabin " pressure of pressure?'
    assert one(spark, text.quoted_phrases(F.col("q")), q=q) == ["flight deck", "cabin"]
    assert one(spark, text.query_terms(F.col("q")), q=q) == ["pressure"]


def test_section_references(spark):
    t = "See 4.1.2 and § 5.1, Level 1, Part 121 or 7."
    assert one(spark, text.section_references(F.col("t")), t=t) == ["4.1.2", "5.1", "Level 1", "Part 121", "§ 5.1"]
    assert one(spark, text.section_references(F.col("t")), t="none") == ["No References Found"]


def test_text_helpers(spark):
    assert one(spark, text.normalize_output(F.col("t")), t="  “a” – ‘b’ \t c�s ") == "\"a\" - 'b' c's"
    assert one(spark, text.normalize_output(F.col("t")), t=None) == ""
    assert one(spark, text.nfkc(F.col("t")), t="ﬁ②") == "fi2"
    assert one(spark, text.last_segments(F.col("t")), t="a\n\nb\n\nc\n\nd") == "b\n\nc\n\nd"
    assert one(spark, text.last_segments(F.col("t")), t="a\n\nb") == "a\n\nb"
    assert one(spark, text.split_connected(F.col("t")), t="ThisIsAVeryLongWord12 short") == "This Is A Very Long Word 12 short"
    assert one(spark, text.drop_nonsense(F.col("t")), t="737 A320 see 4.1 règle wing") == "A320 4.1 wing"
    assert one(spark, text.metadata_field(F.col("t"), "Title"), t="x\nTitle:  A b \nAuthor: c") == "A b"
    assert one(spark, text.stem(F.col("t")), t="a.b.pdf") == "a" or one(spark, text.stem(F.col("t")), t="a.pdf") == "a"
    context = "[SOURCE filename=a; chunk_id=1]\nx\n[SOURCE filename=b; chunk_id=2]\ny\n[SOURCE filename=a; chunk_id=1]\nz"
    assert [tuple(c) for c in one(spark, text.citations(F.col("t")), t=context)] == [("a", "1"), ("b", "2")]
    assert one(spark, text.first_json_object(F.col("t"), "a int"), t='noise {"a": 3}').a == 3
    assert text.clamped(None, 1, 50, 5) == 5 and text.clamped(99, 1, 50, 5) == 50


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, vectors.cosine(a, b), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0
    assert one(spark, vectors.same_within(a, b), a=[1.0, 2.0], b=[1.0, 2.0 + 1e-7])
    assert not one(spark, vectors.same_within(a, b), a=[1.0, 2.0], b=[1.0, 2.1])
    assert not one(spark, vectors.same_within(a, b), a=[1.0, 2.0], b=[1.0])
    assert one(spark, vectors.unit(a), a=[3.0, 4.0]) == [0.6, 0.8]


def _pack(rows, most, per_file):
    kept, seen, files_, total = [], set(), {}, 0
    for rank, chunk, name, sig, cost in rows:
        if sig in seen or (per_file is not None and files_.get(name, 0) >= per_file):
            continue
        if total + cost > most:
            break
        kept.append(chunk)
        seen.add(sig)
        files_[name] = files_.get(name, 0) + 1
        total += cost
    return kept


@pytest.mark.parametrize("most,per_file", [(100, 2), (35, 4), (1000, None), (5, 4)])
def test_packing_equals_loop(spark, most, per_file):
    rows = [(k + 1, f"c{k}", f"f{k % 3}", f"s{k % 7}", 10 + (k * 7) % 13) for k in range(20)] + [(21, "big", "f9", "sx", 500), (22, "small", "f8", "sy", 1)]
    frame = spark.createDataFrame(rows, "rank int, chunk_id string, filename string, signature string, tokens long").withColumn("query_id", F.lit(1))
    got = [r.chunk_id for r in packing.pack(frame, most_tokens=most, per_file=per_file).orderBy("position").collect()]
    assert got == _pack(rows, most, per_file)


def test_greedy_chunks_equal_loop(spark):
    docs = [(1, "word " * 1300), (2, "x" * 4000 + " y z"), (3, ""), (4, None), (5, "abcd " * 500)]
    got = chunking.chunk_words(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 500).orderBy("doc_id", "chunk_no").collect()
    for i, t in docs:
        words, chunks, cur, total = (t or "").split(), [], [], 0
        for w in words:
            c = -(-len(w) // 4)
            if total + c > 500:
                chunks.append(" ".join(cur))
                cur, total = [], 0
            cur.append(w)
            total += c
        chunks += [" ".join(cur)] if cur else []
        assert [r.text for r in got if r.doc_id == i] == chunks


def test_sentence_chunks_overlap_by_words(spark):
    t = " ".join(f"s{k} " + "w " * 9 + f"e{k}." for k in range(40))
    got = chunking.chunk_sentences(spark.createDataFrame([(1, t)], "doc_id long, text string"), "doc_id", "text", most=100, overlap=10).orderBy("chunk_no").collect()
    assert all(r.tokens <= 110 for r in got)
    for a, b in zip(got, got[1:]):
        assert b.text.split()[:10] == a.text.split()[-10:]


def test_passages_take_paragraphs_when_many(spark):
    t = "\n\n".join(["p" * 100] * 20)
    assert one(spark, F.size(chunking.passages(F.col("t"))), t=t) == 20
    assert one(spark, F.size(chunking.passages(F.col("t"))), t="") == 0
    assert one(spark, F.size(chunking.passages(F.col("t"))), t="x " * 1500) == 3


def test_sessions(spark):
    titles = spark.createDataFrame([("a", "First"), ("b", "  "), ("c", "Third")], "session_id string, title string")
    index = spark.createDataFrame([("b", "1", "", True), ("c", "", "5", False), ("dddddddddd", "", "", False)], "session_id string, created_at string, updated_at string, pinned boolean")
    got = {r.id: tuple(r)[1:] for r in sessions.merge_sessions(titles, index, "9").collect()}
    assert got == {"a": ("First", "9", "9", False), "b": ("Session b", "1", "1", True), "c": ("Third", "5", "5", False), "dddddddddd": ("Session dddddddd", "9", "9", False)}
    merged = sessions.merge_sessions(titles, index, "9")
    assert [r.id for r in sessions.list_sessions(merged).collect()] == ["b", "a", "dddddddddd", "c"]
    assert [r.id for r in sessions.list_sessions(merged, "THIRD").collect()] == ["c"]
    t, i = sessions.upsert_session(titles, index, "b", "7", pinned=None)
    assert t.where("session_id = 'b'").first().title.strip() == "" or t.where("session_id = 'b'").count() == 1
    assert tuple(i.where("session_id = 'b'").first()) == ("b", "1", "7", True)
    t, i = sessions.upsert_session(t, i, "n", "8", title=" New one ", pinned=True)
    assert t.where("session_id = 'n'").first().title == "New one" and tuple(i.where("session_id = 'n'").first()) == ("n", "8", "8", True)
    t, i = sessions.delete_session(t, i, "n")
    assert t.where("session_id = 'n'").count() == i.where("session_id = 'n'").count() == 0
    with pytest.raises(ValueError):
        sessions.upsert_session(titles, index, " ", "1")
    row = sessions.exchange_row(titles, "s", "q\r\nq", "short", "2026-01-01 00:00:00").first()
    assert row.user_query == "q q" and row.ai_response == sessions.SHORT_ANSWER


def test_consistency_and_upsert(spark):
    local = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [1.0]), (4, [1.0])], "id long, embedding array<double>")
    stored = spark.createDataFrame([(1, [1.0]), (2, [1.1]), (4, [1.0, 2.0])], "id long, embedding array<double>")
    assert {r.id: r.status for r in consistency.compare(local, stored, "id").collect()} == {1: "match", 2: "mismatch", 3: "missing", 4: "mismatch"}
    now = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v long, x string")
    change = spark.createDataFrame([(1, 1, "c"), (3, 1, "d")], "k long, v long, x string")
    assert sorted(tuple(r) for r in consistency.upsert(now, change, "k", "v").collect()) == [(1, 1, "c"), (2, 1, "b"), (3, 1, "d")]


def _docx(path, paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    path.write_bytes(buffer.getvalue())


def test_files(spark, tmp_path):
    _docx(tmp_path / "a.docx", ["Title: T", "Body text"])
    (tmp_path / "b.pdf").write_bytes(b"%PDF BT (Hello) Tj (World) Tj ET")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("no")
    known = spark.createDataFrame([("gone.pdf",)], "filename string")
    got = {r.filename: r.text for r in files.best(files.extract(files.scan(spark, str(tmp_path), known))).collect()}
    assert got == {"a.docx": "Title: T\nBody text", "b.pdf": "Hello\nWorld", "broken.docx": ""}
    (tmp_path / "abbr.csv").write_text("a, alpha\nb\na, again\n")
    assert {tuple(r) for r in files.abbreviations(spark, str(tmp_path / "abbr.csv")).collect()} == {("a", "again")}
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.json").write_text('[{"id": "x", "n": 1}]')
    (tmp_path / "j/2.json").write_text("not json")
    assert [tuple(r) for r in files.json_records(spark, str(tmp_path / "j/*.json"), "id string, n int").collect()] == [("x", 1)]
    assert files.json_records(spark, str(tmp_path / "none/*.json"), "id string").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "f", 3, "t" * 150, [1, 2])], "chunk_id string, filename string, tokens int, text string, a array<int>")
    assert sinks.report(rows).first().preview == "t" * 100 + "..."
    sinks.write_report(sinks.flat_for_csv(rows), str(tmp_path / "r"))
    sinks.append_new(rows, None, "chunk_id", str(tmp_path / "c"))
    known = spark.read.parquet(str(tmp_path / "c"))
    sinks.append_new(rows, known, "chunk_id", str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "c2")).count() == 0


def test_markup(spark):
    html = "<html><script>x</script><!-- c --><h1>A &amp; B</h1><p>one  two</p><a href='q'></a></html>"
    assert one(spark, web.html_text(F.col("h")), h=html) == "A & B\none\ntwo"
    xml = "<r><content>c1</content><section>a <b>b</b>\n c</section><section> </section></r>"
    assert one(spark, web.xml_text(F.col("h")), h=xml) == "a b c\n\nc1"
    assert one(spark, web.document_id(F.col("h")), h="see AC 20-115 now") == "AC 20-115"
    pages = spark.createDataFrame([(1, "http://h/x", '<a href="/a.pdf">A</a><a href="http://z/b.xml">B</a>')], "id long, url string, html string")
    assert [tuple(r) for r in web.links(pages, "id", ending=".pdf").collect()] == [(1, 0, "/a.pdf", "http://h/a.pdf", "a.pdf")]


def test_rule_entities_reject_overlaps():
    assert seams.rule_entities(["B-737 from JFK on AA 100 by Lufthansa under FAA"])[0] == [("B-737", "AIRCRAFT_MODEL"), ("JFK", "AIRPORT_CODE"), ("FAA", "AIRPORT_CODE"), ("AA 100", "FLIGHT_NUMBER"), ("Lufthansa", "AIRLINE")]


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        seams.retried(fails, 3, 2.0, waits.append)()
    assert waits == [2.0, 4.0] and len(calls) == 3


def _limiter(rows, limit, seconds):
    out, buckets = [], {}
    for ts, failed in rows:
        count, reset = buckets.get("k", (0, None))
        if reset is not None and ts >= reset:
            count, reset = 0, None
        blocked = count >= limit
        if not blocked:
            count, reset = (count + 1, reset or ts + pd.Timedelta(seconds=seconds)) if failed else (0, None)
        buckets["k"] = (count, reset)
        out.append((count, blocked))
    return out


def test_login_limiter_batch_and_stream(spark, tmp_path):
    base = pd.Timestamp("2026-01-01")
    plan = [(0, True), (10, True), (20, True), (30, False), (70, True), (80, False), (90, True), (95, True), (99, True), (300, True)]
    rows = [(1, k, (base + pd.Timedelta(seconds=s)).to_pydatetime(), f) for k, (s, f) in enumerate(plan)]
    frame = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, failed boolean")
    want = _limiter([(base + pd.Timedelta(seconds=s), f) for s, f in plan], 3, 60)
    got = incremental.login_limits(frame, limit=3, seconds=60).orderBy("event_id").collect()
    assert [(r.n, r.blocked) for r in got] == want
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.login_limits_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 3, 60)
    query = stream.writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r.blocked) for r in spark.sql("SELECT * FROM limits ORDER BY ts").collect()] == want


def test_incremental_ingest_takes_new_keys_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = lambda a, b: spark.createDataFrame([(k, f"v{k}") for k in range(a, b)], "id long, v string")
    rows(0, 10).write.parquet(src)
    incremental.ingest(spark, src, "id long, v string", out, cp, "id")
    rows(5, 15).write.mode("append").parquet(src)
    incremental.ingest(spark, src, "id long, v string", out, cp, "id")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))


def test_engine_answers_with_citations(spark):
    docs = spark.createDataFrame([("Guide_wing.docx", "Wings lift. Air flows over the wing."), ("Accident_Report_x.pdf", "Wings failed in the accident."), ("Memo.docx", "Nothing here.")], "filename string, text string")
    embed = seams.HashingEmbedder()
    chunks = docs.withColumn("chunk_id", F.concat("filename", F.lit("_0"))).withColumn("embedding", embed.column(F.col("text")))
    engine = Engine(docs, chunks)
    row = engine.ask("how wings lift air").first()
    assert not row.strict_mode and row.target_filename is None
    assert {c.filename for c in row.citations} == {"Guide_wing.docx", "Memo.docx"} and row.answer.startswith("Wings lift.")
    strict = engine.ask('What does "guide wing" say about air flows?').first()
    assert strict.strict_mode and strict.target_filename == "Guide_wing.docx" and {c.filename for c in strict.citations} == {"Guide_wing.docx"}
    with pytest.raises(ValueError):
        engine.ask(" ")


def test_lexical_score_counts_phrases(spark):
    assert one(spark, search.lexical_score(F.col("t"), F.lit('pressure of "flight deck"')), t="The Flight-Deck pressure") == 5


def test_prepare_chunk_and_embed(spark):
    docs = spark.createDataFrame([("a.pdf", "Title: Wing report\nth flight crew saw Part 121 and JFK aircraft"), (None, "x"), ("b.pdf", None)], "filename string, text string")
    rows = {r.filename: r for r in ingest.prepare(docs).collect()}
    assert set(rows) == {"a.pdf", "b.pdf"}
    a = rows["a.pdf"]
    assert a.metadata.title == "Wing report" and a.section_references == ["Part 121"] and a.category == "operations"
    assert [(e.text, e.label) for e in a.entities] == [("JFK", "AIRPORT_CODE"), ("Part 121", "SECTION_REF")]
    chunks = ingest.chunk(ingest.prepare(docs), docs.where("filename = 'b.pdf'"))
    assert [r.chunk_id for r in chunks.collect()] == ["a.pdf_0"]
    made = ingest.embed_new(chunks.union(chunks), chunks.limit(0), seams.HashingEmbedder(8))
    assert [len(r.embedding) for r in made.collect()] == [8]


def test_steps_retry_and_go_on(spark):
    calls = {"bad": 0, "good": 0}

    def bad():
        calls["bad"] += 1
        raise ValueError("no")

    def good():
        calls["good"] += 1

    report = ingest.run_steps([("bad", bad), ("good", good)], sleep=lambda s: None)
    assert [(n, d) for n, d, _, _ in report] == [("bad", False), ("good", True)] and calls == {"bad": 3, "good": 1}
    assert [r[0] for r in ingest.run_steps([("bad", bad), ("good", good)], only="good")] == ["good"]
    rows, watch = ingest.observed(spark.range(5), "seen", most=F.max("id"))
    rows.collect()
    assert watch.get == {"rows": 5, "most": 4}


def test_nfkc_text_returns_every_document(spark, tmp_path):
    rows = [(1, "plain"), (2, "ﬁn ② ｆｕｌｌ"), (3, "e\u0301"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in catalogue.queries()["nfkc_text"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in rows}


def test_cell_search_recall(spark):
    """Mean recall of 0.9 against brute force over many queries, the query's own row left out."""
    from lodestone.plans import search_queries

    sf = "/root/testdata/sf0.1"
    sample = search_queries._sample(spark, sf, 64)
    centres = search.fit_centres(sample, search_queries.CELLS)
    probes = search.probes_for(sample, centres, 5, search_queries.RECALL)
    rows = search.assign_cells(spark.read.parquet(f"{sf}/embeddings.parquet"), centres).select("vec_id", "embedding", "cell").orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cell, found = np.array([r.cell for r in rows]), []
    for q in range(0, len(v), 5):
        best = [x for x in np.argsort(-(v @ v[q]), kind="stable")[:6] if x != q][:5]
        found.append(np.isin(cell[best], search.nearest_cells(v[q].tolist(), centres, probes)).mean())
    print("recall", np.mean(found), "probes", probes, "queries", len(found))
    assert len(found) >= 300 and np.mean(found) >= 0.9 and probes < len(centres)


def test_embed_new_chunk_vectors_are_those_of_the_whole_texts(spark, tmp_path):
    rows = [(1, "a b a"), (2, "wing " * 5000 + "last"), (3, ""), (4, None), (5, "has one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.chunk_id: r.embedding for r in catalogue.queries()["embed_new_chunk_vectors"](spark, str(tmp_path)).collect()}
    assert got == {i: seams.HashingEmbedder().one(t) for i, t in rows[:4]}


def test_expansion_fact_check_and_follow_ups(spark):
    assert seams.expand_query("Does ATC clear IFR, ATC?", {"atc": "air traffic control", "IFR": "instrument flight rules"}) == "Does ATC clear IFR, ATC? air traffic control instrument flight rules"
    assert seams.expand_query("nothing here", {"atc": "x"}) == "nothing here"
    got = one(spark, seams.fact_check(F.col("a"), F.col("c")), a="The wing stalled early. Bananas grow quickly.", c="[SOURCE filename=bananas grow quickly; chunk_id=1]\nThe left wing stalled early.")
    assert (got.supported, got.unsupported, got.accurate) == (["The wing stalled early."], ["Bananas grow quickly."], False)
    assert one(spark, seams.follow_ups("why did the engine fail", F.col("a"), 2), a="The engine failed after lubrication ceased and bearings seized.") == ["What else is known about failed?", "What else is known about lubrication?"]


def test_delete_history_returns_the_prior_count(spark):
    history = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "session_id string, user_query string")
    rest, gone = sessions.delete_history(history, " a ")
    assert gone == 2 and sorted(r.user_query for r in rest.collect()) == ["3", "4"]


def test_sentiment_shares(spark):
    docs = spark.createDataFrame([(1, "good bad plane plane"), (2, ""), (3, "plane")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "word string, valence double")
    got = {r.doc_id: tuple(r)[1:] for r in analytics.sentiment_shares(docs, "doc_id", lexicon).collect()}
    assert got == {1: (0.428571, 0.285714, 0.285714, 0.125), 2: (0.0, 0.0, 0.0, 0.0), 3: (0.0, 0.0, 1.0, 0.0)}
