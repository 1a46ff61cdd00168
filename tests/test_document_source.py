"""The data source of documents: what is listed, what is read, and a stream that is broken off."""

import os

import pytest

from lodestone.plans import ingest
from lodestone.seams import LetterEmbedder
from lodestone.sources import document_source

EXTRACT = {"txt": [("plain", lambda content: content.decode())]}


def _put(folder, name, text, time):
    (folder / name).write_text(text)
    os.utime(folder / name, (time, time))


def test_batch_reads_what_is_not_known(spark, tmp_path):
    document_source.register(spark)
    docs = tmp_path / "docs"
    (docs / "deep").mkdir(parents=True)
    for k, name in enumerate(["a.pdf", "deep/b.DOCX", "c.txt", "d.pdf", "none"]):
        _put(docs, name, f"text {k}", 1000 + k)
    spark.createDataFrame([("a.pdf",), ("zz.pdf",)], "filename string").write.parquet(f"{tmp_path}/known")
    read = spark.read.format("lodestone_documents").option("path", str(docs))
    assert sorted((r.filename, r.kind, r.size, bytes(r.content)) for r in read.load().collect()) == [("a.pdf", "pdf", 6, b"text 0"), ("b.DOCX", "docx", 6, b"text 1"), ("d.pdf", "pdf", 6, b"text 3")]
    (docs / "a.pdf").chmod(0)  # a known file's content is not asked for
    assert sorted(r.filename for r in read.option("known", f"{tmp_path}/known").load().collect()) == ["b.DOCX", "d.pdf"]
    assert spark.read.format("lodestone_documents").option("path", f"{tmp_path}/nowhere").load().count() == 0


def test_partitions_follow_sizes(monkeypatch):
    monkeypatch.setattr(document_source, "PARTITION_BYTES", 100)
    files = [document_source.Found(k, f"f{k}", size) for k, size in enumerate([50, 50, 300, 10, 10])]
    assert [[f.size for f in p.files] for p in document_source._dealt(files)] == [[50, 50], [300], [10, 10]]


def test_stream_resumes_with_no_id_twice(spark, tmp_path):
    docs, target, checkpoint = tmp_path / "docs", f"{tmp_path}/out", f"{tmp_path}/state"
    docs.mkdir()
    for k in range(4):
        _put(docs, f"f{k}.txt", f"first words of file number {k} here " * 40, 1000 + k)
    asked = []

    class Breaks(LetterEmbedder):
        def column(self, text):
            asked.append(1)
            if len(asked) == 2:
                raise RuntimeError("broken off")
            return super().column(text)

    run = lambda embedder: ingest.embed_stream(spark, str(docs), target, checkpoint, embedder, most=50, files_per_batch=2, extractors=EXTRACT, kinds="txt")
    with pytest.raises(Exception, match="broken off"):
        run(Breaks())
    assert ingest.embedded(spark, target).select("filename").distinct().count() == 2
    run(LetterEmbedder())
    rows = ingest.embedded(spark, target).collect()
    assert len({r.filename for r in rows}) == 4 and len({r.chunk_id for r in rows}) == len(rows) > 8
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in rows)
    before = sorted(os.listdir(target))
    (docs / "f0.txt").chmod(0)
    run(LetterEmbedder())  # nothing new: nothing read, nothing written
    assert sorted(os.listdir(target)) == before
    _put(docs, "f9.txt", "one more", 2000)
    run(LetterEmbedder())
    more = ingest.embedded(spark, target)
    assert more.count() == len(rows) + 1 and more.where("filename = 'f9.txt'").first().text == "one more"
