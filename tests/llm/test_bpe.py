"""BPE against the tokenizers library on whole texts."""

import hashlib

import public_tokenizers
import pytest

from lodestone.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", "   ", "The café  O'Neil's <|endoftext|>x 42", "\x1c   a　b\x85c", "É İ ΣΣ \x00 don't", "é ́x", "a" * 3000, "x\ty\nz\x0bq\x0cr\rs", None, "d e ﻿ ​ 🙂👍🏽", "<|startoftext|> <|endoftext|>"]


def _expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return ids, [t.decode(x, skip_special_tokens=False) for x in ids]


@pytest.mark.parametrize("chunk_chars", [1, 50, 4_000_000])
def test_matches_library_on_hard_texts(spark, chunk_chars):
    rows = [(k, x, "extra") for k, x in enumerate(HARD)] + [(1, "again", "e"), (1, "again", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((r.doc_id, r.ids, r.decoded, r.n_tokens) for r in bpe.encode(docs, PATH, chunk_chars=chunk_chars).collect())
    ids, decoded = _expected([r[1] for r in rows])
    assert got == sorted((r[0], i, d, len(i)) for r, i, d in zip(rows, ids, decoded))


def test_null_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two")], "doc_id long, text string")
    assert [r.doc_id for r in bpe.encode(docs, PATH).collect()] == [None]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_digests_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids, decoded = _expected([r.text for r in rows])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r.doc_id: (len(i), sha(" ".join(map(str, i))), sha(d)) for r, i, d in zip(rows, ids, decoded)}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(docs, PATH, ids_as_text=True)).collect()}
    assert got == want


def test_a_bucket_is_answered_batch_by_batch():
    """Words that come again in a later batch of the bucket have the ids of the first."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    with open(PATH, encoding="utf-8") as file:
        spec = type("Sent", (), {"value": file.read()})()
    lists = [["hello", "wörld"], ["wörld", "again"], ["hello"], ["x" * 50, "again", "hello"]]
    batches = [pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int64()), "bucket": pa.array([7], pa.int32()), "words": pa.array([zstandard.compress("\n".join(w).encode())], pa.binary())}) for k, w in enumerate(lists)]
    got = list(bpe._encode_bucket(spec)(iter(batches)))
    ids, _ = _expected([w for words in lists for w in words])
    told = [i for b in got for i in bpe._expand(b.column("ids")[0].as_py()).tolist()]
    lens = [n for b in got for n in bpe._expand(b.column("lens")[0].as_py()).tolist()]
    assert told == [i for x in ids for i in x] and lens == [len(x) for x in ids] and isinstance(lens, list) and np.sum(lens) == len(told)
