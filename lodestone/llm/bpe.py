"""BPE encoding and decoding through a distinct-word table.

A text splits at ASCII white space, which the tokenizer's pre-tokenizer drops
and never crosses, so a text's ids are its words' ids in order. The plan:

1. split every text in Spark tasks; documents are gathered into chunks, each
   with its own list of distinct words and the documents as positions in it;
   written once to the shared folder;
2. deal the chunks' distinct words to buckets by hash; a bucket holds every
   occurrence of a word in any chunk's list, so each distinct word of the
   corpus is encoded once; its ids go back to the chunks that asked;
3. join ids back by position within each chunk; decode by joining the ids to
   the table of pieces by id, which the tokenizer file gives every worker.

No row per word occurrence is ever shuffled. A frequent word costs one list
entry per chunk, so there is no hot key. The only thing sent to every executor
is the tokenizer file, whose size is fixed by its vocabulary.

Defined results: a null text counts as empty; an empty text has 0 tokens, an
empty id list and an empty decoded text; null ids stay null; repeated rows give
repeated rows; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bucketed, buckets, give_back

#: Characters of text, and distinct words, that close a chunk after the document that reaches them.
CHUNK_CHARS = 8_000_000
CHUNK_WORDS = 300_000

_PACKED = "chunk long, bucket int, doc_ids array<long>, sizes binary, places binary, order binary, words binary"
_REPLY = "chunk long, bucket int, lens binary, ids binary"


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; the first byte tells the width."""
    width = 2 if not len(values) or int(values.max()) < 1 << 16 else 4
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _expand(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.uint32)


def _pack(packed_buckets: int, chunk_chars: int):
    """Documents to chunks: a row with positions, and a row per bucket of its distinct words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, chars = TaskContext.get().partitionId(), 0, 0
        doc_ids, places = [], []
        index: dict[bytes, int] = defaultdict(count().__next__)

        def chunk() -> pa.RecordBatch:
            words = list(index)
            at = np.fromiter((zlib.crc32(w) % packed_buckets for w in words), np.int64, len(words))
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.uint32)
            order = order[np.argsort(at[order], kind="stable")]
            ends = np.searchsorted(at[order], np.arange(packed_buckets + 1))
            sizes = np.array([len(p) for p in places], np.uint32)
            out = [((task << 32) | made, -1, doc_ids, _squeeze(sizes), _squeeze(np.concatenate(places)), _squeeze(order), None)]
            for b in np.flatnonzero(np.diff(ends)):
                out.append(((task << 32) | made, int(b), None, None, None, None, zstandard.compress(b"\n".join([words[k] for k in order[ends[b] : ends[b + 1]]]), 3)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PACKED_ARROW)], schema=_PACKED_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8").split()
                doc_ids.append(doc_id)
                places.append(np.array([index[w] for w in words], np.uint32))
                chars += sum(map(len, words))
                if chars >= chunk_chars or len(index) >= CHUNK_WORDS:
                    yield chunk()
                    made, chars, doc_ids, places = made + 1, 0, [], []
                    index = defaultdict(count().__next__)
        if doc_ids:
            yield chunk()
        doc_ids, places, index = [], [], {}
        give_back()

    return rows


_TOKENIZERS: dict[int, object] = {}


def _tokenizer(spec: str):
    """The tokenizer of a file's content, built once per Python worker."""
    key = hash(spec)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        made.no_truncation()
        made.no_padding()
        _TOKENIZERS[key] = made
    return _TOKENIZERS[key]


def _encode_bucket(spec):
    """All chunks' words of one bucket, a batch at a time: each distinct word is encoded once, every chunk is answered.

    What is held is the bucket's distinct words and their ids, not what the chunks ask.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        index: dict[bytes, int] = defaultdict(count().__next__)
        lens, starts, ids = array("I"), array("q"), array("I")
        for asked in batches:
            places = [np.array([index[w] for w in zstandard.decompress(x.as_py()).split(b"\n")], np.uint32) for x in asked.column("words")]
            fresh = [w.decode("utf-8") for w in islice(index, len(lens), None)]
            for k in range(0, len(fresh), 4096):
                for x in tokenizer.encode_batch(fresh[k : k + 4096], add_special_tokens=False):
                    starts.append(len(ids))
                    lens.append(len(x.ids))
                    ids.extend(x.ids)
            n_of, start_of, flat = np.array(lens, np.uint32), np.array(starts, np.int64), np.array(ids, np.uint32)
            out_lens, out_ids = [], []
            for p in places:
                n = n_of[p]
                at = np.repeat(start_of[p] - np.concatenate([[0], np.cumsum(n, dtype=np.int64)[:-1]]), n) + np.arange(int(n.sum()))
                out_lens.append(_squeeze(n))
                out_ids.append(_squeeze(flat[at]))
            yield pa.RecordBatch.from_arrays([asked.column("chunk"), asked.column("bucket"), pa.array(out_lens, pa.binary()), pa.array(out_ids, pa.binary())], schema=_REPLY_ARROW)
        del index, lens, starts, ids
        give_back()

    return answer


def _assemble(spec, ids_as_text: bool, out_schema: pa.Schema):
    """One chunk and its words' ids: ids by position, pieces by id."""

    def answer(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(spec.value)
        replies = replies.sort_by("bucket")
        lens = np.concatenate([_expand(x) for x in replies.column("lens").to_pylist()] or [np.zeros(0, np.uint32)])
        flat = np.concatenate([_expand(x) for x in replies.column("ids").to_pylist()] or [np.zeros(0, np.uint32)])
        order = _expand(chunk.column("order")[0].as_py())
        names, pieces = _piece_table(tokenizer)
        numbers, parts = [names[i] for i in flat.tolist()], [pieces[i] for i in flat.tolist()]
        ends = np.cumsum(lens, dtype=np.int64).tolist()
        n_of, id_of, piece_of = np.zeros(len(order), np.int64), [""] * len(order), [""] * len(order)
        n_of[order] = lens
        start = 0
        for k, end in zip(order.tolist(), ends):
            id_of[k], piece_of[k] = " ".join(numbers[start:end]), " ".join(parts[start:end])
            start = end
        places = _expand(chunk.column("places")[0].as_py())
        stops = np.cumsum(_expand(chunk.column("sizes")[0].as_py()), dtype=np.int64).tolist()
        n_tokens, ids, decoded, start = [], [], [], 0
        silent = bool((lens == 0).any())
        for stop in stops:
            at = places[start:stop]
            start = stop
            n_tokens.append(int(n_of[at].sum()))
            if silent:
                at = at[n_of[at] > 0]
            at = at.tolist()
            text = " ".join([id_of[k] for k in at])
            ids.append(text if ids_as_text else [int(i) for i in text.split()])
            decoded.append(" ".join([piece_of[k] for k in at]))
        cols = [chunk.column("doc_ids").combine_chunks().flatten(), pa.array(n_tokens, pa.int64()), pa.array(ids, out_schema.field("ids").type), pa.array(decoded, pa.string())]
        return pa.table(cols, schema=out_schema)

    return answer


def _and_give_back(answer):
    def told(*tables: pa.Table) -> pa.Table:
        out = answer(*tables)
        give_back()
        return out

    # Spark tells by the number of arguments whether a function takes the group's key.
    return lambda a, b: told(a, b)


_PIECES: dict[int, tuple[list[str], list[str]]] = {}


def _piece_table(tokenizer) -> tuple[list[str], list[str]]:
    """By id, its decimal digits and its piece ('' for an id without one): the side that every chunk's ids join. Built once per Python worker."""
    if id(tokenizer) not in _PIECES:
        most = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1)
        _PIECES[id(tokenizer)] = [str(i) for i in range(most + 1)], [tokenizer.id_to_token(i) or "" for i in range(most + 1)]
    return _PIECES[id(tokenizer)]


_PACKED_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("places", pa.binary()), ("order", pa.binary()), ("words", pa.binary())])
_REPLY_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("lens", pa.binary()), ("ids", pa.binary())])


def encode(docs: DataFrame, tokenizer_path: str, ids_as_text: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document.

    ``ids`` is an int array, or with ``ids_as_text`` the decimal ids joined by
    one space. The tokenizer file must have no decoder of its own (pieces join
    by one space) and a pre-tokenizer that drops white space.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(buckets(spark), chunk_chars), _PACKED)
    packed = bucketed(packed, "chunk", "bpe_chunks")
    asked = packed.where("bucket >= 0").select("chunk", "bucket", "words")
    replies = asked.groupBy("bucket").applyInArrow(_encode_bucket(spec), _REPLY)
    chunks = packed.where("bucket < 0").select("chunk", "doc_ids", "sizes", "places", "order")
    kind = "string" if ids_as_text else "array<int>"
    out = f"doc_id long, n_tokens long, ids {kind}, decoded string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string() if ids_as_text else pa.list_(pa.int32())), ("decoded", pa.string())])
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_and_give_back(_assemble(spec, ids_as_text, arrow)), out)


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of the contract, from ``encode(..., ids_as_text=True)``."""
    return encoded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
