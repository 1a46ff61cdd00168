"""A written inverted index for lexical ranking: token to documents and places.

Postings are cut twice: by a hash of the token into buckets (folders), and by a
hash of the document into slices, so that a block, one token's documents of one
slice, is bounded however frequent the token is. Blocks hold document ids and
word places as packed ascending integers and lie in the order of tokens, so a question
reads the folders of its tokens and of those the pages that hold them. A small
dictionary has every token's number of documents and of places.

A question is answered rarest token first. What the phrases and the rarer tokens
give is a lower bound; as soon as the k-th best of it is more than all tokens left
could give together, no other document can enter, and the blocks of frequent tokens
are read only where a candidate's slice has one (``blocks_read`` tells).
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.codec import pack_ascending, unpack_ascending
from lodestone.functions.text import normalize_for_match, query_terms, quoted_phrases

#: Documents of a slice, and tokens of text of a bucket within a slice (about).
SLICE_DOCS, CELL_TOKENS = 65_536, 4_000_000
#: Occurrences that a task holds before it hands on what it has.
HELD = 2_000_000
#: Of a packed place: document in the upper, word in the lower bits.
WORD_BITS = 24

_RUN = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("tokens", pa.string()), ("sizes", pa.binary()), ("docs", pa.binary()), ("doc_at", pa.binary()), ("places", pa.binary())])
_BLOCK = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("token", pa.string()), ("n_docs", pa.int64()), ("n_places", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
_RUN_SQL = "bucket int, slice int, tokens string, sizes binary, docs binary, doc_at binary, places binary"
_BLOCK_SQL = "bucket int, slice int, token string, n_docs long, n_places long, docs binary, counts binary, places binary"


def _bucket(token: Column, n: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(n)).cast("int")


def _ends(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.append(np.flatnonzero(np.diff(ids, prepend=-1)), len(ids))


def _runs(n_buckets: int):
    """Of a task's documents, per bucket and slice, the occurrences of each token in order."""

    def run(docs: list[tuple[int, int, np.ndarray]], tokens: list[str]) -> pa.RecordBatch:
        docs.sort(key=lambda d: d[0])
        sizes = np.array([len(x) for _, _, x in docs])
        ids = np.concatenate([x for _, _, x in docs])
        doc = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
        place = np.arange(len(ids), dtype=np.uint32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.uint32), sizes)
        bucket, part = np.array([zlib.crc32(t.encode()) % n_buckets for t in tokens], np.int32), np.array([s for _, s, _ in docs], np.int32)
        order = np.lexsort((ids, part[doc], bucket[ids]))  # stable: documents and places stay ascending
        ids, doc, place = ids[order], doc[order], place[order]
        del order
        cell = (bucket[ids].astype(np.int64) << 32) + part[doc]
        keys, rows = np.array([d for d, _, _ in docs], np.int64), []
        cells = _ends(cell)
        for lo, hi in zip(cells, cells[1:]):
            at = _ends(ids[lo:hi])
            own, local = np.unique(doc[lo:hi], return_inverse=True)
            rows.append((int(cell[lo] >> 32), int(cell[lo] & 0xFFFFFFFF), " ".join([tokens[k] for k in ids[lo:hi][at[:-1]]]), np.diff(at).astype(np.uint32).tobytes(), keys[own].tobytes(), local.astype(np.uint32).tobytes(), place[lo:hi].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN)], schema=_RUN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = defaultdict(count().__next__)
        held, size = [], 0
        for batch in batches:
            for doc, part, norm in zip(*batch.columns):
                doc, part, norm = doc.as_py(), part.as_py(), norm.as_py()  # one text at a time
                held.append((doc, part, np.array([index[t] for t in norm.split(" ")], np.int32)))
                size += len(held[-1][2])
                if size >= HELD:
                    yield run(held, list(index))
                    index, held, size = defaultdict(count().__next__), [], 0
        if held:
            yield run(held, list(index))

    return rows


def _opened(docs: bytes, counts: bytes, places: bytes) -> list[tuple[int, list[int]]]:
    ids, ends = unpack_ascending(docs), unpack_ascending(counts)
    words = unpack_ascending(places) & ((1 << WORD_BITS) - 1)
    return list(zip(ids.tolist(), (x.tolist() for x in np.split(words, ends[:-1]))))


def _merge(runs: pa.Table) -> pa.Table:
    """The runs of one bucket and slice to blocks, by token."""
    index: dict[str, int] = defaultdict(count().__next__)
    ids, docs, places = [], [], []
    # Documents stand as their place among those of the slice, and everything an occurrence has in four bytes each.
    keys = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in runs.column("docs")]))
    for r in range(runs.num_rows):
        row = {c: runs.column(c)[r].as_py() for c in ("tokens", "sizes", "docs", "doc_at", "places")}
        ids.append(np.repeat(np.array([index[t] for t in row["tokens"].split(" ")], np.int32), np.frombuffer(row["sizes"], np.uint32)))
        docs.append(np.searchsorted(keys, np.frombuffer(row["docs"], np.int64)).astype(np.int32)[np.frombuffer(row["doc_at"], np.uint32)])
        places.append(np.frombuffer(row["places"], np.uint32))
    ids, docs, places = (np.concatenate(x) for x in (ids, docs, places))
    tokens = list(index)
    by_name = sorted(range(len(tokens)), key=tokens.__getitem__)
    rank = np.empty(len(tokens), np.int32)
    rank[by_name] = np.arange(len(tokens), dtype=np.int32)
    ids = rank[ids]
    order = np.lexsort((places, docs, ids))
    ids, docs, places = ids[order], docs[order], places[order]
    del index, order
    new = np.append(True, (np.diff(ids) != 0) | (np.diff(docs) != 0))  # a document of a token begins
    first = np.flatnonzero(new)  # places where it does
    token_at = _ends(ids)
    doc_at = np.searchsorted(first, token_at)  # documents before each token
    last = np.append(first[1:], len(ids))
    rows = []
    for k, (lo, hi, a, b) in enumerate(zip(token_at.tolist(), token_at[1:].tolist(), doc_at.tolist(), doc_at[1:].tolist())):
        packed = ((np.cumsum(new[lo:hi]) - 1) << WORD_BITS) + places[lo:hi]
        rows.append((tokens[by_name[k]], b - a, hi - lo, pack_ascending(keys[docs[first[a:b]]]), pack_ascending(last[a:b] - lo), pack_ascending(packed)))
    del ids, docs, places, new, first, last, tokens
    bucket, part = runs.column("bucket")[0].as_py(), runs.column("slice")[0].as_py()
    cols = [[bucket] * len(rows), [part] * len(rows), *zip(*rows)]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _BLOCK)], schema=_BLOCK)


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", slice_docs: int = SLICE_DOCS, cell_tokens: int = CELL_TOKENS) -> LexicalIndex:
    """Index ``docs`` (integer ``key``, unique; rows without one are left out) in a folder; a null text has no token."""
    spark = docs.sparkSession
    norm = normalize_for_match(F.coalesce(F.col(text), F.lit("")))
    size = docs.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).first()
    n_slices = max(1, -(-size.n // slice_docs))
    n_buckets = max(8, -(-(size.chars or 0) // (5 * cell_tokens * n_slices)))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n_slices)).cast("int").alias("slice"), norm.alias("norm")).where("norm <> ''")
    blocks = rows.mapInArrow(_runs(n_buckets), _RUN_SQL).groupBy("bucket", "slice").applyInArrow(_merge, _BLOCK_SQL)
    writer = blocks.write.partitionBy("bucket").option("parquet.page.size", 1 << 16).option("parquet.page.row.count.limit", 256)
    writer.mode("overwrite").parquet(f"{path}/postings")
    held = spark.read.schema(_BLOCK_SQL).parquet(f"{path}/postings")
    held.groupBy("token").agg(F.sum("n_docs").alias("df"), F.sum("n_places").alias("cf"), F.first("bucket").alias("bucket")).write.mode("overwrite").parquet(f"{path}/tokens")
    docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc")).write.mode("overwrite").parquet(f"{path}/docs")
    spark.createDataFrame([(json.dumps({"slices": n_slices, "buckets": n_buckets}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/shape")
    return LexicalIndex(spark, path)


def _docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a block."""
    for batch in batches:
        ids = [unpack_ascending(x.as_py()) for x in batch.column("docs")]
        tokens = pa.array(np.repeat(np.array(batch.column("token").to_pylist(), object), [len(x) for x in ids]).tolist(), pa.string())
        yield pa.RecordBatch.from_arrays([tokens, pa.array(np.concatenate(ids) if ids else [], pa.int64())], names=["token", "doc"])


def _places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each place of a token."""
    for batch in batches:
        out: list[tuple[str, int, int]] = []
        for token, *blob in zip(*(batch.column(c).to_pylist() for c in ("token", "docs", "counts", "places"))):
            out += [(token, doc, at) for doc, places in _opened(*blob) for at in places]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["token", "doc", "at"])


@dataclass
class LexicalIndex:
    """An index that ``write_index`` wrote."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        shape = json.loads(self.spark.read.text(f"{self.path}/shape").first()[0])
        self.slices, self.buckets = shape["slices"], shape["buckets"]
        self.tokens = self.spark.read.parquet(f"{self.path}/tokens")

    def blocks(self, tokens: list[str], slices: list[int] | None = None) -> DataFrame:
        """The blocks of some tokens: only the folders of their buckets are read."""
        held = self.spark.read.schema(_BLOCK_SQL).parquet(f"{self.path}/postings")
        held = held.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in tokens})) & F.col("token").isin(tokens))
        return held if slices is None else held.where(F.col("slice").isin(slices))

    def with_phrase(self, phrase: str) -> DataFrame:
        """doc of every document whose normalised text holds the phrase, also within words: its first word may end a token, its last begin one."""
        words = phrase.split(" ")
        token = F.col("token")
        if len(words) == 1:
            return self.blocks_of(self.tokens.where(F.contains(token, F.lit(phrase)))).mapInArrow(_docs_of, "token string, doc long").select("doc").distinct()
        found = None
        for nth, w in enumerate(words):
            fits = F.endswith(token, F.lit(w)) if nth == 0 else F.startswith(token, F.lit(w)) if nth == len(words) - 1 else token == w
            part = self.blocks_of(self.tokens.where(fits)).mapInArrow(_places_of, "token string, doc long, at long").select("doc", (F.col("at") - nth).alias("start"))
            found = part if found is None else found.join(part, ["doc", "start"], "left_semi")
        return found.select("doc").distinct()

    def blocks_of(self, tokens: DataFrame) -> DataFrame:
        """The blocks of tokens of the dictionary: named where they are few, joined by shuffle where a part of a word fits many."""
        few = tokens.select("token").limit(1001).collect()
        if len(few) <= 1000:
            return self.blocks([r.token for r in few])
        return self.spark.read.schema(_BLOCK_SQL).parquet(f"{self.path}/postings").join(tokens.select("token", "bucket"), ["token", "bucket"], "left_semi")

    def rank(self, query: str, k: int = 20) -> DataFrame:
        """doc and score of the k best documents: query tokens that they hold, and 4 for each quoted phrase; ties to the smaller doc."""
        asked = self.spark.range(1).select(query_terms(F.lit(query)).alias("t"), F.filter(F.transform(quoted_phrases(F.lit(query)), normalize_for_match), lambda p: p != "").alias("p")).first()
        held = self.tokens.where(F.col("token").isin(asked.t)).orderBy("df", "token").collect() if asked.t else []  # a row for each token of the question
        terms = [r.token for r in held]
        parts = [self.with_phrase(p).select("doc", F.lit(4).alias("score")) for p in asked.p]
        rare, seen = [], 0
        for r in held:
            # Enough for k documents, of which the best can beat all that is left.
            if seen >= k and len(rare) + 4 * len(parts) > len(terms) - len(rare):
                break
            rare.append(r.token)
            seen += r.df
        scores, self.left = self._scores(rare, None, parts), []
        if len(rare) < len(terms):
            best = scores.orderBy(F.desc("score"), "doc").limit(k).collect()
            left = terms[len(rare) :]
            if len(best) == k and best[-1].score > len(left):
                # No document without a rare token or a phrase can reach the k-th best: the rest is read for candidates alone.
                near = scores.where(F.col("score") + len(left) >= best[-1].score)
                slices = [r.slice for r in near.select(F.pmod(F.xxhash64("doc"), F.lit(self.slices)).cast("int").alias("slice")).distinct().collect()]
                self.left = left
                more = self._scores(left, slices, []).join(near.select("doc"), "doc", "left_semi")
                scores = near.unionByName(more).groupBy("doc").agg(F.sum("score").alias("score"))
            else:
                scores = self._scores(terms, None, parts)
        top = scores.orderBy(F.desc("score"), "doc").limit(k)
        # Where fewer documents have a score, those without one follow.
        none = self.spark.read.parquet(f"{self.path}/docs").orderBy("doc").limit(2 * k).join(F.broadcast(top), "doc", "left_anti").select("doc", F.lit(0).cast("long").alias("score"))
        return top.unionByName(none).orderBy(F.desc("score"), "doc").limit(k)

    def _scores(self, tokens: list[str], slices: list[int] | None, parts: list[DataFrame]) -> DataFrame:
        """doc and score by some tokens and by phrases already looked up."""
        rows = self.blocks(tokens, slices).mapInArrow(_docs_of, "token string, doc long").select("doc", F.lit(1).alias("score"))
        for part in parts:
            rows = rows.unionByName(part)
        return rows.groupBy("doc").agg(F.sum("score").alias("score"))

    def blocks_read(self, tokens: list[str], slices: list[int] | None = None) -> tuple[int, int]:
        """Blocks, and bytes in them, that some tokens' postings have."""
        size = F.length("docs") + F.length("counts") + F.length("places")
        row = self.blocks(tokens, slices).agg(F.count("*").alias("n"), F.sum(size).alias("size")).first()
        return row.n, row.size or 0
