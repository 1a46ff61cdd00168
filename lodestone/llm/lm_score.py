"""LM scoring by online logistic context mixing.

A text is a row of tokens: its words, A-Z lower-cased, and one end. It is coded
as binary decisions, and a document's score is the log10 of the product of
their probabilities.

Coding. A word that the training texts hold at least twice is known: one
decision says so, then come the bits of its hash bucket and of its Huffman code
within the bucket (by training counts), so a token takes about as many decisions
as its order-0 entropy has bits. Other words are spelled, byte by byte, in a
Huffman code of the bytes of words that the training texts hold once. Every
decision is a node of a code tree.

Predictors. For each of ``ORDERS`` contexts (the last one and two tokens;
within a spelled word the last three and four bytes) the context and the
node are hashed to one of 2 ** ``SLOT_BITS`` slots, which counts the zeros and
ones that followed in all training texts. In a context a word stands for itself
only where it is frequent (a short code), else for its last two bytes: so what the
slots are asked to tell apart follows the shape of the vocabulary and not the size of
the corpus. Every bit of a code is asked of the contexts and mixed, up to ``DEEP`` bits, which four bytes hold; a code
is longer only where a word's share of all tokens is below about 2 ** -32, and its bits after those count as one bit each.

Mixing. The predictions, as logits, are summed with weights that a gate chooses:
the kind of the decision and how much each context has seen. An adaptive
probability map refines the sum. Weights start from what online learning over
the training texts gave and go on learning within the document that is scored,
after blocks of tokens whose edges depend on the place in the document alone.

Plan. Documents become chunks with a list of distinct words; the words are
dealt to hash buckets, as many as their number asks for, and answered with count
and code, so no row per occurrence is shuffled and no word is hot. The coded
chunks are written once. Equal texts meet by digest, a row per chunk that holds
one: the first such chunk owns the text, learns it as often as training documents
hold it and scores it once; the score goes back to the chunks. One pass counts
every training text; partial tables are merged in a tree with bounded fan-in.
Weights are learned on every twelfth training document, against tables that leave
those out; the tables that score hold all. What is sent to every task has a
fixed bound: one byte a slot (``ORDERS`` * 2 ** ``SLOT_BITS``), the weights and
the byte code.

Defined results: a null or empty text is one token, the end; a null id trains
and is not held out; repeated rows train once each and are scored each; without
training texts all counts are 0, base_score is 0 and words are spelled with equal bytes;
an empty table gives an empty table; further columns are ignored. Texts are
read whole; the work in memory is a batch of tokens whatever a text's length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bucketed, give_back, materialize
from lodestone.llm.packing import expand, squeeze

#: Of a document's hash modulo 14: these are held out (2 of 7), and these learn the weights.
HELD, LEARN = (2, 9), 3
#: Bytes of text, and distinct words, that close a chunk after the document that reaches them.
CHUNK_BYTES, CHUNK_WORDS = 6_000_000, 250_000
#: Words asked for by all chunks for which one hash bucket is opened; at least ``LEAST_BUCKETS``.
BUCKET_WORDS, LEAST_BUCKETS = 1_000_000, 64
ORDERS, SLOT_BITS, PART_BITS = 2, 22, 16
#: Partial tables that one step of the merge adds up.
FAN = 32
#: Bits of code that a word has at most to count as itself in a context of each order; bits of a code that contexts are asked for: as many as a node's four bytes hold.
FREQUENT, DEEP = (14, 9), 32
#: Bytes of a spelled word that are a context of each order.
LETTERS = (3, 4)
#: Tokens that are worked on at once, and the first edges of blocks after which a document's weights move.
AT_ONCE = 4_000
EDGES = (0, 32, 64, 128, 256, 512, 1024, 2048)
STEP = 4096
GATES, APM_ROWS, APM_CELLS = 3 * 4**ORDERS, 3 * 8, 48
RATE, OWN_RATE = 0.5, 0.25
#: Mixed logits stay within this.
LIMIT = np.float32(11.5)
END = b" "  # no word holds a blank

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BACK = np.uint64(pow(int(_M1), -1, 1 << 64))
_M4, _M5 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_FOLD = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))

_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("of", pa.binary()), ("digests", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64())])
_ASK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("at", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("at", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary()), ("lens", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("letters", pa.list_(pa.int64()))])
_TEXT = pa.schema([("digest", pa.binary()), ("chunk", pa.int64()), ("nth", pa.int64()), ("rest", pa.int64()), ("learn", pa.int64())])
_CODED = pa.schema([("chunk", pa.int64()), ("digests", pa.binary()), ("rest", pa.binary()), ("learn", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary()), ("lens", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("letters", pa.list_(pa.int64()))])
_TABLE = pa.schema([("part", pa.int32()), ("heap", pa.int64()), ("first", pa.binary()), ("rest", pa.binary())])
_LEARNED = pa.schema([("kind", pa.string()), ("at", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])
_SCORED = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)]


def tokens_of(text: str) -> list[bytes]:
    return [*text.encode("utf-8").translate(_FOLD).split(), END]


def fold(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) % 14 if doc_id is not None else 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A polynomial hash of each stretch of bytes: the same wherever the word stands."""
    powers, back = np.full(len(text), _M1, np.uint64), np.full(len(text), _BACK, np.uint64)
    powers[0] = back[0] = 1
    total = np.append(np.uint64(0), np.cumsum((text + np.uint64(1)) * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64))
    return _mix((total[stop] - total[start]) * np.cumprod(back, dtype=np.uint64)[start])


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of a canonical Huffman code; a weight counts as 2 ** -32 of the sum at least, which bounds the lengths."""
    n = len(weights)
    lens = np.zeros(n, np.int64)
    if n < 2:
        return np.zeros(n, np.uint64), lens
    weights = np.maximum(weights, max(1, int(weights.sum()) >> 32))
    order = np.argsort(weights, kind="stable")
    leaves, made, parent = weights[order].tolist(), [], np.zeros(2 * n - 1, np.int64)
    a = b = 0  # the two smallest stand at the head of the leaves or of the nodes made so far
    for node in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if a < n and (b >= len(made) or leaves[a] <= made[b]):
                total, parent[a], a = total + leaves[a], node, a + 1
            else:
                total, parent[n + b], b = total + made[b], node, b + 1
        made.append(total)
    depth = [0] * (2 * n - 1)
    up = parent.tolist()
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[up[node]] + 1
    lens[order] = depth[:n]
    by_len = np.argsort(lens, kind="stable")
    shift = (lens.max() - lens[by_len]).astype(np.uint64)
    share = np.uint64(1) << shift
    codes = np.zeros(n, np.uint64)
    codes[by_len] = (np.cumsum(share, dtype=np.uint64) - share) >> shift
    return codes, lens


def _pack(chunk_bytes: int, chunk_words: int):
    """Documents to chunks: distinct texts as places in a list of distinct words, with the words' training counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        doc_ids, of, places, texts, index = [], [], [], {}, defaultdict(count().__next__)

        def chunk() -> pa.RecordBatch:
            sizes = np.array([len(p) for p in places], np.uint64)
            trains = np.bincount(of, weights=[fold(i) not in HELD for i in doc_ids], minlength=len(sizes))
            flat = np.concatenate(places)
            counts = np.bincount(flat, weights=np.repeat(trains, sizes.astype(np.int64)), minlength=len(index)).astype(np.uint64)
            row = ((task << 32) | made, doc_ids, squeeze(np.array(of, np.uint64)), b"".join(texts), squeeze(sizes), squeeze(flat), zstandard.compress(b"\n".join(index), 3), squeeze(counts), len(index))
            return pa.RecordBatch.from_arrays(_rows([row], _CHUNK), schema=_CHUNK)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens_of(text.as_py() or "")
                key = xxhash.xxh3_128_digest(b" ".join(words))
                if key not in texts:
                    texts[key] = len(places)
                    places.append(np.array([index[w] for w in words], np.uint64))
                    size += sum(map(len, words)) + len(words)
                doc_ids.append(doc_id)
                of.append(texts[key])
                if size >= chunk_bytes or len(index) >= chunk_words or len(doc_ids) >= chunk_words:
                    yield chunk()
                    made, size = made + 1, 0
                    doc_ids, of, places, texts, index = [], [], [], {}, defaultdict(count().__next__)
        if doc_ids:
            yield chunk()
        give_back()

    return rows


def _deal(n_buckets: int):
    """A chunk's distinct words to hash buckets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words = zstandard.decompress(batch.column("words")[r].as_py()).split(b"\n")
                counts = expand(batch.column("counts")[r].as_py())
                to = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % n_buckets
                order = np.argsort(to, kind="stable")
                ends, out = np.searchsorted(to[order], np.arange(n_buckets + 1)), []
                for b in np.flatnonzero(np.diff(ends)):
                    at = order[ends[b] : ends[b + 1]]
                    out.append((batch.column("chunk")[r].as_py(), int(b), squeeze(np.diff(at, prepend=0)), zstandard.compress(b"\n".join([words[k] for k in at]), 3), squeeze(counts[at])))
                yield pa.RecordBatch.from_arrays(_rows(out, _ASK), schema=_ASK)

    return rows


def _answer(n_buckets: int):
    """All chunks' words of one bucket: training count and code of each; one more row with the bucket's totals."""
    bits = n_buckets.bit_length() - 1

    def answer(asked: pa.Table) -> pa.Table:
        index: dict[bytes, int] = defaultdict(count().__next__)
        places = [np.array([index[w] for w in zstandard.decompress(x.as_py()).split(b"\n")], np.int64) for x in asked.column("words")]
        total = np.zeros(len(index), np.int64)
        for at, x in zip(places, asked.column("counts")):
            total[at] += expand(x.as_py()).astype(np.int64)
        words, bucket = list(index), asked.column("bucket")[0].as_py()
        # The order of words decides codes of equal length, so it must not follow the order of rows.
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        known = order[total[order] > 1]
        code, size = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        within, lens = huffman(total[known])
        code[known] = (np.uint64((1 << bits) | bucket) << lens.astype(np.uint64)) | within
        size[known] = lens + bits + 1
        once = b"".join([words[k] for k in np.flatnonzero(total == 1)])
        letters = np.bincount(np.frombuffer(once, np.uint8), minlength=257)
        letters[256] = int((total == 1).sum())
        out = [(asked.column("chunk")[r].as_py(), bucket, asked.column("at")[r].as_py(), squeeze(total[at].astype(np.uint64)), squeeze(code[at]), squeeze(size[at]), None, None, None) for r, at in enumerate(places)]
        out.append((-1, bucket, None, None, None, None, int(total.sum()), int((total > 0).sum()), letters.tolist()))
        give_back()
        return pa.table(_rows(out, _REPLY), schema=_REPLY)

    return lambda asked: answer(asked)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct text of a chunk: its digest, and how many training documents hold it."""
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["digests"]) // 16
            of, kind = expand(row["of"]).astype(np.int64), np.array([fold(i) for i in row["doc_ids"]])
            rest, learn = (np.bincount(of, weights=w, minlength=n).astype(np.int64) for w in (~np.isin(kind, (*HELD, LEARN)), kind == LEARN))
            digests = [row["digests"][16 * k : 16 * k + 16] for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((digests, [row["chunk"]] * n, range(n), rest, learn), _TEXT)], schema=_TEXT)


def _own(owned: pa.Table) -> pa.Table:
    """The texts that one chunk owns, as a reply to it."""
    owned = owned.sort_by("nth")
    nth, rest, learn = (owned.column(c).to_numpy().astype(np.uint64) for c in ("nth", "rest", "learn"))
    return pa.table(_rows([(owned.column("chunk")[0].as_py(), -1, squeeze(np.diff(nth, prepend=np.uint64(0))), squeeze(rest), squeeze(learn), *[None] * 4)], _REPLY), schema=_REPLY)


def _assemble(chunk: pa.Table, replies: pa.Table) -> pa.Table:
    """The texts that a chunk owns, with its words' counts and codes; or the totals of buckets."""
    if not chunk.num_rows:
        return pa.table(_rows([(-1, *[None] * 9, r["n"], r["v"], r["letters"]) for r in replies.select(["n", "v", "letters"]).to_pylist()], _CODED), schema=_CODED)
    (row,) = chunk.to_pylist()
    found, own = np.zeros((3, row["n_words"]), np.uint64), None
    for r in replies.to_pylist():
        at = np.cumsum(expand(r["at"]).astype(np.int64))
        if r["bucket"] < 0:
            own, rest, learn = at, r["counts"], r["codes"]
        else:
            for k, c in enumerate(("counts", "codes", "lens")):
                found[k, at] = expand(r[c])
    if own is None:
        return _CODED.empty_table()
    sizes, places = expand(row["sizes"]).astype(np.int64), expand(row["places"])
    places = places[np.repeat(np.isin(np.arange(len(sizes)), own), sizes)]
    digests = b"".join([row["digests"][16 * k : 16 * k + 16] for k in own.tolist()])
    out = (row["chunk"], digests, rest, learn, squeeze(sizes[own].astype(np.uint64)), squeeze(places), row["words"], *(squeeze(x) for x in found), None, None, None)
    give_back()
    return pa.table(_rows([out], _CODED), schema=_CODED)


def _tell(chunk: pa.Table, scored: pa.Table) -> pa.Table:
    """Every document of a chunk with its text's scores."""
    scored = scored.sort_by("nth")
    of = pa.array(np.concatenate([expand(x.as_py()).astype(np.int64) for x in chunk.column("of")] or [np.zeros(0, np.int64)]))
    return pa.table([chunk.column("doc_ids").combine_chunks().flatten(), *(scored.column(f.name).combine_chunks().take(of) for f in list(_OUT)[1:])], schema=_OUT)


#: The name of what stands before a document's first token.
_START = _mix(np.array([END[0] + 1], np.uint64))[0]


class Coded:
    """A chunk's texts and words, ready to be laid out as decisions."""

    def __init__(self, row: dict, letters: tuple[np.ndarray, np.ndarray]):
        self.digests = row["digests"]
        self.rest, self.learn = (expand(row[c]).astype(np.int64) for c in ("rest", "learn"))
        self.sizes, self.places = expand(row["sizes"]).astype(np.int64), expand(row["places"]).astype(np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        text = np.frombuffer(zstandard.decompress(row["words"]) + b"\n", np.uint8)
        stop = np.flatnonzero(text == 10)
        start = np.append(0, stop[:-1] + 1)
        self.counts, code, size = expand(row["counts"]).astype(np.int64), expand(row["codes"]), expand(row["lens"]).astype(np.int64)
        known = size > 0
        size = np.where(known, size, 1)
        beyond = np.maximum(size - DEEP, 0)
        self.code, self.size = (code >> beyond.astype(np.uint64)).astype(np.uint32), (size - beyond).astype(np.int32)
        self.bytes = stop - start + (text[start] != END[0])
        # What a word is as a context of each order: itself where it is frequent, else its last two bytes.
        own, tail = _word_hashes(text, start, stop), _mix(text[stop - 1].astype(np.uint64) + np.uint64(256) * np.where(stop - start > 1, text[stop - 2], 0).astype(np.uint64))
        self.names = [np.append(np.where(known & (size <= most), own, tail), _START) for most in FREQUENT]
        # Spelled words in one row: their bytes and a mark at the end (256).
        self.n_letters = np.where(known, 0, stop - start + 1)
        self.spell = np.cumsum(self.n_letters) - self.n_letters
        flat = text[np.repeat(~known, stop - start + 1)].astype(np.int64)
        flat[flat == 10] = 256
        at = np.arange(len(flat)) - np.repeat(self.spell, self.n_letters)
        over = np.maximum(letters[1] - DEEP, 0)
        self.letter_code, self.letter_size = (letters[0] >> over.astype(np.uint64)).astype(np.uint32)[flat], (letters[1] - over).astype(np.int32)[flat]
        #: Bits of each token that no context is asked for.
        self.plain = beyond + np.bincount(np.repeat(np.arange(len(stop)), self.n_letters), weights=over[flat], minlength=len(stop))
        key, self.letter_ctx = np.full(len(flat), 7, np.uint32), []
        for k in range(1, LETTERS[-1] + 1):
            key = key * np.uint32(521) + np.where(at >= k, np.roll(flat, k), 300).astype(np.uint32)
            if k in LETTERS:
                self.letter_ctx.append((key ^ (key >> np.uint32(15))) * _M4)

    def decisions(self, at: np.ndarray, text: np.ndarray):
        """Of the tokens ``at`` (places in the chunk), each in its ``text``: token, bit, kind, depth and a slot for each order."""
        word, start = self.places[at], self.starts[text]
        # Symbols: a token's own, then the letters of a spelled one.
        n_symbols = 1 + self.n_letters[word]
        token = np.repeat(np.arange(len(at), dtype=np.int32), n_symbols)
        nth = np.arange(len(token)) - np.repeat(np.cumsum(n_symbols) - n_symbols, n_symbols)
        letter = nth > 0
        of_letter = (self.spell[word][token] + nth - 1)[letter]
        code, size = self.code[word][token], self.size[word][token]
        code[letter], size[letter] = self.letter_code[of_letter], self.letter_size[of_letter]
        before = [np.where(at - k >= start, self.places[at - k], len(self.size)) for k in range(1, ORDERS + 1)]
        ctx = []
        for k, names in enumerate(self.names):
            key = np.full(len(at), k + 3, np.uint64)
            for b in before[: k + 1]:
                key = key * _M1 + names[b]
            of_word = _mix(key).astype(np.uint32)[token]
            of_word[letter] = self.letter_ctx[k][of_letter]
            ctx.append(of_word)
        # Decisions: the bits of each symbol.
        stop = np.cumsum(size, dtype=np.int32)
        symbol = np.repeat(np.arange(len(token)), size)
        left = (stop - np.int32(1))[symbol] - np.arange(len(symbol), dtype=np.int32)
        depth = (size - np.int32(1))[symbol] - left
        prefix = code[symbol] >> left.view(np.uint32)
        bit = (prefix & np.uint32(1)).astype(np.uint8)
        node = ((prefix >> np.uint32(1)) | (np.uint32(1) << depth.view(np.uint32))) * _M4
        slots = [(((c[symbol] ^ node) * _M5) >> np.uint32(32 - SLOT_BITS)).astype(np.intp) for c in ctx]
        kind = (letter + np.uint8(1))[symbol]
        kind[(stop - size)[~letter]] = 0
        return token[symbol], bit, kind, depth, slots


def _letters(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    return huffman(np.frombuffer(row, np.int64))


def _spans(sizes: np.ndarray, starts: np.ndarray, texts: np.ndarray, lo: int, hi: int):
    """Tokens lo to hi of each of the texts, in batches: places and texts."""
    n = np.minimum(sizes[texts], hi) - lo
    total = np.cumsum(n)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + AT_ONCE)))
        k = n[first:last]
        at = np.repeat(starts[texts[first:last]] + lo, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        yield at, np.repeat(texts[first:last], k)
        first = last


def _edges(most: int) -> Iterator[tuple[int, int]]:
    """Blocks of a document: they widen, then stay as they are."""
    edges = [*EDGES, *range(STEP, most + STEP, STEP)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if a < most)


def _coded_rows(batches: Iterator[pa.RecordBatch], letters: bytes) -> Iterator[Coded]:
    code = _letters(letters)
    for batch in batches:
        for r in range(batch.num_rows):
            yield Coded({c: batch.column(c)[r].as_py() for c in batch.schema.names}, code)


def _count(letters: bytes):
    """Zeros and ones by slot of all training texts of a task: without, and only, those that learn the weights."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tables = np.zeros((2, ORDERS, 2 << SLOT_BITS), np.int32)
        seen = False
        for coded in _coded_rows(batches, letters):
            for table, times in zip(tables, (coded.rest, coded.learn)):
                texts = np.flatnonzero(times)
                for lo in range(0, int(coded.sizes[texts].max(initial=0)), AT_ONCE):
                    inside = texts[coded.sizes[texts] > lo]
                    for at, text in _spans(coded.sizes, coded.starts, inside, lo, lo + AT_ONCE):
                        token, bit, _, _, slots = coded.decisions(at, text)
                        n = times[text].astype(np.int32)[token]
                        for k, slot in enumerate(slots):
                            np.add.at(table[k], slot * 2 + bit, n)
                        seen = True
        if seen:
            for part in range(ORDERS << (SLOT_BITS - PART_BITS)):
                first, rest = (t.reshape(-1)[part << (PART_BITS + 1) : (part + 1) << (PART_BITS + 1)].astype(np.uint64) for t in tables)
                yield pa.RecordBatch.from_arrays(_rows([(part, task, squeeze(first), squeeze(rest))], _TABLE), schema=_TABLE)
        del tables
        give_back()

    return rows


def _add(rows: pa.Table) -> pa.Table:
    """Partial tables of one part, added up."""
    sums = [np.zeros(2 << PART_BITS, np.uint64), np.zeros(2 << PART_BITS, np.uint64)]
    for r in range(rows.num_rows):
        for total, c in zip(sums, ("first", "rest")):
            total += expand(rows.column(c)[r].as_py())
    return pa.table(_rows([(rows.column("part")[0].as_py(), rows.column("heap")[0].as_py(), *(squeeze(x) for x in sums))], _TABLE), schema=_TABLE)


def _predictions(counts: np.ndarray) -> np.ndarray:
    """A byte a slot: the logit in quarters and how much was seen (none, one, up to seven, more)."""
    zeros, ones = counts.reshape(-1, 2).astype(np.float64).T
    level = np.clip(np.rint(4 * np.log((ones + 0.4) / (zeros + 0.4))) + 32, 0, 63).astype(np.uint8)
    return (level << 2) | np.searchsorted([1, 2, 8], zeros + ones, side="right").astype(np.uint8)


class Mixer:
    """Predictions of a table, weights by gate and an adaptive probability map."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray, apm: np.ndarray):
        self.tables, self.weights, self.apm = tables, weights, apm

    @staticmethod
    def fresh() -> np.ndarray:
        weights = np.full((ORDERS + 1, GATES), 0.4, np.float32)
        weights[ORDERS] = 0
        return weights

    def inputs(self, kind: np.ndarray, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Logits by order and the gate of each decision."""
        held = [table.take(slot, mode="clip") for table, slot in zip(self.tables, slots)]
        gate = kind
        for x in held:
            gate = (gate << 2) + (x & 3)
        return [((x >> 2).astype(np.float32) - np.float32(32)) * np.float32(0.25) for x in held], gate.astype(np.intp)

    @staticmethod
    def mixed(weights: np.ndarray, gate: np.ndarray, logits: list[np.ndarray]) -> np.ndarray:
        total = weights[ORDERS].take(gate, mode="clip")
        for own, x in zip(weights, logits):
            total += own.take(gate, mode="clip") * x
        return total

    @staticmethod
    def cell(kind: np.ndarray, depth: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Place in the map: kind and depth of the decision, and the logit in halves."""
        return (kind.astype(np.intp) * 8 + np.minimum(depth, 7)) * APM_CELLS + (2 * total + 24).astype(np.intp)

    @staticmethod
    def moved(weights: np.ndarray, gate: np.ndarray, miss: np.ndarray, logits: list[np.ndarray]) -> None:
        """One step of online learning: by gate, towards what the misses ask for."""
        n = np.bincount(gate, minlength=GATES) + 16
        for k in range(ORDERS + 1):
            push = np.bincount(gate, weights=miss * logits[k] if k < ORDERS else miss, minlength=GATES)
            weights[k] += (RATE * push / n).astype(np.float32)


def _learn(letters: bytes, tables):
    """Weights and map counts learned online, chunk by chunk, from the documents that the tables leave out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(_unpacked(tables.value), Mixer.fresh(), np.zeros(0))
        sums, times, cells = np.zeros((ORDERS + 1, GATES), np.int64), np.zeros(GATES, np.int64), np.zeros((APM_ROWS * APM_CELLS, 2), np.int64)
        for coded in _coded_rows(batches, letters):
            weights, events = Mixer.fresh(), np.zeros(GATES, np.int64)
            texts = np.flatnonzero(coded.learn)
            for lo, hi in _edges(int(coded.sizes[texts].max(initial=0))):
                for at, text in _spans(coded.sizes, coded.starts, texts[coded.sizes[texts] > lo], lo, hi):
                    _, bit, kind, depth, slots = coded.decisions(at, text)
                    logits, gate = mixer.inputs(kind, slots)
                    total = np.clip(Mixer.mixed(weights, gate, logits), -LIMIT, LIMIT)
                    Mixer.moved(weights, gate, bit - 1 / (1 + np.exp(-total)), logits)
                    events += np.bincount(gate, minlength=GATES)
                    cells += np.bincount(Mixer.cell(kind, depth, total) * 2 + bit, minlength=cells.size).reshape(-1, 2)
            # Whole numbers, so the sum does not depend on the order of chunks; a chunk speaks for 4,096 decisions of a gate at most.
            n = np.minimum(events, 4096)
            sums += np.rint(weights * 65536.0).astype(np.int64) * n
            times += n
        out = [("weight", int(k), int(sums.flat[k]), int(times[k % GATES])) for k in range(sums.size) if times[k % GATES]]
        out += [("cell", int(k), int(cells[k, 0]), int(cells[k, 1])) for k in np.flatnonzero(cells.sum(1))]
        yield pa.RecordBatch.from_arrays(_rows(out, _LEARNED), schema=_LEARNED)
        give_back()

    return rows


def _score(letters: bytes, tables, learned, n: int, v: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(_unpacked(tables.value), *learned.value)
        for coded in _coded_rows(batches, letters):
            total = np.zeros(len(coded.sizes))
            by_size = np.argsort(-coded.sizes, kind="stable")
            for first in range(0, len(by_size), 256):
                _score_texts(mixer, coded, by_size[first : first + 256], total)
            base = np.log10((coded.counts + 1) / (n + v + 1))
            edges = np.append(coded.starts, len(coded.places))[:-1]
            per_text = [np.add.reduceat(x[coded.places], edges) for x in (base, (coded.counts > 0).astype(np.int64), coded.bytes, coded.plain)]
            total -= per_text[3] * np.log(2)
            bits = -total / np.log(2)
            cols = [[coded.digests[16 * k : 16 * k + 16] for k in range(len(total))], coded.sizes, per_text[1], per_text[0], total / np.log(10), bits / per_text[2]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _SCORED)], schema=_SCORED)
        give_back()

    return rows


def _score_texts(mixer: Mixer, coded: Coded, texts: np.ndarray, total: np.ndarray) -> None:
    """Log probabilities of some texts, longest first; each has its own change of the weights, which moves after each of its blocks."""
    change = np.zeros((ORDERS + 1, len(coded.sizes)), np.float32)
    for lo, hi in _edges(int(coded.sizes[texts[0]])):
        for at, text in _spans(coded.sizes, coded.starts, texts[coded.sizes[texts] > lo], lo, hi):
            token, bit, kind, depth, slots = coded.decisions(at, text)
            logits, gate = mixer.inputs(kind, slots)
            logit = Mixer.mixed(mixer.weights, gate, logits)
            first = np.flatnonzero(np.diff(text, prepend=-1))  # tokens, then decisions, at which the texts begin
            begin, here = np.searchsorted(token, first), text[first]
            if lo:
                size = np.diff(begin, append=len(token))
                logit += np.repeat(change[ORDERS, here], size)
                for k, x in enumerate(logits):
                    logit += np.repeat(change[k, here], size) * x
            np.clip(logit, -LIMIT, LIMIT, out=logit)
            p = 1 / (1 + np.exp(-logit))
            refined = (p + mixer.apm.take(Mixer.cell(kind, depth, logit), mode="clip")) * np.float32(0.5)
            total[here] += np.add.reduceat(np.log(np.where(bit, refined, 1 - refined)), begin, dtype=np.float64)
            miss, n = bit - p, np.diff(begin, append=len(token)) + 64
            for k in range(ORDERS + 1):
                change[k, here] += OWN_RATE * np.add.reduceat(miss * logits[k] if k < ORDERS else miss, begin) / n


def _unpacked(parts: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(parts), np.uint8).reshape(ORDERS, 1 << SLOT_BITS)


def scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, chunk_words: int = CHUNK_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chunks = bucketed(texts.mapInArrow(_pack(chunk_bytes, chunk_words), _ddl(_CHUNK)), "chunk", "lm_chunks")
    asked = chunks.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, 1 << max(0, -(-asked // bucket_words) - 1).bit_length())
    asks = chunks.select("chunk", "words", "counts").mapInArrow(_deal(n_buckets), _ddl(_ASK))
    replies = asks.groupBy("bucket").applyInArrow(_answer(n_buckets), _ddl(_REPLY))
    held = chunks.select("chunk", "doc_ids", "of", "digests").mapInArrow(_texts, _ddl(_TEXT))
    owned = held.groupBy("digest").agg(F.min(F.struct("chunk", "nth")).alias("at"), F.sum("rest").alias("rest"), F.sum("learn").alias("learn"))
    owned = owned.select("at.chunk", "at.nth", "rest", "learn").groupBy("chunk").applyInArrow(_own, _ddl(_REPLY))
    coded = materialize(chunks.groupBy("chunk").cogroup(replies.unionAll(owned).groupBy("chunk")).applyInArrow(_assemble, _ddl(_CODED)), "lm-coded")

    told = coded.where("chunk = -1")
    n, v = (x or 0 for x in told.agg(F.sum("n"), F.sum("v")).first())
    letters = np.ones(257, np.int64)
    for r in told.select(F.posexplode("letters")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # 257 rows
        letters[r.pos] += r.n
    letters = letters.tobytes()

    rows = coded.where("chunk >= 0").select("digests", "rest", "learn", "sizes", "places", "words", "counts", "codes", "lens")
    tables = rows.mapInArrow(_count(letters), _ddl(_TABLE))
    heaps = rows.rdd.getNumPartitions()
    while True:
        heaps = -(-heaps // FAN)
        tables = tables.withColumn("heap", F.floor(F.col("heap") / FAN)).groupBy("part", "heap").applyInArrow(_add, _ddl(_TABLE))
        if heaps <= 1:
            break
    tables = materialize(tables, "lm-tables")
    without, whole = _table(spark, tables, "first"), _table(spark, tables.select("part", "first", "rest"), "rest")
    learned = rows.mapInArrow(_learn(letters, without), _ddl(_LEARNED)).groupBy("kind", "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    weights, cells = Mixer.fresh(), np.zeros((APM_ROWS * APM_CELLS, 2))
    for r in learned.collect():  # a row for each weight and each cell of the map
        if r["kind"] == "weight":
            weights.flat[r["at"]] = r["x"] / r["y"] / 65536
        else:
            cells[r["at"]] = r["x"], r["y"]
    # A cell that saw little says what the mixed logit says.
    middle = 1 / (1 + np.exp(-np.tile((np.arange(APM_CELLS) - 23.5) / 2, APM_ROWS)))
    apm = ((cells[:, 1] + 16 * middle) / (cells.sum(1) + 16)).astype(np.float32)
    sent = spark.sparkContext.broadcast((weights, apm))
    scored = rows.mapInArrow(_score(letters, whole, sent, n, v), _ddl(_SCORED)).join(held.select("digest", "chunk", "nth"), "digest")
    out = chunks.select("chunk", "doc_ids", "of").groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(_tell, _ddl(_OUT))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == HELD[0], F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def _table(spark, tables: DataFrame, upto: str):
    """The predictions of all slots for every task: a byte each, whatever the corpus."""
    names = tables.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                counts = expand(batch.column("first")[r].as_py())
                if upto == "rest":
                    counts = counts + expand(batch.column("rest")[r].as_py())
                cols = [pa.array([batch.column("part")[r].as_py()], pa.int32()), pa.array([zstandard.compress(_predictions(counts).tobytes(), 3)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "cells"])

    held = np.full((ORDERS << (SLOT_BITS - PART_BITS), 1 << PART_BITS), 32 << 2, np.uint8)
    for r in tables.select(*[c for c in names if c != "heap"]).mapInArrow(rows, "part int, cells binary").collect():  # bounded: a byte a slot
        held[r["part"]] = np.frombuffer(zstandard.decompress(r["cells"]), np.uint8)
    return spark.sparkContext.broadcast(zstandard.compress(held.tobytes(), 3))
