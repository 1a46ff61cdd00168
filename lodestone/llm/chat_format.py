"""Chat formatting by quotation linking.

A message's lines are read with their quote depth (leading ``>`` marks, blanks
between them allowed). Lines of one depth in a row are a passage. What stands
at depth 0 is the message's own; an attribution line ("... wrote:") right
before a quote goes with the quote. Passages are normalised (lower case, white
space collapsed) and hashed; the own text of every message is indexed by the
hashes of its whole, its paragraphs and its lines, each pointing to the first
message of the conversation that says so. An equality join by (conversation,
hash) finds the original of each quoted passage, as a whole or line by line; as
the index holds one row per conversation and hash, a line that everybody
repeats multiplies nothing.

A message answers the original that most of its shallowest linked quote comes
from (ties: the later message). Answers form threads; roots are found by
pointer doubling. Conversations are in reply order: threads by the turn of
their root, messages of a thread by turn, so an answer follows what it answers.
Places are found by sums over slices of turns, so a conversation that holds a
third of all rows is not ordered in one task.

Defined results: a null text is empty; a null conv_id or turn is a value of its
own, before all others; rows that share conv_id and turn are one message told
more than once: each row is returned, in the order of role and text, and quotes
link to their turn; quotes without an original stay unlinked and are removed
all the same; quotes link to earlier turns only; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"[^\n>]{1,300}\b(wrote|writes|schrieb|a écrit|escribió)[ ]?:[ \t]*$", re.I)
#: Turns of a conversation that are ordered together.
SLICE = 4096
NONE = -(2**63)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def passage_hash(text: str) -> bytes | None:
    found = normalised(text)
    return hashlib.blake2b(found.encode("utf-8"), digest_size=16).digest() if found else None


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The own text of a message, and its quoted passages as (depth, lines) in order."""
    own, quotes = [], []
    before = 0
    for line in text.split("\n"):
        marks = MARKS.match(line)
        depth = marks[1].count(">") if marks else 0
        if depth:
            if not before and own and ATTRIBUTION.match(own[-1]):
                own.pop()
            if depth != before:
                quotes.append((depth, []))
            quotes[-1][1].append(line[marks.end() :])
        else:
            own.append(line)
        before = depth
    return "\n".join(own).strip("\n") if quotes else text, quotes


_PARSED = pa.schema([
    ("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n_quotes", pa.int64()),
    ("said", pa.list_(pa.binary())), ("quoted", pa.list_(pa.struct([("no", pa.int32()), ("depth", pa.int32()), ("hash", pa.binary()), ("weight", pa.int64())]))),
])
_SQL = "conv long, turn long, role string, text string, n_quotes long, said array<binary>, quoted array<struct<no:int,depth:int,hash:binary,weight:bigint>>"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part, rows = batch.slice(at, 1024), []
            for text in part.column(3).to_pylist():
                own, quotes = parse(text or "")
                said = {passage_hash(x) for x in [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]} - {None}
                asked = []
                for no, (depth, lines) in enumerate(quotes):
                    hashes = [(passage_hash(x), 1) for x in lines] + [(passage_hash("\n".join(lines)), len(lines) + 1)]
                    asked += [{"no": no, "depth": depth, "hash": h, "weight": w} for h, w in hashes if h]
                rows.append((own, len(quotes), sorted(said), asked))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, f.type) for c, f in zip(cols, list(_PARSED)[3:]))], schema=_PARSED)


def _places(rows: DataFrame, keys: list[str], order: str, size: str, out: str) -> DataFrame:
    """``out``: the sum of ``size`` over rows of ``keys`` whose ``order`` is smaller; one row per keys and order."""
    sliced = rows.withColumn("__slice", F.floor(F.col(order) / SLICE))
    sums = sliced.groupBy(*keys, "__slice").agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__slice", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("__within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return placed.join(sums, [*keys, "__slice"]).withColumn(out, (F.col("__before") + F.col("__within")).cast("long")).drop("__slice", "__before", "__within")


def _roots(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """conv, turn, root and depth of every message that answers another, by pointer doubling."""
    held = materialize(parents.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "chat-roots")
    for _ in range(max_rounds):
        above = held.select("conv", F.col("turn").alias("root"), F.col("root").alias("__up"), F.col("depth").alias("__more"))
        moved = held.join(above, ["conv", "root"], "left")
        if moved.where(F.col("__up").isNotNull()).isEmpty():
            return held
        held = materialize(moved.select("conv", "turn", F.coalesce("__up", "root").alias("root"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth")), "chat-roots")
    raise RuntimeError("answers did not settle")


def link_quotes(parsed: DataFrame) -> DataFrame:
    """conv, turn, no, depth, original and weight: where each quoted passage comes from."""
    said = parsed.select("conv", "turn", F.explode("said").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    asked = parsed.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.no", "q.depth", "q.hash", "q.weight").distinct()
    met = asked.join(said, ["conv", "hash"]).where("original < turn")
    return met.groupBy("conv", "turn", "no", "depth", "original").agg(F.sum("weight").alias("weight"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, parent_turn, root_turn, depth, n_quotes, n_linked, text and formatted of every message."""
    keyed = messages.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(NONE)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = materialize(keyed.mapInArrow(_parse_batches, _SQL), "chat-parsed")
    linked = materialize(link_quotes(parsed), "chat-links")
    by_depth = linked.groupBy("conv", "turn", "depth", "original").agg(F.sum("weight").alias("weight"))
    parents = by_depth.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("depth")).alias("d"), "weight", "original"))["original"].alias("parent"))
    n_linked = linked.groupBy("conv", "turn").agg(F.count_distinct("no").alias("n_linked"))
    threads = _roots(parents).join(parents, ["conv", "turn"]).join(n_linked, ["conv", "turn"])
    turns = parsed.groupBy("conv", "turn").agg(F.count("*").alias("n"))
    placed = turns.join(threads, ["conv", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    sizes = placed.groupBy("conv", "root").agg(F.sum("n").alias("size"))
    starts = _places(sizes, ["conv"], "root", "size", "start").select("conv", "root", "start")
    ordered = _places(placed, ["conv", "root"], "turn", "n", "inside").join(starts, ["conv", "root"])
    ordered = ordered.select("conv", "turn", "root", F.col("parent"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), (F.col("start") + F.col("inside")).alias("first"), "n")
    rows = parsed.drop("said", "quoted").join(ordered, ["conv", "turn"])
    single = rows.where("n = 1").withColumn("position", F.col("first"))
    again = Window.partitionBy("conv", "turn").orderBy("role", "text")
    several = rows.where("n > 1").withColumn("position", F.col("first") + F.row_number().over(again) - 1)
    real = lambda c: F.when(F.col(c) != NONE, F.col(c))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return single.unionByName(several).select(
        real("conv").alias("conv_id"), "position", real("turn").alias("turn"), "role", real("parent").alias("parent_turn"), real("root").alias("root_turn"), "depth", "n_quotes", "n_linked", "text", formatted.alias("formatted")
    )
