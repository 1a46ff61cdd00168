"""python -m lodestone list | run QUERY DATA_FOLDER [ROWS]
python -m lodestone ask DATA_FOLDER QUESTION | history DATA_FOLDER SESSION [ROWS]
python -m lodestone pipeline DATA_FOLDER OUT_FOLDER [--step NAME] [--verbose]"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import sessions
from lodestone.plans import catalogue, ingest
from lodestone.seams import HashingEmbedder
from lodestone.session import local_session, table
from lodestone.sources import sinks


def _corpus(spark, folder: str):
    return table(spark, folder, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")


def steps(spark, folder: str, out: str) -> list:
    """prepare, chunk and embed, each reading what the one before wrote."""
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    return [
        ("prepare", lambda: sinks.write_corpus(ingest.prepare(_corpus(spark, folder)), f"{out}/corpus")),
        ("chunk", lambda: sinks.write_corpus(ingest.chunk(read("corpus")), f"{out}/chunks")),
        ("embed", lambda: ingest.embed_in_parts(read("chunks"), f"{out}/embeddings", HashingEmbedder())),
    ]


def ask(folder: str, question: str) -> dict:
    """The answer over a folder's documents, each embedded by the default embedder."""
    spark, embedder = local_session(), HashingEmbedder()
    docs = _corpus(spark, folder)
    chunks = docs.withColumn("chunk_id", F.concat("filename", F.lit("_0")))
    vectors = chunks.select("chunk_id", embedder.column(F.col("text")).alias("embedding"))
    return Engine(docs, chunks, embedder, vectors=vectors).ask(question).first().asDict(recursive=True)


def main(args: list[str]) -> int:
    verbose = "--verbose" in args
    args = [a for a in args if a != "--verbose"]
    if args == ["list"]:
        print("\n".join(sorted(catalogue.queries())))
        return 0
    if len(args) in (3, 4) and args[0] == "run":
        if args[1] not in catalogue.queries():
            print(f"no query {args[1]}", file=sys.stderr)
            return 2
        catalogue.queries()[args[1]](local_session(), args[2]).show(int(args[3]) if len(args) == 4 else 20, truncate=60)
        return 0
    if len(args) == 3 and args[0] == "ask":
        found = ask(args[1], args[2])
        print(found["answer"], *(f"[{c['filename']}; {c['chunk_id']}]" for c in found["citations"]), sep="\n")
        return 0
    if len(args) in (3, 4) and args[0] == "history":
        rows = sessions.exchanges(table(local_session(), args[1], "conversations"))
        for r in sessions.latest(rows, int(args[2]), int(args[3]) if len(args) == 4 else 5, "session_id", "asked").collect():
            print(f"> {r.user_query}\n{r.ai_response}\n")
        return 0
    if len(args) in (3, 5) and args[0] == "pipeline" and (len(args) == 3 or args[3] == "--step"):
        only = args[4] if len(args) == 5 else None
        made = steps(local_session(), args[1], args[2])
        if only is not None and only not in dict(made):
            print(f"no step {only}; there are {', '.join(dict(made))}", file=sys.stderr)
            return 2
        report = ingest.run_steps(made, only=only)
        for name, done, seconds, error in report:
            print(f"{name}: {'done' if done else 'failed'}" + (f", {seconds:.1f} s" if verbose else "") + (f" ({error[:200]})" if error else ""))
        return 0 if all(done for _, done, _, _ in report) else 1
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
