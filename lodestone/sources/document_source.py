"""Documents as a Python data source: batch and stream, known names dropped before a byte is read.

``register(spark)`` makes it known; then::

    spark.read.format("lodestone_documents").option("path", folder).option("known", table).load()
    spark.readStream.format("lodestone_documents").option("path", folder).load()

The planner lists the folder (names, sizes, times), drops names that the Parquet table
``known`` has in its column ``filename``, and deals the files to partitions by size; tasks
read contents. A stream's offset is the time and path of the last file that was taken in,
so a file is read once, and a second run over a folder where nothing is new reads none.
A file whose time is before that of a file already taken in is not seen by the stream.
``upto`` (time and path, as in an offset) lets a run end before the newest file, ``kinds``
names the endings (docx and pdf by default).

Paths are those of local folders or of stores that pyarrow's file systems know.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "lodestone_documents"
SCHEMA = "filename string, path string, kind string, size long, content binary"
#: Bytes of files of a partition; a larger file is a partition of its own.
PARTITION_BYTES = 64 << 20

_ARROW = pa.schema([("filename", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


@dataclass(order=True)
class Found:
    """A listed file, in the order of a stream."""

    time: int
    path: str
    size: int = 0

    @property
    def filename(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def kind(self) -> str:
        return self.filename.rsplit(".", 1)[-1].lower() if "." in self.filename else ""


@dataclass
class Files(InputPartition):
    files: list[Found]


def _system(path: str):
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, kinds: set[str]) -> list[Found]:
    """Files of some kinds under a folder, oldest first; none where there is no folder."""
    system, root = _system(path)
    found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = [Found(x.mtime_ns or 0, x.path, x.size or 0) for x in found if x.type == pyarrow.fs.FileType.File]
    return sorted(f for f in files if f.kind in kinds)


def _dealt(files: list[Found]) -> list[Files]:
    """Partitions of about ``PARTITION_BYTES``, in order."""
    out: list[Files] = []
    size = PARTITION_BYTES
    for f in files:
        if size >= PARTITION_BYTES:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out


class _Contents:
    """What batch and stream share: the options, and reading a partition's files."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.kinds = {k.strip().lower() for k in options.get("kinds", "docx,pdf").split(",")}
        self.known, self.upto = options.get("known"), json.loads(options.get("upto", "null"))

    def new(self) -> list[Found]:
        files = listed(self.path, self.kinds)
        if self.upto:
            files = [f for f in files if (f.time, f.path) <= (self.upto["time"], self.upto["path"])]
        if self.known:
            system, root = _system(self.known)
            if system.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
                names = set(pyarrow.dataset.dataset(root, filesystem=system, format="parquet").to_table(columns=["filename"]).column(0).to_pylist())
                files = [f for f in files if f.filename not in names]
        return files

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        for f in partition.files:
            with system.open_input_stream(f.path) as stream:
                row = (f.filename, f.path, f.kind, f.size, stream.read())
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _ARROW)], schema=_ARROW)


class DocumentReader(_Contents, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _dealt(self.new()) or [Files([])]


class DocumentStream(_Contents, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.new()
        return {"time": files[-1].time, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = (start["time"], start["path"]), (end["time"], end["path"])
        return _dealt([f for f in self.new() if first < (f.time, f.path) <= last])


class DocumentSource(DataSource):
    """filename, path, kind, size and content of files under a folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)

    def streamReader(self, schema) -> DocumentStream:
        return DocumentStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
