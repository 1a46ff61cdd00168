"""A table by key that takes changes without being rewritten: base files, change files, merged when read.

Rows lie in folders by a hash of their key. A change set (rows, or tombstones for
keys that go) is written beside the base, into the folders of its own keys only;
a reader takes the base without the changed keys, which are few and sent to every
task, and the latest row of each changed key: the base is not shuffled. When more
than ``most_changes`` rows of changes stand beside the base, the folders they
touch, and no others, are written anew.

A small file per version says which folders count. It is created, never
overwritten, so of two writers at once the second fails and may try again, and a
write that breaks off leaves the version before it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import file_system

#: Rows of changes that may stand beside the base; their keys are broadcast by readers.
MOST_CHANGES = 500_000


@dataclass
class KeyedTable:
    """A table in a folder; ``latest`` is the column that decides between rows of a key in one change set."""

    spark: SparkSession
    path: str
    key: str = ""
    latest: str | None = None
    most_changes: int = MOST_CHANGES
    state: dict = field(default_factory=dict)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, latest: str | None = None, buckets: int = 64, most_changes: int = MOST_CHANGES) -> KeyedTable:
        """A new table of ``rows``: of each key the latest; rows without a key are left out."""
        table = cls(rows.sparkSession, path, key, latest, most_changes)
        table.state = {"version": 0, "key": key, "latest": latest, "buckets": buckets, "schema": rows.schema.json(), "base": {}, "changes": []}
        name = f"base-{uuid.uuid4().hex}"
        table._write(table._one_per_key(rows), name)
        table.state["base"] = {str(b): name for b in table._buckets_in(name)}
        table._commit()
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, most_changes: int = MOST_CHANGES) -> KeyedTable:
        """The table's last version."""
        table = cls(spark, path, most_changes=most_changes)
        system, at = file_system(spark, f"{path}/_versions")
        last = max(int(x.getPath().getName().split(".")[0]) for x in system.listStatus(at) if x.getPath().getName().endswith(".json"))
        _, file = file_system(spark, f"{path}/_versions/{last}.json")
        stream = system.open(file)
        table.state = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        stream.close()
        table.key, table.latest = table.state["key"], table.state["latest"]
        return table

    def read(self) -> DataFrame:
        """The rows as they are now."""
        return self._merged(None)

    def lookup(self, keys: list) -> DataFrame:
        """The rows of a few keys: only their folders are read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {self._schema()[self.key].dataType.simpleString()}").select(self._bucket()).distinct().collect()]
        return self._merged(buckets).where(F.col(self.key).isin(keys))

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of their key or are added; a column that they lack is null."""
        missing = [c for c in self._schema().fieldNames() if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast(self._schema()[c].dataType) for c in missing})
        self._change(self._one_per_key(rows).select(*self._schema().fieldNames(), F.lit(False).alias("__gone")))

    def delete(self, keys: DataFrame) -> None:
        """Rows of these keys go; a key that is not there changes nothing."""
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema() if f.name != self.key]
        gone = keys.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        self._change(gone.select(self.key, *others, F.lit(True).alias("__gone")).select(*self._schema().fieldNames(), "__gone"))

    def compact(self) -> list[int]:
        """Write the folders anew that changes touch; which ones."""
        touched = sorted({b for c in self.state["changes"] for b in c["buckets"]})
        if touched:
            name = f"base-{uuid.uuid4().hex}"
            self._write(self._merged(touched), name)
            written = self._buckets_in(name)
            self.state["base"] = {b: n for b, n in self.state["base"].items() if int(b) not in touched} | {str(b): name for b in written}
            self.state["changes"] = []
            self._commit()
        return touched

    def _change(self, rows: DataFrame) -> None:
        name = f"change-{uuid.uuid4().hex}"
        self._write(rows, name)
        buckets = self._buckets_in(name)
        if not buckets:
            return
        count = self.spark.read.parquet(f"{self.path}/{name}").count()
        self.state["changes"].append({"name": name, "buckets": buckets, "rows": count})
        self._commit()
        if sum(c["rows"] for c in self.state["changes"]) > self.most_changes:
            self.compact()

    def _schema(self):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(self.state["schema"]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.state["buckets"])).cast("int").alias("__bucket")

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        whole = F.struct(*([F.col(self.latest).alias("__latest")] if self.latest else []), *rows.columns)
        best = rows.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("__key")).agg(F.max(whole).alias("r"))
        return best.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("__bucket", self._bucket()).write.partitionBy("__bucket").parquet(f"{self.path}/{name}")

    def _buckets_in(self, name: str) -> list[int]:
        system, at = file_system(self.spark, f"{self.path}/{name}")
        return sorted(int(x.getPath().getName().split("=")[1]) for x in system.listStatus(at) if x.getPath().getName().startswith("__bucket="))

    def _merged(self, buckets: list[int] | None) -> DataFrame:
        """Base and changes of some folders, or of all."""
        schema = self._schema()
        wanted = lambda b: buckets is None or int(b) in buckets
        paths = [f"{self.path}/{n}/__bucket={b}" for b, n in self.state["base"].items() if wanted(b)]
        base = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        parts = []
        for at, change in enumerate(self.state["changes"]):
            own = [f"{self.path}/{change['name']}/__bucket={b}" for b in change["buckets"] if wanted(b)]
            if own:
                parts.append(self.spark.read.schema(self._schema().add("__gone", "boolean")).parquet(*own).withColumn("__at", F.lit(at)))
        if not parts:
            return base
        changes = parts[0]
        for part in parts[1:]:
            changes = changes.unionByName(part)
        last = changes.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*schema.fieldNames(), "__gone"), "__at").alias("r"))
        # Bounded: compaction begins at ``most_changes`` rows.
        kept = base.join(F.broadcast(changes.select(self.key)), self.key, "left_anti").select(*schema.fieldNames())
        return kept.unionByName(last.where("NOT r.__gone").select(*[F.col(f"r.{c}").alias(c) for c in schema.fieldNames()]))

    def _commit(self) -> None:
        """The next version, there as a whole or not at all."""
        state = self.state | {"version": self.state["version"] + 1}
        system, final = file_system(self.spark, f"{self.path}/_versions/{state['version']}.json")
        if system.exists(final):
            raise RuntimeError("another writer made a version: open the table again")
        _, partial = file_system(self.spark, f"{self.path}/_versions/{state['version']}.{uuid.uuid4().hex}.partial")
        out = system.create(partial, True)
        out.write(json.dumps(state).encode("utf-8"))
        out.close()
        if not system.rename(partial, final):
            raise RuntimeError("another writer made a version: open the table again")
        self.state = state
