"""Tables whose changes rewrite only what they touch.

Rows lie in buckets by a hash of their key, a folder each. A manifest, a small file with a number, says which folder holds
each bucket now. A change finds the buckets of its keys, reads those, writes their new rows beside, and makes
the next manifest, in one step that fails where another change was first: so readers see a change whole or not
at all, a change that broke leaves nothing that is read, and the second of two at once is told to run again.

Cases: keys that no row has insert; deleting absent keys changes nothing; null keys are keys like others, equal to each
other; a change without rows makes no manifest; an empty table is one without files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import logs
from ..operators.resolve import checkpointed

BUCKETS = 64
BUCKET = "_bucket"


class ChangedMeanwhileError(RuntimeError):
    """Another change made the manifest that this one wanted to make."""


@dataclass
class Manifest:
    """The state of a table: `folders` has the folder of each bucket that has rows."""

    number: int
    keys: list[str]
    buckets: int
    schema: dict
    folders: dict[str, str]


class KeyedTable:
    """A table in a folder of a store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The newest manifest."""
        names = [s.getPath().getName() for s in self._store().listStatus(self._path("manifests"))]
        newest = max(n for n in names if n.startswith("manifest-"))
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{newest}").collect())  # one small file
        return Manifest(**json.loads(text))

    def _publish(self, new: Manifest) -> None:
        """Makes a manifest: written under a name of its own, then given its number in one step that fails where that is taken."""
        store, final, beside = self._store(), self._path(f"manifests/manifest-{new.number:012d}"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = store.create(beside, True)
        out.write(bytearray(json.dumps(vars(new), sort_keys=True).encode()))
        out.close()
        try:
            if store.getScheme() == "file":  # Hadoop's local store renames over what is there; a link doesn't
                at = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(at(final), at(beside))
                store.delete(beside, False)
                made = True
            else:
                made = store.rename(beside, final)
        except Exception:
            if not store.exists(final):
                raise
            made = False
        if not made:
            store.delete(beside, False)
            raise ChangedMeanwhileError(f"{self.folder}: state {new.number} is there already")

    def _written(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Writes rows by bucket to a new folder; {bucket: folder} of those that have any."""
        name = f"data-{uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{name}")
        found = [s.getPath().getName() for s in self._store().listStatus(self._path(name))]
        return {n.split("=")[1]: f"{name}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    @classmethod
    def create(cls, rows: DataFrame, folder: str, keys: list[str], *, buckets: int = BUCKETS) -> KeyedTable:
        """Writes a table whose keys are unique."""
        table = cls(rows.sparkSession, folder)
        table._publish(Manifest(0, keys, buckets, json.loads(rows.schema.json()), table._written(rows, keys, buckets)))
        return table

    def read(self, buckets: set[str] | None = None, state: Manifest | None = None) -> DataFrame:
        """The rows, of some buckets or of all."""
        state = state or self.manifest()
        schema = StructType.fromJson(state.schema)
        paths = [f"{self.folder}/{f}" for b, f in sorted(state.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Replaces the buckets that the keys of `touched` lie in by `make` of their rows; gives those buckets."""
        state = self.manifest()
        at = touched.select(F.pmod(F.xxhash64(*state.keys), F.lit(state.buckets)).cast("string").alias("b")).distinct()
        own = {r["b"] for r in at.collect()}  # as many as there are buckets at most
        if not own:
            return []
        new = self._written(make(self.read(own, state)), state.keys, state.buckets)
        kept = {b: f for b, f in state.folders.items() if b not in own}
        self._publish(Manifest(state.number + 1, state.keys, state.buckets, state.schema, kept | new))
        return sorted(own, key=int)

    def upsert(self, changes: DataFrame, seq: str) -> list[str]:
        """The newest row of each key by seq; changes win ties. `changes` has the table's columns."""
        keys = self.manifest().keys
        changes = checkpointed(changes)  # read for the buckets and for the rows: both must see the same
        return self.change(changes, lambda rows: logs.upsert(rows, changes, keys, seq))

    def delete(self, gone: DataFrame) -> list[str]:
        """Rows whose keys are among those of `gone` go."""
        keys = self.manifest().keys
        gone = checkpointed(gone.select(*keys).distinct())

        def left(rows: DataFrame) -> DataFrame:
            same = F.lit(True)
            for k in keys:
                same &= rows[k].eqNullSafe(gone[k])
            return rows.join(gone, same, "left_anti")

        return self.change(gone, left)

    def update(self, keys: DataFrame, values: dict[str, object]) -> list[str]:
        """Sets columns, by expressions over the row, where the key is among those of `keys`."""
        names = self.manifest().keys
        hit = checkpointed(keys.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names))).distinct().withColumn("_hit", F.lit(True)))

        def changed(rows: DataFrame) -> DataFrame:
            same = F.lit(True)
            for i, k in enumerate(names):
                same &= rows[k].eqNullSafe(hit[f"_k{i}"])
            met = rows.join(hit, same, "left")
            return met.select(*(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))

        return self.change(hit.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(names))), changed)

    def tidy(self) -> int:
        """Removes data that the newest manifest doesn't name; gives how many folders went. Not while others read or change."""
        store, folders, gone = self._store(), set(self.manifest().folders.values()), 0
        used = {f.split("/")[0] for f in folders}
        for status in store.listStatus(self._path("")):
            name = status.getPath().getName()
            if not name.startswith("data-"):
                continue
            inside = [s.getPath() for s in store.listStatus(status.getPath()) if s.getPath().getName().startswith(BUCKET)]
            for path in inside:
                if name not in used or f"{name}/{path.getName()}" not in folders:
                    gone += store.delete(path, True)
            if name not in used:
                store.delete(status.getPath(), True)
        return gone
