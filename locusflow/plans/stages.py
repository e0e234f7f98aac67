"""A runner of batch stages: names, tags, skipping of finished outputs, manifests and comparisons."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluation import content_hash
from ..sources.writers import text_file

Build = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass
class Stage:
    name: str
    build: Build
    needs: list[str] = field(default_factory=list)
    tags: frozenset[str] = frozenset()  # network, paid, long, frozen


@dataclass
class Runner:
    """Stages write Parquet under `root`; a manifest holds rows and a content hash of each output."""

    spark: SparkSession
    root: str
    stages: list[Stage]

    def __post_init__(self) -> None:
        known: set[str] = set()
        for s in self.stages:
            if missing := set(s.needs) - known:
                raise ValueError(f"{s.name} needs {sorted(missing)}, declared later or never")
            known.add(s.name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def done(self, name: str) -> bool:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)

    def expand(self, names: list[str]) -> list[Stage]:
        """The named stages and all that they need, in order of declaration; `all` means every one."""
        wanted, by_name = set(), {s.name: s for s in self.stages}
        todo = list(by_name) if names == ["all"] else list(names)
        while todo:
            n = todo.pop()
            if n not in by_name:
                raise KeyError(n)
            if n not in wanted:
                wanted.add(n)
                todo += by_name[n].needs
        return [s for s in self.stages if s.name in wanted]

    def status(self) -> dict[str, str]:
        return {s.name: "done" if self.done(s.name) else "missing" for s in self.stages}

    def run(self, names: list[str], *, allow: set[str] = frozenset(), force: bool = False) -> dict[str, dict]:
        out = {}
        for s in self.expand(names):
            if self.done(s.name) and not force:
                out[s.name] = {"state": "skipped"}
                continue
            if refused := s.tags - set(allow):
                raise PermissionError(f"{s.name} is tagged {sorted(refused)}; allow it to run it")
            began = time.time()
            inputs = {n: self.spark.read.parquet(self.path(n)) for n in s.needs}
            s.build(self.spark, inputs).write.mode("overwrite").parquet(self.path(s.name))
            out[s.name] = {"state": "run", "seconds": round(time.time() - began, 1)}
        return out

    def manifest(self) -> dict[str, dict]:
        return {s.name: content_hash(self.spark.read.parquet(self.path(s.name))).first().asDict() for s in self.stages if self.done(s.name)}

    def save_manifest(self, path: str) -> dict[str, dict]:
        now = self.manifest()
        text_file(self.spark, path, json.dumps(now, indent=1, sort_keys=True))
        return now

    @staticmethod
    def compare(before: dict[str, dict], after: dict[str, dict]) -> dict[str, str]:
        def kind(n: str) -> str:
            if n not in before or n not in after:
                return "added" if n in after else "removed"
            return "same" if before[n] == after[n] else "changed"

        return {n: kind(n) for n in sorted(before.keys() | after.keys())}
