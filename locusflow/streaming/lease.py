"""A lease on a folder of a store, so that one job at a time moves what the folder keeps.

Every lease is a file `lease-N`, made by the store in one step that fails where the name is taken; N, one more than the last,
is the holder's fence. A lease is live until it is released or its time since the last renewal is over, by the times
of the store's files. Before the holder moves anything it renews the lease, which fails where a higher one is there: a job that
paused beyond its time finds itself fenced off and stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SECONDS = 900


class LeaseHeldError(RuntimeError):
    """Another job holds the lease, or has taken it from this one."""


class Lease:
    """The lease with this fence on a folder."""

    def __init__(self, spark: SparkSession, folder: str, fence: int = 0):
        self.folder, self.fence = folder.rstrip("/"), fence
        self._jvm = spark._jvm
        self.store = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _made(self, fence: int):
        return self._path(f"lease-{fence:012d}")

    def _released(self, fence: int):
        return self._path(f"released-{fence:012d}")

    def leases(self) -> dict[int, int]:
        """Fences, and when each lease was made or last renewed, in milliseconds."""
        if not self.store.exists(self._path("")):
            return {}
        return {int(s.getPath().getName()[6:]): s.getModificationTime() for s in self.store.listStatus(self._path("")) if s.getPath().getName().startswith("lease-")}

    def now(self) -> int:
        """The store's time in milliseconds: that of a file just written."""
        beside = self._path(f".clock-{uuid.uuid4().hex}")
        self.store.create(beside, True).close()
        time = self.store.getFileStatus(beside).getModificationTime()
        self.store.delete(beside, False)
        return time

    def make(self) -> bool:
        """Makes the lease's file; false where another job has made it."""
        path = self._made(self.fence)
        self.store.mkdirs(path.getParent())
        if self.store.getScheme() == "file":  # Hadoop's local store looks first and writes then; the system does both in one step
            return self._jvm.java.io.File(path.toUri().getPath()).createNewFile()
        try:
            self.store.create(path, False).close()
        except Exception:
            if self.store.exists(path):
                return False
            raise
        return True

    def renew(self) -> None:
        """Makes the lease young again; fails where a higher one is there."""
        if max(self.leases(), default=0) > self.fence:
            raise LeaseHeldError(f"{self.folder}: another job has taken the lease from number {self.fence}")
        self.store.setTimes(self._made(self.fence), self.now(), -1)

    def release(self) -> None:
        self.store.create(self._released(self.fence), True).close()


@contextmanager
def held(spark: SparkSession, folder: str, *, seconds: int = SECONDS) -> Iterator[Lease]:
    """The lease on a folder while the block runs; fails where a live one is there."""
    look = Lease(spark, folder)
    made = look.leases()
    last = max(made, default=0)
    if last and not look.store.exists(look._released(last)) and look.now() - made[last] < seconds * 1000:
        raise LeaseHeldError(f"{folder}: lease {last} is held")
    own = Lease(spark, folder, last + 1)
    if not own.make():
        raise LeaseHeldError(f"{folder}: another job was first")
    try:
        yield own
    finally:
        own.release()
