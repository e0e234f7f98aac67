"""Tables laid out for a kind of question: by place for boxes, and derived tables that are written once.

A catalogue is written in the order of a curve through a grid of places (bits of latitude and longitude in turn), dealt
to files by ranges of it. So every row group covers a small box, its Parquet statistics say so, and the plain
comparisons of a box skip all others. Rows without a place come last and no box finds them.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

#: Bits of either coordinate in the curve: cells of some 150 m.
CURVE_BITS = 18
#: Bytes of a row group before compression: small, for it is what a box reads at least.
GROUP_BYTES = 1 << 20
#: Bytes of a file, as the optimiser reckons the rows.
FILE_BYTES = 128 << 20
#: Every other bit of 64, by the width of the groups that it keeps together.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _apart(x: Column) -> Column:
    """The bits of a number below 2^32, each two places from the next."""
    for step, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, step)).bitwiseAND(F.lit(mask))
    return x


def curve(lat: Column, lon: Column, bits: int = CURVE_BITS) -> Column:
    """The place on the curve; null without a coordinate."""
    most = (1 << bits) - 1
    cell = lambda x, low, span: F.least(F.greatest(F.floor((x - low) / span * (1 << bits)), F.lit(0)), F.lit(most)).cast("long")
    place = _apart(cell(lat, -90.0, 180.0)) + F.shiftleft(_apart(cell(lon, -180.0, 360.0)), 1)
    return F.when(lat.isNotNull() & lon.isNotNull(), place)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def write_by_place(df: DataFrame, path: str, *, lat: str = "lat", lon: str = "lon", group_bytes: int = GROUP_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes the rows in the order of the curve."""
    files = max(1, min(input_bytes(df) // file_bytes, 1 << 16))
    placed = df.withColumn("_curve", F.coalesce(curve(F.col(lat), F.col(lon)), F.lit((1 << 62) - 1)))
    dealt = placed.repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve")
    dealt.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.size", group_bytes >> 4).parquet(path)


def within(rows: DataFrame, at: tuple[float, float], km: float, *, lat: str = "lat", lon: str = "lon", columns: list[str] | None = None) -> DataFrame:
    """The rows within km of a place; of a table that `write_by_place` wrote, only row groups whose boxes meet the circle's are read."""
    rows = rows.where(geo.box(F.col(lat), F.col(lon), *at, km)).where(geo.haversine_km(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lon)) <= km)
    return rows.select(*columns) if columns else rows


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only on local threads, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
    return _local[context.applicationId]


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of a table's files: another one once the table has been written anew."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [store.getFileStatus(place)] if store.getFileStatus(place).isFile() else list(store.listStatus(place))
    told = sorted(f"{x.getPath()}|{x.getLen()}|{x.getModificationTime()}" for x in found)
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:24]


def once(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """The folder of what `build(folder)` derives from a table, written when nothing derived from this state of it is there.

    It is written beside and then takes its name in one step, so that no reader meets a part of it; of two
    writers one's work stays.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = f"{shared_folder(spark)}/derived/{name}-{fingerprint(spark, source)}"
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path(folder)):
        beside = f"{folder}.{uuid.uuid4().hex}"
        build(beside)
        if store.exists(path(folder)) or not store.rename(path(beside), path(folder)):
            store.delete(path(beside), True)
    return folder
