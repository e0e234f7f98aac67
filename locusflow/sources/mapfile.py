"""Map files (protocol-buffer extracts of nodes, ways and relations) as a Spark source.

The driver walks a file's blob headers, which say how long each blob is, and deals runs of blobs to tasks; a task seeks
to its run, inflates a blob at a time and decodes its delta-coded integers as arrays. What needs more than one object,
the middle of a way or of an area, is joins and sums in Spark: ways meet the places of their nodes by id, with
coordinates as whole units of 1e-7 degrees, so that sums don't depend on their order.

Cases: an object without tags has an empty map; nodes that a way names but no file holds are left out of its
middle, and a way or area without any is left out itself; an object in several files of one read is the last
file's, by name; blobs of types other than data are passed over; an empty file gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "map_file"
#: Bytes of a task's run of blobs; a longer blob is a run of its own.
RUN_BYTES = 32 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 8_192
#: Field numbers of the file format's messages, by message.
HEADER = {"type": 1, "size": 3}
BLOB = {"raw": 1, "zlib": 3}
DATA = {"strings": 1, "group": 2, "granularity": 17, "lat_offset": 19, "lon_offset": 20}
GROUP = {"node": 1, "dense": 2, "way": 3, "relation": 4}
OBJECT = {"id": 1, "keys": 2, "values": 3, "lat": 8, "lon": 9, "refs": 8, "roles": 8, "members": 9, "types": 10}
DENSE = {"ids": 1, "lats": 8, "lons": 9, "tags": 10}
MEMBER_KINDS = ("n", "w", "r")
#: Fixed value: coordinates in the file count nanodegrees; ours count units of 1e-7 degrees.
NANO = 100

SCHEMA = "file int, kind string, id bigint, tags map<string,string>, lat bigint, lon bigint, refs array<bigint>, members array<struct<kind:string,id:bigint,role:string>>"
_MEMBER = pa.struct([("kind", pa.string()), ("id", pa.int64()), ("role", pa.string())])
_TYPES = {"file": pa.int32(), "kind": pa.string(), "id": pa.int64(), "tags": pa.map_(pa.string(), pa.string()), "lat": pa.int64(), "lon": pa.int64(), "refs": pa.list_(pa.int64()), "members": pa.list_(_MEMBER)}


def varints(data) -> np.ndarray:
    """All variable-length integers of a packed field, as unsigned 64-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    length = ends - starts + 1
    for k in range(int(length.max(initial=0))):
        own = np.flatnonzero(length > k)
        out[own] |= (raw[starts[own] + k].astype(np.uint64) & np.uint64(0x7F)) << np.uint64(7 * k)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag-coded numbers with their signs."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def deltas(data) -> np.ndarray:
    """A packed field of signed differences, added up."""
    return np.cumsum(signed(varints(data)))


def fields(message) -> Iterator[tuple[int, object]]:
    """(field number, bytes or number) of a message, in order."""
    at, end = 0, len(message)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
            continue
        size = number() if wire == 2 else {1: 8, 5: 4}[wire]
        yield tag >> 3, message[at : at + size]
        at += size


def one(message, wanted: dict[str, int]) -> dict[str, object]:
    """The last value of each wanted field."""
    names = {n: k for k, n in wanted.items()}
    return {names[n]: v for n, v in fields(message) if n in names}


@dataclass
class Run(InputPartition):
    """Blobs that follow each other in a file."""

    file: int
    path: str
    begin: int
    size: int


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[str]:
    """The map files that a path names: itself, or those of a folder, by name."""
    from pyarrow import fs

    store, inside = _store(path)
    if store.get_file_info(inside).type != fs.FileType.Directory:
        return [path]
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(inside)) if x.is_file and x.base_name.endswith(".pbf"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def headers(file) -> Iterator[tuple[int, int, bytes]]:
    """(place, bytes, type) of every blob with its header, reading the headers alone."""
    at = 0
    while len(size := file.read(4)) == 4:
        head = one(memoryview(file.read(int.from_bytes(size, "big"))), HEADER)
        whole = 4 + int.from_bytes(size, "big") + int(head["size"])
        yield at, whole, bytes(head["type"])
        at += whole
        file.seek(at)


def runs(number: int, path: str, most: int = RUN_BYTES) -> list[Run]:
    """The data blobs of a file in runs of about `most` bytes."""
    store, inside = _store(path)
    out: list[Run] = []
    with store.open_input_file(inside) as file:
        for at, size, kind in headers(file):
            if kind != b"OSMData":
                continue
            last = out[-1] if out else None
            if last and last.begin + last.size == at and last.size + size <= most:
                last.size += size
            else:
                out.append(Run(number, path, at, size))
    return out


def inflated(blob) -> memoryview:
    got = one(blob, BLOB)
    if "raw" in got:
        return memoryview(got["raw"])
    if "zlib" not in got:
        raise ValueError("only blobs that are stored as they are or with zlib are read")
    return memoryview(zlib.decompress(got["zlib"]))


class Block:
    """The objects of one inflated blob."""

    def __init__(self, data: memoryview, keys: set[bytes]):
        self.groups, strings, found = [], b"", {}
        for n, value in fields(data):
            if n == DATA["strings"]:
                strings = value
            elif n == DATA["group"]:
                self.groups.append(value)
            else:
                found[n] = value
        self.strings = [bytes(s) for n, s in fields(strings) if n == 1]
        self.granularity, self.lat_offset, self.lon_offset = (found.get(DATA[k], d) for k, d in (("granularity", 100), ("lat_offset", 0), ("lon_offset", 0)))
        self.wanted = {i for i, s in enumerate(self.strings) if s in keys} if keys else None

    def units(self, x, offset: int):
        """Coordinates of the file as units of 1e-7 degrees."""
        return (offset + self.granularity * x) // NANO

    def tags(self, keys, values) -> list[tuple[str, str]] | None:
        """The tags, or None of an object without a wanted key."""
        keys = varints(keys).tolist() if len(keys) else []
        if self.wanted is not None and not self.wanted.intersection(keys):
            return None
        return [(self.strings[k].decode(), self.strings[v].decode()) for k, v in zip(keys, varints(values).tolist() if keys else [], strict=True)]

    def dense(self, group, places: bool) -> Iterator[tuple]:
        got = one(group, DENSE)
        ids = deltas(got.get("ids", b""))
        lats, lons = self.units(deltas(got.get("lats", b"")), self.lat_offset), self.units(deltas(got.get("lons", b"")), self.lon_offset)
        if places:
            yield from zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True)
            return
        flat = varints(got.get("tags", b"")).astype(np.int64)  # key, value, ..., 0 for each node; nothing where no node has tags
        stops, at, node = [], 0, 0
        listed_ = flat.tolist()
        if not listed_:
            if self.wanted is None:
                yield from ((i, a, o, []) for i, a, o in zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True))
            return
        while node < len(ids):
            stops = []
            while listed_[at]:
                stops.append((listed_[at], listed_[at + 1]))
                at += 2
            at += 1
            if self.wanted is None or any(k in self.wanted for k, _ in stops):
                yield int(ids[node]), int(lats[node]), int(lons[node]), [(self.strings[k].decode(), self.strings[v].decode()) for k, v in stops]
            node += 1

    def rows(self, kinds: set[str]) -> Iterator[tuple]:
        """(kind, id, tags, lat, lon, refs, members); of kind `p` every node's place, without tags."""
        for group in self.groups:
            for n, message in fields(group):
                if n == GROUP["dense"]:
                    if "n" in kinds:
                        yield from (("n", i, t, a, o, None, None) for i, a, o, t in self.dense(message, False))
                    if "p" in kinds:
                        yield from (("p", i, None, a, o, None, None) for i, a, o in self.dense(message, True))
                    continue
                kind = {GROUP["node"]: "n", GROUP["way"]: "w", GROUP["relation"]: "r"}.get(n)
                if kind is None or (kind not in kinds and not (kind == "n" and "p" in kinds)):
                    continue
                yield from self.single(kind, message, kinds)

    def single(self, kind: str, message, kinds: set[str]) -> Iterator[tuple]:
        got = dict(fields(message))
        id_ = got[OBJECT["id"]]
        if kind == "n":
            id_, lat, lon = (int(signed(np.array([got.get(OBJECT[k], 0)], np.uint64))[0]) for k in ("id", "lat", "lon"))
            lat, lon = self.units(lat, self.lat_offset), self.units(lon, self.lon_offset)
            if "p" in kinds:
                yield "p", id_, None, lat, lon, None, None
            if "n" not in kinds:
                return
        tags = self.tags(got.get(OBJECT["keys"], b""), got.get(OBJECT["values"], b""))
        if tags is None:
            return
        if kind == "n":
            yield kind, id_, tags, lat, lon, None, None
        elif kind == "w":
            yield kind, id_, tags, None, None, deltas(got.get(OBJECT["refs"], b"")).tolist(), None
        else:
            ids, roles, types = deltas(got.get(OBJECT["members"], b"")).tolist(), varints(got.get(OBJECT["roles"], b"")).tolist(), varints(got.get(OBJECT["types"], b"")).tolist()
            yield kind, id_, tags, None, None, None, [{"kind": MEMBER_KINDS[t], "id": i, "role": self.strings[r].decode()} for i, r, t in zip(ids, roles, types, strict=True)]


class MapFileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.kinds = set(options.get("kinds", "n,w,r").split(","))
        self.keys = {k.encode() for k in options.get("keys", "").split(",") if k}
        self.run_bytes = int(options.get("runBytes", RUN_BYTES))

    def partitions(self):
        return [run for number, path in enumerate(listed(self.path)) for run in runs(number, path, self.run_bytes)]

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no blob at all
            return
        store, inside = _store(partition.path)
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [[partition.file] * len(held), *zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values(), strict=True)], list(_TYPES))

        with store.open_input_file(inside) as file:
            file.seek(partition.begin)
            left = partition.size
            while left:
                size = int.from_bytes(file.read(4), "big")
                head = one(memoryview(file.read(size)), HEADER)
                blob = memoryview(file.read(int(head["size"])))
                left -= 4 + size + int(head["size"])
                for row in Block(inflated(blob), self.keys).rows(self.kinds):
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield batch()
        if held:
            yield batch()


class MapFile(DataSource):
    """`path`: a file, or a folder of them. `kinds`: of n, w, r and p (every node's place, without tags). `keys`: only objects with one of these tag keys. `runBytes`: bytes of a task's run."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MapFileReader:
        return MapFileReader(self.options)


def objects(spark: SparkSession, path: str, kinds: str = "n,w,r", keys: list[str] | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The objects of map files, a task a run of blobs."""
    spark.dataSource.register(MapFile)
    return spark.read.format(FORMAT).options(kinds=kinds, keys=",".join(keys or []), runBytes=run_bytes).load(path)


def _middles(ways: DataFrame, places: DataFrame) -> DataFrame:
    """(file, id, n, lat, lon): number and sums of the places of each way's known nodes, repeats included."""
    refs = ways.select("file", "id", F.explode("refs").alias("ref"))
    met = refs.join(places.select("file", F.col("id").alias("ref"), "lat", "lon"), ["file", "ref"])
    return met.groupBy("file", "id").agg(F.count("*").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"))


def _degrees(total: Column, n: Column) -> Column:
    return total / n / F.lit(1e7)


def _closings(parts):
    """The place that closes each outer ring (its least by lon, lat), or null where the parts of an area don't close.

    A part has the ids of its first and last node and its own least place. Every ring is a set of parts that
    hang together at their ends; it closes if each end is met an even number of times.
    """
    import pandas as pd

    def closed(ways) -> list[dict] | None:
        leader: dict[int, int] = {}

        def root(x: int) -> int:
            while leader.setdefault(x, x) != x:
                leader[x] = x = leader[leader[x]]
            return x

        met: dict[int, int] = {}
        for w in ways:
            leader[root(w["first"])] = root(w["last"])
            for end in (w["first"], w["last"]):
                met[end] = met.get(end, 0) + 1
        if any(n % 2 for n in met.values()):
            return None
        least: dict[int, tuple[int, int]] = {}
        for w in ways:
            own = (w["least"]["lon"], w["least"]["lat"])
            least[root(w["first"])] = min(least.get(root(w["first"]), own), own)
        return [{"lat": lat, "lon": lon} for lon, lat in least.values()]

    return pd.Series([closed(list(x)) for x in parts])


def _areas(relations: DataFrame, ways: DataFrame, places: DataFrame) -> DataFrame:
    """(file, id, n, lat, lon), all doubled, of areas: the vertices of their outer rings, each ring's closing vertex twice, as a ring lists it."""
    outer = relations.where(F.col("tags")["type"].isin("multipolygon", "boundary")).select("file", F.col("id").alias("area"), F.explode("members").alias("m"))
    outer = outer.where((F.col("m.kind") == "w") & F.col("m.role").isin("outer", "")).select("file", "area", F.col("m.id").alias("id")).distinct()
    parts = outer.join(ways.select("file", "id", "refs"), ["file", "id"]).where(F.size("refs") > 1)
    inner = parts.select("file", "area", "id", F.get("refs", F.lit(0)).alias("first"), F.element_at("refs", -1).alias("last"), (F.size("refs") - 1).alias("end"), F.posexplode("refs").alias("place", "ref"))
    inner = inner.withColumn("weight", F.when((F.col("place") == 0) | (F.col("place") == F.col("end")), 1).otherwise(2))  # where two parts meet, each has half
    met = inner.join(places.select("file", F.col("id").alias("ref"), "lat", "lon"), ["file", "ref"])
    part = met.groupBy("file", "area", "id", "first", "last").agg(F.sum("weight").alias("n"), F.sum(F.col("lat") * F.col("weight")).alias("lat"), F.sum(F.col("lon") * F.col("weight")).alias("lon"), F.min(F.struct("lon", "lat")).alias("least"))
    whole = part.groupBy("file", "area").agg(F.sum("n").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.collect_list(F.struct("first", "last", "least")).alias("parts"))  # the members of one relation
    ring = whole.withColumn("closing", F.pandas_udf(_closings, "array<struct<lat:bigint,lon:bigint>>")("parts")).where(F.col("closing").isNotNull())
    add = lambda c: F.col(c) + F.aggregate("closing", F.lit(0).cast("long"), lambda a, p: a + 2 * p[c])
    return ring.select("file", F.col("area").alias("id"), (F.col("n") + 2 * F.size("closing")).alias("n"), add("lat").alias("lat"), add("lon").alias("lon"))


def map_places(spark: SparkSession, path: str, keys: list[str], wanted: Column, *, kinds: str = "n,w", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(osm_id, kind, tags, name, lat, lon) of the objects with one of the keys for which `wanted`, of their tags, holds.

    A node is at its place, a way (w) at the mean of its nodes, an area (r) at the mean of its outer rings' vertices.
    """
    rows = objects(spark, path, kinds, [*keys, *(["type"] if "r" in kinds else [])], run_bytes).where(wanted)
    parts = [rows.where("kind = 'n'").select("file", "kind", "id", "tags", _degrees(F.col("lat"), F.lit(1)).alias("lat"), _degrees(F.col("lon"), F.lit(1)).alias("lon"))]
    places = objects(spark, path, "p", None, run_bytes)
    for kind, middles in (("w", lambda own: _middles(own, places)), ("r", lambda own: _areas(own, objects(spark, path, "w", None, run_bytes), places))):
        if kind in kinds.split(","):
            own = rows.where(F.col("kind") == kind)
            at = middles(own).select("file", "id", _degrees(F.col("lat"), F.col("n")).alias("lat"), _degrees(F.col("lon"), F.col("n")).alias("lon"))
            parts.append(own.select("file", "kind", "id", "tags").join(at, ["file", "id"]).select(*parts[0].columns))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    last = found.groupBy("kind", "id").agg(F.max_by(F.struct("tags", "lat", "lon"), "file").alias("x"))
    return last.select(F.concat("kind", F.col("id").cast("string")).alias("osm_id"), "kind", "x.tags", F.map_filter("x.tags", lambda k, _: k.startswith("name")).alias("name"), "x.lat", "x.lon")


#: Amenities of eateries.
EATERIES = ("restaurant", "fast_food", "cafe", "pub", "bar", "food_court", "ice_cream")


def eateries(spark: SparkSession, path: str, **options) -> DataFrame:
    """Eateries among nodes and ways."""
    return map_places(spark, path, ["amenity"], F.col("tags")["amenity"].isin(*EATERIES), **options)


#: Tag keys that make a sight, and which values of each do.
SIGHTS = {
    "tourism": ("attraction", "museum", "gallery", "viewpoint", "zoo", "aquarium", "theme_park", "artwork"),
    "historic": (),
    "amenity": ("place_of_worship", "public_bath"),
    "leisure": ("park", "garden", "nature_reserve", "sauna"),
    "natural": ("beach", "peak", "hot_spring"),
    "waterway": ("waterfall",),
    "shop": ("department_store", "mall", "gift", "variety_store", "chemist", "electronics", "anime", "hobby", "games", "video_games"),
}
#: A supermarket counts where its name or brand has this pattern.
DISCOUNT = "(?iu)ドン・?キホーテ|MEGAドン|Don Quijote"


def sights(spark: SparkSession, path: str, **options) -> DataFrame:
    """Sights among nodes, ways and areas."""
    tag = lambda k: F.col("tags")[k]
    wanted = (tag("shop") == "supermarket") & F.concat(F.coalesce(tag("name"), F.lit("")), F.coalesce(tag("brand"), F.lit(""))).rlike(DISCOUNT)
    for key, values in SIGHTS.items():
        wanted = wanted | (tag(key).isin(*values) if values else tag(key).isNotNull())
    return map_places(spark, path, list(SIGHTS), F.coalesce(wanted, F.lit(False)), kinds="n,w,r", **options)


def stations(spark: SparkSession, path: str, **options) -> DataFrame:
    """Named station nodes: (osm_id, name, operator, station, lat, lon)."""
    found = map_places(spark, path, ["railway"], (F.col("tags")["railway"] == "station") & F.col("tags")["name"].isNotNull(), kinds="n", **options)
    return found.select("osm_id", "name", F.col("tags")["operator"].alias("operator"), F.col("tags")["station"].alias("station"), "lat", "lon")
