"""Address look-up files: a binary search tree over address bits whose leaves point at records, and rows found in it.

The file is read by Spark as bytes, a task a file, and walked from its root: every leaf with a record is a row (prefix,
record), the prefix written as the bits that lead to it. No leaf's prefix begins another's, so an address has at most one,
and it is found by equality: the address gives the first bits of itself for the lengths that the tree has, and meets the
prefixes in a join that Spark deals out by them. IPv4 addresses are looked up where a tree of IPv6 keeps them, after 96 zero
bits.

Cases: an address that isn't one, null, or that no leaf holds has no record; equal addresses are looked up once; an IPv6
address has no record in a tree of IPv4; a file without the closing mark of the format is an error.
"""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the file format: the mark before the metadata, the zero bytes between tree and data, and the types of values.
MARK, GAP = b"\xab\xcd\xefMaxMind.com", 16
POINTER, TEXT, DOUBLE, BYTES, U16, U32, MAP, I32, U64, U128, ARRAY, BOOL, FLOAT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15
#: What is added to a pointer's or a size's own bits, by how many bytes more it has.
POINTER_BASE, SIZE_BASE = (0, 2048, 526336, 0), (29, 285, 65821)


class Values:
    """Values of a data section."""

    def __init__(self, data: memoryview):
        self.data = data

    def number(self, at: int, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.data[at : at + n], "big", signed=signed)

    def read(self, at: int) -> tuple[object, int]:
        """(value, place after it)."""
        first = self.data[at]
        at += 1
        kind, size = first >> 5, first & 31
        if kind == POINTER:
            more = size >> 3 & 3
            low = self.number(at, more + 1) + (0 if more == 3 else (size & 7) << 8 * (more + 1))
            return self.read(low + POINTER_BASE[more])[0], at + more + 1
        if kind == 0:
            kind, at = 7 + self.data[at], at + 1
        if size > 28:
            more = size - 28
            size, at = self.number(at, more) + SIZE_BASE[more - 1], at + more
        if kind == MAP:
            out = {}
            for _ in range(size):
                key, at = self.read(at)
                out[key], at = self.read(at)
            return out, at
        if kind == ARRAY:
            items = []
            for _ in range(size):
                item, at = self.read(at)
                items.append(item)
            return items, at
        if kind == BOOL:
            return bool(size), at
        body = bytes(self.data[at : at + size])
        if kind == TEXT:
            return body.decode(), at + size
        if kind in (DOUBLE, FLOAT):
            import struct

            return struct.unpack(">d" if kind == DOUBLE else ">f", body)[0], at + size
        if kind == BYTES:
            return body.hex(), at + size
        return int.from_bytes(body, "big", signed=kind == I32 and size == 4), at + size


def metadata(content: bytes) -> dict:
    at = content.rfind(MARK)
    if at < 0:
        raise ValueError("no look-up file: its closing mark is missing")
    return Values(memoryview(content)[at + len(MARK) :]).read(0)[0]


def leaves(content: bytes) -> Iterator[tuple[str, str]]:
    """(prefix as bits, record as JSON) of every leaf with a record, in the order of the prefixes."""
    meta = metadata(content)
    count, bits = meta["node_count"], meta["record_size"]
    width, view = bits // 4, memoryview(content)
    data = Values(view[count * width + GAP :])
    records: dict[int, str] = {}

    def branch(node: int, side: int) -> int:
        at = node * width
        if bits == 28:  # the middle byte has four more bits of either record
            own = int.from_bytes(view[at + 4 * side : at + 4 * side + 3], "big")
            middle = view[at + 3]
            return own | (middle >> 4 if side == 0 else middle & 15) << 24
        half = width // 2
        return int.from_bytes(view[at + half * side : at + half * (side + 1)], "big")

    left = [("", 0)]
    while left:
        prefix, node = left.pop()
        if node < count:
            left += [(prefix + "1", branch(node, 1)), (prefix + "0", branch(node, 0))]
        elif node > count:
            if node not in records:
                records[node] = json.dumps(data.read(node - count - GAP)[0], ensure_ascii=False, sort_keys=True)
            yield prefix, records[node]


def prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(ip_version, prefix, record): the leaves of look-up files; a record is JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                version, held = metadata(content)["ip_version"], []
                for leaf in leaves(content):
                    held.append(leaf)
                    if len(held) == 8_192:
                        yield _batch(version, held)
                        held = []
                yield _batch(version, held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "ip_version int, prefix string, record string")


def _batch(version: int, held: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([version] * len(held), pa.int32()), pa.array([p for p, _ in held], pa.string()), pa.array([r for _, r in held], pa.string())], ["ip_version", "prefix", "record"])


def address_bits(text: str | None, version: int) -> str | None:
    """The bits that lead to an address in a tree of this version; None of no address, or of IPv6 in a tree of IPv4."""
    try:
        address = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    if version == 4 and address.version == 6:
        return None
    return f"{int(address):0{32 if version == 4 else 128}b}"


def located(rows: DataFrame, tree: DataFrame, address: str, *, record: str = "record") -> DataFrame:
    """The rows with the record of their address, null where there is none. `tree`: of one file."""
    shape = tree.agg(F.max("ip_version").alias("version"), F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths")).first()  # at most 129 lengths
    version, lengths = shape["version"] or 4, shape["lengths"]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0)
            yield pa.RecordBatch.from_arrays([asked, pa.array([address_bits(x, version) for x in asked.to_pylist()], pa.string())], ["asked", "bits"])

    asked = rows.select(F.col(address).cast("string").alias("asked")).where("asked IS NOT NULL").distinct().mapInArrow(bits, "asked string, bits string").where("bits IS NOT NULL")
    keys = asked.select("asked", F.explode(F.transform(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: F.substr("bits", F.lit(1), n))).alias("prefix"))
    found = keys.join(tree.select("prefix", F.col("record").alias("_record")), "prefix").select("asked", "_record")
    return rows.join(found, F.col(address).cast("string") == F.col("asked"), "left").drop("asked").withColumnRenamed("_record", record)
