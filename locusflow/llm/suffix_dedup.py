"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every string of `LENGTH` bytes holds a k-mer of least hash, its anchor, at a place that its own bytes
decide; equal strings have equal anchors. So only suffixes at anchors are sorted (one in about forty),
each with the bytes before it that its strings need.

1. Blocks of texts find their anchors and send the hashes of anchor k-mers to buckets.
2. Buckets name the k-mers that occur twice or more to the blocks that hold them.
3. Blocks sort the suffixes of those anchors, keep the earliest of equal ones (the others are repeats
   already), and send front-coded runs - the length of the prefix shared with the one before, and the
   rest - to ranges of the suffix order, cut at quantiles of a bounded sample.
4. A range merges its runs with a loser tree whose nodes remember common prefixes: characters known
   to be equal are never compared again. Neighbours that share the k-mer are one group; in it equal
   suffixes, and equal strings of different ones, fall to the earliest. A k-mer of more than `HOT_KMER`
   places (the edge of a line that very many documents hold) may have as many surroundings: its strings
   go by their own 128-bit hashes instead, once a block each, so no range gathers them.
5. Repeats return to their blocks, where the bytes they cover go.

Equal suffixes are merged before they travel, so a passage in very many documents costs a row a block.
Texts are held compressed in the checkpoint and travel so.

Order: by key, then block and row (rows of one key), then place. Keys are integers, others are refused; a null key
comes first; other columns are not read. Cases: a null or empty text has no bytes and nothing removed; texts below `LENGTH` bytes stay
whole; of equal rows the later one goes whole; an empty table gives no rows; a key of -2^63 marks a null one
and comes back as null.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .session import bounded_batches, cut, documents, input_bytes
from .textblocks import LARGE_BLOCK, Block, blocks, span_hashes

LENGTH = 100
KMER = 20
SAMPLE_BLOCKS, SAMPLE_EACH = 2048, 64
HOT_KMER = 8_192
BREAK = 0xFF  # no byte of UTF-8
_PLACE_BITS = 26
Order = tuple[int, int, int, int]


def anchors(block: Block, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, last string, row, k-mer hash): strings first..last have this anchor."""
    data, n = block.array, len(block.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    at = np.arange(n - k + 1)
    hashes = span_hashes(data, at, at + k)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    if n > int(place):
        least = _least_slow(hashes, length - k + 1)
    else:
        v = (hashes & ~place) | at.astype(np.uint64)
        width, step = length - k + 1, 1
        while 2 * step <= width:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        rest = width - step
        least = ((np.minimum(v[: len(v) - rest], v[rest:]) if rest else v) & place).astype(np.int64)
    size = np.diff(block.offsets)
    valid = np.maximum(size - length + 1, 0)
    rows = np.repeat(np.arange(len(block)), valid)
    starts = block.offsets[:-1][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(valid) - valid, valid)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64)
    chosen = least[starts]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(starts)) - 1
    return chosen[begins], starts[begins], starts[ends], rows[begins], hashes[chosen[begins]]


def _least_slow(hashes: np.ndarray, width: int) -> np.ndarray:
    """The same for a block too long for packed places: least hash with its top bits, then place."""
    top = hashes & ~np.uint64((1 << _PLACE_BITS) - 1)
    best = np.arange(len(top) - width + 1)
    for i in range(1, width):
        other = np.arange(len(best)) + i
        best = np.where(top[other] < top[best], other, best)
    return best


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """For each string the length of the prefix that it shares with the one before."""
    if not strings:
        return np.zeros(0, np.int64)
    lengths = np.array(list(map(len, strings)))
    out = np.zeros(len(strings), np.int64)
    for at in range(1, len(strings), 20_000):
        part = strings[at - 1 : at + 20_000]
        width = int(lengths[at - 1 : at + 20_000].max()) + 1
        grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), np.uint8).reshape(len(part), width)
        differ = grid[1:] != grid[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[at : at + len(part) - 1] = np.minimum(shared, np.minimum(lengths[at : at + len(part) - 1], lengths[at - 1 : at + len(part) - 2]))
    return out


class Run:
    """A front-coded sorted run: strings come back one by one with their common prefix."""

    __slots__ = ("at", "ends", "rest", "shared", "string", "tags", "tail")

    def __init__(self, shared: bytes, lengths: bytes, rest: bytes, tags: np.ndarray):
        self.shared, self.rest = np.frombuffer(shared, "<u2").tolist(), rest
        self.ends = np.cumsum(np.frombuffer(lengths, "<u2"), dtype=np.int64).tolist()
        self.tags, self.string, self.at, self.tail = tags.tolist(), b"", -1, 0

    def next(self) -> int:
        """The common prefix of the next string with the one before, or -1 at the end."""
        self.at += 1
        if self.at == len(self.ends):
            return -1
        h, end = self.shared[self.at], self.ends[self.at]
        self.string = self.string[:h] + self.rest[self.tail : end]
        self.tail = end
        return h


def _compare(a: bytes, b: bytes, h: int) -> tuple[bool, int]:
    """(a comes first or is equal, common prefix), from byte h on; all before is known to be equal."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h : h + 16] == b[h : h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    if h == n:
        return len(a) <= len(b), h
    return a[h] < b[h], h


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, tuple]]:
    """(string, common prefix with the one before, tag) in order, by a loser tree over the runs.

    A node holds the run that lost there and the prefix it shares with the winner that passed. Of two
    strings that both follow the last one out, the one sharing more with it comes first, and nothing
    is compared; only for equal lengths do bytes beyond that prefix decide.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [r.next() for r in runs] + [-1] * (k - len(runs))  # -1: at its end
    known = [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one shared with the winner."""
        if heads[b] < 0:
            return a, b
        if heads[a] < 0:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        first, h = _compare(runs[a].string, runs[b].string, known[a])
        won, lost = (a, b) if first else (b, a)
        known[lost] = h
        return won, lost

    level = list(range(k))
    base = k // 2
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 2):
            won, losers[base + i // 2] = play(level[i], level[i + 1])
            above.append(won)
        level, base = above, base // 2
    top = level[0]
    shared = 0
    while heads[top] >= 0:
        run = runs[top]
        yield run.string, shared, run.tags[run.at]
        heads[top] = known[top] = run.next()
        node = (top + k) // 2
        while node >= 1:
            top, losers[node] = play(top, losers[node])
            node //= 2
        shared = known[top]


def _ranges_of(at: list[int], base: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges covered by strings at base + at[i]; neighbours become one range."""
    begin = end = None
    for j in at:
        if begin is None:
            begin, end = j, j
        elif j <= end + length:
            end = j
        else:
            yield base + begin, base + end + length
            begin, end = j, j
    if begin is not None:
        yield base + begin, base + end + length


def group_repeats(group: list[tuple[bytes, int, tuple]], length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """Repeats in suffixes that share their k-mer: (block, row, start, end) byte ranges of texts.

    A tag is (key, block, row, first string, anchor - first string); a suffix with the bytes before it
    gives the strings back.
    """
    variants: list[tuple[bytes, tuple]] = []
    for string, shared, tag in group:
        if variants and shared == len(string) == len(variants[-1][0]):
            last = variants[-1][1]
            late = max(last, tag)
            variants[-1] = (string, min(last, tag))
            yield late[1], late[2], late[3], late[3] + len(string) - 1
        else:
            variants.append((string, tag))
    if len(variants) < 2:
        return
    least: dict[bytes, Order] = {}
    held = []
    for string, tag in variants:
        after, _, before = string.rpartition(bytes([BREAK]))
        whole = before[::-1] + after
        own = [whole[j : j + length] for j in range(len(whole) - length + 1)]
        key, block, row, first, _ = tag
        held.append((tag, own))
        for j, s in enumerate(own):
            order = (key, block, row, first + j)
            if s not in least or order < least[s]:
                least[s] = order
    for (key, block, row, first, _), own in held:
        late = [j for j, s in enumerate(own) if least[s] != (key, block, row, first + j)]
        for start, end in _ranges_of(late, first, length):
            yield block, row, start, end


def _among(hashes: np.ndarray, lists: list[bytes]) -> np.ndarray:
    wanted = np.sort(np.frombuffer(b"".join(lists), "<u8"))
    if not len(wanted):
        return np.zeros(len(hashes), bool)
    return wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes


def _runs_of(starts: np.ndarray, count: int, length: int) -> np.ndarray:
    """(row-wise) starts[i] .. starts[i] + length, neighbours of one row joined: rows (row, start, end); starts: (row, place), sorted."""
    row, place = starts
    new = np.ones(count, bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + length)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], count) - 1
    return np.column_stack([row[begins], place[begins], place[ends] + length])


def _strings(block: Block, keys: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray, length: int, number: int, parts: int) -> list[tuple]:
    """Rows of runs for strings first..last of each anchor: the earliest of equal ones by hash, and the later ones as repeats."""
    if not len(first):
        return []
    n = last - first + 1
    start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    own = np.repeat(row, n)
    h1, h2 = (span_hashes(block.array, start, start + length, lane) for lane in (0, 1))
    place = start - block.offsets[own]
    order = np.lexsort((place, own, keys[own], h2, h1))
    h1, h2, own, place = h1[order], h2[order], own[order], place[order]
    same = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
    out = []
    if same.any():
        at = np.lexsort((place[same], own[same]))
        out.append((number % parts, number, None, None, None, _pack("<i8", _runs_of((own[same][at], place[same][at]), len(at), length))))
    h1, h2, own, place = h1[~same], h2[~same], own[~same], place[~same]
    part = (h1 >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    for p in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        tags = np.stack([keys[own[p]], own[p], place[p]])
        out.append((int(part[p[0]]), number, None, None, np.stack([h1[p], h2[p]]).astype("<u8").tobytes(), _pack("<i8", tags)))
    return out


def _later_strings(strings: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(block, repeats) of strings (two hashes; key, row, place; block) that an equal one comes before."""
    if not strings:
        return
    h1, h2 = np.concatenate([x[0] for x in strings], axis=1)
    key, row, place = np.concatenate([x[1] for x in strings], axis=1)
    block = np.concatenate([x[2] for x in strings])
    order = np.lexsort((place, row, block, key, h2, h1))
    same = np.concatenate([[False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])
    late = order[same]
    late = late[np.lexsort((place[late], row[late], block[late]))]
    for own in np.split(late, np.flatnonzero(np.diff(block[late])) + 1):
        if len(own):
            yield int(block[own[0]]), list(map(tuple, _runs_of((row[own], place[own]), len(own), length).tolist()))


def _pack(kind: str, x) -> bytes:
    return np.asarray(x).astype(kind).tobytes()


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int = KMER, hot_kmer: int = HOT_KMER, with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is no integer: number the rows, for repeats fall to the earliest")
    bounded_batches(spark)
    size = input_bytes(docs)
    buckets = min(max(64, size >> 25), 1 << 18)
    parts = max(64, size >> 22)
    rows = docs.selectExpr(f"cast(`{key}` AS bigint) AS k", f"cast(`{text}` AS string) AS t")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in blocks, and hashes of their anchors' k-mers by bucket."""
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        press = zstandard.ZstdCompressor(level=3)
        held_k, held_t, held = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal number
            keys = pa.concat_arrays(held_k)
            for block in blocks(pa.concat_arrays(held_t), LARGE_BLOCK):
                own = keys.slice(block.first_row, len(block))
                at, _, _, _, hashes = anchors(block, length, kmer)
                once, n = np.unique(hashes, return_counts=True)
                bucket = (once >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                begins = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)))
                rng = np.random.Generator(np.random.PCG64(number))
                some = rng.choice(at, min(SAMPLE_EACH, len(at)), replace=False) if len(at) else at
                sample = b"".join(block.data[a : a + kmer] for a in some.tolist())
                out = [(0, number, -1, _pack("<i8", own.fill_null(-(1 << 63)).to_numpy()), _pack("<i8", block.offsets), press.compress(block.data), sample)]
                for p in np.split(order, begins[1:]) if len(order) else ():
                    out.append((1, number, int(bucket[p[0]]), _pack("<u8", once[p]), _pack("<u1", np.ceil(np.log2(n[p]))), b"", b""))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4], strict=True)], names)

        for batch in batches:
            if batch.num_rows:
                held_k.append(batch.column("k"))
                held_t.append(batch.column("t").fill_null(""))
                held += batch.column("t").nbytes
            if held >= 4 << 20:
                yield from emit()
                held_k, held_t, held = [], [], 0
        if held_k:
            yield from emit()

    names = ["kind", "block", "bucket", "a", "b", "c", "d"]
    stored = cut(rows.mapInArrow(read, "kind int, block bigint, bucket int, a binary, b binary, c binary, d binary"))
    texts = stored.where("kind = 0").select("block", "a", "b", "c")

    def name(table: pa.Table) -> pa.Table:
        """For each block of a bucket its k-mers that occur again, those of very many places apart."""
        held = [np.frombuffer(x, "<u8") for x in table.column("a").to_pylist()]
        places = np.left_shift(1, np.concatenate([np.frombuffer(x, "<u1") for x in table.column("b").to_pylist()]).astype(np.int64))  # up to the next power of two
        hashes = np.concatenate(held)
        owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
        _, back = np.unique(hashes, return_inverse=True)
        places = np.bincount(back, weights=places)[back]
        lists = []
        for chosen in ((places > 1) & (places <= hot_kmer), (places > 1) & (places > hot_kmer)):
            at = np.flatnonzero(chosen)  # in order of their owners
            lists.append([_pack("<u8", x) for x in np.split(hashes[at], np.searchsorted(owner[at], np.arange(1, len(held))))])
        out = [x for x in zip(table.column("block").to_pylist(), *lists, strict=True) if x[1] or x[2]]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "again", "hot"])

    again = stored.where("kind = 1").select("bucket", "block", "a", "b").groupBy("bucket").applyInArrow(name, "block bigint, again binary, hot binary")
    picked = stored.where("kind = 0").orderBy(F.xxhash64("block"), "block").select("d").limit(SAMPLE_BLOCKS).toArrow()
    sample = b"".join(picked.column("d").to_pylist())
    some = sorted(sample[i : i + kmer] for i in range(0, len(sample), kmer))
    splits = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []

    def opened(table: pa.Table) -> tuple[int, np.ndarray, Block]:
        data = zstandard.ZstdDecompressor().decompress(table.column("c")[0].as_py())
        return table.column("block")[0].as_py(), np.frombuffer(table.column("a")[0].as_py(), "<i8"), Block(0, data, np.frombuffer(table.column("b")[0].as_py(), "<i8"))

    run_names = ["part", "block", "shared", "lengths", "rest", "tags"]
    run_types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]

    def sort(own: pa.Table, named: pa.Table) -> pa.Table:
        """Front-coded runs of a block by range, and the repeats found within the block."""
        out = []
        if own.num_rows and named.num_rows:
            number, keys, block = opened(own)
            at, first, last, row, hashes = anchors(block, length, kmer)
            use = np.flatnonzero(_among(hashes, named.column("again").to_pylist()))
            hot = np.flatnonzero(_among(hashes, named.column("hot").to_pylist()))
            out += _strings(block, keys, first[hot], last[hot], row[hot], length, number, parts)
            mark, data, entries = bytes([BREAK]), block.data, []
            start = block.offsets[row]
            for a, f, e, r, o in zip(at[use].tolist(), first[use].tolist(), (last[use] + length).tolist(), row[use].tolist(), start[use].tolist(), strict=True):
                entries.append((data[a:e] + mark + data[f:a][::-1], int(keys[r]), r, f - o, a - f))
            entries.sort()
            kept, late = [], []
            for entry in entries:
                if kept and kept[-1][0] == entry[0]:
                    late.append((entry[2], entry[3], entry[3] + len(entry[0]) - 1))
                else:
                    kept.append(entry)
            if late:
                out.append((number % parts, number, None, None, None, _pack("<i8", late)))
            strings = [x[0] for x in kept]
            ranges = np.array([bisect_right(splits, s[:kmer]) for s in strings], np.int64)
            edges = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(ranges)) if len(ranges) else []
            for b, e in zip(edges[:-1], edges[1:], strict=True):
                shared = common_prefixes(strings[b:e])
                rest = [s[h:] for s, h in zip(strings[b:e], shared.tolist(), strict=True)]
                out.append((int(ranges[b]), number, _pack("<u2", shared), _pack("<u2", [len(x) for x in rest]), b"".join(rest), _pack("<i8", [x[1:] for x in kept[b:e]])))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(run_types)], names=run_names)

    runs = texts.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(sort, "part int, block bigint, shared binary, lengths binary, rest binary, tags binary")

    def combine(table: pa.Table) -> pa.Table:
        """Merges the runs of a range, and strings by their hashes; gives repeats by block."""
        late: dict[int, list[tuple[int, int, int]]] = {}
        own, strings = [], []
        for x in table.to_pylist():
            tags = np.frombuffer(x["tags"], "<i8")
            if x["lengths"] is None and x["rest"] is not None:
                hashes = np.frombuffer(x["rest"], "<u8").reshape(2, -1)
                strings.append((hashes, tags.reshape(3, -1), np.full(hashes.shape[1], x["block"])))
            elif x["rest"] is None:
                late.setdefault(x["block"], []).extend(map(tuple, tags.reshape(-1, 3).tolist()))
            else:
                tags = tags.reshape(-1, 4)
                own.append(Run(x["shared"], x["lengths"], x["rest"], np.column_stack([tags[:, 0], np.full(len(tags), x["block"]), tags[:, 1:]])))
        for block, rows in _later_strings(strings, length):
            late.setdefault(block, []).extend(rows)
        group: list[tuple[bytes, int, tuple]] = []

        def close() -> None:
            if len(group) > 1:
                for block, row, start, end in group_repeats(group, length):
                    late.setdefault(block, []).append((row, start, end))
            group.clear()

        for string, shared, tag in merge(own) if own else ():
            if shared < kmer:
                close()
            group.append((string, shared, tuple(tag)))
        close()
        return pa.table([pa.array(list(late), pa.int64()), pa.array([_pack("<i8", v) for v in late.values()], pa.binary())], names=["block", "late"])

    found = runs.groupBy("part").applyInArrow(combine, "block bigint, late binary")

    def remove(own: pa.Table, late: pa.Table) -> pa.Table:
        number, keys, block = opened(own)
        ranges: dict[int, list[tuple[int, int]]] = {}
        for x in late.column("late").to_pylist():
            for row, start, end in np.frombuffer(x, "<i8").reshape(-1, 3).tolist():
                ranges.setdefault(row, []).append((start, end))
        out = []
        for i in range(len(block)):
            data = block.row(i)
            kept, at, spans = [], 0, 0
            for start, end in sorted(ranges.get(i, ())):
                if start > at or not spans:
                    kept.append(data[at:start])
                    spans += 1
                at = max(at, end)
            kept.append(data[at:])
            left = b"".join(kept)
            k = int(keys[i])
            out.append((None if k == -(1 << 63) else k, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest()) + ((left,) * with_text))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
        return pa.table([pa.array([x[j] for x in out], t) for j, t in enumerate(types)], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    schema = "k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, schema).withColumnRenamed("k", key)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
