"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: bit i of a text's fingerprint is set when bit i is set in over half of the XXH64 values
(seed 42) of its word shingles, repeats included.

Linking: distinct fingerprints only, so copies cost nothing. 64 bits are cut into `max_bits + 2`
blocks; two fingerprints within `max_bits` agree on two blocks at least, so a row per pair of blocks
brings every linked pair together under some equal key, exactly. Keys met by more than `HOT_KEY`
fingerprints are split further by their other bits, which again must agree on one of `max_bits + 1`
parts. Tasks read their rows in key order and index each key's members in Gray-rank order: leaves of
`FAN` neighbours, above them nodes of `FAN` nodes, each with the mask of bits that all below share
and their pattern. Pairs of nodes go down together and are dropped, with all below them, once the
bits in both masks differ in more than `max_bits` places. Links found are reduced to one edge per
fingerprint and key before they leave the task; alternating stars join them into components.

`similar_texts` and `keep_first`, the pipeline's stage, take the same way with a loose bound and an exact check: equal blocks of
shingle minima (bands) are the keys, a key's first member leads those near it, the rest of a key goes by the members that alike
sets must share and down the Gray-order index, and pairs of fingerprints within the bound are linked when their shingle sets,
compared whole, have the Jaccard similarity. Alternating stars join the links.

Cases: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; repeated rows share a fingerprint; other columns are not read, or pass through `keep_first`
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .session import bounded_batches, cut, documents
from .textblocks import blocks, mix

SEED = 42
SHINGLE = 3
MAX_BITS = 2
FAN = 16
HOT_KEY = 4_096
LEADERS = 8
#: Standard deviations above the mean of differing bits at which the index lets pairs go that may be alike.
DEVIATIONS = 7
ROWS_AT_ONCE = 1 << 17
PAIRS_AT_ONCE = 1 << 18
SHINGLES_AT_ONCE = 1 << 20
KNOWN_PAIRS = 1 << 23
#: A bound in bytes for what is broadcast, and what a row that goes, or a name of a set, is reckoned to take.
BROADCAST_BYTES, GONE_BYTES = 32 << 20, 64
_RNG = np.random.Generator(np.random.PCG64(41))
_FACTORS = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, size=256, dtype=np.uint64)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Word shingles of UTF-8 bytes with A-Z lowered; fewer words make one, none make none."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    parts = shingles(text, size)
    return np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=len(parts))


def from_hashes(hashes: np.ndarray) -> int:
    """Bit i is set when it is in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    return from_hashes(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) of every row, fp a signed 64-bit number; a narrow map."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for block in blocks(batch.column("t")):
                for i in range(len(block)):
                    out[block.first_row + i] = fingerprint(block.row(i), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out.view(np.int64))], ["k", "fp"])

    return docs.selectExpr(f"`{key}` AS k", f"cast(`{text}` AS string) AS t").mapInArrow(run, f"k {kind}, fp bigint").withColumnRenamed("k", key)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of bands of minima over `rows` permutations each, from a text's shingle hashes."""
    least = np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12), None] * _FACTORS[: bands * rows] + _OFFSETS[: bands * rows]
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key + least[i::rows])
    return key


def set_id(distinct: np.ndarray) -> int:
    """A 64-bit name of a set of shingle hashes, given sorted."""
    return xxh64_intdigest(distinct.tobytes(), SEED)


def banded(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int, bands: int, rows: int) -> DataFrame:
    """(key, text_hash, sid, fp, n, keys): the name, fingerprint and size of the shingle set, and the keys of its bands; a narrow map."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, fps = np.zeros(batch.num_rows, dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.uint64)
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            keys = np.zeros((batch.num_rows, bands), dtype=np.uint64)
            for block in blocks(batch.column("t")):
                for i in range(len(block)):
                    distinct = np.unique(shingle_hashes(block.row(i), shingle))
                    at = block.first_row + i
                    sids[at], fps[at], sizes[at] = set_id(distinct), from_hashes(distinct), len(distinct)
                    keys[at] = band_keys(distinct, bands, rows)
            flat = pa.array(keys.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("x"), pa.array(sids.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(sizes), lists], ["k", "text_hash", "sid", "fp", "n", "keys"])

    return docs.selectExpr(f"`{key}` AS k", f"cast(`{text}` AS string) AS t", f"xxhash64(`{text}`) AS x").mapInArrow(run, f"k {kind}, text_hash bigint, sid bigint, fp bigint, n bigint, keys array<bigint>").withColumnRenamed("k", key)


def shingle_sets(docs: DataFrame, *, text: str = "text", shingle: int) -> DataFrame:
    """(sid, h): every row's distinct shingle hashes, sorted, as bytes; a narrow map."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("t")):
                sets = [np.unique(shingle_hashes(block.row(i), shingle)) for i in range(len(block))]
                sids = np.array([set_id(x) for x in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(sids.view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], ["sid", "h"])

    return docs.selectExpr(f"cast(`{text}` AS string) AS t").mapInArrow(run, "sid bigint, h binary")


def cuts(bits: list[int], parts: int) -> list[list[int]]:
    """Bit places dealt into so many runs of about equal length."""
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def route(fps: DataFrame, max_bits: int, hot_key: int = HOT_KEY) -> DataFrame:
    """(key, fp): equal keys bring together every pair within max_bits, hot keys split further."""
    places = cuts(list(range(64)), max_bits + 2)
    pairs = list(combinations(range(len(places)), 2))

    def tagged(fp: Column, tag: int, mask: int) -> Column:
        return F.xxhash64(F.lit(tag), fp.bitwiseAND(F.lit(mask)))

    masks = [_mask(places[i] + places[j]) for i, j in pairs]
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), tagged(F.col("fp"), t, m).alias("key")) for t, m in enumerate(masks)))).alias("x")).select("fp", "x.t", "x.key")
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("key", F.lit(True).alias("hot"))
    hot = cut(hot)
    if hot.isEmpty():
        return rows.select("key", "fp")
    met = rows.join(hot, "key", "left")
    finer = None
    for t, (i, j) in enumerate(pairs):
        others = [b for n, block in enumerate(places) if n not in (i, j) for b in block]
        sub = F.array(*(F.xxhash64(F.col("key"), F.lit(s), F.col("fp").bitwiseAND(F.lit(_mask(bits)))) for s, bits in enumerate(cuts(others, max_bits + 1))))
        finer = F.when(F.col("t") == t, sub) if finer is None else finer.when(F.col("t") == t, sub)
    return met.select(F.explode(F.when(F.col("hot"), finer).otherwise(F.array("key"))).alias("key"), "fp")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in Gray order."""
    x = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _levels(keys: np.ndarray, codes: np.ndarray, labels: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The index over members sorted by (key, label, Gray rank), leaves first, until each key has one root.

    A node holds the bits that all below share (mask, code) and their label, or -1 where labels differ.
    """
    first = np.arange(len(keys))
    level = {"key": keys, "first": first, "last": first + 1, "mask": np.full(len(keys), ~np.uint64(0)), "code": codes, "label": labels}
    out = [level]
    while True:
        key = level["key"]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begins, group = np.flatnonzero(new), np.cumsum(new) - 1
        if len(begins) == len(key):
            return out
        place = np.arange(len(key)) - begins[group]
        starts = np.flatnonzero(place % FAN == 0)
        ends = np.append(starts[1:], len(key))
        lead = level["code"][starts]
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        differ = (level["code"] ^ lead[owner]) | ~level["mask"]
        mask = ~np.bitwise_or.reduceat(differ, starts)
        same = np.minimum.reduceat(level["label"], starts) == np.maximum.reduceat(level["label"], starts)
        level = {"key": key[starts], "first": starts, "last": ends, "mask": mask, "code": lead & mask, "label": np.where(same, level["label"][starts], -1)}
        out.append(level)


def _expand(a: np.ndarray, b: np.ndarray, level: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of children of node pairs, each unordered pair once, some at a time."""
    na, nb = level["last"][a] - level["first"][a], level["last"][b] - level["first"][b]
    size = na * nb
    at = 0
    ends = np.cumsum(size)
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = size[at:to]
        own = np.repeat(np.arange(at, to), n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        x, y = level["first"][a[own]] + k // nb[own], level["first"][b[own]] + k % nb[own]
        once = (a[own] != b[own]) | (x < y) if level["leaf"] else (a[own] != b[own]) | (x <= y)
        yield x[once], y[once]
        at = to


def linked(keys: np.ndarray, codes: np.ndarray, labels: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of members of one key and two labels within max_bits; all sorted by (key, label, Gray rank)."""
    levels = _levels(keys, codes, labels)
    if len(levels) == 1:
        return
    roots = np.arange(len(levels[-1]["key"]))
    yield from _descend(levels, len(levels) - 1, roots, roots, max_bits)


def _descend(levels: list[dict[str, np.ndarray]], depth: int, a: np.ndarray, b: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Goes down from each portion of node pairs before it takes the next, so few pairs are held at once."""
    below = levels[depth - 1]
    for x, y in _expand(a, b, levels[depth] | {"leaf": depth == 1}):
        apart = np.bitwise_count((below["code"][x] ^ below["code"][y]) & below["mask"][x] & below["mask"][y])
        near = (apart <= max_bits) & ((below["label"][x] != below["label"][y]) | (below["label"][x] < 0))
        if not near.any():
            continue
        if depth == 1:
            yield x[near], y[near]
        else:
            yield from _descend(levels, depth - 1, x[near], y[near], max_bits)


def _led(keys: np.ndarray, codes: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels from a few rounds in which the first member of a key without one leads all that are near it."""
    label = np.arange(len(keys))
    left = label
    for _ in range(LEADERS):
        if not len(left):
            break
        new = np.concatenate([[True], keys[left][1:] != keys[left][:-1]])
        leader = left[np.flatnonzero(new)][np.cumsum(new) - 1]
        near = np.bitwise_count(codes[left] ^ codes[leader]) <= max_bits
        label[left[near]] = leader[near]
        left = left[~near]
    return label


def local_links(keys: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, another of its component) that join what is linked within equal keys."""
    order = np.lexsort((gray_rank(codes), keys))
    keys, codes = keys[order], codes[order]
    first = _led(keys, codes, max_bits)
    order = np.lexsort((np.arange(len(keys)), first, keys))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    keys, codes, label = keys[order], codes[order], place[first[order]]
    for x, y in linked(keys, codes, label.copy(), max_bits):
        while len(x):
            p, q = label[x], label[y]
            while (label[p] != p).any() or (label[q] != q).any():
                p, q = label[p], label[q]
            apart = p != q
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
    while (label[label] != label).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return codes[moved], codes[label[moved]]


def links(routed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) edges between distinct fingerprints whose components are those of all pairs of equal keys within max_bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys, kept_codes, held = [], [], 0

        def flush(last: bool):
            nonlocal kept_keys, kept_codes, held
            keys, codes = np.concatenate(kept_keys), np.concatenate(kept_codes)
            done = len(keys) if last else int(np.argmax(keys == keys[-1]))  # the last key may go on
            kept_keys, kept_codes, held = [keys[done:]], [codes[done:]], len(keys) - done
            same = np.zeros(done + 1, dtype=bool)
            same[1:done] = keys[1:done] == keys[: done - 1] if done else False
            shared = same[:done] | same[1:]
            if shared.any():
                a, b = local_links(keys[:done][shared], codes[:done][shared].view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                kept_keys.append(batch.column("key").to_numpy())
                kept_codes.append(batch.column("fp").to_numpy())
                held += batch.num_rows
                if held >= ROWS_AT_ONCE:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return routed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def _named(marked: DataFrame, labels: DataFrame, key: str, by: str = "fp", *more: str) -> DataFrame:
    """(key, by, component, more) of marked rows, whose column `by` has the labels (node, label)."""
    distinct = cut(marked.groupBy(by).agg(F.min(key).alias("first")))
    named = distinct.join(labels, distinct[by] == labels["node"], "left").select(by, "first", F.coalesce("label", by).alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    return marked.join(named.join(least, "label").select(by, "component"), by).select(key, by, "component", *more)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component): the component is the smallest key reachable over links of at most max_bits."""
    marked = cut(fingerprints(docs, key=key, text=text, shingle=shingle))
    found = links(route(marked.select("fp").distinct(), max_bits), max_bits)
    return _named(marked, components(found, "a", "b"), key)


def alike(shared: int | np.ndarray, n: int | np.ndarray, m: int | np.ndarray, similarity: float) -> bool | np.ndarray:
    """Whether sets of n and m members, of which so many are shared, have this Jaccard similarity or more."""
    return shared + 1e-9 >= similarity * (n + m - shared)


def loose_bits(similarity: float) -> int:
    """How many bits the fingerprints of alike sets may differ in: `DEVIATIONS` above the mean for large sets.

    A pair's bits differ independently of each other, for 0.8 each with probability 0.151, and 0.188 at worst (four shingles of
    five): a pair is beyond the 30 bits with probability 4e-10, and 7e-8 at worst.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return min(64, round(64 * p + DEVIATIONS * (64 * p * (1 - p)) ** 0.5))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float, hot_key: int = HOT_KEY) -> DataFrame:
    """The pairs (a, b) of set names whose sets (sid, h) are alike; a name in very many pairs is dealt over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                keep.append(bool(alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), similarity)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    many = pairs.groupBy("a").agg((F.count("*") / hot_key).cast("bigint").alias("more"))
    left = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("more") + 1).alias("s"))
    left = left.join(sets.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b")
    right = many.join(sets.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a")
    right = right.select("a", "ha", F.explode(F.expr("sequence(0L, more)")).alias("s"))
    return left.join(right, ["a", "s"]).select("a", "b", "ha", "hb").mapInArrow(run, "a bigint, b bigint")


def prefixes(ids: np.ndarray, n: np.ndarray, values: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(members, how many of each set) of the sets' prefixes: the members that fewest sets hold, so many of them that alike sets share one.

    ids: the sets' members, set after set. Of two sets of this similarity each shares at least `similarity` of its own
    members, so it can't miss all of its first n - similarity * n + 1 in an order common to all.
    """
    need = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    row = np.repeat(np.arange(len(n)), n)
    held = np.bincount(ids, minlength=values)
    order = np.lexsort((ids, held[ids], row))
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    return ids[order][place < need[row]], need


def across(sids: np.ndarray, labels: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], similarity: float, codes: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of alike sets that join all labels so joined; where there are two parts, pairs of unequal part only.

    The sets that share a member of their prefixes are a key of the Gray-order index: unlike sets that came together by chance
    share none. Pairs of fingerprints (`codes`) that it finds within the loose bound are compared as sets.
    """
    n = np.array([len(x) for x in sets])
    keep = np.flatnonzero(n)
    codes = np.array([from_hashes(x) for x in sets], dtype=np.uint64) if codes is None else codes
    sids, labels, parts, codes, n = sids[keep], labels[keep], parts[keep], codes[keep], n[keep]
    names, label = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return
    values, ids = np.unique(np.concatenate([sets[i] for i in keep]), return_inverse=True)
    starts = np.cumsum(n) - n
    two, bits = len(np.unique(parts)) > 1, loose_bits(similarity)

    def compare(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        begins = np.flatnonzero(np.diff(a, prepend=-1))
        for i, others in zip(a[begins].tolist(), np.split(b, begins[1:]), strict=False):
            others = others[label[others] != label[i]]
            if not len(others):
                continue
            members = ids[starts[i] : starts[i] + n[i]]
            mark[members] = 1
            offsets = np.cumsum(n[others]) - n[others]
            places = np.repeat(starts[others] - offsets, n[others]) + np.arange(int(n[others].sum()))
            near = others[alike(np.add.reduceat(mark[ids[places]], offsets), n[i], n[others], similarity)]
            mark[members] = 0
            for at in near[np.unique(label[near], return_index=True)[1]].tolist():
                yield int(sids[i]), int(sids[at])
            if len(near):
                label[np.isin(label, label[near])] = label[i]

    first, need = prefixes(ids, n, len(values), similarity)
    by_value = np.argsort(first, kind="stable")
    first, owner = first[by_value], np.repeat(np.arange(len(n)), need)[by_value]
    held = np.bincount(first, minlength=len(values))[first]
    first, owner, held = first[held > 1], owner[held > 1], held[held > 1]
    mark = np.zeros(len(values), dtype=np.int32)
    seen = np.zeros(min(len(n) ** 2, KNOWN_PAIRS), dtype=np.uint32)  # a pair that shares several members is compared once while it is known here
    begins = np.flatnonzero(np.diff(first, prepend=-1))
    run = (np.cumsum(held) - held)[begins] // (16 * PAIRS_AT_ONCE)  # keys some at a time, so that labels joined by then cut what follows
    bounds = begins[np.diff(run, prepend=-1) != 0].tolist()
    for begin, end in zip(bounds, [*bounds[1:], len(first)], strict=False):
        key, own = first[begin:end], owner[begin:end]
        alone = np.bincount(label)[label] == 1  # sets that nothing is joined to yet lie in Gray order among themselves
        order = np.lexsort((gray_rank(codes)[own], np.where(alone, -1, label)[own], key))
        key, own = key[order], own[order]
        for x, y in linked(key, codes[own], label[own], bits):
            a, b = np.minimum(own[x], own[y]), np.maximum(own[x], own[y])
            fits = (label[a] != label[b]) & ((parts[a] != parts[b]) | (not two)) & (n[a] + 1e-9 >= similarity * n[b]) & (n[b] + 1e-9 >= similarity * n[a])
            met = np.sort(a[fits] * len(n) + b[fits])
            met = met[np.diff(met, prepend=-1) != 0]
            met = met[seen[met % len(seen)] != met // len(seen) + 1]
            seen[met % len(seen)] = met // len(seen) + 1
            yield from compare(met // len(n), met % len(n))


def remaining(shared: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, most: int = SHINGLES_AT_ONCE) -> DataFrame:
    """Alike pairs (a, b) of equal keys and two labels; keys above so many shingles go by pairs of blocks."""
    members = shared.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "fp", "n", F.coalesce("label", "sid").alias("label"))
    mixed = members.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), (F.sum("n") / most).cast("int").alias("more")).where("l <> m").select("key", "more")
    i = F.pmod(F.xxhash64("sid"), F.col("more") + 1).cast("int")
    dealt = members.join(mixed, "key").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("more"))))
    dealt = dealt.select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "sid", "fp", "label")

    def run(table: pa.Table) -> pa.Table:
        sids, own, parts, fps = (table.column(c).to_numpy() for c in ("sid", "label", "i", "fp"))
        pairs = []
        if table.column("x")[0] == table.column("y")[0] or len(np.unique(parts)) > 1:
            pairs = list(across(sids, own, parts, [np.frombuffer(h.as_buffer(), "<u8") for h in table.column("h")], similarity, fps.view(np.uint64)))
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return dealt.join(sets, "sid").groupBy("key", "x", "y").applyInArrow(run, "a bigint, b bigint")


def similar_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 25, rows: int = 5) -> DataFrame:
    """(key, sid, component, text_hash) for texts whose shingle sets have this Jaccard similarity or more.

    Bands of shingle minima are the keys (a pair of similarity 0.8 shares one of 25 bands of 5 with probability
    above 0.9999); a link is a pair of a key whose fingerprints are within `loose_bits` and whose shingle sets,
    compared whole, are alike. First each key's least set leads: it meets all of the key that are near it, a pair a
    member; then those that are still of two components go down the key's Gray-order index.
    """
    marked = cut(banded(docs, key=key, text=text, shingle=shingle, bands=bands, rows=rows))
    routed = marked.where("n > 0").dropDuplicates(["sid"]).select("sid", "fp", "n", F.explode("keys").alias("key"))
    leaders = routed.groupBy("key").agg(F.min(F.struct("sid", "fp", "n")).alias("leader"), F.count("*").alias("members")).where("members > 1").select("key", "leader")
    shared = cut(routed.join(leaders, "key").select("key", "sid", "fp", "n", F.col("leader.sid").alias("a"), F.col("leader.fp").alias("fa"), F.col("leader.n").alias("m")))
    met = cut(shared.select("sid").distinct())
    small = met.count() * GONE_BYTES <= BROADCAST_BYTES
    texts = docs.select(F.col(text).cast("string").alias("t"), F.xxhash64(text).alias("x"))
    if small:  # few texts share a band: only those are hashed again
        wanted = cut(marked.join(F.broadcast(met), "sid", "left_semi").select(F.col("text_hash").alias("x")).distinct())
        if wanted.count() * GONE_BYTES <= BROADCAST_BYTES:
            texts = texts.join(F.broadcast(wanted), "x", "left_semi")
    sets = cut(shingle_sets(texts, text="t", shingle=shingle).join(F.broadcast(met) if small else met, "sid", "left_semi").groupBy("sid").agg(F.first("h").alias("h")))
    near = (F.least("n", "m") + 1e-9 >= similarity * F.greatest("n", "m")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fa"))) <= loose_bits(similarity))
    led = cut(confirmed(shared.where((F.col("a") != F.col("sid")) & near).select("a", F.col("sid").alias("b")).distinct(), sets, similarity))
    rest = remaining(shared, cut(components(led, "a", "b")), sets, similarity)
    return _named(marked, components(led.unionByName(rest), "a", "b"), key, "sid", "text_hash")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """The rows of each component's smallest key, with the columns they have.

    Rows are told apart by key and text: of rows of equal key and text all stay or all go, and so with null
    keys, which stay where no row with a key is like them. The rows that go are counted; up to the bound
    they are broadcast, so texts don't travel.
    """
    found = similar_texts(docs, key=key, text=text, **options)
    gone = cut(found.where(~F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("gone_key"), F.col("text_hash").alias("gone_hash")).distinct())
    took = gone.count() * GONE_BYTES
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("own_key"), F.xxhash64(text).alias("own_hash"))
    same = F.col("own_key").eqNullSafe(F.col("gone_key")) & (F.col("own_hash") == F.col("gone_hash"))
    return rows.join(F.broadcast(gone) if took <= broadcast_bytes else gone, same, "left_anti").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
