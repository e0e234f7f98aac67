"""Language-model scoring with a log-frequency Bloom filter.

Counting: tasks hash words (64 bits), adjacent pairs and triples with byte arrays, add up equal ones, and
send them packed to buckets by hash. A bucket keeps the exact counts of its words, and a Bloom filter that
holds every n-gram q times over, tagged 1..q, where q = 1 + floor(log2 count); triples are held from two
occurrences on, as is customary. A count comes back by probing tags until one is missing. It can only come
out too large, and no n-gram counts as more frequent than its parts.

Model, with counts from probes, V(q) for the count that q stands for, N tokens and W distinct words:
p1(c) = (V(c) + 1) / (N + W + 1); where b was seen p2(c | b) = LAMBDA * V(b c) / V(b) + (1 - LAMBDA) * p1(c), elsewhere
p1; where (a b) was seen twice or more p3(c | a b) = LAMBDA * V(a b c) / V(a b) + (1 - LAMBDA) * p2(c | b), elsewhere p2.
`score` is the sum of log10 of these over the text's words and its end. None exceeds 1.

Scoring: the filter is broadcast while it takes at most `max_filter_bytes`. Beyond that, groups of texts send
their distinct n-grams to the buckets, which probe their part of the filter, and the answers meet the texts
again: the same scores, from any bound. Exact counts for the base score: the most frequent words,
`hot_words_most` at most, are broadcast, and the occurrences of all others go to their buckets, so a
frequent word never makes a bucket large; `score` doesn't depend on where a count came from.

Cases: a null or empty text is its end alone; rows with a null key are scored and count for
training by the same rule on an empty key; equal rows are scored each; an empty training part
gives counts of zero; an empty table gives no rows; other columns are not read. Without the broadcast `docs` is
read more than once and must give its rows in the same order, as a table does; otherwise the run fails.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import bounded_batches, cut, documents, input_bytes
from .textblocks import LARGE_BLOCK, LOWER, Block, blocks, mix, span_hashes, words

HOT_WORDS = 1 << 19
MAX_FILTER_BYTES = 192 << 20
BITS, PROBES, TOP = 7, 4, 40
LAMBDA = 0.5
FLUSH_TOKENS, GROUP_BYTES, PROBED_BYTES = 1 << 20, 6 << 20, 1 << 20
END = np.uint64(0x5EED_0E4D_0000_0001)
_TAG = 0x9E3779B97F4A7C15
_PAIR, _TRIPLE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)
KINDS = ("words", "pairs", "triples")
ORDER = "the rows to score came in another order when they were read again: write them to a table first"
LAYOUT = "bucket int, " + ", ".join(f"{k} binary, {k}_n binary" for k in KINDS)


def in_training(keys: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2 for k in keys], dtype=bool)


def token_keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of all tokens in order: each row's words, then its end."""
    low = Block(block.first_row, block.data.translate(LOWER), block.offsets)
    starts, ends, rows = words(low)
    hashes = span_hashes(low.array, starts, ends)
    n = len(block)
    counts = np.bincount(rows, minlength=n)
    keys = np.full(len(rows) + n, END, dtype=np.uint64)
    keys[np.arange(len(rows)) + rows] = hashes
    return keys, np.repeat(np.arange(n), counts + 1)


@dataclass
class Grams:
    """The n-grams at the tokens of a block: keys, whether a row begins here, and the place before each token."""

    tokens: np.ndarray
    rows: np.ndarray
    pairs: np.ndarray
    later: np.ndarray  # tokens that another stands before in their row: triples end there
    triples: np.ndarray


def grams(block: Block) -> Grams:
    """An end stands before a row's first word; a triple begins with it or later."""
    tokens, rows = token_keys(block)
    if not len(tokens):
        none = np.zeros(0, np.uint64)
        return Grams(none, rows, none, np.zeros(0, np.int64), none)
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    before = np.where(first, END, np.concatenate([[END], tokens[:-1]]))
    pairs = mix(before * _PAIR + tokens)
    later = np.flatnonzero(~first)
    return Grams(tokens, rows, pairs, later, mix(pairs[later - 1] * _TRIPLE + tokens[later]))


def added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    if counts is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte per count below 255, then eight for each of the others."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], "<i8")
    return counts


def pack_grams(keys: np.ndarray) -> bytes:
    """Four bytes per key: a bucket tells n-grams apart by 32 bits, far finer than its filter does."""
    return (keys & _LOW).astype("<u4").tobytes()


def unpack_grams(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.uint64)


_LOW = np.uint64((1 << 32) - 1)


def steps(counts: np.ndarray) -> np.ndarray:
    """q of a count: 1 + floor(log2 c)."""
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


#: The count that stands for q: the middle of 2^(q-1) .. 2^q - 1.
VALUE = np.array([0.0, *((2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, TOP + 2))])


def _places(keys: np.ndarray, tag: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    x = mix((keys & _LOW) + np.uint64(tag * _TAG % (1 << 64)))
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * sizes) >> np.uint64(32)).astype(np.int64)


def build_filter(keys: np.ndarray, q: np.ndarray, bits_each: int = BITS) -> bytes:
    """A bit array holding key i with tags 1..q[i]; so many bits an entry."""
    bits = np.zeros(max(64, -(-int(q.sum()) * bits_each // 8) * 8), dtype=bool)
    size = np.uint64(len(bits))
    for tag in range(1, int(q.max(initial=0)) + 1):
        for at in _places(keys[q >= tag], tag, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Bit arrays of all buckets, end to end."""

    def __init__(self, maps: dict[int, bytes], buckets: int):
        lengths = np.array([len(maps.get(b, b"")) for b in range(buckets)], dtype=np.int64)
        self.buckets, self.sizes, self.starts = buckets, (lengths * 8).astype(np.uint64), np.cumsum(lengths) - lengths
        self.bits = np.frombuffer(b"".join(maps.get(b, b"") for b in range(buckets)) or b"\0", np.uint8)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """q of each key: tags are probed upwards until one is missing."""
        q = np.zeros(len(keys), np.int64)
        bucket = bucket_of(keys, self.buckets)
        left = np.flatnonzero(self.sizes[bucket] > 0)
        tag = 1
        while len(left) and tag <= TOP:
            start, size = self.starts[bucket[left]], self.sizes[bucket[left]]
            held = np.ones(len(left), bool)
            for at in _places(keys[left], tag, size):
                held &= (self.bits[start + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            left = left[held]
            q[left] = tag
            tag += 1
        return q


def count_ngrams(docs: DataFrame, buckets: int, bits_each: int = BITS) -> DataFrame:
    """A row per bucket: (bucket, keys, counts, filter, tokens, n_words, histogram of word counts by q)."""
    names = ["bucket", *(x for k in KINDS for x in (k, f"{k}_n"))]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Grams] = []
        n = 0

        def flush() -> pa.RecordBatch:
            columns: dict[str, list[bytes]] = {}
            rows: dict[str, dict[int, tuple[bytes, bytes]]] = {}
            for kind, arrays, pack in (("words", [g.tokens for g in held], lambda x: x.astype("<u8").tobytes()), ("pairs", [g.pairs for g in held], pack_grams), ("triples", [g.triples for g in held], pack_grams)):
                keys, counts = added(np.concatenate(arrays))
                rows[kind] = {b: (pack(keys[p]), pack_counts(counts[p])) for b, p in by_bucket(keys, buckets)}
            held.clear()
            own = sorted(set().union(*rows.values()))
            for kind in KINDS:
                columns[kind], columns[f"{kind}_n"] = zip(*(rows[kind].get(b, (b"", b"")) for b in own), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(columns[c], pa.binary()) for c in names[1:])], names)

        for batch in batches:
            chosen = in_training(batch.column("k").to_pylist())
            if not chosen.any():
                continue
            for block in blocks(batch.column("t").filter(pa.array(chosen)), LARGE_BLOCK):
                held.append(grams(block))
                n += len(held[-1].tokens)
                if n >= FLUSH_TOKENS:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        def joined(name: str, unpack) -> tuple[np.ndarray, np.ndarray]:
            keys = [unpack(x) for x in table.column(name).to_pylist()]
            n = [unpack_counts(x, len(k)) for x, k in zip(table.column(f"{name}_n").to_pylist(), keys, strict=True)]
            return added(np.concatenate(keys), np.concatenate(n))

        keys, counts = joined("words", lambda x: np.frombuffer(x, "<u8"))
        pairs, pair_counts = joined("pairs", unpack_grams)
        triples, triple_counts = joined("triples", unpack_grams)
        many = triple_counts > 1
        q = steps(counts)
        bits = build_filter(np.concatenate([keys, pairs, triples[many]]), np.concatenate([q, steps(pair_counts), steps(triple_counts[many])]), bits_each)
        row = [table.column("bucket")[0].as_py(), keys.astype("<u8").tobytes(), pack_counts(counts), bits, int(counts.sum()), len(keys), np.bincount(q, minlength=TOP + 2).tolist()]
        return pa.table([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())], strict=True)], names=["bucket", "keys", "counts", "filter", "tokens", "n_words", "histogram"])

    sent = docs.mapInArrow(gather, LAYOUT)
    return sent.groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, counts binary, filter binary, tokens bigint, n_words bigint, histogram array<bigint>")


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, in order) for each bucket that the keys have."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(np.append(bucket[order], -1))) + 1
    for b, e in zip(np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else [], ends, strict=True):
        yield int(bucket[order[b]]), order[b:e]


def probed(asks: pa.ChunkedArray, bits: Filter) -> Iterator[bytes]:
    """The answers to each of many questions, a byte a gram: runs of PROBED_BYTES are probed at once, for a question may be a few grams."""
    size = pc.binary_length(asks).to_numpy().astype(np.int64)
    run = (np.cumsum(size) - size) // PROBED_BYTES
    for r in np.unique(run).tolist():
        at = np.flatnonzero(run == r)
        q = bits.probe(unpack_grams(b"".join(asks.slice(int(at[0]), len(at)).to_pylist()))).astype(np.uint8).tobytes()
        ends = (np.cumsum(size[at]) // 4).tolist()
        yield from (q[i:j] for i, j in zip([0, *ends], ends, strict=False))


@dataclass
class Looked:
    """The distinct n-grams of a block and where each token finds its own."""

    own: Grams
    keys: tuple[np.ndarray, np.ndarray, np.ndarray]
    back: tuple[np.ndarray, np.ndarray, np.ndarray]


def distinct(own: Grams) -> Looked:
    found = [np.unique(x, return_inverse=True) for x in (own.tokens, own.pairs, own.triples)]
    return Looked(own, tuple(k for k, _ in found), tuple(i.reshape(-1) for _, i in found))


def log_probabilities(x: Looked, ask: Callable[[int, np.ndarray | None], np.ndarray], n: int, v: int) -> np.ndarray:
    """log10 p of each token; ask(kind, places or all) gives q of those distinct n-grams of a kind."""
    q1 = ask(0, None)[x.back[0]]
    later = x.own.later
    end = np.searchsorted(x.keys[0], END)
    before = np.full(len(q1), ask(0, np.array([end]))[0] if len(q1) else 0)
    before[later] = q1[later - 1]
    q2 = np.minimum(np.minimum(ask(1, None)[x.back[1]], q1), before)
    p1 = np.minimum((VALUE[q1] + 1.0) / (n + v + 1.0), 1.0)
    p = np.where(before > 0, LAMBDA * VALUE[q2] / np.maximum(VALUE[before], 1) + (1 - LAMBDA) * p1, p1)
    known = (q2[later - 1] > 1) & (q2[later] > 1)  # a triple that is held has such parts
    wanted, back = np.unique(x.back[2][known], return_inverse=True)
    q3 = np.zeros(len(later), np.int64)
    q3[known] = ask(2, wanted)[back.reshape(-1)]
    q3 = np.minimum(np.minimum(q3, q2[later - 1]), q2[later])
    often = q2[later - 1] > 1
    at = later[often]
    p[at] = LAMBDA * VALUE[q3[often]] / VALUE[q2[at - 1]] + (1 - LAMBDA) * p[at]
    return np.log10(p)


def hot_words(table: DataFrame, least_q: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of the words of q >= least_q; the caller has bounded how many."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys = np.frombuffer(k, "<u8")
                counts = unpack_counts(c, len(keys))
                many = steps(counts) >= least_q
                yield pa.RecordBatch.from_arrays([pa.array([keys[many].tobytes()], pa.binary()), pa.array([counts[many].astype("<i8").tobytes()], pa.binary())], ["keys", "counts"])

    got = table.select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").toArrow()
    keys = np.frombuffer(b"".join(got.column("keys").to_pylist()), "<u8")
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), "<i8")
    order = np.argsort(keys)
    return keys[order], counts[order]


def score_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", hot_words_most: int = HOT_WORDS, max_filter_bytes: int = MAX_FILTER_BYTES, bits_each: int = BITS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    buckets = 1 << max(6, min(20, (input_bytes(docs) >> 21).bit_length()))
    table = cut(count_ngrams(rows, buckets, bits_each))
    total = table.agg(F.sum("tokens").alias("n"), F.sum("n_words").alias("v"), F.sum(F.length("filter")).alias("bytes"), *(F.sum(F.get("histogram", F.lit(q))).alias(f"q{q}") for q in range(1, TOP + 2))).first()
    n, v = total["n"] or 0, total["v"] or 0
    by_q = [0, *(total[f"q{q}"] or 0 for q in range(1, TOP + 2))]
    least_q = next(q for q in range(1, TOP + 3) if sum(by_q[q:]) <= hot_words_most)
    keys, counts = hot_words(table, least_q) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sent = (total["bytes"] or 0) <= max_filter_bytes
    maps = {r.bucket: bytes(r.filter) for r in table.select("bucket", "filter").toLocalIterator()} if sent else {}
    shared = spark.sparkContext.broadcast((keys, counts, Filter(maps, buckets) if sent else None))
    del maps
    norm = float(n + v + 1)
    whole = len(keys) == v

    names = ["bucket", "uid", "k", "mark", "held_out", "n_tokens", "n_known", "base", "lm", "ask", "who"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_counts, filter_ = shared.value
        for batch in batches:
            held = ~in_training(batch.column("k").to_pylist())
            uids = batch.column("uid").to_numpy()
            for block in blocks(batch.column("t"), LARGE_BLOCK):
                to = slice(block.first_row, block.first_row + len(block))
                x, m = distinct(grams(block)), len(block)
                own, (found, _, _), (back, _, _) = x.own.rows, x.keys, x.back
                at = np.minimum(np.searchsorted(hot_keys, found), max(len(hot_keys) - 1, 0))
                known = hot_keys[at] == found if len(hot_keys) else np.zeros(len(found), bool)
                c = np.where(known, hot_counts[at], 0)[back] if len(hot_keys) else np.zeros(len(own), np.int64)
                known = known[back]
                length = np.bincount(own, minlength=m)
                lm = np.zeros(m)
                if filter_ is not None:
                    lm = np.bincount(own, weights=log_probabilities(x, lambda kind, some, x=x: filter_.probe(x.keys[kind] if some is None else x.keys[kind][some]), n, v), minlength=m)
                base = np.bincount(own, weights=np.log10(c + 1.0), minlength=m) - length * np.log10(norm)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array((uids[to] % buckets).astype(np.int32)), pa.array(uids[to]), batch.column("k").slice(block.first_row, m), batch.column("mark").slice(block.first_row, m)),
                        *(pa.array(held[to]), pa.array(length.astype(np.int64)), pa.array(np.bincount(own, weights=known, minlength=m).astype(np.int64))),
                        *(pa.array(base), pa.array(lm), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())),
                    ],
                    names,
                )
                if not whole:
                    yield _parcels(x.own.tokens[~known], uids[to][own[~known]], buckets, names, batch.schema.field("k").type)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        """Base scores of the words that are not broadcast."""
        own = asked.filter(asked.column("ask").is_null())
        parts = [own.select(["uid", "k", "mark", "held_out", "n_tokens", "n_known", "base", "lm"])]
        keys = np.frombuffer(held.column("keys")[0].as_py(), "<u8") if held.num_rows else np.zeros(0, np.uint64)
        counts = unpack_counts(held.column("counts")[0].as_py(), len(keys)) if held.num_rows else np.zeros(0, np.int64)
        sent = asked.filter(asked.column("ask").is_valid())
        if sent.num_rows:  # all questions at once: they are many and small
            ask, who = (np.frombuffer(b"".join(sent.column(c).to_pylist()), t) for c, t in (("ask", "<u8"), ("who", "<i8")))
            uid, back = np.unique(who, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, ask), max(len(keys) - 1, 0))
            c = np.where(keys[at] == ask, counts[at], 0) if len(keys) else np.zeros(len(ask))
            known, base = np.bincount(back, weights=c > 0, minlength=len(uid)), np.bincount(back, weights=np.log10(c + 1.0), minlength=len(uid))
            m = len(uid)
            parts.append(pa.table([pa.array(uid), pa.nulls(m, own.schema.field("k").type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.zeros(m))], names=parts[0].column_names))
        return pa.concat_tables(parts)

    out = f"uid bigint, k {kind}, mark bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, lm double"
    numbered = rows.select("k", "t", F.monotonically_increasing_id().alias("uid"), F.coalesce(F.crc32(F.col("t").cast("binary")), F.lit(0)).alias("mark"))
    seen = numbered.mapInArrow(visit, f"bucket int, {out}, ask binary, who binary")
    parts = seen.groupBy("bucket").cogroup(table.select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(answer, out)
    if not sent:
        parts = parts.unionByName(asked_scores(numbered, table.select("bucket", "filter"), buckets, n, v), allowMissingColumns=True)
    same = F.when(F.min("mark") == F.max("mark"), F.sum("lm")).otherwise(F.raise_error(F.lit(ORDER)).cast("double"))
    summed = parts.groupBy("uid").agg(F.max("k").alias("k"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), same.alias("score"))
    return summed.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def asked_scores(rows: DataFrame, filters: DataFrame, buckets: int, n: int, v: int) -> DataFrame:
    """(uid, mark, lm) where the filter stays in its buckets: groups of texts ask for each n-gram once.

    rows: k, t, uid, mark. Groups are runs of some MB of a partition's texts, alike in both readings.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        context, done = TaskContext.get(), 0
        base = (context.partitionId() if context else 0) << 32
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            number = (done + np.cumsum(size) - size) // GROUP_BYTES
            done += int(size.sum())
            for g in np.unique(number).tolist():
                at = np.flatnonzero(number == g)
                yield base + g, batch.slice(int(at[0]), len(at))

    def looked(texts: list[Block]) -> Looked:
        parts, first, row = [], 0, 0
        for block in texts:
            g = grams(block)
            parts.append(Grams(g.tokens, g.rows + row, g.pairs, g.later + first, g.triples))
            first, row = first + len(g.tokens), row + len(block)
        return distinct(Grams(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("tokens", "rows", "pairs", "later", "triples"))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def send() -> pa.RecordBatch:
            x = looked(list(blocks(pa.concat_arrays(held), LARGE_BLOCK)))
            out = [(b, now, kind, pack_grams(keys[p])) for kind, keys in enumerate(x.keys) for b, p in by_bucket(keys, buckets)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "g", "kind", "ask"])

        for g, batch in grouped(batches):
            if held and g != now:
                yield send()
                held = []
            now = g
            held.append(batch.column("t"))
        if held:
            yield send()

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        bucket = asked.column("bucket")[0].as_py() if asked.num_rows else 0
        bits = Filter({0: held.column("filter")[0].as_py()} if held.num_rows else {}, 1)
        press = zstandard.ZstdCompressor(level=1)
        found = [press.compress(q) for q in probed(asked.column("ask"), bits)]
        return pa.table([asked.column("g"), asked.column("kind"), pa.array([bucket] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["g", "kind", "bucket", "q"])

    def send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for g, batch in grouped(batches):
            for block in blocks(batch.column("t"), LARGE_BLOCK):
                own = batch.slice(block.first_row, len(block))
                packed = [own.column("uid").to_numpy().tobytes(), own.column("mark").to_numpy().tobytes(), block.offsets.astype("<i8").tobytes(), press.compress(block.data)]
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], ["g", "uids", "marks", "offsets", "texts"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        held = sorted(((np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["marks"], "<i8"), Block(0, unpress.decompress(r["texts"]), np.frombuffer(r["offsets"], "<i8"))) for r in texts.to_pylist()), key=lambda r: int(r[0][0]))
        uids, marks = np.concatenate([u for u, _, _ in held]), np.concatenate([m for _, m, _ in held])
        x = looked([b for _, _, b in held])
        q = [np.full(len(k), -1) for k in x.keys]
        got = {(r["kind"], r["bucket"]): np.frombuffer(unpress.decompress(r["q"]), np.uint8) for r in answers.to_pylist()}
        for kind, keys in enumerate(x.keys):
            for b, p in by_bucket(keys, buckets):
                if len(got.get((kind, b), ())) != len(p):
                    raise RuntimeError(ORDER)
                q[kind][p] = got[kind, b]
        lm = np.bincount(x.own.rows, weights=log_probabilities(x, lambda kind, some: q[kind] if some is None else q[kind][some], n, v), minlength=len(uids))
        return pa.table([pa.array(uids), pa.array(marks), pa.array(lm)], names=["uid", "mark", "lm"])

    asked = rows.mapInArrow(ask, "bucket int, g bigint, kind int, ask binary")
    answers = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "g bigint, kind int, bucket int, q binary")
    texts = rows.mapInArrow(send_texts, "g bigint, uids binary, marks binary, offsets binary, texts binary")
    return texts.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, "uid bigint, mark bigint, lm double")


def _parcels(ask: np.ndarray, who: np.ndarray, buckets: int, names: list[str], key_type: pa.DataType) -> pa.RecordBatch:
    """Questions to the buckets: a row for each bucket asked."""
    parts = list(by_bucket(ask, buckets))
    m = len(parts)
    empty = [pa.nulls(m, t) for t in (pa.int64(), key_type, pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b for b, _ in parts], pa.int32()),
            *empty,
            pa.array([ask[p].astype("<u8").tobytes() for _, p in parts], pa.binary()),
            pa.array([who[p].astype("<i8").tobytes() for _, p in parts], pa.binary()),
        ],
        names,
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
