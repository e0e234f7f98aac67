"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Texts are encoded with a space before them by a byte-level vocabulary (A) and a piece vocabulary (B). The B
tokens of a block of texts make a static interval index, two sorted arrays of starts and ends; every A
token is a stabbing query against it, answered by bisection, and lists the B tokens whose byte range
overlaps its own. A place between bytes that no token of either side spans is a group boundary.

How often two ids are linked over the whole corpus is counted once. Tasks gather texts into chunks; a chunk holds
its distinct id pairs (`CHUNK_PAIRS`, beside one block's) with their counts, and every text's links as
places among them. Both are a checkpoint in the shared folder, which nothing repeats. Pairs are added up by a
shuffle with map-side sums, each B id's highest count (at most a row an id of the vocabulary) is broadcast back,
and the counts return to the chunks that asked, a row per chunk and pair: a pair that every text
holds costs a row a chunk. Texts never travel, their packed links do, once; what a task holds of the counts is
one chunk's. Nothing else is broadcast, so the plan is the same at every size.

Cases: a null or empty text has no tokens, nor has one that either vocabulary doesn't give back byte by
byte (with U+2581, say): zeros and an empty digest; special strings in a text are plain text; repeated
rows count each time and have equal results; null and equal keys stay apart by row; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import LONG_WORD, Encoder, Memo
from .session import bounded_batches, cut, documents
from .textblocks import Block, blocks, span_hashes

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs of a chunk before it closes, links that it holds at most beside one block's, and pairs in a row on their way to being counted.
CHUNK_PAIRS, CHUNK_LINKS, ROW_PAIRS = 1 << 17, 1 << 23, 4_096
#: How the piece vocabulary writes a space.
SPACE_PIECE = "▁"


def runs(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places at[i] .. at[i] + count[i] - 1 of all i in turn."""
    return np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: printable Latin letters for themselves, letters from U+0100 on for the other bytes in turn."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class TokenBytes:
    """The bytes of every id of a vocabulary, one after another."""

    data: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> TokenBytes:
        lengths = np.array([len(e) for e in entries], np.int64)
        return cls(np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lengths) - lengths, lengths)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[runs(self.begins[ids], self.lengths[ids])]


class ByteEncoder(Encoder):
    """Ids and bytes of the byte-level vocabulary; special strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        entries = [b""] * len(self.begins)
        for token, id_ in self.tokenizer.get_vocab(with_added_tokens=True).items():
            entries[id_] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes = TokenBytes.of(entries)


class PieceEncoder:
    """Ids and bytes of the piece vocabulary.

    No piece holds a space after another character, so nothing is merged over the place before a run of
    spaces: texts are cut there, and each distinct word goes to the tokenizer once while it is remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model, self.memo = sentencepiece.SentencePieceProcessor(model_file=path), Memo()
        self.space = self.model.piece_to_id(SPACE_PIECE)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.cuts = not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces)
        self.bytes = TokenBytes.of([bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)])

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many of each) of words that a space begins: the tokenizer adds that space itself."""
        found = [ids or [self.space] for ids in self.model.encode([w[1:].decode() for w in words], num_threads=1)] if words else []
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), "<u4", int(count.sum())), count

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in turn, how many of each row); every row begins with a space."""
        data, n = block.array, len(block.data)
        cut = np.zeros(n + 1, bool)
        cut[block.offsets[:-1]] = True
        if self.cuts and n > 1:
            cut[1:n] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        row = np.searchsorted(block.offsets, starts, side="right") - 1
        short, long = np.flatnonzero(ends - starts <= LONG_WORD), np.flatnonzero(ends - starts > LONG_WORD)
        distinct, first, back = np.unique(span_hashes(data, starts[short], ends[short]), return_index=True, return_inverse=True)
        left = self.memo.missing(distinct)
        new = short[first[left]]
        ids, many = self.each([block.data[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        if len(left):
            self.memo.put(distinct[left], many, ids)
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        spot = np.searchsorted(self.memo.keys, distinct)[back.reshape(-1)]
        at[short], count[short] = self.memo.at[spot], self.memo.count[spot]
        extra, many = self.each([block.data[s:e] for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        at[long], count[long] = len(self.memo.ids) + np.cumsum(many) - many, many
        out = np.concatenate([self.memo.ids, extra])[runs(at, count)]
        self.memo.trim()
        return out, np.bincount(row, weights=count, minlength=len(block)).astype(np.int64)


class Intervals:
    """A static index over intervals that follow each other: starts and ends are both ascending."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def stab(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, number) of the intervals that overlap [low, high), by bisection on either array."""
        first = np.searchsorted(self.ends, low, side="right")
        return first, np.searchsorted(self.starts, high, side="left") - first


@dataclass
class Aligned:
    """The tokens of the rows of a block, row after row: counts by row; groups and links of tokens."""

    n_a: np.ndarray
    n_b: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_b: np.ndarray
    overlaps: np.ndarray

    @property
    def rows_a(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_a)), self.n_a)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, A id, B id) of every link, in the order of the A tokens."""
        return np.repeat(self.rows_a, self.overlaps), np.repeat(self.ids_a, self.overlaps), self.ids_b[runs(self.first_b, self.overlaps)]

    def groups(self) -> np.ndarray:
        """Groups of each row."""
        closing = np.ones(len(self.ids_a), bool)
        closing[:-1] = self.group_a[1:] != self.group_a[:-1]
        return np.bincount(self.rows_a, weights=closing, minlength=len(self.n_a)).astype(np.int64)


def spaced(block: Block) -> Block:
    """The block with a space before every row."""
    n = len(block)
    offsets = block.offsets + np.arange(n + 1)
    data = np.empty(len(block.data) + n, np.uint8)
    place = np.ones(len(data), bool)
    place[offsets[:-1]] = False
    data[offsets[:-1]] = 0x20
    data[place] = block.array
    return Block(block.first_row, data.tobytes(), offsets)


def align_block(block: Block, a: ByteEncoder, b: PieceEncoder) -> Aligned:
    """Aligns the rows of a block of texts."""
    text = spaced(block)
    n, size = len(text), np.diff(text.offsets)
    sides = []
    good = size > 1
    for coder in (a, b):
        ids, count = coder.encode(text)
        ids = ids.astype(np.int64)
        row = np.repeat(np.arange(n), count)
        fits = np.bincount(row, weights=coder.bytes.lengths[ids], minlength=n).astype(np.int64) == size
        own = fits[row]
        where = np.repeat(fits, size)
        differs = coder.bytes.joined(ids[own]) != text.array[where]
        wrong = np.bincount(np.repeat(np.arange(n), size)[where], weights=differs, minlength=n) > 0
        good &= fits & ~wrong
        sides.append((ids, row))
    parts = []
    for (ids, row), coder in zip(sides, (a, b), strict=True):
        own = good[row]
        ids = ids[own]
        parts.append((ids, np.bincount(row[own], minlength=n), np.cumsum(coder.bytes.lengths[ids])))
    (ids_a, n_a, ends_a), (ids_b, n_b, ends_b) = parts
    starts_a, starts_b = ends_a - a.bytes.lengths[ids_a], ends_b - b.bytes.lengths[ids_b]
    first, overlaps = Intervals(starts_b, ends_b).stab(starts_a, ends_a)
    spanned = np.ones(int(size[good].sum()) + 1, np.int8)  # places between bytes: 0 where tokens of both sides end
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    spanned[both] = 0
    last_a, last_b = spanned[ends_a] == 0, spanned[ends_b] == 0
    return Aligned(n_a, n_b, ids_a, ids_b, np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b, first, overlaps)


def group_texts(aligned: Aligned, digits: TokenBytes) -> list[bytes]:
    """Each row's groups as `a1,a2|b1;a3|b2,b3`; b'' of a row without tokens."""
    ga, gb, n = aligned.group_a, aligned.group_b, len(aligned.n_a)
    at_a = np.arange(len(ga)) + np.searchsorted(gb, ga, side="left")
    at_b = np.arange(len(gb)) + np.searchsorted(ga, gb, side="right")
    total = len(ga) + len(gb)
    ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[at_a], ids[at_b] = aligned.ids_a, aligned.ids_b
    closing_a, closing_b = np.ones(len(ga), bool), np.ones(len(gb), bool)
    closing_a[:-1], closing_b[:-1] = ga[1:] != ga[:-1], gb[1:] != gb[:-1]
    mark[at_a[closing_a]], mark[at_b[closing_b]] = ord("|"), ord(";")
    width = digits.lengths[ids] + 1
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if total else 0, np.uint8)
    place = np.ones(len(out), bool)
    place[ends - 1] = False
    out[place] = digits.joined(ids)
    out[ends - 1] = mark
    data = out.tobytes()
    row_end = np.concatenate([[0], np.cumsum(aligned.n_a + aligned.n_b)])
    byte_end = np.concatenate([[0], ends])[row_end].tolist()
    return [data[byte_end[i] : max(byte_end[i + 1] - 1, byte_end[i])] for i in range(n)]


@dataclass
class Coders:
    a: ByteEncoder
    b: PieceEncoder
    digits: TokenBytes


_coders: dict[tuple[str, str], Coders] = {}


def coders(path_a: str, path_b: str) -> Coders:
    """Both encoders, once per worker process."""
    if (path_a, path_b) not in _coders:
        a, b = ByteEncoder(path_a), PieceEncoder(path_b)
        _coders[path_a, path_b] = Coders(a, b, TokenBytes.of([str(i).encode() for i in range(max(len(a.bytes.lengths), len(b.bytes.lengths)))]))
    return _coders[path_a, path_b]


class Chunk:
    """Distinct pairs of ids in the order of their coming, with their counts."""

    def __init__(self) -> None:
        self.codes, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.links = 0

    def add(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code; new ones take the next."""
        order = np.argsort(codes, kind="stable")
        ranked = codes[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        distinct = ranked[begins]
        spot = np.searchsorted(self.codes, distinct)
        new = np.ones(len(distinct), bool)
        inside = spot < len(self.codes)
        new[inside] = self.codes[spot[inside]] != distinct[inside]
        fresh = distinct[new]
        self.places = np.insert(self.places, spot[new], len(self.codes) + np.arange(len(fresh)))
        self.codes = np.insert(self.codes, spot[new], fresh)
        self.counts = np.concatenate([self.counts, np.zeros(len(fresh), np.int64)])
        own = self.places[np.searchsorted(self.codes, distinct)]
        many = np.diff(np.append(begins, len(ranked)))
        self.counts[own] += many
        self.links += len(codes)
        out = np.empty(len(codes), np.int64)
        out[order] = np.repeat(own, many)
        return out

    def full(self) -> bool:
        return len(self.codes) >= CHUNK_PAIRS or self.links >= CHUNK_LINKS

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, counts) by place."""
        codes = np.empty(len(self.codes), np.int64)
        codes[self.places] = self.codes
        return codes, self.counts


def pack_places(places: np.ndarray, rows: np.ndarray, n_rows: int) -> list[bytes]:
    """The places of each row's links in ascending order: differences, their bytes in planes, compressed."""
    ranked = np.sort(rows << 32 | places)
    steps = np.diff(ranked & 0xFFFFFFFF, prepend=0)
    ends = np.cumsum(np.bincount(rows, minlength=n_rows))
    begins = ends - np.bincount(rows, minlength=n_rows)
    some = begins < ends
    steps[begins[some]] = (ranked & 0xFFFFFFFF)[begins[some]]
    press = zstandard.ZstdCompressor(level=1)
    steps = steps.astype("<u4")
    return [press.compress(np.ascontiguousarray(steps[s:e].view(np.uint8).reshape(-1, 4).T).tobytes()) if e > s else b"" for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def unpack_places(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.int64)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The alignment itself, a row per row: (key, a_ids, b_ids, a_groups, b_groups, first_b, overlaps).

    `a_groups` and `b_groups` number each token's group within the text; the A token at place i overlaps
    `overlaps[i]` B tokens from `first_b[i]` on. A narrow map.
    """
    bounded_batches(docs.sparkSession)
    names = ["a_ids", "b_ids", "a_groups", "b_groups", "first_b", "overlaps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coders(path_a, path_b)
        for batch in batches:
            for block in blocks(batch.column("t")):
                x = align_block(block, coder.a, coder.b)
                at_a, at_b = np.concatenate([[0], np.cumsum(x.n_a)]), np.concatenate([[0], np.cumsum(x.n_b)])
                base = np.concatenate([[0], np.cumsum(x.groups())])[:-1]
                columns = [
                    *((x.ids_a, at_a), (x.ids_b, at_b), (x.group_a - np.repeat(base, x.n_a), at_a)),
                    *((x.group_b - np.repeat(base, x.n_b), at_b), (x.first_b - np.repeat(at_b[:-1], x.n_a), at_a), (x.overlaps, at_a)),
                ]
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v, at in columns]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(block.first_row, len(block)), *lists], ["k", *names])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS k", f"cast(`{text}` AS string) AS t").mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} array<int>" for n in names))
    return out.withColumnRenamed("k", key)


def _chunked(docs: DataFrame, path_a: str, path_b: str, text: str, key: str) -> DataFrame:
    """Rows of texts (`codes` null) and, after a chunk's texts, rows of its pairs (`place` is the first one's)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"chunk bigint, place bigint, k {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, codes array<bigint>, counts array<bigint>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coders(path_a, path_b)
        width = len(coder.b.bytes.lengths)
        context = TaskContext.get()
        number, chunk = (context.partitionId() if context else 0) << 32, Chunk()

        def pairs() -> pa.RecordBatch:
            codes, counts = chunk.listed()
            at = np.arange(0, len(codes), ROW_PAIRS)
            ends = pa.array(np.append(at, len(codes)), pa.int32())
            own = {"chunk": pa.array(np.full(len(at), number)), "place": pa.array(at), "codes": pa.ListArray.from_arrays(ends, pa.array(codes)), "counts": pa.ListArray.from_arrays(ends, pa.array(counts))}
            return _filled(own, len(at))

        def _filled(own: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(n, kinds[c])) for c in names], names)

        kinds = {"k": None, "groups_sha256": pa.string(), "links": pa.binary(), "codes": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
        kinds |= {c: pa.int64() for c in names if c not in kinds}
        for batch in batches:
            kinds["k"] = batch.column("k").type
            for block in blocks(batch.column("t")):
                x = align_block(block, coder.a, coder.b)
                rows, a, b = x.links()
                packed = pack_places(chunk.add(a * width + b), rows, len(block))
                sha = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(x, coder.digits)]
                figures = {"n_a": x.n_a, "n_b": x.n_b, "n_groups": x.groups(), "n_links": np.bincount(rows, minlength=len(block))}
                own = {"chunk": pa.array(np.full(len(block), number)), "k": batch.column("k").slice(block.first_row, len(block)), "groups_sha256": pa.array(sha), "links": pa.array(packed, pa.binary())}
                yield _filled(own | {c: pa.array(v.astype(np.int64)) for c, v in figures.items()}, len(block))
                if chunk.full():
                    yield pairs()
                    number, chunk = number + 1, Chunk()
        if len(chunk.codes):
            yield pairs()

    return docs.selectExpr(f"`{key}` AS k", f"cast(`{text}` AS string) AS t").mapInArrow(run, schema)


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """(code, n, best): links of each pair of ids, and whether no other pair of its B id has more."""
    counted = pairs.groupBy("code").agg(F.sum("n").alias("n")).withColumn("b", F.pmod("code", F.lit(width)))
    highest = counted.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of the vocabulary at most
    return counted.join(F.broadcast(highest), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_figures(docs: DataFrame, path_a: str, path_b: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    import sentencepiece

    bounded_batches(docs.sparkSession)
    stored = cut(_chunked(docs, path_a, path_b, text, key))
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    pairs = stored.where("codes IS NOT NULL").select("chunk", "place", F.posexplode(F.arrays_zip("codes", "counts")).alias("at", "x"))
    pairs = pairs.select("chunk", (F.col("place") + F.col("at")).alias("place"), F.col("x.codes").alias("code"), F.col("x.counts").alias("n"))
    counted = pair_counts(pairs.select("code", "n"), width)
    answers = pairs.select("chunk", "place", "code").join(counted, "code")
    texts = stored.where("codes IS NULL").drop("codes", "counts", "place")
    empty = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in texts.columns if c != "chunk"]
    replies = answers.select("chunk", *empty, "place", (F.col("n") * 2 + F.col("best").cast("long")).alias("answer"))
    asked = texts.select("*", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("answer"))
    met = replies.unionByName(asked).repartition("chunk").sortWithinPartitions("chunk", F.desc("place"))
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's answers come first, from the last place to the first, then its texts."""
        answers: list[np.ndarray] = []
        table, chunk = np.zeros(0, np.int64), None
        for batch in batches:
            chunks, places = batch.column("chunk").to_numpy(), batch.column("place").to_numpy()
            edges = np.flatnonzero((chunks[1:] != chunks[:-1]) | ((places[1:] < 0) != (places[:-1] < 0))) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(chunks)], strict=True):
                if lo == hi:
                    continue
                if chunks[lo] != chunk:
                    answers, table, chunk = [], np.zeros(0, np.int64), chunks[lo]
                part = batch.slice(lo, hi - lo)
                if places[lo] >= 0:
                    answers.append(part.column("answer").to_numpy())
                    continue
                if answers:
                    table, answers = np.concatenate(answers)[::-1], []
                found = [table[unpack_places(x)] for x in part.column("links").to_pylist()]
                best = pa.array([int((f & 1).sum()) for f in found], pa.int64())
                total = pa.array([int((f >> 1).sum()) for f in found], pa.int64())
                own = {"n_best": best, "count_sum": total}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else part.column(c) for c in names], names)

    schema = f"k {kind}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"
    return met.mapInArrow(run, schema).withColumnRenamed("k", key)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY)
    return alignment_figures(documents(spark, sf_dir), *paths)
