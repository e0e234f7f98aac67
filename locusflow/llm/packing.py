"""Best-fit packing: bounded-space online best fit into sequences of a fixed capacity.

A document is its token ids followed by one closing id. Documents longer than the capacity are cut:
the first piece takes the remainder, all later ones are full and make sequences of their own. The
other pieces go, as they come, to the fullest open bin that still has room. Open bins hang on a
bitset keyed by free space, so the best fit is the lowest set bit at or above the piece's length;
when `open_bins` are open and none fits, the fullest closes and a new one opens. Each task packs the
rows of its own partition, so there is no shuffle and memory is `open_bins` small lists; partitions
below about 8 MiB of input are read together, for the bins that a task leaves open are its waste.

Ids: texts are cut where the byte-level vocabulary's pre-tokenizer always cuts; a block's distinct
pieces that are not remembered go to the tokenizer together, and ids are gathered from arrays. A
text with a special string goes to the tokenizer whole.

Cases: a null or empty text is one piece holding the closing id; repeated rows are packed once each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .session import bounded_batches, documents, input_bytes
from .textblocks import Block, blocks, span_hashes
from .token_counts import load, ranges

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
OPEN_BINS = 256
CLOSING_ID = 0
SPECIAL = b"<|endoftext|>"
#: How the byte-level alphabet writes a space.
SPACE_LETTER = "\u0120"
LONG_WORD, MEMO_PIECES = 64, 1 << 18


class Bins:
    """Open bins by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free: dict[int, list[int]] = defaultdict(list)
        self.bits = 0
        self.open = 0
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        if length >= self.capacity:
            return self.new(), 0
        fitting = self.bits >> length
        if fitting:
            room = length + ((fitting & -fitting).bit_length() - 1)
            bin_ = self._take(room)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            room, bin_ = self.capacity, self.new()
        if room > length:
            self.free[room - length].append(bin_)
            self.bits |= 1 << (room - length)
            self.open += 1
        return bin_, self.capacity - room

    def _take(self, room: int) -> int:
        bins = self.free[room]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << room)
        self.open -= 1
        return bin_


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: ASCII letters, other printable ASCII too, and bytes that may be, or may begin, white space."""
    letter, shown, blank = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    letter[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
    shown[0x21:0x7F] = True
    blank[:0x21] = True
    blank[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
    return letter, shown, blank


_LETTER, _SHOWN, _BLANK = _kinds()


def cut_places(block: Block) -> np.ndarray:
    """Where pieces begin, in ascending order, row starts included.

    A cut stands where the byte-level pre-tokenizer always begins a new word, and where what it makes of
    either side doesn't depend on the other: after an ASCII letter that something else in ASCII follows,
    before a space and a character that surely isn't white space, and after a line break between
    two printable ones.
    """
    data = block.array
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[block.offsets[:-1]] = True
    if n > 1:
        letter, shown, blank = _LETTER[data], _SHOWN[data], _BLANK[data]
        cut[1:n] |= letter[:-1] & ~letter[1:] & (data[1:] < 0x80)
        cut[: n - 1] |= (data[:-1] == 0x20) & ~blank[1:]
        cut[2:n] |= (data[1:-1] == 0x0A) & shown[:-2] & shown[2:]
    return np.flatnonzero(cut[:n])


class Memo:
    """Ids of pieces by hash, in sorted arrays, in two generations of at most `MEMO_PIECES` between blocks.

    A full generation becomes the old one; pieces of the old one that come up again move over, the rest
    goes with the next change. Results don't depend on it.
    """

    def __init__(self) -> None:
        self.clear()
        self.old = (self.keys, self.at, self.count, self.ids)

    def clear(self) -> None:
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def put(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Adds sorted new keys, whose ids follow each other in their order."""
        spot = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, spot, len(self.ids) + np.cumsum(count) - count)
        self.count, self.keys = np.insert(self.count, spot, count), np.insert(self.keys, spot, keys)
        self.ids = np.concatenate([self.ids, ids])

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, sorted and distinct, that neither generation has."""
        left = np.flatnonzero(~_held(self.keys, keys))
        again = left[_held(self.old[0], keys[left])]
        if len(again):
            spot = np.searchsorted(self.old[0], keys[again])
            at, count = self.old[1][spot], self.old[2][spot]
            self.put(keys[again], count, self.old[3][_runs(at, count)])
            left = np.setdiff1d(left, again, assume_unique=True)
        return left

    def trim(self) -> None:
        if len(self.keys) > MEMO_PIECES:
            self.old = (self.keys, self.at, self.count, self.ids)
            self.clear()


def _held(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _runs(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places at[i] .. at[i] + count[i] - 1 of all i in turn."""
    return np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Encoder:
    """Token ids of blocks of texts: each distinct piece goes to the tokenizer once while it is remembered."""

    def __init__(self, path: str):
        self.tokenizer, self.memo = load(path)[0], Memo()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, id_ in vocabulary.items():
            self.begins[id_] = token[0] == SPACE_LETTER

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many of each) of texts given to the tokenizer one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), "<u4", int(count.sum())), count

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that a space begins and that hold no other: one text, cut again at the tokens with a space."""
        ids, counts = [], []
        for lo, hi in ranges(np.fromiter(map(len, words), np.int64, len(words)), 1 << 18):
            got = np.array(self.tokenizer.encode_batch_fast([b"".join(words[lo:hi]).decode()], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.begins[got])
            if len(at) == hi - lo:
                count = np.diff(np.append(at, len(got)))
            else:  # this vocabulary holds a space elsewhere: one by one, then
                got, count = self.each([w.decode() for w in words[lo:hi]])
            ids.append(got)
            counts.append(count)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def learn(self, block: Block, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Puts pieces with distinct sorted keys into the memo."""
        data = block.array
        blanks = np.concatenate([[0], np.cumsum(_BLANK[data])])
        plain = (data[starts] == 0x20) & (blanks[ends] == blanks[starts] + 1)
        for chosen, encode in ((plain, self.together), (~plain, lambda words: self.each([w.decode() for w in words]))):
            own = np.flatnonzero(chosen)
            if len(own):
                ids, count = encode([block.data[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
                self.memo.put(keys[own], count, ids)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in turn, how many of each row)."""
        starts = cut_places(block)
        ends = np.append(starts[1:], len(block.data))
        row = np.searchsorted(block.offsets, starts, side="right") - 1
        whole = np.array([SPECIAL in block.row(i) for i in range(len(block))]) if SPECIAL in block.data else np.zeros(len(block), bool)
        apart = (ends - starts > LONG_WORD) | whole[row]  # not remembered
        keys = np.zeros(len(starts), np.uint64)
        short = np.flatnonzero(~apart)
        keys[short] = span_hashes(block.array, starts[short], ends[short])
        distinct, first, back = np.unique(keys[short], return_index=True, return_inverse=True)
        left = self.memo.missing(distinct)
        self.learn(block, starts[short[first[left]]], ends[short[first[left]]], distinct[left])
        spot = np.searchsorted(self.memo.keys, distinct)[back]
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[short], count[short] = self.memo.at[spot], self.memo.count[spot]
        long = np.flatnonzero(apart & ~whole[row])
        special = np.flatnonzero(whole)
        extra, n = self.each([block.data[s:e].decode() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)] + [block.row(i).decode() for i in special.tolist()])
        at_extra = len(self.memo.ids) + np.cumsum(n) - n
        lead = np.searchsorted(starts, block.offsets[special])  # a text with a special string: all of it at its first piece
        slots = np.concatenate([long, lead]).astype(np.int64)
        at[slots], count[slots] = at_extra, n
        ids = np.concatenate([self.memo.ids, extra]) if len(extra) else self.memo.ids
        out = ids[_runs(at, count)]
        self.memo.trim()
        return out, np.bincount(row, weights=count, minlength=len(block)).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    out = []
    for block in blocks(pa.array(texts, pa.string())):
        ids, count = encoder(path).encode(block)
        out += [x.tobytes() for x in np.split(ids, np.cumsum(count)[:-1])]
    return out


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pack(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """A row per piece: (key, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, open_bins)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for block in blocks(batch.column("t")):
                rows: list[tuple] = []
                found, count = encoder(path).encode(block)
                data, ends = found.tobytes(), np.cumsum(count).tolist()
                for i, n in enumerate(count.tolist()):
                    ids = data[4 * (ends[i] - n) : 4 * ends[i]] + closing
                    for number, (start, length) in enumerate(pieces(n + 1, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        bin_, offset = bins.place(length)
                        rows.append((block.first_row + i, number, start, length, zlib.crc32(part), base + bin_, offset) + (part,) * with_ids)
                cols = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=False))], names
                )

    few = max(1, input_bytes(docs) >> 23)  # narrow partitions would leave many bins half empty

    schema = f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return docs.selectExpr(f"`{key}` AS k", f"cast(`{text}` AS string) AS t").coalesce(few).mapInArrow(run, schema).withColumnRenamed("k", key)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
