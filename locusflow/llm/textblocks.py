"""Blocks of texts as byte arrays, and vectorised word finding and hashing over them.

A block is a slice of an Arrow batch holding about `BLOCK_BYTES` of UTF-8, so the arrays that the
operators derive from it are bounded whatever the number of rows in the batch. A single longer text
makes a block of its own: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Just below a power of two, so that tables over a block's places take no more than they must.
BLOCK_BYTES = (1 << 20) - 4096
#: For operators whose blocks merge what is equal in them.
LARGE_BLOCK = (2 << 20) - 4096

#: Bytes 0x09-0x0D and 0x20 separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z, every other byte to itself. UTF-8 keeps A-Z out of multi-byte characters.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_SEED = np.random.Generator(np.random.PCG64(20_240_607))
_BYTE_KEYS = _SEED.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_MULTIPLIER = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@dataclass
class Block:
    """Bytes of consecutive rows; row i holds data[offsets[i]:offsets[i + 1]]."""

    first_row: int
    data: bytes
    offsets: np.ndarray

    @property
    def array(self) -> np.ndarray:
        return np.frombuffer(self.data, dtype=np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def blocks(texts: pa.Array, target: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string array into blocks of whole rows; a null row is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = memoryview(data) if data is not None else memoryview(b"")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + target, side="right")) - 1)
        yield Block(i, bytes(whole[at[i] : at[j]]), at[i : j + 1] - at[i])
        i = j


def segments(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross rows: (starts, ends, row of each)."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that aren't white space: (starts, ends, row of each)."""
    return segments(~IS_SPACE[block.array], block.offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i below n (grown in powers of two, kept up to one block)."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        p = _MULTIPLIER[lane]
        out = []
        for base in (p, pow(p, -1, 1 << 64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            out.append(table)
        have = (out[0], out[1])
        if size <= 1 << 21:
            _powers[lane] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums of a polynomial modulo 2^64."""
    power, inverse = _power_table(len(data) + 1, lane)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_KEYS[lane][data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def sums_by_row(rows: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of values, per row as int64 (exact: the values are integers below 2^53)."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def char_starts(data: np.ndarray) -> np.ndarray:
    """True where a byte begins a code point."""
    return (data & 0xC0) != 0x80
