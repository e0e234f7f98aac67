"""Quality rules with compression bands.

zstandard ratios (raw bytes over compressed) of the whole text and of its fixed chunks must lie in a
band whose limits depend on the text's length: below the band a text is incompressible, above it
repetitive. Rule counts (words, word characters, symbols, repeated lines, repeated word windows)
come from byte arrays and 64-bit hashes of lines and windows, over a block of rows at a time.

Cases: a null or empty text has no words and fails the base rules; a text of fewer than three words
has no windows; lines without a word are never repeats; repeated rows give repeated results; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .session import bounded_batches, documents
from .textblocks import Block, blocks, char_starts, mix, span_hashes, sums_by_row, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Ratio limits by length in bytes: `low[i]`..`high[i]` hold from `lengths[i]` on.

    Short texts compress little, so their lower limits are loose; from 1 KiB on base64 noise reaches
    1.34 and the texts of the sf0.1 table are at 1.68 or above. Long natural texts reach higher
    ratios than short ones. `chunk_share` is the part of a text's chunks, the last of which
    ends with the text, that may lie outside the band of a chunk's length.
    """

    lengths: tuple[int, ...] = (0, 256, 1_024, 8_192, 65_536)
    low: tuple[float, ...] = (0.0, 1.05, 1.40, 1.40, 1.40)
    high: tuple[float, ...] = (3.0, 3.0, 3.2, 3.8, 4.5)
    chunk: int = 4_096
    chunk_share: float = 0.25
    level: int = 3

    def outside(self, length: int, packed: int) -> bool:
        i = bisect_right(self.lengths, length) - 1
        ratio = length / packed if packed else 0.0
        return not self.low[i] <= ratio <= self.high[i]


def compression(text: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio of the whole, chunks, chunks outside, whether the text passes)."""
    if not text:
        return 0.0, 0, 0, True
    packed = len(press.compress(text))
    chunks = out = 0
    view = memoryview(text)
    at_each = list(range(0, len(text) - bands.chunk + 1, bands.chunk))
    if at_each and len(text) % bands.chunk:
        at_each.append(len(text) - bands.chunk)  # the remainder, in a chunk that ends with the text
    for at in at_each:
        chunks += 1
        out += bands.outside(bands.chunk, len(press.compress(view[at : at + bands.chunk])))
    passes = not bands.outside(len(text), packed) and out <= bands.chunk_share * chunks
    return len(text) / packed, chunks, out, passes


def rule_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n, data = len(block), block.array
    starts, ends, rows = words(block)
    points = np.concatenate([[0], np.cumsum(char_starts(data))])
    edges = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    hashes = span_hashes(data, starts, ends)
    return {
        "n_words": sums_by_row(rows, n),
        "word_chars": sums_by_row(rows, n, points[ends] - points[starts]),
        "n_symbols": edges[block.offsets[1:]] - edges[block.offsets[:-1]],
        "n_dup_lines": _repeated_lines(block, starts),
        "n_repeat_words": _repeated_windows(hashes, rows, n),
    }


def _repeated_lines(block: Block, word_starts: np.ndarray) -> np.ndarray:
    n, data = len(block), block.array
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([block.offsets[:-1][np.diff(block.offsets) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(n, dtype=np.int64)
    rows = np.searchsorted(block.offsets, starts, side="right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], block.offsets[rows + 1])
    held = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, rows = starts[held], ends[held], rows[held]
    keys = np.stack([span_hashes(data, starts, ends), rows.astype(np.uint64)])
    order = np.lexsort(keys)
    same = (keys[:, order[1:]] == keys[:, order[:-1]]).all(axis=0)
    return sums_by_row(rows[order[1:]][same], n)


def _repeated_windows(hashes: np.ndarray, rows: np.ndarray, n: int, size: int = 3) -> np.ndarray:
    m = len(hashes) - size + 1
    if m <= 0:
        return np.zeros(n, dtype=np.int64)
    inside = rows[:m] == rows[size - 1 :]
    window = mix(hashes[:m] + np.uint64(0x9E3779B97F4A7C15) * mix(hashes[1 : m + 1] + np.uint64(0x9E3779B97F4A7C15) * mix(hashes[2:])))
    key = mix(window ^ mix(rows[:m].astype(np.uint64) + np.uint64(1)))  # windows of other rows are other windows
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(hashes) + 1, dtype=np.int64)
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + size, -1)
    return sums_by_row(rows[np.cumsum(twice)[:-1] > 0], n)


def judge_quality(docs: DataFrame, *, text: str = "text", key: str = "doc_id", bands: Bands = Bands()) -> DataFrame:
    """Counts, ratios and verdicts of every row; a narrow map without a shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["k", *counted, "base_failed", "kept", "ratio", "n_chunks", "n_chunks_outside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
        for batch in batches:
            for block in blocks(batch.column("t")):
                counts = rule_counts(block)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                pressed = [compression(block.row(i), bands, press) for i in range(len(block))]
                ratio, chunks, out, passes = zip(*pressed, strict=True)
                arrays = [batch.column("k").slice(block.first_row, len(block)), *(pa.array(counts[c], pa.int64()) for c in counted)]
                arrays += [pa.array(failed), pa.array(~failed & np.array(passes)), pa.array(ratio, pa.float64()), pa.array(chunks, pa.int64()), pa.array(out, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"k {kind}, " + ", ".join(f"{c} bigint" for c in counted) + ", base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_chunks_outside bigint"
    return docs.selectExpr(f"`{key}` AS k", f"cast(`{text}` AS string) AS t").mapInArrow(run, schema).withColumnRenamed("k", key)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir))
