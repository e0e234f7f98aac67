"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries into words (the vocabulary's tokenizer drops white space and no
token spans it), the distinct words of a block that are not yet known go to the tokenizer in batches
balanced by bytes, and a text's length is the sum over its words. A worker remembers the lengths of a
bounded number of words (`Memo`); results don't depend on it. A word of more than `LONG_PIECE` characters (a text
without white space) is cut again where the vocabulary's pre-tokenizer always begins a new piece: between ASCII
letters and digits, and after East Asian punctuation that a letter follows.

Cases: a null or empty text has no tokens; special strings inside a text count as the tokenizer's
default has them (they hold no white space, so a cut never splits one); repeated rows give repeated
results; other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .session import bounded_batches, documents

VOCABULARY = "word_bpe_49k.json"
MAX_TOKENS = 2048
BATCH_BYTES = 1 << 16
MEMO_WORDS = 300_000
LONG_WORD = 64
LONG_PIECE = 4_096
SAFE = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[。、，．！？「」])(?=[^\W\d_])")
SPACES = re.compile(r"[\t\n\x0b\x0c\r ]+")


class Memo(dict):
    """What the tokenizer gave for words, in two generations of at most `MEMO_WORDS` each between blocks.

    A full generation becomes the old one; words of the old one that come up again move over, the
    rest goes with the next change. Words longer than `LONG_WORD` are forgotten after their block.
    """

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}
        self.new_words: list[str] = []

    def missing(self, wanted: set[str]) -> list[str]:
        unknown = []
        for w in wanted.difference(self):
            if w in self.old:
                self[w] = self.old[w]
            else:
                unknown.append(w)
        self.new_words = unknown
        return unknown

    def trim(self) -> None:
        for w in self.new_words:
            if len(w) > LONG_WORD:
                self.pop(w, None)
        if len(self) > MEMO_WORDS:
            self.old = dict(self)
            self.clear()


_state: dict[str, tuple[object, Memo]] = {}


def load(path: str):
    """The tokenizer of a file, one per worker process, on this thread only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _state:
        from tokenizers import Tokenizer

        _state[path] = (Tokenizer.from_file(path), Memo())
    return _state[path]


def by_bytes(items: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about equal bytes; an item longer than `most` is a batch of its own."""
    batch: list[str] = []
    size = 0
    for item in items:
        n = len(item.encode())
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(item)
        size += n
    if batch:
        yield batch


def split(text: str | None) -> list[str]:
    """Words of a text, cut at the white space that both Python and the tokenizer take for such."""
    if not text:
        return []
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return SPACES.split(text)
    return text.split()


def encoded_lengths(tokenizer, pieces: list[str]) -> list[int]:
    """Tokens of each piece, in batches of about equal bytes."""
    return [len(e) for batch in by_bytes(pieces) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


def safe_pieces(word: str) -> list[str]:
    """A long word cut where the pre-tokenizer always cuts; one that may hold a special string stays whole."""
    return [word] if "<|" in word else SAFE.split(word)


def lengths(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each whole text."""
    tokenizer, memo = load(path)
    cut = [split(text) for text in texts]
    missing = memo.missing({w for ws in cut for w in ws})
    whole = [w for w in missing if len(w) <= LONG_PIECE]
    memo.update(zip(whole, encoded_lengths(tokenizer, whole), strict=True))
    for w in missing:
        if len(w) > LONG_PIECE:
            memo[w] = sum(encoded_lengths(tokenizer, safe_pieces(w)))
    out = [sum(map(memo.__getitem__, ws)) for ws in cut]
    memo.trim()
    return out


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; a narrow map without a shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t")
            sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            counts: list[int] = []
            for lo, hi in ranges(sizes.to_numpy(zero_copy_only=False)):
                counts += lengths(column.slice(lo, hi - lo).to_pylist(), path)
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), sizes, n, pc.greater(n, max_tokens)], ["k", "n_bytes", "n_tokens", "over_limit"])

    out = docs.selectExpr(f"`{key}` AS k", f"cast(`{text}` AS string) AS t").mapInArrow(run, f"k {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("k", key)


def ranges(sizes, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges holding about `most` bytes each."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += int(size)
    if len(sizes) > lo:
        yield lo, len(sizes)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
