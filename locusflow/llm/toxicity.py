"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows.

Inputs of a step, for one word: how toxic the word itself is in the training texts (shrunken
log-odds of document counts), the same of its character n-grams (their greatest and mean), and
trained vectors of the word and of its n-grams. The features live in a bounded lexicon picked from
the training texts; a word that isn't in it acts through its characters. A text is cut into windows of
`WINDOW` words, each begun `STRIDE` words after the last, so neighbours overlap; its score is the
greatest of all its windows. Training takes the window of a text with the greatest log-odds, leaving
the text's own counts out of them, and of clean texts another window at random.

Labels come from a bounded sample: the first `max_toxic` and `max_clean` training rows in the order of
a hash of their keys, and of those only texts of at most `max_bytes`; scoring covers all rows and whole
texts. Nothing but the text enters a score.

Cases: a null, empty or wordless text scores 0; without labels of both kinds every score is 0, so
nothing is rejected; null keys take no part in training and are scored; labels of several rows for one key count once, as the greatest; of several texts with one key
the least is learnt from; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import gru
from .session import bounded_batches, cut, documents, free_name
from .textblocks import LOWER, Block, blocks, mix, segments, span_hashes

WINDOW, STRIDE = 48, 32
HIDDEN, VECTOR = 8, 2
THRESHOLD = 0.3
LEXICON = 1 << 16
#: Documents' worth of doubt in log-odds, and the documents an entry needs for a trained vector.
SHRINK, VECTOR_SUPPORT = 8, 12
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 3000, 20_000
EPOCHS, MIN_STEPS, BATCH, RATE = 4, 240, 64, 0.01
SEED, COUNT_ENTRIES = 11, 4_000_000
#: Character n-grams in bytes: from the word's beginning, and anywhere.
PREFIXES, GRAM = (4, 5, 6), 5
SCORE_WINDOWS = 1_024

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_IN_WORD[128:] = True


@dataclass
class Words:
    """The words of a block: rows, ids of distinct words, and those words' n-grams in CSR form."""

    rows: np.ndarray
    ids: np.ndarray
    word_keys: np.ndarray
    gram_keys: np.ndarray
    gram_owner: np.ndarray


def read_words(block: Block) -> Words:
    lowered = Block(block.first_row, block.data.translate(LOWER), block.offsets)
    data = lowered.array
    starts, ends, rows = segments(_IN_WORD[data], block.offsets)
    hashes, first, ids = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    length = e - s
    keys, owners = [], []
    for n in PREFIXES:
        own = np.flatnonzero(length >= n)
        keys.append(mix(span_hashes(data, s[own], s[own] + n) + np.uint64(n)))
        owners.append(own)
    count = np.maximum(length - GRAM + 1, 0)
    own = np.repeat(np.arange(len(s)), count)
    at = s[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    keys.append(span_hashes(data, at, at + GRAM))
    owners.append(own)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return Words(rows, ids.reshape(-1), mix(hashes + np.uint64(77)), np.concatenate(keys)[order], owner[order])


@dataclass
class Model:
    """The lexicon (sorted keys, document counts by label) and the network. No keys: scores are 0."""

    keys: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    totals: tuple[int, int]
    params: gru.Params

    def odds(self, found: np.ndarray, own_label: int | None = None) -> np.ndarray:
        """Shrunken log-odds of lexicon entries; own_label: leaves one document of that label out."""
        t, c = self.toxic[found].astype(np.float32), self.clean[found].astype(np.float32)
        nt, nc = self.totals
        if own_label is not None:
            t, c = np.maximum(t - own_label, 0), np.maximum(c - 1 + own_label, 0)
            nt, nc = nt - own_label, nc - 1 + own_label
        return np.log((t + 0.5) / (nt + 1) * (nc + 1) / (c + 0.5)) * (t + c) / (t + c + SHRINK) / 3

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def inputs(self, words: Words, own_label: int | None = None) -> tuple[np.ndarray, tuple]:
        """A row of inputs per distinct word, and what the trained vectors' gradients need."""
        n = len(words.word_keys)
        x = np.zeros((n, 3 + 2 * VECTOR), np.float32)
        at, known = self.lookup(words.word_keys)
        w = np.flatnonzero(known)
        x[w, 0] = self.odds(at[w], own_label)
        x[w, 3 : 3 + VECTOR] = self.params["E"][at[w]]
        g_at, g_known = self.lookup(words.gram_keys)
        g = np.flatnonzero(g_known)
        owner, g_at = words.gram_owner[g], g_at[g]
        if len(g):
            odds = self.odds(g_at, own_label)
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(begins, len(g)))
            x[owner[begins], 1] = np.maximum(np.maximum.reduceat(odds, begins), 0)
            x[owner[begins], 2] = np.add.reduceat(odds, begins) / count
            x[owner[begins], 3 + VECTOR :] = np.add.reduceat(self.params["E"][g_at], begins, axis=0) / count[:, None]
        return x, (w, at[w], owner, g_at)


def window_starts(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, row) of every window; each begins STRIDE words after the one before."""
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.cumsum(counts) - counts
    windows = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(n_rows), windows)
    number = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    return firsts[row] + number * STRIDE, np.minimum(WINDOW, counts[row] - number * STRIDE), row


def gathered(ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word ids, mask), both (time, windows); places past a window's end hold word 0, masked."""
    steps = np.arange(int(length.max()))[:, None]
    mask = steps < length
    return ids[np.where(mask, first + steps, first)], mask


def score_block(model: Model, block: Block) -> np.ndarray:
    scores = np.zeros(len(block))
    words = read_words(block)
    if not len(words.rows) or not len(model.keys):
        return scores
    x, _ = model.inputs(words)
    p = model.params
    pre_f, pre_b = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
    first, length, row = window_starts(words.rows, len(block))
    for at in range(0, len(first), SCORE_WINDOWS):
        to = slice(at, at + SCORE_WINDOWS)
        ids, mask = gathered(words.ids, first[to], length[to])
        np.maximum.at(scores, row[to], gru.sigmoid(gru.forward(p, pre_f[ids], pre_b[ids], mask)).astype(float))
    return scores


NO_MODEL = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), (0, 0), {})


def count_keys(parts: Iterable[Words], labels: Iterable[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, toxic, clean): how many texts of each label hold a key, added up over some millions of entries at a time."""
    keys, toxic, clean = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, held_labels, size = [], [], 0

    def add() -> None:
        nonlocal keys, toxic, clean
        label = np.repeat(np.array(held_labels, np.int64), [len(k) for k in held])
        keys, back = np.unique(np.concatenate([keys, *held]), return_inverse=True)
        toxic = np.bincount(back, weights=np.concatenate([toxic, label]), minlength=len(keys)).astype(np.int64)
        clean = np.bincount(back, weights=np.concatenate([clean, 1 - label]), minlength=len(keys)).astype(np.int64)

    for words, label in zip(parts, labels, strict=True):
        held.append(np.unique(np.concatenate([words.word_keys, words.gram_keys])))
        held_labels.append(label)
        size += len(held[-1])
        if size >= COUNT_ENTRIES:
            add()
            held, held_labels, size = [], [], 0
    if held:
        add()
    return keys, toxic, clean


def pick_lexicon(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, totals: tuple[int, int], limit: int = LEXICON) -> Model:
    """Entries held by two texts or more, the `limit` with the most evidence against independence; of ties the least keys."""
    many = toxic + clean >= 2
    keys, toxic, clean = keys[many], toxic[many], clean[many]
    expected = (toxic + clean) * totals[0] / max(sum(totals), 1)
    evidence = (toxic - expected) ** 2 / np.maximum(expected, 1e-9)
    best = np.sort(np.argsort(-evidence, kind="stable")[:limit])
    return Model(keys[best], toxic[best], clean[best], totals, {})


def prepared(model: Model, seed: int) -> Model:
    """The same with parameters as they are before training."""
    model.params = gru.init(3 + 2 * VECTOR, HIDDEN, seed) | {"E": np.zeros((len(model.keys), VECTOR), np.float32)}
    return model


def learn_windows(model: Model, examples: list[Example], prior: float, seed: int = SEED) -> Model:
    """Trains on windows; `prior`: the share of label 1 that scores should assume."""
    prepared(model, seed)
    rng = np.random.Generator(np.random.PCG64(seed))
    p, adam = model.params, gru.Adam(model.params, RATE)
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // max(len(examples), 1)))):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            _learn(model, adam, [examples[i] for i in order[at : at + BATCH]])
    share = float(np.mean([e.label for e in examples]))
    p["o"] += np.float32(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


def read_text(text: str) -> Words:
    return read_words(next(blocks(pa.array([text]))))


def train(texts: list[str], labels: list[int], prior: float) -> Model:
    """A model from labelled texts at hand."""
    if len(set(labels)) < 2:
        return NO_MODEL
    parts = [read_text(t) for t in texts]
    model = pick_lexicon(*count_keys(parts, labels), (sum(labels), len(labels) - sum(labels)))
    if not len(model.keys):
        return NO_MODEL
    prepared(model, SEED)
    return learn_windows(model, [x for t, w, y in zip(texts, parts, labels, strict=True) for x in chosen_windows(model, w, y, zlib.crc32(t.encode()))], prior)


@dataclass
class Example:
    """One window: its label, the place of each step among its distinct words, their inputs and n-grams."""

    label: int
    place: np.ndarray
    inputs: np.ndarray
    trace: tuple


def chosen_windows(model: Model, words: Words, label: int, seed: int) -> list[Example]:
    """The text's window of the greatest odds; of a clean text another at random too."""
    first, length, _ = window_starts(words.rows, 1)
    if not len(first):
        return []
    x, _ = model.inputs(words, label)
    ids, mask = gathered(words.ids, first, length)
    odds = np.where(mask, np.maximum(x[:, 0], x[:, 1])[ids], -9)
    best = int(np.argmax(odds.max(axis=0) + 0.01 * np.where(mask, odds, 0).clip(0).sum(axis=0)))
    chosen = {best} if label else {best, int(np.random.Generator(np.random.PCG64(seed)).integers(len(first)))}
    out = []
    for k in sorted(chosen):
        used, place = np.unique(words.ids[first[k] : first[k] + length[k]], return_inverse=True)
        keep = np.isin(words.gram_owner, used)
        part = Words(np.zeros(0), place, words.word_keys[used], words.gram_keys[keep], np.searchsorted(used, words.gram_owner[keep]))
        inputs, trace = model.inputs(part, label)
        out.append(Example(label, place, inputs, trace))
    return out


def _learn(model: Model, adam: gru.Adam, batch: list[Example]) -> None:
    """One step of gradient descent on the cross entropy of a batch of windows."""
    p, n, width = model.params, len(batch), 3 + 2 * VECTOR
    steps = max(len(e.place) for e in batch)
    x, mask = np.zeros((steps, n, width), np.float32), np.zeros((steps, n), bool)
    for i, e in enumerate(batch):
        w, w_at, owner, g_at = e.trace
        rows = e.inputs.copy()
        rows[w, 3 : 3 + VECTOR] = p["E"][w_at]
        if len(owner):
            total, count = np.zeros((len(rows), VECTOR), np.float32), np.bincount(owner, minlength=len(rows))
            np.add.at(total, owner, p["E"][g_at])
            rows[:, 3 + VECTOR :] = total / np.maximum(count, 1)[:, None]
        x[: len(e.place), i], mask[: len(e.place), i] = rows[e.place], True
    y = np.array([e.label for e in batch], np.float32)
    keep: dict = {}
    logit = gru.forward(p, x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], mask, keep)
    g, df, db = gru.backward(p, ((gru.sigmoid(logit) - y) / n).astype(np.float32), keep)
    flat = x.reshape(-1, width)
    for d, dp in (("f", df), ("b", db)):
        dp = np.ascontiguousarray(dp).reshape(flat.shape[0], -1)
        g["W" + d], g["c" + d] = flat.T @ dp, dp.sum(axis=0)
    dx = df @ p["Wf"].T + db @ p["Wb"].T
    g["E"] = np.zeros_like(p["E"])
    for i, e in enumerate(batch):
        w, w_at, owner, g_at = e.trace
        own = np.zeros((len(e.inputs), width), np.float32)
        np.add.at(own, e.place, dx[: len(e.place), i])
        np.add.at(g["E"], w_at, own[w, 3 : 3 + VECTOR])
        if len(owner):
            np.add.at(g["E"], g_at, own[owner, 3 + VECTOR :] / np.bincount(owner, minlength=len(own))[owner][:, None])
    g["E"][model.toxic + model.clean < VECTOR_SUPPORT] = 0
    adam.step(g)


def held_out(key: str = "doc_id"):
    """True for rows that no label is learnt from; a null key isn't one of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, max_toxic: int, max_clean: int, max_bytes: int) -> tuple[DataFrame | None, float]:
    """(rows (y, t) of the labelled sample, the share of label 1 among all training labels)."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out("k")).groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.where("y IN (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return None, 0.5
    chosen = [rows.where(f"y = {y}").orderBy(F.xxhash64("k"), "k").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    texts = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).where(F.octet_length("t") <= max_bytes)
    picked = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("d") == F.col("k"))
    return picked.groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("k", "y", "t"), counts[1] / (counts[0] + counts[1])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Model:
    """Trains on a bounded sample of (max_toxic + max_clean) texts of max_bytes at most.

    Tasks count the lexicon's keys and pick the windows; one task, whose input the bound holds too,
    trains on those windows. The driver sees counts, the lexicon and the model.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, prior = sampled(docs, labels, key=key, text=text, label=label, max_toxic=max_toxic, max_clean=max_clean, max_bytes=max_bytes)
    if rows is None:
        return NO_MODEL
    rows = cut(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column("t").to_pylist(), batch.column("y").to_pylist()
            if texts:
                keys, toxic, clean = count_keys(map(read_text, texts), own)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(clean)], ["key", "toxic", "clean"])

    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    totals = (n.get(1, 0), n.get(0, 0))
    if not all(totals):
        return NO_MODEL
    summed = rows.select("y", "t").mapInArrow(count, "key bigint, toxic bigint, clean bigint").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    expected = (F.col("toxic") + F.col("clean")) * F.lit(totals[0] / sum(totals))
    evidence = F.pow(F.col("toxic") - expected, 2) / expected
    got = summed.where("toxic + clean >= 2").orderBy(F.desc(evidence), F.expr("key < 0"), "key").limit(LEXICON).toArrow()
    model = pick_lexicon(*sorted_counts(*(got.column(c).to_numpy() for c in ("key", "toxic", "clean"))), totals)
    if not len(model.keys):
        return NO_MODEL
    shared = spark.sparkContext.broadcast(prepared(model, SEED))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                seed = zlib.crc32(t.encode())
                out += [(seed, i, pickle.dumps(x)) for i, x in enumerate(chosen_windows(shared.value, read_text(t), y, seed))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["a", "b", "window"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [pickle.loads(x) for batch in batches for x in batch.column("window").to_pylist()]
        if examples:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn_windows(shared.value, examples, prior).params)], pa.binary())], ["params"])

    found = rows.select("y", "t").mapInArrow(windows, "a bigint, b bigint, window binary")
    learnt = found.repartition(1).sortWithinPartitions("a", "b", "window").mapInArrow(learn, "params binary").collect()
    if not learnt:
        return NO_MODEL
    model.params = pickle.loads(bytes(learnt[0]["params"]))
    return model


def sorted_counts(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as collected, by unsigned key."""
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], toxic[order], clean[order]


def _scored(docs: DataFrame, model: Model, text: str, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: StructType) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for block in blocks(batch.column(text)):
                out[block.first_row : block.first_row + len(block)] = score_block(shared.value, block)
            yield finish(batch, out)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns and, last, the greatest score of a text's windows: `_score`, or a free name like it; a narrow map."""
    name = free_name(docs, "_score")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return _scored(docs, model, text, lambda batch, out: pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name]), schema)


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with the columns they have."""
    return _scored(docs, model, text, lambda batch, out: batch.filter(pa.array(out < threshold)), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
