"""Quality classifier: naive Bayes support vectors over n-gram indicators.

N-grams of a text, each counted once however often it occurs: its tokens and pairs of neighbouring tokens
(runs of letters and digits in lower case, or of one symbol), the byte n-grams of `GRAM` inside tokens, and
runs of one to three token shapes. A shape says how a token is written (case, digits, length, or the
symbol and how often) and whether it repeats one of the two words before it, so that it generalises
over words never seen. Every indicator is scaled by the log-ratio of its class counts (naive Bayes with
`ALPHA` added), rows are brought to unit length, and a linear hinge-loss model over them is fitted by dual
coordinate descent; its weights are interpolated with their mean magnitude, as is usual for this model. Margins of
rows left out in turn give the logistic curve that turns a margin into a score.

Labels come from a bounded sample: the first `max_each` training rows of either label in the order of a
hash of their keys, and of those texts of at most `max_bytes`. Tasks count n-grams and read features; the
`LEXICON` n-grams with the most evidence and the fitted weights are all that the driver sees; one task, whose
input the bound holds, fits them. Scoring is a narrow map over all rows and whole texts. Nothing but the
text enters a score.

Cases: a null, empty or blank text has no n-gram and scores what the curve gives for a margin of the bias alone;
without labels of both kinds every score is the share of label 1 (0.5 without labels); null keys take no
part in training, are scored, and count as not held out; labels of several rows for one key count once, as
the least; of several texts with one key the least is learnt from; repeated rows score alike; an empty
table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .session import bounded_batches, cut, documents, free_name
from .textblocks import IS_SPACE, LOWER, Block, blocks, mix, span_hashes

THRESHOLD = 0.5
#: The bound of the labelled sample: rows of either label, bytes of a text.
MAX_EACH, MAX_BYTES = 2_500, 20_000
LEXICON = 1 << 16
ALPHA, COST, BETA = 1.0, 1.0, 0.25
#: A constant input beside the n-grams carries the bias.
BIAS = 0.1
EPOCHS, TOLERANCE, FOLDS, SEED = 60, 1e-2, 3, 17
GRAM = 4
#: Words of so many bytes and more share a shape of length.
LENGTHS = (2, 4, 8, 14)
COUNT_ENTRIES = 4_000_000

_WORD = np.zeros(256, dtype=bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_WORD[128:] = True
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
#: What runs of bytes make a token: 0 separates, 1 is a word's, any symbol makes runs of its own.
_KIND = np.where(IS_SPACE, 0, np.where(_WORD, 1, np.arange(256) + 2)).astype(np.int32)
#: One seed a family of n-grams, so that none shares keys with another.
_TOKEN, _PAIR, _GRAMS, _SHAPE = (np.uint64(x) for x in (0x5151, 0xA2A2A2, 0x77331, 0xC4C4C4C4))


def _sorted_distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order; sorting whole arrays is faster here than numpy's hashing."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each) of runs of word bytes or of one symbol."""
    kind = _KIND[block.array]
    n = len(kind)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(n + 1, bool)
    first[block.offsets] = True
    first[0] = first[n] = True
    first[1:n] |= kind[1:] != kind[:-1]
    edges = np.flatnonzero(first)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(block.offsets, starts, side="right") - 1


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A small number for how each token is written and whether it repeats a word just before."""
    word = _WORD[data[starts]]
    length = ends - starts
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    uppers = upper[ends] - upper[starts]
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    digits = digit[ends] - digit[starts]
    case = np.where(uppers == 0, 0, np.where(uppers * 2 > length, 2, np.where(_UPPER[data[starts]], 1, 3)))
    written = case * 2 + (digits > 0)
    shape = np.where(word, 1 + written * 8 + np.searchsorted(LENGTHS, length, side="right"), 128 + data[starts].astype(np.int64) * 4 + np.minimum(length, 3))
    again = np.zeros(len(starts), np.int64)
    own = np.flatnonzero(word)
    for back in (2, 1):
        if len(own) > back:
            same = (hashes[own[back:]] == hashes[own[:-back]]) & (rows[own[back:]] == rows[own[:-back]])
            again[own[back:][same]] = back
    return (shape + 1024 * again).astype(np.uint64)


@dataclass
class Grams:
    """N-grams of a block's rows: keys with the row of each, and distinct tokens with their byte n-grams in CSR form."""

    rows: np.ndarray
    keys: np.ndarray
    token_rows: np.ndarray
    tokens: np.ndarray
    gram_keys: np.ndarray
    gram_owner: np.ndarray


def read_grams(block: Block) -> Grams:
    lowered = Block(block.first_row, block.data.translate(LOWER), block.offsets)
    starts, ends, rows = _tokens(block)
    hashes = span_hashes(lowered.array, starts, ends)
    distinct, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    ids = ids.reshape(-1)
    keys, own = [], []

    def runs(values: np.ndarray, seed: np.uint64, sizes: tuple[int, ...]) -> None:
        run = mix(values + seed)
        for n in range(1, sizes[-1] + 1):
            if n > 1:
                run = mix(run[:-1] * np.uint64(3) + mix(values[n - 1 :] + seed * np.uint64(n)))
            if n in sizes:
                inside = rows[: len(run)] == rows[n - 1 :]
                keys.append(run[inside])
                own.append(rows[: len(run)][inside])

    runs(hashes, _PAIR, (2,))
    shapes = _shapes(block.array, starts, ends, rows, hashes)
    runs(shapes, _SHAPE, (1, 2, 3))
    pair = _sorted_distinct(rows * max(len(distinct), 1) + ids)
    token_rows, tokens = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
    keys.append(mix(distinct[tokens] + _TOKEN))
    own.append(token_rows)
    s, length = starts[first], (ends - starts)[first]
    count = np.maximum(length - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(s)), count)
    at = s[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return Grams(np.concatenate(own), np.concatenate(keys), token_rows, tokens, mix(span_hashes(lowered.array, at, at + GRAM) + _GRAMS), owner)


def _expanded(owner: np.ndarray, n_tokens: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the tokens given, place among the grams) of all grams of all tokens given; owner is ascending."""
    count = np.bincount(owner, minlength=n_tokens)
    begin = np.cumsum(count) - count
    many = count[tokens]
    place = np.repeat(np.arange(len(tokens)), many)
    return place, np.repeat(begin[tokens] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


@dataclass
class Model:
    """Sorted keys of the lexicon, their log-count ratios, and the fitted weights over scaled indicators."""

    keys: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)
    leading: np.ndarray | None = field(default=None, repr=False)

    def features(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in the lexicon) of the distinct indicators of a block, in that order."""
        grams = read_grams(block)
        held = self._held(grams.gram_keys)
        gram_at, gram_own = held[1], grams.gram_owner[held[0]]
        place, at = _expanded(gram_own, int(grams.tokens.max()) + 1 if len(grams.tokens) else 1, grams.tokens)
        found = self._held(grams.keys)
        rows = np.concatenate([grams.rows[found[0]], grams.token_rows[place]])
        cells = _sorted_distinct(rows * len(self.keys) + np.concatenate([found[1], gram_at[at]]))
        return cells // len(self.keys), cells % len(self.keys)

    def _held(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys that the lexicon has, where it has them); most others fail by their leading bits."""
        if self.leading is None:
            self.leading = np.zeros(1 << 20, bool)
            self.leading[self.keys >> np.uint64(44)] = True
        maybe = np.flatnonzero(self.leading[keys >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        there = self.keys[at] == keys[maybe]
        return maybe[there], at[there]

    def margins(self, block: Block) -> np.ndarray:
        n = len(block)
        if not len(self.keys):
            return np.full(n, self.bias)
        rows, at = self.features(block)
        size = np.bincount(rows, weights=self.ratios[at].astype(float) ** 2, minlength=n)
        product = np.bincount(rows, weights=(self.ratios * self.weights)[at].astype(float), minlength=n)
        return product / np.sqrt(np.maximum(size, 1e-12)) + self.bias

    def scores(self, block: Block) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margins(block) + b, -30, 30)))


def without_evidence(share: float) -> Model:
    """Scores every text by the share of label 1."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), curve=(0.0, float(np.log(share / (1 - share)))))


@dataclass
class Rows:
    """Sparse rows of unit length over the lexicon."""

    begins: np.ndarray
    at: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, parts: list[np.ndarray], ratios: np.ndarray) -> Rows:
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        values = ratios[at].astype(float)
        row = np.repeat(np.arange(len(parts)), np.diff(begins))
        size = np.sqrt(np.maximum(np.bincount(row, weights=values**2, minlength=len(parts)), 1e-12))
        return cls(begins, at, values / size[row])

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begins[i], self.begins[i + 1])
        return self.at[part], self.values[part]


def dual_descent(rows: Rows, labels: np.ndarray, chosen: np.ndarray, n_features: int, *, costs: np.ndarray, epochs: int = EPOCHS, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, dual variables) of the L1-loss support vector machine over the chosen rows.

    One dual variable at a time takes its exact minimum within 0 and the row's cost, rows in a new random order each
    epoch, until no projected gradient of an epoch is beyond the tolerance.
    """
    w, bias, alpha = np.zeros(n_features), 0.0, np.zeros(len(labels))
    signs = np.where(labels > 0, 1.0, -1.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    cells = {int(i): rows.row(i) for i in chosen}
    diagonal = {i: float(v @ v) + BIAS * BIAS for i, (_, v) in cells.items()}
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(chosen).tolist():
            at, v = cells[i]
            y, a, cost = signs[i], alpha[i], costs[i]
            slope = y * (float(w[at] @ v) + bias * BIAS) - 1
            projected = min(slope, 0.0) if a <= 0 else max(slope, 0.0) if a >= cost else slope
            worst = max(worst, abs(projected))
            if projected:
                alpha[i] = min(max(a - slope / diagonal[i], 0.0), cost)
                step = (alpha[i] - a) * y
                w[at] += step * v
                bias += step * BIAS
        if worst < tolerance:
            break
    return w, bias * BIAS, alpha


def interpolated(w: np.ndarray, beta: float = BETA) -> np.ndarray:
    """The weights drawn towards their mean magnitude: the naive Bayes end of the model."""
    return (1 - beta) * float(np.abs(w).mean()) + beta * w if len(w) else w


def logistic_curve(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton's method on smoothed targets."""
    pos, neg = float((labels > 0).sum()), float((labels <= 0).sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        gradient = x.T @ (weights * (p - target)) + 1e-6 * ab
        hessian = (x * (weights * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        length = float(np.abs(step).max())
        ab -= step * min(1.0, 5 / max(length, 1e-12))
        if length < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def fit_rows(model: Model, parts: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """Fits the weights and the curve on rows of lexicon places; `prior`: the share of label 1 that scores assume."""
    rows, n = Rows.of(parts, model.ratios), len(model.keys)
    share = float(labels.mean())
    costs = COST * np.where(labels > 0, prior / share, (1 - prior) / (1 - share))
    balance = COST * np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))

    def fitted(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        w, bias, _ = dual_descent(rows, labels, chosen, n, costs=balance)
        return interpolated(w), bias

    def margins(w: np.ndarray, bias: float, chosen: np.ndarray) -> np.ndarray:
        return np.array([float(w[at] @ v) + bias for at, v in map(rows.row, chosen.tolist())])

    everyone = np.arange(len(labels))
    fold = np.random.Generator(np.random.PCG64(SEED)).permutation(len(labels)) % FOLDS
    left_out = np.zeros(len(labels))
    for k in range(FOLDS):
        rest, own = everyone[fold != k], everyone[fold == k]
        if len(own) and len(set(labels[rest])) == 2:
            left_out[own] = margins(*fitted(rest), own)
    w, bias = fitted(everyone)
    model.weights, model.bias, model.curve = w.astype(np.float32), bias, logistic_curve(left_out, labels, costs)
    return model


def count_keys(parts: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, texts of label 1, texts of label 0) over texts' distinct keys."""
    sizes = [len(p) for p in parts]
    keys, back = np.unique(np.concatenate(parts), return_inverse=True)
    label = np.repeat(np.array(labels, np.int64), sizes)
    good = np.bincount(back.reshape(-1), weights=label, minlength=len(keys)).astype(np.int64)
    return keys, good, np.bincount(back.reshape(-1), minlength=len(keys)) - good


def text_keys(text: str) -> np.ndarray:
    """The distinct keys of one text."""
    grams = read_grams(next(blocks(pa.array([text]))))
    return _sorted_distinct(np.concatenate([grams.keys, grams.gram_keys]))


def lexicon(keys: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Model:
    """A model of these n-grams with their log-count ratios, unfitted."""
    order = np.argsort(keys)
    p, q = good[order] + ALPHA, bad[order] + ALPHA
    return Model(keys[order], np.log((p / p.sum()) / (q / q.sum())).astype(np.float32))


def evidence(good, bad, totals: tuple[int, int]):
    """How far class counts are from independence; of numpy arrays or columns."""
    expected = (good + bad) * (totals[0] / sum(totals))
    return (good - expected) * (good - expected) / (expected * (1 - totals[0] / sum(totals)))


def train(texts: list[str], labels: list[int], prior: float | None = None, limit: int = LEXICON) -> Model:
    """A model from labelled texts at hand."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return without_evidence(float(y.mean()) if len(y) else 0.5)
    keys, good, bad = count_keys([text_keys(t) for t in texts], labels)
    many = good + bad >= 2
    keys, good, bad = keys[many], good[many], bad[many]
    best = np.lexsort((keys, -evidence(good, bad, (int(y.sum()), int((1 - y).sum())))))[:limit]
    model = lexicon(keys[best], good[best], bad[best])
    if not len(model.keys):
        return without_evidence(float(y.mean()))
    return fit_rows(model, [model.features(next(blocks(pa.array([t]))))[1] for t in texts], y, float(y.mean()) if prior is None else prior)


def held_out(key: str = "doc_id") -> Column:
    """True for rows that no label is learnt from; a null key isn't one of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, max_each: int, max_bytes: int) -> tuple[DataFrame | None, float]:
    """(rows (y, t) of the labelled sample, the share of label 1 among all training labels)."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out("k")).groupBy("k").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return None, good / (good + bad) if good + bad else 0.5
    chosen = [rows.where(f"y = {y}").orderBy(F.xxhash64("k"), "k").limit(max_each) for y in (0, 1)]
    texts = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).where(F.octet_length("t") <= max_bytes)
    picked = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("d") == F.col("k"))  # 2 * max_each keys
    return picked.groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("k", "y", "t"), good / (good + bad)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, good, bad) of the texts of a task, added up over some millions of entries at a time."""
    parts: list[np.ndarray] = []
    labels: list[int] = []

    def summed() -> pa.RecordBatch:
        keys, good, bad = count_keys(parts, labels)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(good), pa.array(bad)], ["key", "good", "bad"])

    for batch in batches:
        for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
            parts.append(text_keys(t))
            labels.append(y)
            if sum(map(len, parts)) >= COUNT_ENTRIES:
                yield summed()
                parts, labels = [], []
    if parts:
        yield summed()


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_each: int = MAX_EACH, max_bytes: int = MAX_BYTES, limit: int = LEXICON) -> Model:
    """A model from the labelled sample: 2 * max_each texts of max_bytes at most, `limit` n-grams."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, prior = sampled(docs, labels, key=key, text=text, label=label, max_each=max_each, max_bytes=max_bytes)
    if rows is None:
        return without_evidence(prior)
    rows = cut(rows)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(n) < 2:
        return without_evidence(prior)
    counted = rows.select("y", "t").mapInArrow(_count, "key bigint, good bigint, bad bigint").groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where("good + bad >= 2")
    ranked = counted.orderBy(F.desc(evidence(F.col("good"), F.col("bad"), (n[1], n[0]))), F.expr("key < 0"), "key").limit(limit)
    got = ranked.toArrow()  # `limit` rows of three numbers
    if not got.num_rows:
        return without_evidence(prior)
    model = lexicon(got.column("key").to_numpy().view(np.uint64), got.column("good").to_numpy(), got.column("bad").to_numpy())
    shared = spark.sparkContext.broadcast(model)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shared.value.features(next(blocks(pa.array([t]))))[1].astype("<u4").tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(own, pa.binary())], ["k", "y", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        y: list[int] = []
        for batch in batches:
            parts += [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("places").to_pylist()]
            y += batch.column("y").to_pylist()
        if parts:
            fitted = fit_rows(shared.value, parts, np.array(y), prior)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((fitted.weights, fitted.bias, fitted.curve))], pa.binary())], ["fitted"])

    kind = rows.schema["k"].dataType.simpleString()
    found = rows.mapInArrow(places, f"k {kind}, y int, places binary")
    learnt = found.repartition(1).sortWithinPartitions("k").mapInArrow(learn, "fitted binary").collect()  # one row
    model.weights, model.bias, model.curve = pickle.loads(bytes(learnt[0]["fitted"]))
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns and, last, the score: `_score`, or a free name like it; a narrow map."""
    bounded_batches(docs.sparkSession)
    name, shared = free_name(docs, "_score"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for block in blocks(batch.column(text)):
                out[block.first_row : block.first_row + len(block)] = shared.value.scores(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
