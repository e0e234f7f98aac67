"""Nulls, repeated rows, null and equal keys, clashing columns, empty tables and very long texts, for every operator and stage."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("locusflow.llm.queries")
public_tokenizers = pytest.importorskip("public_tokenizers")

import zstandard  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from locusflow.llm import decontamination, lm, packing, quality, secrets, simhash, suffix_dedup, token_counts, toxicity  # noqa: E402
from locusflow.llm.textblocks import blocks  # noqa: E402

#: Names that the operators use for themselves, or might.
CLASHING = ["_score", "_key", "_k", "_hits", "_hash", "_length", "_left", "k", "t", "h", "w", "n", "uid", "bucket", "row", "own_k", "own_key", "gone_key", "text_hash", "sid", "fp", "component", "part", "block", "mark", "spans", "hits", "left", "score", "y", "d"]
draw = random.Random(21)
VOCABULARY = ["".join(draw.choice("aeioubcdfgklmnprst") for _ in range(draw.randrange(3, 9))) for _ in range(900)]


def prose(n):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(14)
BASE = prose(300)
VERY_LONG = prose(120_000) + " " + PASSAGE + " password=hunter2secret end"
ROWS = [(None, prose(80)), (None, None), (None, BASE), (1, BASE), (1, BASE), (1, prose(90) + " " + PASSAGE), (2, ""), (3, VERY_LONG), (4, "x" * 300_000), (5, None), (6, prose(70)), (6, prose(70)), (7, "\n\n \t"), (8, PASSAGE)]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).repartition(3, "doc_id")


def clashing(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


OPERATORS = {
    "lm": lambda df: lm.score_texts(df).withColumn("base_score", F.round("base_score", 6)).withColumn("score", F.round("score", 6)),
    "suffix_dedup": suffix_dedup.remove_repeats,
    "token_counts": lambda df: token_counts.count_tokens(df, public_tokenizers.path(token_counts.VOCABULARY)),
    "simhash": simhash.near_duplicates,
    "similar_texts": simhash.similar_texts,
    "packing": lambda df: packing.pack(df, public_tokenizers.path(packing.VOCABULARY)).drop("sequence_id", "offset"),
    "quality": quality.judge_quality,
    "secrets": secrets.scan_secrets,
    "decontamination": lambda df: decontamination.find_hits(df, df.sparkSession.createDataFrame([(1, PASSAGE)], "item_id long, text string")).withColumn("hits", F.array_sort("hits")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, plain, name):
    run = OPERATORS[name]
    want = run(plain)
    got = run(clashing(plain))
    assert want.columns == got.columns and rows_of(want) == rows_of(got)
    if name not in ("packing", "decontamination"):
        assert want.count() == len(ROWS)
    assert run(plain.limit(0)).count() == 0


def test_rows_of_one_key_and_of_none(spark, plain):
    """Equal rows have equal results, apart from removal, where the later goes whole; null keys have results of their own."""
    got = collections.defaultdict(list)
    for r in suffix_dedup.remove_repeats(plain).collect():
        got[r.doc_id].append(r)
    size = len(BASE.encode())
    assert sum(r.n_removed == 0 for r in got[None]) == 3 and sorted(r.n_removed for r in got[1] if r.n_bytes == size) == [size, size]
    near = collections.defaultdict(set)
    for r in simhash.near_duplicates(plain).collect():
        near[r.doc_id].add(r.component)
    assert near[None] == {1, 2, next(iter(near[None] - {1, 2}))} and 1 in near[1] and near[2] == near[5] == near[7] == {2}
    kept = sorted(map(tuple, simhash.keep_first(plain).collect()), key=repr)
    assert (None, BASE) not in kept and kept.count((1, BASE)) == 2 and (None, ROWS[0][1]) in kept and (None, None) not in kept


def test_very_long_texts_are_read_whole(spark, plain):
    from tokenizers import Tokenizer

    long = plain.where("doc_id IN (3, 4)")
    for module in (token_counts, packing):
        t = Tokenizer.from_file(public_tokenizers.path(module.VOCABULARY))
        want = {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in ((3, VERY_LONG), (4, "x" * 300_000))}
        if module is token_counts:
            assert {r.doc_id: r.n_tokens for r in OPERATORS["token_counts"](long).collect()} == want
        else:
            total = collections.Counter()
            for r in packing.pack(long, public_tokenizers.path(packing.VOCABULARY)).collect():
                total[r.doc_id] += r.length
            assert total == {k: n + 1 for k, n in want.items()}
    words = VERY_LONG.split()
    assert {r.doc_id: r.n_words for r in quality.judge_quality(long).collect()} == {3: len(words), 4: 1}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(long).collect()}
    assert spans[4] == [] and spans[3] == [("assign", VERY_LONG.index("password="), len(VERY_LONG) - 4)]
    hits = {r.k: r.hits for r in decontamination.find_hits(long, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).collect()}
    assert sorted(hits[3]) == list(range(120_000, 120_014)) and hits[4] == []
    texts = [prose(60) + (" zorgle quivex" if i % 2 else "") for i in range(120)]
    model = toxicity.train(texts, [i % 2 for i in range(120)], 0.5)
    clean = (texts[0] + " ") * 2000
    ends = [clean, clean + " zorgle quivex " + texts[2]]
    low, high = (float(toxicity.score_block(model, next(blocks(pa.array([x]))))[0]) for x in ends)
    assert low < 0.5 < high


def test_toxicity_of_awkward_tables(spark, plain):
    labels = spark.createDataFrame([(k, y) for k in range(9) for y in (0, k % 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(plain, labels)
    scored = toxicity.score(clashing(plain), model)
    assert scored.columns[-1] == "_score_" and scored.count() == len(ROWS)
    clean = toxicity.keep_clean(clashing(plain), model)
    assert clean.columns == clashing(plain).columns
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.keep_clean(plain, toxicity.fit(plain, none)).count() == len(ROWS)
    assert toxicity.keep_clean(plain, toxicity.fit(plain.limit(0), labels)).count() == len(ROWS)
    assert toxicity.keep_clean(plain.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def tables(spark, plain, tmp_path_factory):
    """Two sets of tables: the awkward rows with clashing columns, and empty ones."""
    out = []
    for name, docs in (("full", clashing(plain)), ("none", plain.limit(0))):
        root = str(tmp_path_factory.mktemp(name))
        docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
        docs.write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([(k, 1, k % 2) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
        spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
        out.append(root)
    return out


def test_stages_take_awkward_tables(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    for root in tables:
        docs = spark.read.parquet(f"{root}/documents.parquet")
        n = docs.count()
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, root)
            assert out.columns == docs.columns and out.count() <= n
            if name in ("decontamination", "secrets"):
                assert out.count() == n - (name == "decontamination" and n > 0)  # the row that is the passage alone
        rows = pipeline.run(spark, root)
        assert (rows.count() > 0) == (n > 0)


def plain_spans(text):
    """Every rule of a secret scan from scratch, over the whole text."""
    kinds = [("assign", secrets.ASSIGN, 6, 2), ("access", secrets.ACCESS, 20, 0), ("hex", secrets.HEX, 24, 0)]
    base = [(k, m.start(), m.end()) for k, rx, least, group in kinds for m in rx.finditer(text) if len(m[group]) >= least]
    more = []
    for run in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        s = run[0]
        if secrets.allowed(s):
            continue
        for i in range(len(s) - 19):
            window = s[i : i + 20]
            counts = collections.Counter(window)
            entropy = -sum(c / 20 * math.log2(c / 20) for c in counts.values())
            lower, upper, digit = (sum(map(f, window)) for f in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9"))
            if re.fullmatch("[0-9a-fA-F]+", window):
                kind, fits = "entropy_hex", digit > 1 and lower + upper > 1
            else:
                kind, fits = "entropy_mixed", (digit > 1) + (lower > 1) + (upper > 1) >= 2 and (digit > 1 or (lower > 3 and upper > 3))
            if fits and entropy >= secrets.LIMITS[kind] - 1e-9:
                start = run.start() + i
                if more and more[-1][2] >= start and more[-1][1] >= run.start():
                    more[-1] = (more[-1][0], more[-1][1], start + 20)
                else:
                    more.append((kind, start, start + 20))
    rest = [x for x in more if not any(b[1] <= x[1] and x[2] <= b[2] for b in base)]
    order = ["assign", "access", "hex", "entropy_hex", "entropy_mixed"]
    return sorted(base + rest, key=lambda x: (x[1], order.index(x[0]), x[2]))


def secret_texts():
    d = random.Random(31)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda alphabet, n: "".join(d.choice(alphabet) for _ in range(n))
    makers = [
        lambda: d.choice(["password", "Secret", "API_KEY", "apikey", "token", "passwd"]) + d.choice(['"', "'", ""]) + " " * d.randrange(3) + d.choice(":=") + " " * d.randrange(3) + d.choice(['"', ""]) + pick(chars + "+/_.=-", d.randrange(3, 30)),
        lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", d.randrange(10, 24)),
        lambda: pick("0123456789abcdef", d.randrange(18, 60)),
        lambda: pick("0123456789ABCDEF", d.randrange(18, 60)),
        lambda: pick(chars, d.randrange(15, 70)),
        lambda: pick(chars + "+/_=-", d.randrange(15, 120)),
        lambda: "-".join(d.choice(VOCABULARY) for _ in range(d.randrange(2, 7))),
        lambda: "".join(w.capitalize() for w in d.choices(VOCABULARY, k=6)),
        lambda: pick("a", 40), lambda: d.choice(VOCABULARY), lambda: d.choice(["é", "日本", "\n", "=", "  "]),
    ]
    return [d.choice(["", " ", "é "]) + d.choice(["", " ", ", "]).join(d.choice(makers)() + d.choice(["", " "]) for _ in range(d.randrange(1, 14))) for _ in range(1500)]


def test_secret_scan_equals_a_plain_one(spark, tmp_path):
    texts = [*secret_texts(), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op9_secret_scans(spark, str(tmp_path)).collect()}
    entropy = 0
    for i, text in enumerate(texts):
        spans = plain_spans(text or "")
        base = [s for s in spans if not s[0].startswith("entropy")]
        n = collections.Counter(k for k, _, _ in base)
        r = got[i]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans), text
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        entropy += len(spans) - len(base)
    assert entropy > 300


def plain_kept(text, bands):
    data = text.encode()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(twice) > 50 * len(words):
        return False

    def outside(piece):
        at = max(i for i, n in enumerate(bands.lengths) if len(piece) >= n)
        ratio = len(piece) / len(zstandard.ZstdCompressor(level=bands.level, write_checksum=False).compress(piece))
        return ratio < bands.low[at] or ratio > bands.high[at]

    c = bands.chunk
    chunks = [data[i : i + c] for i in range(0, len(data), c) if len(data[i : i + c]) == c]
    if chunks and len(data) % c:
        chunks.append(data[-c:])
    return not outside(data) and sum(map(outside, chunks)) <= bands.chunk_share * len(chunks)


def test_quality_verdicts_equal_plain_ones(spark):
    d = random.Random(41)
    texts = []
    for n in (40, 55, 120, 400, 700, 1500, 4000, 9000):
        for _ in range(4):
            words = [d.choice(VOCABULARY) for _ in range(n)]
            texts.append(" ".join(words))
            texts.append(" ".join(words[: n // 2] + words[: n // 4] * 3))
            texts.append(" ".join("".join(chr(d.randrange(33, 127)) for _ in range(7)) for _ in range(n)))
            texts.append(" ".join(words[: n // 3]) + " again and again" * (n // 2))
    got = {r.doc_id: r.kept for r in quality.judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: plain_kept(t, quality.Bands()) for i, t in enumerate(texts)}
    assert got == want and 0.2 < np.mean(list(want.values())) < 0.9


def plain_bins(lengths, capacity, open_bins):
    """Sequences of bounded-space best fit: a list of free spaces; of those that don't fit when it is full the least goes."""
    free, closed = [], 0
    for n in lengths:
        if n >= capacity:
            closed += 1
            continue
        fitting = [f for f in free if f >= n]
        if fitting:
            free.remove(min(fitting))
            left = min(fitting) - n
        else:
            if len(free) == open_bins:
                free.remove(min(free))
                closed += 1
            left = capacity - n
        if left:
            free.append(left)
        else:
            closed += 1
    return closed + len(free)


@pytest.mark.parametrize("open_bins", [1, 5, 64, 256])
def test_bins_equal_plain_best_fit(open_bins):
    d = random.Random(open_bins)
    lengths = [d.choice([d.randrange(1, 2049), d.randrange(1, 300), 2048, 1024]) for _ in range(3000)]
    bins = packing.Bins(2048, open_bins)
    placed = [bins.place(n) for n in lengths]
    used = collections.Counter()
    for (b, offset), n in zip(placed, lengths, strict=True):
        assert offset == used[b]
        used[b] += n
    assert max(used.values()) <= 2048 and len(used) == plain_bins(lengths, 2048, open_bins)


def test_packing_wastes_little_however_rows_are_dealt(spark, tmp_path):
    d = random.Random(51)
    df = spark.createDataFrame([(i, " ".join(d.choices(VOCABULARY, k=d.randrange(10, 900)))) for i in range(600)], "doc_id long, text string")
    counts = []
    for parts in (1, 40):
        df.repartition(parts).write.parquet(f"{tmp_path}/{parts}")
        rows = packing.pack(spark.read.parquet(f"{tmp_path}/{parts}"), public_tokenizers.path(packing.VOCABULARY)).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s")).first()
        counts.append(rows.s / math.ceil(rows.n / 2048))
    assert max(counts) < 1.03


def test_folds_are_those_of_the_contract():
    keys = list(range(50))
    assert lm.in_training(keys).tolist() == [zlib.crc32(str(k).encode()) % 7 != 2 for k in keys]


def test_long_words_are_cut_where_the_tokenizer_cuts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.VOCABULARY)
    t, d = Tokenizer.from_file(path), random.Random(61)
    alphabet = "ab1Z9é日本語。、！「」かŃ' ́ｱ.-ß".replace(" ", "")
    texts = ["".join(d.choice(alphabet) for _ in range(6000)) for _ in range(20)] + ["日本語の文。" * 2000, "x1" * 5000, "<|endoftext|>a1" * 900, "a" * 9000]
    assert token_counts.lengths(texts, path) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert max(map(len, token_counts.safe_pieces(texts[0]))) < 400


def plain_score(model, text):
    """The network step by step, one window after the other, from words found by a pattern."""
    p = model.params
    sig = lambda x: 1 / (1 + np.exp(-x))
    words = re.findall("[0-9A-Za-z\\u0080-\\U0010ffff]+", text)
    rows = []
    for w in words:  # inputs of a word alone are those of the word in its text
        x, _ = model.inputs(toxicity.read_text(w))
        rows.append(x[0])
    best = 0.0
    for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        window = rows[at : at + toxicity.WINDOW]
        if not window:
            continue
        states = {}
        for d, order in (("f", window), ("b", window[::-1])):
            h, out = np.zeros(toxicity.HIDDEN), []
            for x in order:
                a, b = x @ p["W" + d] + p["c" + d], h @ p["U" + d]
                n = toxicity.HIDDEN
                z, r = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
                h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :])
                out.append(h)
            states[d] = out
        h = np.array([np.concatenate([f, b]) for f, b in zip(states["f"], states["b"][::-1], strict=True)])
        e = np.exp(np.tanh(h @ p["A"]) @ p["v"])
        best = max(best, float(sig((e / e.sum()) @ h @ p["u"] + p["o"][0])))
    return best


def test_toxicity_scores_equal_a_plain_network():
    d = random.Random(71)
    texts = [" ".join(d.choices(VOCABULARY, k=d.randrange(20, 90))) + (" zorgle quivexly" if i % 3 == 0 else "") for i in range(150)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(150)], 1 / 3)
    some = ["", "one", " ".join(VOCABULARY[:48]), " ".join(VOCABULARY[:49]), " ".join(VOCABULARY[:81]), texts[0] * 3, "Zorgle, ZORGLES! é日本 x-y_z 12"]
    got = np.concatenate([toxicity.score_block(model, b) for b in blocks(pa.array(some))])
    assert np.allclose(got, [plain_score(model, t) for t in some], atol=1e-4) and got[5] > 0.5
