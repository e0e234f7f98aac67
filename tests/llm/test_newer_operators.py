"""Phrase collocations, tokenizer alignment and the quality classifier against brute force and held-out rows."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("locusflow.llm.queries")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from locusflow.llm import collocations, quality_classifier, tokenizer_alignment  # noqa: E402
from locusflow.llm.textblocks import blocks  # noqa: E402

draw = random.Random(31)
FEW = ["a", "B", "c", "çé", "dd", "E'e", "日本", "en", "es", "x-y"]
CLASHING = ["chunk", "place", "places", "words", "langs", "counts", "t", "l", "k", "rank", "bucket", "w1", "f", "word", "phrase", "a", "n", "y", "_score", "places_", "codes", "links", "answer", "n_a"]


def few(n):
    return "".join(draw.choice(FEW) + draw.choice([" ", " ", "  ", "\t", ", ", ".\n", "; "]) for _ in range(n))


PHRASED = [(None, None, "en"), (1, "", "en"), (2, " .,;\n\t ", None), (2, few(40), None), (3, few(3000), "en"), (3, few(500), "es"), (4, few(700), "en"), (4, "one two " * 30 + ". " + "p p p p " * 12, "fr"), (5, "one two three. " * 25, "fr")] + [(i, few(60), draw.choice(["en", "es"])) for i in range(30)]


def phrases_of(rows, min_count, top):
    """The contract, read plainly."""
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in (1, 2, 3):
                counts.update((lang, *ws[i : i + m]) for i in range(len(ws) - m + 1))
    found = collections.defaultdict(list)
    candidates = {k: a for k, a in counts.items() if len(k) > 2 and a >= min_count}
    covered = collections.Counter()
    for k, a in candidates.items():
        if len(k) == 4:
            for part in (k[:3], (k[0], *k[2:])):
                covered[part] = max(covered[part], a)
    for k, a in candidates.items():
        if len(k) == 3 and 100 * covered[k] >= 50 * a:
            continue
        lang, ws = k[0], k[1:]
        cuts = [(1_000_000 * a * a // (counts[lang, *ws[:i]] * counts[lang, *ws[i:]]), i) for i in range(1, len(ws))]
        score, i = min(cuts)
        found[lang].append((-score, -a, " ".join(ws).encode(), counts[lang, *ws[:i]], counts[lang, *ws[i:]], total[lang]))
    return {(lang, rank, p.decode(), -a, left, right, n, -s) for lang, rows in found.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(rows)[:top], 1)}


def as_tuples(df):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize(("hot", "bucket_words", "top"), [(1 << 19, 1 << 20, 2_000), (20, 1_000, 2_000), (0, 500, 25)])
def test_phrases_equal_brute_force(spark, hot, bucket_words, top):
    docs = spark.createDataFrame(PHRASED, "doc_id long, text string, lang string").repartition(3)
    mined = collocations.mine_phrases(docs, min_count=4, hot_pivot=hot, bucket_words=bucket_words)
    want = phrases_of(PHRASED, 4, top)
    assert as_tuples(collocations.top_phrases(mined, top)) == want and len(want) > 40
    assert as_tuples(collocations.top_phrases(mined, top, ranked_rows=20)) == want  # ranked in a tree


def test_phrases_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(PHRASED, schema)
    odd = docs.select(*(F.lit("clash").alias(c) for c in CLASHING), "text", "lang")
    assert as_tuples(collocations.top_phrases(collocations.mine_phrases(odd))) == phrases_of(PHRASED, 10, 2_000)
    for none in (docs.limit(0), spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "few words only", "en")], schema)):
        assert collocations.top_phrases(collocations.mine_phrases(none)).collect() == []


def test_phrase_scores_beyond_64_bits(spark):
    rows = [(10**12 + 7, 10**12 + 9, 3 * 10**12 + 1), (10, 10, 10), (7 * 10**12, 9 * 10**12, 8 * 10**12)]
    got = spark.createDataFrame(rows, "a long, x long, y long").select("a", "x", "y", collocations.association(F.col("a"), F.col("x"), F.col("y")).alias("s")).collect()
    assert {(r.a, r.x, r.y): r.s for r in got} == {(a, x, y): 1_000_000 * a * a // (x * y) for a, x, y in rows}


def test_fragments_hold_each_phrase_of_a_pivot_once():
    draws = np.random.Generator(np.random.PCG64(4))
    for hot in (0, 3, 9):
        ranks = np.where(draws.random(400) < 0.1, collocations.BLANK, draws.integers(0, 9, 400))
        rows, counts = collocations.merged(collocations.fragments(ranks, hot))
        assert (rows[1:3][rows[1:3] < collocations.NONE].max(initial=-1) < 9) and counts.sum() == collocations.fragments(ranks, hot).shape[1]
        grams, many = collocations.mined(rows, counts, 1)
        got = {tuple(int(x) for x in g if x != collocations.NONE): int(n) for g, n in zip(grams.T, many, strict=True)}
        want = collections.Counter(tuple(ranks[i : i + m].tolist()) for m in (2, 3) for i in range(len(ranks) - m + 1) if (ranks[i : i + m] < collocations.BLANK).all())
        assert got == dict(want)
        if hot:  # all fragments of one phrase meet in one bucket
            at = collocations.bucket_of(rows, hot, 7)
            where = collections.defaultdict(set)
            for b in range(7):
                for g in collocations.mined(rows[:, at == b], counts[at == b], 1)[0].T.tolist():
                    where[tuple(g)].add(b)
            assert all(len(bs) == 1 for bs in where.values())


def test_words_named_like_languages_stay_apart():
    own = collocations.Dictionary()
    for block in blocks(pa.array(["en es en", "es en de", "en"])):
        own.add(block, ["es", "en", "en"])
    assert sorted(zip(own.langs, own.words, own.counts.tolist(), strict=True)) == [("en", b"de", 1), ("en", b"en", 2), ("en", b"es", 1), ("es", b"en", 2), ("es", b"es", 1)]


PATHS = public_tokenizers.path(tokenizer_alignment.BYTE_VOCABULARY), public_tokenizers.path(tokenizer_alignment.PIECE_VOCABULARY)
ALIGNED = [
    *(None, "", " ", "  lead", "trail  ", "a\n\nb\tc", "▁sentinel", "x ▁ y", "<s> </s> <unk> <0x41> <|endoftext|>", "a<|endoftext|>b", "日本語のテキスト。", "naïve café ﬁ 🙂🙂", "\0 nul \x7f", "é combining", "x" * 5000, "1234567 89,000.00"),
    *(" ".join(draw.choice(FEW + ["tokenization", "Unverzüglich", "wharf", "  "]) for _ in range(n)) for n in (30, 400, 6000)),
    "tokenization wharf",
    "tokenization wharf",
]


def aligned_plainly(texts):
    """(figures, groups, ids and their bytes) by the libraries' own calls and a walk over both lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(PATHS[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    # the byte-level alphabet: printable Latin letters are themselves, the other bytes take letters from U+0100 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    entry = {i: bytes(byte[c] for c in k) for k, i in a_side.get_vocab(with_added_tokens=False).items() if all(c in byte for c in k)}
    out, links_of, pairs = [], [], collections.Counter()
    for text in texts:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [entry[i] for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            out.append((0, 0, 0, 0, ""))
            links_of.append([])
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = bisect.bisect_right(ends[0], e), bisect.bisect_right(ends[1], e)
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        links = []
        for i, e in enumerate(ends[0]):
            begin = e - len(a_bytes[i])
            j = bisect.bisect_right(ends[1], begin)
            while j < len(b) and ends[1][j] - len(b_bytes[j]) < e:
                links.append((a[i], b[j]))
                j += 1
        pairs.update(links)
        links_of.append(links)
        out.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return [(*x, sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links)) for x, links in zip(out, links_of, strict=True)]


def test_alignment_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ALIGNED)]
    want = aligned_plainly(ALIGNED)
    assert [x[0] for x in want].count(0) == 4  # null, empty, and U+2581 twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs.repartition(3), docs.coalesce(1).select("doc_id", "text", *(F.lit("clash").alias(c) for c in CLASHING))):
        got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in tokenizer_alignment.alignment_figures(df, *PATHS).collect()}
        assert got == dict(enumerate(want))
    assert tokenizer_alignment.alignment_figures(docs.limit(0), *PATHS).count() == 0
    same = spark.createDataFrame([(None, "tokenization wharf"), (7, "tokenization wharf"), (7, "tokenization wharf"), (None, None)], "doc_id long, text string")
    figures = sorted((r.doc_id is None, r.n_a, r.count_sum) for r in tokenizer_alignment.alignment_figures(same, *PATHS).collect())
    assert figures[0] == figures[1] and figures[2] == (True, 0, 0) and figures[3][1:] == figures[0][1:] and len(figures) == 4


def test_alignment_lists_tokens_groups_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "Unverzüglich wharf"), (2, None), (3, "日本 x")], "doc_id long, text string")
    got = {r.doc_id: r for r in tokenizer_alignment.align_tokens(docs, *PATHS).collect()}
    assert got[2].a_ids == [] and got[2].b_ids == []
    for r in (got[1], got[3]):
        assert r.a_groups[0] == r.b_groups[0] == 0 and r.a_groups[-1] == r.b_groups[-1]
        links = [(i, r.first_b[i] + d) for i in range(len(r.a_ids)) for d in range(r.overlaps[i])]
        assert {j for _, j in links} == set(range(len(r.b_ids)))
        assert all(r.a_groups[i] == r.b_groups[j] for i, j in links)


def test_alignment_chunks_give_back_their_places():
    draws = np.random.Generator(np.random.PCG64(9))
    chunk, seen = tokenizer_alignment.Chunk(), []
    for n in (0, 500, 1, 900):
        codes = draws.integers(0, 300, n)
        rows = np.sort(draws.integers(0, 5, n))
        places = chunk.add(codes)
        listed, _ = chunk.listed()
        assert (listed[places] == codes).all()
        for i, packed in enumerate(tokenizer_alignment.pack_places(places, rows, 5)):
            assert tokenizer_alignment.unpack_places(packed).tolist() == sorted(places[rows == i].tolist())
        seen += codes.tolist()
    codes, counts = chunk.listed()
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == dict(collections.Counter(seen))


WORDS = ["".join(draw.choice("aeioubcdfgklmnprst") for _ in range(draw.randrange(3, 9))) for _ in range(600)]


def graded(i):
    ws = [draw.choice(WORDS) for _ in range(draw.randrange(20, 120))]
    if i % 3:
        return " ".join(ws).capitalize() + ".", 1
    kind = i % 9
    return (" ".join(w + "###" for w in ws) if kind == 0 else " ".join(w.upper() + "!!" for w in ws) if kind == 3 else " ".join(f"{w} {w} {w}" for w in ws)), 0


def test_quality_is_learnt_and_held_out(spark):
    rows = [(i, *graded(i)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "plain words"), (700, None), (701, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (5, 2)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    got = {(r.doc_id, r.text): r for r in quality_classifier.score(docs, model).select("*", quality_classifier.held_out().alias("held")).collect()}
    assert len(got) == 603 and not got[None, "plain words"].held
    held = [(got[i, t]._score, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i, t].held == (zlib.crc32(str(i).encode()) % 3 == 1) for i, t, _ in rows)
    assert len(held) > 150 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    assert got[700, None]._score == got[701, ""]._score and 0 <= got[701, ""]._score <= 1
    # held-out labels, other columns and repeated rows change nothing
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    odd = docs.union(docs.where("doc_id = 5")).select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    again = quality_classifier.score(odd, quality_classifier.fit(odd, turned))
    assert again.columns[-1] == "_score_"
    assert all(r._score_ == pytest.approx(got[r.doc_id, r.text]._score, abs=1e-9) for r in again.collect())
    whole = " ".join(w for w in WORDS) + "."
    ends = [quality_classifier.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first()._score for t in (whole * 60, whole + " " + " ".join(w.upper() + "!!" for w in WORDS) * 60)]
    assert ends[0] > 0.5 > ends[1]


def test_quality_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(0, 1), (2, 1)], 1.0), ([(10, 1), (0, 0)], 0.5)):
        model = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [round(r._score, 3) for r in quality_classifier.score(docs, model).collect()] == [want, want]
    assert quality_classifier.score(docs.limit(0), quality_classifier.without_evidence(0.5)).count() == 0


def test_quality_reads_the_same_grams_as_a_plain_reader():
    texts = ["", "One two two!! three", "çé 12ab ÇÉ ...", "a " * 9 + "longerword", "one\ntwo"]
    tokens = [[m.group().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+|([^A-Za-z0-9\x80-\xff\x20\x09-\x0d])\1*", t.encode())] for t in texts]
    grams = quality_classifier.read_grams(next(blocks(pa.array(texts))))
    for i, own in enumerate(tokens):
        assert len(set(grams.tokens[grams.token_rows == i])) == len(set(own))
        n = len(own)
        assert (grams.rows == i).sum() == max(n - 1, 0) + n + max(n - 1, 0) + max(n - 2, 0) + len(set(own))
    distinct = {t for own in tokens for t in own}
    assert len(grams.gram_keys) == sum(max(len(t) - quality_classifier.GRAM + 1, 0) for t in distinct)
    alone = [quality_classifier.text_keys(t).tolist() for t in texts if t]
    model = quality_classifier.Model(np.unique(np.concatenate([quality_classifier.text_keys(t) for t in texts if t])), np.ones(10**4, np.float32))
    model.ratios = model.ratios[: len(model.keys)]
    rows, at = model.features(next(blocks(pa.array([t for t in texts if t]))))
    assert [model.keys[at[rows == i]].tolist() for i in range(len(alone))] == alone


def test_dual_descent_solves_the_dual():
    """Against projected gradient descent on the same dual, run long."""
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.random((60, 12)) * (rng.random((60, 12)) < 0.5)
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.standard_normal(60) > 0.6).astype(int)
    parts = [np.flatnonzero(r) for r in x]
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    rows = quality_classifier.Rows(begins, np.concatenate(parts), np.concatenate([r[p] for r, p in zip(x, parts, strict=True)]))
    costs = np.full(60, 0.7)
    w, bias, alpha = quality_classifier.dual_descent(rows, y, np.arange(60), 12, costs=costs, epochs=2000, tolerance=1e-8)
    s = np.where(y > 0, 1.0, -1.0)
    q = (x @ x.T + quality_classifier.BIAS**2) * s[:, None] * s
    plain = np.zeros(60)
    for _ in range(60_000):
        plain = np.clip(plain - (q @ plain - 1) / np.linalg.norm(q, 2), 0, costs)
    value = lambda a: 0.5 * a @ q @ a - a.sum()
    assert value(alpha) <= value(plain) + 1e-6
    assert np.allclose(w, (alpha * s) @ x) and bias == pytest.approx(float((alpha * s).sum()) * quality_classifier.BIAS**2)


def test_log_count_ratios_and_evidence():
    model = quality_classifier.lexicon(np.array([9, 4], np.uint64), np.array([3, 0]), np.array([1, 5]))
    assert model.keys.tolist() == [4, 9]
    p, q = np.array([1, 4]), np.array([6, 2])
    assert np.allclose(model.ratios, np.log((p / 5) / (q / 8)))
    assert quality_classifier.evidence(np.array([5.0]), np.array([5.0]), (10, 10))[0] == 0
    a, b = quality_classifier.logistic_curve(np.array([-2.0, -1, 1, 2] * 50), np.array([0, 0, 1, 1] * 50), np.ones(200))
    assert a > 1 and abs(b) < 1e-6
