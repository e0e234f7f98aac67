"""The pipeline's stages over a small corpus, each against a plain version of its decision."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from locusflow.llm import packing, secrets, toxicity  # noqa: E402
from locusflow.llm.textblocks import blocks  # noqa: E402

rng = random.Random(12)
WORDS = ["".join(rng.choice("aeioubcdfgklmnprst") for _ in range(rng.randrange(3, 9))) for _ in range(600)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose(25)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    texts, toxic = {}, {}
    for i in range(160):
        words = prose(rng.randrange(60, 160)).split()
        toxic[i] = int(i % 4 == 0)
        for _ in range(4 * toxic[i]):
            words[rng.randrange(len(words))] = "zorgle" + rng.choice(["", "an", "est"])
        texts[i] = " ".join(words)
    base = prose(300)
    texts[200], texts[201] = base, base
    texts[202] = base.replace(base.split()[150], "changedword", 1)
    texts[203] = prose(20) + " " + PASSAGE.upper() + ", " + prose(20)
    texts[204], texts[205] = PASSAGE, prose(30) + " password=hunter2secret " + prose(30)
    texts[206], texts[207] = None, ""
    docs = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), texts, toxic


def shingles(text, n=5):
    ws = re.findall(r"\S+", (text or "").lower())
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def test_stages(spark, corpus):
    root, texts, toxic = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{root}/labels.parquet"))
    scores = {k: float(toxicity.score_block(model, next(blocks(pa.array([t or ""]))))[0]) for k, t in texts.items()}
    clean = stages["toxicity"](spark, docs, root)
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and kept == {k for k, s in scores.items() if s < toxicity.THRESHOLD}
    wrong = [k for k, y in toxic.items() if (k in kept) == bool(y)]
    assert len(wrong) <= 8

    deduped = stages["near_duplicates"](spark, docs, root)
    left = {r.doc_id for r in deduped.collect()}
    want = []
    for k in sorted(texts):
        own = shingles(texts[k])
        if not any((own == o) or (own and o and len(own & o) >= 0.8 * len(own | o)) for o in map(shingles, (texts[j] for j in want))):
            want.append(k)
    assert deduped.columns == docs.columns and left == set(want)

    out = {r.doc_id: r for r in stages["decontamination"](spark, docs, root).collect()}
    assert 204 not in out and out[203].n_chars == len(out[203].text)
    assert not any(w.upper() in out[203].text.split() for w in PASSAGE.split())
    assert {k: r.text for k, r in out.items() if k != 203} == {k: t for k, t in texts.items() if k not in (203, 204)}

    safe = {r.doc_id: r for r in stages["secrets"](spark, docs, root).collect()}
    assert "hunter2" not in safe[205].text and "[REDACTED]" in safe[205].text and safe[205].n_chars == len(safe[205].text)
    assert all(safe[k].text == t for k, t in texts.items() if not dict(secrets.scan(pa.array([t], pa.string()))))

    pieces = stages["packing"](spark, docs, root).collect()
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    path = public_tokenizers.path(packing.VOCABULARY)
    assert total == {k: len(packing.encode([t or ""], path)[0]) // 4 + 1 for k, t in texts.items()}


def test_run_hands_each_stage_what_was_kept(spark, corpus):
    root, texts, _ = corpus
    rows = corpus_pipeline.run(spark, root).collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {201, 202, 204} and {200, 203, 205} <= ids
    assert len({r.sequence_id for r in rows}) < len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert np.isfinite([r.length for r in rows]).all()
