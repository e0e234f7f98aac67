"""Questions to the buckets of op1's filter: many small ones are answered together."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from locusflow.llm import lm


class Counted(lm.Filter):
    times = 0

    def probe(self, keys):
        self.times += 1
        return super().probe(keys)


def test_small_questions_are_probed_together(monkeypatch):
    """As many questions as a large table sends, some empty, some beyond a run: the answers of each alone, few probes."""
    monkeypatch.setattr(lm, "PROBED_BYTES", 4096)
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 32, 5000, dtype=np.uint64)
    held = lm.build_filter(keys, rng.integers(1, 9, 5000))
    asks = [rng.choice(np.concatenate([keys, keys + np.uint64(1)]), n).astype("<u4").tobytes() for n in [0, 1, 3000, 2, *rng.integers(0, 12, 2000).tolist(), 0]]
    bits = Counted({0: held}, 1)
    got = list(lm.probed(pa.chunked_array([asks[:700], asks[700:]], pa.binary()), bits))
    assert bits.times < 40 and got == [bits.probe(lm.unpack_grams(x)).astype(np.uint8).tobytes() for x in asks]
    assert list(lm.probed(pa.chunked_array([], pa.binary()), bits)) == []


def test_scores_by_questions_equal_scores_by_broadcast(spark):
    rows = [(i, " ".join(f"w{(i * j) % 37} v{i}" for j in range(i % 50))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = lambda **a: sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm.score_texts(docs, **a).collect())
    assert scored() == scored(max_filter_bytes=1, hot_words_most=5) and docs.where(F.length("text") == 0).count() > 0
