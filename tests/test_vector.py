import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import vector as v

CASES = [
    ([1.0, 2.0], [1.0, 2.0], 1.0, 1.0), ([1.0, 0.0], [-1.0, 0.0], -1.0, 1 / 3), ([1.0, 0.0], [0.0, 1.0], 0.0, 1 / (1 + math.sqrt(2))),
    ([], [], 0.0, 0.0), ([1.0], [1.0, 2.0], 0.0, 0.0), (None, [1.0], 0.0, 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0, 1 / (1 + math.sqrt(2))), ([0.0], [0.0], 0.0, 1.0),
]


@pytest.mark.parametrize("a, b, cos, euc", CASES)
def test_cases(spark, a, b, cos, euc):
    r = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(v.cosine(F.col("a"), F.col("b")), v.euclidean(F.col("a"), F.col("b")), v.cosine(F.col("b"), F.col("a"))).first()
    assert r[0] == pytest.approx(cos) and r[1] == pytest.approx(euc) and r[2] == r[0]


def test_metric_names():
    assert v.metric("euclidean") is v.euclidean
    assert v.metric("cosine") is v.metric(None) is v.metric("hybrid") is v.metric(3) is v.cosine


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.floats(-100, 100), min_size=3, max_size=3), min_size=1, max_size=20), st.lists(st.floats(-100, 100), min_size=3, max_size=3))
def test_fast_cosine_agrees(spark, rows, q):
    df = spark.createDataFrame([(r,) for r in [*rows, None, [], [1.0]]], "e array<double>")
    got = df.select(v.cosine(F.col("e"), v.literal(q)).alias("a"), v.fast_cosine(q)(F.col("e")).alias("b")).collect()
    for r, e in zip(got, [*rows, None, None, None], strict=True):
        assert r["a"] == pytest.approx(r["b"], abs=1e-9)
        if e is not None and np.linalg.norm(e) > 1e-100 and np.linalg.norm(q) > 1e-100:
            assert r["a"] == pytest.approx(np.dot(e, q) / np.linalg.norm(e) / np.linalg.norm(q), abs=1e-6)


def test_hashed_vectors_are_counts_of_tokens(monkeypatch):
    """As one token after another, with what is remembered begun anew in between."""
    import hashlib
    import math
    import pickle

    from tessella.functions.text import STOP_WORDS
    from tessella.sources import providers

    def plain(text, dim):
        v = [0.0] * dim
        for t in providers._TOKENS((text or "").lower()):
            if t not in STOP_WORDS:
                v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    texts = [None, "", "the of", "Größe x9 Alpha alpha the", " ".join(f"w{i % 37}" for i in range(500))]
    monkeypatch.setattr(providers, "TOKENS_HELD", 5)
    for dim in (1, 8, 64):
        embedder = providers.HashEmbedder(dim)
        assert embedder.embed(texts) == [plain(t, dim) for t in texts] and 0 < len(embedder.buckets) <= 5
        assert not pickle.loads(pickle.dumps(embedder)).buckets
