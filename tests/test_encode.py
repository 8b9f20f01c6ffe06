"""The blocked encoder against one matrix product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ingest


@pytest.mark.parametrize("part", [None, 1 << 15])
def test_wide_dictionary(spark, monkeypatch, part):
    """16,384 features in 16 blocks; in one task a block of vectors, and dealt over many tasks."""
    if part:
        monkeypatch.setattr(ingest, "_PART", part * 4)
    rng = np.random.default_rng(2)
    w, b, t = rng.integers(-3, 4, (8, 16_384)).astype(float), rng.integers(-2, 3, 16_384).astype(float), rng.integers(0, 3, 16_384).astype(float)
    x = rng.integers(-2, 3, (300, 8)).astype(float)
    x[7] = 0
    vectors = spark.createDataFrame([(i // 10, "s", i % 10, f"t{i}", v.tolist()) for i, v in enumerate(x)], "text_id long, source string, token_pos long, token_str string, vector array<double>").repartition(3)
    got = ingest.encode(vectors, ingest.dictionary(spark, w, b, t), 5, 1.0).collect()
    s = np.maximum(x @ w + b, 0)
    s[s <= t] = 0
    s[s <= 1.0] = 0
    assert len(got) == len(x)
    for r in got:
        i = r["text_id"] * 10 + r["token_pos"]
        order = np.lexsort((np.arange(w.shape[1]), -s[i]))[:5]
        assert [(a["feature_id"], a["activation"]) for a in r["activations"]] == [(int(f), s[i, f]) for f in order if s[i, f] > 0]
        assert r["n_positive_features"] == (s[i] > 0).sum()


def test_no_positive_score_and_empty_tables(spark):
    v = spark.createDataFrame([(1, "s", 0, "a", [1.0, 2.0])], "text_id long, source string, token_pos long, token_str string, vector array<double>")
    d = ingest.dictionary(spark, np.array([[-1.0], [-1.0]]), np.zeros(1))
    r = ingest.encode(v, d, 3).first()
    assert r["activations"] == [] and r["n_positive_features"] == 0
    assert ingest.encode(v, d.limit(0), 3).first()["activations"] == []
    assert ingest.encode(v.limit(0), d, 3).count() == 0 and ingest.encoded_rows(ingest.encode(v.where(F.lit(False)), d)).count() == 0
