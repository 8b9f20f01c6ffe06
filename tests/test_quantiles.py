"""Quantiles by rank against numpy, with brackets far smaller than the groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import quantiles as Q

QS = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


def values(kind, rng):
    n = 4000
    return {
        "spread": rng.normal(size=n), "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.5), "short": rng.normal(size=3), "single": np.array([2.0]),
        "mass": np.concatenate([rng.normal(size=n // 2), np.full(n // 2, 0.25)]), "steps": np.repeat(np.arange(40.0), 100), "tails": np.concatenate([np.full(n - 2, 1.0), [-np.inf, np.inf]]), "huge": 10.0 ** rng.uniform(-200, 200, n),
    }[kind]


KINDS = ("spread", "few", "one", "short", "single", "mass", "steps", "tails", "huge")


@pytest.mark.parametrize("limit,few", [(50, 0), (1_000_000, 0), (1_000_000, 10_000)])
def test_against_numpy(spark, limit, few):
    rng = np.random.default_rng(1)
    of = {k: values(k, rng) for k in KINDS}
    rows = [(k, float(x)) for k in KINDS for x in of[k]] + [("spread", None), ("none", None), ("none", float("nan")), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r["q"] for r in Q.quantiles(df, "v", QS, ("k",), limit, "q", few).collect()}
    assert set(got) == {*KINDS, None} and got[None] == [1.0, 1.25, 1.5, 1.95, 1.99, 2.0]
    for k in KINDS:
        with np.errstate(invalid="ignore"):
            want = np.quantile(of[k], QS) if k != "tails" else np.array([-np.inf, 1, 1, 1, 1, np.inf])
        assert None not in got[k], (k, got[k], want)
        assert np.allclose(got[k], want, rtol=1e-9, equal_nan=True), k


def test_one_group_of_all_rows_is_never_in_one_task(spark):
    """No bracket of more than the limit is ordered: the ordered rows are counted."""
    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_000).cast("double").alias("v"))
    seen = []
    meet = Q._meet
    try:
        Q._meet = lambda rows, want, group: (seen.append(want), meet(rows, want, group))[1]
        assert Q.quantiles(df, "v", (0.5, 0.9), limit=1000).first()["quantiles"] == pytest.approx([99_999.5, 179_999.1])
    finally:
        Q._meet = meet
    last = seen[-1].agg(F.max("_inside"), F.max(F.col("_hi") - F.col("_lo"))).first()
    assert last[0] <= 1000 and last[1] <= 1002


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert Q.quantiles(df, "v", (0.5,), ("k",)).count() == 0 and Q.quantiles(df, "v", (0.5,)).count() == 0
