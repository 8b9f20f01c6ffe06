"""Two activation regimes of a feature: Gaussian mixtures of log1p(activation)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.artifacts import shared_dir

from ..functions.numeric import is_finite
from .quantiles import quantiles
from .stats import context_by_position

#: Floor of a variance, least gain of the mean log-likelihood, most rounds.
FLOOR, GAIN, ROUNDS = 1e-6, 1e-3, 100
#: Distinct values up to which one task fits a feature; a feature with more is fitted by sums over all tasks.
IN_TASK = 1_000_000
_LOG_2PI = math.log(2 * math.pi)
PEAK_COLUMNS = ("feature_id", "peak_label", "activation", "log_activation", "bimodality_score", "peak_log_mean_low", "peak_log_mean_high", "text_id", "token_pos", "source", "left_context", "center_token", "right_context")


def log_points(acts: DataFrame) -> DataFrame:
    """(feature_id, x, n): log1p of the finite positive activations; equal values are one row with
    their number, so a frequent feature with repeated values is short."""
    return acts.where(is_finite(F.col("activation")) & (F.col("activation") > 0)).groupBy("feature_id", F.log1p("activation").alias("x")).agg(F.count("*").alias("n"))


def _log_density(x: Column, weight: Column, mean: Column, var: Column) -> Column:
    return F.log(weight) - 0.5 * (_LOG_2PI + F.log(var) + (x - mean) * (x - mean) / var)


def fit_two_components(points: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Two-component mixtures of ``points`` (feature_id, x, n): feature_id, w0, m0, v0, w1, m1, v1, loglik (mean).
    Features of up to ``in_task`` distinct values are fitted each in one task, larger ones together
    by fit_by_sums; both take the same steps."""
    sizes = points.groupBy("feature_id").agg(F.count("*").alias("_size"))
    large = sizes.where(F.col("_size") > in_task).select("feature_id")
    small = points.join(sizes.where(F.col("_size") <= in_task).select("feature_id"), "feature_id", "left_semi")
    fitted = small.groupBy("feature_id").applyInPandas(_fit_one, "feature_id long, w0 double, m0 double, v0 double, w1 double, m1 double, v1 double, loglik double")
    if large.limit(1).count():
        fitted = fitted.unionByName(fit_by_sums(points.join(large, "feature_id", "left_semi")))
    return fitted


def _fit_one(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("x")
    x, n = rows["x"].to_numpy(), rows["n"].to_numpy(np.float64)
    cut = (x * n).sum() / n.sum()
    for _ in range(5):
        low = x < cut
        sides = [(x[s] * n[s]).sum() / n[s].sum() if s.any() else cut for s in (low, ~low)]
        cut = sum(sides) / 2
    r, last = (x >= cut).astype(np.float64), -np.inf
    for i in range(ROUNDS + 1):
        weights = np.stack([n * (1 - r), n * r])
        total = np.maximum(weights.sum(axis=1), 1e-12)
        w, m = np.maximum(weights.sum(axis=1) / n.sum(), 1e-12), weights @ x / total
        v = np.maximum(0.0, weights @ (x * x) / total - m * m) + FLOOR
        d = np.log(w)[:, None] - 0.5 * (_LOG_2PI + np.log(v)[:, None] + (x - m[:, None]) ** 2 / v[:, None])
        top = d.max(axis=0)
        ll = top + np.log(np.exp(d - top).sum(axis=0))
        r, mean = np.exp(d[1] - ll), (n * ll).sum() / n.sum()
        if mean - last < GAIN:
            break
        last = mean
    return pd.DataFrame({"feature_id": [rows["feature_id"].iloc[0]], "w0": w[0], "m0": m[0], "v0": v[0], "w1": w[1], "m1": m[1], "v1": v[1], "loglik": mean})


def fit_by_sums(points: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The same for features of any size, all at once.

    The start is two means: a point belongs to the low side if it is below the middle of its feature's
    mean of the low and high half. A round of expectation and maximisation is one sum over the
    points for every feature, with map-side partial sums, so a feature may be as large as
    the table; only a row of six numbers for each feature goes from round to round. A
    feature whose mean log-likelihood gains less than GAIN keeps its numbers.
    """
    spark = points.sparkSession
    middle = points.groupBy("feature_id").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("cut"))
    for _ in range(5):  # two means in one dimension: the cut moves to the middle of both sides' means
        p = points.join(middle, "feature_id")
        low, w = F.col("x") < F.col("cut"), F.col("n")
        side = lambda c: F.sum(F.when(c, F.col("x") * w)) / F.sum(F.when(c, w))
        middle = p.groupBy("feature_id").agg(((F.coalesce(side(low), F.max("cut")) + F.coalesce(side(~low), F.max("cut"))) / 2).alias("cut"))
        middle = _kept(middle)
    first = (F.col("x") >= F.col("cut")).cast("double")
    params = _kept(_maximise(points.join(middle, "feature_id").select("feature_id", "x", "n", first.alias("r"), F.lit(None).cast("double").alias("ll"))).withColumns({"loglik": F.lit(float("-inf")), "done": F.lit(False)}))
    for i in range(rounds):
        p = points.join(params.where("NOT done"), "feature_id")
        a = _log_density(F.col("x"), F.col("w0"), F.col("m0"), F.col("v0"))
        b = _log_density(F.col("x"), F.col("w1"), F.col("m1"), F.col("v1"))
        top = F.greatest(a, b)
        ll = top + F.log(F.exp(a - top) + F.exp(b - top))
        new = _maximise(p.select("feature_id", "x", "n", F.exp(b - ll).alias("r"), ll.alias("ll")))
        old = params.select("feature_id", *[F.col(c).alias(f"_{c}") for c in ("w0", "m0", "v0", "w1", "m1", "v1", "loglik", "done")])
        j = old.join(new, "feature_id", "left")
        over = F.col("_done") | F.col("loglik").isNull()
        stop = over | (F.col("loglik") - F.col("_loglik") < GAIN)
        params = _kept(j.select("feature_id", *[F.when(stop, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("w0", "m0", "v0", "w1", "m1", "v1")], F.when(over, F.col("_loglik")).otherwise(F.col("loglik")).alias("loglik"), stop.alias("done")))
        if not params.where("NOT done").limit(1).count():
            break
    return params.drop("done")


def _maximise(rows: DataFrame) -> DataFrame:
    r, n, x = F.col("r"), F.col("n"), F.col("x")
    s = rows.groupBy("feature_id").agg(F.sum(n).alias("n"), F.sum(n * r).alias("n1"), F.sum(n * r * x).alias("s1"), F.sum(n * r * x * x).alias("q1"), F.sum(n * (1 - r)).alias("n0"), F.sum(n * (1 - r) * x).alias("s0"), F.sum(n * (1 - r) * x * x).alias("q0"), (F.sum(n * F.col("ll")) / F.sum(n)).alias("loglik"))
    tiny = F.lit(1e-12)
    mean = lambda i: F.col(f"s{i}") / F.greatest(F.col(f"n{i}"), tiny)
    var = lambda i: F.greatest(F.lit(0.0), F.col(f"q{i}") / F.greatest(F.col(f"n{i}"), tiny) - mean(i) * mean(i)) + FLOOR
    w = lambda i: F.greatest(F.col(f"n{i}") / F.col("n"), tiny)
    return s.select("feature_id", w(0).alias("w0"), mean(0).alias("m0"), var(0).alias("v0"), w(1).alias("w1"), mean(1).alias("m1"), var(1).alias("v1"), "loglik")


def _kept(params: DataFrame) -> DataFrame:
    """The rows, with their lineage cut through the checkpoint folder."""
    spark = params.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return params.checkpoint(eager=True)


def bimodality_candidates(acts: DataFrame, min_points: int = 100) -> DataFrame:
    """Per feature with ``min_points`` finite positive activations: BIC of one and of two components, their
    difference as bimodality_score, the low and high mean, and minimum, median, 0.95 quantile and
    maximum of the activations; largest score first."""
    points = log_points(acts)
    n = F.sum("n")
    one = points.groupBy("feature_id").agg(n.alias("n_points"), (F.sum(F.col("x") * F.col("n")) / n).alias("m"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("q"))
    one = one.where(F.col("n_points") >= min_points).withColumn("v", F.greatest(F.lit(0.0), F.col("q") / F.col("n_points") - F.col("m") * F.col("m")) + FLOOR)
    points = _kept(points.join(one.select("feature_id"), "feature_id", "left_semi"))
    two = fit_two_components(points)
    # mean log-likelihood of one Gaussian at its own mean and (floored) variance
    ll1 = -0.5 * (_LOG_2PI + F.log("v") + (F.col("v") - FLOOR) / F.col("v"))
    a = F.col("activation")
    good = acts.where(is_finite(a) & (a > 0))
    spread = good.groupBy("feature_id").agg(F.min(a).alias("activation_min"), F.max(a).alias("activation_max"))
    spread = spread.join(quantiles(good, a, (0.5, 0.95), ("feature_id",), name="_p"), "feature_id").withColumns({f"activation_p{q}": F.get("_p", F.lit(i)) for i, q in enumerate((50, 95))})
    j = one.join(two, "feature_id").join(spread, "feature_id")
    k = F.col("n_points").cast("double")
    j = j.withColumns({"bic_1": -2 * k * ll1 + 2 * F.log(k), "bic_2": -2 * k * F.col("loglik") + 5 * F.log(k)})
    return j.select("feature_id", "n_points", "bic_1", "bic_2", (F.col("bic_1") - F.col("bic_2")).alias("bimodality_score"), F.least("m0", "m1").alias("log_mean_low"), F.greatest("m0", "m1").alias("log_mean_high"), "activation_min", "activation_p50", "activation_p95", "activation_max").orderBy(F.desc("bimodality_score"), "feature_id")


def peak_examples(acts: DataFrame, meta: DataFrame, candidates: DataFrame, top_features: int = 50, per_peak: int = 8, window: int = 20) -> DataFrame:
    """For the first ``top_features`` candidates: rows dealt to the low or high component (the likelier one), the
    ``per_peak`` strongest of each with context by position."""
    ranked = candidates.orderBy(F.desc_nulls_last("bimodality_score"), "feature_id").limit(top_features).select("feature_id", "bimodality_score")
    rows = acts.join(ranked, "feature_id").where(is_finite(F.col("activation")) & (F.col("activation") > 0))
    two = fit_two_components(_kept(log_points(rows)))
    rows = rows.withColumn("log_activation", F.log1p("activation")).join(two, "feature_id")
    a = _log_density(F.col("log_activation"), F.col("w0"), F.col("m0"), F.col("v0"))
    b = _log_density(F.col("log_activation"), F.col("w1"), F.col("m1"), F.col("v1"))
    low_first = F.col("m0") <= F.col("m1")
    is_low = F.when(low_first, a >= b).otherwise(b >= a)
    rows = rows.withColumns({"peak_label": F.when(is_low, "low").otherwise("high"), "peak_log_mean_low": F.least("m0", "m1"), "peak_log_mean_high": F.greatest("m0", "m1")})
    w = Window.partitionBy("feature_id", "peak_label").orderBy(F.desc("activation"), "text_id", "token_pos")
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_peak)
    out = context_by_position(top.select("feature_id", "peak_label", "activation", "log_activation", "bimodality_score", "peak_log_mean_low", "peak_log_mean_high", "text_id", "token_pos", "source"), meta, window)
    return out.select(*PEAK_COLUMNS).orderBy(F.desc("bimodality_score"), "feature_id", "peak_label", F.desc("activation"), "text_id", "token_pos")
