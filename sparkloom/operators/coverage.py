"""Principal components of vectors, and how direction vectors lie in them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, effective_dimension, entropy, normalize

SUMMARY = "component long, explained_variance_ratio double, cumulative_explained_variance_ratio double"


def fit_pca(vectors: DataFrame, n: int, col: str = "vector") -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(components (n, d), variance ratios, mean) of the vectors; n is cut to the rows and the width. The
    covariance (d x d) is summed on the executors. Signs are fixed: each component's largest loading
    is positive. None for fewer than two rows or one dimension."""
    rows = vectors.select(F.transform(col, lambda x: x.cast("double")).alias("v")).where("v IS NOT NULL")
    first = rows.first()
    if first is None:
        return None
    d = len(first["v"])
    count = rows.count()
    if min(count, d) < 2:
        return None
    n = min(n, count, d)
    model = PCA(k=n, inputCol="x", outputCol="y").fit(rows.select(array_to_vector("v").alias("x")))
    pc = model.pc.toArray().T
    pc = pc * np.sign(pc[np.arange(n), np.abs(pc).argmax(axis=1)])[:, None]
    mean = rows.select(Summarizer.mean(array_to_vector("v")).alias("m")).first()["m"]
    return pc, np.asarray(model.explainedVariance.toArray()), np.asarray(mean.toArray())


def pca_summary(vectors: DataFrame, n: int = 20, col: str = "vector") -> DataFrame:
    """component (from 1), its variance ratio and the running sum."""
    return _summary(vectors.sparkSession, fit_pca(vectors, n, col))


def _summary(spark: SparkSession, fitted) -> DataFrame:
    if fitted is None:
        return spark.createDataFrame([], SUMMARY)
    rows = spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(fitted[1])], "component long, explained_variance_ratio double")
    return rows.withColumn("cumulative_explained_variance_ratio", F.sum("explained_variance_ratio").over(Window.orderBy("component")))


def _with_basis(df: DataFrame, pc: np.ndarray) -> DataFrame:
    """``df`` with the components as an array of arrays in _basis: one row of components x width numbers, sent to each task."""
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(pc.tolist(),)], "_basis array<array<double>>")))


def decoder_pca(directions: DataFrame, stats: DataFrame | None = None, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """(summary, coordinates) of the normalised directions: feature_id, decoder_pc1, decoder_pc2, centred, left
    joined with ``stats``."""
    unit = directions.select("feature_id", normalize(F.col("vector")).alias("vector"))
    fitted = fit_pca(unit, n)
    summary = _summary(directions.sparkSession, fitted)
    if fitted is None:
        return summary, directions.sparkSession.createDataFrame([], "feature_id long, decoder_pc1 double, decoder_pc2 double")
    pc, _, mean = fitted
    at = lambda k: (dot(F.col("vector"), F.col("_basis")[k]) - float(mean @ pc[k])) if k < len(pc) else F.lit(0.0)
    coords = _with_basis(unit, pc[:2]).select("feature_id", at(0).alias("decoder_pc1"), at(1).alias("decoder_pc2"))
    return summary, coords if stats is None else coords.join(stats, "feature_id", "left")


def coverage_bucket(observed, top1, top5, dimension, center, n: int) -> Column:
    return (
        F.when(observed < 0.05, "mostly_outside_observed_pca")
        .when(top1 >= 0.50, "single_head_pc_aligned")
        .when((top5 >= 0.65) & (dimension <= 6.0), "compact_high_variance_aligned")
        .when(center <= max(5.0, 0.25 * n), "broad_high_variance_aligned")
        .when(center >= max(8.0, 0.65 * n), "mid_tail_variance_aligned")
        .when(dimension >= max(8.0, 0.50 * n), "distributed_across_components")
        .otherwise("mid_variance_aligned")
    )


PROFILE = ("pc_mass_observed", "pc_observed_mass", "pc_mass_unobserved_tail", "pc_unobserved_mass", "effective_pc_dim", "pc_entropy", "pc_center_of_mass", "pc_explained_variance_top_1", "pc_explained_variance_top_5", "pc_explained_variance_observed")


def coverage_profiles(directions: DataFrame, residuals: DataFrame, n: int = 20, tops: tuple[int, ...] = (1, 5, 20), ids: DataFrame | None = None) -> DataFrame:
    """Per direction the squared projections on the ``n`` principal components of ``residuals``: mass inside
    them and outside, entropy, effective dimension, centre, and the mass of the first components,
    absolute and within the observed ones (with n = 20, that of the first 20 is 1)."""
    fitted = fit_pca(residuals, n)
    if fitted is None:
        masses = ", ".join(f"pc_mass_top_{k} double, pc_norm_mass_top_{k} double" for k in tops)
        return directions.sparkSession.createDataFrame([], "feature_id long, pc_components_observed long, " + ", ".join(f"{x} double" for x in PROFILE) + f", {masses}, coverage_bucket string")
    if ids is not None:
        directions = directions.join(ids.select("feature_id").distinct(), "feature_id", "left_semi")
    return profiles_on(directions, fitted[0], fitted[1], tops)


def profiles_on(directions: DataFrame, pc: np.ndarray, ratio: np.ndarray, tops: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """``coverage_profiles`` on given orthonormal components (rows of ``pc``) that explain ``ratio`` of the variance."""
    n = len(pc)
    d = _with_basis(directions.select("feature_id", normalize(F.col("vector")).alias("_v")), pc)
    d = d.select("feature_id", F.transform("_basis", lambda b: F.pow(dot(F.col("_v"), b), 2.0)).alias("_mass"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("pc_mass_observed", total(F.col("_mass"))).withColumn("_norm", F.transform("_mass", lambda m: m / F.greatest(F.col("pc_mass_observed"), F.lit(1e-8))))
    d = d.withColumns({
        "pc_components_observed": F.lit(n).cast("long"),
        "pc_observed_mass": F.col("pc_mass_observed"),
        "pc_mass_unobserved_tail": F.greatest(F.lit(0.0), 1 - F.col("pc_mass_observed")),
        "pc_unobserved_mass": F.greatest(F.lit(0.0), 1 - F.col("pc_mass_observed")),
        "effective_pc_dim": effective_dimension(F.col("_norm")),
        "pc_entropy": entropy(F.col("_norm")),
        "pc_center_of_mass": total(F.transform("_norm", lambda x, i: x * (i + 1))),
        "pc_explained_variance_top_1": F.lit(float(ratio[:1].sum())),
        "pc_explained_variance_top_5": F.lit(float(ratio[:5].sum())),
        "pc_explained_variance_observed": F.lit(float(ratio.sum())),
    } | {f"pc_mass_top_{k}": total(F.slice("_mass", 1, k)) for k in tops} | {f"pc_norm_mass_top_{k}": total(F.slice("_norm", 1, k)) for k in tops})
    norm_top = lambda k: total(F.slice("_norm", 1, k))
    d = d.withColumn("coverage_bucket", coverage_bucket(F.col("pc_mass_observed"), norm_top(1) if 1 in tops else F.lit(0.0), norm_top(5) if 5 in tops else (norm_top(1) if 1 in tops else F.lit(0.0)), F.col("effective_pc_dim"), F.col("pc_center_of_mass"), n))
    return d.select("feature_id", "pc_components_observed", *PROFILE, *[c for k in tops for c in (f"pc_mass_top_{k}", f"pc_norm_mass_top_{k}")], "coverage_bucket")
