"""The numbers behind report pages: histograms, counts, points, ranked lists and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_finite


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """bin (from 0), bin_start, bin_end, count of every equal-width bin from minimum to maximum, the last one closed;
    missing values go, one single value has a bin range of width 1 around it."""
    v = df.select(F.col(col).cast("double").alias("v")).where(is_finite(F.col("v")))
    ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a IS NOT NULL")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = v.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), F.coalesce("count", F.lit(0)).alias("count")).orderBy("bin")


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """value (null is one) and count, most frequent first, the first ``n``."""
    c = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return c.limit(n) if n is not None else c


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None, n: int | None = None, order_by: str | None = None) -> DataFrame:
    """Rows with all coordinates, the first ``n`` by ``order_by``."""
    cols = [x, y] + ([color] if color else [])
    keep = ([order_by] if order_by and order_by not in cols else []) + cols
    p = df.select(*keep).dropna(subset=cols)
    return (p.orderBy(order_by) if order_by else p).limit(n) if n is not None else p


def variance_bars(summary: DataFrame) -> DataFrame:
    return summary.select("component", "explained_variance_ratio").orderBy("component")


def preview(df: DataFrame, cols: list[str], n: int = 20, width: int = 120) -> DataFrame:
    """The columns of ``cols`` that exist, n rows, as cells of a Markdown table: 4 significant digits without trailing
    zeros, nothing for a missing value, line ends as spaces, bars escaped, more than ``width`` characters cut and dotted."""
    kinds = dict(df.dtypes)

    def cell(c):
        if kinds[c] in ("double", "float"):
            v = F.col(c).cast("double")
            digits = F.regexp_replace(F.regexp_replace(F.format_string("%.4g", v), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
            return F.when(v.isNotNull() & ~F.isnan(v), digits).otherwise("")
        t = F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
        return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)

    return df.select(*[cell(c).alias(c) for c in cols if c in kinds]).limit(n)


def table_preview(df: DataFrame, keys: list[str], n: int = 40) -> DataFrame:
    """The first ``n`` rows by the first key descending, then the other keys ascending."""
    return df.orderBy(F.desc_nulls_last(keys[0]), *[F.asc_nulls_last(k) for k in keys[1:]]).limit(n)


def ranked(df: DataFrame, score: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` largest scores; a missing score counts as -1."""
    return df.orderBy(F.coalesce(F.col(score), F.lit(-1.0)).desc(), *ties).limit(n)


def ranked_report_sets(features: DataFrame, pairs: DataFrame, bimodal: DataFrame) -> dict[str, DataFrame]:
    """20 features by artifact score, 20 for manual review by semantic score, 20 pairs by suspicion, 30 bimodal candidates."""
    review = features.where(F.col("inspection_labels").contains("manual_review") if dict(features.dtypes)["inspection_labels"] == "string" else F.array_contains("inspection_labels", "manual_review"))
    return {
        "artifacts": ranked(features, "artifact_score", 20, "feature_id"),
        "manual_review": ranked(review, "semantic_score", 20, "feature_id"),
        "pairs": ranked(pairs, "pair_suspicion_score", 20, "feature_i", "feature_j"),
        "bimodal": ranked(bimodal, "bimodality_score", 30, "feature_id"),
    }
