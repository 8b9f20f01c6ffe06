"""Row and feature filters."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeatureFilter, RowFilter
from ..functions.numeric import is_finite
from ..functions.text import attach_token_quality, keep_quality, token_quality_columns


def apply_row_filters(acts: DataFrame, cfg: RowFilter = RowFilter()) -> DataFrame:
    """The nine optional row predicates, in one pass. Exclusions keep nulls, all other tests drop them."""

    def out(col, values):
        return ~F.coalesce(F.col(col).isin(*values), F.lit(False))

    if cfg.require_finite_activation:
        acts = acts.where(is_finite(F.col("activation")))
    if cfg.include_sources is not None:
        acts = acts.where(F.col("source").isin(*cfg.include_sources))
    if cfg.exclude_sources:
        acts = acts.where(out("source", cfg.exclude_sources))
    if cfg.exclude_token_positions:
        acts = acts.where(out("token_pos", cfg.exclude_token_positions))
    if cfg.exclude_token_positions_ge is not None:
        acts = acts.where(F.col("token_pos") < cfg.exclude_token_positions_ge)
    if cfg.exclude_token_strings:
        acts = acts.where(out("token_str", cfg.exclude_token_strings))
    if cfg.exclude_token_substrings:
        has = reduce(lambda a, b: a | b, [F.col("token_str").contains(s) for s in cfg.exclude_token_substrings])
        acts = acts.where(~F.coalesce(has, F.lit(False)))
    if cfg.exclude_token_quality_kinds:
        acts = attach_token_quality(acts).where(keep_quality(cfg.exclude_token_quality_kinds))
        if not cfg.keep_token_quality_columns:
            acts = acts.drop(*token_quality_columns(acts))
    if cfg.min_activation is not None:
        acts = acts.where(F.col("activation") >= cfg.min_activation)
    return acts


def of_tokens(cfg: RowFilter) -> RowFilter:
    """The predicates of ``cfg`` that look at tokens alone: they can be applied before a token has a row for each feature."""
    return replace(cfg, require_finite_activation=False, min_activation=None, keep_token_quality_columns=False)


def of_activations(cfg: RowFilter) -> RowFilter:
    """The predicates of ``cfg`` that of_tokens() leaves."""
    return RowFilter(cfg.require_finite_activation, exclude_token_positions=(), exclude_token_strings=(), exclude_token_substrings=(), exclude_token_quality_kinds=(), min_activation=cfg.min_activation)


def apply_feature_filters(stats: DataFrame, cfg: FeatureFilter = FeatureFilter()) -> DataFrame:
    return stats.where((F.col("n_token_activations") >= cfg.min_feature_token_count) & (F.col("n_texts") >= cfg.min_feature_text_count) & (F.col("token_frequency") <= cfg.max_feature_token_frequency))


def semi_filter(acts: DataFrame, ids: DataFrame, key: str = "feature_id") -> DataFrame:
    """Rows whose feature is among ``ids``; Spark sends the ids to the tasks if they are few."""
    return acts.join(ids.select(key).distinct(), key, "left_semi")


def missing_features(wanted: DataFrame, seen: DataFrame, key: str = "feature_id") -> DataFrame:
    """The ids without a row, with status missing."""
    return wanted.select(key).distinct().join(seen.select(key), key, "left_anti").withColumn("status", F.lit("missing"))


def feature_lookup(table: DataFrame, feature_id: int, n: int | None = None) -> DataFrame:
    """Rows of one feature, strongest first; the predicate reaches the scan."""
    rows = table.where(F.col("feature_id") == feature_id)
    if "activation" in table.columns:
        order = [F.desc_nulls_last("activation"), *[c for c in ("text_id", "token_pos") if c in table.columns]]
        rows = rows.orderBy(*order)
    return rows.limit(n) if n is not None else rows
