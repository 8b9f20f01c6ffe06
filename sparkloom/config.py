"""Settings of the analyses, with their default values."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.text import KINDS


@dataclass(frozen=True)
class RowFilter:
    require_finite_activation: bool = True
    include_sources: tuple[str, ...] | None = None
    exclude_sources: tuple[str, ...] = ()
    exclude_token_positions: tuple[int, ...] = (0,)
    exclude_token_positions_ge: int | None = None
    exclude_token_strings: tuple[str, ...] = ("",)
    exclude_token_substrings: tuple[str, ...] = ("â", "€", "™")
    exclude_token_quality_kinds: tuple[str, ...] = KINDS
    keep_token_quality_columns: bool = True
    min_activation: float | None = None


@dataclass(frozen=True)
class FeatureFilter:
    min_feature_token_count: int = 50
    min_feature_text_count: int = 10
    max_feature_token_frequency: float = 0.20


@dataclass(frozen=True)
class Analysis:
    coactivation_max_pairs: int = 100_000
    neighbors_top_k: int = 20
    neighbors_block: int = 512
    bimodality_min_points: int = 100
    peak_top_features: int = 50
    peak_examples: int = 8
    top_examples: int = 20
    context_window: int = 20
    inspect_pairs: int = 30
    pca_components: int = 20
    coverage_tops: tuple[int, ...] = (1, 5, 20)
    residual_stride: int = 8
    alignment_k: tuple[int, ...] = (5, 10, 20)
    max_seq_len: int = 256
    boundary_margin: int = 16


@dataclass(frozen=True)
class RunConfig:
    rows: RowFilter = field(default_factory=RowFilter)
    features: FeatureFilter = field(default_factory=FeatureFilter)
    analysis: Analysis = field(default_factory=Analysis)
    #: The dictionary that encodes token_vectors: a table as of ingest.dictionary(), or its arguments weights (width, features), bias
    #: and threshold.
    encoder: object | None = None
    #: Constant columns of every card.
    run_info: tuple[tuple[str, object], ...] = (("run_name", "run"), ("corpus", ""), ("activation_mode", "topk"), ("top_k", 64), ("model_name", ""), ("sae_release", ""), ("sae_id", ""), ("layer", 0), ("hook_name", ""), ("site", ""), ("width", ""), ("l0", ""))
