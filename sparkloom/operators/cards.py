"""Feature cards: one wide row of evidence for each feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cooccurrence import undirected_edges
from .inspection import FEATURE_COLUMNS, as_json, top_list
from .labels import assign_feature_labels

EXAMPLE = ["rank", "activation", "source", "text_id", "token_pos", "left_context", "center_token", "right_context"]
BIMODAL = ["bimodality_score", "log_mean_low", "log_mean_high", "activation_min", "activation_p50", "activation_p95", "activation_max", "n_points"]
COVERAGE = ["pc_mass_observed", "pc_mass_unobserved_tail", "effective_pc_dim", "pc_entropy", "pc_center_of_mass", "pc_mass_top_1", "pc_mass_top_5", "pc_mass_top_20", "pc_norm_mass_top_1", "pc_norm_mass_top_5", "pc_norm_mass_top_20", "coverage_bucket"]
ALIGNMENT = ["n_geometry_neighbors", "n_coactivation_neighbors", "gca_at_5", "gca_at_10", "gca_at_20", "graph_alignment_bucket"]
#: The columns that come first, in this order.
ORDER = [
    "feature_id", "primary_label", "manual_priority", "inspection_labels", "artifact_score", "semantic_score", "graph_agreement_score", "coverage_coherence_score",
    "n_token_activations", "n_texts", "token_frequency", "text_frequency", "mean_activation", "p50_activation", "p95_activation", "p99_activation", "max_activation",
    "bimodality_score", "max_decoder_cosine", "max_coactivation_jaccard", "max_coactivation_pmi", "gca_at_5", "gca_at_10", "gca_at_20", "graph_alignment_bucket",
    "pc_norm_mass_top_20", "effective_pc_dim", "pc_entropy", "coverage_bucket", "decoder_pc1", "decoder_pc2", "decoder_umap_x", "decoder_umap_y",
    "bimodal_low_examples_json", "bimodal_high_examples_json", "top_examples_json", "top_decoder_neighbors_json", "top_coactivation_neighbors_json",
]


def merge_replace(left: DataFrame, right: DataFrame | None, on: str, cols: list[str], order_by: list | None = None) -> DataFrame:
    """``left`` with the columns ``cols`` taken from ``right``: those it had are replaced, right's first row of a key
    counts (by ``order_by``, else by the columns themselves), and a right side that is missing, lacks the
    key or has no row leaves them as they were (null where left had none). Doing it twice is doing it once."""
    if right is None or on not in right.columns:
        return left
    cols = [c for c in cols if c in right.columns]
    small = right.select(on, *cols)
    w = Window.partitionBy(on).orderBy(*(order_by or cols or [on]))
    small = small.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    had = [c for c in cols if c in left.columns]
    out = left.withColumnsRenamed({c: f"_old_{c}" for c in had}).join(small, on, "left")
    if not had:
        return out
    # one row that tells whether right has any; it reads what the join reads
    any_row = F.broadcast(small.agg(F.max(F.xxhash64(on, *cols)).isNotNull().alias("_any")))
    out = out.crossJoin(any_row).withColumns({c: F.when(F.col("_any"), F.col(c)).otherwise(F.col(f"_old_{c}")) for c in had})
    return out.drop("_any", *[f"_old_{c}" for c in had])


def basic_feature_cards(filtered: DataFrame, examples: DataFrame, run_info=()) -> DataFrame:
    """Filtered features with their top 5 examples as JSON and the constant columns of the run."""
    top = top_list(examples, "feature_id", [F.desc_nulls_last("activation"), "rank"], 5, EXAMPLE, "_e").select("feature_id", as_json("_e").alias("top_examples_json"))
    cards = filtered.join(top, "feature_id", "left")
    return cards.withColumns({k: F.lit(v) for k, v in run_info}) if run_info else cards


def merge_inspection(cards, inspection):
    return merge_replace(cards, inspection, "feature_id", list(FEATURE_COLUMNS[1:]))


def merge_bimodality(cards, candidates, peaks=None):
    cards = merge_replace(cards, candidates, "feature_id", BIMODAL)
    if peaks is not None:
        cols = ["activation", "source", "text_id", "token_pos", "left_context", "center_token", "right_context"]
        for label in ("low", "high"):
            top = top_list(peaks.where(F.col("peak_label") == label), "feature_id", [F.desc_nulls_last("activation"), "text_id", "token_pos"], 5, cols, "_e")
            name = f"bimodal_{label}_examples_json"
            cards = merge_replace(cards, top.select("feature_id", as_json("_e").alias(name)), "feature_id", [name])
    return cards


def merge_decoder_neighbors(cards, neighbors):
    best = neighbors.groupBy(F.col("feature_i").alias("feature_id")).agg(F.max("decoder_cosine").alias("max_decoder_cosine"))
    cards = merge_replace(cards, best, "feature_id", ["max_decoder_cosine"])
    top = top_list(neighbors, "feature_i", [F.asc("rank")], 10, ["feature_i", "feature_j", "rank", "decoder_cosine"], "_e")
    return merge_replace(cards, top.select(F.col("feature_i").alias("feature_id"), as_json("_e").alias("top_decoder_neighbors_json")), "feature_id", ["top_decoder_neighbors_json"])


def merge_coactivation(cards, pairs):
    both = undirected_edges(pairs)
    best = both.groupBy("feature_id").agg(F.max("jaccard").alias("max_coactivation_jaccard"), F.max("pmi").alias("max_coactivation_pmi"))
    cards = merge_replace(cards, best, "feature_id", ["max_coactivation_jaccard", "max_coactivation_pmi"])
    order = [F.desc_nulls_last("jaccard"), F.desc_nulls_last("pmi"), F.desc_nulls_last("coactivation_count"), "neighbor_feature_id"]
    top = top_list(both, "feature_id", order, 10, both.columns, "_e")
    return merge_replace(cards, top.select("feature_id", as_json("_e").alias("top_coactivation_neighbors_json")), "feature_id", ["top_coactivation_neighbors_json"])


def merge_projection(cards, coords, x: str = "decoder_pc1", y: str = "decoder_pc2"):
    """Any supplied coordinates, under their own names."""
    return merge_replace(cards, coords, "feature_id", [x, y])


def projection_metadata(stats, inspection=None, bimodal=None):
    """Statistics with inspection and bimodality columns and labels: what a projection is coloured by."""
    return assign_feature_labels(merge_replace(merge_replace(stats, inspection, "feature_id", list(FEATURE_COLUMNS[1:])), bimodal, "feature_id", BIMODAL))


def enrich_feature_cards(cards, inspection=None, bimodal=None, peaks=None, neighbors=None, pairs=None, pca=None, layout=None, coverage=None, alignment=None) -> DataFrame:
    """Cards with all evidence that is given, labels and priority, preferred columns first. All evidence has one row
    (or a bounded list) for each feature, so these joins stay as small as the number of features."""
    cards = merge_inspection(cards, inspection)
    cards = merge_bimodality(cards, bimodal, peaks)
    cards = merge_decoder_neighbors(cards, neighbors) if neighbors is not None else cards
    cards = merge_coactivation(cards, pairs) if pairs is not None else cards
    cards = merge_projection(cards, pca)
    cards = merge_projection(cards, layout, "decoder_umap_x", "decoder_umap_y")
    cards = merge_replace(cards, coverage, "feature_id", COVERAGE)
    cards = merge_replace(cards, alignment, "feature_id", ALIGNMENT)
    cards = assign_feature_labels(cards)
    first = [c for c in ORDER if c in cards.columns]
    return cards.select(*first, *[c for c in cards.columns if c not in first])
