"""The steps of a run: each reads tables of the run and writes its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import alignment, cards, cooccurrence, coverage, filters, geometry, ingest, inspection, mixture, report, stats
from ..sources.artifacts import Run, drop, stored

CORE = ("collect",)
ATLAS = ("collect", "features", "coactivation", "geometry", "geometry-vs-coactivation", "bimodality", "inspection", "space", "cards", "report")
RESEARCH = ("collect", "features", "coactivation", "geometry", "geometry-vs-coactivation", "bimodality", "inspection", "space", "coverage", "alignment", "cards", "report")
PRESETS = {"core": CORE, "atlas": ATLAS, "research": RESEARCH}


def filtered_acts(run: Run, cfg: RunConfig, anew: bool = False) -> DataFrame:
    """The filtered fact table: step_features writes it anew from the activations and filters at hand, later steps read it."""
    if anew or not run.has("filtered_activations"):
        run.write("filtered_activations", filters.apply_row_filters(run.sae_activations(), cfg.rows))
    return run.table("filtered_activations")


def step_collect(run: Run, cfg: RunConfig) -> None:
    """Tokens of texts; from token_vectors, through cfg.encoder, activations, the count of positive ones of each token, and
    every so-manieth vector as residual_vectors; or activations from dense_activations (vectors encoded before).
    Each where the run has what it takes. Texts with a number that is not finite go whole."""
    info = dict(cfg.run_info)
    mode = info.get("activation_mode", "topk")
    if mode not in ("topk", "positive"):
        raise ValueError(f"activation_mode is topk or positive, not {mode}")
    topk, k = mode == "topk", int(info.get("top_k", 64))
    if run.has("texts"):
        run.write("token_metadata", ingest.explode_tokens(run.texts(), max_seq_len=cfg.analysis.max_seq_len))
    if run.has("dense_activations"):
        dense = ingest.drop_nonfinite_texts(run.table("dense_activations"))
        run.write(f"sae_activations_{'topk' if topk else 'positive'}", ingest.sparsify_topk(dense, k) if topk else ingest.sparsify_positive(dense))
        run.write("token_activation_summary", ingest.token_activation_summary(dense))
    if run.has("token_vectors"):
        vectors = ingest.drop_nonfinite_texts(run.table("token_vectors"))
        run.write("residual_vectors", ingest.sample_vectors(vectors, cfg.analysis.residual_stride))
        if cfg.encoder is not None:
            features = ingest.dictionary(run.spark, *cfg.encoder) if isinstance(cfg.encoder, tuple) else cfg.encoder
            encoded = stored(ingest.encode(vectors, features, k if topk else None), "encoded")  # bests and counts of one pass
            run.write(f"sae_activations_{'topk' if topk else 'positive'}", ingest.encoded_rows(encoded))
            run.write("token_activation_summary", encoded.drop("activations"))
            drop(encoded)


def step_features(run: Run, cfg: RunConfig) -> None:
    acts, meta = filtered_acts(run, cfg, anew=True), run.token_metadata()
    s = run.write("feature_stats", stats.feature_stats(acts, meta))
    kept = run.write("filtered_features", filters.apply_feature_filters(s, cfg.features))
    top = run.write("top_feature_examples", stats.top_examples(acts, meta, cfg.analysis.top_examples, cfg.analysis.context_window))
    run.write("feature_cards", cards.basic_feature_cards(kept, top, cfg.run_info))


def step_coactivation(run: Run, cfg: RunConfig) -> None:
    run.write("coactivation_pairs", cooccurrence.same_token_pairs(filtered_acts(run, cfg), run.filtered_features(), cfg.analysis.coactivation_max_pairs))


def step_geometry(run: Run, cfg: RunConfig) -> None:
    run.write("decoder_neighbors", geometry.decoder_neighbors(run.directions(), run.filtered_features(), cfg.analysis.neighbors_top_k, cfg.analysis.neighbors_block))


def step_geometry_vs_coactivation(run: Run, cfg: RunConfig) -> None:
    run.write("geometry_vs_coactivation", geometry.geometry_vs_coactivation(run.decoder_neighbors(), run.coactivation_pairs()))


def step_bimodality(run: Run, cfg: RunConfig) -> None:
    acts = filtered_acts(run, cfg)
    found = run.write("bimodal_feature_candidates", mixture.bimodality_candidates(acts, cfg.analysis.bimodality_min_points))
    run.write("bimodal_peak_examples", mixture.peak_examples(acts, run.token_metadata(), found, cfg.analysis.peak_top_features, cfg.analysis.peak_examples, cfg.analysis.context_window))


def step_inspection(run: Run, cfg: RunConfig) -> None:
    acts = filtered_acts(run, cfg)
    s = inspection.summarize_features(acts, run.filtered_features(), run.top_feature_examples(), cfg.analysis.max_seq_len, cfg.analysis.boundary_margin)
    run.write("inspection_feature_summaries", inspection.feature_summaries_frame(s))
    order = [F.desc("pmi"), F.desc("jaccard"), F.desc("coactivation_count"), "feature_i", "feature_j"]
    pairs = run.coactivation_pairs().orderBy(*order).limit(cfg.analysis.inspect_pairs)
    ids = pairs.select(F.col("feature_i").alias("feature_id")).union(pairs.select("feature_j"))
    run.write("inspection_pair_summaries", inspection.pair_summaries_frame(inspection.summarize_pairs(acts, pairs, inspection.summarize_features(acts, ids, None, cfg.analysis.max_seq_len, cfg.analysis.boundary_margin))))


def step_space(run: Run, cfg: RunConfig) -> None:
    n = cfg.analysis.pca_components
    run.write("residual_pca_summary", coverage.pca_summary(run.residual_vectors(), n))
    kept = filters.semi_filter(run.directions(), run.filtered_features())
    summary, coords = coverage.decoder_pca(kept, run.filtered_features(), n)
    run.write("decoder_pca_summary", summary)
    run.write("decoder_feature_pca", coords)


def step_coverage(run: Run, cfg: RunConfig) -> None:
    run.write("feature_coverage_profiles", coverage.coverage_profiles(run.directions(), run.residual_vectors(), cfg.analysis.pca_components, cfg.analysis.coverage_tops, run.filtered_features()))


def step_alignment(run: Run, cfg: RunConfig) -> None:
    a = run.write("feature_graph_alignment", alignment.graph_alignment(run.decoder_neighbors(), run.coactivation_pairs(), run.filtered_features(), cfg.analysis.alignment_k))
    run.write("graph_alignment_summary", alignment.alignment_summary(a))


def step_cards(run: Run, cfg: RunConfig) -> None:
    base = run.table("feature_cards") if run.has("feature_cards") else run.filtered_features()
    have = lambda name: run.table(name) if run.has(name) else None
    run.write("feature_cards", cards.enrich_feature_cards(base, have("inspection_feature_summaries"), have("bimodal_feature_candidates"), have("bimodal_peak_examples"), have("decoder_neighbors"), have("coactivation_pairs"), have("decoder_feature_pca"), have("projection"), have("feature_coverage_profiles"), have("feature_graph_alignment")))


#: The tables with a preview in the report, and the columns that order it.
PREVIEWS = {
    "feature_cards": ("manual_priority", "artifact_score"), "feature_stats": ("n_token_activations", "p99_activation"), "bimodal_feature_candidates": ("bimodality_score",),
    "geometry_vs_coactivation": ("decoder_cosine", "jaccard"), "inspection_feature_summaries": ("manual_priority", "artifact_score"), "inspection_pair_summaries": ("pair_artifact_score",),
    "feature_coverage_profiles": ("pc_norm_mass_top_20", "effective_pc_dim"), "feature_graph_alignment": ("gca_at_10",),
}


def step_report(run: Run, cfg: RunConfig) -> None:
    """Histograms, counts and ranked lists of the cards, previews of the tables, and the variances of components."""
    c = run.feature_cards()
    for name, keys in PREVIEWS.items():
        if run.has(name):
            t = run.table(name)
            run.write(f"report_table_{name}", report.table_preview(t, [k for k in (*keys, "feature_id", "feature_i", "feature_j") if k in t.columns]))
    for name in ("residual", "decoder"):
        if run.has(f"{name}_pca_summary"):
            run.write(f"report_variance_{name}", report.variance_bars(run.table(f"{name}_pca_summary")))
    if run.has("token_activation_summary"):
        run.write("report_histogram_n_positive_features", report.histogram(run.token_activation_summary(), "n_positive_features"))
    for col in ("token_frequency", "p99_activation", "bimodality_score", "artifact_score", "effective_pc_dim", "pc_norm_mass_top_20", "gca_at_10"):
        if col in c.columns:
            run.write(f"report_histogram_{col}", report.histogram(c, col))
    for col, n in (("primary_label", 12), ("coverage_bucket", None), ("graph_alignment_bucket", None)):
        if col in c.columns:
            run.write(f"report_counts_{col}", report.value_counts(c, col, n))
    if run.has("geometry_vs_coactivation"):
        run.write("report_counts_quadrant", report.value_counts(run.table("geometry_vs_coactivation"), "quadrant"))
    if run.has("inspection_feature_summaries") and run.has("bimodal_feature_candidates"):
        for name, df in report.ranked_report_sets(run.table("inspection_feature_summaries"), run.table("inspection_pair_summaries"), run.table("bimodal_feature_candidates")).items():
            run.write(f"report_{name}", df)


STEPS = {name: globals()["step_" + name.replace("-", "_")] for name in RESEARCH}


def run_pipeline(run: Run, steps: str | tuple[str, ...] = "atlas", cfg: RunConfig = RunConfig()) -> Run:
    """Runs a preset, or the given steps in their order. The run's folder must hold token_metadata and activations, or
    what the collect step makes them of, and, for the geometric steps, directions and residual_vectors. The
    rows and features of every table that a step wrote go to the run's table metrics. Facts and tokens lie in buckets of
    texts, evidence in buckets of features; where spark.sql.requireAllClusterKeysForCoPartition is off, joins by text and
    position use the former too."""
    metrics = None
    for name in PRESETS.get(steps, ()) if isinstance(steps, str) else steps:
        if name not in STEPS:
            raise ValueError(f"no step {name}; there are {', '.join(STEPS)}")
        run.written.clear()
        STEPS[name](run, cfg)
        if run.written:
            one = stats.step_metrics(**{t: run.table(t) for t in run.written}).select(F.lit(name).alias("step"), "*")
            one = run.spark.createDataFrame(one.collect(), one.schema)  # a row for each table, before later steps replace it
            metrics = one if metrics is None else metrics.unionByName(one)
    if metrics is not None:
        run.write("metrics", metrics)
    return run
