"""Operators on hand-made tables: each of the semantic traps has a case."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import alignment, cards, cooccurrence, coverage, filters, geometry, inspection, labels, mixture, report, stats
from sparkloom.plans.pipeline import PRESETS, run_pipeline
from sparkloom.sources import corpus
from sparkloom.sources.artifacts import Run, write_table

ACTS = "feature_id long, text_id long, token_pos long, source string, token_str string, activation double"


def acts_of(spark, rows):
    return spark.createDataFrame([(f, t, p, "s", tok, float(a)) for f, t, p, tok, a in rows], ACTS)


def test_stats_percentiles_interpolate(spark):
    acts = acts_of(spark, [(1, 0, i, "a", i + 1) for i in range(4)])
    r = stats.feature_stats(acts, acts).first()
    assert r["p95_activation"] == pytest.approx(3.85) and r["p50_activation"] == 2.5 and r["token_frequency"] == 1.0


def test_stats_no_token_left(spark):
    acts = acts_of(spark, [(1, 0, 0, "a", 1)])
    with pytest.raises(ValueError):
        stats.feature_stats(acts, acts.where("text_id = 9"))


def test_nan_is_missing(spark):
    acts = acts_of(spark, [(1, 0, 0, "a", 1), (1, 0, 1, "a", float("nan")), (1, 0, 2, "a", 3)])
    r = stats.feature_stats(acts, acts).first()
    assert (r["max_activation"], r["mean_activation"], r["n_token_activations"]) == (3.0, 2.0, 3)


def test_pairs_count_rows_and_distinct(spark):
    # a repeated row counts in the features' counts, not in the pairs'
    acts = acts_of(spark, [(1, 0, 0, "a", 1), (1, 0, 0, "a", 1), (2, 0, 0, "a", 1), (2, 0, 1, "b", 1)])
    r = cooccurrence.same_token_pairs(acts, acts).first()
    assert (r["feature_i"], r["feature_j"], r["coactivation_count"], r["feature_i_count"], r["feature_j_count"]) == (1, 2, 1, 2, 2)
    assert r["jaccard"] == pytest.approx(1 / 3) and r["pmi"] == pytest.approx(math.log(0.5 / (1 * 1))) and r["p_j_given_i"] == 0.5


def test_pairs_do_not_depend_on_partitions(spark):
    acts = acts_of(spark, [(f, t, p, "a", 1) for t in range(5) for p in range(4) for f in range(6) if (f + t + p) % 2])
    one = cooccurrence.same_token_pairs(acts.coalesce(1), acts).collect()
    assert one == cooccurrence.same_token_pairs(acts.repartition(8), acts).collect()


def test_pair_lookup_prefers_direct(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7)], "feature_i long, feature_j long, jaccard double")
    assert cooccurrence.pair_lookup(pairs, 2, 1).first()["jaccard"] == 0.7


def test_top_examples_context(spark):
    meta = acts_of(spark, [(0, 0, p, c, 0) for p, c in enumerate("abcde")])
    acts = acts_of(spark, [(1, 0, 2, "c", 5), (1, 0, 4, "e", 5), (1, 9, 0, "zz", 1)])
    got = stats.top_examples(acts, meta, 3, 2).orderBy("rank").collect()
    assert [(r["left_context"], r["center_token"], r["right_context"]) for r in got] == [("ab", "c", "de"), ("cd", "e", ""), ("", "zz", "")]


def test_context_by_position_differs_with_gaps(spark):
    meta = acts_of(spark, [(0, 0, p, c, 0) for p, c in ((0, "a"), (5, "b"), (6, "c"))])
    rows = acts_of(spark, [(1, 0, 6, "c", 1), (1, 7, 0, "x", 1)])
    got = stats.context_by_position(rows, meta, 2).collect()
    assert [(r["left_context"], r["center_token"], r["right_context"]) for r in got] == [("b", "c", "")]


def test_neighbors_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=(40, 6)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "feature_id long, vector array<float>")
    got = geometry.decoder_neighbors(v, top_k=3, block=7).orderBy("feature_i", "rank").collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert [r["feature_j"] for r in got] == np.argsort(-s, axis=1)[:, :3].ravel().tolist()
    # fewer other rows than k: the row itself is never returned
    assert geometry.decoder_neighbors(v.limit(2), top_k=5).count() == 2


def test_quadrants_are_directed(spark):
    nb = spark.createDataFrame([(1, 2, 1, 0.9), (2, 1, 1, 0.9)], "feature_i long, feature_j long, rank int, decoder_cosine double")
    pairs = spark.createDataFrame([(1, 2, 3, 5, 5, 0.4, 1.0, 0.6, 0.6)], "feature_i long, feature_j long, coactivation_count long, feature_i_count long, feature_j_count long, jaccard double, pmi double, p_j_given_i double, p_i_given_j double")
    got = {r["feature_i"]: r["quadrant"] for r in geometry.geometry_vs_coactivation(nb, pairs).collect()}
    assert got == {1: "high_cosine_high_coactivation", 2: "high_cosine_low_coactivation"}
    both = geometry.geometry_vs_coactivation(nb, pairs, symmetric=True).collect()
    assert {r["quadrant"] for r in both} == {"high_cosine_high_coactivation"}
    none = geometry.geometry_vs_coactivation(nb, pairs.limit(0)).collect()
    assert {r["jaccard"] for r in none} == {0.0} and none[0]["coactivation_jaccard_threshold"] == math.inf


def test_alignment_divides_by_k(spark):
    nb = spark.createDataFrame([(1, 2, 1, 0.9)], "feature_i long, feature_j long, rank int, decoder_cosine double")
    pairs = spark.createDataFrame([(1, 2, 0.4, 1.0, 3)], "feature_i long, feature_j long, jaccard double, pmi double, coactivation_count long")
    got = {r["feature_id"]: r for r in alignment.graph_alignment(nb, pairs, spark.createDataFrame([(1,), (3,)], "feature_id long")).collect()}
    assert got[1]["gca_at_5"] == 0.2 and got[1]["graph_alignment_bucket"] == "weak_geometry_coactivation_agreement" and got[3]["graph_alignment_bucket"] == "no_neighbors_observed"


def test_planted_modes(spark):
    rng = np.random.default_rng(3)
    two = np.expm1(np.concatenate([rng.normal(1, 0.1, 300), rng.normal(3, 0.1, 200)]))
    one = np.expm1(rng.normal(2, 0.2, 400))
    rows = [(1, i, 0, "a", v) for i, v in enumerate(two)] + [(2, i, 0, "a", v) for i, v in enumerate(one)] + [(3, 0, 0, "a", 1.0)]
    acts = acts_of(spark, rows)
    got = mixture.bimodality_candidates(acts, 100).collect()
    assert [r["feature_id"] for r in got] == [1, 2] and got[0]["bimodality_score"] > 500 > got[1]["bimodality_score"]
    assert got[0]["log_mean_low"] == pytest.approx(1, abs=0.05) and got[0]["log_mean_high"] == pytest.approx(3, abs=0.05)
    x = np.log1p(two)
    ll = -0.5 * (np.log(2 * np.pi) + np.log(x.var() + 1e-6) + x.var() / (x.var() + 1e-6))
    assert got[0]["bic_1"] == pytest.approx(-2 * len(x) * ll + 2 * np.log(len(x)), rel=1e-6)
    points = mixture.log_points(acts.where("feature_id < 3"))
    a = {r["feature_id"]: r for r in mixture.fit_two_components(points).collect()}
    b = {r["feature_id"]: r for r in mixture.fit_by_sums(points).collect()}
    for f in (1, 2):
        assert [a[f][c] for c in ("m0", "m1", "loglik")] == pytest.approx([b[f][c] for c in ("m0", "m1", "loglik")], abs=1e-6)
    peaks = mixture.peak_examples(acts, acts, mixture.bimodality_candidates(acts, 100), 1, 3)
    assert {(r["peak_label"], round(r["log_activation"])) for r in peaks.collect()} == {("low", 1), ("high", 3)}


def test_pca_and_coverage(spark):
    x = np.random.default_rng(2).normal(size=(60, 5)) * [5, 3, 1, 1, 0.5]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "feature_id long, vector array<double>")
    ratio = [r["explained_variance_ratio"] for r in coverage.pca_summary(v, 3).collect()]
    ev = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert ratio == pytest.approx((ev / ev.sum())[:3].tolist())
    got = coverage.coverage_profiles(v, v, 20).collect()
    for r in got:
        assert r["pc_components_observed"] == 5 and r["pc_mass_observed"] == pytest.approx(1) and r["pc_norm_mass_top_20"] == pytest.approx(1) and 1 <= r["effective_pc_dim"] <= 5
    _, coords = coverage.decoder_pca(v)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.mean([r["decoder_pc1"] for r in coords.collect()]) == pytest.approx(0, abs=1e-9)
    assert np.var([r["decoder_pc1"] for r in coords.collect()], ddof=1) == pytest.approx(np.linalg.eigvalsh(np.cov(u.T))[-1])
    assert coverage.pca_summary(v.limit(1)).count() == 0 and "coverage_bucket" in coverage.coverage_profiles(v, v.limit(0)).columns


def test_inspection_missing_and_labels(spark):
    acts = acts_of(spark, [(1, t, 250, "'", 600) for t in range(5)])
    s = inspection.summarize_features(acts, spark.createDataFrame([(1,), (2,)], "feature_id long"))
    got = {r["feature_id"]: r for r in inspection.feature_summaries_frame(s).collect()}
    assert got[1]["inspection_labels"] == "quote_like,punctuation_like,boundary_heavy,token_concentrated,position_concentrated,likely_artifact" and got[1]["manual_priority"] == "low"
    assert got[1]["top_tokens_json"] == "{\"'\": 5}" and got[1]["artifact_score"] == pytest.approx(0.24 + 0.2 + 0.2 + 0.18 + 0.02)
    assert got[2]["artifact_score"] is None and got[2]["manual_priority"] == "unreviewed" and got[2]["n_activations_inspected"] == 0


def test_pair_rows_count_from_both_sides(spark):
    acts = acts_of(spark, [(1, 0, 0, "a", 1), (1, 0, 0, "a", 1), (2, 0, 0, "b", 1), (2, 0, 1, "b", 1)])
    pairs = spark.createDataFrame([(1, 2)], "feature_i long, feature_j long")
    r = inspection.summarize_pairs(acts, pairs, inspection.summarize_features(acts)).first()
    assert r["shared_activation_count_estimate"] == 1 and r["shared_token_concentration"] == pytest.approx(2 / 3)


def test_labels_are_idempotent_and_strict(spark):
    rows = [(i, 100 + i, i / 100, float(i), 0.05 if i else None, 0.97, "semantic_candidate,manual_review" if i % 2 else "", None) for i in range(20)]
    c = spark.createDataFrame(rows, "feature_id long, n_token_activations long, token_frequency double, p99_activation double, artifact_score double, semantic_score double, inspection_labels string, manual_priority string")
    once = labels.assign_feature_labels(c).orderBy("feature_id").collect()
    twice = labels.assign_feature_labels(labels.assign_feature_labels(c)).orderBy("feature_id").collect()
    assert once == twice and all("semantic_candidate" not in r["inspection_labels"] for r in once)
    assert "manual_review" not in once[0]["inspection_labels"] and "manual_review" in once[5]["inspection_labels"]


def test_merge_replace_twice_is_once(spark):
    left = spark.createDataFrame([(1, 5.0), (2, 6.0)], "feature_id long, x double")
    right = spark.createDataFrame([(1, 9.0), (1, 9.5)], "feature_id long, x double")
    one = cards.merge_replace(left, right, "feature_id", ["x"])
    assert [tuple(r) for r in cards.merge_replace(one, right, "feature_id", ["x"]).orderBy("feature_id").collect()] == [(1, 9.0), (2, None)]
    assert cards.merge_replace(left, None, "feature_id", ["x"]) is left


def test_bands(spark):
    acts = acts_of(spark, [(1, i, 0, "a", i) for i in range(1, 8)])
    got = {}
    for r in inspection.activation_bands(acts, acts, 2).orderBy("rank").collect():
        got.setdefault(r["band"], []).append(r["activation"])
    assert got == {"low": [1, 2], "median": [4, 3], "high": [7, 6]}


def test_report(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "v double")
    h = report.histogram(df, "v", 2).collect()
    assert [(r["bin_start"], r["bin_end"], r["count"]) for r in h] == [(1.0, 2.0, 1), (2.0, 3.0, 2)]
    assert report.histogram(df.limit(1), "v", 2).collect()[0]["bin_start"] == 0.5
    assert [tuple(r) for r in report.value_counts(df.where("v > 1 or v is null"), "v").collect()][-1][0] is None


def test_preview_cells(spark):
    df = spark.createDataFrame([(0.5, "a|b\nc"), (123456.0, "x" * 121), (None, None), (float("nan"), "x" * 120), (10.0, ""), (1e-7, "")], "v double, t string")
    got = [tuple(r) for r in report.preview(df, ["v", "none", "t"], 6).collect()]
    assert got == [("0.5", "a\\|b c"), ("1.235e+05", "x" * 117 + "..."), ("", ""), ("", "x" * 120), ("10", ""), ("1e-07", "")]


def test_labels_add_no_other_columns(spark):
    got = labels.assign_feature_labels(spark.createDataFrame([(1, 0.5)], "feature_id long, artifact_score double"))
    assert set(got.columns) == {"feature_id", "artifact_score", "inspection_labels", "primary_label", "manual_priority"}


def test_pair_report(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5)], "feature_i long, feature_j long, jaccard double")
    ex = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")], "feature_id long, rank int, center_token string")
    got = [(r["section"], r["jaccard"], r["center_token"]) for r in cooccurrence.pair_report(pairs, ex, 2, 1, 1).collect()]
    assert sorted(got) == [("coactivation", 0.5, None), ("feature_i", None, "c"), ("feature_j", None, "a")]


def test_collect_encodes_samples_and_counts(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}/run")
    rows = [(0, "s", p, f"t{p}", [float(p), 1.0]) for p in range(5)] + [(1, "s", 0, "x", [float("nan"), 1.0])]
    write_table(spark.createDataFrame(rows, "text_id long, source string, token_pos long, token_str string, vector array<double>"), run.at("token_vectors"))
    from sparkloom.config import Analysis, RunConfig

    w = np.array([[1.0, -1.0, 2.0], [0.0, 0.5, 0.0]])
    for mode, want in (("topk", {(p, 2) for p in range(1, 5)} | {(0, 1)}), ("positive", {(p, f) for p in range(1, 5) for f in (0, 2)} | {(0, 1)})):
        cfg = RunConfig(encoder=(w, np.zeros(3)), analysis=Analysis(residual_stride=2), run_info=(("activation_mode", mode), ("top_k", 1)))
        run_pipeline(run, "core", cfg)
        assert {(r["token_pos"], r["feature_id"]) for r in run.table(f"sae_activations_{mode}").collect()} == want
    assert [r["n_positive_features"] for r in run.token_activation_summary().orderBy("token_pos").collect()] == [1, 2, 2, 2, 2]
    assert sorted(r["token_pos"] for r in run.residual_vectors().collect()) == [0, 2, 4]
    m = {r["table"]: (r["step"], r["n_rows"], r["n_features"]) for r in run.table("metrics").collect()}
    assert m["sae_activations_positive"] == ("collect", 9, 3) and m["residual_vectors"] == ("collect", 3, None)
    with pytest.raises(ValueError):
        run_pipeline(run, "core", RunConfig(run_info=(("activation_mode", "some"),)))


def test_mix_tops_up_from_the_beginning(spark):
    a = spark.createDataFrame([(i, "a", f"a{i}") for i in range(3)], "id long, source string, text string")
    b = spark.createDataFrame([(i + 10, "b", f"b{i}") for i in range(1)], "id long, source string, text string")
    got = [r["text"] for r in corpus.mix_corpora([(a, 50), (b, 50)], 6, a).collect()]
    assert got == ["a0", "a1", "a2", "b0", "a0", "a1"]
    assert corpus.quotas((25, 25, 20, 15, 5, 5), 10, (4, 5)) == [2, 2, 2, 1, 1, 1]


def test_texts_and_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": " a "}\n\n{"text": "", "source": "s"}\n{"text": "b", "source": "s"}\n', encoding="utf-8")
    got = corpus.read_jsonl_corpus(spark, str(tmp_path / "x.jsonl"), 2).collect()
    assert [tuple(r) for r in got] == [("custom-jsonl", "a")]  # the first two rows, one of them empty
    t = corpus.build_text_dataset(corpus.read_jsonl_corpus(spark, str(tmp_path / "x.jsonl")), 9)
    assert t.count() == 9 and t.agg(F.max("text_id")).first()[0] == 8
    corpus.write_texts(t, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/texts").count() == 9


def test_artifacts_and_pipeline(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}/run")
    assert run.feature_stats().count() == 0 and "n_texts" in run.feature_stats().columns
    rng = np.random.default_rng(0)
    tokens = [(t, "s", p, 0, f" w{(t + p) % 7}") for t in range(30) for p in range(8)]
    write_table(spark.createDataFrame(tokens, "text_id long, source string, token_pos long, token_id long, token_str string"), run.at("token_metadata"))
    dense = [(t, "s", p, tok, np.abs(rng.normal(size=12)).tolist()) for t, s, p, _, tok in tokens]
    write_table(spark.createDataFrame(dense, "text_id long, source string, token_pos long, token_str string, vector array<double>"), run.at("dense_activations"))
    vec = [(i, rng.normal(size=6).tolist()) for i in range(12)]
    write_table(spark.createDataFrame(vec, "feature_id long, vector array<double>"), run.at("directions"))
    write_table(spark.createDataFrame(vec, "feature_id long, vector array<double>").withColumnRenamed("feature_id", "text_id"), run.at("residual_vectors"))
    from sparkloom.config import Analysis, FeatureFilter, RunConfig

    cfg = RunConfig(features=FeatureFilter(5, 2, 1.0), analysis=Analysis(bimodality_min_points=20), run_info=(("activation_mode", "topk"), ("top_k", 4)))
    run_pipeline(run, "research", cfg)
    first = run.feature_cards().orderBy("feature_id").collect()
    run_pipeline(run, ("cards",), cfg)  # reads and replaces the same table
    assert run.feature_cards().orderBy("feature_id").collect() == first and len(first) == 12 and first[0]["top_examples_json"].startswith("[{")
    assert run.has("report_table_feature_cards") and run.has("report_variance_residual") and run.has("report_histogram_n_positive_features")
    run_pipeline(run, ("cards", "report"), cfg)
    assert {r["step"] for r in run.table("metrics").collect()} == {"cards", "report"}
    assert set(PRESETS) == {"core", "atlas", "research"}
    with pytest.raises(ValueError):
        run_pipeline(run, ("nothing",))


def test_lookup_reaches_the_scan(spark, tmp_path):
    acts_of(spark, [(1, 0, 0, "a", 1), (2, 0, 0, "a", 2)]).write.parquet(f"file://{tmp_path}/a")
    q = filters.feature_lookup(spark.read.parquet(f"file://{tmp_path}/a"), 2, 5)
    assert "EqualTo(feature_id,2)" in q._jdf.queryExecution().toString() and q.count() == 1
