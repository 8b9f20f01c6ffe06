"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from ..operators import mixture
from . import adapters as A
from .adapters import ACTS_SQL, EMB_SQL, FILTERED_SQL, LOOSE_SQL, NEIGHBORS_SQL, TOKENS_SQL, pairs_sql, stats_sql

STATS = "mean_activation, max_activation, p50_activation, p95_activation, p99_activation, token_frequency, text_frequency"
PROFILE = "pc_mass_observed, pc_observed_mass, pc_mass_unobserved_tail, pc_unobserved_mass, effective_pc_dim, pc_entropy, pc_center_of_mass, pc_mass_top_1, pc_norm_mass_top_1, pc_mass_top_5, pc_norm_mass_top_5, pc_mass_top_20, pc_norm_mass_top_20"
PAIRS = "jaccard, pmi, p_j_given_i, p_i_given_j"


def r6(doubles: str) -> str:
    return ", ".join(f"round({c.strip()}, 6) AS {c.strip()}" for c in doubles.split(","))


def context_sql(rows: str, meta: str, window: int) -> str:
    """CTEs: rows with context by list index."""
    return f"""lists AS (SELECT text_id, list(token_str ORDER BY token_pos, token_str) AS t FROM {meta} WHERE text_id IN (SELECT text_id FROM {rows}) GROUP BY 1),
ctx AS (SELECT {rows}.*, coalesce(array_to_string(t[greatest(0, token_pos - {window}) + 1 : token_pos], ''), '') AS left_context, coalesce(t[token_pos + 1], token_str) AS center_token,
  coalesce(array_to_string(t[token_pos + 2 : token_pos + 1 + {window}], ''), '') AS right_context FROM {rows} LEFT JOIN lists USING (text_id))"""


INSPECT = r"""info AS (SELECT count(*) >= 3 AND max(n) / sum(n) <= 0.85 AS source_is_informative FROM (SELECT count(*)::DOUBLE AS n FROM filt GROUP BY source)),
uniq AS (SELECT token_str, regexp_replace(token_str, '^[\s\x0B\x1c-\x1f\x{85}\p{Z}]+|[\s\x0B\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') IN """ + A.QUOTE_SQL + r""" AS q,
  regexp_matches(token_str, '^[^\p{L}\p{N}]+$') AS p, regexp_matches(token_str, '^[\s\x0B\x1c-\x1f\x{85}\p{Z}]*$') AS s FROM (SELECT DISTINCT token_str FROM filt)),
b AS (SELECT feature_id, count(*) AS n_activations_inspected, avg(q::INT) AS quote_share, avg(p::INT) AS punctuation_share, avg(s::INT) AS space_share, avg((token_pos >= 240)::INT) AS boundary_share,
  quantile_cont(activation, 0.99) AS p99 FROM filt JOIN uniq USING (token_str) GROUP BY 1),
m AS (SELECT * FROM b JOIN (SELECT feature_id, max(n)::DOUBLE AS t FROM (SELECT feature_id, count(*) AS n FROM filt GROUP BY feature_id, token_str) GROUP BY 1) USING (feature_id)
  JOIN (SELECT feature_id, max(n)::DOUBLE AS o FROM (SELECT feature_id, count(*) AS n FROM filt GROUP BY feature_id, source) GROUP BY 1) USING (feature_id)
  JOIN (SELECT feature_id, max(n)::DOUBLE AS x FROM (SELECT feature_id, count(*) AS n FROM filt GROUP BY feature_id, token_pos) GROUP BY 1) USING (feature_id), info),
c AS (SELECT *, t / n_activations_inspected AS token_concentration, o / n_activations_inspected AS raw_source_concentration, CASE WHEN source_is_informative THEN o / n_activations_inspected ELSE 0 END AS source_concentration, x / n_activations_inspected AS position_concentration FROM m),
a AS (SELECT *, 0.24::DOUBLE * quote_share + 0.20::DOUBLE * punctuation_share + 0.12::DOUBLE * space_share + 0.20::DOUBLE * boundary_share + 0.18::DOUBLE * token_concentration + 0.04::DOUBLE * source_concentration + 0.02::DOUBLE * position_concentration AS artifact_score FROM c),
sem AS (SELECT *, greatest(0.0::DOUBLE, 0.40::DOUBLE * (1 - least(1.0::DOUBLE, artifact_score)) + 0.35::DOUBLE * (1 - greatest(token_concentration, position_concentration)) + 0.25::DOUBLE * (1 - least(1.0::DOUBLE, punctuation_share + quote_share + space_share))) AS semantic_score FROM a),
looks AS (SELECT *, list_filter([CASE WHEN quote_share >= 0.25 THEN 'quote_like' END, CASE WHEN punctuation_share >= 0.5 THEN 'punctuation_like' END, CASE WHEN space_share >= 0.25 THEN 'space_like' END,
    CASE WHEN boundary_share >= 0.3 THEN 'boundary_heavy' END, CASE WHEN token_concentration >= 0.5 THEN 'token_concentrated' END, CASE WHEN source_is_informative AND source_concentration >= 0.7 THEN 'source_concentrated' END,
    CASE WHEN position_concentration >= 0.4 THEN 'position_concentrated' END, CASE WHEN artifact_score >= 0.35 THEN 'likely_artifact' END,
    CASE WHEN artifact_score < 0.1 AND semantic_score >= 0.95 AND n_activations_inspected >= 100 AND token_concentration < 0.2 AND position_concentration < 0.25 AND punctuation_share < 0.2 AND quote_share < 0.05 AND space_share < 0.1 AND boundary_share < 0.15 THEN 'manual_review' END], lambda z: z IS NOT NULL) AS labels,
  CASE WHEN artifact_score >= 0.35 THEN 'low' WHEN p99 >= 500 AND artifact_score < 0.25 THEN 'high' WHEN semantic_score >= 0.95 AND n_activations_inspected >= 100 AND artifact_score < 0.1 THEN 'high'
       WHEN semantic_score >= 0.85 AND n_activations_inspected >= 50 AND artifact_score < 0.18 THEN 'medium' ELSE 'unreviewed' END AS manual_priority FROM sem)"""
INSPECTED = "quote_share, punctuation_share, space_share, boundary_share, token_concentration, source_concentration, raw_source_concentration, position_concentration, artifact_score, semantic_score"


def counts_sql(rows: str, by: str, name: str, each: str = "n") -> str:
    """A CTE with the ten most frequent keys of ``rows`` (by, key, n) as a JSON object; counts are written as ``each``."""
    return f"""{name} AS (SELECT {by}, '{{' || string_agg(to_json(key::VARCHAR)::VARCHAR || ': ' || {each}, ', ' ORDER BY n DESC, key) || '}}' AS {name}_json
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, key) AS r FROM {rows}) WHERE r <= 10 GROUP BY {by})"""


def top_sql(col: str, name: str) -> str:
    return counts_sql(f"(SELECT feature_id, {col} AS key, count(*) AS n FROM filt GROUP BY ALL)", "feature_id", name)


TOPS = ", ".join(top_sql(*x) for x in (("token_str", "top_tokens"), ("token_pos", "top_positions"), ("source", "top_sources")))


def nulls_sql(name: str, cols: str) -> str:
    parts = " || ',' || ".join(f"""'"{c}":' || count(*) FILTER ({c} IS NULL)""" for c in cols.split())
    return f"SELECT '{name}' AS artifact, true AS present, count(*) AS n_rows, {len(cols.split())}::BIGINT AS n_columns, '{{' || {parts} || '}}' AS n_nulls FROM {name}"


def labels_sql(table: str) -> str:
    """CTEs that label a table of cards; columns that evidence lacks must be there as 0."""
    return f"""cut AS (SELECT greatest(0.03::DOUBLE, quantile_cont(token_frequency, 0.9)) AS f, quantile_cont(token_frequency, 0.2) FILTER (token_frequency > 0) AS r, quantile_cont(p99_activation, 0.9) AS p,
  quantile_cont(cosine, 0.9) FILTER (cosine > 0) AS c, quantile_cont(jac, 0.9) FILTER (jac > 0) AS j FROM {table}),
l0 AS (SELECT t.*, coalesce(token_frequency > 0 AND token_frequency <= r, false) AS rare, p99_activation >= p AS hot, coalesce(artifact_score >= 0.35, false) AS art,
  coalesce(artifact_score < 0.1 AND semantic_score >= 0.95 AND n_token_activations >= 100, false) AS rev, f, c, j FROM {table} t, cut),
l1 AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(labels, lambda z: z NOT IN ('semantic_candidate', 'source_concentrated', 'manual_review')),
  list_filter([CASE WHEN art THEN 'likely_artifact' END, CASE WHEN token_frequency >= f THEN 'high_frequency' END, CASE WHEN rare THEN 'rare_feature' END, CASE WHEN hot THEN 'high_intensity' END, CASE WHEN rare AND hot THEN 'rare_high_intensity' END,
    CASE WHEN cosine >= c THEN 'decoder_geometry_dense' END, CASE WHEN jac >= j THEN 'coactivation_hub' END, CASE WHEN rev AND NOT art THEN 'manual_review' END], lambda z: z IS NOT NULL)))) AS ls FROM l0),
l2 AS (SELECT *, coalesce(list_filter(['likely_artifact', 'rare_high_intensity', 'coactivation_hub', 'decoder_geometry_dense', 'bimodal_candidate', 'high_intensity', 'high_frequency', 'manual_review', 'rare_feature'], lambda z: list_contains(ls, z))[1], 'unlabeled') AS primary_label FROM l1),
labeled AS (SELECT * EXCLUDE (manual_priority), array_to_string(ls, ',') AS inspection_labels, CASE WHEN art THEN 'low' WHEN primary_label = 'manual_review' THEN 'medium' ELSE manual_priority END AS manual_priority FROM l2)"""


ALIGN = """und AS (SELECT feature_i AS f, feature_j AS g, jaccard, pmi, coactivation_count FROM pairs UNION ALL SELECT feature_j, feature_i, jaccard, pmi, coactivation_count FROM pairs),
ct AS (SELECT f, g, row_number() OVER (PARTITION BY f ORDER BY jaccard DESC, pmi DESC, coactivation_count DESC, g) AS rank FROM und),
al AS (SELECT i.feature_id, (SELECT count(*) FROM nb WHERE feature_i = i.feature_id) AS n_geometry_neighbors, (SELECT count(*) FROM ct WHERE f = i.feature_id AND rank <= 20) AS n_coactivation_neighbors,
  (SELECT count(*) FROM nb JOIN ct ON f = feature_i AND g = feature_j WHERE feature_i = i.feature_id AND nb.rank <= 5 AND ct.rank <= 5) / 5.0::DOUBLE AS gca_at_5,
  (SELECT count(*) FROM nb JOIN ct ON f = feature_i AND g = feature_j WHERE feature_i = i.feature_id AND nb.rank <= 10 AND ct.rank <= 10) / 10.0::DOUBLE AS gca_at_10,
  (SELECT count(*) FROM nb JOIN ct ON f = feature_i AND g = feature_j WHERE feature_i = i.feature_id AND nb.rank <= 20 AND ct.rank <= 20) / 20.0::DOUBLE AS gca_at_20 FROM ids i),
aligned AS (SELECT *, CASE WHEN n_geometry_neighbors = 0 AND n_coactivation_neighbors = 0 THEN 'no_neighbors_observed' WHEN n_coactivation_neighbors = 0 THEN 'geometry_only' WHEN n_geometry_neighbors = 0 THEN 'coactivation_only'
  WHEN gca_at_10 >= 0.3 THEN 'strong_geometry_coactivation_agreement' WHEN gca_at_10 > 0 THEN 'weak_geometry_coactivation_agreement' ELSE 'geometry_coactivation_disagreement' END AS graph_alignment_bucket FROM al)"""
ALL_IDS = "ids AS (SELECT feature_i AS feature_id FROM nb UNION SELECT f FROM und)"
_align = ALIGN.replace("ct AS (SELECT f, g", ALL_IDS + ",\nct AS (SELECT f, g", 1)
_evidence = f"WITH {LOOSE_SQL}, {stats_sql()}"
_pairs = f"WITH {FILTERED_SQL}, {stats_sql()}, {pairs_sql()}"
_loose_pairs = f"WITH {LOOSE_SQL}, every AS (SELECT DISTINCT feature_id FROM filt), {pairs_sql(ids='every')}"
PAIRED = """sh AS (SELECT a.feature_id AS feature_i, b.feature_id AS feature_j, a.text_id, a.token_pos, a.token_str FROM filt a JOIN filt b ON a.text_id = b.text_id AND a.token_pos = b.token_pos AND a.feature_id < b.feature_id),
sw AS (SELECT feature_i, feature_j, token_str AS key, count(*) AS n FROM sh GROUP BY ALL),
sc AS (SELECT feature_i, feature_j, sum(n)::BIGINT AS shared, max(n)::DOUBLE / sum(n) AS shared_token_concentration FROM sw GROUP BY 1, 2),
pr AS (SELECT pairs.*, shared, shared_token_concentration, greatest(i.artifact_score, j.artifact_score) AS pair_artifact_score, greatest(i.artifact_score, j.artifact_score, shared_token_concentration) AS pair_suspicion_score, list_concat(i.labels, j.labels) AS ls
  FROM pairs JOIN sc USING (feature_i, feature_j) JOIN looks i ON i.feature_id = feature_i JOIN looks j ON j.feature_id = feature_j)"""
_top = "top AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, text_id, token_pos))::INT AS rank FROM filt) WHERE rank <= {})"
_gvc = """g AS (SELECT nb.*, coalesce(jaccard, 0) AS jaccard, coalesce(pmi, 0) AS pmi, coalesce(coactivation_count, 0) AS coactivation_count FROM nb LEFT JOIN pairs USING (feature_i, feature_j))"""
_basket = """WITH basket AS (SELECT l_orderkey AS text_id, 0 AS token_pos, l_partkey AS feature_id, l_extendedprice AS activation, l_returnflag AS source FROM lineitem),
tot AS (SELECT count(DISTINCT text_id)::DOUBLE AS n FROM basket),
kept AS (SELECT feature_id FROM basket, tot GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT text_id) >= 10 AND count(*) / any_value(n) <= 0.2), """ + pairs_sql("basket")
_nb_kept = NEIGHBORS_SQL.replace("ON a.vec_id <> b.vec_id)", "ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT feature_id FROM kept))")

#: Coverage of unit directions u(feature_id, e) by the components pca(k, pc, ratio), 20 of them.
COVERED = """mk AS (SELECT feature_id, list(list_dot_product(e, pc) ** 2 ORDER BY k) AS m FROM u, pca GROUP BY feature_id), ob AS (SELECT *, list_sum(m) AS observed FROM mk),
pr AS (SELECT *, list_transform(m, lambda x: x / greatest(observed, 1e-8::DOUBLE)) AS p FROM ob),
cv AS (SELECT feature_id, observed AS pc_mass_observed, observed AS pc_observed_mass, greatest(0::DOUBLE, 1 - observed) AS pc_mass_unobserved_tail, greatest(0::DOUBLE, 1 - observed) AS pc_unobserved_mass, 1 / list_sum(list_transform(p, lambda x: x * x)) AS effective_pc_dim,
  list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: -x * ln(x))) AS pc_entropy, list_sum(list_transform(p, lambda x, i: x * i)) AS pc_center_of_mass, m[1] AS pc_mass_top_1, p[1] AS pc_norm_mass_top_1, list_sum(m[1:5]) AS pc_mass_top_5, list_sum(p[1:5]) AS pc_norm_mass_top_5, list_sum(m) AS pc_mass_top_20, list_sum(p) AS pc_norm_mass_top_20 FROM pr),
covered AS (SELECT *, CASE WHEN pc_mass_observed < 0.05 THEN 'mostly_outside_observed_pca' WHEN pc_norm_mass_top_1 >= 0.5 THEN 'single_head_pc_aligned' WHEN pc_norm_mass_top_5 >= 0.65 AND effective_pc_dim <= 6 THEN 'compact_high_variance_aligned' WHEN pc_center_of_mass <= 5 THEN 'broad_high_variance_aligned'
  WHEN pc_center_of_mass >= 13 THEN 'mid_tail_variance_aligned' WHEN effective_pc_dim >= 10 THEN 'distributed_across_components' ELSE 'mid_variance_aligned' END AS coverage_bucket FROM cv)"""
UNIT = "u AS (SELECT vec_id AS feature_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8::DOUBLE)) AS e FROM embeddings)"
RAW = "raw AS (SELECT embedding::DOUBLE[] AS v FROM embeddings)"


def projected(rows: str, name: str) -> str:
    """A CTE with the first two coordinates of unit vectors, centred."""
    at = ", ".join(f"list_dot_product(e, (SELECT pc FROM {name} WHERE k = {k})) - list_dot_product(m, (SELECT pc FROM {name} WHERE k = {k})) AS decoder_pc{k}" for k in (1, 2))
    return f"xy AS (SELECT feature_id, {at} FROM {rows}, {name}_mean)"


_peaks = ", ".join(f"round({c}, 4) AS {c}" for c in ("activation", "log_activation", "bimodality_score", "peak_log_mean_low", "peak_log_mean_high"))
_around = lambda test: f"coalesce((SELECT string_agg(token_str, '' ORDER BY m.token_pos) FROM mt m WHERE m.text_id = pk.text_id AND {test}), '')"
_run = f"{_pairs}, {_nb_kept}, ids AS (SELECT feature_id FROM kept), {ALIGN}"

SQL = {
    "token_quality_labels": f"WITH {TOKENS_SQL} SELECT token_str, n, {A.QUALITY_SQL} AS token_quality_label, ({A.QUALITY_SQL}) <> 'clean' AS token_quality_is_artifact FROM (SELECT token_str, count(*) AS n, {A.surface_sql('token_str')} AS sf FROM tok GROUP BY token_str)",
    "row_filter": f"WITH {FILTERED_SQL} SELECT source, feature_id, count(*) AS n, round(sum(activation), 4) AS total FROM filt GROUP BY 1, 2",
    "feature_stats": f"WITH {FILTERED_SQL}, {stats_sql()} SELECT feature_id, n_token_activations, n_texts, {r6(STATS)} FROM stats",
    "feature_filter": f"WITH {FILTERED_SQL}, {stats_sql()} SELECT feature_id, n_token_activations, n_texts FROM kept",
    "semi_and_missing": f"WITH {EMB_SQL}, top8 AS (SELECT *, row_number() OVER (PARTITION BY text_id, token_pos ORDER BY activation DESC, feature_id) AS r FROM ev0), t AS (SELECT feature_id, count(*) AS n FROM top8 WHERE r <= 8 AND activation > 0 GROUP BY 1) SELECT vec_id AS feature_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' ELSE 'present' END AS status FROM embeddings LEFT JOIN t ON feature_id = vec_id",
    "feature_lookup": f"WITH {FILTERED_SQL} SELECT feature_id, activation, text_id, token_pos, token_str FROM filt WHERE feature_id = 7 ORDER BY activation DESC, text_id, token_pos LIMIT 50",
    "text_sources": "SELECT coalesce(lang, 'unknown') AS source, count(*) AS texts, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS text_share FROM documents GROUP BY 1",
    "token_sources": f"WITH {TOKENS_SQL} SELECT source, count(DISTINCT text_id) AS texts, count(*) AS tokens, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS token_share FROM tok GROUP BY 1",
    "top_examples": f"WITH {FILTERED_SQL}, top AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, text_id, token_pos))::INT AS rank FROM filt) WHERE rank <= 20), {context_sql('top', 'tok', 20)} SELECT feature_id, rank, activation, text_id, source, token_pos, token_str, left_context, center_token, right_context FROM ctx",
    "position_context": f"""WITH {EMB_SQL}, top AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, text_id, token_pos))::INT AS rank FROM pos) WHERE rank <= 5),
        mt AS (SELECT DISTINCT text_id, token_pos, token_str FROM ev0)
        SELECT feature_id, rank, text_id, token_pos, coalesce((SELECT string_agg(token_str, '' ORDER BY m.token_pos) FROM mt m WHERE m.text_id = top.text_id AND m.token_pos >= top.token_pos - 3 AND m.token_pos < top.token_pos), '') AS left_context,
          coalesce((SELECT min(token_str) FROM mt m WHERE m.text_id = top.text_id AND m.token_pos = top.token_pos), '') AS center_token,
          coalesce((SELECT string_agg(token_str, '' ORDER BY m.token_pos) FROM mt m WHERE m.text_id = top.text_id AND m.token_pos > top.token_pos AND m.token_pos <= top.token_pos + 3), '') AS right_context FROM top""",
    "describe_activation": f"WITH {ACTS_SQL} SELECT count(activation) AS count, round(avg(activation), 6) AS mean, round(stddev_samp(activation), 6) AS std, round(min(activation), 6) AS min, round(quantile_cont(activation, 0.25), 6) AS p25, round(quantile_cont(activation, 0.5), 6) AS p50, round(quantile_cont(activation, 0.75), 6) AS p75, round(max(activation), 6) AS max FROM acts WHERE feature_id = 7",
    "step_metrics": f"WITH {FILTERED_SQL} SELECT 'all' AS \"table\", count(*) AS n_rows, count(DISTINCT feature_id) AS n_features FROM acts UNION ALL SELECT 'filtered', count(*), count(DISTINCT feature_id) FROM filt",
    "sparsify_topk": f"WITH {EMB_SQL} SELECT text_id, source, token_pos, token_str, feature_id, round(activation, 6) AS activation FROM (SELECT *, row_number() OVER (PARTITION BY text_id, token_pos ORDER BY activation DESC, feature_id) AS r FROM ev0) WHERE r <= 8 AND activation > 0",
    "sparsify_topk_rows": f"WITH {ACTS_SQL} SELECT feature_id, count(*) AS n, round(sum(activation), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY text_id, token_pos ORDER BY activation DESC, feature_id) AS r FROM acts) WHERE r <= 2 GROUP BY 1",
    "sparsify_positive": f"WITH {EMB_SQL} SELECT text_id, source, token_pos, token_str, feature_id, round(activation, 6) AS activation FROM pos",
    "token_summary": f"WITH {EMB_SQL} SELECT text_id, source, token_pos, token_str, sum((activation > 0)::INT)::BIGINT AS n_positive_features FROM ev0 GROUP BY ALL",
    "stride_sample": f"WITH {TOKENS_SQL} SELECT text_id, token_pos, token_str FROM tok WHERE token_pos % 8 = 0",
    "finite_texts": "SELECT vec_id // 10 AS text_id, count(*) AS n FROM embeddings GROUP BY 1 HAVING min(embedding[1]) >= -0.2",
    "encoded_vectors": "SELECT vec_id // 10 AS text_id, label::VARCHAR AS source, vec_id % 10 AS token_pos, 'v' || label AS token_str, k AS feature_id, round(embedding[k + 1]::DOUBLE + embedding[k + 17]::DOUBLE - 0.05, 5) AS activation FROM embeddings, range(16) r(k) WHERE embedding[k + 1]::DOUBLE + embedding[k + 17]::DOUBLE - 0.05::DOUBLE > 0",
    "encoded_topk": """WITH e AS (SELECT a.vec_id, a.label, b.vec_id AS f, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) - 0.05::DOUBLE AS s FROM embeddings a, embeddings b),
        p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, f) AS r, count(*) OVER (PARTITION BY vec_id) AS n FROM e WHERE s > 0 AND s > (f % 3) / 10.0::DOUBLE)
        SELECT vec_id // 10 AS text_id, label::VARCHAR AS source, vec_id % 10 AS token_pos, 'v' || label AS token_str, f AS feature_id, round(s, 5) AS activation, n AS n_positive_features FROM p WHERE r <= 3""",
    "collect_metrics": f"WITH {ACTS_SQL} SELECT (SELECT count(DISTINCT text_id) FROM tok) AS n_texts, (SELECT count(*) FROM (SELECT DISTINCT text_id, token_pos FROM tok)) AS n_tokens, (SELECT count(*) FROM acts) AS n_activation_rows, (SELECT count(DISTINCT feature_id) FROM acts) AS n_features",
    "coactivation": f"{_pairs} SELECT feature_i, feature_j, coactivation_count, feature_i_count, feature_j_count, {r6(PAIRS)} FROM pairs",
    "coactivation_basket": f"{_basket} SELECT feature_i, feature_j, coactivation_count, feature_i_count, feature_j_count, {r6(PAIRS)} FROM pairs",
    "undirected_edges": f"{_pairs} SELECT f AS feature_id, count(*) AS degree, round(max(jaccard), 6) AS max_jaccard, round(max(pmi), 6) AS max_pmi FROM (SELECT feature_i AS f, jaccard, pmi FROM pairs UNION ALL SELECT feature_j, jaccard, pmi FROM pairs) GROUP BY 1",
    "pair_lookup": f"{_pairs} SELECT feature_i, feature_j, coactivation_count, feature_i_count, feature_j_count, {r6(PAIRS)} FROM pairs WHERE (feature_i, feature_j) IN ((7, 20), (20, 7))",
    "decoder_neighbors": f"WITH {NEIGHBORS_SQL} SELECT feature_i, feature_j, rank::INT AS rank, round(decoder_cosine, 6) AS decoder_cosine FROM nb",
    "geometry_vs_coactivation": f"{_pairs}, {NEIGHBORS_SQL}, g AS (SELECT nb.*, coalesce(jaccard, 0) AS jaccard FROM nb LEFT JOIN pairs USING (feature_i, feature_j)), q AS (SELECT quantile_cont(decoder_cosine, 0.9) AS a, coalesce(quantile_cont(jaccard, 0.9) FILTER (jaccard > 0), 'inf'::DOUBLE) AS b FROM g) SELECT feature_i, feature_j, rank::INT AS rank, round(decoder_cosine, 6) AS decoder_cosine, round(jaccard, 6) AS jaccard, CASE WHEN decoder_cosine >= a THEN 'high' ELSE 'low' END || '_cosine_' || CASE WHEN jaccard > 0 AND jaccard >= b THEN 'high' ELSE 'low' END || '_coactivation' AS quadrant, round(a, 6) AS decoder_cosine_threshold, round(b, 6) AS coactivation_jaccard_threshold FROM g, q",
    "graph_alignment": f"{_pairs}, {NEIGHBORS_SQL}, {_align} SELECT feature_id, n_geometry_neighbors, n_coactivation_neighbors, {r6('gca_at_5, gca_at_10, gca_at_20')}, graph_alignment_bucket FROM aligned",
    "alignment_summary": f"{_pairs}, {NEIGHBORS_SQL}, {_align} SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(avg((v > 0)::INT), 6) AS nonzero_share, NULL::VARCHAR AS bucket, NULL::BIGINT AS count, NULL::DOUBLE AS share FROM (UNPIVOT (SELECT gca_at_5, gca_at_10, gca_at_20 FROM aligned) ON COLUMNS(*) INTO NAME metric VALUE v) GROUP BY 1 UNION ALL SELECT 'bucket_count', NULL, NULL, NULL, NULL, graph_alignment_bucket, count(*), round(count(*)::DOUBLE / (SELECT count(*) FROM aligned), 6) FROM aligned GROUP BY graph_alignment_bucket",
    "feature_inspection": f"WITH {LOOSE_SQL}, {INSPECT}, {TOPS} SELECT feature_id, n_activations_inspected, source_is_informative, manual_priority, array_to_string(labels, ',') AS inspection_labels, top_tokens_json, top_positions_json, top_sources_json, {r6(INSPECTED)} FROM looks JOIN top_tokens USING (feature_id) JOIN top_positions USING (feature_id) JOIN top_sources USING (feature_id)",
    "pair_inspection": f"""{_loose_pairs}, {INSPECT}, {PAIRED}, {counts_sql("sw", "feature_i, feature_j", "shared_top_tokens", "(2 * n)")}
        SELECT feature_i, feature_j, shared AS shared_activation_count_estimate, coactivation_count, shared_top_tokens_json, {r6('pair_artifact_score, pair_suspicion_score, shared_token_concentration, jaccard, pmi')}, CASE WHEN pair_suspicion_score >= 0.5 THEN 'low' ELSE 'medium' END AS manual_priority,
          array_to_string(list_filter([CASE WHEN pair_suspicion_score >= 0.5 THEN 'likely_artifact_pair' END, CASE WHEN list_contains(ls, 'quote_like') THEN 'quote_related_pair' END, CASE WHEN list_contains(ls, 'boundary_heavy') THEN 'boundary_related_pair' END, CASE WHEN pair_suspicion_score < 0.35 AND shared > 0 THEN 'manual_priority_pair' END], lambda z: z IS NOT NULL), ',') AS inspection_labels FROM pr JOIN shared_top_tokens USING (feature_i, feature_j)""",
    "activation_bands": f"""WITH {ACTS_SQL}, md AS (SELECT feature_id, quantile_cont(activation, 0.5) AS m FROM acts GROUP BY 1),
        bands AS (SELECT acts.*, row_number() OVER (PARTITION BY feature_id ORDER BY activation, text_id, token_pos) AS lo, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, text_id, token_pos) AS hi, row_number() OVER (PARTITION BY feature_id ORDER BY round(abs(activation - m), 9), text_id, token_pos) AS mid FROM acts JOIN md USING (feature_id)),
        top AS (SELECT *, 'low' AS band, lo AS rank FROM bands WHERE lo <= 5 UNION ALL SELECT *, 'median', mid FROM bands WHERE mid <= 5 UNION ALL SELECT *, 'high', hi FROM bands WHERE hi <= 5), {context_sql('top', 'tok', 20)}
        SELECT feature_id, band, rank::INT AS rank, round(activation, 6) AS activation, text_id, source, token_pos, token_str, left_context, center_token, right_context FROM ctx""",
    "feature_labels": f"{_evidence}, {INSPECT}, cards AS (SELECT kept.*, labels, manual_priority, artifact_score, semantic_score, 0.0::DOUBLE AS cosine, 0.0::DOUBLE AS jac FROM kept JOIN looks USING (feature_id)), {labels_sql('cards')} SELECT feature_id, inspection_labels, primary_label, manual_priority FROM labeled",
    "feature_cards": f"""{_evidence}, {INSPECT}, {pairs_sql()}, {_nb_kept}, ids AS (SELECT feature_id FROM kept), {ALIGN},
        best AS (SELECT f AS feature_id, max(jaccard) AS max_coactivation_jaccard, max(pmi) AS max_coactivation_pmi FROM und GROUP BY 1), near AS (SELECT feature_i AS feature_id, max(decoder_cosine) AS max_decoder_cosine FROM nb GROUP BY 1),
        cards AS (SELECT kept.*, labels, manual_priority, artifact_score, semantic_score, coalesce(max_decoder_cosine, 0) AS cosine, coalesce(max_coactivation_jaccard, 0) AS jac, max_decoder_cosine, max_coactivation_jaccard, max_coactivation_pmi, gca_at_5, gca_at_10, gca_at_20, graph_alignment_bucket
                  FROM kept JOIN looks USING (feature_id) LEFT JOIN best USING (feature_id) LEFT JOIN near USING (feature_id) LEFT JOIN aligned USING (feature_id)), {labels_sql('cards')}
        SELECT feature_id, primary_label, manual_priority, inspection_labels, n_token_activations, n_texts, graph_alignment_bucket, {r6('artifact_score, semantic_score, token_frequency, p99_activation, max_decoder_cosine, max_coactivation_jaccard, max_coactivation_pmi, gca_at_5, gca_at_10, gca_at_20')} FROM labeled""",
    "projection_metadata": f"{_evidence}, {INSPECT}, cards AS (SELECT stats.*, labels, manual_priority, artifact_score, semantic_score, 0.0::DOUBLE AS cosine, 0.0::DOUBLE AS jac FROM stats JOIN looks USING (feature_id)), {labels_sql('cards')} SELECT feature_id, primary_label, inspection_labels, round(artifact_score, 6) AS artifact_score FROM labeled",
    "histogram": f"WITH {ACTS_SQL}, e AS (SELECT min(activation) AS lo, max(activation) AS hi FROM acts), h AS (SELECT least(49, floor((activation - lo) / (hi - lo) * 50))::INT AS bin, count(*) AS n FROM acts, e GROUP BY 1) SELECT b::INT AS bin, round(lo + b * ((hi - lo) / 50), 6) AS bin_start, round(lo + (b + 1) * ((hi - lo) / 50), 6) AS bin_end, coalesce(n, 0) AS count FROM e, range(50) r(b) LEFT JOIN h ON bin = b",
    "value_counts": f"WITH {TOKENS_SQL} SELECT {A.QUALITY_SQL} AS value, sum(n)::BIGINT AS count FROM (SELECT token_str, count(*) AS n, {A.surface_sql('token_str')} AS sf FROM tok GROUP BY token_str) GROUP BY 1",
    "table_preview": f"WITH {FILTERED_SQL}, {stats_sql()} SELECT feature_id, n_token_activations, n_texts, {r6(STATS)} FROM stats ORDER BY n_token_activations DESC, feature_id LIMIT 40",
    "scatter_points": f"WITH {FILTERED_SQL}, {stats_sql()} SELECT {r6('token_frequency, p99_activation, text_frequency')} FROM stats",
    "ranked_artifacts": f"WITH {LOOSE_SQL}, {INSPECT} SELECT feature_id, round(artifact_score, 6) AS artifact_score, array_to_string(labels, ',') AS inspection_labels FROM looks ORDER BY looks.artifact_score DESC, feature_id LIMIT 20",
    "clean_texts": f"SELECT doc_id, length(t)::INT AS n, md5(t) AS digest FROM (SELECT doc_id, {A.strip_sql(chr(10).join(['replace(replace(replace(replace(replace(text', ', ' + chr(39) + 'â€™' + chr(39) + ', chr(39))', ', ' + chr(39) + 'â€œ' + chr(39) + ', chr(34))', ', ' + chr(39) + 'â€' + chr(39) + ' || chr(157), chr(34))', ', ' + chr(39) + 'â€“' + chr(39) + ', chr(45))', ', ' + chr(39) + 'â€”' + chr(39) + ', chr(45))']))} AS t FROM documents)",
    "mixed_corpus": f"""WITH c AS (SELECT doc_id, lang, {A.strip_sql('text')} AS text FROM documents),
        s(slice, lang, least, quota) AS (VALUES (0, 'en', 300, 100), (1, 'fr', 200, 100), (2, 'de', 300, 80), (3, 'es', 300, 60), (4, 'fr', 300, 20), (5, 'de', 300, 20)),
        p AS (SELECT slice, doc_id, c.lang, text, quota, row_number() OVER (PARTITION BY slice ORDER BY doc_id) AS nth FROM s JOIN c ON c.lang = s.lang AND length(text) >= least),
        m AS (SELECT * FROM p WHERE nth <= quota),
        f AS (SELECT 6 AS slice, doc_id, lang, text, 0 AS quota, row_number() OVER (ORDER BY doc_id) AS nth FROM c WHERE lang = 'en' AND length(text) >= 300)
        SELECT slice, nth, doc_id, 'mix-' || lang AS source, md5(text) AS digest FROM (SELECT * FROM m UNION ALL SELECT * FROM f WHERE nth <= 400 - (SELECT count(*) FROM m)) ORDER BY slice, nth LIMIT 400""",
    "jsonl_first_rows": f"SELECT source, md5(t) AS digest FROM (SELECT CASE WHEN doc_id % 5 > 0 AND source IS NOT NULL THEN source ELSE 'custom-jsonl' END AS source, CASE WHEN doc_id % 7 <> 3 THEN {A.strip_sql('text')} END AS t FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 130)) WHERE length(t) > 0",
    "text_dataset": "SELECT source, count(*) AS n, min(text_id) AS first_id FROM (SELECT source, row_number() OVER (ORDER BY doc_id) - 1 AS text_id FROM documents UNION ALL SELECT s, (SELECT count(*) FROM documents) + i FROM (VALUES ('manual_code', 0), ('manual_science', 1), ('manual_finance', 2), ('manual_health', 3), ('manual_assistant', 4), ('manual_math', 5), ('manual_security', 6), ('manual_literature', 7)) v(s, i)) GROUP BY 1",
    "profile": " UNION ALL ".join([nulls_sql("documents", "doc_id text lang source n_chars"), nulls_sql("embeddings", "vec_id embedding label"), nulls_sql("labels", "doc_id quality toxic"), nulls_sql("pages", "page_id url html"), "SELECT 'absent', false, 0, 0, '{}'"]),
    "row_filter_options": f"""WITH {FILTERED_SQL} SELECT source, 'text_id,source,token_pos,token_str,feature_id,activation' AS columns, count(*) AS n, max(token_pos) AS last, min(activation) AS least FROM filt
        WHERE source IN ({", ".join(f"'src{i}'" for i in range(12))}) AND source NOT IN ('src3', 'src5') AND token_pos < 200 AND activation >= 2 GROUP BY source""",
    "card_examples": f"WITH {FILTERED_SQL}, {stats_sql()}, {_top.format(5)}, {context_sql('top', 'tok', 20)} SELECT feature_id, 'documents' AS run_name, rank - 1 AS nth, rank, activation, source, text_id, token_pos, left_context, center_token, right_context FROM ctx WHERE feature_id IN (SELECT feature_id FROM kept)",
    "merged_evidence": f"WITH {FILTERED_SQL}, {stats_sql()} SELECT feature_id, CASE WHEN feature_id < 30 THEN n_texts * 2 END AS old, n_token_activations AS kept, NULL::INT AS fresh FROM stats",
    "card_lists": f"{_evidence}, {pairs_sql()}, {_nb_kept}, {_align} SELECT feature_i AS feature_id, 'decoder' AS kind, (rank - 1)::INT AS nth, feature_j AS other, round(decoder_cosine, 6) AS score FROM nb WHERE rank <= 10 UNION ALL SELECT f, 'coactivation', (rank - 1)::INT, g, round(jaccard, 6) FROM ct JOIN und USING (f, g) WHERE rank <= 10",
    "pair_report": f"""{_pairs}, {NEIGHBORS_SQL}, {_gvc}, {_top.format(10)}, {context_sql('top', 'tok', 20)}, none AS (SELECT NULL::BIGINT AS b, NULL::DOUBLE AS d, NULL::VARCHAR AS v, NULL::INT AS i),
        one AS (SELECT * FROM g WHERE (feature_i, feature_j) IN ((7, 20), (20, 7)) ORDER BY feature_i <> 7 LIMIT 1), two AS (SELECT * FROM pairs WHERE (feature_i, feature_j) IN ((7, 20), (20, 7)))
        SELECT 'geometry' AS section, feature_i, feature_j, coactivation_count, round(jaccard, 6) AS jaccard, round(pmi, 6) AS pmi, b AS feature_id, rank::INT AS rank, d AS activation, b AS text_id, b AS token_pos, v AS left_context, v AS center_token, v AS right_context FROM one, none
        UNION ALL SELECT 'coactivation', feature_i, feature_j, coactivation_count, round(jaccard, 6), round(pmi, 6), b, i, d, b, b, v, v, v FROM two, none
        UNION ALL SELECT CASE WHEN feature_id = 7 THEN 'feature_i' ELSE 'feature_j' END, b, b, b, d, d, feature_id, rank, activation, text_id, token_pos, left_context, center_token, right_context FROM ctx, none WHERE feature_id IN (7, 20)""",
    "single_component": f"""WITH {EMB_SQL}, s AS (SELECT feature_id, count(*) AS n_points, avg(ln(1 + activation)) AS m, avg(ln(1 + activation) ** 2) AS q, min(activation) AS activation_min, quantile_cont(activation, 0.5) AS activation_p50, quantile_cont(activation, 0.95) AS activation_p95, max(activation) AS activation_max FROM pos GROUP BY 1),
        v AS (SELECT *, greatest(0::DOUBLE, q - m * m) + {mixture.FLOOR!r}::DOUBLE AS v FROM s WHERE n_points >= 100)
        SELECT feature_id, n_points, round(n_points * (ln(2 * pi()) + ln(v) + (v - {mixture.FLOOR!r}::DOUBLE) / v) + 2 * ln(n_points), 4) AS bic_1, {", ".join(f"round({c}, 4) AS {c}" for c in ("activation_min", "activation_p50", "activation_p95", "activation_max"))} FROM v""",
    "bimodality": f"WITH RECURSIVE {A.MIXTURE_SQL} SELECT feature_id, n_points, {', '.join(f'round({c}, 4) AS {c}' for c in ('bic_1', 'bic_2', 'bimodality_score', 'log_mean_low', 'log_mean_high', 'activation_min', 'activation_p50', 'activation_p95', 'activation_max'))} FROM bim",
    "bimodal_set": f"WITH RECURSIVE {A.MIXTURE_SQL} SELECT feature_id, round(bimodality_score, 4) AS bimodality_score, round(log_mean_low, 4) AS log_mean_low, round(log_mean_high, 4) AS log_mean_high FROM bim ORDER BY bim.bimodality_score DESC, feature_id LIMIT 30",
    "peak_examples": f"""WITH RECURSIVE {A.MIXTURE_SQL}, mt AS (SELECT DISTINCT text_id, token_pos, token_str FROM ev0)
        SELECT feature_id, peak_label, text_id, token_pos, source, {_around("m.token_pos >= pk.token_pos - 20 AND m.token_pos < pk.token_pos")} AS left_context, {_around("m.token_pos = pk.token_pos")} AS center_token, {_around("m.token_pos > pk.token_pos AND m.token_pos <= pk.token_pos + 20")} AS right_context, {_peaks}
        FROM (SELECT *, x AS log_activation FROM pk) pk""",
    "pca_summary": f"WITH RECURSIVE {RAW}, {A.pca_sql('raw', 20, 'pca')} SELECT k AS component, round(ratio, 6) AS explained_variance_ratio, round(sum(ratio) OVER (ORDER BY k), 6) AS cumulative_explained_variance_ratio FROM pca",
    "variance_bars": f"WITH RECURSIVE {UNIT}, uv AS (SELECT e AS v FROM u), {A.pca_sql('uv', 5, 'pca')} SELECT k AS component, round(ratio, 6) AS explained_variance_ratio FROM pca",
    "decoder_pca": f"WITH RECURSIVE {UNIT}, uv AS (SELECT e AS v FROM u), {A.pca_sql('uv', 2, 'pca')}, {projected('u', 'pca')} SELECT feature_id, round(decoder_pc1, 5) AS decoder_pc1, round(decoder_pc2, 5) AS decoder_pc2 FROM xy",
    "coverage_profiles": f"""WITH RECURSIVE {UNIT}, {RAW}, {A.pca_sql('raw', 20, 'pca')}, {COVERED}, ex AS (SELECT sum(ratio) FILTER (k <= 1) AS a, sum(ratio) FILTER (k <= 5) AS b, sum(ratio) AS c FROM pca)
        SELECT feature_id, 20::BIGINT AS pc_components_observed, round(a, 5) AS pc_explained_variance_top_1, round(b, 5) AS pc_explained_variance_top_5, round(c, 5) AS pc_explained_variance_observed, {r6(PROFILE).replace(', 6)', ', 5)')}, coverage_bucket FROM covered, ex""",
    "card_evidence": f"""WITH RECURSIVE {A.MIXTURE_SQL}, top8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id, token_pos ORDER BY activation DESC, feature_id) AS r8 FROM ev0) WHERE r8 <= 8 AND activation > 0),
        {stats_sql('top8', 'ev0')}, {pairs_sql('top8')}, {_nb_kept}, ids AS (SELECT feature_id FROM kept), {ALIGN}, {UNIT}, uk AS (SELECT * FROM u WHERE feature_id IN (SELECT feature_id FROM kept)), uv AS (SELECT e AS v FROM uk), {A.pca_sql('uv', 2, 'two_pc')}, {projected('uk', 'two_pc')}, {RAW}, {A.pca_sql('raw', 20, 'pca')}, {COVERED}
        SELECT feature_id, n_points, round(bimodality_score, 4) AS bimodality_score, round(log_mean_low, 4) AS log_mean_low, round(log_mean_high, 4) AS log_mean_high, round(decoder_pc1, 4) AS decoder_pc1, round(decoder_pc2, 4) AS decoder_pc2, round(pc_mass_observed, 4) AS pc_mass_observed, round(effective_pc_dim, 4) AS effective_pc_dim, coverage_bucket,
          n_geometry_neighbors, n_coactivation_neighbors, round(gca_at_10, 4) AS gca_at_10, graph_alignment_bucket FROM kept LEFT JOIN bim USING (feature_id) LEFT JOIN xy USING (feature_id) LEFT JOIN covered USING (feature_id) LEFT JOIN aligned USING (feature_id)""",
    "inspection_rows": f"""{_loose_pairs}, {INSPECT}, {PAIRED} SELECT 'documents' AS run_name, 'feature' AS kind, feature_id AS feature_i, NULL::BIGINT AS feature_j, n_activations_inspected AS n, round(artifact_score, 6) AS score FROM looks
        UNION ALL SELECT 'documents', 'pair', feature_i, feature_j, shared, round(pair_artifact_score, 6) FROM pr""",
    "run_metrics": f"""{_run}, met(step, "table", n_rows, n_features) AS (
        SELECT 'features', 'filtered_activations', count(*), count(DISTINCT feature_id) FROM filt UNION ALL SELECT 'features', 'feature_stats', count(*), count(*) FROM stats UNION ALL SELECT 'features', 'filtered_features', count(*), count(*) FROM kept
        UNION ALL SELECT 'features', 'top_feature_examples', sum(least(20, n_token_activations))::BIGINT, count(*) FROM stats UNION ALL SELECT 'features', 'feature_cards', count(*), count(*) FROM kept UNION ALL SELECT 'coactivation', 'coactivation_pairs', count(*), NULL FROM pairs
        UNION ALL SELECT 'geometry', 'decoder_neighbors', count(*), NULL FROM nb UNION ALL SELECT 'geometry-vs-coactivation', 'geometry_vs_coactivation', count(*), NULL FROM nb UNION ALL SELECT 'alignment', 'feature_graph_alignment', count(*), count(*) FROM aligned
        UNION ALL SELECT 'alignment', 'graph_alignment_summary', 3 + count(DISTINCT graph_alignment_bucket), NULL FROM aligned UNION ALL SELECT 'cards', 'feature_cards', count(*), count(*) FROM kept) SELECT * FROM met""",
    "run_cards": f"""{_run}, best AS (SELECT f AS feature_id, max(jaccard) AS max_coactivation_jaccard FROM und GROUP BY 1), near AS (SELECT feature_i AS feature_id, max(decoder_cosine) AS max_decoder_cosine FROM nb GROUP BY 1)
        SELECT feature_id, 'run' AS run_name, n_token_activations, n_texts, {r6('max_decoder_cosine, max_coactivation_jaccard, gca_at_10')}, graph_alignment_bucket FROM kept LEFT JOIN best USING (feature_id) LEFT JOIN near USING (feature_id) LEFT JOIN aligned USING (feature_id)""",
    "axis_profiles": f"""WITH u AS (SELECT vec_id AS feature_id, embedding::DOUBLE[] AS e, greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-8::DOUBLE) AS z FROM embeddings),
        m AS (SELECT feature_id, list_transform(e[1:20], lambda x: (x / z) * (x / z)) AS m FROM u), o AS (SELECT *, list_sum(m) AS observed FROM m), p AS (SELECT *, list_transform(m, lambda x: x / greatest(observed, 1e-8::DOUBLE)) AS p FROM o),
        c AS (SELECT feature_id, observed AS pc_mass_observed, observed AS pc_observed_mass, greatest(0::DOUBLE, 1 - observed) AS pc_mass_unobserved_tail, greatest(0::DOUBLE, 1 - observed) AS pc_unobserved_mass, 1 / list_sum(list_transform(p, lambda x: x * x)) AS effective_pc_dim,
          list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: -x * ln(x))) AS pc_entropy, list_sum(list_transform(p, lambda x, i: x * i)) AS pc_center_of_mass, m[1] AS pc_mass_top_1, p[1] AS pc_norm_mass_top_1, list_sum(m[1:5]) AS pc_mass_top_5, list_sum(p[1:5]) AS pc_norm_mass_top_5, list_sum(m) AS pc_mass_top_20, list_sum(p) AS pc_norm_mass_top_20 FROM p)
        SELECT feature_id, 20::BIGINT AS pc_components_observed, round(1 / 64::DOUBLE, 6) AS pc_explained_variance_top_1, round(5 / 64::DOUBLE, 6) AS pc_explained_variance_top_5, round(20 / 64::DOUBLE, 6) AS pc_explained_variance_observed, {r6(PROFILE)},
          CASE WHEN pc_mass_observed < 0.05 THEN 'mostly_outside_observed_pca' WHEN pc_norm_mass_top_1 >= 0.5 THEN 'single_head_pc_aligned' WHEN pc_norm_mass_top_5 >= 0.65 AND effective_pc_dim <= 6 THEN 'compact_high_variance_aligned' WHEN pc_center_of_mass <= 5 THEN 'broad_high_variance_aligned'
            WHEN pc_center_of_mass >= 13 THEN 'mid_tail_variance_aligned' WHEN effective_pc_dim >= 10 THEN 'distributed_across_components' ELSE 'mid_variance_aligned' END AS coverage_bucket FROM c""",
    "preview": f"WITH {FILTERED_SQL}, {stats_sql()} SELECT feature_id::VARCHAR AS feature_id, n_texts::VARCHAR AS n_texts, format('{{:.4g}}', mean_activation) AS mean_activation FROM stats ORDER BY n_token_activations DESC, stats.feature_id LIMIT 100",
    "report_sets": f"""{_loose_pairs}, {INSPECT}, {PAIRED},
        s1 AS (SELECT * FROM looks ORDER BY artifact_score DESC, feature_id LIMIT 20), s2 AS (SELECT * FROM looks WHERE list_contains(labels, 'manual_review') ORDER BY semantic_score DESC, feature_id LIMIT 20),
        s3 AS (SELECT * FROM pr ORDER BY pair_suspicion_score DESC, feature_i, feature_j LIMIT 20), s4 AS (SELECT * FROM looks ORDER BY semantic_score DESC, feature_id LIMIT 30)
        SELECT 'artifacts' AS set, feature_id AS feature_i, feature_id AS feature_j, round(artifact_score, 6) AS score FROM s1 UNION ALL SELECT 'manual_review', feature_id, feature_id, round(semantic_score, 6) FROM s2
        UNION ALL SELECT 'pairs', feature_i, feature_j, round(pair_suspicion_score, 6) FROM s3 UNION ALL SELECT 'bimodal', feature_id, feature_id, round(semantic_score, 6) FROM s4""",
    "preset_mix": f"""WITH c AS (SELECT doc_id, lang, {A.strip_sql('text')} AS text FROM documents), s(slice, lang, quota) AS (VALUES (0, 'fr', 140), (1, 'en', 100), (2, 'de', 80), (3, 'es', 40), (4, 'fr', 40)),
        p AS (SELECT slice, doc_id, c.lang, text, quota, row_number() OVER (PARTITION BY slice ORDER BY doc_id) AS nth FROM s JOIN c ON c.lang = s.lang AND length(text) >= 300), m AS (SELECT * FROM p WHERE nth <= quota),
        f AS (SELECT 5 AS slice, doc_id, lang, text, 0 AS quota, row_number() OVER (ORDER BY doc_id) AS nth FROM c WHERE lang = 'en' AND length(text) >= 300)
        SELECT slice, nth, doc_id, 'mix-' || lang AS source, md5(text) AS digest FROM (SELECT * FROM m UNION ALL SELECT * FROM f WHERE nth <= 400 - (SELECT count(*) FROM m)) ORDER BY slice, nth LIMIT 400""",
    "jsonl_round_trip": f"SELECT coalesce(source, 'custom-jsonl') AS source, count(*) AS n, sum(length(t))::BIGINT AS chars, min(md5(t)) AS first_digest FROM (SELECT source, {A.strip_sql('text')} AS t FROM documents) WHERE length(t) > 0 GROUP BY 1",
}
