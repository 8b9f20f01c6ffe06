"""Global labels of feature cards, from thresholds over all cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import available, missing_or_empty, safe_numeric
from ..sources.artifacts import stored
from .quantiles import quantiles

# Labels from the most to the least telling.
PRIORITY = ("likely_artifact", "rare_high_intensity", "coactivation_hub", "decoder_geometry_dense", "bimodal_candidate", "high_intensity", "high_frequency", "manual_review", "rare_feature")
HIGH = ("rare_high_intensity", "bimodal_candidate", "coactivation_hub", "decoder_geometry_dense")
MEDIUM = ("manual_review", "high_frequency", "high_intensity", "rare_feature")


def ensure_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, default)


def split_labels(c: Column, is_array: bool = False) -> Column:
    """Labels of a comma-joined string, or an array of them, trimmed, without empty ones."""
    parts = c if is_array else F.split(c, ",")
    return F.array_distinct(F.filter(F.transform(F.coalesce(parts, F.expr("CAST(array() AS array<string>)")), lambda x: F.trim(x)), lambda x: x != ""))


def primary_label(labels: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(labels, p), F.lit(p)) for p in PRIORITY], F.lit("unlabeled"))


def thresholds(cards: DataFrame, **wanted: tuple[Column, float]) -> DataFrame:
    """One row with the quantile of each named column over all cards, null where it has no value."""
    long = cards.select(F.explode(F.array(*[F.struct(F.lit(name).alias("of"), c.alias("v")) for name, (c, _) in wanted.items()])).alias("e")).select("e.*")
    qs = tuple(sorted({q for _, q in wanted.values()}))
    at = lambda name, q: F.max(F.when(F.col("of") == name, F.get("_p", F.lit(qs.index(q))))).alias(name)
    return quantiles(long, "v", qs, ("of",), name="_p").agg(*[at(name, q) for name, (_, q) in wanted.items()])


def assign_feature_labels(cards: DataFrame) -> DataFrame:
    """Sets inspection_labels (sorted, comma-joined), primary_label and manual_priority. Thresholds are
    quantiles over all cards: one aggregated row, joined to each. Labels of older runs that only the
    inspection sets are dropped, manual_review is set anew by its strict rule; a priority is filled only
    where it is missing, then artifacts become low and manual_review medium. No other column is added."""
    given = cards.columns
    absent = [c for c in ("artifact_score", "token_frequency", "p99_activation", "n_token_activations", "bimodality_score", "max_decoder_cosine", "max_coactivation_jaccard", "semantic_score") if c not in given]
    cards = cards.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else cards
    cards = ensure_column(ensure_column(cards, "inspection_labels", F.lit("")), "manual_priority", F.lit(None).cast("string"))
    is_array = dict(cards.dtypes)["inspection_labels"].startswith("array")
    num = lambda c: safe_numeric(F.col(c))
    freq, p99, cos, jac, bim = num("token_frequency"), num("p99_activation"), num("max_decoder_cosine"), num("max_coactivation_jaccard"), num("bimodality_score")
    cards = stored(cards, "cards")
    positive = lambda c: F.when(c > 0, c)
    cuts = thresholds(cards, _freq=(freq, 0.90), _rare=(positive(freq), 0.20), _p99=(p99, 0.90), _bim=(positive(bim), 0.95), _cos=(positive(cos), 0.90), _jac=(positive(jac), 0.90))
    cuts = cuts.withColumns({"_freq": F.greatest(F.lit(0.03), F.coalesce("_freq", F.lit(0.03))), "_p99": F.coalesce("_p99", F.lit(float("inf"))), "_bim": F.greatest(F.lit(500.0), F.coalesce("_bim", F.lit(float("inf"))))})
    c = cards.crossJoin(F.broadcast(cuts))  # one row
    artifact = available(F.col("artifact_score")) & (num("artifact_score") >= 0.35)
    rare = F.coalesce((freq > 0) & (freq <= F.col("_rare")), F.lit(False))
    intense = p99 >= F.col("_p99")
    review = available(F.col("artifact_score")) & ~artifact & (num("n_token_activations") >= 100) & (num("artifact_score") < 0.10) & (num("semantic_score") >= 0.95)
    new = F.array(*[F.when(test, F.lit(name)) for test, name in (
        (artifact, "likely_artifact"), (freq >= F.col("_freq"), "high_frequency"), (rare, "rare_feature"), (intense, "high_intensity"), (rare & intense, "rare_high_intensity"),
        (bim >= F.col("_bim"), "bimodal_candidate"), (F.coalesce(cos >= F.col("_cos"), F.lit(False)), "decoder_geometry_dense"), (F.coalesce(jac >= F.col("_jac"), F.lit(False)), "coactivation_hub"), (review, "manual_review"),
    )])
    old = F.array_except(split_labels(F.col("inspection_labels"), is_array), F.array(F.lit("semantic_candidate"), F.lit("source_concentrated"), F.lit("manual_review")))
    c = c.withColumns({"_labels": F.array_sort(F.array_distinct(F.concat(old, F.filter(new, lambda x: x.isNotNull())))), "_artifact": artifact})
    c = c.withColumn("primary_label", primary_label(F.col("_labels")))
    first, blank = F.col("primary_label"), missing_or_empty(F.col("manual_priority"))
    fill = F.when(blank & F.col("_artifact"), "low").when(blank & first.isin(*HIGH), "high").when(blank & first.isin(*MEDIUM), "medium").when(blank & (first == "unlabeled"), "unreviewed").otherwise(F.col("manual_priority"))
    priority = F.when(F.col("_artifact"), "low").when(first == "manual_review", "medium").otherwise(F.coalesce(fill, F.lit("unreviewed")))
    return c.withColumns({"manual_priority": priority, "inspection_labels": F.array_join("_labels", ",")}).drop("_labels", "_artifact", "_freq", "_rare", "_p99", "_bim", "_cos", "_jac", *absent)
