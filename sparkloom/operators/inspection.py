"""Heuristic inspection of features and pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_ratio
from ..functions.text import is_space_like, looks_like_punctuation, looks_like_quote
from ..sources.artifacts import stored
from .cooccurrence import few_ids, index_pairs, token_pairs
from .filters import semi_filter
from .quantiles import quantiles
from .stats import first_texts, in_texts, top_rows, with_context

FEATURE_COLUMNS = ("feature_id", "n_activations_inspected", "quote_share", "punctuation_share", "space_share", "boundary_share", "token_concentration", "source_concentration", "raw_source_concentration", "source_is_informative", "position_concentration", "artifact_score", "semantic_score", "manual_priority", "inspection_labels", "top_tokens_json", "top_positions_json", "top_sources_json")
PAIR_COLUMNS = ("feature_i", "feature_j", "pair_artifact_score", "pair_suspicion_score", "shared_token_concentration", "manual_priority", "inspection_labels", "shared_activation_count_estimate", "jaccard", "pmi", "coactivation_count", "shared_top_tokens_json")


def source_is_informative(acts: DataFrame, min_sources: int = 3, max_top_share: float = 0.85) -> DataFrame:
    """One row, source_is_informative: enough sources, and none of them has nearly all rows."""
    return _informative(acts.groupBy(F.coalesce("source", F.lit("None")).alias("source")).agg(F.count("*").alias("n")), min_sources, max_top_share)


def _informative(sources: DataFrame, min_sources: int = 3, max_top_share: float = 0.85) -> DataFrame:
    return sources.agg(F.coalesce((F.count("*") >= min_sources) & (F.max("n") / F.sum("n") <= max_top_share), F.lit(False)).alias("source_is_informative"))


#: What the facts are counted by, and the bits by which Spark tells these grouping sets apart.
_SETS = {("tokens",): 7, ("positions",): 11, ("sources", "texts"): 12}


def _counts(rows: DataFrame) -> dict[str, DataFrame]:
    """(feature_id, key, count) of the facts by token, position, source and text: one scan, whose partial counts a task
    keeps for all; sources are those of the texts, added up. What follows reads the counts alone."""
    keys = [F.coalesce("token_str", F.lit("None")).alias("tokens"), F.coalesce(F.col("token_pos").cast("long"), F.lit(-1)).alias("positions"), F.coalesce("source", F.lit("None")).alias("sources"), F.col("text_id").alias("texts")]
    r = rows.select("feature_id", *keys)
    g = r.groupingSets([["feature_id", *k] for k in _SETS], "feature_id", *[c for k in _SETS for c in k]).agg(F.count("*").alias("count"), F.grouping_id().alias("set"))
    g = stored(g, "counts")
    of = {c: g.where(F.col("set") == bits).select("feature_id", F.col(c).alias("key"), "count") for k, bits in _SETS.items() for c in k}
    return of | {c: of[c].groupBy("feature_id", "key").agg(F.sum("count").alias("count")) for c in ("sources", "texts")}


def _modes(counts: DataFrame, n: int, name: str) -> DataFrame:
    """Per feature the count of the most frequent key and the ``n`` most frequent with their counts (ties: smaller key)."""
    w = Window.partitionBy("feature_id").orderBy(F.desc("count"), "key")
    top = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_r", "key", "count"))), lambda s: F.struct(s["key"].alias("key"), s["count"].alias("count")))
    return top.groupBy("feature_id").agg(F.max("count").alias(f"_{name}"), items.alias(f"top_{name}"))


def _middle(counts: DataFrame) -> DataFrame:
    """Per feature the median key; keys are positions, so a feature has no more than the longest text has tokens."""
    w = Window.partitionBy("feature_id")
    c = counts.withColumns({"_to": F.sum("count").over(w.orderBy("key")), "_h": (F.sum("count").over(w) - 1) / 2})
    hit = lambda r: (r >= F.col("_to") - F.col("count")) & (r < F.col("_to"))
    at = lambda f: F.max(F.when(hit(f("_h")), F.col("key")))
    return c.groupBy("feature_id").agg(((at(F.floor) + at(F.ceil)) / 2).alias("token_pos_median"))


def _labels(*tests: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in tests]), lambda x: x.isNotNull())


def summarize_features(acts: DataFrame, ids: DataFrame | None = None, examples: DataFrame | None = None, max_seq_len: int = 256, boundary_margin: int = 16) -> DataFrame:
    """Per feature: counts, shares of quote-like, punctuation-like, space-like and late tokens, concentration on one
    token, source and position, artifact and semantic score, labels, priority, top tokens, positions and
    sources (arrays of struct<key, count>), and, if given, the top 5 of ``examples``.
    Ids without rows have status missing and nulls."""
    rows = semi_filter(acts, ids) if ids is not None else acts
    counts = _counts(rows)
    if ids is None:
        informative = _informative(counts["sources"].groupBy(F.col("key").alias("source")).agg(F.sum("count").alias("n")))
    else:
        informative = source_is_informative(acts)
    token, pos, n = F.col("key"), F.col("key"), F.col("count")
    share = lambda c: F.sum(F.when(c, n).otherwise(0)) / F.sum(n)
    base = counts["tokens"].groupBy("feature_id").agg(
        F.sum(n).alias("n_activations"), share(looks_like_quote(token)).alias("quote_share"), share(looks_like_punctuation(token)).alias("punctuation_share"), share(is_space_like(token)).alias("space_share"))
    places = counts["positions"].groupBy("feature_id").agg(F.min(pos).alias("token_pos_min"), F.max(pos).alias("token_pos_max"), share(pos >= max_seq_len - boundary_margin).alias("boundary_share"))
    strong = quantiles(rows, "activation", (0.99,), ("feature_id",), name="_p").select("feature_id", F.get("_p", F.lit(0)).alias("_p99"))
    texts = counts["texts"].groupBy("feature_id").agg(F.count("key").alias("n_texts"))
    f = base.join(places, "feature_id").join(_middle(counts["positions"]), "feature_id").join(texts, "feature_id").join(strong, "feature_id", "left").withColumn("_p99", F.coalesce("_p99", F.lit(0.0)))
    for name in ("tokens", "positions", "sources"):
        f = f.join(_modes(counts[name], 10, name), "feature_id")
    f = f.crossJoin(F.broadcast(informative))  # one row
    f = f.withColumns({
        "token_concentration": safe_ratio(F.col("_tokens"), F.col("n_activations")),
        "raw_source_concentration": safe_ratio(F.col("_sources"), F.col("n_activations")),
        "position_concentration": safe_ratio(F.col("_positions"), F.col("n_activations")),
    })
    f = f.withColumn("source_concentration", F.when(F.col("source_is_informative"), F.col("raw_source_concentration")).otherwise(0.0))
    q, p, s, b, t, src, at = (F.col(c) for c in ("quote_share", "punctuation_share", "space_share", "boundary_share", "token_concentration", "source_concentration", "position_concentration"))
    f = f.withColumn("artifact_score", 0.24 * q + 0.20 * p + 0.12 * s + 0.20 * b + 0.18 * t + 0.04 * src + 0.02 * at)
    a = F.col("artifact_score")
    f = f.withColumn("semantic_score", F.greatest(F.lit(0.0), 0.40 * (1 - F.least(F.lit(1.0), a)) + 0.35 * (1 - F.greatest(t, at)) + 0.25 * (1 - F.least(F.lit(1.0), p + q + s))))
    sem, n = F.col("semantic_score"), F.col("n_activations")
    review = (a < 0.10) & (sem >= 0.95) & (n >= 100) & (t < 0.20) & (at < 0.25) & (p < 0.20) & (q < 0.05) & (s < 0.10) & (b < 0.15)
    f = f.withColumn("inspection_labels", _labels(
        (q >= 0.25, "quote_like"), (p >= 0.50, "punctuation_like"), (s >= 0.25, "space_like"), (b >= 0.30, "boundary_heavy"), (t >= 0.50, "token_concentrated"),
        (F.col("source_is_informative") & (src >= 0.70), "source_concentrated"), (at >= 0.40, "position_concentrated"), (a >= 0.35, "likely_artifact"), (review, "manual_review"),
    ))
    f = f.withColumn("manual_priority", F.when(a >= 0.35, "low").when((F.col("_p99") >= 500) & (a < 0.25), "high").when((sem >= 0.95) & (n >= 100) & (a < 0.10), "high").when((sem >= 0.85) & (n >= 50) & (a < 0.18), "medium").otherwise("unreviewed"))
    f = f.drop("_p99", "_tokens", "_positions", "_sources").withColumn("status", F.lit("present"))
    if examples is not None:
        cols = ["rank", "activation", "source", "text_id", "token_pos", "left_context", "center_token", "right_context"]
        f = f.join(top_list(examples, "feature_id", [F.desc_nulls_last("activation"), "rank"], 5, cols, "top_examples"), "feature_id", "left")
    if ids is not None:
        f = ids.select("feature_id").distinct().join(f, "feature_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return f


def top_list(df: DataFrame, key: str, order: list, n: int, cols: list[str], name: str) -> DataFrame:
    """(key, array of the first ``n`` rows of each key as structs of ``cols``)."""
    w = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    items = F.array_sort(F.collect_list(F.struct("_r", F.struct(*cols).alias("row"))))
    return top.groupBy(key).agg(F.transform(items, lambda s: s["row"]).alias(name))


def as_json(c) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def counts_json(c: str) -> Column:
    """An array of struct<key, count> as a JSON object in the array's order."""
    part = F.transform(F.col(c), lambda s: F.concat(F.regexp_extract(F.to_json(F.struct(s["key"].cast("string").alias("k"))), r"^\{\"k\":([\s\S]*)\}$", 1), F.lit(": "), s["count"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(part, ", "), F.lit("}"))


def feature_summaries_frame(summaries: DataFrame) -> DataFrame:
    """The flat 18-column form; missing features have null metrics and are unreviewed."""
    none = F.lit("{}")
    return summaries.select(
        "feature_id", F.coalesce("n_activations", F.lit(0)).cast("long").alias("n_activations_inspected"), "quote_share", "punctuation_share", "space_share", "boundary_share", "token_concentration", "source_concentration", "raw_source_concentration",
        F.coalesce("source_is_informative", F.lit(False)).alias("source_is_informative"), "position_concentration", "artifact_score", "semantic_score", F.coalesce("manual_priority", F.lit("unreviewed")).alias("manual_priority"),
        F.coalesce(F.array_join("inspection_labels", ","), F.lit("")).alias("inspection_labels"),
        F.coalesce(counts_json("top_tokens"), none).alias("top_tokens_json"), F.coalesce(counts_json("top_positions"), none).alias("top_positions_json"), F.coalesce(counts_json("top_sources"), none).alias("top_sources_json"),
    )


#: Requested pairs up to which they are sent to all tasks (16 bytes each).
_SENT_PAIRS = 1_000_000


def shared_tokens(acts: DataFrame, wanted: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """For each of the distinct pairs ``wanted`` (feature_i, feature_j), as a stored table (feature_i, feature_j, key, count): with
    key null, on how many tokens both have rows; else how many of the rows of either on these tokens have the string ``key``.

    Facts move once, to meet by token; a token looks up which pairs of its own features are wanted, so a row is made for
    a shared token only, and not for each pair that a feature is in. Counts are summed where they are made. More than
    _SENT_PAIRS pairs are looked up in lots of so many. ``lists`` (token_str, features) are tokens that aren't in ``acts``, as in
    same_token_pairs(); they don't move."""
    both = wanted.select("feature_i", "feature_j", F.least("feature_i", "feature_j").cast("long").alias("_lo"), F.greatest("feature_i", "feature_j").cast("long").alias("_hi"))
    wanted = stored(both.select(F.col("_lo").alias("feature_i"), F.col("_hi").alias("feature_j")).distinct(), "wanted")
    n = wanted.count()
    features = wanted.select(F.explode(F.array("feature_i", "feature_j")).alias("feature_id")).distinct()
    rows = semi_filter(acts, features).select("text_id", "token_pos", F.col("feature_id").cast("long").alias("feature_id"), F.coalesce("token_str", F.lit("None")).alias("token_str"))
    rows = rows.repartition("text_id", "token_pos").groupBy("text_id", "token_pos", "feature_id", "token_str").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("feature_id", "token_str", "n")))
    tokens = rows.groupBy("text_id", "token_pos").agg(entries.alias("e"))
    tokens = tokens.where(F.size("e") > 1).select("e.feature_id", "e.token_str", "e.n")
    lots = -(-n // _SENT_PAIRS)
    tokens = tokens if lots < 2 else stored(tokens, "tokens")
    parts = [_lookup(tokens, wanted if lots < 2 else wanted.where(F.pmod(F.xxhash64("feature_i", "feature_j"), F.lit(lots)) == i)) for i in range(max(1, lots))]
    if lists is not None:
        met = token_pairs(lists.select(F.coalesce("token_str", F.lit("None")).alias("key"), "features"), few_ids(features)).where("feature_i < feature_j")
        met = met.join(F.broadcast(wanted) if n <= _SENT_PAIRS else wanted, ["feature_i", "feature_j"], "left_semi")
        met = stored(met.groupBy("feature_i", "feature_j", "key").agg(F.sum("n").alias("count")), "met")
        parts += [met.groupBy("feature_i", "feature_j").agg(F.sum("count").alias("count")).withColumn("key", F.lit(None).cast("string")), met.withColumn("count", F.col("count") * 2)]  # a row of either
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy(F.col("feature_i").alias("_lo"), F.col("feature_j").alias("_hi"), "key").agg(F.sum("count").alias("count"))
    return stored(both.join(found, ["_lo", "_hi"]).select("feature_i", "feature_j", "key", "count"), "shared")


def _lookup(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    got = wanted.select(F.col("feature_i").cast("long"), F.col("feature_j").cast("long")).toArrow()
    sides = [c.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if got.num_rows else np.empty(0, np.int64) for c in got.columns]
    names = np.unique(np.concatenate(sides))
    i, j = (np.searchsorted(names, s) for s in sides)
    order = np.argsort(np.minimum(i, j) * len(names) + np.maximum(i, j), kind="stable")
    codes = (np.minimum(i, j) * len(names) + np.maximum(i, j))[order]
    ask = tokens.sparkSession.sparkContext.broadcast((names, codes, sides[0][order], sides[1][order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, fi, fj = ask.value
        for batch in batches:
            if not len(batch) or not len(codes):
                continue
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            f = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            words = batch.column(1).flatten().dictionary_encode()
            word, n = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            token = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(names, f), len(names) - 1)
            good = names[at] == f  # features of this lot of pairs
            hits = []
            for a, b in index_pairs(sizes):
                keep = good[a] & good[b] & (f[a] < f[b])
                a, b = a[keep], b[keep]
                code = at[a] * len(names) + at[b]
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                ok = codes[place] == code
                hits.append(np.stack([token[a[ok]], place[ok], a[ok], b[ok]], 1))
            hit = np.concatenate(hits) if hits else np.empty((0, 4), np.int64)
            if not len(hit):
                continue
            pair, shared = np.unique(np.unique(hit[:, :2], axis=0)[:, 1], return_counts=True)
            rows = np.unique(np.concatenate([hit[:, [1, 2]], hit[:, [1, 3]]]), axis=0)  # a row of a token once a pair
            key, where = np.unique(rows[:, 0] * len(words.dictionary) + word[rows[:, 1]], return_inverse=True)
            counts = np.bincount(where, n[rows[:, 1]]).astype(np.int64)
            of, w = key // len(words.dictionary), key % len(words.dictionary)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([fi[pair], fi[of]])), pa.array(np.concatenate([fj[pair], fj[of]])),
                pa.chunked_array([pa.nulls(len(pair), pa.string()), words.dictionary.take(pa.array(w)).cast(pa.string())]).combine_chunks(), pa.array(np.concatenate([shared, counts])),
            ], names=["feature_i", "feature_j", "key", "count"])

    return tokens.mapInArrow(run, "feature_i long, feature_j long, key string, count long")


def summarize_pairs(acts: DataFrame, pairs: DataFrame, summaries: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Every requested pair at once: on how many tokens both features have rows, the most frequent strings of these
    rows (both sides' rows count) and their concentration, artifact score (the larger of the two), suspicion,
    labels and priority; the pair's own metrics are kept if it has them. ``acts`` and ``lists`` as in shared_tokens()."""
    words = shared_tokens(acts, pairs.select("feature_i", "feature_j").distinct(), lists)
    shared = words.where("key IS NULL").select("feature_i", "feature_j", F.col("count").alias("shared_activation_count_estimate"))
    words = words.where("key IS NOT NULL")
    w = Window.partitionBy("feature_i", "feature_j").orderBy(F.desc("count"), "key")
    top = words.withColumn("_all", F.sum("count").over(Window.partitionBy("feature_i", "feature_j"))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 10)
    top = top.groupBy("feature_i", "feature_j").agg(F.max("count").alias("_top"), F.max("_all").alias("_rows"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "key", "count"))), lambda s: F.struct(s["key"].alias("key"), s["count"].alias("count"))).alias("shared_top_tokens"))
    info = lambda s: summaries.select(F.col("feature_id").alias(f"feature_{s}"), F.coalesce("artifact_score", F.lit(0.0)).alias(f"_a{s}"), F.col("inspection_labels").alias(f"_l{s}"))
    metrics = [c for c in ("jaccard", "pmi", "coactivation_count") if c in pairs.columns]
    p = pairs.select("feature_i", "feature_j", *metrics).dropDuplicates(["feature_i", "feature_j"])
    for c in ("jaccard", "pmi"):
        p = p if c in metrics else p.withColumn(c, F.lit(None).cast("double"))
    p = p if "coactivation_count" in metrics else p.withColumn("coactivation_count", F.lit(None).cast("long"))
    p = p.join(info("i"), "feature_i", "left").join(info("j"), "feature_j", "left").join(shared, ["feature_i", "feature_j"], "left").join(top, ["feature_i", "feature_j"], "left")
    none = F.expr("CAST(array() AS array<string>)")
    has = lambda label: F.array_contains(F.concat(F.coalesce("_li", none), F.coalesce("_lj", none)), label)
    p = p.withColumns({"shared_activation_count_estimate": F.coalesce("shared_activation_count_estimate", F.lit(0)).cast("long"), "pair_artifact_score": F.greatest(F.coalesce("_ai", F.lit(0.0)), F.coalesce("_aj", F.lit(0.0))), "shared_token_concentration": safe_ratio(F.coalesce("_top", F.lit(0)), F.coalesce("_rows", F.lit(0)))})
    p = p.withColumn("pair_suspicion_score", F.greatest("pair_artifact_score", "shared_token_concentration"))
    sus = F.col("pair_suspicion_score")
    labels = _labels((sus >= 0.50, "likely_artifact_pair"), (has("quote_like"), "quote_related_pair"), (has("boundary_heavy"), "boundary_related_pair"), ((sus < 0.35) & (F.col("shared_activation_count_estimate") > 0), "manual_priority_pair"))
    return p.withColumns({"inspection_labels": labels, "manual_priority": F.when(sus >= 0.50, "low").otherwise("medium")}).drop("_ai", "_aj", "_li", "_lj", "_rows", "_top")


def pair_summaries_frame(summaries: DataFrame) -> DataFrame:
    return summaries.withColumns({"inspection_labels": F.array_join("inspection_labels", ","), "shared_top_tokens_json": F.coalesce(counts_json("shared_top_tokens"), F.lit("{}"))}).select(*PAIR_COLUMNS)


def activation_bands(acts: DataFrame, meta: DataFrame, n: int = 5, window: int = 20, ids: DataFrame | None = None) -> DataFrame:
    """Per feature the ``n`` smallest, nearest to the median and largest activations, with context: feature_id, band
    (low, median, high), rank, activation, text_id, source, token_pos, token_str and the context. Rows are not filtered."""
    acts = semi_filter(acts, ids) if ids is not None else acts
    acts = acts.select("feature_id", "text_id", "source", "token_pos", "token_str", "activation")
    median = stored(quantiles(acts, "activation", (0.5,), ("feature_id",), name="_p").select("feature_id", F.get("_p", F.lit(0)).alias("_m")), "medians")
    off = acts.join(median, "feature_id", "left").withColumn("_off", F.round(F.abs(F.col("activation") - F.col("_m")), 9))
    # the texts that hold each band's first rows, from one scan; all three bands are then found among the rows of these
    best = off.groupBy("feature_id", "text_id").agg(F.min("activation").alias("_low"), F.min("_off").alias("_near"), F.max("activation").alias("_high"), F.max(F.col("activation").isNull()).alias("_null"), F.max("_m").isNotNull().alias("_has"))
    best = stored(best.withColumns({c: F.when(~F.col("_null"), F.col(c)) for c in ("_low", "_near")}), "best")
    texts = [first_texts(b, n, order) for b, order in ((best, F.asc("_low")), (best.where("_has"), F.asc("_near")), (best, F.desc_nulls_last("_high")))]
    some = stored(in_texts(off, texts[0].union(texts[1]).union(texts[2]).distinct()), "some")
    bands = {"low": (some, F.asc("activation")), "median": (some.where("_m IS NOT NULL"), F.asc("_off")), "high": (some, F.desc_nulls_last("activation"))}
    rows = reduce(DataFrame.unionByName, [top_rows(r, n, order).drop("_m", "_off").withColumn("band", F.lit(band)) for band, (r, order) in bands.items()])
    rows = with_context(rows, meta, window)
    return rows.select("feature_id", "band", "rank", "activation", "text_id", "source", "token_pos", "token_str", "left_context", "center_token", "right_context")


def inspection_payload(features: DataFrame, pairs: DataFrame | None = None, peaks: DataFrame | None = None, run_name: str = "run") -> DataFrame:
    """Rows for a JSON report: run_name, kind (feature, pair, bimodal) and the summary as nested structs, one column a kind."""
    parts = [features.select(F.lit(run_name).alias("run_name"), F.lit("feature").alias("kind"), F.struct("*").alias("feature"))]
    if pairs is not None:
        parts.append(pairs.select(F.lit(run_name).alias("run_name"), F.lit("pair").alias("kind"), F.struct("*").alias("pair")))
    if peaks is not None:
        parts.append(peaks.select(F.lit(run_name).alias("run_name"), F.lit("bimodal").alias("kind"), F.struct("*").alias("bimodal")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
