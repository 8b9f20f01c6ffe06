"""Statistics of features and sources, and the strongest examples with context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..sources.artifacts import stored
from .quantiles import about_distinct, quantiles

KEY = ("text_id", "token_pos")


def relevant_totals(acts: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: n_total_tokens and n_total_texts of ``meta`` among the tokens that have a row in ``acts``."""
    known = "text_id IS NOT NULL AND token_pos IS NOT NULL"
    texts = _words(acts.where(known), "_a").join(_words(meta.where(known), "_b"), ["text_id", "_w"]).groupBy("text_id").agg(F.sum(F.bit_count(F.col("_a").bitwiseAND(F.col("_b")))).alias("_n")).where("_n > 0")
    return texts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_total_tokens"), F.count("*").alias("n_total_texts"))


def _words(rows: DataFrame, name: str) -> DataFrame:
    """(text_id, _w, ``name``): the positions that a text has rows for, as bits of one word for every 64 of them, so a task sums up the
    rows of a text that it has before any moves."""
    pos = F.col("token_pos").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), pos.bitwiseAND(F.lit(63)).cast("int"))
    return rows.groupBy("text_id", F.shiftright(pos, 6).alias("_w")).agg(F.bit_or(bit).alias(name))


def feature_stats(acts: DataFrame, meta: DataFrame, exact: bool = True, check: bool = True) -> DataFrame:
    """Per feature: rows, texts, mean, maximum, percentiles (linear between values), and frequencies
    among the tokens and texts that have rows; most frequent first.

    Distinct texts are counted over (feature, text) first, so a frequent feature's texts are spread
    over all tasks. Exact percentiles are found by rank (operators/quantiles.py), so a feature may have all rows;
    ``exact=False`` takes Spark's bounded sketch. With ``check``, no token left is an error.
    """
    totals = relevant_totals(acts, meta)
    if check and not totals.first()["n_total_tokens"]:
        raise ValueError("no tokens are left after the row filters")
    a, qs = nan_to_null(F.col("activation")), (0.5, 0.95, 0.99)
    more = [F.count(a).alias("_n"), about_distinct(a).alias("_d")] if exact else [F.percentile_approx(a, list(qs), 10_000).alias("_p")]
    base = acts.groupBy("feature_id").agg(F.count("*").alias("n_token_activations"), F.avg(a).alias("mean_activation"), F.max(a).alias("max_activation"), *more)
    if exact:
        base = stored(base, "base")
        sizes = base.where("_n > 0").select("feature_id", "_n", "_d")
        base = base.drop("_n", "_d").join(quantiles(acts, "activation", qs, ("feature_id",), name="_p", sizes=sizes), "feature_id", "left")
    base = base.select("*", *[F.get("_p", F.lit(i)).alias(f"p{q}_activation") for i, q in enumerate((50, 95, 99))])
    texts = acts.select("feature_id", "text_id").distinct().groupBy("feature_id").agg(F.count("text_id").alias("n_texts"))
    out = base.join(texts, "feature_id").crossJoin(F.broadcast(totals))  # totals: one row
    out = out.select("feature_id", "n_token_activations", "n_texts", "mean_activation", "max_activation", "p50_activation", "p95_activation", "p99_activation", (F.col("n_token_activations") / F.col("n_total_tokens")).alias("token_frequency"), (F.col("n_texts") / F.col("n_total_texts")).alias("text_frequency"))
    return out.orderBy(F.desc("n_token_activations"), "feature_id")


def top_rows(acts: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of each feature with their rank from 1, strongest first unless told otherwise."""
    if not order:
        best = acts.groupBy("feature_id", "text_id").agg(F.max("activation").alias("_best"))
        acts, order = in_texts(acts, first_texts(best, n, F.desc_nulls_last("_best"))), (F.desc_nulls_last("activation"),)
    w = Window.partitionBy("feature_id").orderBy(*order, "text_id", "token_pos")
    return acts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_texts(best: DataFrame, n: int, order: Column) -> DataFrame:
    """(feature_id, text_id): of each feature's texts (feature_id, text_id, the best of their rows) the first n by ``order``, ties to the smaller
    text. The feature's first n rows lie in them: each of n texts before another has a row before all of that one's."""
    w = Window.partitionBy("feature_id").orderBy(order, "text_id")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("feature_id", "text_id")


def in_texts(acts: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of the pairs ``texts`` (feature_id, text_id)."""
    texts = stored(texts, "first")
    sent = texts.limit(_SENT + 1).count() <= _SENT
    keys = {c: F.col(c).alias(f"_{c}") for c in texts.columns}
    other = texts.select(*keys.values())
    return acts.join(F.broadcast(other) if sent else other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]), "left_semi")


#: Positions of a stretch of a text at least; only stretches near an example are looked at.
_STRETCH = 64
#: Stretches up to this number are sent to all tasks (some 50 bytes each), so other tokens don't move.
_SENT = 500_000


def _width(window: int) -> int:
    return max(_STRETCH, 2 * window + 1)


def _asked(places: DataFrame, window: int) -> DataFrame:
    """The places (text_id, token_pos) with the stretches _k that their windows lie in, two at most."""
    size = _width(window)
    return places.select(*KEY, F.explode(F.sequence(F.floor((F.col("token_pos") - window) / size), F.floor((F.col("token_pos") + window) / size))).alias("_k"))


def _picked(tokens: DataFrame, stretches: DataFrame) -> DataFrame:
    """The tokens of the stored ``stretches`` (text_id, _k, ...), with their columns."""
    sent = stretches.limit(_SENT + 1).count() <= _SENT
    return tokens.join(F.broadcast(stretches) if sent else stretches, ["text_id", "_k"])


def _around(places: DataFrame, tokens: DataFrame, window: int) -> DataFrame:
    """(text_id, token_pos, _left, _center, _right) of the places: the tokens (text_id, _i, token_str) up to ``window`` before, at and
    after. Places and tokens meet by stretch of _i, a place in the one or two that its window touches, so no list of
    a whole text is built and no row is made for a token that isn't near."""
    near = tokens.withColumn("_k", F.floor(F.col("_i") / _width(window))).join(_asked(places, window), ["text_id", "_k"])
    near = near.withColumn("_d", F.col("_i") - F.col("token_pos")).where(F.abs("_d") <= window)
    near = near.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_d", "token_str"))).alias("_near"))
    words = lambda test: F.transform(F.filter("_near", test), lambda t: t["token_str"])
    return near.select(
        *KEY, F.array_join(words(lambda t: t["_d"] < 0), "").alias("_left"), F.get(words(lambda t: t["_d"] == 0), F.lit(0)).alias("_center"), F.array_join(words(lambda t: t["_d"] > 0), "").alias("_right"))


def with_context(rows: DataFrame, meta: DataFrame, window: int) -> DataFrame:
    """Adds left_context, center_token and right_context by the token's place among its text's tokens in their order. A
    row of an unknown text keeps its own token and empty context.

    Tokens are counted by stretches of positions; running sums over a text's stretches tell at which place each begins. Only the
    stretches that hold a place near a row are ordered, each for itself."""
    rows = stored(rows, "examples")
    places = rows.select(*KEY).distinct()
    size = _width(window)
    texts = places.select("text_id").distinct()
    if texts.limit(_SENT + 1).count() <= _SENT:  # other texts aren't looked at
        meta = meta.join(F.broadcast(texts), "text_id", "left_semi")
    tokens = meta.select("text_id", "token_pos", "token_str", F.floor(F.col("token_pos") / size).alias("_k"))
    counts = tokens.groupBy("text_id", "_k").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("text_id").orderBy("_k")) - F.col("_n"))  # a row for each stretch
    reach = F.explode(F.sequence(F.floor(F.col("_start") / size), F.floor((F.col("_start") + F.col("_n") - 1) / size))).alias("_at")
    wanted = _asked(places, window).select("text_id", F.col("_k").alias("_at")).distinct()
    needed = stored(starts.select("text_id", "_k", "_start", reach).join(wanted, ["text_id", "_at"]).select("text_id", "_k", "_start").distinct(), "stretches")
    nth = F.row_number().over(Window.partitionBy("text_id", "_k").orderBy("token_pos", "token_str"))
    placed = _picked(tokens, needed).select("text_id", (F.col("_start") + nth - 1).alias("_i"), "token_str")
    j = rows.join(_around(places, placed, window), list(KEY), "left")
    return j.withColumns({
        "left_context": F.coalesce("_left", F.lit("")), "center_token": F.coalesce("_center", "token_str"), "right_context": F.coalesce("_right", F.lit("")),
    }).drop("_left", "_center", "_right")


EXAMPLE_COLUMNS = ("feature_id", "rank", "activation", "text_id", "source", "token_pos", "token_str", "left_context", "center_token", "right_context")


def top_examples(acts: DataFrame, meta: DataFrame, top_n: int = 20, window: int = 20) -> DataFrame:
    """The ``top_n`` strongest rows of each feature with ``window`` tokens of context on either side.
    Only tokens near an example move."""
    return with_context(top_rows(acts, top_n), meta, window).select(*EXAMPLE_COLUMNS)


def context_by_position(rows: DataFrame, meta: DataFrame, window: int = 20) -> DataFrame:
    """Context by the value of token_pos; rows of unknown texts go, a missing centre is empty."""
    rows = stored(rows.join(meta.select("text_id").distinct(), "text_id", "left_semi"), "examples")
    places = rows.select(*KEY).distinct()
    needed = stored(_asked(places, window).select("text_id", "_k").distinct(), "stretches")
    tokens = meta.select("text_id", F.col("token_pos").alias("_i"), "token_str", F.floor(F.col("token_pos") / _width(window)).alias("_k"))
    j = rows.join(_around(places, _picked(tokens, needed).drop("_k"), window), list(KEY), "left")
    return j.withColumns({"left_context": F.coalesce("_left", F.lit("")), "center_token": F.coalesce("_center", F.lit("")), "right_context": F.coalesce("_right", F.lit(""))}).drop("_left", "_center", "_right")


def summarize_text_sources(texts: DataFrame) -> DataFrame:
    """source (missing: unknown), texts, text_share; most texts first."""
    s = texts.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("texts"))
    return _share(s, "texts", "text_share").orderBy(F.desc("texts"), "source")


def summarize_token_sources(meta: DataFrame) -> DataFrame:
    """source (null is a group), texts, tokens, token_share; most tokens first."""
    per_text = meta.groupBy("source", "text_id").agg(F.count("*").alias("tokens"))
    s = per_text.groupBy("source").agg(F.count("text_id").alias("texts"), F.sum("tokens").alias("tokens"))
    return _share(s, "tokens", "token_share").orderBy(F.desc("tokens"), F.asc_nulls_last("source"))


def _share(s: DataFrame, col: str, name: str) -> DataFrame:
    total = s.agg(F.sum(col).alias("_t"))
    return s.crossJoin(F.broadcast(total)).withColumn(name, F.coalesce(F.try_divide(F.col(col), F.col("_t")), F.lit(0.0))).drop("_t")


def describe_activation(acts: DataFrame, feature_id: int) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max of one feature's rows."""
    a, rows = nan_to_null(F.col("activation")), acts.where(F.col("feature_id") == feature_id)
    base = rows.agg(F.count(a).alias("count"), F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"), F.min(a).alias("min"), F.max(a).alias("max"))
    cuts = quantiles(rows, "activation", (0.25, 0.5, 0.75), name="_p")
    base = base.join(cuts, how="left")  # a row each, or none
    return base.select("count", "mean", "std", "min", *[F.get("_p", F.lit(i)).alias(f"p{q}") for i, q in enumerate((25, 50, 75))], "max")


def step_metrics(**tables: DataFrame) -> DataFrame:
    """(table, n_rows, n_features) of each given table."""
    out = None
    for name, df in tables.items():
        key = F.count_distinct("feature_id") if "feature_id" in df.columns else F.lit(None).cast("long")
        one = df.agg(F.count("*").alias("n_rows"), key.alias("n_features")).select(F.lit(name).alias("table"), "n_rows", "n_features")
        out = one if out is None else out.unionByName(one)
    return out
