"""Facts that come as a list for each token: the same pairs and shared tokens as from rows, and nothing gathered by token."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from sparkloom.config import RowFilter
from sparkloom.operators import cooccurrence, filters, inspection, quantiles, stats


def facts(spark, kinds):
    """900 tokens of 30 texts with two to four of 40 features; with few ``kinds`` lists repeat."""
    t = spark.range(900).select((F.col("id") % 30).alias("text_id"), (F.col("id") / 30).cast("long").alias("token_pos"), F.concat(F.lit("w"), F.col("id") % kinds).alias("token_str"), (F.col("id") * 7919 % kinds).alias("r"))
    f = lambda k: F.pmod(F.xxhash64("r", F.lit(k)), F.lit(10)) + k * 10
    t = t.select("text_id", "token_pos", "token_str", F.array(f(0), f(1), F.when(F.col("r") % 3 > 0, f(2)), F.when(F.col("r") % 5 > 0, f(3))).alias("features"))
    rows = t.select("text_id", "token_pos", "token_str", F.explode("features").alias("feature_id")).where("feature_id IS NOT NULL").withColumn("activation", F.col("feature_id") / 2)
    return t, rows


@pytest.mark.parametrize("kinds", [7, 897])
def test_pairs_of_lists(spark, kinds, monkeypatch):
    t, rows = facts(spark, kinds)
    ids = spark.range(35).withColumnRenamed("id", "feature_id")
    want = cooccurrence.same_token_pairs(rows, ids, None).collect()
    assert len(want) > 100 or kinds == 7
    assert cooccurrence.same_token_pairs(rows, ids, None, lists=t).collect() == want
    lists, rest = t.where("text_id % 3 > 0"), rows.where("text_id % 3 = 0")
    assert cooccurrence.same_token_pairs(rows, ids, None, lists=lists, rest=rest).collect() == want
    twice = rest.union(rest)  # rows that repeat count as rows, not as tokens
    assert cooccurrence.same_token_pairs(lists.select("text_id", "token_pos", "token_str", F.explode("features").alias("feature_id")).where("feature_id IS NOT NULL").unionByName(twice.drop("activation")), ids, None).collect() == cooccurrence.same_token_pairs(rows, ids, None, lists=lists, rest=twice).collect()
    pairs = rows.select("feature_id").distinct().withColumnRenamed("feature_id", "feature_i").join(ids.withColumnRenamed("feature_id", "feature_j"), F.col("feature_i") < F.col("feature_j"))
    shared = lambda *a: sorted(tuple(r) for r in inspection.shared_tokens(*a).select("feature_i", "feature_j", F.coalesce("key", F.lit("")), "count").collect())
    assert shared(rows, pairs) == shared(rest, pairs, lists) == shared(rows.where("false"), pairs, t)
    monkeypatch.setattr(cooccurrence, "_FEW_IDS", 3)  # too many ids: as from rows
    assert cooccurrence.same_token_pairs(rows, ids, None, lists=t).collect() == want


def test_first_rows_lie_in_first_texts(spark, monkeypatch):
    """Only rows of the texts that can hold a first row are ordered, whatever is null or ties."""
    rows = [(f, t, p, None if (t + p) % 7 == f else float("nan") if (t * p) % 11 == f + 3 else float((t * p + f) % 4)) for f in range(3) for t in range(20) for p in range(9)] + [(9, 1, 1, None), (9, 0, 5, None)]
    acts = spark.createDataFrame(rows, "feature_id long, text_id long, token_pos long, activation double").repartition(5)
    plain = stats.top_rows(acts, 6, F.desc_nulls_last("activation")).drop("activation")
    seen = []
    window = stats.in_texts
    monkeypatch.setattr(stats, "in_texts", lambda a, t: (seen.append(window(a, t)), seen[-1])[1])
    assert sorted(stats.top_rows(acts, 6).drop("activation").collect()) == sorted(plain.collect())
    assert seen[0].count() < acts.count() / 2


def test_totals_by_words(spark):
    a = spark.createDataFrame([(1, 0), (1, 63), (1, 64), (1, 64), (2, 5), (None, 5), (3, None), (4, -1), (4, -64)], "text_id long, token_pos long")
    m = spark.createDataFrame([(1, 0), (1, 64), (1, 65), (2, 6), (3, None), (None, 5), (4, -1), (4, -1)], "text_id long, token_pos long")
    assert tuple(stats.relevant_totals(a, m).first()) == (3, 2) and tuple(stats.relevant_totals(a, m.where("false")).first()) == (0, 0)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        stats.relevant_totals(a, m).explain()
    assert "hashpartitioning(text_id#" in out.getvalue() and "token_pos" not in "".join(x for x in out.getvalue().splitlines() if "Exchange" in x)


def test_counted_quantiles(spark, monkeypatch):
    """Values that repeat are counted; no bracket is narrowed."""
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: 1 / 0)
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 100).cast("double").alias("v"))
    got = {r["k"]: r["q"] for r in quantiles.quantiles(df, "v", (0.0, 0.5, 1.0), ("k",), 1000, "q", 10).collect()}
    assert got == {k: df.where(f"k = {k}").selectExpr("percentile(v, array(0.0D, 0.5D, 1.0D)) AS q").first()["q"] for k in (0, 1)}


def test_filters_in_two_parts(spark):
    cfg = RowFilter(exclude_token_positions_ge=20, min_activation=3.0, keep_token_quality_columns=False)
    rows = facts(spark, 897)[1].withColumn("token_str", F.when(F.col("text_id") % 4 == 0, F.lit(" . ")).otherwise(F.col("token_str")))
    want = filters.apply_row_filters(rows, cfg)
    got = filters.apply_row_filters(filters.apply_row_filters(rows, filters.of_tokens(cfg)), filters.of_activations(cfg))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 0
