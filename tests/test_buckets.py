"""Run tables that are dealt into buckets are joined and grouped without an exchange."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from sparkloom.operators import cards, cooccurrence
from sparkloom.sources.artifacts import Run, read_table, write_table


def exchanges(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return re.findall(r"Exchange hashpartitioning\((.*?)\)", out.getvalue())


def test_cards_join_without_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = Run(spark, f"file://{tmp_path}/run")
        ids = spark.range(500).withColumnRenamed("id", "feature_id")
        run.write("feature_cards", ids.withColumn("n_texts", F.lit(1)))
        run.write("bimodal_feature_candidates", ids.where("feature_id % 2 = 0").withColumn("bimodality_score", F.col("feature_id") / 2))
        run.write("inspection_feature_summaries", ids.withColumn("artifact_score", F.lit(0.5)))
        again = Run(spark, run.path)  # the layout is found from the folder
        got = cards.merge_bimodality(cards.merge_inspection(again.feature_cards(), again.table("inspection_feature_summaries")), again.bimodal_feature_candidates())
        assert exchanges(got) == [] and got.count() == 500
        assert got.where("bimodality_score = 4").first()["feature_id"] == 8
        run.write("feature_cards", got)  # replaces what it reads
        assert run.feature_cards().where("artifact_score = 0.5").count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_meet_by_token_without_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = Run(spark, f"file://{tmp_path}/run")
        facts = spark.range(4000).select((F.col("id") % 37).alias("text_id"), (F.col("id") % 11).alias("token_pos"), (F.col("id") % 5).alias("feature_id"), F.lit("s").alias("source"), F.lit("t").alias("token_str"), F.lit(1.0).alias("activation"))
        got = run.write("filtered_activations", facts)
        tokens = run.write("token_metadata", facts.select("text_id", "token_pos", "source", "token_str").distinct())
        assert exchanges(got.groupBy("text_id", "token_pos").agg(F.collect_set("feature_id"))) == []
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # buckets by text serve joins by text and position
        assert exchanges(got.select("text_id", "token_pos").distinct().join(tokens.select("text_id", "token_pos").distinct(), ["text_id", "token_pos"])) == []
        pairs = cooccurrence.same_token_pairs(got, F.broadcast(facts.select("feature_id").distinct()), None)
        assert not any("token_pos" in e for e in exchanges(pairs)) and pairs.count() == 10
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plain_and_missing_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write_table(spark.range(9), path)
    assert read_table(spark, path).count() == 9
    write_table(spark.range(7).withColumnRenamed("id", "a b"), path, "a b", 3)
    assert read_table(spark, path).count() == 7 and read_table(spark, path).columns == ["a b"]
    assert read_table(spark, f"{path}none", "x long").count() == 0
