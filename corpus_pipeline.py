"""A corpus through five stages; each is written as a table and reread as the next one's documents.

What holds for every stage: an empty table gives an empty one; texts are looked at whole, however long;
columns beyond those of documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language, mixing, ngram_join, secrets
from sparkloom.llm.shared import drop, fresh, split_by_keys, written

#: A text whose best language has a smaller share of its words than this has none.
LEAST_SHARE = 0.3


def keep_known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null and empty ones among them, and those that no language fits. Repeated rows are
    judged alike. Where no row has a language there is nothing to judge by, and all stay."""
    field = language.train_field(docs)
    if field is None:
        return docs
    pred, score = fresh(docs, "pred"), fresh(docs, "score")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    found = language.identify(row, field).withColumnsRenamed({"lang_pred": pred, "score": score})
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SHARE)).select("row.*")


def keep_one_of_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies, once: of rows that repeat this id, the one that
    is smallest in text (a null one last) and then in the other columns. Null and empty texts are near nothing and
    stay; so do all rows without an id."""
    near = ngram_join.near_duplicates(docs)
    n, keep, nth = fresh(docs, "n"), fresh(docs, "keep"), fresh(docs, "nth")
    ids = near.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias(n), F.first(F.col("doc_id") == F.col("component_id")).alias(keep))
    ids = written(ids.where((F.col(n) > 1) | ~F.col(keep)), "judged")  # all other rows stay, so they don't move
    some, rest = split_by_keys(docs, "doc_id", ids.select("doc_id"))
    some = some.join(ids, "doc_id", "left").where(F.coalesce(keep, F.lit(True)))
    once, again = some.where(F.coalesce(n, F.lit(1)) == 1), some.where(F.col(n) > 1)  # ids that repeat
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), "text", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    again = again.withColumn(nth, first).where(F.col(nth) == 1)
    return rest.unionByName(once.select(*docs.columns)).unionByName(again.select(*docs.columns))


def drop_benchmark_texts(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that tile enough of a benchmark item, every row with such a text. Null and empty texts, and texts
    for an empty benchmark, stay."""
    key = fresh(docs, "key")
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keys = written(found.select(F.col("text_key").alias(key)).distinct(), "flagged")
    return docs.withColumn(key, F.xxhash64("text")).join(keys, key, "left_anti").select(*docs.columns)


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text. Null texts stay null, repeated rows change alike."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    found = secrets.find_secrets(row).select("row", secrets.redact(F.col("text"), F.col("spans")).alias("text"), (F.size("spans") > 0).alias("hit"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def mix_to_weights(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the training mix takes of every document, with its copies. Null and empty texts have no words and give none;
    a null source is a source; repeated rows each count."""
    return mixing.curriculum_order(mixing.mix_sources(docs))


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_texts),
    ("secrets", redact_secrets),
    ("mixing", mix_to_weights),
]

#: SQL expresses neither the field of the first stage nor the tiling of the third.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return mixing.ordered_copies(STAGES[-1][1](spark, docs, sf_dir))  # a row a copy, in training order
