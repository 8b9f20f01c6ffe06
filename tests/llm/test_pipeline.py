"""The pipeline's stages on the small tables: decisions take effect, clean documents stay."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import decontaminate, ngram_join, queries, secrets
from sparkloom.llm.shared import written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    planted = docs.limit(1).select(F.lit(10_001).cast("long").alias("doc_id"), F.lit("123 456").alias("text"), "lang", "source", "n_chars")
    docs, names = docs.unionByName(planted).unionByName(planted), docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, data), name)
        assert docs.columns == names
        seen.append(docs.count())
    assert seen[0] - seen[1] == 2 and seen[1] > seen[2] > seen[3] == seen[4]
    assert ngram_join.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    assert secrets.find_secrets(docs).where(F.size("base_spans") > 0).count() == 0
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert mix.count() == seen[-1]
    assert docs.where("doc_id IS NULL").count() == 0


CLASH = ["_key", "_n", "_nth", "_letters", "_weak", "score", "spans", "size", "row", "cls"]


def test_stages_on_hard_rows(spark, data):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table, clashing columns."""
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first()["text"]
    prose = "The quick dog and the lazy cat went to the market with some bread"
    long = " ".join(f"word{i % 997} and{i % 31}" for i in range(60_000))
    rows = [(1, prose, "en", "a", 3), (1, prose, "en", "a", 3), (1, prose + " password=abcdef123 today", None, None, None), (2, prose, "en", None, 1), (None, prose, "en", "a", 1), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, long, "en", "b", 9), (6, item, "en", "b", 9), (7, "123 456", "en", "b", 7), (8, 'my token = "zzzzzzzzz" is secret', "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in CLASH})
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        kept[name] = sorted(out.collect(), key=str)
        assert all(r[c] == f"own {c}" for r in kept[name] for c in CLASH)
        assert stage(spark, docs.limit(0), data).count() == 0
    ids = lambda name: sorted(str(r["doc_id"]) for r in kept[name])
    assert ids("language") == ["1", "1", "1", "2", "5", "6", "8", "None"]
    assert ids("near_duplicates") == ["1", "3", "4", "5", "6", "7", "8", "None", "None"]
    assert ids("decontamination") == sorted(str(r[0]) for r in rows if r[0] != 6)
    texts = {(r["doc_id"], r["text"]): r["n_chars"] for r in kept["secrets"]}
    assert len(kept["secrets"]) == len(rows) and not any("abcdef123" in (t or "") or "zzzzz" in (t or "") for _, t in texts)
    assert texts[3, None] == 0 and texts[1, prose] == 3 and all(n == len(t) for (_, t), n in texts.items() if "[redacted]" in (t or ""))
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert mix.count() == len(rows) and mix.where("taken > 2 * size").count() == 0 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), data).count() == 0
    untold = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.keep_known_language(spark, untold, data).count() == len(rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(str([r[c] for c in sorted(names)]) for r in got.collect()) == sorted(str([dict(zip(names, r))[c] for c in sorted(names)]) for r in cur.fetchall())
