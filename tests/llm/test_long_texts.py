"""Texts and groups that made earlier forms of the operators slow, wrong or crash."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, neighbours, secrets, shared


def test_endpoints_are_those_of_the_plain_pattern(spark):
    rng = random.Random(6)
    parts = ["a", "b-1", ".", "..", ":", ":80", ":123456", " ", "http://", "https://x", "A", "'", "é", "9"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(20_000)]
    rows += [(-1, "a.b:123456.c:90"), (-2, "a.b:80.c.d:90"), (-3, "a.b:80c.d:90"), (-4, "x.http://a.b:8080 c.d:22"), (-5, ".a.b:80"), (-6, "-.a:99")]
    df = spark.createDataFrame(rows, "i long, t string")
    got = df.select("t", F.regexp_extract_all("t", F.lit(secrets.WEAK["endpoint"]), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(secrets._JAVA["endpoint"]), F.lit(0)).alias("b"), F.split("t", secrets.WEAK["endpoint"], -1).alias("c"), F.split("t", secrets._JAVA["endpoint"], -1).alias("d"))
    assert got.where("a <> b OR c <> d").count() == 0 and got.where("size(a) > 1").count() > 300


@pytest.mark.parametrize("text", ["a." * 100_000, "x" * 1_000_000, "1." * 300_000, "9" * 1_000_000, "a.b:" * 200_000, "-" * 1_000_000, "a" * 19 + ("." + "b" * 9) * 50_000, " " * 1_000_000, "=" * 1_000_000, "password " * 50_000])
def test_secrets_of_long_runs(spark, text):
    docs = spark.createDataFrame([(1, text + " user = bob"), (2, "user=bob1 s3cr3tS3cr3tS3cr3tXYZ a.example.com:8080")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert len(got) == 2 and len(got[2]) == 3 and time.time() - began < 60


def test_words_between_long_gaps(spark):
    rows = [(1, "a" + " " * 1_000_000 + "b", 2), (2, " \t" * 300_000, 0), (3, "\n" * 500_000 + "x", 1), (4, "x " * 300_000, 300_000), (5, None, 0), (6, " ", 1), (7, "é ß", 2)]
    began = time.time()
    got = spark.createDataFrame(rows, "i long, t string, n long").select("n", shared.n_words(F.col("t")).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in got) and time.time() - began < 30


def test_equal_vectors_rank_by_id(spark):
    ids = list(range(6000))
    random.Random(1).shuffle(ids)
    near = [[1.0, 2.0, 3.0, 4.0]] * len(ids)
    rng = np.random.default_rng(3)
    other = [(10_000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))]
    v = neighbours.usable(spark.createDataFrame([*zip(ids, near), *other], "vec_id long, embedding array<double>").repartition(5))
    got = neighbours.search(v, v.where("vec_id = 100")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and all(r["score"] == 0 for r in got)


def test_tiling_of_repetition_is_quick():
    began = time.time()
    word = np.ones(1, np.uint64)
    assert decontaminate.tiles(np.repeat(word, 20_000), np.repeat(word, 1000)) == [(0, 0, 1000)]
    rng = random.Random(2)
    two = np.array([rng.choice([5, 9]) for _ in range(5000)], np.uint64)
    got = decontaminate.tiles(np.tile(two[:50], 200), two[:1000])
    assert sum(n for _, _, n in got) >= 50
    item = np.concatenate([np.repeat(word, 300), two[:400]])
    assert sum(n for _, _, n in decontaminate.tiles(np.concatenate([np.repeat(word, 10_000), two[200:400], two[:200]]), item)) >= 690
    assert time.time() - began < 30


def test_common_seeds_pair_nothing_alone(spark):
    """A phrase that all texts and items hold is left out of the join; what is found stays the same."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = "terms and conditions apply"
    items = [(i, " ".join([word() for _ in range(20)] + [common] + [word() for _ in range(20)])) for i in range(6)]
    docs = [(i, " ".join([word() for _ in range(30)] + [common])) for i in range(40)]
    docs += [(100 + i, "start " + t + " end") for i, t in items] + [(200 + i, " ".join(t.split()[22:] + t.split()[:22])) for i, t in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(100 + i, i) for i in range(6)} | {(200 + i, i) for i in range(6)}
    seeds = spark.createDataFrame([(h, 1, 10, 1) for h in range(7)], "hash long, item long, words long, times long")
    hits = spark.createDataFrame([(r, 6) for r in range(50)] + [(0, h) for h in range(6)], "row long, hash long")
    kept = {r["hash"]: (r["rest"], r["least"]) for r in decontaminate.rare_seeds(seeds, hits, 0.8, 4).collect()}
    assert kept == {h: (1, 2) for h in range(6)}
