"""Collocations against counting every phrase by hand."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import collocations

DOC = "doc_id long, text string, source string, lang string"


def brute(rows, least, longest=3, top=2000, share=50):
    f = collections.defaultdict(collections.Counter)
    for _, text, _, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        n, found = sum(a for g, a in c.items() if len(g) == 1), []
        good = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = collections.Counter()
        for g, a in good.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], a)
        for g, a in good.items():
            if 100 * inside[g] >= share * a and inside[g]:
                continue
            s, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, r, p.decode(), -a, l, x, n, -s) for r, (s, a, p, l, x) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, **options):
    return sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, DOC), **options).collect())


def test_against_counting(spark):
    rng = random.Random(3)
    words = ["a", "B", "cé", "d-d", "of", "the", "ß", "x|y"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!\x0b"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 120)), "s", rng.choice(["en", "de", None, "und"])) for i in range(60)]
    rows += [(1, rows[0][1], "s", "en")] * 3 + [(None, None, None, None), (99, "", "s", "en"), (98, " .\n", "s", "xx")]
    for options in ({"least": 3}, {"least": 2, "top": 7}, {"least": 4, "longest": 4, "share": 80}):
        assert run(spark, rows, **options) == brute(rows, **options)


@pytest.mark.parametrize("lot", [64, 1000])
def test_long_texts_are_cut_without_loss(spark, lot):
    rng = random.Random(4)
    rows = [(1, " ".join(rng.choice("abc") for _ in range(4000)) + ". " + "x  y \n" * 300, "s", "en"), (2, "q" * 3000 + " a b c", "s", "en")]
    got = collocations.collocations(spark.createDataFrame(rows, DOC), least=5, lot=lot)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_products_beyond_64_bits_and_empty_tables(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(3 * 10**12,)], "a long")
    wide = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    got = big.select(F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('a')} * {wide('a + 1')})")).first()[0]
    assert got == 1000000 * 9 * 10**24 // (3 * 10**12 * (3 * 10**12 + 1))
    assert run(spark, []) == []
    clash = spark.createDataFrame([("en", "p q " * 12, "x", 5)], "lang string, text string, phrase string, rank int")
    assert [(r["phrase"], r["a"]) for r in collocations.collocations(clash).collect()] == [("p q p", 11), ("q p q", 11)]


def filled(texts, depth, known=None, lot=1 << 20, bundles=7):
    """(bundle, lang, prefix, next): count, of the stripes that lots of ``texts`` (lang, text) give, and how many rows a bundle has."""
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*texts)], names=["lang", "text"])
    counts, rows = collections.Counter(), collections.Counter()
    for words in collocations._lots(iter([batch]), lot, depth):
        for out in collocations._fill(*words, depth, known, bundles):
            for k, packed in zip(out.column(0).to_pylist(), out.column(1)):
                rows[k] += 1
                for s in pa.ipc.read_record_batch(packed.as_buffer(), collocations._STRIPE).to_pylist():
                    for word, c in zip(s["next"], s["count"], strict=True):
                        counts[k, s["lang"], s["prefix"], word] += c
    return counts, rows


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_entries_are_the_same_however_many_are_counted_at_a_time(monkeypatch, depth):
    rng = random.Random(5)
    texts = [(rng.choice(["en", "de"]), "".join(rng.choice("abcde") + rng.choice("   .\n") for _ in range(rng.randint(0, 90)))) for _ in range(40)]
    by_hand = collections.Counter()
    for lang, text in texts:
        for piece in re.split(r"[.\n]", text):
            w = piece.split()
            for i in range(len(w) - depth):
                by_hand[lang, " ".join(w[i : i + depth]), w[i + depth]] += 1
    some = np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 1 << 18)
    for known in (None, some):
        whole = filled(texts, depth, known)
        for at_once in (1, 30, 1000):
            monkeypatch.setattr(collocations, "_AT_ONCE", at_once)
            assert filled(texts, depth, known) == whole
        monkeypatch.undo()
        got = collections.Counter({k[1:]: c for k, c in whole[0].items()})
        assert got == by_hand if known is None or not depth else got and not got - by_hand
        assert set(whole[1].values()) == {1}  # a bundle is one row of a lot


def test_a_lot_is_filled_in_bounded_memory():
    rng = np.random.default_rng(7)
    vocabulary = np.array([f"w{i}" for i in range(20000)])
    texts = [("en", " ".join(rng.choice(vocabulary, 20000))) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*texts)], names=["lang", "text"])
    size = sum(len(t) for _, t in texts)
    tracemalloc.start()
    try:
        for words in collocations._lots(iter([batch]), 2 * size, 2):
            for _ in collocations._fill(*words, 2, None, 96):
                pass
        assert tracemalloc.get_traced_memory()[1] < 10 * size  # what numpy and Python held at most
    finally:
        tracemalloc.stop()


def test_lots_without_words_or_with_too_few():
    for depth in (0, 1, 2):
        assert filled([("en", " .\n\t"), ("de", "")], depth)[0] == {}
        assert filled([("en", None)], depth)[0] == {}
        got = {k[1:]: c for k, c in filled([("en", "a b. \n"), ("de", ".")], depth)[0].items()}
        assert got == [{("en", "", "a"): 1, ("en", "", "b"): 1}, {("en", "a", "b"): 1}, {}][depth]
