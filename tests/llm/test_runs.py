"""Periodic runs against trying every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np

from sparkloom.llm import runs


def brute(x, least=24):
    n, out = len(x), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, 3 * p):
                out.setdefault((s, i + p), p)
            i += i == s
    return sorted(((s, e, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    out = [w for i, w in enumerate(words) if not any(s + p <= i < e for s, e, p in found)]
    return " ".join(out)


def sequences(rng, n):
    """Few letters, repeated blocks, words of the Fibonacci kind, and powers of powers with faults."""
    for i in range(n):
        if i % 4 == 0:
            yield [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 150))]
        elif i % 4 == 1:
            x = []
            while len(x) < rng.randint(20, 300):
                b = [rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(1, 40))]
                x += (b * rng.randint(1, 9))[: rng.randint(1, 200)]
            yield x
        elif i % 4 == 2:
            a, b = [0], [0, 1]
            for _ in range(rng.randint(3, 9)):
                a, b = b, b + a
            yield b * rng.randint(1, 3)
        else:
            b = [rng.randint(0, 1) for _ in range(rng.randint(1, 5))]
            x = ((b * rng.randint(1, 8) + [rng.randint(0, 2)]) * rng.randint(2, 6))[:400]
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.randint(0, 2)
            yield x


def test_all_runs_are_found():
    total = 0
    for x in sequences(random.Random(1), 1200):
        want = brute(x)
        assert [tuple(r) for r in runs.find_runs(np.array(x)).tolist()] == want
        total += len(want)
    assert total > 1000


def test_range_successors():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, 200)
    r = runs.Repeats(x)
    for k in range(4):
        i = np.arange(0, 200 - (1 << k) + 1)
        lo, hi = r.same(k, i)
        at = rng.integers(0, 260, len(i))
        less, n = r.below(lo, hi, at), hi - lo
        for j, start in enumerate(i):
            want = [p for p in range(200 - (1 << k) + 1) if (x[p : p + (1 << k)] == x[start : start + (1 << k)]).all()]
            assert n[j] == len(want) and less[j] == sum(p < at[j] for p in want)
            if less[j] < n[j]:
                assert r.nth(lo[j : j + 1], hi[j : j + 1], less[j : j + 1])[0] == min(p for p in want if p >= at[j])


def test_texts_of_a_lot_stay_apart(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("wxyz"[v % 4] * (v + 1) for v in x), i) for i, x in enumerate(sequences(rng, 150))]
    same = "a b c " * 5  # not long enough alone, twice in a row would be
    rows += [(1000, same.strip(), 1), (1001, same.strip(), 2), (1002, None, 3), (1003, "", 4), (1004, " \t\n", 5), (None, "q " * 40, 6), (None, "q " * 40, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    for lot in (1, 1 << 17):
        got = runs.periodic_runs(docs.drop("runs").withColumnRenamed("doc_id", "row"), lot=lot).collect()
        assert len(got) == len(rows)
        for r in got:
            words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
            want = brute(words)
            assert [(x["start"], x["start"] + x["length"], x["period"]) for x in r["runs"]] == want
            assert r["collapsed"] == collapsed(words, want)
    assert runs.periodic_runs(docs).columns == ["doc_id", "text", "runs", "collapsed"]  # a clashing column is replaced
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    words = ["a"] * 100_000 + [f"w{i % 30_000}" for i in range(100_000)] + ["b" * 100_000]
    got = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in got["runs"]] == [(0, 100_000, 1), (100_000, 100_000, 30_000)]
    assert len(got["collapsed"].split()) == 30_002


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op13_against_brute_force(spark, data):
    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").collect() if len(r["text"] or "") < 12_000]
    got = {r["doc_id"]: r for r in runs.op13(spark, data).collect()}
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    some = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want, r = brute(words), got[d["doc_id"]]
        best = None
        for s, e, q in want:
            if best is None or (e - s) * best[2] > best[1] * q:
                best = (s, e - s, q)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(want), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == digest("".join(f"{s},{e - s},{q}\n" for s, e, q in want)) and r["collapsed_sha256"] == digest(collapsed(words, want))
        some += bool(want)
    assert some > 5
