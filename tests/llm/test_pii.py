"""Personal data: patterns against plain regular expressions, the field against every segmentation."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from sparkloom.llm import pii

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    ok = (
        lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    )
    return sorted((k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if ok[k](m[0]))


def test_patterns_against_plain_ones():
    rng, n = random.Random(2), 0
    for i in range(20_000):
        alphabet = "0123456789 -.+" if i % 3 else "aZ0019255.@-+ ()_é"
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        want = brute(text)
        assert sorted(pii.pattern_spans(text)) == want
        n += len(want)
    assert n > 2000


@pytest.mark.parametrize("part", ["a", "1", "1.", "@a", "a@", "1 ", "+1 ", "@a.b ", "a.b@c.", "+1", "%"])
def test_patterns_are_linear(part):
    began = time.time()
    pii.pattern_spans(part * 300_000)
    pii.stretches(part * 300_000)
    assert time.time() - began < 20


def segmentations(n, spans):
    """Every way to cut n tokens into single ones and the given spans, with kinds."""
    if n == 0:
        yield []
        return
    for rest in segmentations(n - 1, spans):
        yield rest + [(n - 1, n, 0)]
    for a, b in spans:
        if b == n:
            for rest in segmentations(a, spans):
                for k in range(1, len(pii.KINDS) + 1):
                    yield rest + [(a, b, k)]


def score(t, cut, w, f):
    total, last = 0.0, 0
    for a, b, k in cut:
        total += f[last, k] + (t.features(np.array([a]), np.array([b]))[0] @ w[:, k - 1] if k else 0.0)
        last = k
    return total


@pytest.mark.parametrize("s", ["1.2", "a@b", "+1 2", "12-3"])
def test_decoding_and_likelihood_against_all_segmentations(s):
    rng = np.random.default_rng(5)
    t = pii.Tokens(s)
    spans = list(zip(*(x.tolist() for x in t.spans())))
    n_features = t.features(np.array([0]), np.array([1])).shape[1]
    for _ in range(3):
        w, f = rng.normal(size=(n_features, 4)), rng.normal(size=(5, 5))
        every = list(segmentations(t.n, spans))
        scores = [score(t, c, w, f) for c in every]
        place = t.run["chars"]
        best = every[int(np.argmax(scores))]
        assert pii.SemiField(w, f).best(s) == [(k - 1, place[a], place[b]) for a, b, k in best if k]
        gold = [(k - 1, int(place[a]), int(place[b])) for a, b, k in best if k]
        value, gw, gf = pii.Lot([(s, gold)]).likelihood(w, f)
        assert np.isclose(value, max(scores) - np.log(np.exp(scores).sum()))
        p = np.exp(scores - np.log(np.exp(scores).sum()))
        phi = lambda c: sum((np.outer(t.features(np.array([a]), np.array([b]))[0], np.arange(1, 5) == k) for a, b, k in c if k), np.zeros_like(w))
        assert np.allclose(gw, phi(best) - sum(x * phi(c) for x, c in zip(p, every)))
        step = 1e-5
        up = f.copy()
        up[0, 2] += step
        assert np.isclose((pii.Lot([(s, gold)]).likelihood(w, up)[0] - value) / step, gf[0, 2], atol=1e-3)


def made(rng, kind):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        return f"{rng.choice(['anna', 'bob.k', 'info'])}.{d(2)}@mail{rng.randint(1, 9)}.example.com"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 3:
        return f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"
    while True:
        c = "4" + d(15)
        if luhn(c):
            return c


@pytest.fixture(scope="module")
def corpus():
    rng, rows = random.Random(8), []
    for i in range(160):
        hit = made(rng, i % 4) if i % 2 or i % 8 < 4 else ""
        rows.append((i, f"some words, {rng.choice(['v1.2.3', 'in 2019', 'page 12', 'GNU 3.'])} and then {hit} more of it.\nEnd"))
    return rows


def test_field_adds_other_spellings_and_leaves_numbers_alone(spark, corpus):
    rows = corpus + [
        (900, "pay 4111-1111.1111 1111 no"), (901, "Write to bob.k.12(at)mail3.example.com today"), (902, "ring 001 (555) 123-4567 now"), (903, "On 2024-01-05 version 10.0.19041.1 had 1,234.56 of 99999999 (12)"),
        (904, "card 4111.1111.1111.1111 here"), (905, None), (906, ""), (None, "é 😀 1.2.3.4 x@y.z"), (None, "é 😀 1.2.3.4 x@y.z"), (908, "7 " * 30_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS spans", "text AS row")
    got = pii.find_pii(docs).withColumn("all", pii.spans_text(pii.F.col("spans"))).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "row", "base_spans", "spans", "all"}
    of = {r["doc_id"]: r for r in got}
    for r in got:
        assert [tuple(s) for s in r["base_spans"]] == brute(r["text"] or "")
        assert set(map(tuple, r["base_spans"])) <= set(map(tuple, r["spans"]))
        if (r["doc_id"] or 0) < 900:
            assert r["spans"] == r["base_spans"]
    assert of[901]["all"] == "email:9:38" and of[902]["all"] == "phone:5:23" and of[904]["all"] == "card:5:24"
    assert of[903]["all"] == of[905]["all"] == of[906]["all"] == of[908]["all"] == "" and of[None]["all"] == "email:12:17,ip:4:11"


def test_without_patterns_nothing_is_learnt(spark):
    docs = spark.createDataFrame([(1, "call 001 (555) 123-4567"), (2, None)], "doc_id long, text string")
    assert [r["spans"] for r in pii.find_pii(docs).collect()] == [[], []]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_op12_against_brute_force(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = pii.op12(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in want) for k in range(4))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
        assert itertools.chain(want) and (want or r["spans"] == "")
