"""Context and shared tokens against lists of whole texts."""

import random

import pytest

from sparkloom.operators import inspection, stats


def corpus(rng):
    """Texts whose positions have gaps, repeats and far jumps."""
    meta = []
    for t in range(12):
        pos = 0
        for i in range(rng.choice([1, 5, 90, 700])):
            pos += rng.choice([0, 1, 1, 1, 2, 7, 150])
            meta.append((t, "s", pos, i, f"{rng.choice('abcdefg')}{i} "))
    return meta


@pytest.mark.parametrize("window", [0, 3, 20, 70])
def test_context_by_place_with_gaps(spark, window):
    rng = random.Random(window)
    meta = corpus(rng)
    rows = [(f, t, "s", p, tok, float(i)) for i, (t, _, p, _, tok) in enumerate(meta) for f in range(2) if rng.random() < 0.1] + [(1, 99, "s", 4, "own", 1.0), (1, 0, "s", 10**6, "far", 2.0)]
    m = spark.createDataFrame(meta, "text_id long, source string, token_pos long, token_id long, token_str string").repartition(5)
    a = spark.createDataFrame(rows, "feature_id long, text_id long, source string, token_pos long, token_str string, activation double")
    lists = {}
    for t, _, p, _, tok in meta:
        lists.setdefault(t, []).append((p, tok))
    lists = {t: [tok for _, tok in sorted(x)] for t, x in lists.items()}
    got = stats.with_context(a, m, window).collect()
    assert len(got) == len(rows)
    for r in got:
        x, p = lists.get(r["text_id"], []), r["token_pos"]
        assert (r["left_context"], r["right_context"]) == ("".join(x[max(0, p - window) : p]), "".join(x[p + 1 : p + 1 + window]))
        assert r["center_token"] == (x[p] if p < len(x) else r["token_str"])


@pytest.mark.parametrize("sent", [0, 1000])
def test_context_by_position(spark, sent, monkeypatch):
    monkeypatch.setattr(stats, "_SENT", sent)  # stretches sent to all tasks, and joined
    rng = random.Random(9)
    meta = [m for m in {(t, p): (t, s, p, i, w) for t, s, p, i, w in corpus(rng)}.values()]
    m = spark.createDataFrame(meta, "text_id long, source string, token_pos long, token_id long, token_str string")
    rows = [(1, t, p + rng.choice([0, 1])) for t, _, p, _, _ in meta if rng.random() < 0.1] + [(1, 99, 4)]
    got = stats.context_by_position(spark.createDataFrame(rows, "feature_id long, text_id long, token_pos long"), m, 5).collect()
    assert len(got) == len(rows) - 1
    at = {(t, p): w for t, _, p, _, w in meta}
    for r in got:
        join = lambda ps: "".join(at.get((r["text_id"], p), "") for p in ps)
        p = r["token_pos"]
        assert (r["left_context"], r["center_token"], r["right_context"]) == (join(range(p - 5, p)), join([p]), join(range(p + 1, p + 6)))


@pytest.mark.parametrize("lot", [2, 1_000_000])
def test_shared_tokens(spark, lot, monkeypatch):
    monkeypatch.setattr(inspection, "_SENT_PAIRS", lot)
    rng = random.Random(3)
    acts = [(rng.randrange(4), rng.randrange(6), rng.randrange(9), rng.choice(["x", "y", None])) for _ in range(400)]
    wanted = [(0, 1), (5, 2), (2, 5), (3, 4), (7, 8), (1, 60)]
    df = spark.createDataFrame([(t, p, f, w, 1.0) for t, p, f, w in acts], "text_id long, token_pos long, feature_id long, token_str string, activation double")
    got = {(r[0], r[1], r[2]): r[3] for r in inspection.shared_tokens(df, spark.createDataFrame(wanted, "feature_i long, feature_j long")).collect()}
    want = {}
    for i, j in wanted:
        of = {f: {(t, p) for t, p, g, _ in acts if g == f} for f in (i, j)}
        both = of[i] & of[j]
        if both:
            want[i, j, None] = len(both)
        for t, p, f, w in acts:
            if f in (i, j) and (t, p) in both:
                want[i, j, w or "None"] = want.get((i, j, w or "None"), 0) + 1
    assert got == want
