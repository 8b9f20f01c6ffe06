"""Edge cases of each operator, and brute force or round trips where SQL has no say."""

import collections
import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontaminate, language, mixing, neighbours, ngram_join, secrets, shared, toxicity, url_filters, warc

DOC = "doc_id long, text string, source string, lang string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, l) for i, t, s, l in rows], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


HARD = [None, "", "   \n\t ", "one", "a b c d", "É é ß   x y", "A" * 5000 + " b " * 3000]


# --- shared ------------------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    texts = [t for t in HARD if t] + ["ab cd", "abc d", "a bcd", "AB\x0bcd\x0c"]
    seen = {}
    for t in texts:
        h = shared.word_hashes(t).tolist()
        assert len(h) == len(words(t))
        for w, x in zip(words(t), h):
            assert seen.setdefault(x, w) == w
    assert len(seen) == len({w for t in texts for w in words(t)})


def test_n_words(spark):
    got = [r[0] for r in docs_of(spark, [(i, t, "s", "x") for i, t in enumerate(HARD)]).orderBy("doc_id").select(shared.n_words(F.col("text"))).collect()]
    assert got == [len(words(t)) for t in HARD]


def test_components_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, x) for x in range(101, 140)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 10 for i in range(10, 41)) and all(got[x] == 100 for x in range(100, 140))
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_paths_in_random_order(spark):
    rng = random.Random(6)
    a, b = rng.sample(range(-(10**12), 10**12), 400), rng.sample(range(10**13, 10**14), 120)
    edges = [*zip(a, a[1:]), *zip(b, b[1:])]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(a, min(a)), **dict.fromkeys(b, min(b))}


# --- 1 WARC ------------------------------------------------------------------------------


def test_warc_round_trip_and_members(spark, tmp_path):
    big = "xé" * 600
    rows = [(1, "http://a/", big), (5, None, big), (3, "http://b/ \x00c", big), (4, "http://s/", "small"), (6, "http://s/", "small"), (7, "u", None), (8, "u", ""), (5, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).select("page_id", "url", "html")
    at = f"file://{tmp_path}/w"
    index = warc.normalise(warc.write_monolithic(warc.with_record_types(pages), f"{at}/m"), f"{at}/n")
    got = sorted(warc.read_by_index(index).collect(), key=lambda r: r["page_id"])
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "revisit", 5), (3, "revisit", 5), (4, "response", None), (5, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)]
    assert all(r["payload_digest"] == hashlib.sha1((dict((x[0], x[2]) for x in rows)[r["page_id"]] or "").encode()).hexdigest() for r in got)
    # every member inflates alone; the whole inflates to what the monolithic stream holds, but for headers' case
    for f in (tmp_path / "w/n").glob("*.gz"):
        data = f.read_bytes()
        for line in (tmp_path / "w/n" / (f.name + ".idx")).read_text().splitlines():
            offset, length = map(int, line.split("\t")[:2])
            assert gzip.decompress(data[offset : offset + length]).startswith(b"WARC/1.1\r\n")
        whole = gzip.decompress((tmp_path / "w/m" / f.name.split("-", 1)[1]).read_bytes())
        assert [p for _, p in warc.read_records(io.BytesIO(whole))] == [p for _, p in warc.read_records(io.BytesIO(gzip.decompress(data)))]


def test_warc_empty_and_broken(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_by_index(warc.normalise(warc.write_monolithic(warc.with_record_types(none), f"file://{tmp_path}/m"), f"file://{tmp_path}/n")).count() == 0
    cut = gzip.compress(warc.record_bytes(1, "u", b"payload" * 100, "00" * 20, 700, None))[:-20]
    with pytest.raises(EOFError):
        list(warc.read_records(io.BufferedReader(warc._Inflated(io.BytesIO(cut)))))


def test_warc_of_a_very_large_record(spark, tmp_path):
    big = "0123456789abcdef" * (1 << 18)
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "v", big + "x")], "page_id long, url string, html string")
    got = warc.read_by_index(warc.normalise(warc.write_monolithic(warc.with_record_types(pages), f"file://{tmp_path}/m"), f"file://{tmp_path}/n")).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in got) == [(1, "revisit", 1 << 22), (2, "response", 1 << 22), (3, "response", (1 << 22) + 1)]


# --- 2 URL filters -----------------------------------------------------------------------


def test_url_filters_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "x.d.org", None]
    captures = [(i, h and f"http://u@{h.upper()}:80/p?q", f"2023-0{rng.randrange(1, 9)}-1{rng.randrange(10)}") for i, h in enumerate(rng.choices(hosts, k=120))] + [(200, "no url", "2023-03-01"), (201, "http://a.com/", None)]
    entries = [(rng.choice(hosts[:5]), rng.choice(["p", "q"]), f"2023-0{rng.randrange(1, 9)}-0{rng.randrange(1, 10)}", rng.choice(["add", "remove"])) for _ in range(40)] + [(None, "p", "2023-01-01", "add")]
    c = spark.createDataFrame(captures, "page_id long, url string, d string").select("page_id", "url", F.to_date("d").alias("fetched_at"), F.lit(1).alias("blocked"))
    e = spark.createDataFrame(entries, "pattern string, category string, d string, action string").withColumn("listed_at", F.to_date("d"))
    got = {r["page_id"]: r for r in url_filters.filter_captures(c, e).collect()}
    state = collections.defaultdict(dict)  # (pattern, category) -> day -> action
    for p, k, d, a in entries:
        state[p, k][d] = max(a, state[p, k].get(d, ""))
    for i, url, day in captures:
        host = (re.match(r"http://(?:u@)?([^:/]*)", url).group(1).lower() if url and url.startswith("http") else None) or None
        best = None
        if host and day:
            parts = host.split(".")
            for n in range(max(1, len(parts) - 1)):
                p = ".".join(parts[n:])
                on = sorted(k for (q, k), days in state.items() if q == p and [a for d, a in sorted(days.items()) if d <= day][-1:] == ["add"])
                if on:
                    best = best or (p, on[0])
        assert (got[i]["pattern"], got[i]["category"], got[i]["blocked"]) == ((*best, True) if best else (None, None, False)), (i, url, day)
    assert url_filters.filter_captures(c.limit(0), e).count() == 0 and url_filters.filter_captures(c, e.limit(0)).where("blocked").count() == 0


def test_addresses_null_categories_and_repeated_captures(spark):
    c = spark.createDataFrame([(1, "http://10.0.3.4/"), (1, "http://10.0.3.4/"), (2, "http://[::1]:8/x"), (3, "http://a.b.c/")], "page_id long, url string").withColumn("fetched_at", F.to_date(F.lit("2023-05-01")))
    e = spark.createDataFrame([("3.4", "p"), ("[::1]", None), ("[::1]", "p"), ("b.c", None)], "pattern string, category string").withColumns({"listed_at": F.to_date(F.lit("2023-01-01")), "action": F.lit("add")})
    got = sorted(((r["page_id"], r["host"], r["blocked"], r["pattern"], r["category"]) for r in url_filters.filter_captures(c, e).collect()))
    assert got == [(1, "10.0.3.4", False, None, None)] * 2 + [(2, "[::1]", True, "[::1]", None), (3, "a.b.c", True, "b.c", None)]


# --- 3 n-gram join -----------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    shared_passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 90, 300]))] + (shared_passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate(HARD)] + [(n + 20 + i, t) for i, t in enumerate(HARD)] + [(n + 50, " ".join(shared_passage))]
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == want


def test_ngram_join_repeats_and_nulls(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(7, t), (7, t), (9, t), (None, t), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 7, 4), (7, 7, 4), (9, 7, 4), (None, None, 4), (3, 3, 0), (4, 4, 0)], key=str)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_ngram_join_of_a_chain_and_of_groups_beyond_a_bin(spark, monkeypatch):
    rng = random.Random(3)
    run = [f"c{rng.randrange(10**6)}" for _ in range(200 + 30)]
    rows = [(i, " ".join(run[i : i + 30])) for i in rng.sample(range(200), 200)]  # each like the next only
    base = [f"w{i}" for i in range(80)]
    for i in range(1000, 1300):  # near copies, some too far from the base to link
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 4])):
            w[rng.randrange(80)] = rng.choice(["x", "y", f"z{i}"])
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for side, weight, hot in ((1024, 2_000_000, 8), (32, 2_000_000, 1), (1024, 4000, 0)):
        monkeypatch.setattr(ngram_join, "SIDE", side)
        monkeypatch.setattr(ngram_join, "WEIGHT", weight)
        monkeypatch.setattr(ngram_join, "HOT", hot)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
        assert got == want


def test_tree_search_is_complete():
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 200, 300)
    points = np.stack([np.bincount(rng.integers(0, ngram_join.GROUPS, n), minlength=ngram_join.GROUPS) for n in sizes])
    points[150:] = points[:150] + (rng.random((150, ngram_join.GROUPS)) < 0.05)
    sizes = points.sum(axis=1)
    tree = ngram_join.Tree(points, sizes)
    for i in range(0, 300, 7):
        bound = np.minimum(points, points[i]).sum(axis=1)
        assert set(tree.search(points[i], int(sizes[i]))[0]) == set(np.flatnonzero(9 * bound >= 4 * (sizes[i] + sizes)))


def test_bounds_hold_across_sizes():
    rng = np.random.default_rng(1)
    for n in (3, 80, 900, 20_000):
        a = shared.sorted_set(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        b = shared.sorted_set(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n * 2).astype(np.uint64)]))
        assert ngram_join.bound_of(ngram_join.point_of(a), ngram_join.point_of(b)) >= ngram_join.overlap(a, b)


# --- 4 neighbours ------------------------------------------------------------------------


def test_neighbours_recall_and_exclusions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] + [1.0] * 15), (None, [1.0] * 16), (704, []), (5, x[5].tolist())]
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)))
    got = collections.defaultdict(list)
    for r in neighbours.search(v, v.where(F.col("vec_id") % 100 == 0), shortlist=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({i for i, _ in got[q]} & set(np.argsort(d)[:10]))
        assert all(s == pytest.approx(d[i], rel=1e-12) for i, s in got[q])
    assert hit >= 0.9 * 60 and set(got) == set(range(0, 600, 100))
    few = v.where("vec_id < 3")
    assert neighbours.search(few, few.where("vec_id = 0")).count() == 2
    assert neighbours.search(v.limit(0), v.limit(0)).count() == 0


def test_one_odd_vector_and_long_ones(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=5000).tolist()) for i in range(3)] + [(2000, [1.0])]
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = neighbours.search(v, v.where(F.col("vec_id") % 100 == 0)).collect()
    assert neighbours.width_of(v) == 8 and sorted({r["query_id"] for r in got}) == [0, 100, 200] and len(got) == 30


# --- 5 language --------------------------------------------------------------------------


def test_language_of_words_and_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    field = language.train_field(docs.where(shared.crc_mod("doc_id", 4) != 2), docs_each=40)
    got = language.identify(docs.where(shared.crc_mod("doc_id", 4) == 2).withColumn("score", F.lit("clash")), field).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars > 500").collect()}
    mixed = language.label_words(field, " ".join(texts["de"].split()[:20]) + " " + " ".join(texts["es"].split()[:20]))
    assert collections.Counter(l for l, _ in mixed[:20]).most_common(1)[0][0] == "de" and collections.Counter(l for l, _ in mixed[-20:]).most_common(1)[0][0] == "es"
    hard = language.identify(docs_of(spark, [(i, t, "s", "x") for i, t in enumerate([*HARD, "123 !!", "…"])]), field)
    kinds = {r["doc_id"]: r["lang_pred"] for r in hard.collect()}
    assert [k for k in sorted(kinds) if kinds[k] == "und"] == [0, 1, 2, 7, 8]
    assert language.identify(docs.limit(0), field).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.limit(3), language.train_field(docs.limit(0))).collect()} == {"und"}


def test_every_language_is_fitted(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(70):  # a language of two letters each, of 6 texts or, for the last five, of 2
        a, b = letters[i % 26], letters[(i * 7 + 1 + i // 26) % 26]
        rng = random.Random(i)
        rows += [(100 * i + j, " ".join("".join(rng.choices([a, b, chr(0x4E00 + i)], k=5)) for _ in range(12)), "s", f"l{i:02}") for j in range(6 if i < 65 else 2)]
    field = language.train_field(docs_of(spark, rows), docs_each=2)
    assert field.labels == [f"l{i:02}" for i in range(70)]
    got = language.identify(docs_of(spark, rows).where("lang >= 'l65'"), field).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_a_language_of_repeated_rows_keeps_its_label(spark):
    texts = [(i, f"{w} kala vesi {w} talo", "s", w) for i, w in enumerate(f"r{chr(97 + j)}" for j in range(12))]
    rows = docs_of(spark, texts).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("_n").unionByName(docs_of(spark, [(90, "el perro come", "s", "es")]))
    assert language.train_field(rows, docs_each=3).labels == sorted(["es", *(r[3] for r in texts)])


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    f = language.Field(["a", "b", "c"])
    f.transitions = rng.normal(size=(3, 3))
    em = np.zeros((1, language.CHAIN, 3))
    em[0, :4] = rng.normal(size=(4, 3))
    p, moves = f.posteriors(em, np.array([4]))
    want, pairs, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(sum(em[0, i, y[i]] for i in range(4)) + sum(f.transitions[y[i], y[i + 1]] for i in range(3)))
        z += w
        for i in range(4):
            want[i, y[i]] += w
        for i in range(3):
            pairs[y[i], y[i + 1]] += w
    assert np.allclose(p[0, :4], want / z) and np.allclose(moves, pairs / z) and not p[0, 4:].any()


def test_marginals_run_over_whole_texts():
    rng = np.random.default_rng(2)
    f = language.Field(["a", "b", "c"])
    f.transitions = rng.normal(size=(3, 3)) * 2
    words = np.array([1, 64, 65, 300, 7, 128])
    em = rng.normal(size=(words.sum(), 3)) * 2
    got, at, move = f.marginals(em, words), 0, np.exp(f.transitions)
    for n in words:
        e = np.exp(em[at : at + n])
        ahead, back = [e[0]], [np.ones(3)]
        for i in range(1, n):
            a = (ahead[-1] @ move) * e[i]
            ahead.append(a / a.sum())
        for i in range(n - 1, 0, -1):
            b = move @ (e[i] * back[0])
            back.insert(0, b / b.sum())
        p = np.array(ahead) * np.array(back)
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def test_texts_are_scored_each_for_itself(monkeypatch):
    rng = random.Random(3)
    f = language.Field(["a", "b"])
    f.weights[:] = np.random.default_rng(1).normal(size=f.weights.shape)
    texts = [" ".join("".join(rng.choices("abcé1.", k=rng.randrange(1, 9))) for _ in range(n)) for n in (1, 5, 90, 0, 700, 3)] + ["...", ""]
    mass, n = f.label_masses(texts)
    for t, m, k in zip(texts, mass, n):
        alone, words_ = f.label_masses([t])
        assert np.allclose(alone[0], m) and words_[0] == k == round(m.sum())
    monkeypatch.setattr(language, "_PIECE", 600)  # a word at a cut sees less of its neighbour
    assert f.label_masses(texts)[1].tolist() == n.tolist()


def test_a_language_of_long_texts_only_is_fitted(spark):
    field = language.train_field(docs_of(spark, [(1, "kala vesi talo " * 400, "s", "fi"), (2, "el perro come", "s", "es")]), docs_each=5, chars=500)
    assert field.labels == ["es", "fi"]
    got = language.identify(docs_of(spark, [(1, "kala vesi", "s", None), (2, "perro " * 90_000, "s", None)]).withColumn("_letters", F.lit(1)), field)
    assert {r["doc_id"]: (r["lang_pred"], r["_letters"]) for r in got.collect()} == {1: ("fi", 1), 2: ("es", 1)}


# --- 6 toxicity --------------------------------------------------------------------------


def test_index_is_exact():
    rng = random.Random(3)
    examples = [(i, rng.randrange(2), dict(collections.Counter(rng.choices(range(30), k=rng.randrange(0, 9))))) for i in range(400)]
    index = toxicity.Index([f"t{i}".encode() for i in range(30)], examples, {0: 1.0, 1: 1.0})
    common = [(i, y, dict(collections.Counter(rng.choices(range(30), weights=[60 // (j + 1) + 1 for j in range(30)], k=9)))) for i, y, _ in examples]
    skewed = toxicity.Index([f"t{i}".encode() for i in range(30)], common, {0: 1.0, 1: 1.0})
    assert len(index.most) == 0 and 0 < len(skewed.most) < 30  # short lists only, then lists of both kinds
    for index in (index, skewed):
        full = index.matrix
        for _ in range(60):
            q = dict(collections.Counter(rng.choices(range(30), k=rng.randrange(1, 6))))
            s = (index.vector(q) @ full)[: len(index.ids)]
            place, near = index.nearest(q)
            hit = np.flatnonzero(s)
            best = hit[np.lexsort((hit, -np.round(s[hit], 12)))][: toxicity.NEAREST]
            assert list(place) == list(best) and np.allclose(near, s[best])


def test_long_lists_have_block_maxima():
    rng = random.Random(8)
    words = [60 // (j + 1) + 1 for j in range(30)]
    examples = [(i, rng.randrange(2), dict(collections.Counter(rng.choices(range(30), weights=words, k=9)))) for i in range(400)]
    index = toxicity.Index([f"t{i}".encode() for i in range(30)], examples, {0: 1.0, 1: 1.0})
    full = index.matrix
    long = [t for t in range(30) if (full[t] > 0).sum() > toxicity.LONG]
    assert 0 < len(long) < 30 and [t for t in range(30) if index.row[t] >= 0] == long
    for t in long:
        assert np.array_equal(index.most[index.row[t]], full[t].reshape(-1, toxicity.BLOCK).max(1))


def test_toxicity_of_labels_of_many_values(spark):
    """Any label above 0 is 1, any other 0, however many values there are."""
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words here", "s", "en") for i in range(80)]
    index = toxicity.train_index(docs_of(spark, rows), spark.createDataFrame([(i, i if i % 2 else -i) for i in range(80)], "doc_id long, toxic int"), each=15)
    assert len(index.ids) == 30 and index.labels.sum() == 15 and set(index.weight) == {40 / 15}


def test_toxicity_on_planted_words(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choices([f"w{j}" for j in range(50)], k=40) + (["Vile!", "awful,"] if bad else [])), "s", "en"))
        labels.append((i, int(bad)))
    docs = docs_of(spark, rows + [(900, None, "s", "en"), (901, "", None, None), (None, "vile awful", "s", "en")])
    index = toxicity.train_index(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, index).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels) and got[900]["score"] == got[901]["score"] < 0.5 < got[None]["score"] and got[0]["evidence"]
    assert toxicity.score_toxicity(docs.limit(0), index).count() == 0
    empty = toxicity.train_index(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, empty).where("score < 0 or score > 1").count() == 0


def test_rare_toxic_words_of_few_examples_count(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(50)], k=40) + (["vile" if i % 8 else "awful"] if i % 4 == 0 else [])), "s", "en") for i in range(28)]
    index = toxicity.train_index(docs_of(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, toxic int"))
    assert {w for _, t, *_ in rows for w in t.split()} == {t.decode() for t in index.terms}
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of(spark, [(1, "so w1 vile w2", "s", "en"), (2, "w3 w1 awful", "s", "en"), (3, "w3 w1 w2", "s", "en")]), index).collect()}
    assert min(got[1], got[2]) > got[3]


def test_toxicity_of_ties_repeats_and_long_texts(spark):
    rows = [(i, "vile words here" if i % 2 else "kind words here", "s", "en") for i in range(40)]
    index = toxicity.train_index(docs_of(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"), each=12)
    got = toxicity.score_toxicity(docs_of(spark, [(1, "so vile", "s", "en")] * 3 + [(2, "kind " * 90_000, "s", "en")]).withColumn("evidence", F.lit("clash")), index).collect()
    assert len(index.ids) == 24 and len({(r["score"], tuple(r["evidence"])) for r in got if r["doc_id"] == 1}) == 1
    assert {(r["doc_id"], r["predicted"]) for r in got} == {(1, 1), (2, 0)}


# --- 7 mixing ----------------------------------------------------------------------------


def test_mixing_targets_and_limits(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(300)] + [(i, None, "empty", "x") for i in range(300, 303)] + [(5, "x y", "a", "x")] * 2
    docs = docs_of(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(docs).collect()
    total = sum(r["size"] for r in got)
    by = collections.defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] and (r["position"] is None) == (r["taken"] == 0)
    for r in got:
        assert abs(by[r["source"]] - r["target"]) <= 0.5
    assert sum(by.values()) == pytest.approx(1.5 * total, abs=3) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    level = {r["source"]: r["target"] for r in got}
    weights = dict(zip(["a", "b", "c", "empty", None], [3, 1, 2, 3, 1]))
    open_ = {s: t / weights[s] for s, t in level.items() if t < 2 * next(r["source_size"] for r in got if r["source"] == s) - 1e-9}
    assert max(open_.values()) == pytest.approx(min(open_.values()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    ordered = [r["position"] for r in mixing.curriculum_order(mixing.mix_sources(docs), 1).collect() if r["position"] is not None]
    assert ordered == sorted(ordered)


def test_every_copy_has_its_place(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), "a", "x") for i in range(60)] + [(i, " ".join(["w"] * 20), "b", "x") for i in range(100, 400)] + [(500, None, "a", "x")]
    mixed = mixing.mix_sources(docs_of(spark, rows))
    whole = {r["doc_id"]: r for r in mixed.collect()}
    copies = [r for r in mixing.ordered_copies(mixed, 1).collect() if r["taken"]]
    assert [r["position"] for r in copies] == sorted(r["position"] for r in copies) and len({(r["doc_id"], r["copy"]) for r in copies}) == len(copies)
    by = collections.Counter()
    for r in copies:
        by[r["doc_id"]] += r["taken"]
        assert 0 < r["taken"] <= r["size"]
    assert all(by[i] == r["taken"] for i, r in whole.items())
    a = sorted((r for r in copies if r["source"] == "a"), key=lambda r: r["position"])
    size, target = a[0]["source_size"], a[0]["target"]
    assert target == 2 * size and all(r["taken"] == r["size"] for r in a) and len(a) == 120
    # weight 1.5 falling to 0.5: the demand up to t is target * (1.5 t - t^2 / 2), in step with the words laid out
    at = 0
    for r in a:
        t = r["position"]
        assert target * (1.5 * t - t * t / 2) == pytest.approx(at + r["taken"] / 2)
        at += r["taken"]
    assert at == target and a[-1]["position"] > 0.95


# --- 8 secrets ---------------------------------------------------------------------------


def brute_strong(text):
    text, out = text or "", []
    for kind, pattern, least in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[1])))


SECRET_TEXTS = [*HARD, 'PassWord = "abc123def" token:abc password: token: abcdefgh', "é🙂 api_key='AKIA" + "Z9" * 9 + "' " + "0a" * 13, "AKIASHORT AKIA" + "A" * 30, "secret=secret=secretsecret token=AKIA" + "B" * 20, "user: bob " + "x9" * 12 + " https://h.example/p db.host.io:5432", "login=amy token=abcdefg " + "https://only.example/", ("q9" * 12 + " ") * 40, "deadbeef" * 4 + "passwd:deadbeefdeadbeefdeadbeef"]


def test_strong_spans_against_brute_force(spark):
    df = docs_of(spark, [(i, t, "s", "x") for i, t in enumerate(SECRET_TEXTS)])
    for r in df.select("text", secrets.spans_text(F.array_sort(secrets.strong_spans(F.col("text")))).alias("s")).collect():
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for a, k, b in brute_strong(r["text"]))


def test_weak_candidates_need_company(spark):
    df = docs_of(spark, [(i, t, "s", "x") for i, t in enumerate(SECRET_TEXTS)] + [(5, SECRET_TEXTS[5], "s", "x")]).withColumn("spans", F.lit(0))
    got = {r["doc_id"]: r["s"] for r in secrets.find_secrets(df).select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect()}
    i = SECRET_TEXTS.index("user: bob " + "x9" * 12 + " https://h.example/p db.host.io:5432")
    text = SECRET_TEXTS[i]
    at = text.index("x9")
    assert f"secret:{at}:{at + 24}" in got[i] and "ident:0:9" in got[i] and "endpoint:" in got[i]
    assert got[SECRET_TEXTS.index(("q9" * 12 + " ") * 40)] == ""  # no identifier
    assert secrets.find_secrets(df).count() == len(SECRET_TEXTS) + 1 and secrets.find_secrets(df.limit(0)).count() == 0
    red = {r["doc_id"]: r["t"] for r in secrets.find_secrets(df).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert "x9x9" not in red[i] and red[0] is None and red[3] == "one"


def test_callers_columns_stay(spark):
    df = spark.createDataFrame([(1, "user: bob " + "x9" * 12, 7, "w", 3)], "doc_id long, text string, key long, _weak string, _key int")
    got = secrets.find_secrets(df)
    assert got.columns == ["doc_id", "text", "key", "_weak", "_key", "base_spans", "spans"]
    r = got.collect()[0]
    assert (r["key"], r["_weak"], r["_key"]) == (7, "w", 3) and len(r["spans"]) == 2


# --- 9 decontamination -------------------------------------------------------------------


def brute_tiles(t, i, least):
    ft, fi, out = [True] * len(t), [True] * len(i), []
    while True:
        best = None
        for j in range(len(i)):
            for a in range(len(t)):
                n = 0
                while a + n < len(t) and j + n < len(i) and ft[a + n] and fi[j + n] and t[a + n] == i[j + n]:
                    n += 1
                if n >= least and (best is None or (-n, j, a) < best):
                    best = (-n, j, a)
        if best is None:
            return sorted(out)
        n, j, a = -best[0], best[1], best[2]
        ft[a : a + n], fi[j : j + n] = [False] * n, [False] * n
        out.append((a, j, n))


def test_tiling_against_brute_force():
    rng = random.Random(1)
    as_hash = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    for _ in range(150):
        v = rng.choice([2, 3, 6])
        t, i = ([rng.randrange(v) for _ in range(rng.randrange(n))] for n in (30, 20))
        assert sorted(decontaminate.tiles(as_hash(t), as_hash(i), 3)) == brute_tiles(t, i, 3)


def test_contaminated_passages(spark):
    rng = random.Random(9)
    v = [f"w{i}" for i in range(3000)]
    item = rng.sample(v, 40)
    noise = lambda n: rng.sample(v, n)
    swapped = item[20:] + noise(5) + item[:20]
    rows = [(1, " ".join(noise(200) + item + noise(200)).upper()), (2, " ".join(noise(100) + swapped)), (3, " ".join(noise(300))), (4, None), (5, ""), (6, " ".join(item[:12] + noise(50))), (2, " ".join(noise(100) + swapped)), (None, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "a b"), (12, None), (13, " ".join(noise(30)))], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["n_tiles"]) for r in got) == [("1", 10, 1), ("2", 10, 2), ("2", 10, 2), ("None", 10, 1)]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_by_repeating_repeated_and_nameless_items(spark):
    rng = random.Random(10)
    v = [f"w{i}" for i in range(3000)]
    refrain, short, long, bare = " ".join(rng.sample(v, 10) * 20), " ".join(rng.sample(v, 20)), " ".join(rng.sample(v, 300)), " ".join(rng.sample(v, 30))
    docs = spark.createDataFrame([(1, refrain), (2, short), (3, bare), (4, " ".join(rng.sample(v, 200)))], "doc_id long, text string")
    bench = spark.createDataFrame([(10, refrain), (11, short), (11, f"{short} {long}"), (None, bare)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], str(r["item_id"]), r["item_words"], r["covered_words"]) for r in got) == [(1, "10", 200, 200), (2, "11", 20, 20), (3, "None", 30, 30)]


def test_contaminated_against_brute_force(spark):
    rng = random.Random(12)
    docs, items = [], []
    for i in range(40):
        v = [f"w{j}" for j in range(rng.choice([3, 12, 200]))]
        items.append((i, " ".join(rng.choices(v, k=rng.randrange(1, 25)))))
    for i in range(60):
        w = rng.choices([f"w{j}" for j in range(rng.choice([3, 12, 200]))], k=rng.randrange(0, 40))
        item = rng.choice(items)[1].split()
        docs.append((i, " ".join(w + item[: rng.randrange(len(item) + 1)] + w[:3] + item[-3:])))
    docs.append((60, " ".join(["w1"] * 3000)))
    want = set()
    for d, t in docs[:60]:
        for j, x in items:
            n = sum(z for _, _, z in brute_tiles(t.split(), x.split(), 4))
            if n and n >= 0.5 * len(x.split()):
                want.add((d, j, n))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in got if r["doc_id"] < 60} == want and len(want) > 30


# --- 10 chat -----------------------------------------------------------------------------

CHAT_TEXTS = ["", "</s>[INST] ok [/INST]", "\\", "<\\s>", "a\\b<|x|>", "<<SYS>><</SYS>>", "[INST", "<|>", "é🙂\n\n", "[/INST] </s", "x" * 700]


def test_template_is_reversible():
    for role in ("user", "assistant", "system", "", "tool|>", "a\\"):
        for t in CHAT_TEXTS:
            s, a, b = chat.render(role, t)
            assert [(r, x) for r, x, _, _ in chat.parse(s)] == [(role, t)] and chat.unescape(s[a:b]) == t
    both = "".join(chat.render(r, t)[0] for r in ("user", "assistant") for t in CHAT_TEXTS)
    assert [t for _, t, _, _ in chat.parse(both)] == CHAT_TEXTS * 2


def test_log_folds_back_to_the_turns(spark):
    rows = [(c, i, r, t) for c in (1, 2, None) for i, (r, t) in enumerate(zip(["user", "assistant", None, "system"] * 3, CHAT_TEXTS))]
    rows += [(3, 0, "user", None), (3, 0, "user", None), (3, None, "assistant", "z"), (3, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.reconstruct(chat.events_of(df))).collect()}
    for c in (1, 2, None, 3):
        mine = sorted(((t if t is not None else -1), r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.reconstruct(chat.events_of(df.limit(0)))).count() == 0


def test_a_long_conversation_is_folded_by_many_tasks(spark):
    rows = [(1, i, "user", f"message {i}") for i in range(400)] + [(2, 0, "user", "x")]
    got = chat.reconstruct(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    tasks = got.groupBy(F.spark_partition_id()).agg(F.sum((F.col("conv_id") == 1).cast("int")).alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 400
    # as many as the exchange has partitions, where adaptive execution doesn't join these small ones
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.sum((F.col("conv_id") == 1).cast("int")).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(tasks) == 4 and max(tasks) < 200


def test_fold():
    p = []
    for e in (("delta", 0, 0, "Hallo"), ("delta", 0, 0, " wrld"), ("edit", 6, 10, "world"), ("note", 0, 0, "?"), ("edit", 1, 5, "ello")):
        p = chat.fold(p, *e)
    assert "".join(p) == "Hello world" and "".join(chat.fold(p, "regenerate", 0, 0, "Hi")) == "Hi"
