"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled texts over all their terms, weighted by how well they tell
the classes apart; alike examples share blocks. For a query, lists of at most two blocks' length are added up, and the
largest weight of each longer list in each block bounds what a block can still reach; the best blocks are scored
first, then those that can still enter the nearest.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_mod, written

#: Labelled rows of each class that the index holds at most, and their most characters.
EXAMPLES, EXAMPLE_CHARS = 4000, 20_000
NEAREST, BLOCK = 25, 64
#: Lists of more postings than this have block maxima.
LONG = 2 * BLOCK
#: Examples that the order of the places gathers the others around.
LEADERS = 32

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those of start[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


#: How often a text has each term: a dict, or distinct terms and their counts as arrays.
Counts = dict[int, int] | tuple[np.ndarray, np.ndarray]


def _arrays(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(counts, dict):
        return np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts))
    return counts


def _gathered(term: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, terms: int) -> np.ndarray:
    """An order of the n examples in which alike ones are close, so that blocks' bounds are tight: each goes to the
    nearest of LEADERS of them, and leaders follow one another by nearness. The postings need no order."""
    if n <= LEADERS:
        return np.arange(n)
    lead = np.linspace(0, n - 1, LEADERS).astype(np.int64)
    near = np.empty((n, LEADERS))
    for i, one in enumerate(lead):
        dense, mine = np.zeros(terms), place == one
        dense[term[mine]] = value[mine]
        near[:, i] = np.bincount(place, value * dense[term], n)
    rank, now = np.full(LEADERS, -1), 0
    for i in range(LEADERS):
        rank[now] = i
        now = int(np.where(rank < 0, near[lead[now]], -1.0).argmax())
    best = near.argmax(1)
    return np.lexsort((-near[np.arange(n), best], rank[best]))


class Index:
    """Examples as unit TF-IDF vectors over ``terms``, as postings by term and place. Lists of more than
    LONG postings also have the largest weight in each block of BLOCK places; shorter ones are added up.
    Examples without a term are in none of the blocks. ``scale`` multiplies the weight of each term."""

    def __init__(self, terms: list[bytes], examples: list[tuple], weights: dict[int, float], scale: np.ndarray | None = None):
        """examples: (id, label, counts), counts as for weigh(); weights: how many rows an example of a class stands for."""
        self.terms = {t: i for i, t in enumerate(terms)}
        n = max(1, len(examples))
        df = np.zeros(len(terms), np.int64)
        for e in examples:
            df[_arrays(e[2])[0]] += 1
        self.idf = (np.log((1 + n) / (1 + df)) + 1) * (1.0 if scale is None else scale)
        have = [e for e in examples if len(_arrays(e[2])[0])]
        have.sort(key=lambda e: e[0])
        vectors = [self.weigh(e[2]) for e in have]
        t, w = (np.concatenate([v[i] for v in vectors]) if have else np.empty(0, (np.int64, float)[i]) for i in (0, 1))
        place = np.repeat(np.arange(len(have)), [len(v[0]) for v in vectors])
        del vectors
        alike = _gathered(t, place, w, len(have), len(terms))
        have = [have[i] for i in alike]
        moved = np.empty(len(have), np.int64)
        moved[alike] = np.arange(len(have))
        place = moved[place]
        self.ids = np.array([e[0] for e in have], np.int64)
        self.labels = np.array([e[1] for e in have], np.float64)
        self.weight = np.array([weights[e[1]] for e in have])
        order = np.lexsort((place, t))
        t, self.place, self.value = t[order], place[order], w[order]
        self.first = np.searchsorted(t, np.arange(len(terms) + 1))
        size, blocks = np.diff(self.first), -(-len(have) // BLOCK)
        lists = np.flatnonzero(size > LONG)
        self.row = np.full(len(terms), -1)
        self.row[lists] = np.arange(len(lists))
        # of each long list: where its part of each block begins, and its largest weight there
        self.block_at = np.stack([self.first[i] + np.searchsorted(self.place[self.first[i] : self.first[i + 1]], np.arange(blocks + 1) * BLOCK) for i in lists]) if len(lists) else np.empty((0, blocks + 1), np.int64)
        self.most = np.zeros((len(lists), blocks))
        self.block_sizes = part = np.diff(self.block_at, axis=1)
        if part.any():
            self.most[part > 0] = np.maximum.reduceat(np.append(self.value, 0.0)[_ranges(self.first[lists], size[lists])], np.cumsum(part.ravel()[part.ravel() > 0]) - part.ravel()[part.ravel() > 0])
        bare = [e for e in examples if not len(_arrays(e[2])[0])]
        every = sum(weights[e[1]] for e in examples)
        self.prior = sum(weights[e[1]] for e in examples if e[1]) / every if every else 0.5
        rest = sum(weights[e[1]] for e in bare)
        self.bare = (sum(weights[e[1]] for e in bare if e[1]) + self.prior) / (rest + 1)
        self.steps = None
        del t, w, place, order
        votes = [(self.vote(e[2], skip=j)[0], e[1], weights[e[1]]) for j, e in enumerate(have)]
        self.steps = isotonic(votes)

    @property
    def matrix(self) -> np.ndarray:
        """The vectors as a dense array (terms, places)."""
        out = np.zeros((len(self.terms), -(-len(self.ids) // BLOCK) * BLOCK))
        out[np.repeat(np.arange(len(self.terms)), np.diff(self.first)), self.place] = self.value
        return out

    def weigh(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        t, n = _arrays(counts)
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / (np.sqrt((w**2).sum()) or 1.0)

    def vector(self, counts: Counts) -> np.ndarray:
        v = np.zeros(len(self.idf))
        t, w = self.weigh(counts)
        v[t] = w
        return v

    def nearest(self, counts: Counts, k: int = NEAREST, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples, exactly; ties go to the earlier place. Only
        examples that share a term are listed."""
        t, q = self.weigh(counts)
        row = self.row[t]
        short, row, long_q = row < 0, row[row >= 0], q[row >= 0]
        t, q = t[short], q[short]
        ends = list(zip(self.first[t].tolist(), self.first[t + 1].tolist()))
        value = np.concatenate([self.value[a:b] for a, b in ends]) if ends else np.empty(0)
        places = np.concatenate([self.place[a:b] for a, b in ends]) if ends else np.empty(0, np.int64)
        blocks = self.most.shape[1]
        # what short lists give to each place, as blocks; long lists add at most what their maxima do
        value *= np.repeat(q, self.first[t + 1] - self.first[t])
        part = np.bincount(places, value, blocks * BLOCK).reshape(blocks, BLOCK)
        bound = part.max(1, initial=0.0) + long_q @ self.most[row]
        order = np.argsort(-bound, kind="stable")
        starts, sizes = self.block_at[row, :-1], self.block_sizes[row]
        place, near, least, done = np.empty(0, np.int64), np.empty(0), 0.0, 0
        for more in (8, len(order)):  # the most promising blocks, then all that can still matter
            pick = order[done : done + more]
            pick = np.sort(pick[bound[pick] > 0 if len(near) < k else bound[pick] >= least - 1e-12])
            done += more
            of = sizes[:, pick]
            at = _ranges(starts[:, pick].ravel(), of.ravel())
            s = np.bincount(self.place[at], self.value[at] * np.repeat(long_q, of.sum(1)), blocks * BLOCK).reshape(blocks, BLOCK)[pick] + part[pick]
            mine = (pick[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            s = s.ravel() * (mine != skip)
            hit = np.flatnonzero(s)
            place, near = np.concatenate([place, mine[hit]]), np.concatenate([near, s[hit]])
            if len(near) > k:  # only those about as near as the k-th, or nearer, are sorted
                may = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - 2e-12)
                place, near = place[may], near[may]
            top = np.lexsort((place, -np.round(near, 12)))[:k]
            place, near = place[top], near[top]
            least = near[-1] if len(near) == k else 0.0
        return place, near

    def vote(self, counts: Counts, skip: int = -1) -> tuple[float, np.ndarray]:
        """Votes of the nearest, weighted by cosine and class weight, with one vote's worth of prior."""
        place, near = self.nearest(counts, skip=skip)
        w = near * self.weight[place]
        one = self.weight.mean() if len(self.weight) else 1.0
        raw = (float((w * self.labels[place]).sum()) + 0.5 * one * self.prior) / (float(w.sum()) + 0.5 * one)
        if self.steps is not None:
            x, y = self.steps
            raw = float(np.interp(raw, x, y)) if len(x) else raw
        return raw, self.ids[place[:3]]

    def score(self, text: str | None) -> tuple[float, list[int]]:
        counts = {self.terms[w]: n for w, n in Counter(words_of(text)).items() if w in self.terms}
        if not counts:
            return self.bare, []
        p, ids = self.vote(counts)
        return min(1.0, max(0.0, p)), ids.tolist()


def isotonic(votes: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """A non-decreasing map from vote to share of label 1 (pooled neighbours, weighted): its corners."""
    pools: list[list[float]] = []  # [sum of weight * x, sum of weight * y, weight]
    for x, y, w in sorted(votes):
        pools.append([w * x, w * y, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def train_index(docs: DataFrame, labels: DataFrame, each: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> Index:
    """An index of ``docs`` (doc_id, text) labelled by ``labels`` (doc_id, toxic; above 0 is label 1): of each class the
    ``each`` ids of smallest md5, texts of up to ``chars`` characters. A doc labelled twice is toxic
    if any of its labels is. All terms of the sample are kept; each weight is scaled by the root of the
    term's chi-squared statistic over the sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    counts = written(known.groupBy("toxic").agg(F.count("*").alias("n")), "classes")
    totals = {r["toxic"]: r["n"] for r in counts.collect()}  # two rows
    # ids of small md5, about twice as many as wanted, so that the ranking sees few
    md5 = F.md5(F.col("doc_id").cast("string").cast("binary"))
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 40) / F.col("n"))
    few = known.join(F.broadcast(counts), "toxic").where(F.conv(F.substring(md5, 1, 8), 16, 10).cast("long") <= share * float(1 << 32))
    order = Window.partitionBy("toxic").orderBy(md5, "doc_id")
    picked = few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select("doc_id", "toxic")
    sample = docs.where(F.col("text").isNotNull() & (F.length("text") <= chars)).join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, label, text in zip(*[c.to_pylist() for c in batch.columns]):
                c = Counter(words_of(text))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * (len(c) + 1), pa.int64()), "toxic": pa.array([label] * (len(c) + 1), pa.int64()), "term": pa.array([None, *c], pa.binary()), "n": pa.array([0, *c.values()], pa.int64())})

    rows = written(sample.mapInArrow(terms, "doc_id long, toxic long, term binary, n long"), "terms").toArrow()  # of the bounded sample
    term = rows.column("term").combine_chunks().dictionary_encode()
    vocab = term.dictionary.to_pylist()
    term = term.indices.fill_null(-1).to_numpy().astype(np.int32)
    doc, toxic, n = (rows.column(c).to_numpy() for c in ("doc_id", "toxic", "n"))
    del rows
    order = np.lexsort((term, doc))
    doc, toxic, term, n = doc[order], toxic[order], term[order], n[order].astype(np.int32)
    # rows of one id are one example; its rows of a term are added up, the one without a term is left out
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])))) if len(doc) else np.empty(0, np.int64)
    doc, toxic, term, n = doc[new], toxic[new], term[new], np.add.reduceat(n, new) if len(new) else n
    first = np.flatnonzero(term < 0)
    examples = [(int(doc[a]), int(toxic[a]), (term[a + 1 : b], n[a + 1 : b])) for a, b in zip(first, np.append(first[1:], len(doc)))]
    n1 = sum(e[1] for e in examples)
    n0 = len(examples) - n1
    by = np.stack([np.bincount(term[(term >= 0) & (toxic == c)], minlength=len(vocab)) for c in (0, 1)])
    # how well each term tells the classes apart; a half is added to each count
    c, a, n = by[0] + 0.5, by[1] + 0.5, n0 + n1 + 2.0
    chi = n * (a * (n0 + 1 - c) - c * (n1 + 1 - a)) ** 2 / ((n1 + 1) * (n0 + 1) * (a + c) * (n - a - c))
    return Index(vocab, examples, {1: totals.get(1, 0) / max(1, n1), 0: totals.get(0, 0) / max(1, n0)}, np.sqrt(chi) + 1e-3)


def score_toxicity(docs: DataFrame, index: Index) -> DataFrame:
    """Adds score, predicted and evidence (ids of up to three nearest examples) to ``docs`` (text
    among its columns; columns of these names are replaced). A text without a known term, an empty
    or null one too, scores the share of label 1 among examples without one. Very long texts count whole; repeated rows
    score alike; of examples that are as near, the earlier in the index count; an empty table gives no rows."""
    docs = docs.drop("score", "predicted", "evidence")
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = docs.columns
    at = names.index("text")
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "evidence": F.expr("CAST(array() AS array<bigint>)")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for batch in batches:
            found = []
            for text in batch.column(at):
                text = text.as_py()
                key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()  # copies are scored once
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = index.score(text)
                found.append(known[key])
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=[*names, "score", "predicted", "evidence"])

    return docs.mapInArrow(run, schema)


def op6(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    index = train_index(docs, labels.where(crc_mod("doc_id", 5) != 0))
    docs = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5), F.lit(1)) == 0)
    return score_toxicity(docs, index).select("doc_id", "held_out", "score", "predicted", "evidence")
