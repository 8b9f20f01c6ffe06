"""Benchmark decontamination by greedy string tiling.

Shared runs of K words are seeds; for each text and item that share enough of them, the longest
common runs of words not yet marked are marked again and again, found by running Karp-Rabin hashes.
The share of the item's words under tiles decides, so passages in another order are caught too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import _powers, drop, shingle_hashes, sorted_set, split_by_keys, word_hashes, written

#: Words of a seed and of the shortest tile; share of an item's words under tiles that flags a text.
K, COVERAGE = 4, 0.5
#: Bits of the filter of benchmark seeds: fixed, so 1 MB is sent to the tasks whatever the benchmark's size.
_FILTER_BITS = 23


def _left(free: np.ndarray) -> np.ndarray:
    """From each place on, how many words are unmarked."""
    n = len(free)
    stop = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


class _Hashes:
    """Hashes of all stretches of a sequence of words, from a running sum of word * P**place."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = _powers(len(words) + 1)
        self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)))

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.run[start + size] - self.run[start]) * self.down[start]


#: Pairs of equal windows that are looked at together.
_PAIRS = 1 << 20


def _run_starts(text, item, ht: _Hashes, hi: _Hashes, left_t, left_i, size: int) -> list[tuple[int, int, int]]:
    """(-words, place in item, place in text) of the common runs of ``size`` unmarked words or more that no word before
    continues. Lengths come from hashes of stretches of 2**k words, all pairs at a time."""
    a, b = np.flatnonzero(left_t >= size), np.flatnonzero(left_i >= size)
    if not len(a) or not len(b):
        return []
    ka, kb = ht.of(a, size), hi.of(b, size)
    order = np.argsort(kb, kind="stable")
    b, kb = b[order], kb[order]
    lo, n = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
    n -= lo
    a, lo, n = a[n > 0], lo[n > 0], n[n > 0]
    out, edge = [], np.cumsum(n)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + _PAIRS, "right")))
        of = n[at:to]
        i = np.repeat(a[at:to], of)
        j = b[np.repeat(lo[at:to] - np.concatenate(([0], np.cumsum(of)[:-1])), of) + np.arange(len(i))]
        inner = (i > 0) & (j > 0)
        inner[inner] = (left_t[i[inner] - 1] > 0) & (left_i[j[inner] - 1] > 0) & (text[i[inner] - 1] == item[j[inner] - 1])
        i, j = i[~inner], j[~inner]
        most, m = np.minimum(left_t[i], left_i[j]), np.full(len(i), size)
        for k in range(int(most.max(initial=1)).bit_length() - 1, -1, -1):
            some = np.flatnonzero(m + (1 << k) <= most)
            some = some[ht.of(i[some] + m[some], 1 << k) == hi.of(j[some] + m[some], 1 << k)]
            m[some] += 1 << k
        out += zip((-m).tolist(), j.tolist(), i.tolist())
        at = to
    return out


def tiles(text: np.ndarray, item: np.ndarray, least: int = K) -> list[tuple[int, int, int]]:
    """(place in text, place in item, words) of the tiles of a greedy string tiling: of all common runs
    of unmarked words the longest is marked first (ties: first in item, then in text), until none of
    ``least`` words is left. The search length falls by half; runs of at least it are found from equal window hashes and wait in a
    heap. One that was marked in part since goes back as what is left of it."""
    out, free_t, free_i = [], np.ones(len(text), bool), np.ones(len(item), bool)
    ht, hi = _Hashes(text), _Hashes(item)
    size = max(least, min(len(item), len(text)))
    while True:
        heap = _run_starts(text, item, ht, hi, _left(free_t), _left(free_i), size)
        heapq.heapify(heap)
        while heap:
            n, j, i = heapq.heappop(heap)
            ok = free_t[i : i - n] & free_i[j : j - n] & (text[i : i - n] == item[j : j - n])
            if ok.all():
                free_t[i : i - n], free_i[j : j - n] = False, False
                out.append((i, j, -n))
            elif ok.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
                for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                    if y - x >= size:
                        heapq.heappush(heap, (x - y, j + x, i + x))
        if size == least:
            return out
        size = max(least, size // 2)


def benchmark_seeds(benchmark: DataFrame, k: int = K) -> DataFrame:
    """(hash, item, words, times): the distinct seeds of every row of ``benchmark`` (item, text) and how often each
    occurs in it. Items of fewer than k words have none and match nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = word_hashes(text.as_py())
                h, times = np.unique(shingle_hashes(w, k), return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": pa.array(h.view(np.int64)), "item": pa.array([item] * len(h), pa.int64()), "words": pa.array([len(w)] * len(h), pa.int64()), "times": pa.array(times.astype(np.int64))})

    return benchmark.select("item", "text").mapInArrow(run, "hash long, item long, words long, times long")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of all seeds, put together by Spark as at most 2**17 words of 64 bits."""
    low = F.col("hash").bitwiseAND(F.lit((1 << _FILTER_BITS) - 1))
    rows = seeds.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, CAST((hash & {(1 << _FILTER_BITS) - 1}) % 64 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    for r in rows:
        bits[r["w"]] = r["b"]
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def rare_seeds(seeds: DataFrame, hits: DataFrame, coverage: float, k: int) -> DataFrame:
    """(hash, item, times, rest, least) of the seeds that a pair must share one of. A text that covers enough of an item has
    ``least`` of its seeds' occurrences, so it has one among all but least - 1 of them: the commonest seeds in ``hits``
    (row, hash) are left out of the join, and a phrase that is in most texts doesn't pair them with every item that has
    it. ``rest`` is how often the seeds left out occur in the item."""
    often = seeds.join(hits.groupBy("hash").agg(F.count("*").alias("often")), "hash")  # a seed that no text has pairs nothing
    every = seeds.groupBy("item").agg(F.sum("times").alias("all"))
    w = Window.partitionBy("item").orderBy("often", "hash")  # an item's own seeds
    absent = F.col("all") - F.sum("times").over(Window.partitionBy("item"))
    least = F.ceil(F.col("words") * coverage / k - 1e-9).cast("long")
    placed = often.join(every, "item").withColumns({"least": least, "absent": absent, "before": F.sum("times").over(w) - F.col("times")})
    kept = placed.where(F.col("absent") + F.col("before") <= F.col("all") - F.col("least"))
    rest = F.col("all") - F.col("absent") - F.sum("times").over(Window.partitionBy("item"))
    return kept.select("hash", "item", "times", rest.alias("rest"), "least")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, k: int = K) -> DataFrame:
    """The pairs of a text of ``docs`` (doc_id, text) and an item of ``benchmark`` (item_id, text) whose
    tiles of k words or more cover at least ``coverage`` of the item's words: doc_id, text_key (xxhash64 of
    the text), item_id, item_words, covered_words, coverage, n_tiles, longest_tile.

    Words are those between spaces and U+0009-D, A-Z in lower case. Texts are read whole, once; a
    filter of fixed size drops those without a possible seed, the rest are stored and joined
    with the items' rarer seeds by hash. A pair goes on if its seeds could cover enough (seeds that occur n
    times in the item cover at most n * k of its words). Null and empty texts, and items of fewer than
    k words, match nothing. Repeated rows each give their pairs; so does every row of the benchmark,
    also under a repeated or null item_id.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    items = written(items, "items")  # each row keeps its key
    seeds = written(benchmark_seeds(items.withColumnRenamed("item_text", "text"), k), "seeds")
    bits = spark.sparkContext.broadcast(seed_filter(seeds))
    mask = np.uint64((1 << _FILTER_BITS) - 1)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            keep, lists = [], []
            for i, text in enumerate(batch.column(1)):
                h = shingle_hashes(word_hashes(text.as_py()), k)
                h = sorted_set(h[known[(h & mask).astype(np.int64)]])
                if len(h):
                    keep.append(i)
                    lists.append(h.view(np.int64))
            if keep:
                some = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "text", "hashes"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hits, "doc_id long, text string, hashes array<long>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "seeded")
    hits = found.select("row", F.explode("hashes").alias("hash"))
    rare = written(rare_seeds(seeds, hits, coverage, k), "rare")
    pairs = hits.join(rare, "hash").groupBy("row", "item").agg(F.sum("times").alias("n"), F.max("rest").alias("rest"), F.max("least").alias("least")).where(F.col("n") + F.col("rest") >= F.col("least"))
    pairs = written(pairs.select("row", "item"), "pairs")
    near, _ = split_by_keys(found.select("row", "doc_id", "text"), "row", pairs.select("row"))  # only these texts move
    rows = pairs.join(items, "item").join(near, "row")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, item_id, a, b in zip(*[c.to_pylist() for c in batch.columns[:3]], *batch.columns[3:]):
                item = word_hashes(b.as_py())
                t = tiles(word_hashes(a.as_py()), item, k)
                n = sum(x[2] for x in t)
                if n and n >= coverage * len(item):
                    out.append((doc, key, item_id, len(item), n, n / len(item), len(t), max(x[2] for x in t)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 5 else pa.int64()) for i, c in enumerate(zip(*out))], names=["doc_id", "text_key", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "longest_tile"])

    out = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "item_id", "text", "item_text").mapInArrow(tile, "doc_id long, text_key long, item_id long, item_words long, covered_words long, coverage double, n_tiles long, longest_tile long")
    out = written(out, "found")
    drop(items, seeds, found, rare, pairs)
    return out


def op9(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contaminated(read("documents"), read("benchmark"))
