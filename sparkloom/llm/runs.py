"""Periodic runs of words by internal pattern matching.

A run that repeats with period q holds an aligned block of 2**k words that comes again q words later. Blocks look for
their next occurrences in the windows behind them: the block's interval of the suffix array, and in a wavelet matrix over
that array the smallest positions from the window's start on. Many occurrences of a block in a window no longer than the block
make an arithmetic progression, so its difference and ends give all periods that can matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, fresh, mix

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 24, 3
#: Texts are searched in lots of about so many words; a longer text is a lot of its own.
LOT = 1 << 17
#: Words of the smallest blocks: a run of LEAST words or more with a period up to this holds an aligned one and its next occurrence.
_SMALL = 8
#: A run of LEAST words or more repeats a stretch of so many words.
_REPEATED = LEAST - LEAST // TIMES
_P = np.uint64(0x9E3779B97F4A7C15)


class Repeats:
    """Where a sequence of numbers repeats itself: ranks of all blocks of 2**k numbers, their suffix array, and a
    wavelet matrix over it."""

    def __init__(self, x: np.ndarray):
        n = self.n = len(x)
        at = np.argsort(x, kind="stable")
        new = np.concatenate(([True], x[at][1:] != x[at][:-1]))
        rank = np.empty(n, np.int64)
        rank[at] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.ranks = [rank.astype(np.int32)]
        alone = new & np.append(new[1:], True)
        h = 1
        while not alone.all():  # each round doubles the blocks; only those that repeat are ordered anew
            slots = np.flatnonzero(~alone)
            some = at[slots]
            then = np.where(some + h < n, rank[np.minimum(some + h, n - 1)] + 1, 0)
            key = rank[some] * (n + 1) + then
            order = np.argsort(key, kind="stable")
            some, key = some[order], key[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            at[slots] = some
            rank = rank.copy()
            rank[some] = np.maximum.accumulate(np.where(new, slots, 0))
            alone[slots] = new & np.append(new[1:], True)
            self.ranks.append(rank.astype(np.int32))
            h *= 2
        self.levels = []  # of the wavelet matrix, highest bit first: zeros before each place
        for bit in range(max(1, int(n - 1).bit_length()) - 1, -1, -1):
            one = (at >> bit & 1).astype(bool)
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros))
            at = np.concatenate((at[~one], at[one]))

    def same(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffix array that holds all occurrences of the blocks of 2**k at ``i``."""
        rank = self.ranks[min(k, len(self.ranks) - 1)]
        starts = np.zeros(self.n + 1, bool)
        starts[rank], starts[self.n] = True, True
        starts = np.flatnonzero(starts)
        lo = rank[i].astype(np.int64)
        return lo, starts[np.searchsorted(starts, lo, "right")]

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many positions in these intervals are smaller than ``x``."""
        out, top = np.zeros(len(lo), np.int64), x >= self.n
        size, lo, hi, x = hi - lo, lo.copy(), hi.copy(), np.minimum(x, self.n - 1)
        for bit, zeros in self.levels:
            a, b, one = zeros[lo], zeros[hi], (x >> bit & 1).astype(bool)
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return np.where(top, size, out)

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest position (from 0) in these intervals; with k = below(x), the successor of x."""
        out, lo, hi, k = np.zeros(len(lo), np.int64), lo.copy(), hi.copy(), k.copy()
        for bit, zeros in self.levels:
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = k >= b - a
            out |= one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree from ``a`` and from ``b`` > a on."""
        start, a, b = a, a.copy(), b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            ok = (b < self.n) & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)])
            a, b = a + (ok << k), b + (ok << k)
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree before ``a`` and before ``b`` > a."""
        start, a, b = a, a.copy(), b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            ok = (a >= 1 << k) & (rank[np.maximum(a - (1 << k), 0)] == rank[np.maximum(b - (1 << k), 0)])
            a, b = a - (ok << k), b - (ok << k)
        return start - a

    def periodic(self, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretches of period ``p`` around ``i`` and i + p."""
        return i - self.behind(i, i + p), i + p + self.ahead(i, i + p)


def find_runs(x: np.ndarray, least: int = LEAST, longest: int | None = None) -> np.ndarray:
    """The runs of a sequence, rows (start, end, smallest period): stretches of ``least`` words or more (24 at least) and of three
    periods or more that can't be extended, by start and period. ``longest`` bounds the periods."""
    r, found = Repeats(x), []
    k = _SMALL.bit_length() - 1
    while (1 << k) <= max(_SMALL, (longest or len(x)) // TIMES) and k < len(r.ranks):
        m = 1 << k
        i = np.arange(0, len(x) - m + 1, m)
        lo, hi = r.same(k, i)
        again = hi - lo > 1
        i, lo, hi = i[again], lo[again], hi[again]
        for first in (1, m) if m == _SMALL else (m,):  # windows of m places
            if not len(i):
                break
            before = r.below(lo, hi, i + first)
            n = r.below(lo, hi, i + first + m) - before
            for nth in (0, 1):
                w = np.flatnonzero(n > nth)
                found.append((i[w], r.nth(lo[w], hi[w], before[w] + nth) - i[w]))
            w = np.flatnonzero(n > 2)  # a progression
            if len(w):
                j, one = i[w], r.nth(lo[w], hi[w], before[w])
                p = r.nth(lo[w], hi[w], before[w] + 1) - one
                (a, b), (c, d) = r.periodic(j, p), r.periodic(one, p)
                found += [(j, p), (j, c - a), (j, d - b)]
        k += 1
    i, p = (np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found) if found else ((), ())))
    ok = (p > 0) & (i + p < len(x))
    pairs = np.unique(np.stack([i[ok], p[ok]], 1), axis=0)
    a, b = r.periodic(pairs[:, 0], pairs[:, 1])
    p = pairs[:, 1]
    ok = b - a >= np.maximum(least, TIMES * p)
    a, b, p = a[ok], b[ok], p[ok]
    order = np.lexsort((p, b, a))  # of the periods of one stretch the smallest counts
    a, b, p = a[order], b[order], p[order]
    new = np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    out = np.stack([a[new], b[new], p[new]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _may_repeat(texts: list[list[bytes]]) -> np.ndarray:
    """Which texts hold some stretch of _REPEATED words twice; by hashes, so a few others may be among them."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros(len(texts), bool)
    some = np.flatnonzero(sizes >= LEAST)
    if not len(some):
        return out
    doc = np.repeat(some, sizes[some])
    h = np.fromiter((hash(w) for i in some for w in texts[i]), np.int64, len(doc)).view(np.uint64)
    h = mix(h)
    n = 1
    while n < _REPEATED:
        step = min(n, _REPEATED - n)
        h = mix(h[:-step] * _P + h[step:])
        n += step
    inside = doc[: len(h)] == doc[n - 1 :]
    key = (h + mix(doc[: len(h)].astype(np.uint64) * _P))[inside]
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        out[doc[: len(h)][inside][np.isin(key, twice)]] = True
    return out


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, rows (start, end, period). Words of different texts count as different, so all of a lot
    are one sequence."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    some = np.flatnonzero(_may_repeat(texts))
    if not len(some):
        return out
    ids, starts, base, longest = [], [0], 0, 0
    for i in some:
        known: dict[bytes, int] = {}
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in texts[i]), np.int64, len(texts[i])) + base)
        base += len(known)
        starts.append(starts[-1] + len(texts[i]))
        longest = max(longest, len(texts[i]))
    found = find_runs(np.concatenate(ids), longest=longest)
    edge = np.searchsorted(found[:, 0], starts)
    for n, i in enumerate(some):
        out[i] = found[edge[n] : edge[n + 1]] - [starts[n], starts[n], 0]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1], -1)
    keep = np.cumsum(cover)[:-1] == 0
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def periodic_runs(docs: DataFrame, text_col: str = "text", lot: int = LOT) -> DataFrame:
    """Every row of ``docs`` with runs, an array of struct<start, length, period> in words by start and period, and collapsed, the
    text without what runs repeat: its words joined by one space, those that a run holds after its first period left out.

    Words are what lies between spaces and U+0009-D; a run has 24 words or more and three of its smallest periods or
    more. A null or empty text has no runs and an empty collapsed text. Texts are read whole, however long; repeated rows each get
    theirs, an empty table gives no rows. Columns named runs or collapsed are replaced, all others stay.
    Rows stay where they are, so nothing is exchanged."""
    docs = docs.drop("runs", "collapsed")
    row, text = fresh(docs, "row"), fresh(docs, "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def out(part: list[pa.RecordBatch], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        found, at = runs_of(texts), 0
        for batch in part:
            mine, words = found[at : at + len(batch)], texts[at : at + len(batch)]
            offsets = np.cumsum([0] + [len(r) for r in mine]).astype(np.int32)
            flat = np.concatenate(mine) if len(mine) else np.empty((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], names=["start", "length", "period"])
            short = pa.array([collapse(w, r).decode("utf-8", "surrogatepass") for w, r in zip(words, mine)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), items).cast(kind), short], names=["row", "runs", "collapsed"])
            at += len(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, texts, held = [], [], 0
        for batch in batches:
            for i in range(0, len(batch), 64):
                some = batch.slice(i, 64)
                words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in some.column(1)]
                part.append(some)
                texts += words
                held += sum(map(len, words))
                if held >= lot:
                    yield from out(part, texts)
                    part, texts, held = [], [], 0
        if part:
            yield from out(part, texts)

    one = docs.select(F.struct(*docs.columns).alias(row), F.col(text_col).alias(text))
    got = one.mapInArrow(run, f"row {one.schema[row].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return got.select(*[F.col("row")[c].alias(c) for c in docs.columns], "runs", "collapsed")


def _rewritten(docs: DataFrame) -> DataFrame:
    """A tenth of the documents with an end that repeats: words from number a on come again with period p."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = docs.withColumn("_n", F.when(crc_mod("doc_id", 10) == 0, F.size(words)).otherwise(0))
    g = F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)
    few = few.withColumn("_a", (g % F.greatest(F.col("_n"), F.lit(1))).cast("int")).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    rest = F.col("_n") - F.col("_a")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("_a")), again), " ")
    return few.withColumn("text", F.when(F.col("_n") > 0, text).otherwise(F.col("text"))).drop("_n", "_a", "_p")


def op13(spark, sf_dir):
    docs = _rewritten(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = periodic_runs(docs)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, x: F.when(x["length"] * b["period"] > b["length"] * x["period"], x).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
