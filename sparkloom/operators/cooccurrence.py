"""Features that are active on the same token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import stored
from .filters import semi_filter


#: Bits of a feature id inside its block: pairs are counted in blocks of 256 x 256 features.
_BITS = 8
#: Pairs that a task makes at a time, and those that it counts before it hands them on.
_MADE, _HELD = 1 << 21, 1 << 21
#: Features that a task numbers before it hands on what it has of enough pairs, and rows that it hands on at a time.
_NUMBERED, _ROWS = 1 << 18, 1 << 14
#: Lists that tell whether they repeat.
_LOOK = 100_000
#: Features up to which a task counts all their pairs in one table.
_FEW_IDS = 1000
#: Tasks that first add up what is handed on of one pair of blocks.
_SALT = 8


def index_pairs(sizes: np.ndarray, most: int = _MADE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a before b, of all pairs inside the runs of a list whose lengths are ``sizes``, about ``most`` at a
    time; a run of more pairs comes alone, row by row of them."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for m in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == m]
        if m * (m - 1) // 2 <= most:
            i, j = np.triu_indices(m, 1)
            step = max(1, most // len(i))
            for k in range(0, len(at), step):
                yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
        else:
            for s in at.tolist():
                for i in range(m - 1):
                    yield np.full(m - 1 - i, s + i), np.arange(s + i + 1, s + m)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[new], np.add.reduceat(n, new) if len(new) else n


_PACKED = "block_i long, block_j long, salt int, places binary, counts binary"


def _packed(i: np.ndarray, j: np.ndarray, n: np.ndarray, salt: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Pair counts as a row for each pair of blocks: places in the block and counts as binaries. Sparse pairs have about a row each, so
    rows are cut out of one buffer, and handed on _ROWS at a time."""
    bi, bj = i >> bits, j >> bits
    order = np.lexsort((j, i, bj, bi))
    i, j, n, bi, bj = i[order], j[order], n[order], bi[order], bj[order]
    mask = (1 << bits) - 1
    place = (((i & mask) << bits) | (j & mask)).astype(np.int32)
    edge = np.flatnonzero(np.concatenate(([True], (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]), [True])))
    n = n.astype(np.int64)

    def cut(x: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(((at - at[0]) * x.itemsize).astype(np.int32)), pa.py_buffer(x[at[0] : at[-1]])])

    for s in range(0, len(edge) - 1, _ROWS):
        at = edge[s : s + _ROWS + 1]
        yield pa.RecordBatch.from_arrays([pa.array(bi[at[:-1]]), pa.array(bj[at[:-1]]), pa.array(np.full(len(at) - 1, salt, np.int32)), cut(place, at), cut(n, at)], names=["block_i", "block_j", "salt", "places", "counts"])


def gram(tokens: DataFrame, bits: int = _BITS, made: int = _MADE, most: int = _HELD) -> DataFrame:
    """(feature_i, feature_j, coactivation_count) of ``tokens`` (f: sorted distinct features): on how many tokens two
    features meet. A task counts pairs as it makes them and hands on packed counts, a row for each pair of blocks of features;
    these are added up in arrays of one such block each, by several tasks first and then by one. So no row is made for a
    pair of a token, and rows are bounded by the pairs of blocks and the tasks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}  # features by number
        keys, counts, n = [], [], 0
        part = TaskContext.get().partitionId() % _SALT

        def out():
            names = np.array(list(held), np.int64)
            k, c = _added(keys, counts)
            return _packed(names[k >> 32], names[k & 0xFFFFFFFF], c, part, bits)

        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            own, at = np.unique(flat, return_inverse=True)
            number = np.fromiter((held.setdefault(x, len(held)) for x in own.tolist()), np.int64, len(own))
            for a, b in index_pairs(sizes, made):
                if len(own) ** 2 <= len(a):  # an array of all pairs takes no more than the pairs at hand
                    c = np.bincount(at[a] * len(own) + at[b])
                    k = np.flatnonzero(c)
                    k, c = (number[k // len(own)] << 32) | number[k % len(own)], c[k]
                else:
                    k, c = np.unique((number[at[a]] << 32) | number[at[b]], return_counts=True)
                keys.append(k)
                counts.append(c)
                n += len(k)
                if n > most or len(held) > _NUMBERED and n > most // 8:
                    k, c = _added(keys, counts)
                    keys, counts, n = [k], [c], len(k)
                    if n > most // 2 or len(held) > _NUMBERED:
                        yield from out()
                        held, keys, counts, n = {}, [], [], 0
                        number = np.fromiter((held.setdefault(x, len(held)) for x in own.tolist()), np.int64, len(own))
        if n:
            yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(block_i, block_j, places, counts) of rows that come by block and salt. Few entries are sorted, many added up in an
        array of the whole block."""
        key, held, n, total = None, [], 0, None

        def done():
            if total is None:
                return *key[:2], *_added(*zip(*held))
            for at, c in held:
                total[at] += c
            at = np.flatnonzero(total)
            return *key[:2], at.astype(np.int32), total[at]

        for batch in batches:
            for bi, bj, salt, places, counts in zip(*[c.to_pylist() for c in batch.columns[:3]], *batch.columns[3:]):
                if key != (bi, bj, salt):
                    if key is not None:
                        yield done()
                    key, held, n, total = (bi, bj, salt), [], 0, None
                held.append((np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int64)))
                n += len(held[-1][0])
                if n > 1 << (2 * bits - 2):
                    total = np.zeros(1 << (2 * bits), np.int64) if total is None else total
                    for at, c in held:
                        total[at] += c  # places of a row are distinct
                    held = []
        if key is not None:
            yield done()

    def lots(found: Iterator[tuple]) -> Iterator[list[tuple]]:
        """Blocks together that have some ten thousand pairs."""
        part, n = [], 0
        for x in found:
            part.append(x)
            n += len(x[2])
            if n > 1 << 16 or len(part) > 1024:
                yield part
                part, n = [], 0
        if part:
            yield part

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in lots(add(batches)):
            bi, bj, places, counts = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(bi), pa.array(bj), pa.array(np.zeros(len(bi), np.int32)), pa.array([x.tobytes() for x in places], pa.binary()), pa.array([x.tobytes() for x in counts], pa.binary())], names=["block_i", "block_j", "salt", "places", "counts"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in lots(add(batches)):
            i = np.concatenate([(bi << bits) + (at.astype(np.int64) >> bits) for bi, _, at, _ in part])
            j = np.concatenate([(bj << bits) + (at.astype(np.int64) & ((1 << bits) - 1)) for _, bj, at, _ in part])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([x[3] for x in part]))], names=["feature_i", "feature_j", "coactivation_count"])

    key = ["block_i", "block_j", "salt"]
    packed = tokens.where(F.size("f") > 1).select("f").mapInArrow(make, _PACKED)
    packed = packed.repartition(*key).sortWithinPartitions(*key).mapInArrow(some, _PACKED)
    return packed.repartition("block_i", "block_j").sortWithinPartitions("block_i", "block_j").mapInArrow(every, "feature_i long, feature_j long, coactivation_count long")


def few_ids(ids: DataFrame) -> list[int] | None:
    """The distinct feature_id of ``ids``, if there are no more than _FEW_IDS."""
    found = [r[0] for r in ids.select(F.col("feature_id").cast("long")).where("feature_id IS NOT NULL").distinct().limit(_FEW_IDS + 1).collect()]
    return found if len(found) <= _FEW_IDS else None


def token_pairs(lists: DataFrame, picked: list[int] | None) -> DataFrame:
    """The columns of ``lists`` but features with each pair feature_i <= feature_j of these (of those in ``picked``, if given), whether
    it is the first of its token, and n, of how many tokens. Where lists repeat, by a look at some of them, equal ones are counted
    first; else tokens don't move."""
    some = lists.limit(_LOOK).agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*lists.columns))).first()
    lists = lists.groupBy(*lists.columns).agg(F.count("*").alias("n")) if some[1] * 2 <= some[0] else lists.withColumn("n", F.lit(1).cast("long"))
    rest = [c for c in lists.columns if c != "features"]
    good = F.filter("features", (lambda x: x.isNotNull()) if picked is None else (lambda x: x.isin(picked)))
    one = lists.select(*rest, good.alias("_f")).select(*rest, "_f", F.posexplode_outer("_f").alias("_i", "feature_i"))  # outer: else lists are filtered a second time, before they are counted
    two = one.select(*rest, "_i", "feature_i", F.posexplode_outer("_f").alias("_j", "feature_j")).where("feature_i <= feature_j")
    return two.select(*rest, "feature_i", "feature_j", (F.col("_i") + F.col("_j") == 0).alias("first"))


def _met(lists: DataFrame, picked: list[int]) -> DataFrame:
    """(feature_i, feature_j, n, n_first): on how many tokens a pair, or a feature with itself, is, and of how many it is the first."""
    return token_pairs(lists.select("features"), picked).groupBy("feature_i", "feature_j").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("n_first"))


def same_token_pairs(acts: DataFrame, ids: DataFrame, max_pairs: int | None = 100_000, min_count: int = 1, lists: DataFrame | None = None, rest: DataFrame | None = None) -> DataFrame:
    """Pairs i < j of features with rows on the same token: counts, Jaccard, PMI (natural logarithm)
    and conditional shares; the first ``max_pairs`` by PMI, Jaccard, count.

    Only rows of ``ids`` count. Pair counts are of distinct features of a token, feature
    counts of rows. Pairs are counted by gram().

    ``lists``, if the caller has them: the tokens of ``acts`` with their features, each once and with one row (nulls among them are
    none), but for the rows ``rest`` of ``acts``. Where _FEW_IDS ids at most count, pairs are then counted as tasks
    read the lists, and only the rest is gathered by token.
    """
    picked = few_ids(ids) if lists is not None else None
    acts = semi_filter(acts, ids).select("text_id", "token_pos", F.col("feature_id").cast("long").alias("feature_id"))
    if picked is None:
        counts = acts.groupBy("feature_id").agg(F.count("*").alias("n"))
        tokens = acts.groupBy("text_id", "token_pos").agg(F.sort_array(F.collect_set("feature_id")).alias("f"))
        total = tokens.agg(F.count("*").alias("n_tokens"))
        pairs = gram(tokens)
    else:
        met = _met(lists, picked)
        if rest is not None:
            rest = semi_filter(rest, ids).withColumn("feature_id", F.col("feature_id").cast("long"))
            again = _met(rest.groupBy("text_id", "token_pos").agg(F.collect_set("feature_id").alias("features")), picked)
            own = rest.groupBy(F.col("feature_id").alias("feature_i"), F.col("feature_id").alias("feature_j")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_first"))
            met = met.unionByName(again.withColumn("n", F.when(F.col("feature_i") < F.col("feature_j"), F.col("n")).otherwise(0))).unionByName(own)  # of a feature all rows count
        met = stored(met.groupBy("feature_i", "feature_j").agg(F.sum("n").alias("n"), F.sum("n_first").alias("n_first")), "met")
        counts = met.where("feature_i = feature_j").select(F.col("feature_i").alias("feature_id"), "n")
        total = met.agg(F.coalesce(F.sum("n_first"), F.lit(0)).alias("n_tokens"))
        pairs = met.where("feature_i < feature_j").select("feature_i", "feature_j", F.col("n").alias("coactivation_count"))
    if min_count > 1:
        pairs = pairs.where(F.col("coactivation_count") >= min_count)
    side = lambda s: counts.select(F.col("feature_id").alias(f"feature_{s}"), F.col("n").alias(f"feature_{s}_count"))
    p = pairs.join(side("i"), "feature_i").join(side("j"), "feature_j").crossJoin(F.broadcast(total))
    c, ci, cj, n = (F.col(x).cast("double") for x in ("coactivation_count", "feature_i_count", "feature_j_count", "n_tokens"))
    union = ci + cj - c
    p = p.select(
        "feature_i", "feature_j", "coactivation_count", "feature_i_count", "feature_j_count",
        F.when(union > 0, c / union).otherwise(0.0).alias("jaccard"),
        F.log((c / n) / ((ci / n) * (cj / n))).alias("pmi"),
        (c / ci).alias("p_j_given_i"), (c / cj).alias("p_i_given_j"),
    )
    p = p.orderBy(F.desc("pmi"), F.desc("jaccard"), F.desc("coactivation_count"), "feature_i", "feature_j")
    return p.limit(max_pairs) if max_pairs is not None else p


def undirected_edges(pairs: DataFrame) -> DataFrame:
    """Each pair from both ends: feature_id, neighbor_feature_id and the pair's other columns."""
    rest = [c for c in pairs.columns if c not in ("feature_i", "feature_j")]
    one = pairs.select(F.col("feature_i").alias("feature_id"), F.col("feature_j").alias("neighbor_feature_id"), *rest)
    return one.unionByName(pairs.select(F.col("feature_j").alias("feature_id"), F.col("feature_i").alias("neighbor_feature_id"), *rest))


def pair_lookup(pairs: DataFrame, i: int, j: int) -> DataFrame:
    """The row of (i, j), or else of (j, i)."""
    hit = ((F.col("feature_i") == i) & (F.col("feature_j") == j)) | ((F.col("feature_i") == j) & (F.col("feature_j") == i))
    return pairs.where(hit).orderBy((F.col("feature_i") != i).cast("int")).limit(1)


def pair_report(pairs: DataFrame, examples: DataFrame, i: int, j: int, n: int = 10, geometry: DataFrame | None = None) -> DataFrame:
    """All that is known of a pair: its row of ``geometry`` (section geometry), its co-activation row (section
    coactivation), and the first ``n`` examples by rank of each feature (sections feature_i and feature_j), with
    the columns of each; what a section lacks is null."""
    parts = [] if geometry is None else [pair_lookup(geometry, i, j).select(F.lit("geometry").alias("section"), "*")]
    parts.append(pair_lookup(pairs, i, j).select(F.lit("coactivation").alias("section"), "*"))
    for name, f in (("feature_i", i), ("feature_j", j)):
        parts.append(examples.where((F.col("feature_id") == f) & (F.col("rank") <= n)).select(F.lit(name).alias("section"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
