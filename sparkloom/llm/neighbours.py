"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of M full-dimensional codebooks, found by beam search.
A query's products with all codewords make a lookup table; with the stored norm of the sum they give
approximate distances, and the best of these are ranked anew on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Vectors that the codebooks are fitted on at most; codebooks; codewords of each; beam.
SAMPLE, CODEBOOKS, WORDS, BEAM = 20_000, 16, 256, 4
#: Candidates of a query that are ranked on original vectors; vectors and queries of a block.
SHORTLIST, BLOCK, QUERIES = 1000, 16_384, 256


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: not null, finite in every component, not zero."""
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, M) by beam search: after each codebook the ``beam`` partial sums with the
    smallest residuals go on."""
    n, d = x.shape
    m, k, _ = books.shape
    codes, rest, err = np.zeros((n, 1, 0), np.uint8), x[:, None, :], np.zeros((n, 1))
    err[:, 0] = (x**2).sum(axis=1)
    for j in range(m):
        b = rest.shape[1]
        score = err[:, :, None] - 2 * (rest.reshape(-1, d) @ books[j].T).reshape(n, b, k) + (books[j] ** 2).sum(axis=1)
        flat = score.reshape(n, -1)
        width = min(beam, flat.shape[1])
        top = np.argpartition(flat, width - 1, axis=1)[:, :width]
        row, word = top // k, top % k
        i = np.arange(n)[:, None]
        codes = np.concatenate([codes[i, row], word[:, :, None].astype(np.uint8)], axis=2)
        rest = rest[i, row] - books[j][word]
        err = np.take_along_axis(flat, top, axis=1)
    return codes[np.arange(n), err.argmin(axis=1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(books.shape[0]))


def fit_codebooks(x: np.ndarray, m: int = CODEBOOKS, k: int = WORDS, rounds: int = 1, seed: int = 4) -> np.ndarray:
    """Codebooks (m, k, d): k-means on the residuals of each stage, then rounds of encoding all
    stages by beam search and solving for all codewords together (least squares)."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    books, rest = np.zeros((m, k, d), np.float32), x.astype(np.float32)
    for j in range(m):
        c = rest[rng.choice(len(x), k, replace=len(x) < k)].copy()
        for _ in range(8):
            near = ((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)
            count = np.bincount(near, minlength=k)
            total = np.stack([np.bincount(near, rest[:, i], k) for i in range(d)], axis=1)
            c[count > 0] = total[count > 0] / count[count > 0, None]
        books[j] = c
        rest = rest - c[((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)]
    for _ in range(rounds):
        codes = np.concatenate([encode(p, books) for p in np.array_split(x.astype(np.float32), max(1, len(x) // 2048))])
        at = codes.astype(np.int64) + np.arange(m) * k
        both = np.zeros((m * k, m * k))
        for a in range(m):
            for b in range(m):
                np.add.at(both, (at[:, a], at[:, b]), 1)
        right = np.stack([np.bincount(at.ravel(), np.repeat(x[:, i], m), m * k) for i in range(d)], axis=1)
        # a little of the old codebooks keeps unused words where they are
        ridge = 1e-2
        books = np.linalg.solve(both + ridge * np.eye(m * k), right + ridge * books.reshape(m * k, d)).reshape(m, k, d).astype(np.float32)
    return books


def width_of(vectors: DataFrame) -> int | None:
    """The most common length of ``vectors`` (vec_id, v), of all rows; ties to the smaller. None for an empty table."""
    found = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return found[0]["d"] if found else None


def train_codebooks(vectors: DataFrame, sample: int = SAMPLE, m: int = CODEBOOKS) -> np.ndarray | None:
    """Codebooks fitted on up to ``sample`` rows of the most common length picked by hashes of their id; none for an empty table."""
    vectors = vectors.where(F.size("v") == width_of(vectors))
    share = min(1.0, 1.2 * sample / max(1, vectors.count()))
    some = vectors.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 11) < share * float(1 << 53))
    rows = some.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(sample).select("v").toArrow()
    if not rows.num_rows:
        return None
    return fit_codebooks(rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), m)


def _table(ids, vectors) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([vectors.tobytes()], pa.binary())})


def _blocks(vectors: DataFrame, size: int, make) -> DataFrame:
    """The rows (vec_id, v) packed into blocks of up to ``size``: binary ids and make(matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            rows.append(make(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)))
            if sum(map(len, ids)) >= size:
                yield _table(np.concatenate(ids), np.concatenate(rows))
                ids, rows = [], []
        if ids:
            yield _table(np.concatenate(ids), np.concatenate(rows))

    return vectors.select("vec_id", "v").mapInArrow(run, "ids binary, data binary")


def _nearest(ids: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` smallest scores with their ids; of those equal to the last the smallest ids."""
    if len(s) <= n:
        return ids, s
    last = np.partition(s, n - 1)[n - 1]
    keep, tied = np.flatnonzero(s < last), np.flatnonzero(s == last)
    left = n - len(keep)
    keep = np.concatenate([keep, tied[np.argpartition(ids[tied], left - 1)[:left]]])
    return ids[keep], s[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shortlist: int = SHORTLIST, books: np.ndarray | None = None) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score (Euclidean distance of the
    original vectors in double precision); nearest first, ties to the smaller vec_id.

    ``vectors`` and ``queries`` are tables as of usable(). Every vector is indexed; the rows with the
    query's own id are no candidates. Vectors whose length is not the most common one
    take no part (with ``books`` given: not that of the codewords). Of queries that repeat an id, the one with the smallest components counts;
    repeated rows among the vectors each rank. Query blocks meet code blocks in stretches of one query block, each
    leaving ``shortlist`` rows for a query, so the rows grow with the queries and the tasks that codes are read in; they
    meet their vectors by id.
    """
    spark = vectors.sparkSession
    if books is None:
        books = train_codebooks(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], schema)
    d = books.shape[2]
    vectors, queries = vectors.where(F.size("v") == d), queries.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    shared = spark.sparkContext.broadcast(books)

    def code(x: np.ndarray) -> np.ndarray:
        out = []
        for part in np.array_split(x.astype(np.float32), max(1, -(-len(x) // 1024))):
            c = encode(part, shared.value)
            norms = (decode(c, shared.value) ** 2).sum(axis=1).astype(np.float32)
            out.append(np.concatenate([c, norms.view(np.uint8).reshape(-1, 4)], axis=1))
        return np.concatenate(out)

    codes = written(_blocks(vectors, BLOCK, code), "codes")
    asked = written(_blocks(queries, QUERIES, lambda x: x), "queries").select(F.col("ids").alias("qids"), F.col("data").alias("qdata"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        m = books.shape[0]
        asked, qids, best = None, None, []  # the query block at hand, and (ids, scores) of the best of each query so far

        def done() -> pa.RecordBatch:
            sizes = [len(i) for i, _ in best]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))], names=["query_id", "vec_id", "near"])

        for batch in batches:
            for qraw, qdata, ids, data in zip(*batch.columns):
                if asked is None or not asked.equals(qraw):
                    if best:
                        yield done()
                    asked, qids = qraw, np.frombuffer(qraw.as_buffer(), np.int64)
                    table = 2 * np.einsum("qd,mkd->mqk", np.frombuffer(qdata.as_buffer()).reshape(len(qids), d), books).astype(np.float32)
                    best = [(np.empty(0, np.int64), np.empty(0, np.float32))] * len(qids)
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                rows = np.frombuffer(data.as_buffer(), np.uint8).reshape(len(ids), m + 4)
                c, norms = rows[:, :m].T.astype(np.int64), np.ascontiguousarray(rows[:, m:]).view(np.float32)[:, 0]
                for q in range(len(qids)):
                    s = norms.copy()
                    for j in range(m):
                        s -= table[j, q][c[j]]
                    s[ids == qids[q]] = np.inf
                    i, s = _nearest(ids, s, shortlist)
                    some = np.isfinite(s)
                    best[q] = _nearest(np.concatenate([best[q][0], i[some]]), np.concatenate([best[q][1], s[some]]), shortlist)
        if best:
            yield done()

    # blocks of the stated queries against blocks of all rows: no pair of rows is made here
    near = asked.crossJoin(codes).select("qids", "qdata", "ids", "data").mapInArrow(score, "query_id long, vec_id long, near float")
    w = Window.partitionBy("query_id").orderBy("near", "vec_id")
    near = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= shortlist).select("query_id", "vec_id").distinct()
    pairs = near.join(vectors, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.select("query_id", "vec_id", exact.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4(spark, sf_dir):
    v = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(v, v.where(F.col("vec_id") % 100 == 0))
