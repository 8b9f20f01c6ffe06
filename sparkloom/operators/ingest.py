"""From texts and dense vectors to the sparse fact table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import has_nonfinite
from ..sources.artifacts import stored

#: Words with a leading space, runs of white space, runs of anything else.
TOKEN = r"( ?[\p{L}\p{N}]+|[ \t\r\n]+|[^\p{L}\p{N} \t\r\n]+)"
START = "<bos>"


def tokens_of(text: Column) -> Column:
    """The start token and the default tokens of a text."""
    return F.concat(F.array(F.lit(START)), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)))


def explode_tokens(texts: DataFrame, tokens_col: str | None = None, max_seq_len: int | None = 256, start: str | None = START) -> DataFrame:
    """(text_id, source, token_pos, token_id, token_str): one row a token, cut to ``max_seq_len`` if given.
    ``tokens_col`` is an array of strings, to which ``start`` is put in front; without it the default
    tokens of ``text`` are taken. token_id is a 64-bit hash of the token."""
    if tokens_col is None:
        tokens = tokens_of(F.col("text"))
    else:
        tokens = F.concat(F.array(F.lit(start)), F.col(tokens_col)) if start is not None else F.col(tokens_col)
    if max_seq_len is not None:
        tokens = F.slice(tokens, 1, max_seq_len)
    out = texts.select("text_id", "source", F.posexplode(tokens).alias("token_pos", "token_str"))
    return out.select("text_id", "source", F.col("token_pos").cast("long").alias("token_pos"), F.xxhash64("token_str").alias("token_id"), "token_str")


#: Features of a block of the dictionary, and vectors that meet a block together.
_FEATURES, _VECTORS = 1024, 1024
#: Numbers of the dictionary that the tasks of one part of it read for each block of vectors.
_PART = 1 << 26


def dictionary(spark: SparkSession, weights: np.ndarray, bias: np.ndarray, threshold: np.ndarray | float = 0.0) -> DataFrame:
    """A model's dictionary as a table (feature_id, weights, bias, threshold), a row a feature, from ``weights`` (d, features),
    ``bias`` and ``threshold`` (a number or one a feature)."""
    weights = np.asarray(weights, np.float64)
    n = weights.shape[1]
    t = np.broadcast_to(np.asarray(threshold, np.float64), (n,))
    rows = pa.table({"feature_id": pa.array(np.arange(n)), "weights": pa.array(list(weights.T), pa.list_(pa.float64())), "bias": pa.array(np.asarray(bias, np.float64)), "threshold": pa.array(t)})
    return spark.createDataFrame(rows)


def _feature_blocks(features: DataFrame) -> DataFrame:
    """The dictionary in blocks of up to _FEATURES features: ids, weights, bias and threshold as binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _FEATURES):
                part = batch.slice(at, _FEATURES)
                cols = [part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *[part.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3)]]
                w = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (cols[0], w, cols[1], cols[2])], names=["f_ids", "f_weights", "f_bias", "f_threshold"])

    return features.select("feature_id", "weights", "bias", "threshold").mapInArrow(run, "f_ids binary, f_weights binary, f_bias binary, f_threshold binary")


def _vector_blocks(vectors: DataFrame) -> DataFrame:
    """Rows (_row, vector) in blocks of up to _VECTORS: numbers of the rows and vectors as binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _VECTORS):
                part = batch.slice(at, _VECTORS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["v_rows", "v_data"])

    return vectors.select("_row", "vector").mapInArrow(run, "v_rows binary, v_data binary")


def _best(row: np.ndarray, f: np.ndarray, s: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores (row, feature, score) the ``k`` largest of each row, ties to the smaller feature; all without ``k``."""
    order = np.lexsort((f, -s, row))
    row, f, s = row[order], f[order], s[order]
    if k is None or not len(row):
        return row, f, s
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
    return row[keep], f[keep], s[keep]


def encode(vectors: DataFrame, features: DataFrame, k: int | None = None, min_activation: float = 0.0) -> DataFrame:
    """Every row of ``vectors`` (text_id, source, token_pos, token_str, vector) with activations, its scores against the
    dictionary ``features`` as an array of struct<feature_id, activation>, largest first (ties: smaller feature), and
    n_positive_features. A score is relu(x w + b), zero where it is not above the feature's threshold; those above ``min_activation``
    count, and of these the first ``k`` are kept.

    Blocks of vectors meet blocks of features one after the other in a task, as one matrix product each; the best of each
    vector and the count run along, so positive scores are neither kept nor written, and no task holds the
    dictionary. A dictionary of more than _PART numbers is dealt over several tasks a block of vectors, whose bests are merged."""
    rows = stored(vectors.select("text_id", "source", "token_pos", "token_str", "vector").withColumn("_row", F.monotonically_increasing_id()), "vectors")
    numbers = features.agg(F.coalesce(F.sum(F.size("weights").cast("long")), F.lit(0))).first()[0]
    blocks = stored(_feature_blocks(features.coalesce(1)) if numbers <= _PART else _feature_blocks(features.repartition(-(-numbers // _PART))), "features")
    if numbers <= _PART:
        blocks = blocks.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = best = None

        def done():
            ids, positive, (row, f, s) = np.frombuffer(at.as_buffer(), np.int64), best[0], best[1]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(ids))))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(f), pa.array(s)], names=["feature_id", "activation"])
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(positive)], names=["_row", "activations", "n"])

        for batch in batches:
            for v_rows, v_data, f_ids, w, b, t in zip(*batch.columns):
                if at is None or not at.equals(v_rows):
                    if at is not None:
                        yield done()
                    at, n = v_rows, len(v_rows.as_buffer()) // 8
                    best = [np.zeros(n, np.int64), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
                    x, least = np.frombuffer(v_data.as_buffer()).reshape(n, -1), np.full(n, -np.inf)
                ids = np.frombuffer(f_ids.as_buffer(), np.int64)
                score = np.maximum(x @ np.frombuffer(w.as_buffer()).reshape(len(ids), -1).T + np.frombuffer(b.as_buffer()), 0.0)
                score[score <= np.frombuffer(t.as_buffer())] = 0.0
                good = score > min_activation
                best[0] = best[0] + good.sum(1)
                row, f = np.nonzero(good & (score >= least[:, None]))
                row, f, s = _best(*(np.concatenate(c) for c in zip(best[1], (row, ids[f], score[row, f]))), k)
                best[1] = row, f, s
                if k is not None:
                    full = np.flatnonzero(np.bincount(row, minlength=n) >= k)
                    least[full] = s[np.searchsorted(row, full, "right") - 1]
        if at is not None:
            yield done()

    # blocks with blocks: the product that is asked for. The hint keeps the pairs of a block of vectors together
    met = _vector_blocks(rows).crossJoin(blocks.hint("shuffle_replicate_nl"))
    item = "array<struct<feature_id: bigint, activation: double>>"
    found = met.mapInArrow(run, f"_row long, activations {item}, n long")
    # the same key as the join below, so bests of several tasks meet without an exchange of their own
    order = F.array_sort(F.flatten(F.collect_list(F.transform("activations", lambda a: F.struct((-a["activation"]).alias("a"), a["feature_id"].alias("f"))))))
    found = found.groupBy("_row").agg(order.alias("a"), F.sum("n").alias("n"))
    found = found.select("_row", F.transform(F.slice("a", 1, k) if k is not None else F.col("a"), lambda x: F.struct(x["f"].alias("feature_id"), (-x["a"]).alias("activation"))).alias("activations"), "n")
    none = F.expr(f"CAST(array() AS {item})")
    return rows.join(found, "_row", "left").select("text_id", "source", "token_pos", "token_str", F.coalesce("activations", none).alias("activations"), F.coalesce("n", F.lit(0)).cast("long").alias("n_positive_features"))


def encoded_rows(encoded: DataFrame) -> DataFrame:
    """The activations of encode() as rows: text_id, source, token_pos, token_str, feature_id, activation."""
    return encoded.select("text_id", "source", "token_pos", "token_str", F.explode("activations").alias("a")).select("text_id", "source", "token_pos", "token_str", "a.feature_id", "a.activation")


def encode_vectors(vectors: DataFrame, weights: np.ndarray, bias: np.ndarray, threshold: np.ndarray | float = 0.0, min_activation: float = 0.0) -> DataFrame:
    """All scores of dense token vectors above ``min_activation`` against a dictionary at hand, as rows."""
    return encoded_rows(encode(vectors, dictionary(vectors.sparkSession, weights, bias, threshold), None, min_activation))


def activations_of(df: DataFrame, vec_col: str = "vector") -> DataFrame:
    """One row for each component of a vector: feature_id is its place from 0."""
    keep = [c for c in df.columns if c != vec_col]
    return df.select(*keep, F.posexplode(vec_col).alias("feature_id", "activation")).withColumns({"feature_id": F.col("feature_id").cast("long"), "activation": F.col("activation").cast("double")})


def sparsify_positive(df: DataFrame, vec_col: str = "vector") -> DataFrame:
    """All activations above 0."""
    return activations_of(df, vec_col).where("activation > 0")


def sparsify_topk(df: DataFrame, k: int, vec_col: str = "vector") -> DataFrame:
    """Of each vector the k largest activations (ties: smaller feature), and of these the positive ones.
    The choice is made inside the row, so it needs no exchange."""
    v = F.transform(vec_col, lambda x, i: F.struct((-x.cast("double")).alias("a"), i.cast("long").alias("f")))
    keep = [c for c in df.columns if c != vec_col]
    out = df.select(*keep, F.explode(F.slice(F.array_sort(v), 1, k)).alias("e"))
    return out.select(*keep, F.col("e.f").alias("feature_id"), (-F.col("e.a")).alias("activation")).where("activation > 0")


def sparsify_topk_rows(acts: DataFrame, k: int) -> DataFrame:
    """The same for activations that are rows already: by (text_id, token_pos)."""
    w = Window.partitionBy("text_id", "token_pos").orderBy(F.desc("activation"), "feature_id")
    return acts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r").where("activation > 0")


def token_activation_summary(df: DataFrame, vec_col: str = "vector") -> DataFrame:
    """n_positive_features of every token, before any choice; tokens without one stay."""
    keep = [c for c in ("text_id", "source", "token_pos", "token_str") if c in df.columns]
    return df.select(*keep, F.size(F.filter(vec_col, lambda x: x > 0)).cast("long").alias("n_positive_features"))


def sample_vectors(vectors: DataFrame, stride: int = 8) -> DataFrame:
    """Tokens at positions 0, stride, 2 stride, ..."""
    return vectors.where(F.col("token_pos") % stride == 0)


def drop_nonfinite_texts(vectors: DataFrame, *vec_cols: str) -> DataFrame:
    """Without the texts that have a NaN or an infinity in any vector."""
    bad = F.lit(False)
    for c in vec_cols or ("vector",):
        bad = bad | has_nonfinite(F.col(c))
    return vectors.join(vectors.where(bad).select("text_id").distinct(), "text_id", "left_anti")


def collect_metrics(acts: DataFrame, meta: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row: texts and tokens of ``meta``, rows and features of ``acts``, sampled vectors."""
    m = meta.agg(F.count_distinct("text_id").alias("n_texts"), F.count_distinct("text_id", "token_pos").alias("n_tokens"))
    a = acts.agg(F.count("*").alias("n_activation_rows"), F.count_distinct("feature_id").alias("n_features"))
    out = m.crossJoin(a)  # one row each
    if vectors is not None:
        out = out.crossJoin(vectors.agg(F.count("*").alias("n_vectors")))
    return out
