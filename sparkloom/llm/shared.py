"""Shared-folder tables, text hashing and the connected-components loop used by the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator that counts words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is
    unset and all tasks run on this machine, one of our own; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives any executor.
    Its folder goes with drop() or with the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    have, name = {c.lower() for c in df.columns}, f"_{name}"
    while name.lower() in have:
        name += "_"
    return name


#: Bits of the filter of split_by_keys(), as a table of at most 2**16 words that is sent to all tasks (about 20 MB when full).
_FILTER_BITS = 22


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose column ``key`` may be in the only column of ``keys``, and rows where it surely is not. A bitmap of
    fixed size tells, so a join behind it moves few rows and decides; with many keys the first part grows, no result changes."""
    word, bits = fresh(df, "word"), fresh(df, "bits")
    at = lambda h: (F.shiftrightunsigned(h, 64 - _FILTER_BITS + 6), (F.shiftrightunsigned(h, 64 - _FILTER_BITS) % 64).cast("int"))
    w, b = at(F.xxhash64(keys.columns[0]))
    words = written(keys.select(w.alias(word), b.alias("b")).groupBy(word).agg(F.collect_set("b").alias(bits)), "filter")  # up to 64 bits a word
    w, b = at(F.xxhash64(key))
    marked = df.withColumn(word, w).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.array_contains(bits, b), F.lit(False))
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)


def crc_mod(col: str, m: int):
    """crc32 of the id as text, modulo m (null id: null)."""
    return F.crc32(F.col(col).cast("string")) % m


def n_words(col):
    """Number of words of a text; null counts 0. The pieces between separators, less the empty ones at either end."""
    t = F.coalesce(col, F.lit(""))
    edge = lambda c: c.isin(*" \t\n\x0b\x0c\r").cast("int")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+")) - edge(F.left(t, F.lit(1))) - edge(F.right(t, F.lit(1)))).cast("long")


# --- vectorised word and shingle hashes -------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = bytes(c in (9, 10, 11, 12, 13, 32) for c in range(256))
_POW = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if _POW["n"] < n:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("up", _P), ("down", _P_INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POW[key] = np.cumprod(x, dtype=np.uint64)
        _POW["n"] = size
    return _POW["up"][:n], _POW["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (a finaliser of xor-shifts and multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of the whole text, A-Z in lower case. Polynomial hashes
    come from a running sum over the bytes, so no word is made into a Python object."""
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").join((b" ", b" ")).translate(_LOWER)
    sep = np.frombuffer(data.translate(_SPACE), np.uint8)
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1  # a start and an end of each word in turn
    if not len(edge):
        return np.empty(0, np.uint64)
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    b += np.uint64(1)
    b *= up[:-1]
    np.cumsum(b, out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int, short: bool = False) -> np.ndarray:
    """Hashes of the runs of k words, in order, repeats kept. With ``short`` a text of fewer
    than k words gives its whole sequence as one."""
    n = len(words)
    if n < k:
        if not short or not n:
            return np.empty(0, np.uint64)
        k = n
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out *= _P
        out += words[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def sorted_set(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    x = np.sort(x)
    if len(x) > 1:
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
    return x


# --- connected components ---------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), as a written table; nodes without an
    edge are not listed. Each round a node and the node that is its label take the smallest label of
    a label met among the node's neighbours, so labels hook onto labels and paths halve. Labels only
    fall, and rounds go on until none changes; a path of n nodes takes about log2(n). Every round
    is a written table, so a lost executor costs one round at most; a round's table goes as the next
    one stands. Only a count reaches the driver."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    table = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "label")
    while True:
        label = table.select("node", "component")
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = label.join(jump, "component").select("node", "component", "up")
        near = both.join(step.select(F.col("node").alias("b"), "up"), "b").groupBy(F.col("a").alias("node")).agg(F.min("up").alias("m"))
        met = near.join(label, "node").select("node", "component", "m")
        roots = met.groupBy(F.col("component").alias("node")).agg(F.min("m").alias("hook"))
        new = step.join(met.select("node", "m"), "node").join(roots, "node", "left")
        new = written(new.select("node", F.col("component").alias("old"), F.least("up", "m", "hook").alias("component")), "label")  # least() passes over nulls
        changed = new.where("old <> component").limit(1).count()
        drop(table)
        table = new
        if not changed:
            drop(both)
            label = table.select("node", "component")
            label.stored_at = table.stored_at
            return label
