"""Tables of a run: a folder with one Parquet dataset for each artifact."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the artifacts, for those that are missing.
SCHEMAS = {
    "texts": "text_id long, source string, text string",
    "token_metadata": "text_id long, source string, token_pos long, token_id long, token_str string",
    "sae_activations_topk": "text_id long, source string, token_pos long, token_str string, feature_id long, activation double",
    "sae_activations_positive": "text_id long, source string, token_pos long, token_str string, feature_id long, activation double",
    "token_activation_summary": "text_id long, source string, token_pos long, token_str string, n_positive_features long",
    "residual_vectors": "text_id long, source string, token_pos long, vector array<float>",
    "directions": "feature_id long, vector array<float>",
    "feature_stats": "feature_id long, n_token_activations long, n_texts long, mean_activation double, max_activation double, p50_activation double, p95_activation double, p99_activation double, token_frequency double, text_frequency double",
    "top_feature_examples": "feature_id long, rank int, activation double, text_id long, source string, token_pos long, token_str string, left_context string, center_token string, right_context string",
    "coactivation_pairs": "feature_i long, feature_j long, coactivation_count long, feature_i_count long, feature_j_count long, jaccard double, pmi double, p_j_given_i double, p_i_given_j double",
    "decoder_neighbors": "feature_i long, feature_j long, rank int, decoder_cosine double",
    "bimodal_feature_candidates": "feature_id long, n_points long, bic_1 double, bic_2 double, bimodality_score double, log_mean_low double, log_mean_high double, activation_min double, activation_p50 double, activation_p95 double, activation_max double",
    "feature_cards": "feature_id long",
}
SCHEMAS["filtered_features"] = SCHEMAS["feature_stats"]


#: Artifacts that runs join again and again, and the column that they are dealt by: facts and tokens by text, evidence by feature.
BUCKETS = {"filtered_activations": "text_id", "token_metadata": "text_id"} | {
    name: "feature_id" for name in ("feature_stats", "filtered_features", "feature_cards", "bimodal_feature_candidates", "inspection_feature_summaries", "decoder_feature_pca", "feature_coverage_profiles", "feature_graph_alignment")}
_NOTE = "_buckets"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str, by: str | None = None, buckets: int | None = None) -> None:
    """Replaces the dataset at ``path``. Rows go to a folder beside it first and take its place when
    they are complete, so a plan may read the dataset that it replaces.

    With ``by`` the rows are dealt into ``buckets`` (by default as many as shuffle partitions) of that column and sorted by it in each,
    one file a bucket, so plans that join or group by it need no exchange. A note in the folder tells readers of it."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    p, s = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, staged))
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if by is None:
        df.write.parquet(staged)
    else:
        n, name = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"staged_{uuid.uuid4().hex}"
        df.repartition(n, by).write.bucketBy(n, by).sortBy(by).format("parquet").option("path", staged).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
        note = files.create(spark._jvm.org.apache.hadoop.fs.Path(staged, _NOTE))
        note.write(bytearray(f"{n} {by}", "utf-8"))
        note.close()
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    had = files.exists(p) and files.rename(p, old)
    if not files.rename(s, p):
        raise OSError(f"cannot move {staged} to {path}" + (f"; what it replaces is at {old}" if had else ""))
    if had:
        files.delete(old, True)


def _bucketed(spark: SparkSession, path: str) -> DataFrame | None:
    """The dataset at ``path`` with its buckets, if it has such; its table in the catalog is renewed each time."""
    note = spark._jvm.org.apache.hadoop.fs.Path(path, _NOTE)
    files = note.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(note):
        return None
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(files.open(note)))
    n, by = reader.readLine().split(" ", 1)
    reader.close()
    df = spark.read.parquet(path)
    name = f"run_{hashlib.md5(path.encode()).hexdigest()}_{uuid.uuid4().hex[:8]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all tasks run
    on this machine, one of our own; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there goes when the session ends, if nothing deletes it before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for plans that read it more than once; it cuts lineage and outlives any
    executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The dataset at ``path``; an empty table of ``schema`` if it is missing, an error if there is none."""
    if exists(spark, path):
        got = _bucketed(spark, path)
        return spark.read.parquet(path) if got is None else got
    if schema is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.createDataFrame([], schema)


def write_vectors(df: DataFrame, path: str, col: str = "vector") -> None:
    write_table(df.withColumn(col, F.transform(col, lambda x: x.cast("float"))), path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SCHEMAS["residual_vectors"])


def read_directions(spark: SparkSession, *paths: str) -> DataFrame:
    """The direction vectors under the first of ``paths`` that exists."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError("no direction vectors at " + ", ".join(paths))


class Run:
    """Lazy tables of a run folder: run.table(name), or run.<name>() for the names in SCHEMAS."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.written: list[str] = []

    def at(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def has(self, name: str) -> bool:
        return exists(self.spark, self.at(name))

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.at(name), SCHEMAS.get(name, "feature_id long"))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes an artifact; those of BUCKETS by their column."""
        write_table(df, self.at(name), BUCKETS.get(name))
        self.written.append(name)
        return self.table(name)

    def sae_activations(self) -> DataFrame:
        """Top-k activations, or else all positive ones."""
        return self.table("sae_activations_topk" if self.has("sae_activations_topk") else "sae_activations_positive")

    def __getattr__(self, name: str):
        if name not in SCHEMAS:
            raise AttributeError(f"no artifact is named {name}")
        return lambda: self.table(name)


def profile_artifacts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """artifact, present, n_rows, n_columns, n_nulls (map of column to nulls) of each table, one scan each."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    out = None
    for name, df in tables.items():
        if df is None:
            one = spark.range(1).select(F.lit(name).alias("artifact"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("n_rows"), F.lit(0).alias("n_columns"), F.create_map().cast("map<string,bigint>").alias("n_nulls"))
        else:
            nulls = [x for c in df.columns for x in (F.lit(c), F.count_if(F.col(f"`{c}`").isNull()))]
            one = df.agg(F.count("*").alias("n_rows"), F.create_map(*nulls).alias("n_nulls")).select(F.lit(name).alias("artifact"), F.lit(True).alias("present"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_nulls")
        out = one if out is None else out.unionByName(one)
    return out
