"""Text corpora: readers, mixing by quota, probes, and the JSON sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .artifacts import stored

# The probe rows (source, text).
PROBES = [
    ("manual_code", "Python functions, classes, loops, and dictionaries organize computation."),
    ("manual_science", "In quantum mechanics, measurement changes the state of a physical system."),
    ("manual_finance", "The company reported higher revenue but lower operating margins."),
    ("manual_health", "A healthy training plan balances strength, endurance, mobility, and recovery."),
    ("manual_assistant", "The user asked the assistant to explain the concept step by step."),
    ("manual_math", "Linear algebra studies vectors, matrices, eigenvalues, and projections."),
    ("manual_security", "The phishing email asked the recipient to reset their password."),
    ("manual_literature", "The old house stood at the edge of the forest."),
]
MATH_PROBES = [
    "Eigenvectors define directions that are only scaled by a linear transformation.",
    "Gradient descent updates parameters in the opposite direction of the loss gradient.",
    "A covariance matrix describes how pairs of variables vary together.",
    "Principal component analysis rotates data into directions of maximum variance.",
    "Conditional probability measures the probability of an event after observing evidence.",
]
CODE_PROBES = [
    "A Python decorator wraps a function and can modify its behavior before returning it.",
    "Hash maps provide average constant-time lookup for keys when collisions are controlled.",
    "A unit test should isolate one behavior and assert the expected output clearly.",
    "Vectorized NumPy operations avoid slow Python loops over individual elements.",
    "A command-line interface should validate arguments before launching expensive jobs.",
]
#: Slices of the mixing presets in percent, and which of them take at least one row.
PRESETS = {"research": (50, 50), "broad": (25, 25, 20, 15, 5, 5), "large": (35, 25, 20, 10, 10)}
AT_LEAST_ONE = {"broad": (4, 5)}


def read_jsonl_corpus(spark: SparkSession, path: str, max_items: int | None = None) -> DataFrame:
    """(source, text) of JSON-lines files: the first ``max_items`` rows, in the order of files and lines, are taken before
    cleaning drops those without text; a missing source becomes custom-jsonl. Blank lines are no rows.

    The place where the limit falls is found from the number of rows of each split; only the split that it falls into
    is put in order."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("_split"), F.monotonically_increasing_id().alias("_at"))
    lines = lines.where(F.trim("value") != "")
    if max_items is not None:
        splits = lines.groupBy("_split").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.orderBy("_split")) - F.col("_n")  # a row for each split
        last = splits.withColumn("_before", before).where(F.col("_before") < max_items).agg(F.max(F.struct("_split", (F.lit(max_items) - F.col("_before")).alias("left"))).alias("_last"))
        lines = lines.crossJoin(F.broadcast(last))  # one row
        whole = lines.where(F.col("_split") < F.col("_last._split"))
        cut = lines.where(F.col("_split") == F.col("_last._split")).withColumn("_nth", F.row_number().over(Window.partitionBy("_split").orderBy("_at"))).where(F.col("_nth") <= F.col("_last.left"))
        lines = whole.select("value").unionByName(cut.select("value"))
    rows = lines.select(F.from_json("value", "source string, text string").alias("r"))
    return rows.select(F.coalesce("r.source", F.lit("custom-jsonl")).alias("source"), clean_text(F.col("r.text")).alias("text")).where(F.length("text") > 0)


def read_text_table(df: DataFrame, source: str, text_field: str = "text", min_chars: int = 0, max_items: int | None = None, order_by: str | None = None) -> DataFrame:
    """(source, text) of a table: cleaned, at least ``min_chars`` characters, and then the first
    ``max_items`` rows, in the order of ``order_by``."""
    out = df.withColumn("text", clean_text(F.col(text_field))).where(F.length("text") >= min_chars).withColumn("source", F.lit(source))
    if max_items is not None:
        out = (out.orderBy(order_by) if order_by else out).limit(max_items)
    keep = [order_by] if order_by and order_by not in ("source", "text") else []
    return out.select(*keep, "source", "text")


def quotas(percents, max_items: int, at_least_one: tuple[int, ...] = ()) -> list[int]:
    """Rows of each slice by whole-number division; slices in ``at_least_one`` get one row or more."""
    if tuple(percents) == (50, 50):
        return [max_items // 2, max_items - max_items // 2]
    return [max(1, max_items * p // 100) if i in at_least_one else max_items * p // 100 for i, p in enumerate(percents)]


def mix_corpora(slices: list[tuple[DataFrame, int]], max_items: int, fallback: DataFrame | None = None, order_by: str = "id", at_least_one: tuple[int, ...] = (), dedupe_topup: bool = False) -> DataFrame:
    """The first rows of each (table, percent) slice up to its quota, in slice order, cut to
    ``max_items``. What slices fall short of is topped up from the beginning of ``fallback``, so its
    rows may repeat unless ``dedupe_topup``. Tables are (``order_by``, source, text); the result adds
    slice and nth. Each slice is one bounded top-n; nothing is ordered as a whole."""
    parts, used = [], 0
    for i, ((df, _), n) in enumerate(zip(slices, quotas([p for _, p in slices], max_items, at_least_one))):
        parts.append(_first(df, order_by, min(n, max_items)).withColumn("slice", F.lit(i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    used = out.count()
    if used < max_items and fallback is not None:
        rest = fallback.join(out.select(order_by), order_by, "left_anti") if dedupe_topup else fallback
        out = out.unionByName(_first(rest, order_by, max_items - used).withColumn("slice", F.lit(len(slices))))
    return out.orderBy("slice", "nth").limit(max_items)


def mix_preset(preset: str, loaders: list[Callable[[], DataFrame]], fallback: DataFrame, max_items: int, order_by: str = "id", dedupe_topup: bool = False) -> DataFrame:
    """``mix_corpora`` with the percents of a preset. Each slice is opened by its loader; where Spark can't find or
    resolve what that reads, ``fallback`` takes the slice's place with the same quota."""
    percents = PRESETS[preset]
    if len(loaders) != len(percents):
        raise ValueError(f"{preset} mixes {len(percents)} slices, not {len(loaders)}")

    def opened(load):
        try:
            return load().select(order_by, "source", "text")
        except AnalysisException:
            return fallback

    slices = [(opened(load), p) for load, p in zip(loaders, percents)]
    return mix_corpora(slices, max_items, fallback, order_by, AT_LEAST_ONE.get(preset, ()), dedupe_topup)


def _first(df: DataFrame, order_by: str, n: int) -> DataFrame:
    top = df.select(order_by, "source", "text").orderBy(order_by).limit(n)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(order_by)))


def probe_rows(spark: SparkSession, kind: str = "manual") -> DataFrame:
    """The probe rows: manual, math or code."""
    rows = {"manual": PROBES, "math": [("manual_math", t) for t in MATH_PROBES], "code": [("manual_code", t) for t in CODE_PROBES]}[kind]
    return spark.createDataFrame(rows, "source string, text string")


def append_probes(df: DataFrame) -> DataFrame:
    return df.select("source", "text").unionByName(probe_rows(df.sparkSession))


def build_text_dataset(corpus: DataFrame, max_texts: int | None = None, order_by: str | None = None) -> DataFrame:
    """(text_id, source, text): corpus rows, then the probes, cut to ``max_texts`` (if given),
    numbered from 0. Rows are written once with their place in their partition; partitions' sizes give the
    rest of the number, so no task sees all rows and texts stay in the JVM."""
    first = corpus.orderBy(order_by) if order_by else corpus
    if max_texts is not None:
        first = first.limit(max(max_texts - len(PROBES), 0))
    first = first.select("source", "text")
    rows = stored(append_probes(first).withColumn("_at", F.monotonically_increasing_id()), "texts").withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition
    out = rows.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("text_id"), "source", "text")
    return out if max_texts is None else out.where(F.col("text_id") < max_texts)


def write_texts(df: DataFrame, path: str) -> None:
    """Texts as JSON lines, and a summary of their sources as CSV beside them."""
    from ..operators.stats import summarize_text_sources

    df.write.mode("overwrite").json(f"{path}/texts")
    summarize_text_sources(df).write.mode("overwrite").option("header", True).csv(f"{path}/text_sources")
