"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]. Its integral says how many
words the source gets (its target) and, inverted, at which t each of its words is due. A
document copy takes the position of its middle word; the copies are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_words

#: Slices of a source's hash order that get their running sums apart, so that one source
#: with a third of all rows is dealt over as many tasks.
SLICES = 4096


def source_targets(totals: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """``totals`` (source, source_size) -> the same with weight and target.

    Sources take the weights in turn by code point, null last. Together they get ``share`` of
    all words; a target stops at ``cap`` times its source's size and the excess is shared
    by weight among the others: the targets are min(cap * size, level * weight), and the
    level follows from running sums in the order of cap * size / weight. The table has a row
    for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    i = (F.row_number().over(by_name) - 1) % len(weights)
    t = totals.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i + 1).cast("int")).alias("weight"))
    t = t.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level_here", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the level is that of the first source which does not reach its limit
    level = F.min(F.when(F.col("level_here") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("level_here")))).over(everything)["level_here"]
    level = F.coalesce(level, F.lit(float("inf")))
    return t.select("source", "source_size", "weight", F.least("limit", level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3, 1, 2), ramp: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)), slices: int = SLICES) -> DataFrame:
    """Adds size, source_size, target, taken, position and copies to ``docs`` (doc_id, text, source; all
    other columns go).

    Rows of a source are read in the order of md5(doc_id), doc_id, size. The target is spent
    in whole passes over the source and then a last, partial one, whose boundary document gives
    only the words still due; so the taken words of a source sum to its rounded target, and a
    document gives at most ``cap`` times its size. ``ramp`` has, for each source in turn, the
    weight at t = 0 and t = 1 (linear between, mean 1): the demand up to t is
    target * (a t + (b - a) t^2 / 2), and the position of a copy solves it for its middle word.
    ``copies`` has (copy, words, position) of every copy: copy k starts k passes after the first, and
    only the last may give less than the whole document. ``taken`` is the sum of their words;
    ``position`` is that of the first copy, null if nothing is taken.

    Null or empty texts have size 0 and take 0; a null source is a source of its own; repeated
    rows each count; an empty table gives no rows.
    """
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"))
    d = d.withColumn("_slice", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32)).cast("int"))
    # running sums in two steps: over the slices of a source, then inside each slice
    slice_sums = d.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    targets = source_targets(slice_sums.groupBy("source").agg(F.sum("_words").alias("source_size")), share, cap, weights)
    n = len(ramp)
    nth = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % n
    pick = lambda j: F.element_at(F.array(*[F.lit(float(r[j])) for r in ramp]), (nth + 1).cast("int"))
    targets = targets.withColumns({"_from": pick(0), "_to": pick(1)})
    w = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slice_sums.withColumn("_before", F.coalesce(F.sum("_words").over(w), F.lit(0)))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"], "_slice", "_before", "source_size", "target", "_from", "_to")
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    j = d.join(starts, d["source"].eqNullSafe(starts["source"]) & (d["_slice"] == starts["_slice"])).select("doc_id", d["source"], "size", "source_size", "target", (F.col("_at") + F.col("_before")).alias("_at"), "_from", "_to")
    due = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    j = j.withColumns({"_passes": passes, "_left": F.greatest(F.lit(0), F.least(F.col("size"), due - passes * F.col("source_size") - F.col("_at"))).cast("long")})

    def copy(k):
        words = F.when(k < F.col("_passes"), F.col("size")).otherwise(F.col("_left"))
        part = (k * F.col("source_size") + F.col("_at") + words / 2) / F.col("target")
        return F.struct(k.alias("copy"), words.alias("words"), F.when(words > 0, due_time(part, F.col("_from"), F.col("_to"))).alias("position"))

    j = j.withColumn("copies", F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_passes")), copy), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return j.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.get("copies", F.lit(0))["position"].alias("position"), "copies")


def due_time(part, start, end):
    """The t at which the integral of the linear schedule start..end (mean 1) reaches ``part``."""
    slope = (end - start) / 2
    root = (-start + F.sqrt(F.greatest(F.lit(0.0), start * start + 4 * slope * part))) / (2 * slope)
    return F.least(F.lit(1.0), F.when(slope == 0, part / start).otherwise(root))


def curriculum_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The documents in the order of their first copies: ranges of positions, each sorted; rows that
    take nothing first. The training order is that of all copies: ordered_copies()."""
    return _by_position(mixed, ("position", "doc_id"), partitions)


def ordered_copies(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mix in training order, a row for each copy: ``taken`` is its words, ``position`` its own, ``copy``
    its number from 0. Documents that give nothing come first, once, with a null copy and position."""
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", F.explode_outer("copies").alias("_c"))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", F.col("_c.copy").alias("copy"), F.coalesce("_c.words", F.lit(0)).cast("long").alias("taken"), F.col("_c.position").alias("position"))
    return _by_position(rows, ("position", "doc_id", "copy"), partitions)


def _by_position(rows: DataFrame, keys: tuple[str, ...], partitions: int | None) -> DataFrame:
    return (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return curriculum_order(mix_sources(docs)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS lim FROM s),
v AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(lim) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w),
l AS (SELECT min_by(here, lim / weight) AS level FROM v WHERE here * weight <= lim),
t AS (SELECT source, source_size, least(lim, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM v, l),
r AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS due,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END
        + greatest(0, least(size, due - CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END * source_size - pos)))::BIGINT AS taken
FROM r
"""
