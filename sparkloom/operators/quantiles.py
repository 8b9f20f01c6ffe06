"""Exact quantiles by rank, for groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..sources.artifacts import stored

#: Rows strictly inside a bracket up to which they are sorted in one task; wider brackets are narrowed first.
LIMIT = 1_000_000
#: Rows of the largest group up to which a group's distinct values are kept in memory; a task holds those of 128 groups at most.
_FEW = 10_000
#: How often a value repeats in the mean, at least, where values are counted without a look at brackets.
_OFTEN = 20
#: A sketch cuts a bracket into so many parts.
_PARTS = 200
#: Brackets up to this number are sent to all tasks (some 100 bytes each).
_SENT = 100_000
_INF = float("inf")


def quantiles(df: DataFrame, col: str | Column, qs: tuple[float, ...], keys: tuple[str, ...] = (), limit: int = LIMIT, name: str = "quantiles", few: int = _FEW, sizes: DataFrame | None = None) -> DataFrame:
    """(keys, ``name``): an array with the exact quantiles ``qs`` of each group's values, linear between neighbouring ranks.
    Null and NaN values don't count; a group without any other has no row.

    Where no group has more than ``few`` rows, one aggregation orders the values of each. Where values repeat often, each is
    counted and the counts are ordered. Else a wanted rank lies in a bracket of values, at first all of them. While a bracket holds more than ``limit`` rows strictly inside,
    a sketch of them gives a narrower one, and one pass counts the rows below and inside it. Only the values of
    brackets so small are counted each and ordered, so a group may be the whole table. Rows that equal
    an end of a bracket are only counted.

    ``sizes`` (keys, _n, _d), if the caller has them: how many values a group has (no row without any) and about how many of them are distinct."""
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    rows = df.select(*[F.col(k) for k in keys], nan_to_null(v).alias("_v")).where("_v IS NOT NULL")
    group = list(keys) or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    ends = [F.lit(q) * (F.col("_n") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*[f(h).cast("long") for h in ends for f in (F.floor, F.ceil)]))
    sizes = stored(rows.groupBy(*group).agg(F.count("*").alias("_n"), about_distinct(F.col("_v")).alias("_d")), "sizes") if sizes is None else sizes
    if not sizes.where(F.col("_n") > few).limit(1).count():
        return rows.groupBy(*group).agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs])).alias(name)).select(*keys, name)
    counted = sizes.agg((F.sum("_n") >= F.sum("_d") * _OFTEN) & (F.max("_d") <= limit)).first()[0]
    want = sizes.select(*group, F.lit(-_INF).alias("_lo"), F.lit(_INF).alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), ranks.alias("_ranks"))
    wide = (F.col("_inside") > limit) & (F.col("_lo") < F.col("_hi"))
    while not counted and want.where(wide).limit(1).count():
        want = stored(_narrowed(rows, want.where(wide), group).unionByName(want.where(~wide)), "brackets")
    bracket = [*group, "_lo", "_hi", "_below", "_ranks"]
    if counted:
        found = _meet(rows.groupBy(*group, "_v").agg(F.count("*").alias("_c")), want, group)
    else:
        found = _meet(rows, want, group).groupBy(*bracket, "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*bracket).orderBy("_v")) + F.col("_below")
    found = found.withColumn("_to", upto)
    hit = F.filter("_ranks", lambda r: (r >= F.col("_to") - F.col("_c")) & (r < F.col("_to")))
    found = found.select(*group, "_v", F.explode(hit).alias("_r")).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))

    def value(h: Column) -> Column:
        low = F.floor(h).cast("long")
        a, b = (F.element_at("_at", r) for r in (low, F.ceil(h).cast("long")))
        return F.when(h == low, a).otherwise((low + 1 - h) * a + (h - low) * b)

    found = sizes.join(found, _same(sizes, found, group)).select(*[sizes[k] for k in keys], "_n", "_at")
    return found.select(*keys, F.array(*[value(h) for h in ends]).alias(name))


def about_distinct(c: Column) -> Column:
    """Within a quarter or so how many distinct values there are: 32 bytes a group, which is enough to choose a plan."""
    return F.approx_count_distinct(c, 0.25)


def _same(a: DataFrame, b: DataFrame, group: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in group])


def _meet(rows: DataFrame, want: DataFrame, group: list[str]) -> DataFrame:
    """Rows with each bracket of their group that they lie in."""
    other = want.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(group)})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(group)])
    other = F.broadcast(other) if want.limit(_SENT + 1).count() <= _SENT else other
    return rows.join(other, on & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop(*[f"_k{i}" for i in range(len(group))])


def _narrowed(rows: DataFrame, want: DataFrame, group: list[str]) -> DataFrame:
    """Narrower brackets. A sketch may be off by a tenth of a part, so two parts to either side are kept; a rank that still
    is outside keeps its old bracket, to be narrowed from there."""
    old = [*group, "_lo", "_hi", "_below", "_inside"]
    met = _meet(rows, want, group)
    grid = F.array(*[F.lit(i / _PARTS) for i in range(_PARTS + 1)])
    inner = F.when((F.col("_v") > F.col("_lo")) & (F.col("_v") < F.col("_hi")), F.col("_v"))
    sketch = met.groupBy(*old, "_ranks").agg(F.percentile_approx(inner, grid, 10 * _PARTS).alias("_s"), F.count_if(F.col("_v") == F.col("_lo")).alias("_at_lo"))
    place = F.floor((F.col("_r") - F.col("_below") - F.col("_at_lo")) / F.col("_inside") * _PARTS).cast("int")
    end = lambda i, other: F.when((i >= 0) & (i <= _PARTS), F.get("_s", i)).otherwise(other)
    new = sketch.select(*old, "_s", "_at_lo", F.explode("_ranks").alias("_r")).withColumn("_p", place)
    new = new.withColumns({"_lo2": end(F.col("_p") - 2, F.col("_lo")), "_hi2": end(F.col("_p") + 3, F.col("_hi"))})
    new = new.groupBy(*old, "_lo2", "_hi2").agg(F.collect_set("_r").alias("_ranks"))
    new = stored(new, "sketch")
    v = F.col("_v")
    counted = _meet(rows, new, group).groupBy(*old, "_lo2", "_hi2", "_ranks").agg(F.count_if(v < F.col("_lo2")).alias("_less"), F.count_if((v > F.col("_lo2")) & (v < F.col("_hi2"))).alias("_in"), F.count_if((v == F.col("_lo2")) | (v == F.col("_hi2"))).alias("_ends"))
    counted = counted.withColumn("_first", F.col("_below") + F.col("_less"))
    counted = counted.withColumn("_good", F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_in") + F.col("_ends"))))
    counted = counted.withColumn("_bad", F.array_except("_ranks", "_good"))
    kept = counted.where(F.size("_good") > 0).select(*group, F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), F.col("_first").alias("_below"), F.col("_in").alias("_inside"), F.col("_good").alias("_ranks"))
    again = counted.where(F.size("_bad") > 0).groupBy(*old).agg(F.array_distinct(F.flatten(F.collect_list("_bad"))).alias("_ranks"))
    return kept.unionByName(again.select(*group, "_lo", "_hi", "_below", "_inside", "_ranks"))
