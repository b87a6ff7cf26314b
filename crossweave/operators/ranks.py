"""Ranks inside groups without putting a whole group into one task.

A month's cross-section can hold a third of all rows, so a plain window over the
month would sort it in one task. Here the values are counted per (group, value),
which combines in the map tasks; the counts are dealt out by ranges of (group,
value), so a large group lies in many partitions; a window runs over each
(group, partition) cell; and one row per cell carries what lies in lower cells.
There is one path for groups of every size, and ranks broadcast nothing by force
(`rows_at` does, a row per wanted place):
AQE broadcasts the counts where they are small, and splits the rows of a value
with very many copies where they are not. Row numbers deal out the rows
themselves, by ranges of (group, value, tie).

The dealt table is written (see `stage`), because the cells' offsets and the
cells must come from the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.session import stage

#: Steps that a value's logarithm is counted by, to each power of e.
STEPS = 64


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be NULL; the right side's copies of the keys go."""
    named = right.select(*[F.col(k).alias(f"__k{i}") if k in keys else F.col(k) for i, k in
                           sorted((keys.index(k) if k in keys else -1, k) for k in right.columns)])
    on = [left[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(keys)]
    return left.join(named, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def _dealt(df: DataFrame, keys: list[str], order: list[str], weight: Column) -> DataFrame:
    """df dealt out by ranges of (keys, order), with what lies before and in total.

    Adds __part, __run (sum of `weight` up to and with the row, in its group and
    partition), __off (the same in lower partitions) and __all (in the group).
    """
    cells = stage(df.withColumn("__w", weight).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    group = W.partitionBy(*keys)
    lower = group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (cells.groupBy(*keys, "__part").agg(F.sum("__w").alias("__sum"))
               .select(*keys, "__part", F.coalesce(F.sum("__sum").over(lower), F.lit(0)).alias("__off"), F.sum("__sum").over(group).alias("__all")))
    inside = W.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined(cells.withColumn("__run", F.sum("__w").over(inside)), offsets, [*keys, "__part"], "left")


def value_counts(df: DataFrame, keys: list[str], value: str, distinct: bool = False) -> DataFrame:
    """One row per group and non-null value: (keys, __v, __t, __below, __all).

    __t counts the value's copies, __below the rows of the group with lower
    values, __all the rows of the group; with `distinct`, the last two count
    different values instead.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__t"))
    out = _dealt(counts, keys, ["__v"], F.lit(1).cast("long") if distinct else F.col("__t"))
    return out.select(*keys, "__v", "__t", (F.col("__off") + F.col("__run") - F.col("__w")).alias("__below"), "__all")


def split_rank(df: DataFrame, keys: list[str], value: str, tie: str, *, kind: str = "average",
               rank: str = "rank", total: str | None = None, ties: str | None = None, ascending: bool = True) -> DataFrame:
    """Add the rank of `value` inside `keys` (NULL stays NULL).

    kind: "average" (ties share their mean rank), "dense", or "row" (ties ordered
    by `tie` ascending, so all ranks differ). total / ties: optional output columns
    with the group's non-null row count (distinct values for "dense") and the
    number of copies of the row's value ("average" only).
    """
    v = F.col(value).cast("double")
    work = df.withColumn("__value", v if ascending else -v)
    if kind == "row":
        out = _dealt(work, keys, ["__value", tie], F.col("__value").isNotNull().cast("long"))
        place, n = F.col("__off") + F.col("__run"), F.col("__all")
    else:
        counts = value_counts(work, keys, "__value", distinct=kind == "dense")
        out = joined(work, counts.withColumnRenamed("__v", "__value"), [*keys, "__value"], "left")
        place = F.col("__below") + (F.lit(1) if kind == "dense" else (F.col("__t") + 1) / 2)
        n = F.col("__all")
    known = F.col("__value").isNotNull()
    added = {rank: place, **({total: n} if total else {}), **({ties: F.col("__t")} if ties else {})}
    return out.select(*df.columns, *[F.when(known, c).alias(name) for name, c in added.items()])


def rows_at(df: DataFrame, keys: list[str], value: str, tie: str, places: Callable[[Column], Column]) -> DataFrame:
    """The rows at some places of each group's order (value, tie): (keys, value, tie, __place, __total), null values left out.

    places makes the array of wanted places from the number of the group's values; a place that is asked for twice comes twice. Values are counted by steps
    of their logarithm, which combines in the map tasks; only the rows of a step that holds a wanted place are sorted.
    """
    v = F.col(value).cast("double")
    step = F.when(F.isnan(v), F.lit(2 ** 63 - 1)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * STEPS)).cast("long")
    known = df.select(*keys, value, tie, step.alias("__step")).filter(F.col(value).isNotNull())
    whole = W.partitionBy(*keys)
    lower = whole.orderBy("__step").rowsBetween(W.unboundedPreceding, -1)
    counts = known.groupBy(*keys, "__step").agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, "__step", "__n", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__lower"), F.sum("__n").over(whole).alias("__total"))
    inside = F.filter(places(F.col("__total")), lambda p: (p > F.col("__lower")) & (p <= F.col("__lower") + F.col("__n")))
    wanted = counts.withColumn("__wanted", inside).where(F.size("__wanted") > 0).drop("__n")
    near = split_rank(joined(known, F.broadcast(wanted), [*keys, "__step"], "inner"), [*keys, "__step"], value, tie, kind="row", rank="__r")
    here = F.filter("__wanted", lambda p: p == F.col("__lower") + F.col("__r"))
    return near.select(*keys, value, tie, F.explode(here).alias("__place"), "__total")


def rank_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population sd of the average-tie ranks per group: (keys, rank_mean, rank_sd).

    They follow from the sizes of the tie groups, so the ranks themselves are not
    needed: the variance is (n^2 - 1) / 12 less sum(t^3 - t) / (12 n).
    """
    copies = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("__t"))
    sums = copies.groupBy(*keys).agg(F.sum("__t").alias("__n"), F.sum(F.pow("__t", F.lit(3)) - F.col("__t")).alias("__ties"))
    n = F.col("__n")
    variance = (n * n * n - n - F.col("__ties")) / (12 * n)
    return sums.select(*keys, ((n + 1) / 2).alias("rank_mean"), F.sqrt(variance).alias("rank_sd"))


def group_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, from the counts of its values.

    One row per group with a non-null value; `points` maps output column to the
    quantile. Unlike percentile(), no task holds all values of a group: the two
    neighbouring order statistics are picked by the rows below and up to a value.
    """
    last = F.col("__all") - 1

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__below") <= place) & (place < F.col("__below") + F.col("__t")), F.col("__v")))

    picks = []
    for i, q in enumerate(points.values()):
        pos = F.lit(float(q)) * last
        picks += [at(F.floor(pos)).alias(f"__lo{i}"), at(F.ceil(pos)).alias(f"__hi{i}")]
    out = value_counts(df, keys, value).groupBy(*keys).agg(F.max("__all").alias("__all"), *picks)
    cols = []
    for i, (name, q) in enumerate(points.items()):
        frac = F.lit(float(q)) * last - F.floor(F.lit(float(q)) * last)
        cols.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * frac).alias(name))
    return out.select(*keys, *cols)
