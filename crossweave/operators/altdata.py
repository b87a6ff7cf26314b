"""Point-in-time growth features of alternative monthly series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.functions.columns import clip, month_end, month_index
from crossweave.operators.columnar import ranked_columns

LIMIT = 2.0


def available_month(series: DataFrame, lag_days: str, by: list[str] | None = None) -> DataFrame:
    """Month in which each data month is first usable: the first month end on or after month end + lag.

    Adds formation_mi; if several data months become usable together, the latest is kept.
    """
    keys = [*(by or []), "permno", "formation_mi"]
    usable = series.withColumn("formation_mi", month_index(F.date_add(month_end("mi"), F.col(lag_days))))
    latest = W.partitionBy(*keys).orderBy(F.col("mi").desc())
    return usable.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n").withColumnRenamed("mi", "data_mi")


def _log_ratio(a: Column, b: Column) -> Column:
    return clip(F.when((a > 0) & (b > 0), F.ln(a / b)), -LIMIT, LIMIT)


def growth_features(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """yoy, yoy3, yoy2y (clipped log growth), accel and z per (by, permno, mi).

    Calendar months, not rows: a gap leaves the features that need it NULL. z compares
    yoy with the entity's own previous 12 months (at least 6 known).
    """
    w = W.partitionBy(*(by or []), "permno").orderBy("mi")

    def at(c: str, back: int) -> Column:
        return F.max(c).over(w.rangeBetween(-back, -back))

    quarter = w.rangeBetween(-2, 0)
    rows = series.withColumn("sum3", F.when(F.count("value").over(quarter) == 3, F.sum("value").over(quarter)))
    v = F.col("value")
    rows = (rows.withColumn("yoy", _log_ratio(v, at("value", 12))).withColumn("yoy2y", _log_ratio(v, at("value", 24)))
            .withColumn("yoy3", _log_ratio(F.col("sum3"), at("sum3", 12))))
    year = w.rangeBetween(-12, -1)
    sd = F.stddev_samp("yoy").over(year)
    z = F.when((F.count("yoy").over(year) >= 6) & (sd > 0), (F.col("yoy") - F.avg("yoy").over(year)) / sd)
    return rows.withColumn("accel", F.col("yoy3") - at("yoy3", 3)).withColumn("z", z).drop("sum3")


def sector_percentile(features: DataFrame, value: str, keys: list[str], out: str = "rank") -> DataFrame:
    """Average-tie percentile within the keys, centred: -0.5 to 0.5 (0 for a single name)."""
    return ranked_columns(features, keys, {value: out}, "percentile")


def combined_score(ranked: DataFrame, sources: list[str], dataset: str = "dataset", month: str = "formation_mi") -> DataFrame:
    """One rank column per source, their mean where known (ca_score) and the number known (ca_n_sources)."""
    wide = ranked.groupBy("permno", month).pivot(dataset, sources).agg(F.max("rank"))
    known = reduce(lambda a, b: a + b, [F.col(s).isNotNull().cast("int") for s in sources])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(s), F.lit(0.0)) for s in sources])
    return wide.select("permno", month, *[F.col(s).alias(f"{s}_rank") for s in sources],
                       F.when(known > 0, total / known).alias("ca_score"), known.alias("ca_n_sources"))
