"""Cross-sectional and trailing transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.functions.ols import two_slopes
from crossweave.operators.columnar import ranked_columns
from crossweave.operators.ranks import split_rank


#: Rows a group up to which Spark limits a row number in the map tasks.
HEAD = 1000


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("__p")) \
        .select(*ids, f"__p.{name}", f"__p.{value}")


def rank_keep_missing(df: DataFrame, columns: list[str], month: str, entity: str = "permno") -> DataFrame:
    """(entity, month) and one ranked column per feature: dense ranks scaled to [-1, 1]. A feature with a single distinct value in
    a month becomes NULL. All features share one deal, and rows are not multiplied by their number."""
    ranked = ranked_columns(df.select(entity, month, *columns), [month], {c: f"__r_{c}" for c in columns}, "scaled")
    return ranked.select(entity, month, *[F.col(f"__r_{c}").alias(c) for c in columns])


def rank_keep_missing_long(df: DataFrame, columns: list[str], month: str, entity: str = "permno") -> DataFrame:
    """Long form of rank_keep_missing: one row per (entity, month, feature)."""
    return unpivot(rank_keep_missing(df, columns, month, entity), [entity, month], columns, value="ranked")


def demean_and_clip(df: DataFrame, y: str, month: str, clip_sd: float = 3.0, out: str = "target", within: list[str] | None = None) -> DataFrame:
    """Subtract the month mean, then clip at clip_sd population sds of the whole sample (of each sample, where `within` names their keys)."""
    within = within or []
    means = df.groupBy(*within, month).agg(F.avg(y).alias("__mean"))
    centred = df.join(means, [*within, month]).withColumn(out, F.col(y) - F.col("__mean")).drop("__mean")
    spread = F.stddev_pop(out) * clip_sd
    if within:
        centred = centred.join(centred.groupBy(*within).agg(spread.alias("__bound")), within)
        bound = F.col("__bound")
    else:
        bound = centred.agg(spread).scalar()
    value = F.when(F.col(out).isNotNull(), F.least(F.greatest(F.col(out), -bound), bound))
    return centred.withColumn(out, value).drop("__bound")


def unit_ranks(df: DataFrame, values: dict[str, str], keys: list[str]) -> DataFrame:
    """Average-tie ranks of several columns (input to output), each centred and divided by its population sd (by 1 if that is 0)."""
    return ranked_columns(df, keys, values, "unit")


def unit_rank(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    return unit_ranks(df, {value: out}, keys)


def blend(df: DataFrame, forecast: str, keys: list[str], extra: dict[str, float] | None = None,
          forecast_weight: float = 1.0, out: str = "signal", also: dict[str, str] | None = None) -> DataFrame:
    """Weighted sum of unit ranks; rows an extra signal does not cover count as 0. `also` names columns whose unit ranks come from the same deal."""
    extra = extra or {}
    made = {forecast: "__u0", **{name: f"__u{i}" for i, name in enumerate(extra, 1)}}
    total: Column = F.lit(forecast_weight) * F.col("__u0")
    for i, weight in enumerate(extra.values(), 1):
        total = total + F.lit(weight) * F.coalesce(F.col(f"__u{i}"), F.lit(0.0))
    return unit_ranks(df, made | (also or {}), keys).withColumn(out, total).drop(*made.values())


def neutralise(df: DataFrame, y: str, x1: str, x2: str, month: str, sector: str, out: str) -> DataFrame:
    """Residual of the month's regression of y on x1, x2 and sector dummies.

    Centring inside (month, sector) removes the dummies, so the fit needs one
    aggregation to (month, sector) moments; only that small table is joined back, as a broadcast: a join by month and sector
    would first send all rows. Rows in which y or an x is null take no part in the fit and get a null residual.
    """
    n = F.count(F.lit(1))
    cells = df.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()).groupBy(month, sector).agg(
        F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        (n * F.var_pop(x1)).alias("s11"), (n * F.covar_pop(x1, x2)).alias("s12"), (n * F.var_pop(x2)).alias("s22"),
        (n * F.covar_pop(x1, y)).alias("s1y"), (n * F.covar_pop(x2, y)).alias("s2y"))
    sums = cells.groupBy(month).agg(*[F.sum(c).alias(c) for c in ("s11", "s12", "s22", "s1y", "s2y")])
    b1, b2 = two_slopes(*[F.col(c) for c in ("s11", "s12", "s22", "s1y", "s2y")])
    slopes = sums.select(month, b1.alias("__b1"), b2.alias("__b2"))
    fit = cells.join(slopes, month).select(
        month, sector, "__b1", "__b2",
        (F.col("my") - F.col("__b1") * F.col("m1") - F.col("__b2") * F.col("m2")).alias("__a"))
    resid = F.col(y) - F.col("__a") - F.col("__b1") * F.col(x1) - F.col("__b2") * F.col(x2)
    return df.join(F.broadcast(fit), [month, sector], "left").withColumn(out, resid).drop("__a", "__b1", "__b2")


def smooth(df: DataFrame, value: str, months: int = 3, entity: str = "permno", order: str = "target_mi",
           out: str | None = None) -> DataFrame:
    """Mean over the entity's last `months` rows (as many as there are)."""
    w = W.partitionBy(entity).orderBy(order).rowsBetween(-(months - 1), 0)
    return df.withColumn(out or value, F.avg(value).over(w))


def trailing_percentile(df: DataFrame, value: str, window: int = 60, minimum: int = 36, entity: str = "permno",
                        order: str = "mi", out: str = "pe_pct") -> DataFrame:
    """1 - percentile of the value in the entity's own last rows; NULL where it is not positive."""
    w = W.partitionBy(entity).orderBy(order).rowsBetween(-(window - 1), 0)
    v = F.col(value)
    past = F.col("__past")
    below = F.size(F.filter(past, lambda x: x < v))
    same = F.size(F.filter(past, lambda x: x == v))
    share = (below + (same + 1) / 2) / F.size(past)
    return (df.withColumn("__past", F.collect_list(value).over(w))
            .withColumn(out, F.when((v > 0) & (F.size(past) >= minimum), 1 - share)).drop("__past"))


def attach_trailing_percentile(df: DataFrame, panel: DataFrame, value: str = "ni_me", month: str = "observed_mi", ahead: int = 0, **kw) -> DataFrame:
    """Left join of trailing_percentile on the observation month, which lies `ahead` months before `month`; the panel key is unique, so no
    row is added. Rows that lie together by (permno, month) already, as lagged_join leaves them, need not move again."""
    pct = trailing_percentile(panel.select("permno", "mi", value), value, **kw)
    out = kw.get("out", "pe_pct")
    return df.join(pct.select("permno", (F.col("mi") + ahead).alias(month), out), ["permno", month], "left")


def sector_ranks_z(df: DataFrame, values: dict[str, str], keys: list[str]) -> DataFrame:
    """Average-tie ranks of several columns (input to output) within the keys as population z-scores; NULL where all ranks tie."""
    return ranked_columns(df, keys, values, "z")


def sector_rank_z(df: DataFrame, value: str, month: str, sector: str, out: str) -> DataFrame:
    return sector_ranks_z(df, {value: out}, [month, sector])


def quantile_bins(df: DataFrame, value: str, month: str, bins: int = 10, out: str = "decile", entity: str = "permno") -> DataFrame:
    """Equal-count bins of the first-come rank r of n: max(1, ceil(bins * (r - 1) / (n - 1)))."""
    ranked = split_rank(df, [month], value, entity, kind="row", rank="__r", total="__n")
    scaled = F.ceil(F.lit(bins) * (F.col("__r") - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    return ranked.withColumn(out, F.greatest(F.lit(1), scaled).cast("int")).drop("__r", "__n")


def top_n(df: DataFrame, value: str, n: int, keys: list[str], largest: bool = True, entity: str = "permno",
          rank: str = "position") -> DataFrame:
    """First n rows per group by value, ties by entity.

    Up to HEAD rows a group Spark keeps only the first n of each map task before the shuffle. Longer heads, which would be one sort a group,
    come from row numbers over ranges; the result is the same.
    """
    known = df.filter(F.col(value).isNotNull())
    if n > HEAD:
        return split_rank(known, keys, value, entity, kind="row", rank=rank, ascending=largest is False).filter(F.col(rank) <= n)
    order = F.col(value).desc() if largest else F.col(value).asc()
    w = W.partitionBy(*keys).orderBy(order, F.col(entity).asc())
    return known.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def alpha_forms(df: DataFrame, month: str, ic: float = 0.03, score: str = "score", forecast: str = "forecast",
                vol: str = "vol") -> DataFrame:
    """Three annualised expected-return scalings of a score or forecast."""
    stats = df.groupBy(month).agg(F.stddev_samp(score).alias("__ss"), F.avg(forecast).alias("__fm"),
                                  F.stddev_samp(forecast).alias("__fs"))
    z = F.try_divide(F.col(score), F.col("__ss"))
    return (df.join(stats, month)
            .withColumn("alpha_ic", 12 * F.lit(ic) * F.col(vol) * z)
            .withColumn("alpha_forecast", 12 * (F.col(forecast) - F.col("__fm")))
            .withColumn("alpha_score", 12 * z * F.col("__fs")).drop("__ss", "__fm", "__fs"))
