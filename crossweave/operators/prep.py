"""Panel preparation: keys, screens, point-in-time joins, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.functions.columns import clip, finite_or_null, is_finite, month_index, month_label
from crossweave.operators.ranks import group_quantiles
from crossweave.session import Checks, stage

# Beta sources in order of preference, least price, excluded sizes, and the spread allowed in a month's cash return.
BETA_COLUMNS = ("betabab_1260d", "betadown_252d", "beta_60m")
MIN_PRICE = 5.0
EXCLUDED_SIZES = ("nano", "micro")
CASH_TOLERANCE = 1e-7


def month_keys(df: DataFrame, date: str = "eom") -> DataFrame:
    """Observed month and the month after it, as yyyy-MM labels and indexes."""
    return (df.withColumn("observed_mi", month_index(date)).withColumn("target_mi", F.col("observed_mi") + 1)
            .withColumn("observed_month", month_label("observed_mi")).withColumn("target_month", month_label("target_mi")))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row (an empty result means unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def nonfinite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing and infinite values, in one pass over the rows."""
    inf = float("inf")
    parts = []
    for c in columns:
        value = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"),
                              F.sum((value.isNull() | F.isnan(value)).cast("long")).alias("missing"),
                              F.sum(F.coalesce(F.abs(value) == inf, F.lit(False)).cast("long")).alias("infinite")))
    return df.agg(F.explode(F.array(*parts)).alias("p")).select("p.*")


def checked_rows(df: DataFrame, keys: list[str], finite: list[str] | None = None, name: str = "rows", checks: Checks | None = None) -> DataFrame:
    """Rows whose keys must be unique and whose `finite` columns must be known, neither NaN nor infinite.

    The counts are taken by the pass that writes the rows: a stage of this operator's own, or, with `checks`, the caller's (see
    session.stage). Rows are dealt by their keys for that; a key is numbered within itself, so only copies of a key share a sort.
    """
    numbered = df.withColumn("__copy", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1))))
    odd = {f"odd_{i}": F.sum((~is_finite(c)).cast("long")) for i, c in enumerate(finite or [])}

    def message(seen: dict) -> str | None:
        wrong = [f"{seen['copies']} {name} repeat another's {', '.join(keys)}."] if seen["copies"] else []
        wrong += [f"{seen[f'odd_{i}']} {name} have no finite {c}." for i, c in enumerate(finite or []) if seen[f"odd_{i}"]]
        return " ".join(wrong) or None

    mine = checks or Checks()
    watched = mine.watch(numbered, message, copies=F.sum((F.col("__copy") > 1).cast("long")), **odd).drop("__copy")
    return watched if checks else stage(watched, "checked", checks=mine)


def lagged_join(forecasts: DataFrame, panel: DataFrame, keep_missing: bool = False, checks: Checks | None = None) -> DataFrame:
    """Attach each forecast's prior-month characteristics.

    The month before the target supplies the row. A forecast without one is an error, unless keep_missing leaves it in place
    with NULLs; one with several always is. Both are counted by the pass that writes the joined rows, a stage of this operator's
    own or, with `checks`, the caller's. Rows of a (permno, month) meet in one place for the join, where they are also numbered.
    """
    drop = [c for c in ("ret", "ret_exc", "ret_exc_lead1m", "month") if c in panel.columns]
    lagged = panel.drop(*drop).withColumn("target_mi", F.col("mi") + 1).withColumnRenamed("mi", "observed_mi")
    copy = F.row_number().over(W.partitionBy("permno", "target_mi").orderBy(F.lit(1)))
    joined = forecasts.join(lagged.withColumn("__copy", copy), ["permno", "target_mi"], "left")

    def message(seen: dict) -> str | None:
        if seen["several"]:
            return "Some forecasts have several prior-month rows."
        return "Some forecasts have no prior-month characteristics." if seen["missing"] and not keep_missing else None

    mine = checks or Checks()
    watched = mine.watch(joined, message, missing=F.sum(F.col("__copy").isNull().cast("long")), several=F.sum((F.col("__copy") > 1).cast("long"))).drop("__copy")
    return watched if checks else stage(watched, "lagged", checks=mine)


def beta_use(columns=BETA_COLUMNS, low: float = -0.5, high: float = 3.5) -> Column:
    return clip(F.coalesce(*[finite_or_null(c) for c in columns]), low, high)


def sector_code(code: str = "gics") -> Column:
    return F.coalesce(F.substring(code, 1, 2), F.lit("na"))


def screen(min_price: float = MIN_PRICE, excluded=EXCLUDED_SIZES) -> Column:
    """Price floor, no excluded size group, usable beta, volatility and size."""
    return ((F.abs("prc") >= min_price) & ~F.coalesce(F.col("size_grp").isin(*excluded), F.lit(False))
            & is_finite("beta_use") & is_finite("rvol_21d") & (F.col("rvol_21d") > 0)
            & is_finite("me") & (F.col("me") > 0))


def eligible(df: DataFrame, min_price: float = MIN_PRICE, excluded=EXCLUDED_SIZES, screened: bool = True) -> DataFrame:
    """Tradeable rows; screened=False keeps every row whose inputs can be ranked."""
    if screened:
        return df.filter(screen(min_price, excluded))
    return df.filter(is_finite("beta_use") & is_finite("rvol_21d") & (F.col("rvol_21d") > 0)
                     & is_finite("me") & (F.col("me") > 0))


def eligible_imputed(df: DataFrame, min_price: float = MIN_PRICE, month: str = "target_mi",
                     fallbacks: dict[str, float] | None = None) -> DataFrame:
    """Price floor only; missing inputs take the month's median, then a constant."""
    fallbacks = fallbacks or {"me": 1.0, "beta_use": 1.0, "rvol_21d": 0.02}
    kept = df.filter(is_finite("prc") & (F.abs("prc") >= min_price))
    for c in fallbacks:
        kept = kept.withColumn(c, finite_or_null(c))
    long = kept.select(month, "permno", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in fallbacks])).alias("p")) \
        .select(month, "permno", "p.column", "p.value")
    medians = group_quantiles(long, [month, "column"], "value", {"mid": 0.5})
    wide = medians.groupBy(month).pivot("column", list(fallbacks)).agg(F.first("mid"))
    wide = wide.select(month, *[F.col(c).alias(f"__{c}") for c in fallbacks])
    kept = kept.join(wide, month, "left")
    for c, constant in fallbacks.items():
        kept = kept.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(constant))).drop(f"__{c}")
    return kept


def missing_months(df: DataFrame, expected: DataFrame, month: str) -> DataFrame:
    """Expected months without a row."""
    return expected.select(month).distinct().join(df.select(month).distinct(), month, "left_anti")


def month_gaps(df: DataFrame, month: str) -> DataFrame:
    """Months absent between the first and last month present."""
    seen = df.select(month).distinct()
    full = seen.agg(F.min(month).alias("lo"), F.max(month).alias("hi")) \
        .select(F.explode(F.sequence("lo", "hi")).alias(month))
    return full.join(seen, month, "left_anti")


def implied_cash(panel: DataFrame, month: str = "mi", tolerance: float = CASH_TOLERANCE, strict: bool = False) -> DataFrame:
    """Month median of ret - ret_exc, with its spread; `consistent` is the check.

    The spread is bounded by `tolerance` in valid data, so the value is rounded far
    below it and the median is found over few distinct values.
    """
    rate = panel.withColumn("__cash", F.round(F.col("ret") - F.col("ret_exc"), 12)).filter(F.col("__cash").isNotNull())
    # Pre-aggregate to distinct values, so no task holds a month of rows.
    counted = rate.groupBy(month, "__cash").agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy(month).agg(F.expr("percentile(__cash, 0.5, n)").alias("cash"),
                                     (F.max("__cash") - F.min("__cash")).alias("spread"))
    out = out.withColumn("consistent", F.col("spread") <= tolerance)
    if strict:
        out = out.withColumn("cash", F.when(F.col("consistent"), F.col("cash"))
                             .otherwise(F.raise_error(F.lit("implied cash return varies within a month")).cast("double")))
    return out


def fill_labels(df: DataFrame, columns: list[str], entity: str = "permno", order: str = "mi") -> DataFrame:
    """Last known label of the entity so far, else its first later one."""
    past = W.partitionBy(entity).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    later = W.partitionBy(entity).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing)
    filled = [F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(later)).alias(f"{c}_filled")
              for c in columns]
    return df.select("*", *filled)


def window_filter(df: DataFrame, month: str, start: int | None = None, end: int | None = None,
                  max_months: int | None = None) -> DataFrame:
    """Rows in a month range, optionally only its first max_months months present."""
    if start is not None:
        df = df.filter(F.col(month) >= start)
    if end is not None:
        df = df.filter(F.col(month) <= end)
    if max_months is not None:
        first = df.select(month).distinct().orderBy(month).limit(max_months)
        df = df.join(first, month, "left_semi")
    return df


def missing_exposure(holdings: DataFrame, by: list[str]) -> DataFrame:
    """Held positions without a realised return: how many, how much gross."""
    return (holdings.filter(F.col("raw_return").isNull()).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("missing_return_positions"),
                 F.sum(F.abs("weight")).alias("missing_return_gross")))
