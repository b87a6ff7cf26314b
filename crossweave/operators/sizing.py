"""Rule-based weights and limit tables on a selected book.

A book holds a leg's worth of names per month, so windows over (keys, month, side)
see a bounded number of rows. Limits may be literals or columns (one per trial).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def equal_weight(book: DataFrame, keys: list[str], gross: Column, out: str = "weight") -> DataFrame:
    return book.withColumn(out, F.col("side") * gross / F.count(F.lit(1)).over(W.partitionBy(*keys)))


def _spread(book: DataFrame, keys: list[str], appeal: str, budget: Column, cap: Column, floor: Column, out: str,
            tie: str = "permno") -> DataFrame:
    """Give each row `floor`, share the rest of the budget by `appeal`, cap and redistribute.

    Capping and re-sharing until nothing exceeds the cap freezes the rows of highest
    appeal first. Row i is frozen exactly when its share of what is left after i - 1
    frozen rows breaks the cap, so one pass over suffix sums replaces the loop.
    """
    order = W.partitionBy(*keys).orderBy(F.col(appeal).desc(), F.col(tie).asc())
    tail = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy(*keys)
    work = (book.withColumn("__b", budget).withColumn("__c", cap).withColumn("__f", floor)
            .withColumn("__i", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(whole))
            .withColumn("__tail", F.sum(appeal).over(tail)))
    left = F.col("__b") - (F.col("__i") - 1) * F.col("__c") - (F.col("__n") - F.col("__i") + 1) * F.col("__f")
    hit = (F.col("__f") + left * F.col(appeal) / F.col("__tail")) > F.col("__c")
    work = work.withColumn("__hit", hit.cast("int"))
    work = work.withColumn("__frozen", F.min("__hit").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    work = (work.withColumn("__j", F.sum("__frozen").over(whole))
            .withColumn("__rest", F.sum(F.when(F.col("__frozen") == 0, F.col(appeal))).over(whole)))
    rest = F.col("__b") - F.col("__j") * F.col("__c") - (F.col("__n") - F.col("__j")) * F.col("__f")
    weight = F.when(F.col("__frozen") == 1, F.col("__c")).otherwise(F.col("__f") + rest * F.col(appeal) / F.col("__rest"))
    return work.withColumn(out, weight).drop("__b", "__c", "__f", "__i", "__n", "__tail", "__hit", "__frozen", "__j", "__rest")


def capped_inverse_vol(book: DataFrame, keys: list[str], budget: Column, cap: Column, vol: str = "rvol_21d",
                       out: str = "weight") -> DataFrame:
    """Inverse-volatility shares of a budget with a position cap; vol is winsorised at 5% / 95% per group."""
    whole = W.partitionBy(*keys)
    work = (book.withColumn("__lo", F.percentile(vol, F.lit(0.05)).over(whole))
            .withColumn("__hi", F.percentile(vol, F.lit(0.95)).over(whole))
            .withColumn("__inv", 1 / F.least(F.greatest(F.col(vol), F.col("__lo")), F.col("__hi")))
            .withColumn("__cap", cap)
            .withColumn("__bud", F.least(budget, F.count(F.lit(1)).over(whole) * F.col("__cap"))))
    sized = _spread(work, keys, "__inv", F.col("__bud"), F.col("__cap"), F.lit(0.0), out)
    return sized.drop("__lo", "__hi", "__inv", "__cap", "__bud")


def beta_matched(book: DataFrame, keys: list[str], gross: Column, cap: Column, net_min: Column, net_max: Column,
                 vol: str = "rvol_21d", beta: str = "beta_use", out: str = "weight") -> DataFrame:
    """Inverse-vol legs whose budgets equalise long and short beta dollars, inside the net band.

    Both legs shrink together when one cannot hold its budget under the cap.
    """
    leg = [*keys, "side"]
    book = book.withColumn("__g", gross).withColumn("__k", cap).withColumn("__nmin", net_min).withColumn("__nmax", net_max)
    shares = capped_inverse_vol(book, leg, F.lit(1.0), F.lit(1.0), vol, "__share")
    month = W.partitionBy(*keys)
    is_long = F.col("side") > 0
    work = (shares.withColumn("__bl", F.sum(F.when(is_long, F.col("__share") * F.col(beta))).over(month))
            .withColumn("__bs", F.sum(F.when(~is_long, F.col("__share") * F.col(beta))).over(month))
            .withColumn("__nl", F.sum(is_long.cast("long")).over(month))
            .withColumn("__ns", F.sum((~is_long).cast("long")).over(month)))
    matched = F.when((F.col("__bl") > 0) & (F.col("__bs") > 0), F.col("__g") * F.col("__bs") / (F.col("__bl") + F.col("__bs"))) \
        .otherwise(F.col("__g") / 2)
    net = F.least(F.greatest(2 * matched - F.col("__g"), F.col("__nmin")), F.col("__nmax"))
    work = work.withColumn("__long", (F.col("__g") + net) / 2).withColumn("__short", F.col("__g") - F.col("__long"))
    scale = F.least(F.lit(1.0), F.col("__nl") * F.col("__k") / F.greatest(F.col("__long"), F.lit(1e-12)),
                    F.col("__ns") * F.col("__k") / F.greatest(F.col("__short"), F.lit(1e-12)))
    work = work.withColumn("__budget", F.when(is_long, F.col("__long")).otherwise(F.col("__short")) * scale)
    sized = capped_inverse_vol(work, leg, F.col("__budget"), F.col("__k"), vol, out)
    return sized.withColumn(out, F.col("side") * F.col(out)).select(*[c for c in book.columns if not c.startswith("__")], out)


def rank_tilt(book: DataFrame, keys: list[str], kind: str, gross: Column, cap: Column, floor: Column, score: str = "score",
              out: str = "weight", strict: bool = True) -> DataFrame:
    """Sector-and-leg budgets by name count, tilted by rank: flat, linear or steep (1 / rank).

    A budget above what the cap holds, or below the sum of floors, fails the job;
    without `strict` such a group gets the cap, or its floors, and misses its budget.
    """
    leg = [*keys, "sector", "side"]
    whole = W.partitionBy(*leg)
    n_long = F.sum((F.col("side") > 0).cast("long")).over(W.partitionBy(*keys))
    order = W.partitionBy(*leg).orderBy((F.col("side") * F.col(score)).desc(), F.col("permno").asc())
    work = (book.withColumn("__place", F.row_number().over(order)).withColumn("__count", F.count(F.lit(1)).over(whole))
            .withColumn("__cap", cap).withColumn("__floor", floor)
            .withColumn("__budget", gross / 2 * F.col("__count") / n_long))
    tilts = {"flat": F.lit(1.0), "linear": (F.col("__count") - F.col("__place") + 1).cast("double"), "steep": 1.0 / F.col("__place")}
    tilt = tilts[kind]
    bad = (F.col("__count") * F.col("__cap") < F.col("__budget") - 1e-12) | (F.col("__count") * F.col("__floor") > F.col("__budget") + 1e-12)
    if strict:
        tilt = F.when(bad, F.raise_error(F.lit("sector budget outside what floor and cap allow")).cast("double")).otherwise(tilt)
    budget = F.greatest(F.least("__budget", F.col("__count") * F.col("__cap")), F.col("__count") * F.col("__floor"))
    work = work.withColumn("__tilt", tilt).withColumn("__budget", budget)
    sized = _spread(work, leg, "__tilt", F.col("__budget"), F.col("__cap"), F.col("__floor"), out, tie="__place")
    return sized.withColumn(out, F.col("side") * F.col(out)).drop("__place", "__count", "__cap", "__floor", "__budget", "__tilt")


def liquidity_cap(days: Column, participation: Column, nav: Column, floor: Column, cap: Column,
                  dollar_volume: str = "dolvol_126d") -> Column:
    """Largest weight tradeable in `days` at a share of daily volume: at least floor, at most cap."""
    size = days * participation * F.coalesce(F.col(dollar_volume), F.lit(0.0)) / nav
    return F.least(F.greatest(size, floor), cap)


def expensive_flag(threshold: Column, pct: str = "pe_pct") -> Column:
    """Valuation percentile above the threshold; unknown means unconstrained."""
    return F.coalesce(F.col(pct), F.lit(0.0)) > threshold


def sector_gross_limits(universe: DataFrame, multiple: Column, gross: Column, month: str = "target_mi") -> DataFrame:
    """Gross limit per (month, sector): multiple x the sector's share of names x gross limit."""
    counts = universe.groupBy(month, "sector").agg(F.count(F.lit(1)).alias("names"))
    total = counts.groupBy(month).agg(F.sum("names").alias("__all"))
    share = F.col("names") / F.col("__all")
    return counts.join(total, month).select(month, "sector", share.alias("share"), (multiple * share * gross).alias("gross_limit"))


def balance_sectors(weights: DataFrame, keys: list[str], risk_weight: str | None = None, weight: str = "weight",
                    allowed: float = 1e-9) -> DataFrame:
    """Scale the heavier side of each sector down to the lighter one; one-sided sectors go to 0.

    risk_weight balances weight x that column (a sector beta) instead of dollars.
    """
    w = F.col(weight)
    scaled = w * F.col(risk_weight) if risk_weight else w
    sides = weights.groupBy(*keys, "sector").agg(
        F.sum(F.when(w > 0, scaled).otherwise(F.lit(0.0))).alias("__l"),
        (-F.sum(F.when(w < 0, scaled).otherwise(F.lit(0.0)))).alias("__s"),
        F.max((w > 0).cast("int")).alias("__has_l"), F.max((w < 0).cast("int")).alias("__has_s"))
    long, short = F.col("__l"), F.col("__s")
    factor = (F.when((F.col("__has_l") == 0) | (F.col("__has_s") == 0), F.lit(0.0))
              .when(F.abs(long - short) <= allowed, F.lit(1.0))
              .when((long > short) & (w > 0), short / long)
              .when((short > long) & (w < 0), long / short).otherwise(F.lit(1.0)))
    return weights.join(sides, [*keys, "sector"]).withColumn(weight, w * factor).drop("__l", "__s", "__has_l", "__has_s")


def side_limits(position_limit: Column, short_limit: Column | None = None) -> tuple[Column, Column]:
    """(long_limit, short_limit) of each name: the position limit on its own side, 0 on the other."""
    long = F.when(F.col("side") > 0, position_limit).otherwise(F.lit(0.0))
    capped = F.least(short_limit, position_limit) if short_limit is not None else position_limit
    return long, F.when(F.col("side") < 0, capped).otherwise(F.lit(0.0))
