"""Limit and mandate audits of weighted books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.functions.columns import safe_div
from crossweave.operators.sizing import expensive_flag, side_limits

TOLERANCE = 1e-6
# Mandate limits.
GROSS, NET, NAME, SECTOR_NET = 2.0, 0.5, 0.05, 0.20
MIN_NAMES, MAX_NAMES, MIN_SECTORS, MIN_SHORT_USD, MIN_SHORT_ME = 200, 500, 5, 5e8, 500.0
DUST = 1e-6


def constraint_audit(book: DataFrame, keys: list[str], turnover: DataFrame | None = None, variance: DataFrame | None = None,
                     sector_caps: DataFrame | None = None) -> DataFrame:
    """(keys, rule, violation, passed): how far each month is past each rule in force.

    The settings are columns of `book` (gross_limit, net_min, net_max, position_limit,
    minimum_position_weight, and optional limits, NULL = off). turnover: (keys, turnover);
    variance: (keys, variance), monthly; sector_caps: (keys, sector, gross_limit).
    """
    w, c = F.col("weight"), F.col
    long_limit, short_limit = side_limits(c("position_limit"))
    settings = ["gross_limit", "net_min", "net_max", "beta_limit", "sector_limit", "size_limit", "turnover_limit", "annual_vol_limit"]
    capped = expensive_flag(c("expensive_percentile")) & c("expensive_long_cap").isNotNull()
    part = book.groupBy(*keys, "sector").agg(
        F.sum(w).alias("net"), F.sum(F.abs(w)).alias("gross"), F.sum(w * c("beta_use")).alias("beta"), F.sum(w * c("size")).alias("size"),
        F.max(F.abs(w)).alias("top"), F.max(w - long_limit).alias("over_long"), F.max(-w - short_limit).alias("over_short"),
        F.max(c("minimum_position_weight") - c("side") * w).alias("under"),
        F.max(F.when(capped, w - c("expensive_long_cap"))).alias("expensive"),
        F.max(F.abs(w) - c("liquidity_limit")).alias("illiquid"),
        *[F.max(s).alias(s) for s in settings])
    if sector_caps is not None:
        part = part.join(sector_caps.withColumnRenamed("gross_limit", "__cap"), [*keys, "sector"], "left")
    else:
        part = part.withColumn("__cap", F.lit(None).cast("double"))
    total = part.groupBy(*keys).agg(
        *[F.sum(x).alias(x) for x in ("net", "beta", "size")], F.sum("gross").alias("gross"), F.max(F.abs("net")).alias("sector_net"),
        *[F.max(x).alias(x) for x in ("top", "over_long", "over_short", "under", "expensive", "illiquid", *settings)],
        F.max(c("gross") - c("__cap")).alias("over_sector"))
    for extra, name in ((turnover, "turnover"), (variance, "variance")):
        total = total.join(extra.select(*keys, name), keys, "left") if extra is not None else total.withColumn(name, F.lit(None).cast("double"))
    rules = {
        "mandate_gross": c("gross") - GROSS, "mandate_net_min": -NET - c("net"), "mandate_net_max": c("net") - NET,
        "mandate_position": c("top") - NAME, "long_limits": c("over_long"), "short_limits": c("over_short"),
        "house_gross": c("gross") - c("gross_limit"), "house_net_min": c("net_min") - c("net"), "house_net_max": c("net") - c("net_max"),
        "selected_name_minimum": c("under"), "market_beta": F.abs("beta") - c("beta_limit"),
        "sector": c("sector_net") - c("sector_limit"), "size": F.abs("size") - c("size_limit"),
        "turnover": c("turnover") - c("turnover_limit"),
        "variance": 12 * c("variance") - c("annual_vol_limit") * c("annual_vol_limit"),
        "expensive_long_cap": c("expensive"), "liquidity": c("illiquid"), "sector_gross_cap": c("over_sector"),
        "dollar_neutral": F.abs("net"), "beta_neutral": F.abs("beta"),
    }
    long = total.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), excess.alias("excess")) for name, excess in rules.items()])).alias("r"))
    violation = F.greatest(F.col("r.excess"), F.lit(0.0))
    return (long.filter(F.col("r.excess").isNotNull())
            .select(*keys, F.col("r.rule").alias("rule"), violation.alias("violation"), (violation <= TOLERANCE).alias("passed")))


def _flagged(df: DataFrame, flags: dict) -> DataFrame:
    out = df.select("*", *[flag.alias(f"breach_{name}") for name, flag in flags.items()])
    return out.withColumn("breaches", sum((F.col(f"breach_{n}").cast("long") for n in flags), F.lit(0)))


def mandate_breaches(ledger: DataFrame, min_names: int = MIN_NAMES, max_names: int = MAX_NAMES) -> DataFrame:
    """Mandate flags of a scaled ledger: names, gross, net, max_name, short_usd, sectors_held, max_sector_net."""
    c = F.col
    return _flagged(ledger, {
        "names": ~c("names").between(min_names, max_names), "gross": c("gross") > GROSS + TOLERANCE,
        "net": F.abs("net") > NET + TOLERANCE, "name5": c("max_name") > NAME + TOLERANCE, "short500": c("short_usd") < MIN_SHORT_USD,
        "sectors5": c("sectors_held") < MIN_SECTORS, "sector20": c("max_sector_net") > SECTOR_NET + TOLERANCE})


def scaled_book_totals(book: DataFrame, keys: list[str], scale: str = "k") -> DataFrame:
    """Per month of a scaled book: names, gross, net, largest name, smallest short, sectors, sector net, ex-ante beta."""
    w = F.col("weight") * F.col(scale)
    part = book.groupBy(*keys, "sector").agg(
        F.sum((F.abs(w) > DUST).cast("long")).alias("names"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"),
        F.max(F.abs(w)).alias("max_name"), F.min(F.when(F.col("side") < 0, F.col("me"))).alias("min_short_me"),
        F.sum(F.col("weight") * F.col("beta_use")).alias("ex_ante_beta"))
    return part.groupBy(*keys).agg(
        F.sum("names").alias("names"), F.sum("gross").alias("gross"), F.sum("net").alias("net"), F.max("max_name").alias("max_name"),
        F.min("min_short_me").alias("min_short_me"), F.sum((F.col("gross") > DUST).cast("long")).alias("sectors_held"),
        F.max(F.abs("net")).alias("max_sector_net"), F.sum("ex_ante_beta").alias("ex_ante_beta"))


def mandate_breaches_names(book: DataFrame, keys: list[str], scale: str = "k", min_names: int = MIN_NAMES,
                           max_names: int = MAX_NAMES, min_short_me: float = MIN_SHORT_ME) -> DataFrame:
    """Mandate flags computed from the scaled names."""
    c = F.col
    return _flagged(scaled_book_totals(book, keys, scale), {
        "names": ~c("names").between(min_names, max_names), "gross": c("gross") > GROSS + TOLERANCE,
        "net": F.abs("net") > NET + TOLERANCE, "name5": c("max_name") > NAME + TOLERANCE,
        "short_me": F.coalesce(c("min_short_me") < min_short_me, F.lit(False)),
        "sectors5": c("sectors_held") < MIN_SECTORS, "sector20": c("max_sector_net") > SECTOR_NET + TOLERANCE})


def drift_audit(book: DataFrame, net: DataFrame, keys: list[str], limit: float = NAME) -> DataFrame:
    """Month-end weights after the month's returns: largest, gross, net, names over the limit.

    book carries `filled`; net is (keys, total_net).
    """
    d = book.join(net.select(*keys, "total_net"), keys).withColumn("__d", F.col("weight") * (1 + F.col("filled")) / (1 + F.col("total_net")))
    return d.groupBy(*keys).agg(
        F.max(F.abs("__d")).alias("monthend_max_weight"), F.sum(F.abs("__d")).alias("monthend_gross"), F.sum("__d").alias("monthend_net"),
        F.sum((F.abs("__d") > limit + TOLERANCE).cast("long")).alias("monthend_names_over_limit"))


def drift_rollup(audit: DataFrame, method: list[str]) -> DataFrame:
    return audit.groupBy(*method).agg(F.max("monthend_max_weight").alias("max_monthend_weight"),
                                      F.sum((F.col("monthend_names_over_limit") > 0).cast("long")).alias("months_over_limit"))


def concentration(book: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """Effective names (gross squared over sum of squares) and the top names' share of gross."""
    a = F.abs("weight")
    w = W.partitionBy(*keys).orderBy(F.col("__a").desc(), F.col("permno").asc())
    ranked = book.withColumn("__a", a).withColumn("__n", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(
        safe_div(F.pow(F.sum("__a"), F.lit(2)), F.sum(F.col("__a") * F.col("__a"))).alias("effective_names"),
        safe_div(F.sum(F.when(F.col("__n") <= top, F.col("__a")).otherwise(F.lit(0.0))), F.sum("__a")).alias("top_share"))


def position_count_flag(book: DataFrame, keys: list[str], low: int = MIN_NAMES, high: int = MAX_NAMES) -> DataFrame:
    n = F.sum((F.abs("weight") > DUST).cast("long"))
    return book.groupBy(*keys).agg(n.alias("positions"), n.between(low, high).alias("in_range"))


def liquidity_report(book: DataFrame, keys: list[str], uncapped: str = "liquidity_uncapped", limit: str = "liquidity_limit",
                     floor: str = "minimum_position_weight") -> DataFrame:
    """Positions and gross above the liquidity limit, limits under the floor, positions at the floor."""
    a = F.abs("weight")
    over = a > F.col(limit) + TOLERANCE
    return book.groupBy(*keys).agg(
        F.avg(over.cast("double")).alias("positions_over"), safe_div(F.sum(F.when(over, a).otherwise(F.lit(0.0))), F.sum(a)).alias("gross_over"),
        F.avg((F.col(uncapped) < F.col(floor)).cast("double")).alias("cap_below_floor"),
        F.avg((F.abs(a - F.col(floor)) <= TOLERANCE).cast("double")).alias("at_floor"))
