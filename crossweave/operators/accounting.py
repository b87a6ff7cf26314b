"""Turnover, returns after cost, overlays and performance summaries.

Ledgers hold one row per (method, month), so windows and arrays over a method's months stay small. The only sequential
part, drifting the book by its own net return, is a walk over months whose state and inputs are a few numbers each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.functions.columns import month_index, month_index_of, safe_div
from crossweave.session import stage

NAV0 = 1e9
PREMIUM = 0.04


def _months(keys: list[str], month: str):
    return W.partitionBy(*keys).orderBy(month)


def with_returns(book: DataFrame, returns: DataFrame, month: str = "target_mi") -> DataFrame:
    """Attach the holding month's return: raw_return (may be missing) and filled (missing = 0). A return below -1 fails the job."""
    possible = F.when(F.col("ret") < -1, F.raise_error(F.lit("a return is below -1")).cast("double")).otherwise(F.col("ret"))
    r = returns.select("permno", F.col("mi").alias(month), possible.alias("raw_return"))
    return book.join(r, ["permno", month], "left").withColumn("filled", F.coalesce("raw_return", F.lit(0.0)))


def previous_pairs(book: DataFrame, keys: list[str], month: str = "target_mi", grown: bool = True,
                   weight: str = "weight") -> DataFrame:
    """Full outer match of each month's weights with the month before: (keys, month, permno, w, d).

    d is the earlier weight, multiplied by 1 + its return if `grown`; names that left
    the book have w = 0, so forced exits count as trades.
    """
    now = book.select(*keys, month, "permno", F.col(weight).alias("w"))
    carried = F.col(weight) * (1 + F.col("filled")) if grown else F.col(weight)
    before = book.select(*keys, (F.col(month) + 1).alias(month), "permno", carried.alias("d"))
    held = now.select(*keys, month).distinct()
    both = now.join(before, [*keys, month, "permno"], "full_outer").na.fill(0.0, ["w", "d"])
    return both.join(held, [*keys, month], "left_semi")


def turnover(book: DataFrame, net: DataFrame, keys: list[str], month: str = "target_mi") -> DataFrame:
    """Traded fraction of NAV when last month's net return is known: sum of abs(w - d / (1 + net))."""
    last = net.select(*keys, (F.col(month) + 1).alias(month), F.col("total_net").alias("__net"))
    pairs = previous_pairs(book, keys, month).join(last, [*keys, month], "left")
    moved = F.abs(F.col("w") - F.col("d") / (1 + F.coalesce("__net", F.lit(0.0))))
    return pairs.groupBy(*keys, month).agg(F.sum(moved).alias("turnover"))


def _pieces(pairs: DataFrame, guess: DataFrame, keys: list[str], month: str) -> DataFrame:
    """(keys, month, const, slope, low, high): each month's turnover as const + slope * s for s in [low, high], around the guessed s.

    Turnover is the sum of abs(w - d * s), so it is linear between the breakpoints w / d; only names whose breakpoint lies between
    the guess and the true s would count with the wrong sign.
    """
    w, d, s = F.col("w"), F.col("d"), F.col("s")
    cut = F.when(d != 0, w / d)
    above = F.when(cut > s, 1.0).otherwise(-1.0)
    infinite = F.lit(float("inf"))
    return pairs.join(guess, [*keys, month], "left").na.fill(1.0, ["s"]).groupBy(*keys, month).agg(
        F.sum(F.when(d != 0, F.signum(d) * w * above).otherwise(F.abs(w))).alias("const"), F.sum(-F.abs(d) * above).alias("slope"),
        F.coalesce(F.max(F.when(cut <= s, cut)), -infinite).alias("low"), F.coalesce(F.min(F.when(cut > s, cut)), infinite).alias("high"))


def _walk(rows: DataFrame, keys: list[str], month: str) -> DataFrame:
    """Months of a trial in order, each with s = 1 / (1 + net return of the month before); a row of the fold is a month's few numbers."""
    fields = (month, "gross_return", "cost_rate", "other_cost", "const", "slope", "low", "high")
    gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    out_type = f"array<struct<{month}:int,s:double,inside:boolean,turnover:double,cost:double,total_net:double>>"
    init = F.struct(F.lit(0.0).alias("net"), F.lit(None).cast("int").alias("at"), F.array().cast(out_type).alias("out"))

    def step(acc, x):
        at = x[month].cast("int")
        gap = F.when(acc["at"] + 1 != at, F.raise_error(F.lit("a month is missing inside a book")).cast("double")).otherwise(F.lit(0.0))
        s = 1 / (1 + acc["net"]) + F.coalesce(gap, F.lit(0.0))

        def book_month(s):
            traded = x["const"] + x["slope"] * s
            cost = traded * x["cost_rate"] + x["other_cost"]
            net = F.when(x["gross_return"] - cost > -1, x["gross_return"] - cost).otherwise(F.raise_error(F.lit("portfolio bankruptcy")).cast("double"))
            inside = (x["slope"] == 0) | ((s >= x["low"]) & (s <= x["high"]))
            return F.struct(net.alias("net"), at.alias("at"), F.concat(acc["out"], F.array(F.struct(
                at.alias(month), s.alias("s"), inside.alias("inside"), traded.alias("turnover"), cost.alias("cost"), net.alias("total_net")))).alias("out"))

        return F.transform(F.array(s), book_month)[0]

    return gathered.select(*keys, F.explode(F.aggregate("rows", init, step, lambda acc: acc["out"])).alias("m")).select(*keys, "m.*")


def drift_fold(book: DataFrame, inputs: DataFrame, keys: list[str], month: str = "target_mi", weight: str = "weight") -> DataFrame:
    """Month-by-month turnover, cost and net return when the book drifts by its own net return.

    inputs: (keys, month, gross_return, cost_rate, other_cost). Net return at or below -1 fails the job, and so do a month of
    the book without inputs and a month missing between two of a book.

    A month's turnover depends on the month before through one number s = 1 / (1 + net), and is piecewise linear in it. So
    names are summed up to the piece around a guessed s, in parallel over all months, and only those few numbers are walked through in
    order. A walk that leaves a piece is repeated with the pieces around what it found; cost moves s little, so that two or three
    rounds end it, with the exact result.
    """
    gross = F.coalesce("gross_return", F.raise_error(F.lit("a month of the book has no return or cost")).cast("double"))
    pairs = stage(previous_pairs(book, keys, month, weight=weight), "pairs")
    known = stage(pairs.select(*keys, month).distinct().join(inputs, [*keys, month], "left").withColumn("gross_return", gross), "inputs")
    guess = inputs.select(*keys, (F.col(month) + 1).alias(month), (1 / (1 + F.col("gross_return"))).alias("s")).where(F.col("gross_return") > -1)
    while True:
        walked = stage(_walk(known.join(_pieces(pairs, guess, keys, month), [*keys, month]), keys, month), "walked")
        if walked.where(~F.col("inside")).isEmpty():
            return walked.drop("s", "inside")
        guess = walked.select(*keys, month, "s")


def gross_returns(book: DataFrame, cash: DataFrame, keys: list[str], month: str = "target_mi", weight: str = "weight") -> DataFrame:
    """cash + sum of w x (r - cash) per month. `book` carries `filled`; cash is (mi, cash). A month without cash fails the job."""
    c = cash.select(F.col("mi").alias(month), F.col("cash").alias("__cash"))
    known = F.coalesce("__cash", F.raise_error(F.lit("a month has no cash rate")).cast("double"))
    sums = book.groupBy(*keys, month).agg(F.sum(F.col(weight) * F.col("filled")).alias("__wr"), F.sum(weight).alias("__w"))
    return sums.join(c, month, "left").withColumn("cash", known).select(*keys, month, "cash", (F.col("cash") + F.col("__wr") - F.col("__w") * F.col("cash")).alias("total_gross"))


def exposures(book: DataFrame, keys: list[str], month: str = "target_mi", weight: str = "weight") -> DataFrame:
    """Gross, net, largest position, beta, size and largest sector net per month."""
    w = F.col(weight)
    sector = book.groupBy(*keys, month, "sector").agg(
        F.sum(w).alias("sn"), F.sum(F.abs(w)).alias("sg"), F.max(F.abs(w)).alias("mx"),
        F.sum(w * F.col("beta_use")).alias("sb"), F.sum(w * F.col("size")).alias("ss"),
        F.sum((F.abs(w) > 1e-6).cast("long")).alias("np"), F.sum(F.col("raw_return").isNull().cast("long")).alias("nm"),
        F.sum(F.when(F.col("raw_return").isNull(), F.abs(w)).otherwise(F.lit(0.0))).alias("gm"),
        F.sum(F.when(w < 0, -w).otherwise(F.lit(0.0))).alias("sh"))
    return sector.groupBy(*keys, month).agg(
        F.sum("sg").alias("gross"), F.sum("sn").alias("net"), F.max("mx").alias("max_weight"), F.sum("sb").alias("market_beta"),
        F.sum("ss").alias("size_exposure"), F.max(F.abs("sn")).alias("max_sector_net"), F.sum("np").alias("positions"),
        F.sum("nm").alias("missing_return_positions"), F.sum("gm").alias("missing_return_gross"), F.sum("sh").alias("short_gross"))


def sector_exposure_table(book: DataFrame, keys: list[str], month: str = "target_mi") -> DataFrame:
    return book.groupBy(*keys, month, "sector").agg(F.sum("weight").alias("net_exposure"))


def ledger(book: DataFrame, returns: DataFrame, cash: DataFrame, keys: list[str], cost_bps: str = "trading_cost_bps",
           month: str = "target_mi", premium: float = PREMIUM, variance: DataFrame | None = None) -> DataFrame:
    """Monthly ledger of every trial at once: returns, cost, turnover and exposures.

    variance (keys, month, variance), if given, adds predicted_monthly_vol; a month without it has NULL.
    """
    book = with_returns(book, returns, month)
    rate = book.groupBy(*keys, month).agg((F.max(cost_bps) / 10000).alias("cost_rate"), F.lit(0.0).alias("other_cost"))
    gross = gross_returns(book, cash, keys, month)
    inputs = gross.join(rate, [*keys, month]).withColumnRenamed("total_gross", "gross_return")
    folded = drift_fold(book, inputs, keys, month)
    if variance is not None:
        vol = F.sqrt(F.greatest(F.col("variance"), F.lit(0.0))).alias("predicted_monthly_vol")
        folded = folded.join(variance.select(*keys, month, vol), [*keys, month], "left")
    return (folded.join(gross, [*keys, month]).join(exposures(book, keys, month), [*keys, month])
            .withColumn("hurdle", F.col("cash") + F.lit(premium) / 12).withColumn("one_way_turnover", F.col("turnover") / 2))


def ledger_gross_drift(book: DataFrame, returns: DataFrame, cash: DataFrame, keys: list[str],
                       cost_bps: str = "trading_cost_bps", month: str = "target_mi") -> DataFrame:
    """Ledger whose previous weights drift by the gross return: a plain shifted join, no fold."""
    book = with_returns(book, returns, month)
    gross = gross_returns(book, cash, keys, month)
    rate = book.groupBy(*keys, month).agg((F.max(cost_bps) / 10000).alias("cost_rate"))
    moved = turnover(book, gross.withColumnRenamed("total_gross", "total_net"), keys, month)
    return (moved.join(gross, [*keys, month]).join(rate, [*keys, month])
            .withColumn("cost", F.col("turnover") * F.col("cost_rate"))
            .withColumn("total_net", F.col("total_gross") - F.col("cost")))


def benchmark_returns(levels: DataFrame, value: str = "level", date: str = "observation_date") -> DataFrame:
    """Change of each month's last known level: (mi, market_return)."""
    known = levels.filter(F.col(value).isNotNull())
    last = known.groupBy(month_index(date).alias("mi")).agg(F.max_by(value, date).alias("__level"))
    # One row per calendar month is left, so a single ordered window is small.
    w = W.partitionBy(F.lit(1)).orderBy("mi")
    return last.select("mi", (F.col("__level") / F.lag("__level").over(w) - 1).alias("market_return"))


def official_hurdle(rates: DataFrame, value: str = "rate", date_mi: str = "mi", premium: float = PREMIUM) -> DataFrame:
    """Percent annual rate / 1200 + premium / 12 per month."""
    return rates.select(F.col(date_mi).alias("mi"), (F.col(value) / 1200 + F.lit(premium) / 12).alias("hurdle"))


def attach_hurdle(ledger_df: DataFrame, hurdles: DataFrame, month: str = "target_mi") -> DataFrame:
    """Replace the ledger's hurdle by the official one; a month without it fails the job."""
    h = hurdles.select(F.col("mi").alias(month), F.col("hurdle").alias("__h"))
    checked = F.when(F.col("__h").isNotNull(), F.col("__h")).otherwise(
        F.raise_error(F.lit("month without an official hurdle; nothing is filled forward")).cast("double"))
    return ledger_df.drop("hurdle").join(h, month, "left").withColumn("hurdle", checked).drop("__h")


def nav_path(ledger_df: DataFrame, keys: list[str], ret: str = "total_net", month: str = "target_mi", start: float = NAV0,
             out: str = "nav") -> DataFrame:
    w = _months(keys, month).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ledger_df.withColumn(out, F.lit(start) * F.exp(F.sum(F.log1p(ret)).over(w)))


def _drawdown(ledger_df: DataFrame, keys: list[str], ret: str, month: str, from_one: bool) -> DataFrame:
    path = nav_path(ledger_df, keys, ret, month, 1.0, "__wealth")
    peak = F.max("__wealth").over(_months(keys, month).rowsBetween(W.unboundedPreceding, W.currentRow))
    return path.withColumn("__dd", F.col("__wealth") / (F.greatest(peak, F.lit(1.0)) if from_one else peak) - 1)


def annual_ir(active: Column) -> Column:
    sd = F.stddev_samp(active)
    return F.when(sd > 0, F.sqrt(F.lit(12.0)) * F.avg(active) / sd)


def summarize(ledger_df: DataFrame, keys: list[str], month: str = "target_mi") -> DataFrame:
    """Performance summary per method; drawdown counts from starting wealth 1."""
    rows = _drawdown(ledger_df, keys, "total_net", month, True)
    r, market = F.col("total_net"), F.col("market_return") - F.col("cash")
    n = F.count(F.lit(1))
    wealth = F.exp(F.sum(F.log1p(r)))
    beta = F.when((n >= 3) & (F.count(market) == n) & (F.var_pop(market) > 0), F.regr_slope(r - F.col("cash"), market))
    return rows.groupBy(*keys).agg(
        n.alias("months"), (F.pow(wealth, 12 / n) - 1).alias("cagr"), (F.stddev_samp(r) * F.sqrt(F.lit(12.0))).alias("annual_vol"),
        annual_ir(r - F.col("hurdle")).alias("information_ratio"), F.least(F.min("__dd"), F.lit(0.0)).alias("max_drawdown"),
        beta.alias("realized_market_beta"), F.avg("turnover").alias("mean_traded_nav"),
        F.avg("one_way_turnover").alias("mean_one_way_turnover"), (F.avg("one_way_turnover") * 12).alias("annual_one_way_turnover"),
        wealth.alias("ending_nav_billion"), F.sum("cost").alias("total_cost_nav_fractions"), F.avg("gross").alias("mean_gross"),
        F.max(F.abs("market_beta")).alias("max_abs_estimated_beta"), F.max("max_sector_net").alias("max_sector_net"),
        F.min("positions").alias("min_positions"), F.avg("missing_return_gross").alias("mean_missing_return_gross"))


def period_split(ledger_df: DataFrame, keys: list[str], split: str, month: str = "target_mi") -> DataFrame:
    """summarize() before and from the month `split` (yyyy-MM)."""
    period = F.when(F.col(month) < month_index_of(F.lit(split)), F.lit("before")).otherwise(F.lit("from"))
    return summarize(ledger_df.withColumn("period", period), [*keys, "period"], month)


def pnl_split(book: DataFrame, universe: DataFrame, returns: DataFrame, cash: DataFrame, keys: list[str],
              month: str = "target_mi") -> DataFrame:
    """Sector part: w x (cap-weighted sector return - cash). Selection part: w x (r - sector return)."""
    priced = with_returns(universe.select(month, "permno", "sector", "me"), returns, month).filter("raw_return IS NOT NULL")
    sector = priced.groupBy(month, "sector").agg((F.sum(F.col("raw_return") * F.col("me")) / F.sum("me")).alias("__rs"))
    rows = with_returns(book, returns, month).join(sector, [month, "sector"], "left") \
        .join(cash.select(F.col("mi").alias(month), "cash"), month)
    rs = F.coalesce("__rs", "filled")
    return rows.groupBy(*keys, month).agg(F.sum(F.col("weight") * (rs - F.col("cash"))).alias("sector_pnl"),
                                          F.sum(F.col("weight") * (F.col("filled") - rs)).alias("selection_pnl"))


def recost(ledger_df: DataFrame, trade_rate: float, borrow_annual: float) -> DataFrame:
    """Full cost (trades plus borrow on the short leg) and the returns in excess of cash it leaves."""
    return (ledger_df.withColumn("cost_full", F.col("turnover") * trade_rate + F.col("short_gross") * borrow_annual / 12)
            .withColumn("r_full", F.col("total_gross") - F.col("cost_full"))
            .withColumn("x", F.col("r_full") - F.col("cash")).withColumn("mx", F.col("market_return") - F.col("cash")))


def hedge_ratio(rows: DataFrame, keys: list[str], window: int = 24, minimum: int = 12, month: str = "target_mi",
                skip_missing: bool = True, x: str = "x", mx: str = "mx", out: str = "h") -> DataFrame:
    """OLS slope of x on mx over earlier rows only; 0 until there are `minimum` of them.

    skip_missing takes the last `window` rows where both are known; otherwise the
    last `window` rows as they are.
    """
    if not skip_missing:
        w = _months(keys, month).rowsBetween(-window, -1)
        enough = F.count(F.lit(1)).over(w) >= minimum
        return rows.withColumn(out, F.when(enough, F.regr_slope(x, mx).over(w)).otherwise(F.lit(0.0)))
    known = F.col(x).isNotNull() & F.col(mx).isNotNull()
    # every row looks up the fit that ends at the last known row before it, by that row's number among the known ones
    numbered = rows.withColumn("__seen", F.count(F.when(known, 1)).over(_months(keys, month).rowsBetween(W.unboundedPreceding, -1)))
    last = _months(keys, month).rowsBetween(-(window - 1), 0)
    fits = numbered.where(known).select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("__seen") + 1).alias("__number"),
                                        F.count(F.lit(1)).over(last).alias("__n"), F.regr_slope(x, mx).over(last).alias("__slope"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__seen") == F.col("__number")]
    fitted = numbered.join(fits, on, "left").withColumn(out, F.when(F.col("__n") >= minimum, F.col("__slope")).otherwise(F.lit(0.0)))
    return fitted.drop("__seen", "__number", "__n", "__slope", *[f"__{k}" for k in keys])


def vol_target(rows: DataFrame, keys: list[str], target: float = 0.10, window: int = 12, minimum: int = 12, low: float = 0.25,
               high: float = 1.0, series: str = "x_hedged", month: str = "target_mi", out: str = "k") -> DataFrame:
    """Scale in [low, high] that brings the earlier rows' annualised sd to target; 1 until there are enough."""
    w = _months(keys, month).rowsBetween(-window, -1)
    sd = F.stddev_samp(series).over(w) * F.sqrt(F.lit(12.0))
    k = F.when((F.count(series).over(w) >= minimum) & (sd > 0), F.least(F.greatest(F.lit(target) / sd, F.lit(low)), F.lit(high)))
    return rows.withColumn(out, F.coalesce(k, F.lit(1.0)))


def overlay(rows: DataFrame, keys: list[str], month: str = "target_mi", **kw) -> DataFrame:
    """Hedge ratio h, hedged series and scale k on a recosted ledger."""
    hedged = hedge_ratio(rows, keys, month=month).withColumn("x_hedged", F.col("x") - F.col("h") * F.coalesce("mx", F.lit(0.0)))
    return vol_target(hedged, keys, month=month, **kw)


def scale_book(rows: DataFrame, book: DataFrame, keys: list[str], trade_rate: float, borrow_annual: float,
               month: str = "target_mi") -> DataFrame:
    """Trade, cost and return of the scaled, hedged book; undrifted turnover, first month in full."""
    scaled = book.select(*keys, month, "permno", "weight").join(rows.select(*keys, month, "k"), [*keys, month]) \
        .withColumn("weight", F.col("weight") * F.col("k"))
    traded = previous_pairs(scaled, keys, month, grown=False).groupBy(*keys, month).agg(F.sum(F.abs(F.col("w") - F.col("d"))).alias("traded_s"))
    out = rows.join(traded, [*keys, month])
    cost = F.col("traded_s") * trade_rate + F.col("short_gross") * F.col("k") * borrow_annual / 12
    excess = F.col("k") * (F.col("total_gross") - F.col("cash") - F.col("h") * F.coalesce("mx", F.lit(0.0)))
    out = out.withColumn("cost_s", cost).withColumn("ret", F.col("cash") + excess - F.col("cost_s"))
    out = nav_path(out, keys, "ret", month)
    return out.withColumn("nav_open", F.coalesce(F.lag("nav").over(_months(keys, month)), F.lit(NAV0)))


def scale_book_drifted(rows: DataFrame, book: DataFrame, keys: list[str], trade_rate: float, borrow_annual: float,
                       month: str = "target_mi") -> DataFrame:
    """scale_book with the scaled book drifting by its own net return (a fold over months).

    rows: recosted ledger with x and mx. The hedge uses the last rows as they are.
    """
    hedged = hedge_ratio(rows, keys, month=month, skip_missing=False)
    hedged = hedged.withColumn("x_hedged", F.col("x") - F.col("h") * F.col("mx"))
    sized = vol_target(hedged, keys, month=month)
    scaled = book.join(sized.select(*keys, month, "k"), [*keys, month]).withColumn("scaled", F.col("weight") * F.col("k"))
    inputs = sized.select(
        *keys, month, (F.col("cash") + F.col("k") * (F.col("total_gross") - F.col("cash")) - F.col("k") * F.col("h") * F.col("mx")).alias("gross_return"),
        F.lit(float(trade_rate)).alias("cost_rate"), (F.col("k") * F.col("short_gross") * borrow_annual / 12).alias("other_cost"))
    folded = drift_fold(scaled, inputs, keys, month, weight="scaled").select(
        *keys, month, F.col("turnover").alias("traded"), F.col("cost").alias("cost_s"), F.col("total_net").alias("net_return"))
    out = sized.join(inputs.select(*keys, month, "gross_return"), [*keys, month]).join(folded, [*keys, month])
    out = nav_path(out, keys, "net_return", month)
    return (out.withColumn("nav_start", F.coalesce(F.lag("nav").over(_months(keys, month)), F.lit(NAV0)))
            .withColumn("hurdle", F.col("cash") + PREMIUM / 12).withColumn("one_way", F.col("traded") / 2))


def sector_share_of_gross(book: DataFrame, keys: list[str], named: str, month: str = "target_mi") -> DataFrame:
    """Largest sector and its share of gross, and one named sector's share. Of equal sectors the earlier name is the largest.

    Sums of the same weights differ in their last bits by the order in which tasks add them, so sectors are compared at twelve places.
    """
    sg = book.groupBy(*keys, month, "sector").agg(F.sum(F.abs("weight")).alias("sg"))
    return sg.groupBy(*keys, month).agg(
        F.min_by("sector", F.struct(-F.round("sg", 12), F.col("sector"))).alias("largest_sector"),
        safe_div(F.max("sg"), F.sum("sg")).alias("largest_sector_gross_share"),
        safe_div(F.sum(F.when(F.col("sector") == named, F.col("sg")).otherwise(F.lit(0.0))), F.sum("sg")).alias("named_gross_share"))


def overlay_metrics(rows: DataFrame, shares: DataFrame, keys: list[str], month: str = "target_mi") -> DataFrame:
    """Summary of a drifted overlay run; drawdown counts from the first month's wealth."""
    r = _drawdown(rows.join(shares, [*keys, month]), keys, "net_return", month, False)
    return r.groupBy(*keys).agg(
        annual_ir(F.col("net_return") - F.col("hurdle")).alias("net_ir"), annual_ir(F.col("gross_return") - F.col("hurdle")).alias("gross_ir"),
        (F.stddev_samp("net_return") * F.sqrt(F.lit(12.0))).alias("vol"), F.min("__dd").alias("max_drawdown"),
        F.max(F.col("k") * F.col("max_sector_net")).alias("max_sector_net"),
        F.median("largest_sector_gross_share").alias("sector_share_median"), F.max("largest_sector_gross_share").alias("sector_share_max"),
        F.median("named_gross_share").alias("named_share_median"), F.max("named_gross_share").alias("named_share_max"),
        F.avg("one_way").alias("monthly_one_way"), (F.avg("cost_s") * 12).alias("annual_cost"), F.avg("k").alias("mean_k"),
        F.sum("breaches").alias("breaches"), F.sum((F.col("breaches") > 0).cast("long")).alias("months_with_breach"))


def beta_with_se(rows: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """OLS slope and its standard error."""
    n, sxx, syy, sxy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    resid = (syy - sxy * sxy / sxx) / (n - 2)
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("beta"), F.sqrt(safe_div(resid, sxx)).alias("se"))


def usd_positions(book: DataFrame, rows: DataFrame, keys: list[str], month: str = "target_mi") -> DataFrame:
    """Dollar positions at the previous month end, plus one hedge row per month; rounded to cents. A row without a ticker fails the job.

    The export is sorted by date and size when written; see `in_export_order`.
    """
    from crossweave.functions.columns import month_end
    sized = book.join(rows.select(*keys, month, "k", "nav_open"), [*keys, month])
    date = month_end(F.col(month) - 1)
    ticker = F.coalesce("ticker_filled", F.raise_error(F.lit("a position has no ticker")).cast("string"))
    held = sized.select(*keys, date.alias("date"), ticker.alias("ticker"), F.col("company_name_filled").alias("name"),
                        F.round(F.col("weight") * F.col("k") * F.col("nav_open"), 2).alias("position_usd"))
    hedge = rows.select(*keys, date.alias("date"), F.lit("HEDGE").alias("ticker"), F.lit("index futures hedge").alias("name"),
                        F.round(-F.col("h") * F.col("k") * F.col("nav_open"), 2).alias("position_usd"))
    return held.unionByName(hedge)


def in_export_order(positions: DataFrame) -> DataFrame:
    return positions.orderBy("date", F.col("position_usd").desc())


def bootstrap_ir(ledger_df: DataFrame, keys: list[str], reps: int, seed: int, month: str = "target_mi") -> DataFrame:
    """Bootstrap standard error of the IR: months redrawn with replacement, `reps` times, by the md5 of seed, repetition and draw."""
    rows = ledger_df.select(*keys, month, (F.col("total_net") - F.col("hurdle")).alias("active"))
    numbered = (rows.withColumn("slot", F.row_number().over(_months(keys, month)) - 1)
                .withColumn("months", F.count(F.lit(1)).over(W.partitionBy(*keys))))
    draws = numbered.select(*keys, F.col("slot").alias("draw"), "months", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string"))), 1, 12), 16, 10)
    draws = draws.withColumn("slot", F.pmod(number.cast("long"), F.col("months")).cast("int"))
    redrawn = draws.select(*keys, "rep", "slot").join(numbered.select(*keys, "slot", "active"), [*keys, "slot"])
    per_rep = redrawn.groupBy(*keys, "rep").agg(annual_ir(F.col("active")).alias("ir"))
    return per_rep.groupBy(*keys).agg(F.count("ir").alias("reps"), F.avg("ir").alias("mean_ir"), F.stddev_samp("ir").alias("se_ir"))
