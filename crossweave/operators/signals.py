"""Signal research: information coefficients, spreads, t-statistics, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.functions.columns import hit_share, months_t_stat, safe_corr, safe_div
from crossweave.operators import crosssection as X
from crossweave.operators.columnar import ROW, numbered, ranked_columns
from crossweave.operators.ranks import joined, rows_at
from crossweave.session import stage


def rank_ics(df: DataFrame, pairs: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Spearman correlation per group of each pair of columns, over the rows where both are known; NULL if either is constant.

    pairs: output column -> (a, b); names_<output> counts the pair's rows. A column is ranked among the rows in which its partner is
    known, all of them in one deal. Groups without such a row for any pair are left out.
    """
    masked, ranks, out = [], {}, []
    for i, (name, (a, b)) in enumerate(pairs.items()):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        for side, c in (("a", a), ("b", b)):
            masked.append(F.when(both, F.col(c).cast("double")).alias(f"__{side}{i}"))
            ranks[f"__{side}{i}"] = f"__r{side}{i}"
        out += [safe_corr(f"__ra{i}", f"__rb{i}").alias(name), F.count(f"__a{i}").alias(f"names_{name}")]
    rows = df.select(*keys, *masked).where(F.coalesce(*[F.col(f"__a{i}") for i in range(len(pairs))]).isNotNull())
    return ranked_columns(rows, keys, ranks, "average").groupBy(*keys).agg(*out)


def rank_ic(df: DataFrame, a: str, b: str, keys: list[str], out: str = "rank_ic") -> DataFrame:
    """Spearman correlation per group over rows where both are known, with their number as names; NULL if either is constant."""
    return rank_ics(df, {out: (a, b)}, keys).withColumnRenamed(f"names_{out}", "names")


def residual_alpha(df: DataFrame, ret: str, month: str = "target_mi", out: str = "alpha") -> DataFrame:
    """Return net of the month's regression on sector dummies, size rank and beta."""
    return X.neutralise(df.filter(F.col(ret).isNotNull()), ret, "size", "beta_use", month, "sector", out)


def _edge_means(df: DataFrame, n: int, month: str) -> DataFrame:
    top = X.top_n(df, "score", n, [month]).groupBy(month).agg(F.avg("r").alias("__tr"), F.avg("alpha").alias("__ta"))
    bottom = X.top_n(df, "score", n, [month], largest=False).groupBy(month).agg(F.avg("r").alias("__br"), F.avg("alpha").alias("__ba"))
    return top.join(bottom, month).select(month, (F.col("__tr") - F.col("__br")).alias("spread_raw"),
                                          (F.col("__ta") - F.col("__ba")).alias("spread_alpha"))


def signal_check(scores: DataFrame, returns: DataFrame, top: int = 100, month: str = "target_mi") -> DataFrame:
    """Per month: names, rank ICs with return and residual alpha, top-bottom spreads, score vs size and beta."""
    r = returns.select("permno", F.col("mi").alias(month), F.col("ret").alias("r"))
    rows = residual_alpha(scores.join(r, ["permno", month]), "r", month).select(month, "permno", "score", "r", "alpha", "size", "beta_use")
    # written, because the ranks, both edges and the correlations read it
    rows = stage(rows, "signal_rows")
    ics = rank_ics(rows, {"ic_raw": ("score", "r"), "ic_alpha": ("score", "alpha")}, [month])
    ics = ics.where(F.col("names_ic_alpha") > 0).withColumnRenamed("names_ic_raw", "names").drop("names_ic_alpha")
    corr = rows.groupBy(month).agg(safe_corr("score", "size").alias("corr_score_size"), safe_corr("score", "beta_use").alias("corr_score_beta"))
    return ics.join(_edge_means(rows, top, month), month).join(corr, month)


def decile_alpha(scores: DataFrame, returns: DataFrame, month: str = "target_mi", bins: int = 10) -> DataFrame:
    """Mean over months of the monthly mean residual alpha per score decile."""
    r = returns.select("permno", F.col("mi").alias(month), F.col("ret").alias("r"))
    rows = residual_alpha(scores.join(r, ["permno", month]), "r", month)
    binned = X.quantile_bins(rows, "score", month, bins)
    monthly = binned.groupBy(month, "decile").agg(F.avg("alpha").alias("alpha"))
    return monthly.groupBy("decile").agg(F.avg("alpha").alias("mean_alpha"), F.count(F.lit(1)).alias("months"))


def signal_summary(monthly: DataFrame, columns=("ic_raw", "ic_alpha", "spread_raw", "spread_alpha")) -> DataFrame:
    """mean, t-statistic and hit share over months, one row per measure."""
    long = X.unpivot(monthly, [], list(columns), "measure", "value")
    return long.groupBy("measure").agg(F.avg("value").alias("mean"), months_t_stat("value").alias("t_stat"),
                                       hit_share(F.col("value") > 0).alias("hit"))


def signal_by_year(monthly: DataFrame, month: str = "target_mi") -> DataFrame:
    year = F.floor((F.col(month) - 1) / 12).cast("int").alias("year")
    return monthly.groupBy(year).agg(F.avg("ic_alpha").alias("ic_alpha"), F.avg("spread_alpha").alias("spread_alpha"))


def yoy_signal(series: DataFrame, panel: DataFrame, by: list[str] | None = None) -> DataFrame:
    """value(t-1) / value(t-13) - 1 at t, where the entity has panel rows at t, t-1 and t-13."""
    by = list(by or [])
    keyed = F.lit(True)
    for c in (*by, "permno", "mi"):
        keyed = keyed & F.col(c).isNotNull()
    values = series.filter(keyed).select(*by, "permno", "mi", "value", F.lit(False).alias("__live"))
    live = panel.select(*[F.lit(None).cast(series.schema[c].dataType).alias(c) for c in by], "permno", "mi",
                        F.lit(None).cast(series.schema["value"].dataType).alias("value"), F.lit(True).alias("__live"))
    # An entity's values and panel months meet once; what the joins by month and series would look up are frames of its months.
    rows = values.unionByName(live.filter("permno IS NOT NULL AND mi IS NOT NULL")).repartition("permno")
    months = W.partitionBy("permno").orderBy("mi")
    rows = rows.select("*", F.max("__live").over(months.rangeBetween(0, 0)).alias("__now"), F.max("__live").over(months.rangeBetween(1, 1)).alias("__next"))
    known = rows.filter(~F.col("__live") & F.col("__now"))
    # lists, so that several values of a month each meet the others, as in a join
    past = W.partitionBy("permno", *by).orderBy("mi").rangeBetween(-12, -12)
    pair = known.withColumn("__past", F.collect_list("value").over(past)).withColumn("den", F.explode("__past")).filter(F.col("__next") & F.col("value").isNotNull() & (F.col("den") != 0))
    return pair.select(*by, "permno", (F.col("mi") + 1).alias("mi"), (F.col("value") / F.col("den") - 1).alias("growth"))


def signal_universe(signal: DataFrame, panel: DataFrame, min_price: float = 5.0, sizes=("small", "large", "mega"),
                    min_sector: int = 5, by: list[str] | None = None, with_numbers: bool = False) -> DataFrame:
    """Signal rows with a tradeable panel row and outcome, in sectors of min_sector names, in months of 2+ sectors.

    The rows are written before they are counted. The cells they are kept by are few, and broadcast, so that the rows need not move for it.
    with_numbers leaves their numbers, for a rank (see columnar.numbered).
    """
    by = list(by or [])
    tradeable = panel.filter(
        (F.col("prc") >= min_price) & F.col("size_grp").isin(*sizes) & F.col("sector").isNotNull() & F.col("ret_exc_lead1m").isNotNull())
    # sorted inside the tasks, so that a chunk of rows, as ranks take them, holds few groups
    d = stage(numbered(signal.join(tradeable, ["permno", "mi"]).sortWithinPartitions(*by, "mi", "sector")), "tradeable", codec="zstd")
    big = d.groupBy(*by, "mi", "sector").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_sector)
    wide = big.groupBy(*by, "mi").agg(F.count(F.lit(1)).alias("__s")).filter("__s >= 2")
    cells = big.select(*by, "mi", "sector").join(wide.select(*by, "mi"), [*by, "mi"])
    kept = d.join(F.broadcast(cells), [*by, "mi", "sector"], "left_semi")
    return kept if with_numbers else kept.drop(ROW)


def sector_tercile_spread(d: DataFrame, by: list[str] | None = None, value: str = "growth", ret: str = "ret_exc_lead1m") -> DataFrame:
    """Mean return of the top third less the bottom third per sector, averaged by names; ties by entity.

    The last row of the bottom third and the first of the top third bound them, so only rows near those two places are sorted.
    """
    keys = [*(by or []), "mi"]
    home, row = [*keys, "sector"], F.struct(value, "permno")
    ends = rows_at(d, home, value, "permno", lambda n: F.when(n >= 3, F.array(F.floor(n / 3), n - F.floor(n / 3) + 1)).otherwise(F.array().cast("array<long>")))
    bounds = ends.groupBy(*home).agg(F.min(row).alias("__lo"), F.max(row).alias("__hi"))
    known = F.count(value)
    sector = joined(d, F.broadcast(bounds), home, "left").groupBy(*home).agg(
        F.when(known > 0, known).alias("n"), F.avg(F.when(row >= F.col("__hi"), F.col(ret))).alias("hi"),
        F.avg(F.when(row <= F.col("__lo"), F.col(ret))).alias("lo"))
    return sector.groupBy(*keys).agg((F.sum(F.col("n") * (F.col("hi") - F.col("lo"))) / F.sum("n")).alias("ls"),
                                     F.sum("n").alias("names"), F.count(F.lit(1)).alias("sectors"))


def monthly_stats(d: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank IC of z, tercile spread, names and sectors by return month (the month after formation)."""
    keys = [*(by or []), "mi"]
    ic = rank_ic(d, "z", "ret_exc_lead1m", keys, "ic").drop("names")
    joined = sector_tercile_spread(d, by).join(ic, keys)
    return joined.withColumn("ret_mi", F.col("mi") + 1).drop("mi")


def newey_west_t(series: DataFrame, value: str, keys: list[str], order: str, lags: int = 3, out: str = "nw_t") -> DataFrame:
    """Mean over its Newey-West standard error: Bartlett weights, autocovariances divided by T; NULL if T < 3."""
    whole, ordered = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(order)
    rows = series.withColumn("__e", F.col(value) - F.avg(value).over(whole))
    variance = F.sum(F.col("__e") * F.col("__e"))
    for lag in range(1, lags + 1):
        rows = rows.withColumn(f"__p{lag}", F.col("__e") * F.lag("__e", lag).over(ordered))
        variance = variance + 2 * (1 - lag / (lags + 1)) * F.coalesce(F.sum(f"__p{lag}"), F.lit(0.0))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.when(n >= 3, safe_div(F.avg(value), F.sqrt(variance / n / n))).alias(out))


def in_windows(df: DataFrame, windows: dict[str, tuple[int | None, int | None]], month: str) -> DataFrame:
    """One copy of each row per named month window that holds it."""
    names = []
    for name, (lo, hi) in windows.items():
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col(month) >= lo)
        if hi is not None:
            inside = inside & (F.col(month) <= hi)
        names.append(F.when(inside, F.lit(name)))
    return df.withColumn("window", F.explode(F.array_compact(F.array(*names))))


def window_summary(monthly: DataFrame, signal: DataFrame, windows: dict[str, tuple[int | None, int | None]], by: list[str]) -> DataFrame:
    """Months, span, breadth, IC with Newey-West t, hit rate and spread statistics per named window."""
    keys = [*by, "window"]
    m = in_windows(monthly, windows, "ret_mi")
    s = in_windows(signal.withColumn("ret_mi", F.col("mi") + 1), windows, "ret_mi")
    covered = s.groupBy(*keys).agg(F.count_distinct("sector").alias("sectors_covered"))
    out = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), F.min("ret_mi").alias("first_mi"), F.max("ret_mi").alias("last_mi"), F.avg("names").alias("avg_names"),
        F.avg("ic").alias("mean_ic"), hit_share(F.col("ic") > 0).alias("hit_rate"), (100 * F.avg("ls")).alias("ls_mean_pct"),
        (safe_div(F.avg("ls"), F.stddev_samp("ls")) * F.sqrt(F.lit(12.0))).alias("ls_sharpe"), months_t_stat("ls").alias("ls_t"))
    return out.join(covered, keys).join(newey_west_t(m, "ic", keys, "ret_mi", out="ic_t"), keys)


def by_year(monthly: DataFrame, by: list[str]) -> DataFrame:
    year = F.floor((F.col("ret_mi") - 1) / 12).cast("int").alias("year")
    return monthly.groupBy(*by, year).agg(
        F.count(F.lit(1)).alias("months"), F.avg("names").alias("avg_names"), F.avg("ic").alias("mean_ic"),
        hit_share(F.col("ic") > 0).alias("hit_rate"), (100 * F.avg("ls")).alias("ls_mean_pct"), months_t_stat("ls").alias("ls_t"))


def pairwise_xs_corr(a: DataFrame, b: DataFrame, min_n: int = 20, by: list[str] | None = None, value_a: str = "a", value_b: str = "b") -> DataFrame:
    """Average monthly Spearman between two signals on shared names, months used and mean overlap."""
    by = list(by or [])
    keys = [*by, "mi"]
    shared = a.select(*keys, "permno", value_a).join(b.select(*keys, "permno", value_b), [*keys, "permno"])
    ic = rank_ic(shared, value_a, value_b, keys, "c").drop("names")
    sizes = shared.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(ic, keys, "left")
    enough = F.col("n") >= min_n
    return sizes.groupBy(*by).agg(F.avg(F.when(enough, F.col("c"))).alias("mean_corr"), F.sum(enough.cast("long")).alias("months_used"),
                                  F.avg("n").alias("mean_overlap"))


def mapping_survivorship(series: DataFrame, panel: DataFrame, last: int, early: int, min_mapped: int = 3) -> DataFrame:
    """How a series' entity mapping relates to entities that left the panel: (metric, value) rows.

    series: (permno, mi); panel: (permno, mi, sector, size_grp). last is the panel's
    final month, early the month before which an exit counts as old.
    """
    life = panel.groupBy("permno").agg(F.min("mi").alias("first"), F.max("mi").alias("last"))
    mapped = series.select("permno").distinct()
    ml = mapped.join(life, "permno", "left")
    alive, old = F.col("last") == last, F.col("last") < early

    def count(cond):
        return F.sum(F.coalesce(cond, F.lit(False)).cast("double"))

    names = ml.agg(F.count(F.lit(1)).cast("double").alias("mapped"), count(alive).alias("mapped_alive"), count(old).alias("mapped_left_early"),
                   count(~alive & ~old).alias("mapped_left_late"))
    rows = series.join(life, "permno", "left").join(panel.select("permno", "mi", F.lit(1).alias("__live")), ["permno", "mi"], "left").agg(
        count(F.col("mi") > F.col("last")).alias("rows_after_exit"), count(F.col("mi") < F.col("first")).alias("rows_before_entry"),
        count(F.col("__live").isNull()).alias("rows_off_panel"), F.count(F.lit(1)).cast("double").alias("rows_total"))
    span = series.agg(F.min("mi").alias("lo"), F.max("mi").alias("hi"))
    window = panel.filter(F.col("mi").between(span.select("lo").scalar(), span.select("hi").scalar()))
    homes = window.join(mapped, "permno", "left_semi").groupBy("permno").agg(F.max_by("sector", "mi").alias("sector"))
    kept = homes.groupBy("sector").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_mapped).select("sector")
    comparable = window.join(kept, "sector", "left_semi")
    universe = comparable.groupBy("permno").agg(
        F.max(F.col("size_grp").isin("small", "large", "mega").cast("int")).alias("small_plus"),
        F.max(F.col("size_grp").isin("large", "mega").cast("int")).alias("large_plus"))
    universe = universe.join(life, "permno").join(mapped.withColumn("__mapped", F.lit(1)), "permno", "left")
    covered = F.coalesce("__mapped", F.lit(0)).cast("double")
    parts = []
    for tag in ("small_plus", "large_plus"):
        here = F.col(tag) == 1
        for state, cond in (("listed", alive), ("exited", ~alive)):
            parts += [count(here & cond).alias(f"{tag}_{state}"), (100 * F.avg(F.when(here & cond, covered))).alias(f"{tag}_{state}_covered_pct")]
    coverage = universe.agg(*parts)
    out = None
    for frame in (names, rows, coverage):
        long = X.unpivot(frame, [], frame.columns, "metric", "value")
        out = long if out is None else out.unionByName(long)
    exits = ml.filter(~alive).groupBy(F.concat(F.lit("exits_"), F.floor((F.col("last") - 1) / 12).cast("string")).alias("metric")) \
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    return out.unionByName(exits)


def score_slope(scores: DataFrame, returns: DataFrame, month: str = "target_mi") -> DataFrame:
    """Monthly cross-sectional slope of realised return on score."""
    r = returns.select("permno", F.col("mi").alias(month), "ret")
    return scores.join(r, ["permno", month]).filter("ret IS NOT NULL").groupBy(month).agg(F.regr_slope("ret", "score").alias("slope"))


def slope_summary(slopes: DataFrame) -> DataFrame:
    return slopes.agg(F.count("slope").alias("months"), F.avg("slope").alias("mean_slope"), months_t_stat("slope").alias("t_stat"))


def rank_ic_by_group(df: DataFrame, forecast: str, outcome: str, group: str, month: str = "target_mi") -> DataFrame:
    """Mean monthly rank IC inside each group of names (say, screened and excluded)."""
    ic = rank_ic(df, forecast, outcome, [month, group])
    return ic.groupBy(group).agg(F.avg("rank_ic").alias("mean_rank_ic"), F.count("rank_ic").alias("months"), F.avg("names").alias("avg_names"))
