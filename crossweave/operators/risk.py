"""Risk estimates in factor form.

The shrunk covariance of N names over T past periods is never formed as N x N: with
z the standardised history, w'Sw needs only the T sums over names of z x a x w, and
the shrinkage intensity only the T x T Gram matrix, or on days blocks of names.
History windows are a fixed number of periods.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.functions.ols import two_slopes

JITTER = 1e-10


def number_months(history: DataFrame, targets: DataFrame, month: str = "target_mi") -> DataFrame:
    """(mi, k) for every month of either table: k - 1 months of history lie before mi, gaps not counted.

    One row per calendar month, so the single ordered window is small.
    """
    every = history.select("mi", F.lit(1).alias("__in")).unionByName(targets.select(F.col(month).alias("mi"), F.lit(0).alias("__in")))
    w = W.partitionBy(F.lit(1)).orderBy("mi").rowsBetween(W.unboundedPreceding, -1)
    return every.groupBy("mi").agg(F.max("__in").alias("__in")).select(
        "mi", (F.coalesce(F.sum("__in").over(w), F.lit(0)) + 1).cast("int").alias("k"))


def trailing_moments(history: DataFrame, candidates: DataFrame, months: int = 36, minimum: int = 12, vol: str = "rvol_21d",
                     vol_scale: float = 21 ** 0.5, floor: float = 1e-4, month: str = "target_mi", strict: bool = False) -> DataFrame:
    """Count, mean and population sd of each candidate in the last `months` months present strictly before the target.

    history: (permno, mi, ret). One pass per entity: candidate rows are laid between
    the history rows and look back over a range of numbered months. Fewer than `minimum`
    observations or no spread makes the estimate unreliable; its sd is then the
    candidate's own daily volatility, scaled. strict refuses targets with fewer than
    `minimum` months of history.
    """
    numbers = number_months(history, candidates, month)
    keys = candidates.select("permno", F.col(month).alias("mi"), F.col(vol).alias("__vol"), F.lit(None).cast("double").alias("ret"),
                             F.lit(1).alias("__mark"))
    known = history.select("permno", "mi", F.lit(None).cast("double").alias("__vol"), "ret", F.lit(0).alias("__mark"))
    w = W.partitionBy("permno").orderBy("k").rangeBetween(-months, -1)
    out = (known.unionByName(keys).join(numbers, "mi").withColumn("observations", F.count("ret").over(w)).withColumn("mean", F.avg("ret").over(w))
           .withColumn("sample_sd", F.stddev_pop("ret").over(w)).filter("__mark = 1"))
    reliable = (F.col("observations") >= minimum) & (F.coalesce("sample_sd", F.lit(0.0)) > 1e-8)
    out = out.withColumn("reliable", reliable).withColumn(
        "sd", F.greatest(F.when(reliable, F.col("sample_sd")).otherwise(F.col("__vol") * vol_scale), F.lit(floor)))
    periods = F.least(F.lit(months), F.col("k") - 1)
    if strict:
        periods = F.when(periods >= minimum, periods).otherwise(F.raise_error(F.lit("insufficient historical months")).cast("int"))
    return out.select("permno", F.col("mi").alias(month), "observations", "mean", "reliable", "sd", periods.alias("periods"))


def standardised_history(history: DataFrame, moments: DataFrame, months: int = 36, month: str = "target_mi") -> DataFrame:
    """(month, permno, mi, z) of reliable candidates; missing periods are 0 and left out.

    Targets are laid out over their numbered months first, so that they meet the history by (entity, month).
    """
    numbers = number_months(history, moments, month)
    window = (numbers.withColumnRenamed("mi", month).join(moments.select(month).distinct(), month, "left_semi").filter("k > 1")
              .select(month, F.explode(F.sequence(F.greatest(F.lit(1), F.col("k") - months), F.col("k") - 1)).alias("k")))
    present = numbers.join(history.select("mi").distinct(), "mi", "left_semi")
    past = history.filter(F.col("ret").isNotNull()).select("permno", "mi", "ret")
    joined = moments.filter("reliable").join(window.join(present, "k").drop("k"), month).join(past, ["permno", "mi"])
    return joined.select(month, "permno", "mi", ((F.col("ret") - F.col("mean")) / F.col("sd")).alias("z"))


def _intensity(sums: DataFrame, month: str) -> DataFrame:
    """delta and mu from N, T, sum of diag(G), sum of diag(G) squared and sum of G squared; 0 and 0 for a month without reliable names."""
    n, t = F.col("names"), F.when(F.col("periods") > 0, F.col("periods"))
    tr, fro = F.col("tr") / t, F.col("fro") / (t * t)
    d = (fro - tr * tr / n) / n
    b = F.least((F.col("quart") / t - fro) / (n * t), d)
    delta = F.when((b > 0) & (d > 0), b / d).otherwise(F.lit(0.0))
    return sums.select(month, "names", "periods", delta.alias("delta"), F.coalesce(tr / n, F.lit(0.0)).alias("mu"))


def shrinkage_intensity(moments: DataFrame, z: DataFrame, month: str = "target_mi") -> DataFrame:
    """Ledoit-Wolf intensity and scale per month from the period-by-period Gram matrix.

    Each name contributes at most periods^2 / 2 products, summed before the shuffle.
    """
    size = moments.groupBy(month).agg(F.count(F.lit(1)).alias("names"), F.max("periods").alias("periods"))
    arrays = z.groupBy(month, "permno").agg(F.collect_list(F.struct("mi", "z")).alias("h"))
    first = arrays.select(month, "h", F.explode("h").alias("a"))
    pairs = first.select(month, F.col("a.mi").alias("s"), F.col("a.z").alias("zs"), F.explode("h").alias("b")) \
        .filter(F.col("s") <= F.col("b.mi"))
    gram = pairs.groupBy(month, "s", F.col("b.mi").alias("t")).agg(F.sum(F.col("zs") * F.col("b.z")).alias("g"))
    diagonal = F.col("s") == F.col("t")
    sums = gram.groupBy(month).agg(
        F.sum(F.when(diagonal, F.col("g")).otherwise(F.lit(0.0))).alias("tr"),
        F.sum(F.when(diagonal, F.col("g") * F.col("g")).otherwise(F.lit(0.0))).alias("quart"),
        F.sum(F.when(diagonal, F.col("g") * F.col("g")).otherwise(2 * F.col("g") * F.col("g"))).alias("fro"))
    return _intensity(size.join(sums, month, "left"), month)


def name_factors(moments: DataFrame, z: DataFrame, shrink: DataFrame, month: str = "target_mi") -> DataFrame:
    """Per candidate: factor scale a (0 if unreliable) and own sd outside the factor block."""
    own = z.groupBy(month, "permno").agg(F.sum(F.col("z") * F.col("z")).alias("zz"))
    joined = moments.join(own, [month, "permno"], "left").join(shrink.select(month, "delta", "mu"), month)
    own_share = F.coalesce(F.try_divide((1 - F.col("delta")) * F.col("zz"), F.col("periods")), F.lit(0.0))
    diag = F.greatest(own_share + F.col("delta") * F.col("mu"), F.lit(1e-12))
    return joined.select(month, "permno", "delta", "mu", "periods", "sd", "reliable",
                         F.when(F.col("reliable"), F.col("sd") / F.sqrt(diag)).otherwise(F.lit(0.0)).alias("a"),
                         F.when(F.col("reliable"), F.lit(0.0)).otherwise(F.col("sd")).alias("sd_unrel"))


def portfolio_variance(weights: DataFrame, factors: DataFrame, z: DataFrame, keys: list[str] | None = None,
                       month: str = "target_mi", scale: float = 1.0) -> DataFrame:
    """w'Sw per (keys, month) from sums over names; `scale` multiplies all but the jitter."""
    keys = list(keys or [])
    by = [*keys, month]
    w = weights.select(*by, "permno", "weight").join(factors, [month, "permno"])
    aw = F.col("a") * F.col("weight")
    own = w.groupBy(*by).agg(
        F.max("delta").alias("delta"), F.max("mu").alias("mu"), F.max("periods").alias("periods"), F.sum(aw * aw).alias("aa"),
        F.sum(F.pow(F.col("sd_unrel") * F.col("weight"), F.lit(2))).alias("uu"), F.sum(F.col("weight") * F.col("weight")).alias("ww"))
    path = (w.filter("a > 0").join(z, [month, "permno"]).groupBy(*by, "mi").agg(F.sum(F.col("z") * aw).alias("f"))
            .groupBy(*by).agg(F.sum(F.col("f") * F.col("f")).alias("ff")))
    common = F.coalesce(F.try_divide((1 - F.col("delta")) * F.col("ff"), F.col("periods")), F.lit(0.0))
    total = (common + F.col("delta") * F.col("mu") * F.col("aa")
             + F.col("uu")) * scale + JITTER * F.col("ww")
    return own.join(path, by, "left").select(*by, total.alias("variance"))


def covariance_times_weights(weights: DataFrame, factors: DataFrame, z: DataFrame, keys: list[str] | None = None,
                             month: str = "target_mi") -> DataFrame:
    """(S w) per name and the covariance's diagonal, without emitting pairs of names."""
    keys = list(keys or [])
    by = [*keys, month]
    w = weights.select(*by, "permno", "weight").join(factors, [month, "permno"])
    loaded = w.filter("a > 0").join(z, [month, "permno"]).withColumn("b", F.col("z") * F.col("a"))
    path = loaded.groupBy(*by, "mi").agg(F.sum(F.col("b") * F.col("weight")).alias("f"))
    common = loaded.join(path, [*by, "mi"]).groupBy(*by, "permno").agg(F.sum(F.col("b") * F.col("f")).alias("bf"))
    own = F.when(F.col("reliable"), F.col("delta") * F.col("mu") * F.col("a") * F.col("a")).otherwise(F.col("sd_unrel") * F.col("sd_unrel"))
    shared = F.coalesce(F.try_divide((1 - F.col("delta")) * F.col("bf"), F.col("periods")), F.lit(0.0))
    product = shared + (own + JITTER) * F.col("weight")
    return w.join(common, [*by, "permno"], "left").select(
        *by, "permno", (F.col("sd") * F.col("sd") + JITTER).alias("variance"), product.alias("covariance_with_book"))


def risk_audit(history: DataFrame, candidates: DataFrame, moments: DataFrame, months: int = 36, month: str = "target_mi") -> DataFrame:
    """History span, names on the fallback volatility, missing share of the history matrix (NULL without history)."""
    numbers = number_months(history, candidates, month)
    present = numbers.join(history.select("mi").distinct(), "mi", "left_semi")
    targets = numbers.withColumnRenamed("mi", month).join(candidates.select(month).distinct(), month, "left_semi")
    spans = targets.join(present.select(F.col("mi").alias("history_start"), F.col("k").alias("f")), F.col("f") == F.greatest(F.lit(1), F.col("k") - months), "left") \
        .join(present.select(F.col("mi").alias("history_end"), F.col("k").alias("l")), F.col("l") == F.col("k") - 1, "left")
    m = moments.groupBy(month).agg(
        F.max("periods").alias("history_months"), F.sum((~F.col("reliable")).cast("long")).alias("fallback_vol_stocks"),
        (1 - F.try_divide(F.sum("observations"), F.count(F.lit(1)) * F.max("periods"))).alias("missing_history_fraction"))
    return m.join(spans, month).select(month, "history_start", "history_end", "history_months", "fallback_vol_stocks", "missing_history_fraction")


def number_days(daily: DataFrame, date: str = "date") -> DataFrame:
    """Consecutive number of each day on which anything traded; one row per calendar day."""
    w = W.partitionBy(F.lit(1)).orderBy(date)
    return daily.select(date).distinct().withColumn("di", F.row_number().over(w))


def daily_moments(daily: DataFrame, candidates: DataFrame, months: int = 36, minimum: int = 250, month: str = "target_mi",
                  vol: str = "rvol_21d") -> tuple[DataFrame, DataFrame]:
    """Moments and standardised returns on the days of the `months` months before each target month."""
    d = daily.withColumn("day_mi", F.year("date") * 12 + F.month("date")).filter(F.col("daily_return").isNotNull())
    window = F.explode(F.sequence(F.col(month) - months, F.col(month) - 1)).alias("day_mi")
    pairs = candidates.select(month, "permno", vol, window).join(d, ["permno", "day_mi"])
    stats = pairs.groupBy(month, "permno").agg(F.count(F.lit(1)).alias("observations"), F.avg("daily_return").alias("mean"),
                                               F.stddev_pop("daily_return").alias("sample_sd"))
    days = d.groupBy("day_mi").agg(F.count_distinct("date").alias("days"))
    targets = candidates.select(month).distinct()
    span = targets.select(month, F.explode(F.sequence(F.col(month) - months, F.col(month) - 1)).alias("day_mi")) \
        .join(days, "day_mi").groupBy(month).agg(F.sum("days").alias("periods"))
    span = targets.join(span, month, "left").na.fill(0, ["periods"])
    reliable = (F.coalesce("observations", F.lit(0)) >= minimum) & (F.coalesce("sample_sd", F.lit(0.0)) > 1e-8)
    moments = (candidates.select(month, "permno", vol).join(stats, [month, "permno"], "left").join(span, month)
               .select(month, "permno", F.coalesce("observations", F.lit(0)).alias("observations"), "mean", reliable.alias("reliable"),
                       F.greatest(F.when(reliable, F.col("sample_sd")).otherwise(F.col(vol)), F.lit(1e-5)).alias("sd"), "periods"))
    z = pairs.join(moments.filter("reliable").select(month, "permno", "mean", "sd"), [month, "permno"]).select(
        month, "permno", F.col("date").alias("mi"), ((F.col("daily_return") - F.col("mean")) / F.col("sd")).alias("z"))
    return moments, z


def daily_shrinkage(moments: DataFrame, z: DataFrame, month: str = "target_mi") -> DataFrame:
    """shrinkage_intensity on days: the squared norm of z'z, which that of zz' equals, from the smaller side.

    A month with no more names than days is one block and multiplies names. With more, names are dealt into blocks of about as
    many as there are days; each returns its share of the day-by-day matrix, and the shares are added up row by row. No
    row is copied, and no task holds more than a matrix of days by days.
    """
    size = moments.groupBy(month).agg(F.count(F.lit(1)).alias("names"), F.max("periods").alias("periods"))
    day = z.groupBy(month, "mi").agg(F.sum(F.col("z") * F.col("z")).alias("q"))
    diagonal = day.groupBy(month).agg(F.sum("q").alias("tr"), F.sum(F.col("q") * F.col("q")).alias("quart"))
    dtype = z.schema[month].dataType.simpleString()
    # a month's days are numbered over its own few hundred rows
    within = W.partitionBy(month)
    days = day.select(month, "mi", (F.row_number().over(within.orderBy("mi")) - 1).alias("at"), F.count(F.lit(1)).over(within).cast("int").alias("days"))
    blocks = F.greatest(F.ceil(F.col("names") / F.greatest("days", F.lit(1))), F.lit(1)).cast("int")
    dealt = z.join(days, [month, "mi"]).join(size.select(month, "names"), month).withColumn("blocks", blocks) \
        .withColumn("block", F.pmod(F.xxhash64("permno"), F.col("blocks")).cast("int")).select(month, "permno", "at", "days", "z", "blocks", "block")

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        cols, names = pd.factorize(pdf["permno"])
        m = np.zeros((int(pdf["days"].iloc[0]), len(names)))
        m[pdf["at"].to_numpy(), cols] = pdf["z"].to_numpy()
        if pdf["blocks"].iloc[0] == 1:
            gram = m.T @ m
            return pd.DataFrame({month: [pdf[month].iloc[0]], "at": [-1], "products": [[float((gram * gram).sum())]]})
        return pd.DataFrame({month: pdf[month].iloc[0], "at": np.arange(len(m)), "products": list(m @ m.T)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        products = np.sum(np.stack(pdf["products"].to_list()), axis=0)
        fro = products.sum() if pdf["at"].iloc[0] < 0 else (products * products).sum()
        return pd.DataFrame({month: [pdf[month].iloc[0]], "fro": [float(fro)]})

    shares = dealt.groupBy(month, "block").applyInPandas(share, f"{month} {dtype}, at int, products array<double>")
    fro = shares.groupBy(month, "at").applyInPandas(total, f"{month} {dtype}, fro double").groupBy(month).agg(F.sum("fro").alias("fro"))
    return _intensity(size.join(diagonal.join(fro, month), month, "left"), month)


def dimson_beta(daily: DataFrame, groups: DataFrame, formations: DataFrame, days: int = 252, minimum: int = 126,
                low: float = 0.3, high: float = 3.0) -> DataFrame:
    """Sum of the slopes on the group's equal-weighted return and its previous day's, per formation.

    daily: (permno, date, daily_return); groups: (permno, sector); formations: (permno, di)
    with di the formation day's number. Uses the `days` days before the formation
    day, the first of them only as a lag; 1.0 with fewer than `minimum` usable days.
    """
    numbered = daily.join(number_days(daily), "date")
    rows = numbered.join(groups, "permno").filter(F.col("daily_return").isNotNull())
    market = rows.groupBy("sector", "di").agg(F.avg("daily_return").alias("m0"))
    lagged = market.select("sector", (F.col("di") + 1).alias("di"), F.col("m0").alias("m1"))
    usable = rows.join(market, ["sector", "di"]).join(lagged, ["sector", "di"]).select(
        "permno", "di", F.col("daily_return").alias("y"), "m0", "m1", F.lit(0).alias("__mark"))
    blank = F.lit(None).cast("double")
    marks = formations.select("permno", "di", blank.alias("y"), blank.alias("m0"), blank.alias("m1"), F.lit(1).alias("__mark"))
    # Two growing frames and a difference: each row is added once, whatever the window's length.
    order = W.partitionBy("permno").orderBy("di")
    until, before = order.rangeBetween(W.unboundedPreceding, -1), order.rangeBetween(W.unboundedPreceding, -days)

    def total(term):
        return F.coalesce(F.sum(term).over(until), F.lit(0.0)) - F.coalesce(F.sum(term).over(before), F.lit(0.0))

    c = F.col
    terms = {"n": F.when(c("y").isNotNull(), F.lit(1.0)), "y": c("y"), "m0": c("m0"), "m1": c("m1"), "m00": c("m0") * c("m0"), "m01": c("m0") * c("m1"),
             "m11": c("m1") * c("m1"), "m0y": c("m0") * c("y"), "m1y": c("m1") * c("y")}
    sums = usable.unionByName(marks).select("permno", "di", "__mark", *[total(t).alias(f"t_{k}") for k, t in terms.items()]).filter("__mark = 1")

    def centred(product, a, b):
        return c(f"t_{product}") - F.coalesce(F.try_divide(c(f"t_{a}") * c(f"t_{b}"), c("t_n")), F.lit(0.0))

    wide = sums.select("permno", "di", c("t_n").cast("long").alias("n"), centred("m00", "m0", "m0").alias("s11"), centred("m01", "m0", "m1").alias("s12"),
                       centred("m11", "m1", "m1").alias("s22"), centred("m0y", "m0", "y").alias("s1y"), centred("m1y", "m1", "y").alias("s2y"))
    b1, b2 = two_slopes(*[F.col(c) for c in ("s11", "s12", "s22", "s1y", "s2y")])
    beta = F.when(F.col("n") >= minimum, F.least(F.greatest(b1 + b2, F.lit(low)), F.lit(high))).otherwise(F.lit(1.0))
    return wide.select("permno", "di", F.col("n").alias("days"), beta.alias("sector_beta"))
