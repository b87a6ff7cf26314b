"""Monthly sector inputs and the rule-based decisions made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Decision menu and thresholds.
LABELS = "ABCDEFGHIJK"
LOOSE_RATIO, HIGH_VOL, CALM_VOL = 2.0, 0.25, 0.12
BANDS, CAPS = ("1%", "2%", "3%"), ("1.25x", "1.5x", "none")


def sector_key(sectors: DataFrame, seed: int) -> DataFrame:
    """(sector, label): masked letters in an order drawn by hash. A handful of sector codes."""
    w = W.partitionBy(F.lit(1)).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("sector"))))
    letters = F.array(*map(F.lit, LABELS))
    return sectors.select("sector").distinct().withColumn("label", F.element_at(letters, F.row_number().over(w)))


def month_key(months: DataFrame, seed: int, month: str = "target_mi") -> DataFrame:
    """(month, ID): shuffled ids R01, R02, ... One row per calendar month."""
    w = W.partitionBy(F.lit(1)).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(month).cast("string"))))
    return months.select(month).distinct().withColumn("ID", F.format_string("R%02d", F.row_number().over(w)))


def sector_inputs_long(universe: DataFrame, returns: DataFrame, months: int = 3, month: str = "target_mi") -> DataFrame:
    """Per (month, sector): share of names, sample sd of the forecast, annualised sd of the sector's
    equal-weighted return over the previous `months` months (today's members)."""
    cells = universe.groupBy(month, "sector").agg(F.count(F.lit(1)).alias("names"), F.stddev_samp("forecast").alias("disp"))
    total = universe.groupBy(month).agg(F.count(F.lit(1)).alias("__all"))
    # Equi-join on shifted months: each member meets at most `months` earlier rows.
    members = universe.select(month, "sector", "permno", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("__back"))
    past = members.withColumn("mi", F.col(month) - F.col("__back")).join(returns.select("permno", "mi", "ret"), ["permno", "mi"])
    ew = past.groupBy(month, "sector", "mi").agg(F.avg("ret").alias("ew"))
    vol = ew.groupBy(month, "sector").agg((F.stddev_samp("ew") * F.sqrt(F.lit(12.0))).alias("vol"))
    return (cells.join(total, month).join(vol, [month, "sector"], "left")
            .select(month, "sector", (F.col("names") / F.col("__all")).alias("share"), "disp", "vol"))


def sector_inputs(long: DataFrame, sectors: DataFrame, months: DataFrame, month: str = "target_mi", labels: str = LABELS,
                  decimals: int = 4) -> DataFrame:
    """Wide masked table: ID and {label}_{share, disp, vol}."""
    keyed = long.join(sectors, "sector").join(months, month)
    wide = keyed.groupBy("ID").pivot("label", list(labels)).agg(*[F.round(F.first(c), decimals).alias(c) for c in ("share", "disp", "vol")])
    return wide.select("ID", *[F.col(f"{lab}_{c}") for lab in labels for c in ("share", "disp", "vol")])


def _median(values):
    known = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(known)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(known, F.greatest(lo, F.lit(1))) + F.element_at(known, F.greatest(hi, F.lit(1)))) / 2)


def decide(inputs: DataFrame, labels: str = LABELS) -> DataFrame:
    """(ID, band, cap, reason) from the masked table alone."""
    disp = F.array(*[F.col(f"{x}_disp") for x in labels])
    vol = F.array(*[F.col(f"{x}_vol") for x in labels])
    names = F.array(*map(F.lit, labels))
    work = (inputs.withColumn("top", F.element_at(names, F.array_position(disp, F.array_max(disp)).cast("int")))
            .withColumn("ratio", F.array_max(disp) / _median(disp)).withColumn("v", _median(vol)))
    cap = F.when(F.col("ratio") >= LOOSE_RATIO, F.lit(CAPS[1])).otherwise(F.lit(CAPS[0]))
    band = F.when(F.col("v") >= HIGH_VOL, F.lit(BANDS[0])).when(F.col("v") <= CALM_VOL, F.lit(BANDS[2])).otherwise(F.lit(BANDS[1]))
    mood = F.when(F.col("v") >= HIGH_VOL, "high").when(F.col("v") <= CALM_VOL, "calm").otherwise("normal")
    work = work.withColumn("cap", cap).withColumn("band", band)
    # The wording of a reason. Numbers are rounded before they are printed, so that exact halves go one way.
    v, ratio = F.round(F.col("v") + F.lit(3e-11), 2), F.round(F.col("ratio") + F.lit(3e-11), 1)
    why = F.when(F.col("cap") == CAPS[1], F.format_string("sector %s dispersion %.1fx median, loosen cap", F.col("top"), ratio)) \
        .otherwise(F.format_string("dispersion spread %.1fx, tight cap", ratio))
    known = F.when(v.isNull(), "unknown").otherwise(F.format_string("%.2f", v))
    reason = F.concat(F.format_string("median sector vol %s (%s) -> band %s; ", known, mood, F.col("band")), why)
    return work.select("ID", "band", "cap", reason.alias("reason"))


def apply_schedule(decisions: DataFrame, months: DataFrame, month: str = "target_mi") -> DataFrame:
    """(month, band, cap) as numbers through the key table; a value outside the menus fails the job."""
    def number(c):
        return F.when(F.lower(c) == "none", F.lit(None).cast("double")).when(F.col(c).endswith("%"), F.rtrim(F.col(c), F.lit("%")).cast("double") / 100) \
            .otherwise(F.rtrim(F.col(c), F.lit("x")).cast("double"))

    ok = F.col("band").isin(*BANDS) & F.col("cap").isin(*CAPS)
    checked = F.when(ok, number("band")).otherwise(F.raise_error(F.lit("decision outside the menus")).cast("double"))
    return decisions.join(months, "ID").select(month, checked.alias("band"), number("cap").alias("cap"))
