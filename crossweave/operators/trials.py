"""Trial tables: build, resolve, validate, run all at once, compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.functions.columns import is_finite, safe_corr
from crossweave.operators import accounting as A
from crossweave.operators import sizing as Z
from crossweave.session import stage

# Settings and their defaults.
DEFAULTS = {
    "gross_limit": 2.0, "net_min": -0.5, "net_max": 0.5, "position_limit": 0.05, "minimum_position_weight": 0.001,
    "beta_limit": 0.0, "sector_limit": None, "size_limit": None, "turnover_limit": None, "annual_vol_limit": None,
    "expensive_percentile": 0.70, "expensive_long_cap": None, "risk_penalty": 100.0, "cost_penalty": 1.0,
    "trading_cost_bps": 20.0, "covariance_months": 36, "covariance_min_observations": 12, "score_scale": 1.0,
}
INTEGERS = ("covariance_months", "covariance_min_observations")

# One setting changed at a time.
AXES = {
    "gross_limit": ("0.75", "1.0", "1.25", "1.5", "1.75"),
    "annual_vol_limit": ("0.05", "0.075", "0.1", "0.125", "0.15", "0.2"),
    "position_limit": ("0.005", "0.01", "0.015", "0.025"),
    "risk_penalty": ("10.0", "30.0", "300.0", "1000.0", "3000.0"),
    "cost_penalty": ("10.0", "50.0", "100.0", "300.0"),
    "beta_limit": ("0.05", "0.1", "0.2", "None"),
    "sector_limit": ("0.0", "0.025", "0.05", "0.1"),
    "size_limit": ("0.0", "0.05", "0.1"),
    "covariance_months": ("12", "24", "60"),
    "turnover_limit": ("0.75", "1.0", "1.5", "2.0"),
}
# Cost stress levels, full mixes and refinements.
COST_STRESS = ("35.0", "50.0", "100.0")
MIX = {"gross_limit": ("1.0", "1.5", "2.0"), "position_limit": ("0.01", "0.025"), "cost_penalty": ("10.0", "100.0")}
MIX_COMMON = {"sector_limit": "0.05", "size_limit": "0.1", "annual_vol_limit": "0.1"}
REFINE_GROSS = {"risk_penalty": ("3.0", "10.0", "30.0"), "position_limit": ("0.015", "0.025"), "gross_limit": ("1.5", "2.0")}
REFINE_VOL = {"risk_penalty": ("10.0", "30.0"), "position_limit": ("0.015", "0.025"), "annual_vol_limit": ("0.1", "0.125", "0.15")}
REFINE_SECTOR = {"risk_penalty": ("10.0", "30.0")}
REFINE_SECTOR_COMMON = {"position_limit": "0.025", "sector_limit": "0.05", "cost_penalty": "10.0"}
# The arms of the objective study, as settings that differ from the defaults.
ARMS = {
    "a0_control": {"score_scale": "1.0", "risk_penalty": "100.0"},
    "a1_units": {"score_scale": "0.004339", "risk_penalty": "0.4339"},
    "a2_risk_lo": {"score_scale": "0.004339", "risk_penalty": "0.2170"},
    "a3_risk_hi": {"score_scale": "0.004339", "risk_penalty": "0.8678"},
    "a4_turnover": {"score_scale": "0.004339", "risk_penalty": "0.4339", "turnover_limit": "1.0"},
    "a5_beta_off": {"score_scale": "0.004339", "risk_penalty": "0.4339", "beta_limit": "None"},
}


def _product(spark: SparkSession, axes: dict[str, tuple[str, ...]], common: dict[str, str], label: str) -> DataFrame:
    """All combinations of a few listed values, named by a format over the axes."""
    row = spark.range(1)
    for name, values in axes.items():
        row = row.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    row = row.drop("id").withColumn("trial", F.format_string(label, *map(F.col, axes)))
    for name, value in common.items():
        row = row.withColumn(name, F.lit(value))
    return row


def trial_grid(spark: SparkSession, refine: bool = False) -> DataFrame:
    """Trials as text settings, one per row; NULL inherits the default, 'None' switches a limit off."""
    if refine:
        parts = [_product(spark, REFINE_GROSS, {}, "refine_r%s_p%s_g%s"), _product(spark, REFINE_VOL, {}, "refine_r%s_p%s_v%s"),
                 _product(spark, REFINE_SECTOR, REFINE_SECTOR_COMMON, "refine_r%s_sector")]
    else:
        parts = [spark.range(1).select(F.lit("baseline").alias("trial"))]
        parts += [_product(spark, {name: values}, {}, f"{name}_%s") for name, values in AXES.items()]
        parts += [_product(spark, MIX, MIX_COMMON, "mix_g%s_p%s_c%s"),
                  _product(spark, {"trading_cost_bps": COST_STRESS}, {}, "cost_stress_%sbps")]
    grid = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return grid.select("trial", *[F.col(c).cast("string").alias(c) if c in grid.columns else F.lit(None).cast("string").alias(c) for c in DEFAULTS])


def arm_trials(spark: SparkSession) -> DataFrame:
    """The arms as trial rows, in the form of trial_grid."""
    rows = [(name, *[settings.get(c) for c in DEFAULTS]) for name, settings in ARMS.items()]
    return spark.createDataFrame(rows, "trial string, " + ", ".join(f"{c} string" for c in DEFAULTS))


def resolve_settings(trials: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Typed settings: blank inherits, 'none' disables, integers must be whole. `unreadable` names bad cells."""
    defaults = defaults or DEFAULTS
    out, bad = ["trial"], []
    for name, default in defaults.items():
        text = F.trim(F.col(name)) if name in trials.columns else F.lit(None).cast("string")
        value = text.try_cast("double")
        blank = text.isNull() | (text == "")
        off = F.lower(text) == "none"
        resolved = F.when(blank, F.lit(default).cast("double")).when(off, F.lit(None).cast("double")).otherwise(value)
        broken = ~blank & ~off & value.isNull()
        if name in INTEGERS:
            broken = broken | (~blank & (off | (value != F.floor(value))))
            resolved = F.when(~broken, resolved).cast("int")
        bad.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)))
        out.append(resolved.alias(name))
    return trials.select(*out, F.concat_ws(",", *bad).alias("unreadable"))


def validate_settings(settings: DataFrame) -> DataFrame:
    """Rejected rows: (trial, problem), one per broken rule. NaN and infinite values break every rule of their setting.

    Names must be there and differ; each of several trials of one name is rejected.
    """
    def value(name):
        return F.col(name)

    def within(name, low, high, low_open=False):
        above = value(name) > low if low_open else value(name) >= low
        return is_finite(name) & above & (value(name) <= high)

    floor, cap, dear = value("minimum_position_weight"), value("position_limit"), value("expensive_long_cap")
    rules = {
        "gross_limit: above 0, at most 2": within("gross_limit", 0, 2, low_open=True),
        "net_min, net_max: in order, both from -0.5 to 0.5":
            within("net_min", -0.5, 0.5) & within("net_max", -0.5, 0.5) & (value("net_min") <= value("net_max")),
        "position_limit: above 0, at most 0.05": within("position_limit", 0, 0.05, low_open=True),
        "minimum_position_weight: above 1e-6, at most position_limit": is_finite("minimum_position_weight") & (floor > 1e-6) & (floor <= cap),
        "expensive_percentile: between 0 and 1": is_finite("expensive_percentile") & (value("expensive_percentile") > 0) & (value("expensive_percentile") < 1),
        "expensive_long_cap: from minimum_position_weight to position_limit": dear.isNull() | (is_finite("expensive_long_cap") & (dear >= floor) & (dear <= cap)),
        "score_scale: above 0, at most 1": within("score_scale", 0, 1, low_open=True),
        "covariance_min_observations: from 2 to covariance_months":
            (value("covariance_min_observations") >= 2) & (value("covariance_min_observations") <= value("covariance_months")),
    }
    for name in ("beta_limit", "sector_limit", "size_limit", "turnover_limit", "annual_vol_limit"):
        rules[f"{name}: empty, or finite and not below 0"] = value(name).isNull() | (is_finite(name) & (value(name) >= 0))
    for name in ("risk_penalty", "cost_penalty", "trading_cost_bps"):
        rules[f"{name}: finite and not below 0"] = is_finite(name) & (value(name) >= 0)
    alone = F.count(F.lit(1)).over(Window.partitionBy("trial")) == 1
    rules["trial: a name of its own"] = F.col("trial").isNotNull() & (F.trim("trial") != "") & F.col("__alone")
    problems = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules.items()],
                                       F.when(F.col("unreadable") != "", F.concat(F.lit("cannot be read: "), F.col("unreadable")))))
    return settings.withColumn("__alone", alone).select("trial", F.explode(problems).alias("problem"))


def size_trials(trials: DataFrame, schedules: DataFrame, month: str = "target_mi", strict: bool = True) -> DataFrame:
    """Weights of every trial on the candidate schedule it names.

    trials: trial, schedule, rule ('equal', 'beta_matched', 'rank_flat', 'rank_linear',
    'rank_steep') and settings; schedules: candidates with a `schedule` column. The
    schedule is shared by its trials, which are told apart by the trial column.
    """
    book = schedules.join(trials, "schedule")
    keys = ["trial", month]
    gross, cap, floor = F.col("gross_limit"), F.col("position_limit"), F.col("minimum_position_weight")

    def of(rule):
        return book.filter(F.col("rule") == rule)

    parts = [Z.equal_weight(of("equal"), keys, gross),
             Z.beta_matched(of("beta_matched"), keys, gross, cap, F.col("net_min"), F.col("net_max"))]
    parts += [Z.rank_tilt(of(f"rank_{kind}"), keys, kind, gross, cap, floor, strict=strict) for kind in ("flat", "linear", "steep")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_trials(trials: DataFrame, schedules: DataFrame, returns: DataFrame, cash: DataFrame, market: DataFrame,
               month: str = "target_mi", strict: bool = True) -> DataFrame:
    """Ledgers of all trials at once: size, account, attach the market return.

    The sized book is staged, because the ledger reads it several times.
    """
    sized = stage(size_trials(trials, schedules, month, strict), "sized")
    led = A.ledger(sized, returns, cash, ["trial"], month=month)
    return led.join(market.select(F.col("mi").alias(month), "market_return"), month, "left")


def leaderboard(settings: DataFrame, summary: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Settings beside results, best information ratio first, failed trials left out."""
    ok = summary.join(failed.select("trial"), "trial", "left_anti") if failed is not None else summary
    return settings.join(ok, "trial").orderBy(F.col("information_ratio").desc_nulls_last(), "trial")


def paired(before: DataFrame, after: DataFrame, columns: list[str], suffixes=("_before", "_after")) -> DataFrame:
    left = before.select("trial", *[F.col(c).alias(c + suffixes[0]) for c in columns])
    right = after.select("trial", *[F.col(c).alias(c + suffixes[1]) for c in columns])
    return left.join(right, "trial")


def check_complete(ledger_df: DataFrame, months: DataFrame, violations: DataFrame | None = None, tolerance: float = 1e-6,
                   month: str = "target_mi") -> DataFrame:
    """Per trial: months present, duplicates, largest rule violation, and whether all is in order."""
    expected = months.select(month).distinct().withColumn("__known", F.lit(1))
    seen = ledger_df.join(expected, month, "left").groupBy("trial").agg(
        F.count_distinct(F.when(F.col("__known") == 1, F.col(month))).alias("months"),
        (F.count(F.lit(1)) - F.count_distinct(month)).alias("duplicates"),
        F.sum(F.col("__known").isNull().cast("long")).alias("unexpected"))
    if violations is not None:
        seen = seen.join(violations.groupBy("trial").agg(F.max("violation").alias("max_violation")), "trial", "left")
    else:
        seen = seen.withColumn("max_violation", F.lit(None).cast("double"))
    wanted = expected.agg(F.count(F.lit(1))).scalar()
    ok = (F.col("months") == wanted) & (F.col("duplicates") == 0) & (F.col("unexpected") == 0) \
        & (F.coalesce("max_violation", F.lit(0.0)) <= tolerance)
    return seen.withColumn("complete", ok)


def match_positions(ref: DataFrame, ours: DataFrame, by: str = "date", expected: DataFrame | None = None) -> DataFrame:
    """Compare two books by ticker per date, each normalised by its gross.

    ref: (date, ticker, position); ours: (date, ticker, weight), ticker may be NULL. expected (date, gross): what the gross of
    ref should be; scale_ok holds within one percent of it, and is NULL without it.
    """
    def side(df, value, name):
        total = df.groupBy(by).agg(F.sum(F.abs(value)).alias("__gross"))
        summed = df.filter(F.col("ticker").isNotNull()).groupBy(by, "ticker").agg(F.sum(value).alias("__v"))
        return summed.join(total, by).select(by, "ticker", F.expr("try_divide(__v, __gross)").alias(name)), total.withColumnRenamed("__gross", f"{name}_gross")

    (left, ref_gross), (right, our_gross) = side(ref, "position", "ref"), side(ours, "weight", "ours")
    none = ours.groupBy(by).agg(F.sum(F.col("ticker").isNull().cast("long")).alias("no_ticker"))
    both = left.join(right, [by, "ticker"], "full_outer")
    matched = F.col("ref").isNotNull() & F.col("ours").isNotNull()
    diff = F.abs(F.col("ref") - F.col("ours"))
    out = both.groupBy(by).agg(
        F.sum(matched.cast("long")).alias("matched"), F.sum(F.col("ours").isNull().cast("long")).alias("ref_only"),
        F.sum(F.col("ref").isNull().cast("long")).alias("ours_only"), F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"),
        F.avg(F.when(matched, (diff < 1e-4).cast("double"))).alias("within_1bp"),
        F.avg(F.when(matched, (F.col("ref") * F.col("ours") > 0).cast("double"))).alias("sign_agree"),
        safe_corr("ref", "ours").alias("corr"))
    out = out.join(none, by, "left").join(ref_gross, by, "left").join(our_gross, by, "left")
    out = out.join(expected.select(by, F.col("gross").alias("__expected")), by, "left") if expected is not None else out.withColumn("__expected", F.lit(None).cast("double"))
    same = (F.col("ref_only") == F.coalesce("no_ticker", F.lit(0))) & (F.col("ours_only") == 0)
    out = out.withColumn("same_names", same).withColumn("shape_ok", same & (F.col("max_diff") < 1e-4))
    ratio = F.try_divide(F.col("ref_gross"), F.col("__expected"))
    return out.withColumn("scale_ratio", ratio).withColumn("scale_ok", F.abs(F.col("scale_ratio") - 1) < 0.01).drop("__expected")
