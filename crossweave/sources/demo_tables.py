"""Panel, event and series inputs derived from the order tables (see FIXTURES.md).

Entity = supplier, month = ship month. Money columns are summed as whole cents, so
totals do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.functions.columns import clip, month_end, month_index, month_label
from crossweave.operators.columnar import ROW, numbered
from crossweave.operators.ranks import rows_at
from crossweave.session import Checks, shared_stage, stage

WINDOW_START, WINDOW_END = "1995-02", "2001-07"
SIZE_GROUPS = ("nano", "micro", "small", "large", "mega")
CHARACTERISTICS = ("beta_60m", "betabab_1260d", "betadown_252d", "rvol_21d", "ret", "ni_me", "ret_12_1",
                   "disc_top", "tax_top", "qty_line")


def _index(label: str) -> int:
    return int(label[:4]) * 12 + int(label[5:])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    """Money as whole cents; the small shift keeps 1.005, which is less as a double, a half."""
    return F.rint(F.col(c) * 100 + F.signum(c) * 1e-9).cast("long")


def _exact_sum(c: str) -> Column:
    return F.sum(_cents(c)) / F.lit(100.0)


def _size_bounds(cells: DataFrame) -> DataFrame:
    """(mi, __bounds): the last (me, permno) of each month's first four fifths."""
    def last(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda q: q * F.floor(n / 5) + F.least(q, n % 5))

    return rows_at(cells, ["mi"], "me", "permno", last).groupBy("mi").agg(F.collect_list(F.struct("me", "permno")).alias("__bounds"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier months with their history, all but the size group, which needs the whole month."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("permno"), month_index("l_shipdate").alias("mi"), "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    # A cell's few lines lie far apart, so sums made before the exchange would be as many as the lines, and wider: the lines travel, once,
    # to where their supplier's history is.
    cells = lines.repartition("permno").groupBy("permno", "mi").agg(
        F.count(F.lit(1)).alias("lines"), _exact_sum("l_extendedprice").alias("me"),
        _exact_sum("l_quantity").alias("qty"), _exact_sum("l_discount").alias("disc"), _exact_sum("l_tax").alias("tax"),
        (F.sum(_cents("l_extendedprice") * (_cents("l_discount") - _cents("l_tax"))) / F.lit(10000.0)).alias("flow"),
        (F.sum(_cents("l_extendedprice") * _cents("l_discount")) / F.lit(10000.0)).alias("disc_value"),
        F.max("l_discount").alias("disc_max"), F.max("l_tax").alias("tax_max"),
        F.max("l_returnflag").alias("gvkey"), F.max("l_linestatus").alias("iid"),
        F.stddev_samp(unit).alias("unit_sd"), F.avg(unit).alias("unit_avg"))
    # one row per calendar month, as are the bounds below
    rates = lines.groupBy("mi").agg((_exact_sum("l_tax") / F.count(F.lit(1)) * 100).alias("rate"))
    history = W.partitionBy("permno").orderBy("mi")
    price = F.col("me") / F.col("qty")
    raw = F.col("prc") / F.lag("prc").over(history) - 1
    next_to = F.lag("mi").over(history) == F.col("mi") - 1
    panel = (cells.withColumn("prc", price)
             .join(F.broadcast(rates), "mi")
             .withColumn("cash", F.col("rate") / 1200)
             .withColumn("ret", F.when(next_to, 0.2 * clip(raw, -0.5, 0.5)))
             .withColumn("ret_exc", F.col("ret") - F.col("cash"))
             .withColumn("ret_exc_lead1m",
                         F.when(F.lead("mi").over(history) == F.col("mi") + 1, F.lead("ret_exc").over(history)))
             .withColumn("dolvol_126d", F.sum("me").over(history.rowsBetween(-5, 0)))
             .withColumn("ret_12_1", F.lag("prc", 1).over(history) / F.lag("prc", 12).over(history) - 1))
    places = (table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"),
                                                    F.col("s_nationkey") == F.col("n_nationkey"))
              .select(F.col("s_suppkey").alias("permno"), F.col("s_name").alias("company_name"),
                      F.format_string("1%d%02d10", F.col("n_regionkey"), F.col("n_nationkey")).alias("code")))
    return panel.join(places, "permno")


def _panel(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """The panel's columns, made when it is read: only what it can't do without is written."""
    smaller = F.filter("__bounds", lambda b: (b["me"] < F.col("me")) | ((b["me"] == F.col("me")) & (b["permno"] < F.col("permno"))))
    quintile = F.when(F.col("me").isNotNull(), F.size(smaller) + 1)
    return (cells.join(F.broadcast(bounds), "mi", "left").select(
        "permno", "mi", month_label("mi").alias("month"), month_end("mi").alias("eom"), "lines", "me", "prc",
        "qty", "disc_value", "cash", "rate", "ret", "ret_exc", "ret_exc_lead1m", "dolvol_126d", "ret_12_1",
        F.when(F.col("permno") % 97 != 0, F.col("code")).alias("gics"),
        F.element_at(F.array(*map(F.lit, SIZE_GROUPS)), quintile).alias("size_grp"),
        F.when(F.col("lines") >= 3, (F.col("disc") / F.col("lines") * 20)).alias("betabab_1260d"),
        (F.col("tax") / F.col("lines") * 25).alias("betadown_252d"),
        F.lit(1.0).alias("beta_60m"),
        F.round(F.col("unit_sd") / F.col("unit_avg"), 10).alias("rvol_21d"),
        (F.col("flow") / F.col("me")).alias("ni_me"),
        (F.col("disc") / F.col("lines")).alias("avg_disc"),
        (F.col("tax") / F.col("lines")).alias("avg_tax"),
        F.when((F.col("permno") + F.col("mi")) % 11 != 0, F.concat(F.lit("T"), (F.col("permno") % 37).cast("string"))).alias("ticker"),
        F.when((F.col("permno") + F.col("mi")) % 7 != 0, F.col("company_name")).alias("company_name"),
        "gvkey", "iid", F.col("ret").alias("ret_1_0"), F.col("me").alias("market_equity"),
        F.when(F.col("lines") >= 6, F.col("disc_max")).alias("disc_top"),
        F.when(F.col("lines") >= 9, F.col("tax_max")).alias("tax_top"),
        F.when(F.col("lines") >= 4, (F.col("qty") / F.col("lines"))).alias("qty_line")))


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stage(_cells(spark, sf_dir), "cells")
    return _panel(cells, _size_bounds(cells))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = shared_stage(spark, sf_dir, "cells", lambda: _cells(spark, sf_dir))
    return _panel(cells, shared_stage(spark, sf_dir, "size_bounds", lambda: _size_bounds(cells)))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(permno, target_mi, forecast, alt_forecast) for target months inside the window."""
    p = panel(spark, sf_dir)
    return (p.select("permno", (F.col("mi") + 1).alias("target_mi"),
                     (F.col("avg_disc") * 0.4 - F.col("avg_tax") * 0.2 - 0.01).alias("forecast"),
                     (F.col("avg_tax") * 0.2).alias("alt_forecast"))
            .filter(F.col("target_mi").between(_index(WINDOW_START), _index(WINDOW_END))))


def alt_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return p.select("permno", "mi", F.explode(F.create_map(
        F.lit("foot"), F.col("qty"), F.lit("card"), F.col("disc_value"),
        F.lit("web"), F.col("lines").cast("double"))).alias("dataset", "value"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily benchmark level (average order value); texts stay unparsed as in a raw CSV."""
    return (table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("observation_date"))
            .agg((_exact_sum("o_totalprice") / F.count(F.lit(1))).alias("level")))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("filing_date"),
                    F.when(F.col("o_orderkey") % 13 != 0, F.to_date("o_orderdate")).alias("content_report_date"),
                    F.concat(F.lit("T"), ((F.col("l_suppkey") + F.col("l_linenumber") % 2) % 37).cast("string")).alias("ticker"),
                    (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"),
                    (F.col("l_returnflag") == "R").alias("is_amendment"),
                    F.when(F.col("l_linenumber") != 5, F.col("l_suppkey")).alias("cik"),
                    month_index("l_shipdate").alias("mi")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(permno, date, daily_return): unit price per ship day against the previous observed day."""
    def build():
        days = (table(spark, sf_dir, "lineitem")
                .groupBy(F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("date"))
                .agg((_exact_sum("l_extendedprice") / _exact_sum("l_quantity")).alias("unit")))
        raw = F.col("unit") / F.lag("unit").over(W.partitionBy("permno").orderBy("date")) - 1
        return (days.withColumn("daily_return", 0.2 * clip(raw, -0.5, 0.5))
                .filter(F.col("daily_return").isNotNull()).select("permno", "date", "daily_return"))
    return shared_stage(spark, sf_dir, "daily", build)


def customer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse panel: one row per customer and order month."""
    return (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("permno"), month_index("o_orderdate").alias("mi"))
            .agg(_exact_sum("o_totalprice").alias("me"), F.count(F.lit(1)).alias("orders")))


MIN_PRICE = 1500.0
SHORT_MIN_ME = 200_000.0


def _universe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossweave.plans import score as S
    checks = Checks()
    return shared_stage(spark, sf_dir, "universe",
                        lambda: numbered(S.universe(forecasts(spark, sf_dir), panel(spark, sf_dir), MIN_PRICE, checks=checks).sortWithinPartitions("target_mi")), checks)


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe_rows(spark, sf_dir).drop(ROW)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossweave.plans import score as S
    return shared_stage(spark, sf_dir, "scored", lambda: S.score(_universe_rows(spark, sf_dir)))


# Fixed leg sizes, as a mandate sets them: the book does not grow with the universe.
LEG = 10
SHORT_LEG = 15


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossweave.operators import selection as E
    return shared_stage(spark, sf_dir, "candidates", lambda: E.with_scores(
        E.select_global(scored(spark, sf_dir), LEG, 2.5, SHORT_MIN_ME), scored(spark, sf_dir)))


def balanced_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossweave.operators import selection as E
    return shared_stage(spark, sf_dir, "balanced", lambda: E.with_scores(
        E.select_sector_balanced(scored(spark, sf_dir), LEG, 2.5, SHORT_MIN_ME), scored(spark, sf_dir)))


# The trials run on the demo schedules.
TRIALS = (
    ("matched_1.0", "global", "beta_matched", 1.0, 0.08, 20.0),
    ("matched_0.75", "global", "beta_matched", 0.75, 0.05, 35.0),
    ("steep_0.75", "balanced", "rank_steep", 0.75, 0.06, 20.0),
    ("equal_1.0", "global", "equal", 1.0, 0.08, 20.0),
)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = spark.createDataFrame(
        TRIALS, "trial string, schedule string, rule string, gross_limit double, position_limit double, trading_cost_bps double")
    return table_.select("*", F.lit(-0.1).alias("net_min"), F.lit(0.1).alias("net_max"), F.lit(0.001).alias("minimum_position_weight"))


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["target_mi", "permno", "side", "sector", "score", "forecast", "rvol_21d", "beta_use", "size", "me", "dolvol_126d", "pe_pct",
            "ticker", "company_name"]
    both = candidates(spark, sf_dir).select(*keep, F.lit("global").alias("schedule"))
    return both.unionByName(balanced_candidates(spark, sf_dir).select(*keep, F.lit("balanced").alias("schedule")))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("permno", "mi", "ret")


def cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("mi").agg(F.max("cash").alias("cash"), F.max("rate").alias("rate"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark months, damped like the stock returns."""
    from crossweave.operators import accounting as A
    raw = A.benchmark_returns(levels(spark, sf_dir))
    return raw.select("mi", (0.2 * clip("market_return", -0.5, 0.5)).alias("market_return"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials' weights with settings, returns and liquidity limits."""
    from crossweave.operators import accounting as A
    from crossweave.operators import sizing as Z
    from crossweave.operators import trials as J

    def build():
        sized = J.size_trials(trials(spark, sf_dir), schedules(spark, sf_dir), strict=False)
        limit = Z.liquidity_cap(F.lit(3.0), F.lit(0.10), F.lit(2e7), F.col("minimum_position_weight"), F.col("position_limit"))
        raw = 3.0 * 0.10 * F.coalesce(F.col("dolvol_126d"), F.lit(0.0)) / 2e7
        return A.with_returns(sized, returns(spark, sf_dir)).withColumn("liquidity_limit", limit).withColumn("liquidity_uncapped", raw)
    return shared_stage(spark, sf_dir, "book", build)


def trial_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossweave.operators import accounting as A
    from crossweave.operators import trials as J

    def build():
        led = J.run_trials(trials(spark, sf_dir), schedules(spark, sf_dir), returns(spark, sf_dir), cash(spark, sf_dir), market(spark, sf_dir),
                           strict=False)
        return A.attach_hurdle(led, A.official_hurdle(cash(spark, sf_dir)))
    return shared_stage(spark, sf_dir, "ledger", build)
