"""Trial tables and comparisons."""

from pyspark.sql import functions as F

from checks.accounting import summary_sql
from checks.registry import near, query
from checks.views import TO_BOOK, TO_CANDIDATES, TO_LEDGER, label, r6, with_
from crossweave.functions.columns import month_label
from crossweave.operators import accounting as A
from crossweave.operators import trials as J
from crossweave.sources import demo_tables as D


# Fixed values, written out: the trials of the grid with their gross and position limits.
GRID_SQL = """(
  SELECT trial, 2.0::DOUBLE AS gross_limit, 0.05::DOUBLE AS cap FROM (VALUES ('baseline'),
    ('annual_vol_limit_0.05'), ('annual_vol_limit_0.075'), ('annual_vol_limit_0.1'), ('annual_vol_limit_0.125'), ('annual_vol_limit_0.15'), ('annual_vol_limit_0.2'),
    ('risk_penalty_10.0'), ('risk_penalty_30.0'), ('risk_penalty_300.0'), ('risk_penalty_1000.0'), ('risk_penalty_3000.0'),
    ('cost_penalty_10.0'), ('cost_penalty_50.0'), ('cost_penalty_100.0'), ('cost_penalty_300.0'),
    ('beta_limit_0.05'), ('beta_limit_0.1'), ('beta_limit_0.2'), ('beta_limit_None'),
    ('sector_limit_0.0'), ('sector_limit_0.025'), ('sector_limit_0.05'), ('sector_limit_0.1'), ('size_limit_0.0'), ('size_limit_0.05'), ('size_limit_0.1'),
    ('covariance_months_12'), ('covariance_months_24'), ('covariance_months_60'),
    ('turnover_limit_0.75'), ('turnover_limit_1.0'), ('turnover_limit_1.5'), ('turnover_limit_2.0'),
    ('cost_stress_35.0bps'), ('cost_stress_50.0bps'), ('cost_stress_100.0bps'),
    ('a0_control'), ('a1_units'), ('a2_risk_lo'), ('a3_risk_hi'), ('a4_turnover'), ('a5_beta_off')) t(trial)
  UNION ALL SELECT * FROM (VALUES ('gross_limit_0.75', 0.75, 0.05), ('gross_limit_1.0', 1.0, 0.05), ('gross_limit_1.25', 1.25, 0.05), ('gross_limit_1.5', 1.5, 0.05),
    ('gross_limit_1.75', 1.75, 0.05), ('position_limit_0.005', 2.0, 0.005), ('position_limit_0.01', 2.0, 0.01), ('position_limit_0.015', 2.0, 0.015), ('position_limit_0.025', 2.0, 0.025),
    ('refine_r10.0_sector', 2.0, 0.025), ('refine_r30.0_sector', 2.0, 0.025))
  UNION ALL SELECT 'mix_g' || g || '_p' || p || '_c' || c, g::DOUBLE, p::DOUBLE FROM (VALUES ('1.0'), ('1.5'), ('2.0')) g(g), (VALUES ('0.01'), ('0.025')) p(p), (VALUES ('10.0'), ('100.0')) c(c)
  UNION ALL SELECT 'refine_r' || r || '_p' || p || '_g' || g, g::DOUBLE, p::DOUBLE FROM (VALUES ('3.0'), ('10.0'), ('30.0')) r(r), (VALUES ('0.015'), ('0.025')) p(p), (VALUES ('1.5'), ('2.0')) g(g)
  UNION ALL SELECT 'refine_r' || r || '_p' || p || '_v' || v, 2.0, p::DOUBLE FROM (VALUES ('10.0'), ('30.0')) r(r), (VALUES ('0.015'), ('0.025')) p(p), (VALUES ('0.1'), ('0.125'), ('0.15')) v(v)
  ) g(trial, gross_limit, cap)"""


@query("j01_trial_grid_feasible", with_(*TO_CANDIDATES) + f"""
, c AS (SELECT target_mi, count(*) AS names FROM candidates GROUP BY 1)
SELECT trial, count(*) FILTER (names * cap >= gross_limit) AS months_cap_holds_gross, count(*) FILTER (names * 0.001 <= gross_limit) AS months_floor_fits
FROM c, {GRID_SQL} GROUP BY 1""")
def trial_grid_feasible(spark, sf):
    """Months of the schedule in which the floor and cap of each trial of the grid, its refinements and the arms can hold its gross."""
    every = J.trial_grid(spark).unionByName(J.trial_grid(spark, refine=True)).unionByName(J.arm_trials(spark))
    settings = J.resolve_settings(every).select("trial", "gross_limit", "position_limit", "minimum_position_weight",
                                                              F.lit("global").alias("schedule"))
    months = D.schedules(spark, sf).groupBy("schedule", "target_mi").agg(F.count(F.lit(1)).alias("names"))
    both = months.join(settings, "schedule")
    return both.groupBy("trial").agg(
        F.sum((F.col("names") * F.col("position_limit") >= F.col("gross_limit")).cast("long")).alias("months_cap_holds_gross"),
        F.sum((F.col("names") * F.col("minimum_position_weight") <= F.col("gross_limit")).cast("long")).alias("months_floor_fits"))


@query("j02_resolve_settings", """
WITH t AS (SELECT 'trial_' || o_orderkey AS trial, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN ' None ' WHEN o_orderkey % 4 = 2 THEN '0.25' ELSE 'abc' END AS b,
  CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN '24' ELSE '24.5' END AS m FROM orders)
SELECT trial, CASE WHEN b IS NULL THEN CAST(0.0 AS DOUBLE) ELSE try_cast(trim(b) AS DOUBLE) END AS beta_limit,
  CASE WHEN m = '' THEN 36 WHEN m = '24' THEN 24 END AS covariance_months,
  concat_ws(',', CASE WHEN b = 'abc' THEN 'beta_limit' END, CASE WHEN m = '24.5' THEN 'covariance_months' END) AS unreadable FROM t""")
def resolve_settings(spark, sf):
    k = F.col("o_orderkey") % 4
    trials = D.table(spark, sf, "orders").select(
        F.concat(F.lit("trial_"), F.col("o_orderkey").cast("string")).alias("trial"),
        F.when(k == 1, " None ").when(k == 2, "0.25").when(k == 3, "abc").alias("beta_limit"),
        F.when(F.col("o_custkey") % 3 == 0, "").when(F.col("o_custkey") % 3 == 1, "24").otherwise("24.5").alias("covariance_months"))
    return J.resolve_settings(trials).select("trial", "beta_limit", "covariance_months", "unreadable")


@query("j03_trial_weights", with_(*TO_BOOK) + f"SELECT trial, {label('target_mi')} AS month, permno, side, {r6('weight')} AS weight FROM book")
def trial_weights(spark, sf):
    sized = J.size_trials(D.trials(spark, sf), D.schedules(spark, sf), strict=False)
    return sized.select("trial", month_label("target_mi").alias("month"), "permno", "side", near("weight").alias("weight"))


@query("j03_run_trials", with_(*TO_LEDGER) + f"""
SELECT trial, {label('target_mi')} AS month, {r6('total_net')} AS total_net, {r6('turnover')} AS turnover, {r6('market_return')} AS market_return FROM ledger""")
def run_trials(spark, sf):
    led = J.run_trials(D.trials(spark, sf), D.schedules(spark, sf), D.returns(spark, sf), D.cash(spark, sf), D.market(spark, sf), strict=False)
    return led.select("trial", month_label("target_mi").alias("month"), *[near(c).alias(c) for c in ("total_net", "turnover", "market_return")])


@query("j04_leaderboard", with_(*TO_LEDGER) + summary_sql("trial", "ledger") + f"""
SELECT trial, schedule, rule, gross_limit, months, {r6('information_ratio')} AS information_ratio, {r6('cagr')} AS cagr
FROM summ JOIN trials USING (trial) WHERE trial <> 'equal_1.0'""")
def leaderboard(spark, sf):
    settings = D.trials(spark, sf)
    board = J.leaderboard(settings, A.summarize(D.trial_ledger(spark, sf), ["trial"]), settings.filter("rule = 'equal'"))
    return board.select("trial", "schedule", "rule", "gross_limit", "months", near("information_ratio").alias("information_ratio"), near("cagr").alias("cagr"))


@query("j05_paired", with_(*TO_LEDGER) + f"""
SELECT trial, {r6('avg(total_net) FILTER (target_mi < 1999 * 12 + 1)')} AS mean_net_before, {r6('avg(total_net) FILTER (target_mi >= 1999 * 12 + 1)')} AS mean_net_after FROM ledger GROUP BY 1""")
def paired(spark, sf):
    led = D.trial_ledger(spark, sf)
    cut = 1999 * 12 + 1
    mean = F.avg("total_net").alias("mean_net")
    both = J.paired(led.filter(F.col("target_mi") < cut).groupBy("trial").agg(mean), led.filter(F.col("target_mi") >= cut).groupBy("trial").agg(mean), ["mean_net"])
    return both.select("trial", near("mean_net_before").alias("mean_net_before"), near("mean_net_after").alias("mean_net_after"))


@query("j06_check_complete", with_(*TO_LEDGER) + f"""
, m AS (SELECT DISTINCT target_mi FROM scored), v AS (SELECT trial, max(abs(net)) - 0.1 AS max_violation FROM ledger GROUP BY 1)
SELECT trial, count(DISTINCT target_mi) AS months, count(*) - count(DISTINCT target_mi) AS duplicates, {r6('max(max_violation)')} AS max_violation,
  count(DISTINCT target_mi) = (SELECT count(*) FROM m) AND max(max_violation) <= 1e-6 AS complete
FROM ledger JOIN v USING (trial) GROUP BY 1""")
def check_complete(spark, sf):
    led = D.trial_ledger(spark, sf)
    violations = led.select("trial", (F.abs("net") - 0.1).alias("violation"))
    checked = J.check_complete(led, D.scored(spark, sf).select("target_mi").distinct(), violations)
    return checked.select("trial", "months", "duplicates", near("max_violation").alias("max_violation"), "complete")


@query("j07_match_positions", with_(*TO_BOOK) + f"""
, ref AS (SELECT target_mi, ticker, weight * 3e6 AS position FROM book WHERE trial = 'matched_1.0' AND ticker IS NOT NULL),
our AS (SELECT target_mi, ticker, weight FROM book WHERE trial = 'equal_1.0'),
r AS (SELECT target_mi, ticker, sum(position) / any_value(g) AS ref FROM ref JOIN (SELECT target_mi, sum(abs(position)) AS g FROM ref GROUP BY 1) USING (target_mi) GROUP BY 1, 2),
o AS (SELECT target_mi, ticker, sum(weight) / any_value(g) AS ours FROM our JOIN (SELECT target_mi, sum(abs(weight)) AS g FROM our GROUP BY 1) USING (target_mi)
  WHERE ticker IS NOT NULL GROUP BY 1, 2),
j AS (SELECT * FROM r FULL JOIN o USING (target_mi, ticker)),
n AS (SELECT target_mi, count(*) FILTER (ticker IS NULL) AS no_ticker, sum(abs(weight)) AS our_gross FROM our GROUP BY 1),
g AS (SELECT target_mi, sum(abs(weight)) * 3e6 AS ref_gross FROM book WHERE trial = 'matched_1.0' AND ticker IS NOT NULL GROUP BY 1),
e AS (SELECT target_mi, sum(abs(weight)) * 3e6 AS expected FROM book WHERE trial = 'matched_1.0' GROUP BY 1)
SELECT {label('j.target_mi')} AS month, count(*) FILTER (ref IS NOT NULL AND ours IS NOT NULL) AS matched, count(*) FILTER (ours IS NULL) AS ref_only,
  count(*) FILTER (ref IS NULL) AS ours_only, any_value(no_ticker) AS no_ticker, {r6('max(abs(ref - ours))')} AS max_diff, {r6('avg(abs(ref - ours))')} AS mean_diff,
  {r6('avg(CAST(abs(ref - ours) < 1e-4 AS INTEGER))')} AS within_1bp, {r6('avg(CAST(ref * ours > 0 AS INTEGER))')} AS sign_agree, {r6('corr(ref, ours)')} AS corr,
  count(*) FILTER (ours IS NULL) = any_value(no_ticker) AND count(*) FILTER (ref IS NULL) = 0 AS same_names,
  count(*) FILTER (ours IS NULL) = any_value(no_ticker) AND count(*) FILTER (ref IS NULL) = 0 AND max(abs(ref - ours)) < 1e-4 AS shape_ok,
  {r6('any_value(ref_gross) / 1e6')} AS ref_gross, {r6('any_value(our_gross)')} AS our_gross, {r6('any_value(ref_gross / expected)')} AS scale_ratio,
  any_value(abs(ref_gross / expected - 1) < 0.01) AS scale_ok
FROM j LEFT JOIN n USING (target_mi) LEFT JOIN g USING (target_mi) LEFT JOIN e USING (target_mi) GROUP BY j.target_mi""")
def match_positions(spark, sf):
    book = D.book(spark, sf)
    ref = book.filter("trial = 'matched_1.0' AND ticker IS NOT NULL").select("target_mi", "ticker", (F.col("weight") * 3e6).alias("position"))
    ours = book.filter("trial = 'equal_1.0'").select("target_mi", "ticker", "weight")
    expected = book.filter("trial = 'matched_1.0'").groupBy("target_mi").agg((F.sum(F.abs("weight")) * 3e6).alias("gross"))
    m = J.match_positions(ref, ours, "target_mi", expected).withColumn("ref_gross", F.col("ref_gross") / 1e6).withColumnRenamed("ours_gross", "our_gross")
    rounded = ("max_diff", "mean_diff", "within_1bp", "sign_agree", "corr", "ref_gross", "our_gross", "scale_ratio")
    return m.select(month_label("target_mi").alias("month"), "matched", "ref_only", "ours_only", "no_ticker", "same_names", "shape_ok", "scale_ok",
                    *[near(c).alias(c) for c in rounded])
