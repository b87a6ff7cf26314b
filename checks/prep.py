"""Panel preparation."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import FORECASTS, JOINED, PANEL, TO_UNIVERSE, label, r6, with_
from crossweave.functions.columns import month_label
from crossweave.operators import prep as P
from crossweave.sources import demo_tables as D


@query("b01_month_keys", """
SELECT strftime(o_orderdate, '%Y-%m') AS observed_month, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m') AS target_month, count(*) AS n
FROM orders GROUP BY 1, 2""")
def month_keys(spark, sf):
    return P.month_keys(D.table(spark, sf, "orders"), "o_orderdate").groupBy("observed_month", "target_month").agg(
        F.count(F.lit(1)).alias("n"))


@query("b02_check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def check_unique(spark, sf):
    return P.duplicate_groups(D.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


COLS = ["ret", "betabab_1260d", "rvol_21d", "ret_12_1", "log_ret"]


@query("b03_check_finite", with_(PANEL) + ", x AS (SELECT *, CASE WHEN ret = 0.1 THEN CAST('inf' AS DOUBLE) WHEN ret = -0.1 THEN CAST('nan' AS DOUBLE) ELSE ret END AS log_ret FROM panel)\n"
       + " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR isnan({c})) AS missing, "
           f"count(*) FILTER (isinf({c})) AS infinite FROM x" for c in COLS))
def check_finite(spark, sf):
    marked = F.when(F.col("ret") == 0.1, float("inf")).when(F.col("ret") == -0.1, float("nan")).otherwise(F.col("ret"))
    return P.nonfinite_counts(D.panel(spark, sf).withColumn("log_ret", marked), COLS)


@query("b04_lagged_join", with_(PANEL, FORECASTS, JOINED) + f"""
SELECT permno, {label('target_mi')} AS target_month, {label('observed_mi')} AS observed_month, {r6('forecast')} AS forecast, {r6('prc')} AS prc FROM joined""")
def lagged_join(spark, sf):
    out = P.lagged_join(D.forecasts(spark, sf), D.panel(spark, sf))
    return out.select("permno", month_label("target_mi").alias("target_month"), month_label("observed_mi").alias("observed_month"),
                      near("forecast").alias("forecast"), near("prc").alias("prc"))


@query("b05_beta_use", with_(PANEL) + f"""
SELECT permno, month, {r6('least(greatest(coalesce(betabab_1260d, betadown_252d, beta_60m), -0.5), 1.5)')} AS beta_use FROM panel""")
def beta_use(spark, sf):
    return D.panel(spark, sf).select("permno", "month", near(P.beta_use(high=1.5)).alias("beta_use"))


@query("b06_eligible", with_(*TO_UNIVERSE) + f"SELECT permno, {label('target_mi')} AS month FROM universe")
def eligible(spark, sf):
    joined = P.lagged_join(D.forecasts(spark, sf), D.panel(spark, sf)).withColumn("beta_use", P.beta_use())
    return P.eligible(joined, D.MIN_PRICE).select("permno", month_label("target_mi").alias("month"))


@query("b06_eligible_unscreened", with_(*TO_UNIVERSE) + f"""
SELECT permno, {label('target_mi')} AS month FROM joined WHERE beta_use IS NOT NULL AND rvol_21d > 0 AND me > 0""")
def eligible_unscreened(spark, sf):
    joined = P.lagged_join(D.forecasts(spark, sf), D.panel(spark, sf)).withColumn("beta_use", P.beta_use())
    return P.eligible(joined, screened=False).select("permno", month_label("target_mi").alias("month"))


@query("b07_eligible_imputed", with_(*TO_UNIVERSE) + f"""
, k AS (SELECT permno, target_mi, me, rvol_21d, CASE WHEN beta_use < 0.8 THEN NULL ELSE beta_use END AS beta_use FROM joined WHERE abs(prc) >= 1500)
SELECT permno, {label('target_mi')} AS month,
  {r6('coalesce(me, median(me) OVER m, 1.0)')} AS me, {r6('coalesce(beta_use, median(beta_use) OVER m, 1.0)')} AS beta_use,
  {r6('coalesce(rvol_21d, median(rvol_21d) OVER m, 0.02)')} AS rvol_21d FROM k WINDOW m AS (PARTITION BY target_mi)""")
def eligible_imputed(spark, sf):
    joined = P.lagged_join(D.forecasts(spark, sf), D.panel(spark, sf)).withColumn("beta_use", P.beta_use())
    joined = joined.select("permno", "target_mi", "prc", "me", "rvol_21d",
                           F.when(F.col("beta_use") >= 0.8, F.col("beta_use")).alias("beta_use"))
    out = P.eligible_imputed(joined, D.MIN_PRICE)
    return out.select("permno", month_label("target_mi").alias("month"),
                      *[near(c).alias(c) for c in ("me", "beta_use", "rvol_21d")])


@query("b08_sector_code", with_(PANEL) + "SELECT coalesce(substr(gics, 1, 2), 'na') AS sector, count(*) AS n FROM panel GROUP BY 1")
def sector_code(spark, sf):
    return D.panel(spark, sf).groupBy(P.sector_code().alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@query("b09_missing_months", """
WITH c AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS mi, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS me FROM orders GROUP BY 1, 2)
SELECT DISTINCT mi FROM c WHERE mi NOT IN (SELECT mi FROM c WHERE me > 900000)""")
def missing_months(spark, sf):
    c = D.customer_months(spark, sf)
    return P.missing_months(c.filter("me > 900000"), c, "mi")


@query("b09_month_gaps", """
WITH a AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS mi, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS me FROM orders GROUP BY 1, 2),
c AS (SELECT DISTINCT mi FROM a WHERE me > 900000),
f AS (SELECT unnest(generate_series(min(mi), max(mi))) AS mi FROM c)
SELECT CAST(mi AS INTEGER) AS mi FROM f WHERE mi NOT IN (SELECT mi FROM c)""")
def month_gaps(spark, sf):
    return P.month_gaps(D.customer_months(spark, sf).filter("me > 900000"), "mi")


@query("b10_implied_cash", with_(PANEL) + f"""
SELECT month, {r6('median(ret - ret_exc)')} AS cash, max(ret - ret_exc) - min(ret - ret_exc) <= 1e-7 AS consistent
FROM panel WHERE ret IS NOT NULL GROUP BY 1""")
def implied_cash(spark, sf):
    return P.implied_cash(D.panel(spark, sf), strict=True).select(
        month_label("mi").alias("month"), near("cash").alias("cash"), "consistent")


@query("b11_fill_labels", with_(PANEL) + """
SELECT permno, month,
  coalesce(last_value(ticker IGNORE NULLS) OVER (PARTITION BY permno ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(ticker IGNORE NULLS) OVER (PARTITION BY permno ORDER BY mi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ticker_filled,
  coalesce(last_value(company_name IGNORE NULLS) OVER (PARTITION BY permno ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(company_name IGNORE NULLS) OVER (PARTITION BY permno ORDER BY mi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS company_name_filled
FROM panel""")
def fill_labels(spark, sf):
    return P.fill_labels(D.panel(spark, sf), ["ticker", "company_name"]).select(
        "permno", "month", "ticker_filled", "company_name_filled")


@query("b12_window_filter", with_(PANEL) + """
SELECT month, count(*) AS n FROM panel WHERE mi >= 1996 * 12 + 3 AND mi <= 1999 * 12 + 6
  AND mi IN (SELECT DISTINCT mi FROM panel WHERE mi >= 1996 * 12 + 3 ORDER BY 1 LIMIT 18) GROUP BY 1""")
def window_filter(spark, sf):
    out = P.window_filter(D.panel(spark, sf), "mi", 1996 * 12 + 3, 1999 * 12 + 6, 18)
    return out.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("b13_missing_exposure", with_(PANEL) + f"""
SELECT month, count(*) AS missing_return_positions, {r6('sum(abs(ni_me))')} AS missing_return_gross FROM panel WHERE ret IS NULL GROUP BY 1""")
def missing_exposure(spark, sf):
    held = D.panel(spark, sf).select("month", F.col("ni_me").alias("weight"), F.col("ret").alias("raw_return"))
    out = P.missing_exposure(held, ["month"])
    return out.withColumn("missing_return_gross", near("missing_return_gross"))


