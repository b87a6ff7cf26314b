"""Limit and mandate audits."""

from pyspark.sql import functions as F

from checks.accounting import BREACHES, LEDGER_FLAGS, NAME_FLAGS, TO_DRIFTED, TOTALS, breach_rows, drifted_rows, flag_sql
from checks.registry import near, query
from checks.risk import TO_RISK, book_variance
from checks.views import LEDGER, TO_BOOK, TO_LEDGER, label, r6, with_
from crossweave.functions.columns import month_label
from crossweave.operators import audits as H
from crossweave.operators import sizing as Z
from crossweave.operators import trials as J
from crossweave.sources import demo_tables as D

BY = ["trial", "target_mi"]


def out(df, *columns, exact=()):
    return df.select("trial", month_label("target_mi").alias("month"), *exact, *[near(c).alias(c) for c in columns])


OPTIONAL = {"beta_limit": 0.0, "sector_limit": 0.02, "size_limit": 0.10, "turnover_limit": 0.75, "annual_vol_limit": 0.05,
            "expensive_percentile": 0.70, "expensive_long_cap": 0.005}

RULES = {
    "mandate_gross": "gross - 2.0", "mandate_net_min": "-0.5 - net", "mandate_net_max": "net - 0.5", "mandate_position": "top - 0.05",
    "long_limits": "over_long", "short_limits": "over_short", "house_gross": "gross - gross_limit", "house_net_min": "net_min - net",
    "house_net_max": "net - net_max", "selected_name_minimum": "under", "market_beta": "abs(beta) - 0.0", "sector": "sector_net - 0.02",
    "size": "abs(size) - 0.10", "turnover": "turnover - 0.75", "variance": "12 * variance - 0.05 * 0.05", "expensive_long_cap": "expensive",
    "liquidity": "illiquid", "sector_gross_cap": "over_sector", "dollar_neutral": "abs(net)", "beta_neutral": "abs(beta)"}


@query("h01_constraint_audit", with_(*TO_RISK, LEDGER) + f"""
, gl AS (SELECT target_mi, sector, 1.25 * (count(*) / sum(count(*)) OVER (PARTITION BY target_mi)) AS share125 FROM scored GROUP BY target_mi, sector),
hb AS (SELECT * FROM book),
hs AS (SELECT b.trial, b.target_mi, b.sector, sum(weight) AS sn, sum(abs(weight)) AS sg, any_value(share125) * any_value(gross_limit) AS cap
  FROM hb b JOIN gl ON gl.target_mi = b.target_mi AND gl.sector = b.sector GROUP BY 1, 2, 3),
ht AS (SELECT trial, target_mi, max(abs(sn)) AS sector_net, max(sg - cap) AS over_sector FROM hs GROUP BY 1, 2),
hm AS (
  SELECT trial, target_mi, sum(abs(weight)) AS gross, sum(weight) AS net, sum(weight * beta_use) AS beta, sum(weight * size) AS size, max(abs(weight)) AS top,
    max(weight - CASE WHEN side > 0 THEN position_limit ELSE 0 END) AS over_long, max(-weight - CASE WHEN side < 0 THEN position_limit ELSE 0 END) AS over_short,
    max(minimum_position_weight - side * weight) AS under, max(CASE WHEN coalesce(pe_pct, 0) > 0.7 THEN weight - 0.005 END) AS expensive,
    max(abs(weight) - liquidity_limit) AS illiquid, max(gross_limit) AS gross_limit, max(net_min) AS net_min, max(net_max) AS net_max FROM hb GROUP BY 1, 2),
hw AS (SELECT hm.*, sector_net, over_sector, turnover, variance FROM hm JOIN ht USING (trial, target_mi) LEFT JOIN (SELECT trial, target_mi, turnover FROM ledger) USING (trial, target_mi)
  LEFT JOIN var USING (trial, target_mi)),
hr AS (""" + " UNION ALL ".join(f"SELECT trial, target_mi, '{n}' AS rule, {e} AS excess FROM hw" for n, e in RULES.items()) + f""")
SELECT trial, {label('target_mi')} AS month, rule, {r6('greatest(excess, 0)')} AS violation, greatest(excess, 0) <= 1e-6 AS passed FROM hr WHERE excess IS NOT NULL""")
def constraint_audit(spark, sf):
    book = D.book(spark, sf)
    for name, value in OPTIONAL.items():
        book = book.withColumn(name, F.lit(value))
    shares = Z.sector_gross_limits(D.scored(spark, sf), F.lit(1.25), F.lit(1.0)).select("target_mi", "sector", "gross_limit")
    limits = D.trials(spark, sf).select("trial", F.col("gross_limit").alias("g"))
    caps = book.select(*BY, "sector").distinct().join(shares, ["target_mi", "sector"]).join(limits, "trial") \
        .select(*BY, "sector", (F.col("gross_limit") * F.col("g")).alias("gross_limit"))
    audit = H.constraint_audit(book, BY, D.trial_ledger(spark, sf), book_variance(spark, sf), caps)
    return out(audit, "violation", exact=("rule", "passed"))


MANDATE_COLS = [f"breach_{n}" for n in LEDGER_FLAGS]


@query("h02_mandate_breaches", with_(*TO_DRIFTED, TOTALS, BREACHES) + f"SELECT trial, {label('target_mi')} AS month, names, sectors_held, "
       + ", ".join(MANDATE_COLS) + ", breaches FROM breach")
def mandate_breaches(spark, sf):
    return out(breach_rows(spark, sf), exact=("names", "sectors_held", *MANDATE_COLS, "breaches"))


NAME_COLS = [f"breach_{n}" for n in NAME_FLAGS]


@query("h03_mandate_breaches_names", with_(*TO_DRIFTED, TOTALS) + f", nb AS (SELECT *, {flag_sql(NAME_FLAGS)} FROM totals)\n"
       + f"SELECT trial, {label('target_mi')} AS month, {r6('ex_ante_beta')} AS ex_ante_beta, min_short_me, " + ", ".join(NAME_COLS) + ", breaches FROM nb")
def mandate_breaches_names(spark, sf):
    scaled = D.book(spark, sf).join(drifted_rows(spark, sf).select(*BY, "k"), BY)
    b = H.mandate_breaches_names(scaled, BY, min_names=15, max_names=20, min_short_me=250_000.0)
    return out(b, "ex_ante_beta", exact=("min_short_me", *NAME_COLS, "breaches"))


DRIFT = """dr AS (SELECT b.trial, b.target_mi, weight * (1 + filled) / (1 + l.total_net) AS d FROM book b JOIN ledger l USING (trial, target_mi)),
da AS (SELECT trial, target_mi, max(abs(d)) AS monthend_max_weight, sum(abs(d)) AS monthend_gross, sum(d) AS monthend_net,
  count(*) FILTER (abs(d) > 0.050001) AS monthend_names_over_limit FROM dr GROUP BY 1, 2)"""


def drift_rows(spark, sf):
    return H.drift_audit(D.book(spark, sf), D.trial_ledger(spark, sf), BY)


@query("h04_drift_audit", with_(*TO_LEDGER, DRIFT) + f"""
SELECT trial, {label('target_mi')} AS month, {r6('monthend_max_weight')} AS monthend_max_weight, {r6('monthend_gross')} AS monthend_gross,
  {r6('monthend_net')} AS monthend_net, monthend_names_over_limit FROM da""")
def drift_audit(spark, sf):
    return out(drift_rows(spark, sf), "monthend_max_weight", "monthend_gross", "monthend_net", exact=("monthend_names_over_limit",))


@query("h04_drift_rollup", with_(*TO_LEDGER, DRIFT) + f"""
SELECT trial, {r6('max(monthend_max_weight)')} AS max_monthend_weight, count(*) FILTER (monthend_names_over_limit > 0) AS months_over_limit FROM da GROUP BY 1""")
def drift_rollup(spark, sf):
    return H.drift_rollup(drift_rows(spark, sf), ["trial"]).withColumn("max_monthend_weight", near("max_monthend_weight"))


@query("h05_concentration", with_(*TO_BOOK) + f"""
, c AS (SELECT *, row_number() OVER (PARTITION BY trial, target_mi ORDER BY abs(weight) DESC, permno) AS n FROM book)
SELECT trial, {label('target_mi')} AS month, {r6('sum(abs(weight)) ** 2 / sum(weight ** 2)')} AS effective_names,
  {r6('sum(CASE WHEN n <= 10 THEN abs(weight) ELSE 0 END) / sum(abs(weight))')} AS top_share FROM c GROUP BY trial, target_mi""")
def concentration(spark, sf):
    return out(H.concentration(D.book(spark, sf), BY), "effective_names", "top_share")


@query("h06_position_count_flag", with_(*TO_BOOK) + f"""
SELECT trial, {label('target_mi')} AS month, count(*) FILTER (abs(weight) > 1e-6) AS positions, count(*) FILTER (abs(weight) > 1e-6) BETWEEN 18 AND 20 AS in_range
FROM book GROUP BY trial, target_mi""")
def position_count_flag(spark, sf):
    return out(H.position_count_flag(D.book(spark, sf), BY, 18, 20), exact=("positions", "in_range"))


@query("h07_validate_settings", """
WITH t AS (SELECT CASE WHEN o_orderkey % 40 = 0 THEN 'trial_same' ELSE 'trial_' || o_orderkey END AS trial,
  CASE WHEN o_custkey % 50 = 49 THEN 'NaN'::DOUBLE ELSE (o_custkey % 50) / 20.0 END AS gross, (o_custkey % 7) / 100.0 AS cap,
  CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_custkey % 9 = 8 THEN 'Infinity'::DOUBLE ELSE (o_custkey % 9) - 1 END END AS beta,
  (o_custkey % 30) / 2.0 AS months, CASE WHEN o_orderkey % 5 > 0 THEN (o_custkey % 6) / 100.0 END AS dear, (o_custkey % 8) / 6.0 AS scale FROM orders),
p AS (
  SELECT trial, 'gross_limit: above 0, at most 2' AS problem FROM t WHERE isnan(gross) OR NOT (gross > 0 AND gross <= 2)
  UNION ALL SELECT trial, 'position_limit: above 0, at most 0.05' FROM t WHERE NOT (cap > 0 AND cap <= 0.05)
  UNION ALL SELECT trial, 'minimum_position_weight: above 1e-6, at most position_limit' FROM t WHERE NOT (0.001 <= cap)
  UNION ALL SELECT trial, 'beta_limit: empty, or finite and not below 0' FROM t WHERE beta < 0 OR isinf(beta)
  UNION ALL SELECT trial, 'covariance_min_observations: from 2 to covariance_months' FROM t WHERE floor(months) <> months OR NOT (12 <= months)
  UNION ALL SELECT trial, 'expensive_long_cap: from minimum_position_weight to position_limit' FROM t WHERE NOT (dear >= 0.001 AND dear <= cap)
  UNION ALL SELECT trial, 'score_scale: above 0, at most 1' FROM t WHERE NOT (scale > 0 AND scale <= 1)
  UNION ALL SELECT trial, 'trial: a name of its own' FROM t WHERE trial IN (SELECT trial FROM t GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT trial, 'cannot be read: covariance_months' FROM t WHERE floor(months) <> months)
SELECT * FROM p""")
def validate_settings(spark, sf):
    orders = D.table(spark, sf, "orders")
    customer, order = F.col("o_custkey"), F.col("o_orderkey")

    def text(c):
        return c.cast("string")
    beta = F.when(customer % 9 == 8, "inf").otherwise(text(customer % 9 - 1))
    trials = orders.select(
        F.when(order % 40 == 0, "trial_same").otherwise(F.concat(F.lit("trial_"), text(order))).alias("trial"),
        F.when(customer % 50 == 49, "nan").otherwise(text(customer % 50 / 20.0)).alias("gross_limit"), text(customer % 7 / 100.0).alias("position_limit"),
        F.when(order % 3 == 0, "none").when(order % 3 == 2, beta).alias("beta_limit"), text(customer % 30 / 2.0).alias("covariance_months"),
        F.when(order % 5 > 0, text(customer % 6 / 100.0)).alias("expensive_long_cap"), text(customer % 8 / 6.0).alias("score_scale"))
    return J.validate_settings(J.resolve_settings(trials))


@query("h08_liquidity_report", with_(*TO_BOOK) + f"""
SELECT trial, {label('target_mi')} AS month, {r6('avg(CAST(abs(weight) > liquidity_limit + 1e-6 AS INTEGER))')} AS positions_over,
  {r6('coalesce(sum(abs(weight)) FILTER (abs(weight) > liquidity_limit + 1e-6), 0) / sum(abs(weight))')} AS gross_over,
  {r6('avg(CAST(liquidity_uncapped < minimum_position_weight AS INTEGER))')} AS cap_below_floor,
  {r6('avg(CAST(abs(abs(weight) - minimum_position_weight) <= 1e-6 AS INTEGER))')} AS at_floor FROM book GROUP BY trial, target_mi""")
def liquidity_report(spark, sf):
    return out(H.liquidity_report(D.book(spark, sf), BY), "positions_over", "gross_over", "cap_below_floor", "at_floor")
