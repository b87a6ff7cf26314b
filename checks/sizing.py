"""Rule-based sizing and limit tables."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import (TO_BALANCED, TO_BOOK, TO_CANDIDATES, TO_SCORED, beta_matched, inverse_vol, label, r6, rank_tilt, with_)
from crossweave.functions.columns import month_label
from crossweave.operators import sizing as Z
from crossweave.sources import demo_tables as D

MONTH = ["target_mi"]
W_COLS = f"SELECT {label('target_mi')} AS month, permno, {r6('weight')} AS weight FROM "


def weights(df, *more):
    return df.select(month_label("target_mi").alias("month"), "permno", *more, near("weight").alias("weight"))


@query("f01_equal_weight", with_(*TO_CANDIDATES) + f"""
SELECT {label('target_mi')} AS month, permno, {r6('side * 2.0 / count(*) OVER (PARTITION BY target_mi)')} AS weight FROM candidates""")
def equal_weight(spark, sf):
    return weights(Z.equal_weight(D.candidates(spark, sf), MONTH, F.lit(2.0)))


@query("f02_capped_inverse_vol", with_(*TO_CANDIDATES, inverse_vol("iv", "candidates", "target_mi, side", "0.5", "0.07", "weight")) + W_COLS + "iv")
def capped_inverse_vol(spark, sf):
    return weights(Z.capped_inverse_vol(D.candidates(spark, sf), ["target_mi", "side"], F.lit(0.5), F.lit(0.07)))


@query("f03_beta_matched", with_(*TO_CANDIDATES) + """
, lim AS (SELECT *, 1.0 AS gross_limit, 0.08 AS position_limit, -0.1 AS net_min, 0.1 AS net_max FROM candidates),
""" + beta_matched("bm", "lim", "target_mi") + W_COLS + "bm")
def beta_matched_legs(spark, sf):
    return weights(Z.beta_matched(D.candidates(spark, sf), MONTH, F.lit(1.0), F.lit(0.08), F.lit(-0.1), F.lit(0.1)))


def tilt_sql(kind):
    return (with_(*TO_BALANCED) + ", lim AS (SELECT *, 0.75 AS gross_limit, 0.06 AS position_limit, 0.001 AS minimum_position_weight FROM bcand),\n"
            + rank_tilt("rt", "lim", "target_mi", kind) + W_COLS + "rt")


def tilt(spark, sf, kind):
    return weights(Z.rank_tilt(D.balanced_candidates(spark, sf), MONTH, kind, F.lit(0.75), F.lit(0.06), F.lit(0.001), strict=False))


@query("f04_rank_tilt_flat", tilt_sql("flat"))
def rank_tilt_flat(spark, sf):
    return tilt(spark, sf, "flat")


@query("f04_rank_tilt_linear", tilt_sql("linear"))
def rank_tilt_linear(spark, sf):
    return tilt(spark, sf, "linear")


@query("f04_rank_tilt_steep", tilt_sql("steep"))
def rank_tilt_steep(spark, sf):
    return tilt(spark, sf, "steep")


@query("f05_liquidity_cap", with_(*TO_SCORED) + f"""
SELECT {label('target_mi')} AS month, permno, {r6('least(greatest(3 * 0.1 * coalesce(dolvol_126d, 0) / 2e7, 0.001), 0.05)')} AS weight FROM scored""")
def liquidity_cap(spark, sf):
    cap = Z.liquidity_cap(F.lit(3.0), F.lit(0.1), F.lit(2e7), F.lit(0.001), F.lit(0.05))
    return weights(D.scored(spark, sf).withColumn("weight", cap))


@query("f06_expensive_flag", with_(*TO_SCORED) + f"SELECT {label('target_mi')} AS month, permno, coalesce(pe_pct, 0) > 0.7 AS expensive FROM scored")
def expensive_flag(spark, sf):
    return D.scored(spark, sf).select(month_label("target_mi").alias("month"), "permno", Z.expensive_flag(F.lit(0.7)).alias("expensive"))


@query("f07_sector_gross_limits", with_(*TO_SCORED) + f"""
SELECT {label('target_mi')} AS month, sector, {r6('count(*) / sum(count(*)) OVER (PARTITION BY target_mi)')} AS share,
  {r6('1.25 * (count(*) / sum(count(*)) OVER (PARTITION BY target_mi)) * 2.0')} AS gross_limit FROM scored GROUP BY target_mi, sector""")
def sector_gross_limits(spark, sf):
    out = Z.sector_gross_limits(D.scored(spark, sf), F.lit(1.25), F.lit(2.0))
    return out.select(month_label("target_mi").alias("month"), "sector", near("share").alias("share"), near("gross_limit").alias("gross_limit"))


def balance_sql(value):
    return with_(*TO_BOOK) + f"""
, s AS (SELECT trial, target_mi, sector, coalesce(sum({value}) FILTER (weight > 0), 0) AS l, coalesce(-sum({value}) FILTER (weight < 0), 0) AS s,
  bool_or(weight > 0) AS hl, bool_or(weight < 0) AS hs FROM book GROUP BY 1, 2, 3)
SELECT trial, {label('target_mi')} AS month, permno, {r6('''weight * CASE WHEN NOT hl OR NOT hs THEN 0 WHEN abs(l - s) <= 1e-9 THEN 1
  WHEN l > s AND weight > 0 THEN s / l WHEN s > l AND weight < 0 THEN l / s ELSE 1 END''')} AS weight
FROM book JOIN s USING (trial, target_mi, sector)"""


@query("f08_balance_sectors", balance_sql("weight"))
def balance_sectors(spark, sf):
    return weights(Z.balance_sectors(D.book(spark, sf), ["trial", "target_mi"]), "trial")


@query("f08_balance_sectors_risk", balance_sql("weight * beta_use"))
def balance_sectors_risk(spark, sf):
    return weights(Z.balance_sectors(D.book(spark, sf), ["trial", "target_mi"], "beta_use"), "trial")


@query("f09_side_limits", with_(*TO_CANDIDATES) + f"""
SELECT {label('target_mi')} AS month, permno, {r6('CASE WHEN side > 0 THEN CAST(0.05 AS DOUBLE) ELSE 0 END')} AS long_limit,
  {r6('CASE WHEN side < 0 THEN CAST(0.03 AS DOUBLE) ELSE 0 END')} AS short_limit FROM candidates""")
def side_limits(spark, sf):
    long, short = Z.side_limits(F.lit(0.05), F.lit(0.03))
    return D.candidates(spark, sf).select(month_label("target_mi").alias("month"), "permno", long.alias("long_limit"), short.alias("short_limit"))
