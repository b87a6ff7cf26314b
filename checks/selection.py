"""Candidate selection."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import QUOTA, TO_BALANCED, TO_CANDIDATES, TO_SCORED, label, r6, selection, with_
from crossweave.functions.columns import month_label
from crossweave.operators import selection as E
from crossweave.operators import sizing as Z
from crossweave.sources import demo_tables as D


def labelled(df, *columns):
    return df.select(month_label("target_mi").alias("month"), *columns)


@query("e01_select_global", with_(*TO_CANDIDATES) + f"SELECT {label('target_mi')} AS month, permno, side, CAST(place AS INTEGER) AS place FROM candidates")
def select_global(spark, sf):
    return labelled(E.select_global(D.scored(spark, sf), D.LEG, 2.5, D.SHORT_MIN_ME), "permno", "side", "place")


@query("e02_sector_quota", with_(*TO_SCORED, QUOTA) + f"SELECT {label('target_mi')} AS month, sector, names, short_names, slots FROM quota")
def sector_quota(spark, sf):
    return labelled(E.sector_quota(D.scored(spark, sf), D.LEG, D.SHORT_MIN_ME), "sector", "names", "short_names", "slots")


@query("e03_select_sector_balanced", with_(*TO_BALANCED) + f"SELECT {label('target_mi')} AS month, permno, side FROM bcand")
def select_sector_balanced(spark, sf):
    return labelled(E.select_sector_balanced(D.scored(spark, sf), D.LEG, 2.5, D.SHORT_MIN_ME), "permno", "side")


@query("e04_select_asymmetric", with_(*TO_SCORED, selection(10, 15, True)) + f"""
SELECT {label('target_mi')} AS month, permno, side, CAST(place AS INTEGER) AS place FROM picks""")
def select_asymmetric(spark, sf):
    return labelled(E.select_asymmetric(D.scored(spark, sf), D.LEG, D.SHORT_LEG, 2.5, D.SHORT_MIN_ME), "permno", "side", "place")


NAIVE_SQL = """
, nv AS (SELECT *, row_number() OVER (PARTITION BY target_mi ORDER BY score DESC, permno) AS t,
  row_number() OVER (PARTITION BY target_mi ORDER BY score, permno DESC) AS b FROM scored),
naive AS (SELECT *, 1 AS side, t AS place FROM nv WHERE t <= 10 UNION ALL SELECT *, -1, b FROM nv WHERE b <= 10)
"""


@query("e05_select_naive", with_(*TO_SCORED) + NAIVE_SQL + f"SELECT {label('target_mi')} AS month, permno, side, CAST(place AS INTEGER) AS place FROM naive")
def select_naive(spark, sf):
    return labelled(E.select_naive(D.scored(spark, sf), D.LEG), "permno", "side", "place")


@query("e05_naive_long_short_return", with_(*TO_SCORED) + NAIVE_SQL + f"""
, w AS (SELECT *, side * 2.0 / count(*) OVER (PARTITION BY target_mi) AS weight FROM naive)
SELECT {label('w.target_mi')} AS month, count(*) AS names, {r6('sum(abs(weight))')} AS gross, {r6('sum(weight)')} AS net,
  {r6('sum(weight * coalesce(p.ret, 0))')} AS long_short_return
FROM w LEFT JOIN panel p ON p.permno = w.permno AND p.mi = w.target_mi GROUP BY w.target_mi""")
def naive_long_short_return(spark, sf):
    """Flagship: screen, rank, neutralise, smooth, pick, weight and account, in one query."""
    book = Z.equal_weight(E.select_naive(D.scored(spark, sf), D.LEG), ["target_mi"], F.lit(2.0))
    realised = D.panel(spark, sf).select("permno", F.col("mi").alias("target_mi"), "ret")
    return (book.join(realised, ["permno", "target_mi"], "left").groupBy(month_label("target_mi").alias("month")).agg(
        F.count(F.lit(1)).alias("names"), near(F.sum(F.abs("weight"))).alias("gross"), near(F.sum("weight")).alias("net"),
        near(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0)))).alias("long_short_return")))


@query("e06_check_legs", with_(*TO_CANDIDATES) + f"""
SELECT {label('target_mi')} AS month, count(*) FILTER (side > 0) AS longs, count(*) FILTER (side < 0) AS shorts,
  count(*) FILTER (abs(prc) < 2000) AS below_price, count(*) FILTER (size_grp IN ('nano', 'micro')) AS excluded_size,
  count(*) FILTER (side < 0 AND me < 200000) AS small_shorts, count(*) - count(DISTINCT permno) AS on_both_legs,
  count(*) FILTER (side > 0) = 10 AND count(*) FILTER (side < 0) = 10 AND count(*) FILTER (abs(prc) < 2000) = 0 AS passed
FROM candidates GROUP BY target_mi""")
def check_legs(spark, sf):
    out = E.check_legs(D.candidates(spark, sf), D.LEG, D.LEG, 2000.0, D.SHORT_MIN_ME)
    return labelled(out, "longs", "shorts", "below_price", "excluded_size", "small_shorts", "on_both_legs", "passed")
