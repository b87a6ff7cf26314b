"""Growth features of alternative series."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import PANEL, label, r6, unit_rank, with_
from crossweave.functions.columns import month_label
from crossweave.operators import altdata as N
from crossweave.session import shared_stage
from crossweave.sources import demo_tables as D

BY = ["dataset"]

FEATURES = """ser AS (SELECT permno, mi, unnest(['foot', 'card', 'web']) AS dataset, unnest([qty, disc_value, CAST(lines AS DOUBLE)]) AS value FROM panel),
s3 AS (SELECT *, CASE WHEN count(value) OVER q = 3 THEN sum(value) OVER q END AS sum3 FROM ser
  WINDOW q AS (PARTITION BY dataset, permno ORDER BY mi RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
gr AS (
  SELECT a.*, b.value AS v12, c.value AS v24, b.sum3 AS s12 FROM s3 a LEFT JOIN s3 b ON b.dataset = a.dataset AND b.permno = a.permno AND b.mi = a.mi - 12
    LEFT JOIN s3 c ON c.dataset = a.dataset AND c.permno = a.permno AND c.mi = a.mi - 24),
g1 AS (
  SELECT dataset, permno, mi, value, CASE WHEN value > 0 AND v12 > 0 THEN least(greatest(ln(value / v12), -2), 2) END AS yoy,
    CASE WHEN value > 0 AND v24 > 0 THEN least(greatest(ln(value / v24), -2), 2) END AS yoy2y,
    CASE WHEN sum3 > 0 AND s12 > 0 THEN least(greatest(ln(sum3 / s12), -2), 2) END AS yoy3 FROM gr),
feat AS (
  SELECT a.*, a.yoy3 - b.yoy3 AS accel, CASE WHEN count(a.yoy) OVER y >= 6 AND stddev_samp(a.yoy) OVER y > 0 THEN (a.yoy - avg(a.yoy) OVER y) / stddev_samp(a.yoy) OVER y END AS z
  FROM g1 a LEFT JOIN g1 b ON b.dataset = a.dataset AND b.permno = a.permno AND b.mi = a.mi - 3
  WINDOW y AS (PARTITION BY a.dataset, a.permno ORDER BY a.mi RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING))"""

# Days until a source's month is published.
LAGS = {"foot": 5, "card": 3, "web": 40}
USABLE = f"""us AS (SELECT *, CASE dataset {' '.join(f"WHEN '{k}' THEN {v}" for k, v in LAGS.items())} END AS lag_days FROM feat),
uf AS (SELECT *, year(d) * 12 + month(d) AS formation_mi FROM (
  SELECT *, last_day(make_date(CAST((mi - 1) // 12 AS BIGINT), CAST((mi - 1) % 12 + 1 AS BIGINT), CAST(1 AS BIGINT))) + CAST(lag_days AS INTEGER) AS d FROM us)),
av AS (SELECT * FROM uf QUALIFY row_number() OVER (PARTITION BY dataset, permno, formation_mi ORDER BY mi DESC) = 1)"""

RANKED = f"""rk0 AS (SELECT av.*, substr(p.gics, 1, 2) AS sector FROM av JOIN panel p ON p.permno = av.permno AND p.mi = av.formation_mi WHERE yoy3 IS NOT NULL AND p.gics IS NOT NULL),
rk AS (SELECT *, CASE WHEN count(*) OVER s > 1 THEN ({unit_rank('yoy3', 'dataset, formation_mi, sector')} - 1) / (count(*) OVER s - 1) - 0.5 ELSE 0 END AS rank
  FROM rk0 WINDOW s AS (PARTITION BY dataset, formation_mi, sector))"""


def features(spark, sf):
    return shared_stage(spark, sf, "growth_features", lambda: N.growth_features(D.alt_series(spark, sf), BY))


def usable(spark, sf):
    lags = F.create_map(*[F.lit(x) for pair in LAGS.items() for x in pair])
    return N.available_month(features(spark, sf).withColumn("lag_days", lags[F.col("dataset")]), "lag_days", BY)


def ranked(spark, sf):
    sector = D.panel(spark, sf).select("permno", F.col("mi").alias("formation_mi"), F.substring("gics", 1, 2).alias("sector"))
    rows = usable(spark, sf).join(sector, ["permno", "formation_mi"]).filter("yoy3 IS NOT NULL AND sector IS NOT NULL")
    return N.sector_percentile(rows, "yoy3", ["dataset", "formation_mi", "sector"])


@query("n01_available_month", with_(PANEL, FEATURES, USABLE) + f"SELECT dataset, permno, {label('mi')} AS data_month, {label('formation_mi')} AS formation_month FROM av")
def available_month(spark, sf):
    return usable(spark, sf).select("dataset", "permno", month_label("data_mi").alias("data_month"), month_label("formation_mi").alias("formation_month"))


GROWTH = ("yoy", "yoy3", "yoy2y")


@query("n02_growth", with_(PANEL, FEATURES) + f"SELECT dataset, permno, {label('mi')} AS month, {', '.join(f'{r6(c)} AS {c}' for c in GROWTH)} FROM feat")
def growth(spark, sf):
    return N.growth_features(D.alt_series(spark, sf), BY).select("dataset", "permno", month_label("mi").alias("month"), *[near(c).alias(c) for c in GROWTH])


@query("n03_accel", with_(PANEL, FEATURES) + f"SELECT dataset, permno, {label('mi')} AS month, {r6('accel')} AS accel FROM feat")
def accel(spark, sf):
    return features(spark, sf).select("dataset", "permno", month_label("mi").alias("month"), near("accel").alias("accel"))


@query("n04_growth_z", with_(PANEL, FEATURES) + f"SELECT dataset, permno, {label('mi')} AS month, {r6('z')} AS z FROM feat")
def growth_z(spark, sf):
    return features(spark, sf).select("dataset", "permno", month_label("mi").alias("month"), near("z").alias("z"))


@query("n05_sector_percentile", with_(PANEL, FEATURES, USABLE, RANKED) + f"SELECT dataset, permno, {label('formation_mi')} AS month, sector, {r6('rank')} AS rank FROM rk")
def sector_percentile(spark, sf):
    return ranked(spark, sf).select("dataset", "permno", month_label("formation_mi").alias("month"), "sector", near("rank").alias("rank"))


@query("n05_combined_score", with_(PANEL, FEATURES, USABLE, RANKED) + f"""
SELECT permno, {label('formation_mi')} AS month, {', '.join(f"round((max(rank) FILTER (dataset = '{d}')) + 3e-11, 6) + 0.0 AS {d}_rank" for d in LAGS)},
  {r6('avg(rank)')} AS ca_score, CAST(count(*) AS INTEGER) AS ca_n_sources FROM rk GROUP BY permno, formation_mi""")
def combined_score(spark, sf):
    c = N.combined_score(ranked(spark, sf), list(LAGS))
    return c.select("permno", month_label("formation_mi").alias("month"), *[near(f"{d}_rank").alias(f"{d}_rank") for d in LAGS],
                    near("ca_score").alias("ca_score"), "ca_n_sources")
