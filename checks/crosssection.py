"""Cross-sectional and trailing transforms."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import PANEL, TO_SCORED, TO_UNIVERSE, label, r6, unit_rank, with_
from crossweave.functions.columns import month_label
from crossweave.operators import crosssection as X
from crossweave.sources import demo_tables as D

FEATURES = list(D.CHARACTERISTICS)


def monthly(df, mi="target_mi"):
    return df.withColumn("month", month_label(mi))


RANKED_SQL = with_(PANEL) + f"""
, long AS (
  SELECT permno, month, unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS feature,
    unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in FEATURES)}]) AS value FROM panel),
r AS (SELECT *, dense_rank() OVER (PARTITION BY month, feature ORDER BY value) AS dr FROM long WHERE value IS NOT NULL),
t AS (SELECT *, max(dr) OVER (PARTITION BY month, feature) AS top FROM r)
"""


@query("c01_rank_keep_missing", RANKED_SQL + f"""
SELECT l.permno, l.month, l.feature, {r6('CASE WHEN t.top > 1 THEN (t.dr - 1) / (t.top - 1) * 2 - 1 END')} AS ranked
FROM long l LEFT JOIN t ON t.permno = l.permno AND t.month = l.month AND t.feature = l.feature""")
def rank_keep_missing(spark, sf):
    ranked = X.rank_keep_missing_long(D.panel(spark, sf), FEATURES, "mi")
    return ranked.select("permno", month_label("mi").alias("month"), "feature", near("ranked").alias("ranked"))


@query("c01_rank_keep_missing_wide", RANKED_SQL + f"""
SELECT l.permno, l.month, {r6("max(CASE WHEN l.feature = 'ret_12_1' AND t.top > 1 THEN (t.dr - 1) / (t.top - 1) * 2 - 1 END)")} AS ret_12_1,
  {r6("max(CASE WHEN l.feature = 'disc_top' AND t.top > 1 THEN (t.dr - 1) / (t.top - 1) * 2 - 1 END)")} AS disc_top
FROM long l LEFT JOIN t ON t.permno = l.permno AND t.month = l.month AND t.feature = l.feature GROUP BY 1, 2""")
def rank_keep_missing_wide(spark, sf):
    wide = X.rank_keep_missing(D.panel(spark, sf), ["ret_12_1", "disc_top"], "mi")
    return wide.select("permno", month_label("mi").alias("month"), near("ret_12_1").alias("ret_12_1"),
                       near("disc_top").alias("disc_top"))


@query("c02_demean_and_clip", with_(PANEL) + f"""
, d AS (SELECT permno, month, ret_exc_lead1m - avg(ret_exc_lead1m) OVER (PARTITION BY month) AS y FROM panel WHERE ret_exc_lead1m IS NOT NULL),
s AS (SELECT stddev_pop(y) AS sd FROM d)
SELECT permno, month, {r6('least(greatest(y, -2 * sd), 2 * sd)')} AS target FROM d, s""")
def demean_and_clip(spark, sf):
    known = D.panel(spark, sf).filter("ret_exc_lead1m IS NOT NULL")
    out = X.demean_and_clip(known, "ret_exc_lead1m", "mi", clip_sd=2.0)
    return out.select("permno", "month", near("target").alias("target"))


@query("c03_unit_rank", with_(*TO_SCORED) + f"SELECT permno, {label('target_mi')} AS month, {r6('signal')} AS signal FROM scored")
def unit_rank_query(spark, sf):
    out = X.unit_rank(D.universe(spark, sf), "forecast", ["target_mi"], "signal")
    return monthly(out).select("permno", "month", near("signal").alias("signal"))


@query("c04_blend", with_(*TO_SCORED) + f"""
, a AS (SELECT *, CASE WHEN pe_pct IS NOT NULL THEN rank() OVER (PARTITION BY target_mi, pe_pct IS NULL ORDER BY pe_pct)
    + (count(*) OVER (PARTITION BY target_mi, pe_pct) - 1) / 2.0 END AS rp FROM scored),
b AS (SELECT *, coalesce((rp - avg(rp) OVER m) / coalesce(nullif(stddev_pop(rp) OVER m, 0), 1), 0) AS zp FROM a WINDOW m AS (PARTITION BY target_mi))
SELECT permno, {label('target_mi')} AS month, {r6('0.9 * signal + 0.1 * zp')} AS signal FROM b""")
def blend(spark, sf):
    out = X.blend(D.universe(spark, sf), "forecast", ["target_mi"], {"pe_pct": 0.1}, 0.9)
    return monthly(out).select("permno", "month", near("signal").alias("signal"))


@query("c05_neutralise", with_(*TO_SCORED) + f"SELECT permno, {label('target_mi')} AS month, sector, {r6('residual')} AS residual FROM scored")
def neutralise(spark, sf):
    return monthly(D.scored(spark, sf)).select("permno", "month", "sector", near("residual").alias("residual"))


@query("c06_size_exposure", with_(*TO_SCORED) + f"SELECT permno, {label('target_mi')} AS month, {r6('size')} AS size FROM scored")
def size_exposure(spark, sf):
    out = X.unit_rank(D.universe(spark, sf), "me", ["target_mi"], "size")
    return monthly(out).select("permno", "month", near("size").alias("size"))


@query("c07_smooth", with_(*TO_SCORED) + f"SELECT permno, {label('target_mi')} AS month, {r6('score')} AS score FROM scored")
def smooth(spark, sf):
    return monthly(X.smooth(D.scored(spark, sf).drop("score"), "residual", 3, out="score")).select(
        "permno", "month", near("score").alias("score"))


@query("c08_trailing_percentile", with_(*TO_UNIVERSE) + f"SELECT permno, {label('mi')} AS month, {r6('pe_pct')} AS pe_pct FROM pe")
def trailing_percentile(spark, sf):
    out = X.trailing_percentile(D.panel(spark, sf).select("permno", "mi", "ni_me"), "ni_me")
    return monthly(out, "mi").select("permno", "month", near("pe_pct").alias("pe_pct"))


@query("c09_sector_rank_z", with_(*TO_UNIVERSE) + f"""
, r AS (SELECT *, {unit_rank('forecast', 'target_mi, sector')} AS rk FROM universe)
SELECT permno, {label('target_mi')} AS month, sector,
  {r6('(rk - avg(rk) OVER s) / nullif(stddev_pop(rk) OVER s, 0)')} AS z FROM r WINDOW s AS (PARTITION BY target_mi, sector)""")
def sector_rank_z(spark, sf):
    out = X.sector_rank_z(D.universe(spark, sf), "forecast", "target_mi", "sector", "z")
    return monthly(out).select("permno", "month", "sector", near("z").alias("z"))


@query("c10_quantile_bins", with_(*TO_SCORED) + f"""
, r AS (SELECT permno, target_mi, row_number() OVER (PARTITION BY target_mi ORDER BY score, permno) AS rk,
  count(*) OVER (PARTITION BY target_mi) AS n FROM scored)
SELECT permno, {label('target_mi')} AS month,
  CAST(greatest(1, ceil(10 * (rk - 1) / greatest(n - 1, 1))) AS INTEGER) AS decile FROM r""")
def quantile_bins(spark, sf):
    return monthly(X.quantile_bins(D.scored(spark, sf), "score", "target_mi")).select("permno", "month", "decile")


@query("c11_top_bottom_n", with_(*TO_SCORED) + f"""
, a AS (SELECT permno, target_mi, score, row_number() OVER (PARTITION BY target_mi ORDER BY score DESC, permno) AS t,
  row_number() OVER (PARTITION BY target_mi ORDER BY score, permno) AS b FROM scored)
SELECT permno, {label('target_mi')} AS month, 'top' AS side, t AS position FROM a WHERE t <= 10
UNION ALL SELECT permno, {label('target_mi')}, 'bottom', b FROM a WHERE b <= 10""")
def top_bottom_n(spark, sf):
    scored = D.scored(spark, sf)
    top = X.top_n(scored, "score", 10, ["target_mi"]).withColumn("side", F.lit("top"))
    bottom = X.top_n(scored, "score", 10, ["target_mi"], largest=False).withColumn("side", F.lit("bottom"))
    return monthly(top.unionByName(bottom)).select("permno", "month", "side", "position")


@query("c12_alpha_forms", with_(*TO_SCORED) + f"""
SELECT permno, {label('target_mi')} AS month, {r6('12 * 0.03 * rvol_21d * score / stddev_samp(score) OVER m')} AS alpha_ic,
  {r6('12 * (forecast - avg(forecast) OVER m)')} AS alpha_forecast,
  {r6('12 * score / stddev_samp(score) OVER m * stddev_samp(forecast) OVER m')} AS alpha_score
FROM scored WINDOW m AS (PARTITION BY target_mi)""")
def alpha_forms(spark, sf):
    out = monthly(X.alpha_forms(D.scored(spark, sf), "target_mi", vol="rvol_21d"))
    return out.select("permno", "month", *[near(c).alias(c) for c in ("alpha_ic", "alpha_forecast", "alpha_score")])


