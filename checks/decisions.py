"""Monthly sector inputs and decisions."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import TO_SCORED, label, r6, with_
from crossweave.functions.columns import month_label
from crossweave.operators import decisions as M
from crossweave.session import shared_stage
from crossweave.sources import demo_tables as D

SEED = 7
LABELS = "ABCDEF"

INPUTS = f"""si AS (
  SELECT s.target_mi, s.sector, count(*) / any_value(n) AS share, stddev_samp(forecast) AS disp
  FROM scored s JOIN (SELECT target_mi, count(*) AS n FROM scored GROUP BY 1) USING (target_mi) GROUP BY 1, 2),
sew AS (SELECT s.target_mi, s.sector, p.mi, avg(p.ret) AS ew FROM scored s JOIN panel p ON p.permno = s.permno AND p.mi BETWEEN s.target_mi - 3 AND s.target_mi - 1 GROUP BY 1, 2, 3),
sv AS (SELECT target_mi, sector, stddev_samp(ew) * sqrt(12) AS vol FROM sew GROUP BY 1, 2),
sl_ AS (SELECT si.*, vol FROM si LEFT JOIN sv USING (target_mi, sector)),
sk AS (SELECT sector, 'ABCDEFGHIJK'[row_number() OVER (ORDER BY md5('{SEED}:' || sector))] AS label FROM (SELECT DISTINCT sector FROM scored)),
mk AS (SELECT target_mi, printf('R%02d', row_number() OVER (ORDER BY md5('{SEED + 1}:' || target_mi))) AS ID FROM (SELECT DISTINCT target_mi FROM scored)),
wide AS (SELECT ID, {', '.join(f"round(max({c}) FILTER (label = '{x}'), 4) + 0.0 AS {x}_{c}" for x in LABELS for c in ('share', 'disp', 'vol'))}
  FROM sl_ JOIN sk USING (sector) JOIN mk USING (target_mi) GROUP BY 1),
dl AS (SELECT ID, list_filter([{', '.join(f'{x}_disp' for x in LABELS)}], lambda x: x IS NOT NULL) AS ds, [{', '.join(f'{x}_disp' for x in LABELS)}] AS da,
  list_filter([{', '.join(f'{x}_vol' for x in LABELS)}], lambda x: x IS NOT NULL) AS vs FROM wide),
dc AS (SELECT ID, list_max(ds) / list_median(ds) AS ratio, list_median(vs) AS v, '{LABELS}'[list_position(da, list_max(ds))] AS top FROM dl),
dec AS (SELECT ID, CASE WHEN v >= 0.25 THEN '1%' WHEN v <= 0.12 THEN '3%' ELSE '2%' END AS band, CASE WHEN ratio >= 2 THEN '1.5x' ELSE '1.25x' END AS cap, ratio, v, top FROM dc)"""


def long_inputs(spark, sf):
    return M.sector_inputs_long(D.scored(spark, sf), D.returns(spark, sf))


def keys(spark, sf):
    scored = D.scored(spark, sf)
    return M.sector_key(scored, SEED), M.month_key(scored, SEED + 1)


def wide(spark, sf):
    return shared_stage(spark, sf, "sector_inputs", lambda: M.sector_inputs(long_inputs(spark, sf), *keys(spark, sf), labels=LABELS))


@query("m01_sector_inputs_long", with_(*TO_SCORED, INPUTS) + f"""
SELECT {label('target_mi')} AS month, sector, {r6('share')} AS share, {r6('disp')} AS disp, {r6('vol')} AS vol FROM sl_""")
def sector_inputs_long(spark, sf):
    return long_inputs(spark, sf).select(month_label("target_mi").alias("month"), "sector", *[near(c).alias(c) for c in ("share", "disp", "vol")])


@query("m01_sector_inputs", with_(*TO_SCORED, INPUTS) + "SELECT * FROM wide")
def sector_inputs(spark, sf):
    return M.sector_inputs(long_inputs(spark, sf), *keys(spark, sf), labels=LABELS)


@query("m02_decide", with_(*TO_SCORED, INPUTS) + "SELECT ID, band, cap FROM dec")
def decide(spark, sf):
    return M.decide(wide(spark, sf), LABELS).select("ID", "band", "cap")


@query("m02_decide_reason", with_(*TO_SCORED, INPUTS) + """
SELECT ID, band, cap, printf('median sector vol %s (%s) -> band %s; ', coalesce(printf('%.2f', round(v + 3e-11, 2)), 'unknown'), CASE WHEN v >= 0.25 THEN 'high' WHEN v <= 0.12 THEN 'calm' ELSE 'normal' END, band)
  || CASE WHEN cap = '1.5x' THEN printf('sector %s dispersion %.1fx median, loosen cap', top, round(ratio + 3e-11, 1)) ELSE printf('dispersion spread %.1fx, tight cap', round(ratio + 3e-11, 1)) END AS reason
FROM dec""")
def decide_reason(spark, sf):
    return M.decide(wide(spark, sf), LABELS)


@query("m03_apply_schedule", with_(*TO_SCORED, INPUTS) + f"""
SELECT {label('target_mi')} AS month, CAST(rtrim(band, '%') AS DOUBLE) / 100 AS band, CAST(rtrim(cap, 'x') AS DOUBLE) AS cap FROM dec JOIN mk USING (ID)""")
def apply_schedule(spark, sf):
    return M.apply_schedule(M.decide(wide(spark, sf), LABELS), keys(spark, sf)[1]).select(month_label("target_mi").alias("month"), "band", "cap")
