"""Risk estimates."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import PANEL, TO_BOOK, label, r6, with_
from crossweave.functions.columns import month_label
from crossweave.operators import accounting as A
from crossweave.operators import prep as P
from crossweave.operators import risk as R
from crossweave.session import shared_stage
from crossweave.sources import demo_tables as D

SETS = """sets AS (SELECT DISTINCT 'global' AS schedule, target_mi, permno, rvol_21d FROM candidates
  UNION ALL SELECT DISTINCT 'balanced', target_mi, permno, rvol_21d FROM bcand)"""

MOM = f"""{SETS},
hh AS (SELECT c.schedule, c.target_mi, c.permno, any_value(c.rvol_21d) AS vol, count(p.ret) AS observations, avg(p.ret) AS mean, stddev_pop(p.ret) AS ssd
  FROM sets c LEFT JOIN panel p ON p.permno = c.permno AND p.mi BETWEEN c.target_mi - 36 AND c.target_mi - 1 GROUP BY 1, 2, 3),
mom AS (SELECT schedule, target_mi, permno, observations, mean, observations >= 12 AND coalesce(ssd, 0) > 1e-8 AS reliable,
  greatest(CASE WHEN observations >= 12 AND coalesce(ssd, 0) > 1e-8 THEN ssd ELSE vol * sqrt(21) END, 1e-4) AS sd,
  least(36, target_mi - (SELECT min(mi) FROM panel)) AS periods FROM hh),
z AS (SELECT m.schedule, m.target_mi, m.permno, p.mi, (p.ret - m.mean) / m.sd AS z FROM mom m JOIN panel p
  ON p.permno = m.permno AND p.mi BETWEEN m.target_mi - 36 AND m.target_mi - 1 WHERE m.reliable AND p.ret IS NOT NULL)"""

LW = """gram AS (SELECT a.schedule, a.target_mi, a.mi AS s, b.mi AS t, sum(a.z * b.z) AS g FROM z a JOIN z b
  ON a.schedule = b.schedule AND a.target_mi = b.target_mi AND a.permno = b.permno GROUP BY 1, 2, 3, 4),
gs AS (SELECT schedule, target_mi, sum(CASE WHEN s = t THEN g ELSE 0 END) AS tr, sum(CASE WHEN s = t THEN g * g ELSE 0 END) AS quart, sum(g * g) AS fro FROM gram GROUP BY 1, 2),
sz AS (SELECT schedule, target_mi, count(*) AS n, max(periods) AS t FROM mom GROUP BY 1, 2),
l1 AS (SELECT schedule, target_mi, n, t, tr / t AS tr, (fro / (t * t) - (tr / t) ** 2 / n) / n AS d, (quart / t - fro / (t * t)) / (n * t) AS b FROM sz LEFT JOIN gs USING (schedule, target_mi)),
lw AS (SELECT schedule, target_mi, n AS names, t AS periods, CASE WHEN least(b, d) > 0 AND d > 0 THEN least(b, d) / d ELSE 0 END AS delta, coalesce(tr / n, 0) AS mu FROM l1),
fac AS (
  SELECT m.*, l.delta, l.mu, CASE WHEN reliable THEN sd / sqrt(greatest((1 - delta) * coalesce(zz, 0) / m.periods + delta * mu, 1e-12)) ELSE 0 END AS a,
    CASE WHEN reliable THEN 0 ELSE sd END AS sd_unrel
  FROM mom m JOIN lw l USING (schedule, target_mi) LEFT JOIN (SELECT schedule, target_mi, permno, sum(z * z) AS zz FROM z GROUP BY 1, 2, 3) USING (schedule, target_mi, permno)),
pv AS (
  SELECT b.trial, b.target_mi, max(delta) AS delta, max(mu) AS mu, max(periods) AS t, sum((a * weight) ** 2) AS aa, sum((sd_unrel * weight) ** 2) AS uu, sum(weight ** 2) AS ww
  FROM book b JOIN fac USING (schedule, target_mi, permno) GROUP BY 1, 2),
pf AS (SELECT trial, target_mi, sum(f * f) AS ff FROM (
  SELECT b.trial, b.target_mi, z.mi, sum(z.z * a * weight) AS f FROM book b JOIN fac USING (schedule, target_mi, permno) JOIN z USING (schedule, target_mi, permno)
  GROUP BY 1, 2, 3) GROUP BY 1, 2),
var AS (SELECT trial, target_mi, (1 - delta) / t * coalesce(ff, 0) + delta * mu * aa + uu + 1e-10 * ww AS variance FROM pv LEFT JOIN pf USING (trial, target_mi))"""

TO_SETS = (*TO_BOOK, MOM)
TO_RISK = (*TO_SETS, LW)

# Each schedule is a set of names of its own: its books are measured with the covariance of its own names.
SCHEDULES = ("global", "balanced")


def month(df, *columns, exact=()):
    return df.select(month_label("target_mi").alias("month"), *exact, *[near(c).alias(c) for c in columns])


def per_schedule(make):
    """make(schedule) for both schedules, side by side."""
    first, second = (make(s).withColumn("schedule", F.lit(s)) for s in SCHEDULES)
    return first.unionByName(second)


def targets(spark, sf, schedule):
    names = D.candidates(spark, sf) if schedule == "global" else D.balanced_candidates(spark, sf)
    return names.select("target_mi", "permno", "rvol_21d").distinct()


def moments(spark, sf, schedule):
    return shared_stage(spark, sf, f"moments_{schedule}", lambda: R.trailing_moments(D.returns(spark, sf), targets(spark, sf, schedule)))


def history_z(spark, sf, schedule):
    return shared_stage(spark, sf, f"history_z_{schedule}", lambda: R.standardised_history(D.returns(spark, sf), moments(spark, sf, schedule)))


def factors(spark, sf, schedule):
    m, z = moments(spark, sf, schedule), history_z(spark, sf, schedule)
    return R.name_factors(m, z, shared_stage(spark, sf, f"shrink_{schedule}", lambda: R.shrinkage_intensity(m, z)))


def books(spark, sf, schedule):
    return D.book(spark, sf).filter(F.col("schedule") == schedule)


def book_variance(spark, sf):
    """Variance of every trial's book each month."""
    return per_schedule(lambda s: R.portfolio_variance(books(spark, sf, s), factors(spark, sf, s), history_z(spark, sf, s), ["trial"])).drop("schedule")


@query("g01_trailing_moments", with_(*TO_SETS) + f"""
SELECT schedule, {label('target_mi')} AS month, permno, observations, reliable, {r6('mean')} AS mean, {r6('sd')} AS sd FROM mom""")
def trailing_moments(spark, sf):
    m = per_schedule(lambda s: R.trailing_moments(D.returns(spark, sf), targets(spark, sf, s)))
    return month(m, "mean", "sd", exact=("schedule", "permno", "observations", "reliable"))


@query("g02_standardised_history", with_(*TO_SETS) + f"""
SELECT schedule, {label('target_mi')} AS month, permno, {label('mi')} AS history_month, {r6('z')} AS z FROM z""")
def standardised_history(spark, sf):
    z = per_schedule(lambda s: R.standardised_history(D.returns(spark, sf), moments(spark, sf, s)))
    return month(z, "z", exact=("schedule", "permno", month_label("mi").alias("history_month")))


@query("g03_shrinkage_intensity", with_(*TO_RISK) + f"""
SELECT schedule, {label('target_mi')} AS month, names, CAST(periods AS INTEGER) AS periods, {r6('delta')} AS delta, {r6('mu')} AS mu FROM lw""")
def shrinkage_intensity(spark, sf):
    lw = per_schedule(lambda s: R.shrinkage_intensity(moments(spark, sf, s), history_z(spark, sf, s)))
    return month(lw, "delta", "mu", exact=("schedule", "names", "periods"))


@query("g04_portfolio_variance", with_(*TO_RISK) + f"SELECT trial, {label('target_mi')} AS month, {r6('sqrt(variance)')} AS monthly_vol FROM var")
def portfolio_variance(spark, sf):
    return month(book_variance(spark, sf).withColumn("monthly_vol", F.sqrt("variance")), "monthly_vol", exact=("trial",))


@query("g05_covariance_times_weights", with_(*TO_RISK) + f"""
, held AS MATERIALIZED (SELECT trial, schedule, target_mi, permno, weight FROM book),
facm AS MATERIALIZED (SELECT * FROM fac),
zb AS MATERIALIZED (SELECT h.trial, h.target_mi, h.permno, z.mi, z.z * f.a AS za, z.z * f.a * h.weight AS part FROM held h
  JOIN facm f ON f.schedule = h.schedule AND f.target_mi = h.target_mi AND f.permno = h.permno
  JOIN z ON z.schedule = h.schedule AND z.target_mi = h.target_mi AND z.permno = h.permno),
path AS MATERIALIZED (SELECT trial, target_mi, mi, sum(part) AS f FROM zb GROUP BY 1, 2, 3),
bf AS (SELECT zb.trial, zb.target_mi, zb.permno, sum(zb.za * p.f) AS bf FROM zb JOIN path p ON p.trial = zb.trial AND p.target_mi = zb.target_mi AND p.mi = zb.mi GROUP BY 1, 2, 3)
SELECT b.trial, {label('b.target_mi')} AS month, b.permno, {r6('1000 * (sd * sd + 1e-10)')} AS variance,
  {r6('1000 * ((1 - delta) / periods * coalesce(bf, 0) + ((CASE WHEN reliable THEN delta * mu * a * a ELSE sd_unrel ** 2 END) + 1e-10) * weight)')} AS covariance_with_book
FROM held b JOIN facm USING (schedule, target_mi, permno) LEFT JOIN bf ON bf.trial = b.trial AND bf.target_mi = b.target_mi AND bf.permno = b.permno""")
def covariance_times_weights(spark, sf):
    c = per_schedule(lambda s: R.covariance_times_weights(books(spark, sf, s), factors(spark, sf, s), history_z(spark, sf, s), ["trial"]))
    c = c.withColumn("variance", 1000 * F.col("variance")).withColumn("covariance_with_book", 1000 * F.col("covariance_with_book"))
    return month(c, "variance", "covariance_with_book", exact=("trial", "permno"))


DAILY = """dcell AS (SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS unit FROM lineitem GROUP BY 1, 2),
dret AS (SELECT permno, date, CASE WHEN lag(unit) OVER (PARTITION BY permno ORDER BY date) IS NOT NULL
  THEN 0.2 * least(greatest(unit / lag(unit) OVER (PARTITION BY permno ORDER BY date) - 1, -0.5), 0.5) END AS r FROM dcell),
daily AS (SELECT permno, date, r, year(date) * 12 + month(date) AS dmi FROM dret WHERE r IS NOT NULL)"""

DRISK = """dh AS (SELECT c.schedule, c.target_mi, c.permno, any_value(c.rvol_21d) AS vol, count(d.r) AS observations, avg(d.r) AS mean, stddev_pop(d.r) AS ssd
  FROM sets c LEFT JOIN daily d ON d.permno = c.permno AND d.dmi BETWEEN c.target_mi - 36 AND c.target_mi - 1 GROUP BY 1, 2, 3),
dn AS (SELECT t.target_mi, count(DISTINCT d.date) AS periods FROM (SELECT DISTINCT target_mi FROM sets) t LEFT JOIN daily d ON d.dmi BETWEEN t.target_mi - 36 AND t.target_mi - 1 GROUP BY 1),
dmom AS (SELECT dh.*, periods, observations >= 40 AND coalesce(ssd, 0) > 1e-8 AS reliable,
  greatest(CASE WHEN observations >= 40 AND coalesce(ssd, 0) > 1e-8 THEN ssd ELSE vol END, 1e-5) AS sd FROM dh JOIN dn USING (target_mi)),
dz AS (SELECT m.schedule, m.target_mi, m.permno, d.date, (d.r - m.mean) / m.sd AS z FROM dmom m JOIN daily d ON d.permno = m.permno AND d.dmi BETWEEN m.target_mi - 36 AND m.target_mi - 1 WHERE reliable),
dg AS (SELECT a.schedule, a.target_mi, sum(a.z * b.z) AS g FROM dz a JOIN dz b ON a.schedule = b.schedule AND a.target_mi = b.target_mi AND a.date = b.date GROUP BY a.schedule, a.target_mi, a.permno, b.permno),
df AS (SELECT schedule, target_mi, sum(g * g) AS fro FROM dg GROUP BY 1, 2),
dq AS (SELECT schedule, target_mi, sum(q) AS tr, sum(q * q) AS quart FROM (SELECT schedule, target_mi, date, sum(z * z) AS q FROM dz GROUP BY 1, 2, 3) GROUP BY 1, 2),
ds AS (SELECT schedule, target_mi, count(*) AS n, nullif(max(periods), 0) AS t FROM dmom GROUP BY 1, 2),
d1 AS (SELECT schedule, target_mi, n, t, tr / t AS tr, (fro / (t * t) - (tr / t) ** 2 / n) / n AS d, (quart / t - fro / (t * t)) / (n * t) AS b
  FROM ds LEFT JOIN df USING (schedule, target_mi) LEFT JOIN dq USING (schedule, target_mi)),
dlw AS (SELECT schedule, target_mi, n AS names, CAST(t AS BIGINT) AS periods, CASE WHEN least(b, d) > 0 AND d > 0 THEN least(b, d) / d ELSE 0 END AS delta, coalesce(tr / n, 0) AS mu FROM d1),
dfac AS (SELECT m.schedule, m.target_mi, m.permno, nullif(m.periods, 0) AS periods, l.delta, l.mu,
    CASE WHEN reliable THEN sd / sqrt(greatest((1 - delta) * coalesce(zz, 0) / m.periods + delta * mu, 1e-12)) ELSE 0 END AS a,
    CASE WHEN reliable THEN 0 ELSE sd END AS sd_unrel
  FROM dmom m JOIN dlw l USING (schedule, target_mi) LEFT JOIN (SELECT schedule, target_mi, permno, sum(z * z) AS zz FROM dz GROUP BY 1, 2, 3) USING (schedule, target_mi, permno)),
dpv AS (SELECT b.trial, b.schedule, b.target_mi, max(delta) AS delta, max(mu) AS mu, max(periods) AS t, sum((a * weight) ** 2) AS aa, sum((sd_unrel * weight) ** 2) AS uu, sum(weight ** 2) AS ww
  FROM book b JOIN dfac USING (schedule, target_mi, permno) GROUP BY 1, 2, 3),
dpf AS (SELECT trial, target_mi, sum(f * f) AS ff FROM (SELECT b.trial, b.target_mi, dz.date, sum(dz.z * a * weight) AS f FROM book b JOIN dfac USING (schedule, target_mi, permno)
  JOIN dz USING (schedule, target_mi, permno) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("g06_daily_risk", with_(*TO_BOOK, SETS, DAILY, DRISK) + f"""
SELECT trial, {label('target_mi')} AS month, {r6('dlw.delta')} AS delta, {r6('dlw.mu')} AS mu,
  {r6('sqrt(21 * (coalesce((1 - dpv.delta) / t * ff, 0) + dpv.delta * dpv.mu * aa + uu) + 1e-10 * ww)')} AS monthly_vol
FROM dlw JOIN dpv USING (schedule, target_mi) LEFT JOIN dpf USING (trial, target_mi)""")
def daily_risk(spark, sf):
    def one(schedule):
        m, z = R.daily_moments(D.daily(spark, sf), targets(spark, sf, schedule), minimum=40)
        m, z = shared_stage(spark, sf, f"daily_moments_{schedule}", lambda: m), shared_stage(spark, sf, f"daily_z_{schedule}", lambda: z)
        lw = shared_stage(spark, sf, f"daily_lw_{schedule}", lambda: R.daily_shrinkage(m, z))
        v = R.portfolio_variance(books(spark, sf, schedule), R.name_factors(m, z, lw), z, ["trial"], scale=21.0)
        return lw.join(v, "target_mi")
    return month(per_schedule(one).withColumn("monthly_vol", F.sqrt("variance")), "delta", "mu", "monthly_vol", exact=("trial",))


@query("g07_risk_audit", with_(*TO_SETS) + f"""
SELECT schedule, {label('target_mi')} AS month, {label('greatest(target_mi - 36, (SELECT min(mi) FROM panel))')} AS history_start, {label('(target_mi - 1)')} AS history_end,
  CAST(max(periods) AS INTEGER) AS history_months, count(*) FILTER (NOT reliable) AS fallback_vol_stocks,
  {r6('1 - sum(observations) / (count(*) * max(periods))')} AS missing_history_fraction FROM mom GROUP BY schedule, target_mi""")
def risk_audit(spark, sf):
    a = per_schedule(lambda s: R.risk_audit(D.returns(spark, sf), targets(spark, sf, s), moments(spark, sf, s)))
    return month(a, "missing_history_fraction", exact=("schedule", month_label("history_start").alias("history_start"), month_label("history_end").alias("history_end"),
                                                       "history_months", "fallback_vol_stocks"))


@query("g08_dimson_beta", with_(PANEL, DAILY) + f"""
, grp AS (SELECT DISTINCT permno, coalesce(substr(gics, 1, 2), 'na') AS sector FROM panel),
days AS (SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM daily)),
rows_ AS (SELECT d.permno, g.sector, n.di, d.r FROM daily d JOIN grp g USING (permno) JOIN days n USING (date)),
mk AS (SELECT sector, di, avg(r) AS m FROM rows_ GROUP BY 1, 2),
us AS (SELECT r.permno, r.di, r.r AS y, a.m AS m0, b.m AS m1 FROM rows_ r JOIN mk a ON a.sector = r.sector AND a.di = r.di JOIN mk b ON b.sector = r.sector AND b.di = r.di - 1),
fm AS (SELECT year(date) * 12 + month(date) AS mi, min(di) AS di FROM days JOIN (SELECT date FROM days) USING (date) GROUP BY 1),
ff AS (SELECT p.permno, p.mi, fm.di FROM panel p JOIN fm USING (mi)),
s AS (SELECT f.permno, f.mi, count(u.y) AS n, count(u.y) * var_pop(m0) AS s11, count(u.y) * covar_pop(m0, m1) AS s12, count(u.y) * var_pop(m1) AS s22,
    count(u.y) * covar_pop(m0, y) AS s1y, count(u.y) * covar_pop(m1, y) AS s2y
  FROM ff f LEFT JOIN us u ON u.permno = f.permno AND u.di BETWEEN f.di - 251 AND f.di - 1 GROUP BY 1, 2)
SELECT permno, {label('mi')} AS month, n AS days, {r6('''CASE WHEN n >= 40 THEN least(greatest(
  ((s22*s1y - s12*s2y) + (s11*s2y - s12*s1y)) / (s11*s22 - s12*s12), 0.3), 3.0) ELSE 1.0 END''')} AS sector_beta FROM s""")
def dimson_beta(spark, sf):
    daily = D.daily(spark, sf)
    groups = D.panel(spark, sf).select("permno", P.sector_code().alias("sector")).distinct()
    first = R.number_days(daily).groupBy((F.year("date") * 12 + F.month("date")).alias("mi")).agg(F.min("di").alias("di"))
    formations = D.panel(spark, sf).select("permno", "mi").join(first, "mi")
    b = R.dimson_beta(daily, groups, formations, minimum=40).join(first, "di")
    return b.select("permno", month_label("mi").alias("month"), "days", near("sector_beta").alias("sector_beta"))


@query("g09_exposures", with_(*TO_BOOK) + f"""
, sx AS (SELECT trial, target_mi, sector, sum(weight) AS sn FROM book GROUP BY 1, 2, 3)
SELECT b.trial, {label('b.target_mi')} AS month, {r6('sum(abs(weight))')} AS gross, {r6('sum(weight)')} AS net, {r6('sum(weight * beta_use)')} AS market_beta,
  {r6('sum(weight * size)')} AS size_exposure, {r6('(SELECT max(abs(sn)) FROM sx WHERE sx.trial = b.trial AND sx.target_mi = b.target_mi)')} AS max_sector_net
FROM book b GROUP BY b.trial, b.target_mi""")
def exposures(spark, sf):
    return month(A.exposures(D.book(spark, sf), ["trial"]), "gross", "net", "market_beta", "size_exposure", "max_sector_net", exact=("trial",))
