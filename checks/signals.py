"""Signal research."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import FORECASTS, JOINED, PANEL, TO_SCORED, label, r6, unit_rank, with_
from crossweave.functions.columns import month_label
from crossweave.operators import crosssection as X
from crossweave.operators import prep as P
from crossweave.operators import signals as K
from crossweave.session import shared_stage, stage
from crossweave.sources import demo_tables as D

RESID = """rr AS (SELECT s.permno, s.target_mi, s.sector, s.score, s.size, s.beta_use, p.ret AS r FROM scored s JOIN panel p ON p.permno = s.permno AND p.mi = s.target_mi WHERE p.ret IS NOT NULL),
rd AS (SELECT *, r - avg(r) OVER s AS dy, size - avg(size) OVER s AS d1, beta_use - avg(beta_use) OVER s AS d2 FROM rr WINDOW s AS (PARTITION BY target_mi, sector)),
rn AS (SELECT target_mi, sum(d1*d1) AS s11, sum(d1*d2) AS s12, sum(d2*d2) AS s22, sum(d1*dy) AS s1y, sum(d2*dy) AS s2y FROM rd GROUP BY 1),
ra AS (SELECT rd.*, round(dy - (s22*s1y - s12*s2y)/(s11*s22 - s12*s12)*d1 - (s11*s2y - s12*s1y)/(s11*s22 - s12*s12)*d2, 10) AS alpha FROM rd JOIN rn USING (target_mi))"""


def spearman(src, a, b, part, name):
    return f"""{name}_r AS (SELECT *, {unit_rank(a, part)} AS qa, {unit_rank(b, part)} AS qb FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
{name} AS (SELECT {part}, CASE WHEN var_pop(qa) > 0 AND var_pop(qb) > 0 THEN corr(qa, qb) END AS c, count(*) AS n FROM {name}_r GROUP BY {part})"""


CHECK = f"""{RESID},
{spearman('ra', 'score', 'r', 'target_mi', 'icr')},
{spearman('ra', 'score', 'alpha', 'target_mi', 'ica')},
eg AS (SELECT *, row_number() OVER (PARTITION BY target_mi ORDER BY score DESC, permno) AS t, row_number() OVER (PARTITION BY target_mi ORDER BY score, permno) AS b FROM ra),
sg AS (
  SELECT target_mi, count(*) AS names, avg(r) FILTER (t <= 10) - avg(r) FILTER (b <= 10) AS spread_raw, avg(alpha) FILTER (t <= 10) - avg(alpha) FILTER (b <= 10) AS spread_alpha,
    corr(score, size) AS corr_score_size, corr(score, beta_use) AS corr_score_beta FROM eg GROUP BY 1),
sigm AS (SELECT sg.*, icr.c AS ic_raw, ica.c AS ic_alpha FROM sg JOIN icr USING (target_mi) JOIN ica USING (target_mi))"""

MEASURES = ("ic_raw", "ic_alpha", "spread_raw", "spread_alpha")


def rounded(df, *columns, exact=()):
    return df.select(*exact, *[near(c).alias(c) for c in columns])


def checked(spark, sf):
    return shared_stage(spark, sf, "signal_check", lambda: K.signal_check(D.scored(spark, sf), D.returns(spark, sf), 10))


@query("k01_signal_check", with_(*TO_SCORED, CHECK) + f"""
SELECT {label('target_mi')} AS month, names, {', '.join(f'{r6(c)} AS {c}' for c in (*MEASURES, 'corr_score_size', 'corr_score_beta'))} FROM sigm""")
def signal_check(spark, sf):
    c = K.signal_check(D.scored(spark, sf), D.returns(spark, sf), 10)
    return rounded(c, *MEASURES, "corr_score_size", "corr_score_beta", exact=(month_label("target_mi").alias("month"), "names"))


@query("k01_decile_alpha", with_(*TO_SCORED, CHECK) + f"""
, rk AS (SELECT *, row_number() OVER (PARTITION BY target_mi ORDER BY score, permno) AS r_, count(*) OVER (PARTITION BY target_mi) AS n_ FROM ra),
dc AS (SELECT target_mi, CAST(greatest(1, ceil(10 * (r_ - 1) / greatest(n_ - 1, 1))) AS INTEGER) AS decile, avg(alpha) AS a FROM rk GROUP BY 1, 2)
SELECT decile, {r6('avg(a)')} AS mean_alpha, count(*) AS months FROM dc GROUP BY 1""")
def decile_alpha(spark, sf):
    return rounded(K.decile_alpha(D.scored(spark, sf), D.returns(spark, sf)), "mean_alpha", exact=("decile", "months"))


@query("k01_signal_summary", with_(*TO_SCORED, CHECK) + " UNION ALL ".join(
    f"SELECT '{c}' AS measure, {r6(f'avg({c})')} AS mean, {r6(f'avg({c}) / stddev_samp({c}) * sqrt(count({c}))')} AS t_stat, "
    f"{r6(f'avg(CAST({c} > 0 AS INTEGER))')} AS hit FROM sigm" for c in MEASURES))
def signal_summary(spark, sf):
    return rounded(K.signal_summary(checked(spark, sf)), "mean", "t_stat", "hit", exact=("measure",))


@query("k01_signal_by_year", with_(*TO_SCORED, CHECK) + f"""
SELECT CAST((target_mi - 1) // 12 AS INTEGER) AS year, {r6('avg(ic_alpha)')} AS ic_alpha, {r6('avg(spread_alpha)')} AS spread_alpha FROM sigm GROUP BY 1""")
def signal_by_year(spark, sf):
    return rounded(K.signal_by_year(checked(spark, sf)), "ic_alpha", "spread_alpha", exact=("year",))


YOY = """series AS (SELECT permno, mi, unnest(['foot', 'card', 'web']) AS dataset, unnest([qty, disc_value, CAST(lines AS DOUBLE)]) AS value FROM panel),
yoy AS (SELECT n.dataset, n.permno, n.mi + 1 AS mi, n.value / d.value - 1 AS growth FROM series n JOIN series d
  ON d.dataset = n.dataset AND d.permno = n.permno AND d.mi = n.mi - 12 JOIN panel p ON p.permno = n.permno AND p.mi = n.mi + 1 WHERE d.value <> 0)"""

USE = """u0 AS (SELECT y.*, p.ret_exc_lead1m, p.ret_12_1, substr(p.gics, 1, 2) AS sector FROM yoy y JOIN panel p USING (permno, mi)
  WHERE p.prc >= 1500 AND p.size_grp IN ('small', 'large', 'mega') AND p.gics IS NOT NULL AND p.ret_exc_lead1m IS NOT NULL),
u1 AS (SELECT *, count(*) OVER (PARTITION BY dataset, mi, sector) AS ns FROM u0),
u2 AS (SELECT * FROM u1 WHERE ns >= 5),
u3 AS (SELECT * FROM u2 WHERE (dataset, mi) IN (SELECT (dataset, mi) FROM u2 GROUP BY dataset, mi HAVING count(DISTINCT sector) >= 2)),
sigu AS (SELECT *, round((rg - avg(rg) OVER s) / nullif(stddev_pop(rg) OVER s, 0), 10) + 0.0 AS z,
  CASE WHEN ret_12_1 IS NOT NULL THEN round((rm - avg(rm) OVER sm) / nullif(stddev_pop(rm) OVER sm, 0), 10) + 0.0 END AS z_mom FROM (
  SELECT *, """ + unit_rank("growth", "dataset, mi, sector") + """ AS rg,
    CASE WHEN ret_12_1 IS NOT NULL THEN rank() OVER (PARTITION BY dataset, mi, sector, ret_12_1 IS NULL ORDER BY ret_12_1) + (count(*) OVER (PARTITION BY dataset, mi, sector, ret_12_1) - 1) / 2.0 END AS rm
  FROM u3) WINDOW s AS (PARTITION BY dataset, mi, sector), sm AS (PARTITION BY dataset, mi, sector))"""

MONTHLY = f"""{spearman('sigu', 'z', 'ret_exc_lead1m', 'dataset, mi', 'aic')},
tr AS (SELECT *, row_number() OVER (PARTITION BY dataset, mi, sector ORDER BY growth, permno) AS k, count(*) OVER (PARTITION BY dataset, mi, sector) AS n FROM sigu),
ts AS (SELECT dataset, mi, sector, max(n) AS n, avg(ret_exc_lead1m) FILTER (k > n - n // 3) - avg(ret_exc_lead1m) FILTER (k <= n // 3) AS sp FROM tr GROUP BY 1, 2, 3),
tm AS (SELECT dataset, mi, sum(n * sp) / sum(n) AS ls, CAST(sum(n) AS BIGINT) AS names, count(*) AS sectors FROM ts GROUP BY 1, 2),
ms AS (SELECT tm.*, tm.mi + 1 AS ret_mi, aic.c AS ic FROM tm JOIN aic USING (dataset, mi))"""

TO_ALT = (PANEL, YOY, USE, MONTHLY)
BY = ["dataset"]


def panel_for_signals(spark, sf):
    return D.panel(spark, sf).select("permno", "mi", "prc", "size_grp", "ret_exc_lead1m", "ret_12_1", F.substring("gics", 1, 2).alias("sector"))


def universe(spark, sf):
    def build():
        p = panel_for_signals(spark, sf)
        d = K.signal_universe(K.yoy_signal(D.alt_series(spark, sf), p, BY), p, 1500.0, by=BY, with_numbers=True)
        d = X.sector_ranks_z(d, {"growth": "z", "ret_12_1": "z_mom"}, ["dataset", "mi", "sector"])
        # Equal ranks in equal-sized sectors must tie exactly.
        return d.withColumn("z", F.round("z", 10)).withColumn("z_mom", F.round("z_mom", 10))
    return shared_stage(spark, sf, "alt_universe", build)


def stats(spark, sf):
    return shared_stage(spark, sf, "alt_monthly", lambda: K.monthly_stats(universe(spark, sf), BY))


@query("k02_yoy_signal", with_(PANEL, YOY) + f"SELECT dataset, permno, {label('mi')} AS month, {r6('growth')} AS growth FROM yoy")
def yoy_signal(spark, sf):
    s = K.yoy_signal(D.alt_series(spark, sf), panel_for_signals(spark, sf), BY)
    return rounded(s, "growth", exact=("dataset", "permno", month_label("mi").alias("month")))


@query("k03_signal_universe", with_(PANEL, YOY, USE) + f"""
SELECT dataset, permno, {label('mi')} AS month, sector, {r6('z')} AS z, {r6('z_mom')} AS z_mom FROM sigu""")
def signal_universe(spark, sf):
    return rounded(universe(spark, sf), "z", "z_mom", exact=("dataset", "permno", month_label("mi").alias("month"), "sector"))


@query("k04_sector_tercile_spread", with_(*TO_ALT) + f"SELECT dataset, {label('mi')} AS month, {r6('ls')} AS ls, names, sectors FROM tm")
def sector_tercile_spread(spark, sf):
    return rounded(K.sector_tercile_spread(universe(spark, sf), BY), "ls", exact=("dataset", month_label("mi").alias("month"), "names", "sectors"))


@query("k05_monthly_stats", with_(*TO_ALT) + f"SELECT dataset, {label('ret_mi')} AS ret_month, {r6('ic')} AS ic, {r6('ls')} AS ls, names, sectors FROM ms")
def monthly_stats(spark, sf):
    return rounded(K.monthly_stats(universe(spark, sf), BY), "ic", "ls", exact=("dataset", month_label("ret_mi").alias("ret_month"), "names", "sectors"))


def nw_sql(src, keys, value="ic"):
    return f"""nwe AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY {keys}) AS e FROM {src}),
nwp AS (SELECT *, e * lag(e, 1) OVER w AS p1, e * lag(e, 2) OVER w AS p2, e * lag(e, 3) OVER w AS p3 FROM nwe WINDOW w AS (PARTITION BY {keys} ORDER BY ret_mi)),
nw AS (SELECT {keys}, CASE WHEN count(*) >= 3 THEN avg({value}) / sqrt((sum(e * e) + 1.5 * coalesce(sum(p1), 0) + 1.0 * coalesce(sum(p2), 0) + 0.5 * coalesce(sum(p3), 0)) / count(*) / count(*)) END AS t
  FROM nwp GROUP BY {keys})"""


@query("k06_newey_west_t", with_(*TO_ALT, nw_sql("ms", "dataset")) + f"SELECT dataset, {r6('t')} AS nw_t FROM nw")
def newey_west_t(spark, sf):
    return rounded(K.newey_west_t(stats(spark, sf), "ic", BY, "ret_mi"), "nw_t", exact=("dataset",))


WINDOWS = {"design": (None, 1998 * 12 + 12), "test": (1999 * 12 + 1, 2001 * 12 + 7), "all": (None, None)}
WSQL = f"""wm AS (SELECT *, 'design' AS win FROM ms WHERE ret_mi <= {1998 * 12 + 12} UNION ALL SELECT *, 'test' FROM ms WHERE ret_mi BETWEEN {1999 * 12 + 1} AND {2001 * 12 + 7} UNION ALL SELECT *, 'all' FROM ms),
wc AS (SELECT w.dataset, w.win, count(DISTINCT u.sector) AS sectors_covered FROM wm w JOIN sigu u ON u.dataset = w.dataset AND u.mi = w.mi GROUP BY 1, 2),
{nw_sql('wm', 'dataset, win')}"""


@query("k07_window_summary", with_(*TO_ALT, WSQL) + f"""
SELECT wm.dataset, wm.win AS "window", count(*) AS months, {label('min(ret_mi)')} AS first_month, {label('max(ret_mi)')} AS last_month, {r6('avg(names)')} AS avg_names,
  {r6('avg(ic)')} AS mean_ic, {r6('avg(CAST(ic > 0 AS INTEGER))')} AS hit_rate, {r6('100 * avg(ls)')} AS ls_mean_pct, {r6('avg(ls) / stddev_samp(ls) * sqrt(12)')} AS ls_sharpe,
  {r6('avg(ls) / stddev_samp(ls) * sqrt(count(*))')} AS ls_t, any_value(sectors_covered) AS sectors_covered, {r6('any_value(t)')} AS ic_t
FROM wm JOIN wc USING (dataset, win) JOIN nw USING (dataset, win) GROUP BY 1, 2""")
def window_summary(spark, sf):
    s = K.window_summary(stats(spark, sf), universe(spark, sf), WINDOWS, BY)
    return rounded(s, "avg_names", "mean_ic", "hit_rate", "ls_mean_pct", "ls_sharpe", "ls_t", "ic_t",
                   exact=("dataset", "window", "months", month_label("first_mi").alias("first_month"), month_label("last_mi").alias("last_month"), "sectors_covered"))


@query("k08_by_year", with_(*TO_ALT) + f"""
SELECT dataset, CAST((ret_mi - 1) // 12 AS INTEGER) AS year, count(*) AS months, {r6('avg(names)')} AS avg_names, {r6('avg(ic)')} AS mean_ic,
  {r6('avg(CAST(ic > 0 AS INTEGER))')} AS hit_rate, {r6('100 * avg(ls)')} AS ls_mean_pct, {r6('avg(ls) / stddev_samp(ls) * sqrt(count(*))')} AS ls_t FROM ms GROUP BY 1, 2""")
def by_year(spark, sf):
    return rounded(K.by_year(stats(spark, sf), BY), "avg_names", "mean_ic", "hit_rate", "ls_mean_pct", "ls_t", exact=("dataset", "year", "months"))


SOURCES = ("foot", "card", "web")
TEST_MONTHS = WINDOWS["test"]


@query("k09_pairwise_xs_corr", with_(PANEL, YOY, USE) + f"""
, both_ AS (SELECT a.dataset || ' vs ' || b.dataset AS pair, a.permno, a.mi, a.z AS a, b.z AS b FROM sigu a JOIN sigu b ON a.permno = b.permno AND a.mi = b.mi
    AND (a.dataset, b.dataset) IN (('foot', 'card'), ('foot', 'web'), ('card', 'web'))
  UNION ALL SELECT dataset || ' vs momentum', permno, mi, z, z_mom FROM sigu),
pr AS (SELECT *, 'all' AS win FROM both_ UNION ALL SELECT *, 'test' FROM both_ WHERE mi + 1 BETWEEN {TEST_MONTHS[0]} AND {TEST_MONTHS[1]}),
{spearman('pr', 'a', 'b', 'win, pair, mi', 'pc')},
pn AS (SELECT win, pair, mi, count(*) AS n FROM pr GROUP BY 1, 2, 3)
SELECT pn.win AS "window", pn.pair, {r6('avg(c) FILTER (pn.n >= 20)')} AS mean_corr, count(*) FILTER (pn.n >= 20) AS months_used, {r6('avg(pn.n)')} AS mean_overlap
FROM pn LEFT JOIN pc USING (win, pair, mi) GROUP BY 1, 2""")
def pairwise_xs_corr(spark, sf):
    """Every pair of sources, and each source against momentum, over the test window and over all months."""
    u = universe(spark, sf)
    first = {a: [f"{a} vs {b}" for b in SOURCES[i + 1:]] + [f"{a} vs momentum"] for i, a in enumerate(SOURCES)}
    second = {b: [f"{a} vs {b}" for a in SOURCES[:i]] for i, b in enumerate(SOURCES)}

    def pairs_of(table):
        return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]), F.col("dataset"))

    def windows(df):
        test = F.when((F.col("mi") + 1).between(*TEST_MONTHS), F.lit("test"))
        return df.withColumn("window", F.explode(F.array_compact(F.array(F.lit("all"), test))))

    left = windows(u.select("permno", "mi", F.col("z").alias("a"), F.explode(pairs_of(first)).alias("pair")))
    right = u.select("permno", "mi", F.col("z").alias("b"), F.explode(pairs_of(second)).alias("pair")).unionByName(
        u.select("permno", "mi", F.col("z_mom").alias("b"), F.concat("dataset", F.lit(" vs momentum")).alias("pair")))
    return rounded(K.pairwise_xs_corr(left, windows(right), 20, ["window", "pair"]), "mean_corr", "mean_overlap", exact=("window", "pair", "months_used"))


SURV = """cp AS (SELECT o_custkey AS permno, year(o_orderdate) * 12 + month(o_orderdate) AS mi, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS me, any_value(c_mktsegment) AS sector, any_value(c_acctbal) AS acct
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
cpan AS (SELECT *, CASE WHEN me > 300000 THEN 'mega' WHEN me > 200000 THEN 'large' WHEN me > 100000 THEN 'small' ELSE 'micro' END AS size_grp FROM cp),
ser AS (SELECT permno, mi + 2 AS mi FROM cpan WHERE acct > 5000 UNION SELECT permno, mi FROM cpan WHERE acct > 5000),
life AS (SELECT permno, min(mi) AS first, max(mi) AS last FROM cpan GROUP BY 1),
lastm AS (SELECT max(mi) AS m FROM cpan),
ml AS (SELECT permno, first, last FROM (SELECT DISTINCT permno FROM ser) LEFT JOIN life USING (permno)),
sr AS (SELECT s.permno, s.mi, l.first, l.last, c.permno AS live FROM ser s LEFT JOIN life l USING (permno) LEFT JOIN cpan c ON c.permno = s.permno AND c.mi = s.mi),
win AS (SELECT * FROM cpan WHERE mi BETWEEN (SELECT min(mi) FROM ser) AND (SELECT max(mi) FROM ser)),
homes AS (SELECT permno, max_by(sector, mi) AS sector FROM win WHERE permno IN (SELECT permno FROM ser) GROUP BY 1),
keep AS (SELECT sector FROM homes GROUP BY 1 HAVING count(*) >= 3),
uni AS (SELECT w.permno, max(CAST(size_grp IN ('small', 'large', 'mega') AS INTEGER)) AS small_plus, max(CAST(size_grp IN ('large', 'mega') AS INTEGER)) AS large_plus
  FROM win w WHERE sector IN (SELECT sector FROM keep) GROUP BY 1),
un AS (SELECT u.*, l.last = (SELECT m FROM lastm) AS alive, u.permno IN (SELECT permno FROM ser) AS cov FROM uni u JOIN life l USING (permno))"""

EARLY = 2001 * 12 + 1


def surv_sql():
    alive, old = "last = (SELECT m FROM lastm)", f"last < {EARLY}"
    rows = [("mapped", "count(*)", "ml"), ("mapped_alive", f"count(*) FILTER ({alive})", "ml"), ("mapped_left_early", f"count(*) FILTER ({old})", "ml"),
            ("mapped_left_late", f"count(*) FILTER (NOT {alive} AND NOT {old})", "ml"), ("rows_after_exit", "count(*) FILTER (mi > last)", "sr"),
            ("rows_before_entry", "count(*) FILTER (mi < first)", "sr"), ("rows_off_panel", "count(*) FILTER (live IS NULL)", "sr"), ("rows_total", "count(*)", "sr")]
    for tag in ("small_plus", "large_plus"):
        for state, cond in (("listed", "alive"), ("exited", "NOT alive")):
            rows += [(f"{tag}_{state}", f"count(*) FILTER ({tag} = 1 AND {cond})", "un"),
                     (f"{tag}_{state}_covered_pct", f"100 * avg(CAST(cov AS INTEGER)) FILTER ({tag} = 1 AND {cond})", "un")]
    parts = [f"SELECT '{m}' AS metric, round((CAST({e} AS DOUBLE)) + 3e-11, 6) + 0.0 AS value FROM {s}" for m, e, s in rows]
    parts.append(f"SELECT 'exits_' || ((last - 1) // 12), CAST(count(*) AS DOUBLE) FROM ml WHERE NOT {alive} GROUP BY 1")
    return with_(SURV) + " UNION ALL ".join(parts)


@query("k10_mapping_survivorship", surv_sql())
def mapping_survivorship(spark, sf):
    customers = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("permno"), F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").alias("acct"))
    size = F.when(F.col("me") > 300_000, "mega").when(F.col("me") > 200_000, "large").when(F.col("me") > 100_000, "small").otherwise("micro")
    panel = D.customer_months(spark, sf).join(customers, "permno").withColumn("size_grp", size)
    mapped = panel.filter("acct > 5000").select("permno", "mi")
    series = mapped.withColumn("mi", F.col("mi") + 2).unionByName(mapped).distinct()
    last = panel.agg(F.max("mi")).scalar()
    out = K.mapping_survivorship(series, panel, last, EARLY)
    return out.withColumn("value", near("value"))


SLOPES = "slp AS (SELECT s.target_mi, regr_slope(p.ret, s.score) AS slope FROM scored s JOIN panel p ON p.permno = s.permno AND p.mi = s.target_mi WHERE p.ret IS NOT NULL GROUP BY 1)"


@query("k11_score_slope", with_(*TO_SCORED, SLOPES) + f"SELECT {label('target_mi')} AS month, {r6('slope')} AS slope FROM slp")
def score_slope(spark, sf):
    return rounded(K.score_slope(D.scored(spark, sf), D.returns(spark, sf)), "slope", exact=(month_label("target_mi").alias("month"),))


@query("k11_slope_summary", with_(*TO_SCORED, SLOPES) + f"""
SELECT count(slope) AS months, {r6('avg(slope)')} AS mean_slope, {r6('avg(slope) / stddev_samp(slope) * sqrt(count(slope))')} AS t_stat FROM slp""")
def slope_summary(spark, sf):
    return rounded(K.slope_summary(K.score_slope(D.scored(spark, sf), D.returns(spark, sf))), "mean_slope", "t_stat", exact=("months",))


@query("k12_rank_ic_by_group", with_(PANEL, FORECASTS, JOINED) + f"""
, g AS (SELECT j.target_mi, j.forecast, p.ret, CASE WHEN j.size_grp IN ('nano', 'micro') OR j.prc < 1500 THEN 'excluded' ELSE 'screened' END AS grp
  FROM joined j JOIN panel p ON p.permno = j.permno AND p.mi = j.target_mi),
{spearman('g', 'forecast', 'ret', 'target_mi, grp', 'gi')}
SELECT grp, {r6('avg(c)')} AS mean_rank_ic, count(c) AS months, {r6('avg(n)')} AS avg_names FROM gi GROUP BY 1""")
def rank_ic_by_group(spark, sf):
    joined = P.lagged_join(D.forecasts(spark, sf), D.panel(spark, sf))
    out = F.col("size_grp").isin("nano", "micro") | (F.col("prc") < 1500)
    realised = D.returns(spark, sf).select("permno", F.col("mi").alias("target_mi"), "ret")
    rows = joined.withColumn("grp", F.when(out, "excluded").otherwise("screened")).join(realised, ["permno", "target_mi"])
    return rounded(K.rank_ic_by_group(rows, "forecast", "ret", "grp"), "mean_rank_ic", "avg_names", exact=("grp", "months"))
