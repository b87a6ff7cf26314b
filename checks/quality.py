"""Data-quality rules."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import FILINGS, PANEL, label, r6, with_
from crossweave.functions.columns import month_label
from crossweave.operators import quality as L
from crossweave.session import shared_stage, stage
from crossweave.sources import demo_tables as D

END = 2001 * 12 + 11
EARLY = 2001 * 12 + 1
FEATURES = list(D.CHARACTERISTICS)
GROUPS = ("left early", "left late", "listed")


def rounded(df, *columns, exact=()):
    return df.select(*exact, *[near(c).alias(c) for c in columns])


def customers(spark, sf):
    return D.customer_months(spark, sf)


def planted(spark, sf):
    """Panel with one month's values taken from the next month."""
    return L.plant_lookahead(D.panel(spark, sf), SHIFTED, SHIFT_FROM, SHIFT_TO)


SHIFT_FROM, SHIFT_TO = 1999 * 12 + 12, 2000 * 12 + 1
SHIFTED = ["ret_1_0", "market_equity", "rvol_21d", "ni_me", "ret_12_1", "betabab_1260d"]
PLANT = f"""shifted AS (SELECT p.* REPLACE ({', '.join(f'CASE WHEN n.permno IS NOT NULL THEN n.{c} ELSE p.{c} END AS {c}' for c in SHIFTED)})
  FROM panel p LEFT JOIN (SELECT * FROM panel WHERE mi = {SHIFT_TO}) n ON n.permno = p.permno AND p.mi = {SHIFT_FROM})"""


def timing_sql(src, tag):
    return f"""{tag} AS (SELECT mi, avg(CAST(coalesce(abs(ret_1_0 - ret) < 1e-4, FALSE) AS INTEGER)) AS ret_ok,
    avg(CAST(coalesce(abs(market_equity - me) / abs(me) < 1e-4, FALSE) AS INTEGER)) AS me_ok FROM {src} GROUP BY 1),
{tag}_f AS (SELECT *, ret_ok < (SELECT median(ret_ok) FROM {tag}) - 0.5 OR me_ok < (SELECT median(me_ok) FROM {tag}) - 0.5 AS flagged FROM {tag})"""


@query("l01_timing_consistency", with_(PANEL, PLANT, timing_sql("shifted", "tc")) + f"""
SELECT {label('mi')} AS month, {r6('ret_ok')} AS ret_ok, {r6('me_ok')} AS me_ok, flagged FROM tc_f""")
def timing_consistency(spark, sf):
    return rounded(L.timing_consistency(planted(spark, sf)), "ret_ok", "me_ok", exact=(month_label("mi").alias("month"), "flagged"))


@query("l02_duplicate_keys", with_(FILINGS) + """
SELECT 'document_id' AS key, count(*) - count(DISTINCT document_id) AS duplicates FROM filings
UNION ALL SELECT 'permno+filing_date+ticker', count(*) - count(DISTINCT (permno, filing_date, ticker)) FROM filings""")
def duplicate_keys(spark, sf):
    return L.duplicate_keys(D.filings(spark, sf), [["document_id"], ["permno", "filing_date", "ticker"]])


@query("l03_ticker_map_check", with_(PANEL) + """
SELECT (SELECT count(*) FROM (SELECT 1 FROM panel WHERE ticker IS NOT NULL GROUP BY ticker, mi HAVING count(DISTINCT permno) > 1)) AS shared_ticker_months,
  (SELECT count(*) FROM (SELECT 1 FROM panel WHERE ticker IS NOT NULL GROUP BY ticker HAVING count(DISTINCT permno) > 1)) AS reused_tickers""")
def ticker_map_check(spark, sf):
    return L.ticker_map_check(D.panel(spark, sf))


@query("l03_ticker_owners", with_(PANEL) + f"""
SELECT ticker, {label('mi')} AS month, count(DISTINCT permno) AS owners FROM panel WHERE ticker IS NOT NULL GROUP BY ticker, mi HAVING count(DISTINCT permno) > 1""")
def ticker_owners(spark, sf):
    return L.ticker_owners(D.panel(spark, sf)).select("ticker", month_label("mi").alias("month"), "owners")


@query("l04_key_changes", with_(PANEL) + """
, k AS (SELECT permno, mi, gvkey || '-' || iid AS k, lag(gvkey || '-' || iid) OVER (PARTITION BY permno ORDER BY mi) AS prev FROM panel),
runs AS (SELECT * FROM k WHERE prev IS NULL OR k <> prev)
SELECT (SELECT count(DISTINCT permno) FROM k WHERE k <> prev) AS changed,
  (SELECT count(DISTINCT permno) FROM (SELECT permno, k FROM runs GROUP BY 1, 2 HAVING count(*) > 1)) AS switched_back""")
def key_changes(spark, sf):
    return L.key_changes(D.panel(spark, sf))


MISS = "missp AS (SELECT *, (" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in FEATURES) + f") / {len(FEATURES)}.0 AS miss_share FROM panel)"


def miss_panel(spark, sf):
    return L.with_miss_share(D.panel(spark, sf), FEATURES)


@query("l05_missingness_bands", with_(PANEL, MISS) + f"""
SELECT CASE WHEN miss_share <= 0.1 THEN '<=10%' WHEN miss_share <= 0.25 THEN '10-25%' WHEN miss_share <= 0.5 THEN '25-50%' ELSE '>50%' END AS band,
  count(*) AS rows, {r6('median(me)')} AS median_me, {r6("avg(CAST(size_grp IN ('micro', 'nano') AS INTEGER))")} AS micro_nano_share FROM missp GROUP BY 1""")
def missingness_bands(spark, sf):
    return rounded(L.missingness_bands(miss_panel(spark, sf)), "median_me", "micro_nano_share", exact=("band", "rows"))


@query("l05_missingness_ratio", with_(PANEL, MISS) + f"""
, r AS (SELECT mi, median(me) FILTER (miss_share > 0.3) / median(me) FILTER (miss_share <= 0.3) AS ratio FROM missp GROUP BY 1)
SELECT {r6('median(ratio)')} AS ratio, count(ratio) AS months FROM r""")
def missingness_ratio(spark, sf):
    return rounded(L.missingness_ratio(miss_panel(spark, sf), high=0.3), "ratio", exact=("months",))


CUST = """cust AS (SELECT o_custkey AS permno, year(o_orderdate) * 12 + month(o_orderdate) AS mi, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS me FROM orders GROUP BY 1, 2),
cend AS (SELECT max(mi) AS m FROM cust)"""


def life_sql(src, end, early=EARLY):
    return f"""lf AS (SELECT permno, min(mi) AS first, max(mi) AS last, CASE WHEN max(mi) = {end} THEN 'listed' WHEN max(mi) < {early} THEN 'left early' ELSE 'left late' END AS "group"
  FROM {src} GROUP BY 1)"""


CLIFE = life_sql("cust", "(SELECT m FROM cend)")


def customer_life(spark, sf):
    c = customers(spark, sf)
    return L.lifetimes(c, c.agg(F.max("mi")).scalar(), EARLY)


@query("l06_lifetimes", with_(CUST, CLIFE) + 'SELECT permno, first, last, "group" FROM lf')
def lifetimes(spark, sf):
    return customer_life(spark, sf)


def pivot_cols(expr):
    return ", ".join(f"{expr.format(g=g)} AS \"{g}\"" for g in GROUPS)


@query("l07_coverage_by_year", with_(CUST, CLIFE) + f"""
, s AS (SELECT DISTINCT permno, CAST((mi - 1) // 12 AS INTEGER) AS year, "group" FROM cust JOIN lf USING (permno))
SELECT year, {pivot_cols("count(*) FILTER (\"group\" = '{g}')")}, count(*) AS "all",
  {r6('count(*) / (SELECT count(*) FROM s WHERE year = 2000)')} AS vs_base FROM s GROUP BY 1""")
def coverage_by_year(spark, sf):
    c = L.coverage_by_year(customers(spark, sf), customer_life(spark, sf), 2000)
    return rounded(c, "vs_base", exact=("year", *GROUPS, "all"))


@query("l08_survivorship_flag", with_(CUST, CLIFE) + f"""
SELECT count(*) AS entities, {r6('avg(CAST(last < (SELECT m FROM cend) AS INTEGER))')} AS exit_share, avg(CAST(last < (SELECT m FROM cend) AS INTEGER)) < 0.01 AS flagged FROM lf""")
def survivorship_flag(spark, sf):
    c = customers(spark, sf)
    return rounded(L.survivorship_flag(customer_life(spark, sf), c.agg(F.max("mi")).scalar()), "exit_share", exact=("entities", "flagged"))


@query("l09_real_start", with_(CUST) + f"""
, n AS (SELECT mi, count(*) AS n FROM cust GROUP BY 1), lv AS (SELECT avg(n) AS level FROM n WHERE (mi - 1) // 12 = 2000)
SELECT {label('min(mi)')} AS start, {r6('max(level)')} AS level FROM n, lv WHERE n >= 0.5 * level""")
def real_start(spark, sf):
    return L.real_start(customers(spark, sf), 2000).select(month_label("start").alias("start"), near("level").alias("level"))


@query("l10_event_lag_buckets", with_(FILINGS) + f"""
, g AS (SELECT date_diff('day', content_report_date, filing_date) AS lag FROM filings)
SELECT count(*) FILTER (lag IS NULL) AS missing, count(*) FILTER (lag < 0) AS negative, count(*) FILTER (lag = 0) AS same_day,
  count(*) FILTER (lag BETWEEN 1 AND 4) AS days_1_4, count(*) FILTER (lag > 4) AS later, {r6('median(lag)')} AS median_days FROM g""")
def event_lag_buckets(spark, sf):
    return L.event_lag_buckets(D.filings(spark, sf))


@query("l11_event_ticker_conflicts", with_(PANEL, FILINGS) + f"""
, own AS (SELECT ticker, mi, min(permno) AS owner FROM panel WHERE ticker IS NOT NULL GROUP BY 1, 2),
m AS (SELECT f.*, p.ticker AS panel_ticker, o.owner FROM filings f LEFT JOIN panel p ON p.permno = f.permno AND p.mi = f.mi LEFT JOIN own o ON o.ticker = f.ticker AND o.mi = f.mi)
SELECT count(*) FILTER (panel_ticker IS NOT NULL) AS both_present, count(*) FILTER (ticker <> panel_ticker) AS differs,
  {r6('count(*) FILTER (ticker <> panel_ticker) / count(*) FILTER (panel_ticker IS NOT NULL)')} AS share_differs,
  count(*) FILTER (owner <> permno) AS owned_by_other, count(*) FILTER (cik IS NULL) AS cik_missing FROM m""")
def event_ticker_conflicts(spark, sf):
    c = L.event_ticker_conflicts(D.filings(spark, sf), D.panel(spark, sf))
    return rounded(c, "share_differs", exact=("both_present", "differs", "owned_by_other", "cik_missing"))


# Events of the customer panel: every order, announced up to 29 months before it.
EVENTS = f"""{CUST},
{CLIFE},
ev AS (SELECT o_custkey AS permno, year(o_orderdate) * 12 + month(o_orderdate) - o_orderkey % 30 AS mi FROM orders),
cs AS (SELECT permno, max_by(CASE WHEN me > 200000 THEN 'large' ELSE 'small' END, mi) AS size_last FROM cust GROUP BY 1),
fl AS (SELECT lf.*, cs.size_last, lf.permno IN (SELECT permno FROM ev) AS ever,
    EXISTS (SELECT 1 FROM ev WHERE ev.permno = lf.permno AND ev.mi BETWEEN lf.last - 11 AND lf.last) AS recent FROM lf JOIN cs USING (permno))"""


def event_parts(spark, sf):
    panel = customers(spark, sf).withColumn("size_grp", F.when(F.col("me") > 200_000, "large").otherwise("small"))
    announced = F.year("o_orderdate") * 12 + F.month("o_orderdate") - F.col("o_orderkey") % 30
    events = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("permno"), announced.alias("mi"))
    return events, panel, customer_life(spark, sf)


@query("l12_event_coverage", with_(EVENTS) + f"""
SELECT "group", count(*) AS entities, {r6('avg(CAST(recent AS INTEGER))')} AS recent_share, {r6('avg(CAST(ever AS INTEGER))')} AS ever_share FROM fl GROUP BY 1""")
def event_coverage(spark, sf):
    return rounded(L.event_coverage(L.event_flags(*event_parts(spark, sf))), "recent_share", "ever_share", exact=("group", "entities"))


@query("l12_event_coverage_by_size", with_(EVENTS) + f"""
SELECT size_last, {pivot_cols("round((avg(CAST(recent AS INTEGER)) FILTER (\"group\" = '{g}')) + 3e-11, 6) + 0.0")} FROM fl GROUP BY 1""")
def event_coverage_by_size(spark, sf):
    return rounded(L.event_coverage_by_size(L.event_flags(*event_parts(spark, sf))), *GROUPS, exact=("size_last",))


@query("l12_event_coverage_by_year", with_(EVENTS) + f"""
, pr AS (SELECT DISTINCT permno, CAST((mi - 1) // 12 AS INTEGER) AS year, "group" FROM cust JOIN lf USING (permno)),
ey AS (SELECT DISTINCT permno, CAST((mi - 1) // 12 AS INTEGER) AS year FROM ev),
hs AS (SELECT pr.*, CAST(ey.permno IS NOT NULL AS INTEGER) AS has FROM pr LEFT JOIN ey ON ey.permno = pr.permno AND ey.year = pr.year),
ec AS (SELECT CAST((mi - 1) // 12 AS INTEGER) AS year, count(*) AS events FROM ev GROUP BY 1)
SELECT year, {pivot_cols("round((avg(has) FILTER (\"group\" = '{g}')) + 3e-11, 6) + 0.0")}, {r6('avg(has)')} AS "all", any_value(events) AS events FROM hs LEFT JOIN ec USING (year) GROUP BY 1""")
def event_coverage_by_year(spark, sf):
    return rounded(L.event_coverage_by_year(*event_parts(spark, sf)), *GROUPS, "all", exact=("year", "events"))


SLICE = (1999 * 12 + 1, 2000 * 12 + 12)
#: Overwritten columns less the two by which the timing rule recognises a later month.
PARTIAL = [c for c in SHIFTED if c not in ("ret_1_0", "market_equity")]
SLICED = f"""slice AS (SELECT * FROM missp WHERE mi BETWEEN {SLICE[0]} AND {SLICE[1]}),
e1 AS (SELECT p.* REPLACE ({', '.join(f'CASE WHEN n.permno IS NOT NULL THEN n.{c} ELSE p.{c} END AS {c}' for c in SHIFTED)})
  FROM slice p LEFT JOIN (SELECT * FROM slice WHERE mi = {SHIFT_TO}) n ON n.permno = p.permno AND p.mi = {SHIFT_FROM}),
e2 AS (SELECT * FROM slice WHERE permno IN (SELECT permno FROM slice GROUP BY 1 HAVING max(mi) = {SLICE[1]})),
hold AS (SELECT ticker, permno, min(mi) AS since FROM slice WHERE ticker IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 6),
hold2 AS (SELECT ticker, list(permno ORDER BY since, permno) AS h FROM hold GROUP BY 1 HAVING count(*) >= 2 ORDER BY ticker LIMIT 1),
e3 AS (SELECT s.* REPLACE (CASE WHEN s.ticker = t.ticker AND s.permno = t.h[2] THEN t.h[1] ELSE s.permno END AS permno) FROM slice s, hold2 t),
e4 AS (SELECT s.* REPLACE (CASE WHEN s.ticker = t.ticker AND s.permno = t.h[2] THEN t.h[1] ELSE s.permno END AS permno)
  FROM (SELECT * FROM e1 WHERE permno IN (SELECT permno FROM e1 GROUP BY 1 HAVING max(mi) = {SLICE[1]})) s, hold2 t),
e5 AS (SELECT p.* REPLACE ({', '.join(f'CASE WHEN n.permno IS NOT NULL THEN n.{c} ELSE p.{c} END AS {c}' for c in PARTIAL)})
  FROM slice p LEFT JOIN (SELECT * FROM slice WHERE mi = {SHIFT_TO}) n ON n.permno = p.permno AND p.mi = {SHIFT_FROM})"""

SLICES = (("clean", "slice"), ("lookahead", "e1"), ("survivors", "e2"), ("ticker", "e3"), ("all", "e4"), ("lookahead_partial", "e5"))


def copies(spark, sf):
    clean = shared_stage(spark, sf, "slice", lambda: miss_panel(spark, sf).filter(F.col("mi").between(*SLICE)))
    return L.planted_copies(clean, SHIFTED, PARTIAL, SHIFT_FROM, SHIFT_TO, SLICE[1], L.shared_ticker(clean))


@query("l13_plant_errors", with_(PANEL, MISS, SLICED) + " UNION ALL ".join(
    f"SELECT '{n}' AS slice, count(*) AS rows, count(DISTINCT permno) AS entities, count(*) - count(DISTINCT (permno, mi)) AS duplicate_keys, "
    f"{r6(f'sum(ni_me) FILTER (mi = {SHIFT_FROM})')} AS ni_me_before, {r6(f'sum(ret_1_0) FILTER (mi = {SHIFT_FROM})')} AS ret_before FROM {t}" for n, t in SLICES))
def plant_errors(spark, sf):
    before = F.col("mi") == SHIFT_FROM
    return copies(spark, sf).groupBy("slice").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("permno").alias("entities"), (F.count(F.lit(1)) - F.count_distinct("permno", "mi")).alias("duplicate_keys"),
        near(F.sum(F.when(before, F.col("ni_me")))).alias("ni_me_before"), near(F.sum(F.when(before, F.col("ret_1_0")))).alias("ret_before"))


def scorecard_sql():
    ctes, rules = [], {}
    for n, t in SLICES:
        ctes.append(timing_sql(t, f"t_{t}"))
        ctes.append(f"k_{t} AS (SELECT permno, mi, row_number() OVER w AS n, gvkey || '-' || iid AS k, lag(gvkey || '-' || iid) OVER w AS prev FROM {t} WINDOW w AS (PARTITION BY permno ORDER BY mi, gvkey, iid))")
        ctes.append(f"r_{t} AS (SELECT mi, median(me) FILTER (miss_share > 0.5) / median(me) FILTER (miss_share <= 0.5) AS ratio FROM {t} GROUP BY 1)")
        exits = f"(SELECT avg(CAST(l < {SLICE[1]} AS INTEGER)) FROM (SELECT max(mi) AS l FROM {t} GROUP BY permno))"
        for rule, e in {
                "timing_months_flagged": f"(SELECT CAST(count(*) FILTER (flagged) AS DOUBLE) FROM t_{t}_f)",
                "duplicate_keys": f"(SELECT CAST(count(*) - count(DISTINCT (permno, mi)) AS DOUBLE) FROM {t})",
                "shared_ticker_months": f"(SELECT CAST(count(*) AS DOUBLE) FROM (SELECT 1 FROM {t} WHERE ticker IS NOT NULL GROUP BY ticker, mi HAVING count(DISTINCT permno) > 1))",
                "key_changed": f"(SELECT CAST(count(DISTINCT permno) AS DOUBLE) FROM k_{t} WHERE k <> prev)",
                "switched_back": f"(SELECT CAST(count(DISTINCT permno) AS DOUBLE) FROM (SELECT permno FROM k_{t} WHERE n = 1 OR k <> prev GROUP BY permno, k HAVING count(*) > 1))",
                "missing_size_ratio": f"(SELECT median(ratio) FROM r_{t})", "exit_share": exits, "survivorship_flag": f"CAST({exits} < 0.01 AS DOUBLE)"}.items():
            rules.setdefault(rule, []).append(f"round(({e}) + 3e-11, 6) + 0.0 AS \"{n}\"")
    return with_(PANEL, MISS, SLICED, *ctes) + " UNION ALL ".join(f"SELECT '{r}' AS rule, {', '.join(cols)}" for r, cols in rules.items())


@query("l14_rules_scorecard", scorecard_sql())
def rules_scorecard(spark, sf):
    names = [n for n, _ in SLICES]
    return rounded(L.rules_scorecard(copies(spark, sf), names, SLICE[1], 2000 * 12 + 1), *names, exact=("rule",))
