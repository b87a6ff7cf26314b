"""Accounting, overlays and performance."""

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.risk import TO_RISK, book_variance
from checks.views import CASH, MARKET, TO_BOOK, TO_LEDGER, label, r6, with_
from crossweave.functions.columns import month_label
from crossweave.operators import accounting as A
from crossweave.operators import audits as H
from crossweave.operators import prep as P
from crossweave.session import shared_stage
from crossweave.sources import demo_tables as D

KEYS = ["trial"]
TRADE, BORROW = 0.0065, 0.0152


def out(df, *columns, exact=()):
    """(trial, month, exact columns, rounded columns) of a per-month result."""
    return df.select("trial", month_label("target_mi").alias("month"), *exact, *[near(c).alias(c) for c in columns])


def sel(*columns, exact=(), src="ledger"):
    parts = [f"trial, {label('target_mi')} AS month", *exact, *[f"{r6(c)} AS {c}" for c in columns]]
    return f"SELECT {', '.join(parts)} FROM {src}"


@query("i01_turnover", with_(*TO_LEDGER) + sel("turnover"))
def turnover(spark, sf):
    net = D.trial_ledger(spark, sf).select("trial", "target_mi", "total_net")
    return out(A.turnover(D.book(spark, sf), net, KEYS), "turnover")


ACCOUNT = ("total_gross", "total_net", "cash", "turnover", "cost", "gross", "net", "max_weight", "market_beta", "size_exposure",
           "max_sector_net", "missing_return_gross", "one_way_turnover")
COUNTS = ("positions", "missing_return_positions")


@query("i02_account", with_(*TO_LEDGER) + sel(*ACCOUNT, exact=COUNTS))
def account(spark, sf):
    led = A.ledger(D.book(spark, sf).drop("raw_return", "filled"), D.returns(spark, sf), D.cash(spark, sf), KEYS)
    return out(led, *ACCOUNT, exact=COUNTS)


@query("i02_predicted_vol", with_(*TO_RISK) + f"SELECT trial, {label('target_mi')} AS month, {r6('sqrt(greatest(variance, 0))')} AS predicted_monthly_vol FROM var")
def predicted_vol(spark, sf):
    """The ledger's predicted volatility from the factor form of the book's variance."""
    book = D.book(spark, sf).drop("raw_return", "filled")
    return out(A.ledger(book, D.returns(spark, sf), D.cash(spark, sf), KEYS, variance=book_variance(spark, sf)), "predicted_monthly_vol")


@query("i03_ledger", with_(*TO_LEDGER) + sel("total_net", "turnover", "cost", "hurdle", "market_return"))
def ledger(spark, sf):
    return out(D.trial_ledger(spark, sf), "total_net", "turnover", "cost", "hurdle", "market_return")


@query("i03_ledger_gross_drift", with_(*TO_LEDGER) + f"""
, moved AS (
  SELECT p.trial, p.target_mi, sum(abs(x.w - x.d / (1 + coalesce(g.total_gross, 0)))) AS turnover
  FROM (SELECT trial, target_mi, unnest(pairs) AS x FROM pairs) p LEFT JOIN gr g ON g.trial = p.trial AND g.target_mi = p.target_mi - 1
  WHERE (p.trial, p.target_mi) IN (SELECT (trial, target_mi) FROM gr) GROUP BY 1, 2)
SELECT trial, {label('target_mi')} AS month, {r6('turnover')} AS turnover, {r6('total_gross - turnover * rate_c')} AS total_net FROM moved JOIN gr USING (trial, target_mi)""")
def ledger_gross_drift(spark, sf):
    book = D.book(spark, sf).drop("raw_return", "filled")
    return out(A.ledger_gross_drift(book, D.returns(spark, sf), D.cash(spark, sf), KEYS), "turnover", "total_net")


@query("i04_benchmark_returns", with_(MARKET) + f"SELECT {label('mi')} AS month, {r6('mr')} AS market_return FROM mraw")
def benchmark_returns(spark, sf):
    return A.benchmark_returns(D.levels(spark, sf)).select(month_label("mi").alias("month"), near("market_return").alias("market_return"))


@query("i05_hurdle", with_(*TO_LEDGER) + sel("hurdle"))
def hurdle(spark, sf):
    led = D.trial_ledger(spark, sf).select("trial", "target_mi")
    return out(A.attach_hurdle(led.withColumn("hurdle", F.lit(0.0)), A.official_hurdle(D.cash(spark, sf))), "hurdle")


@query("i06_nav_path", with_(*TO_LEDGER) + f"""
SELECT trial, {label('target_mi')} AS month, {r6('1000 * exp(sum(ln(1 + total_net)) OVER (PARTITION BY trial ORDER BY target_mi))')} AS nav FROM ledger""")
def nav_path(spark, sf):
    return out(A.nav_path(D.trial_ledger(spark, sf), KEYS, start=1000.0), "nav")


SUMMARY = ("cagr", "annual_vol", "information_ratio", "max_drawdown", "realized_market_beta", "mean_traded_nav", "mean_one_way_turnover",
           "annual_one_way_turnover", "ending_nav_billion", "total_cost_nav_fractions", "mean_gross", "max_abs_estimated_beta", "max_sector_net",
           "mean_missing_return_gross")


def summary_sql(keys, src):
    return f"""
, wl AS (SELECT *, exp(sum(ln(1 + total_net)) OVER (PARTITION BY {keys} ORDER BY target_mi)) AS wealth FROM {src}),
wd AS (SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY {keys} ORDER BY target_mi)) - 1 AS dd FROM wl),
summ AS (SELECT {keys}, count(*) AS months, exp(sum(ln(1 + total_net))) ** (12.0 / count(*)) - 1 AS cagr,
  stddev_samp(total_net) * sqrt(12) AS annual_vol,
  sqrt(12) * avg(total_net - hurdle) / nullif(stddev_samp(total_net - hurdle), 0) AS information_ratio, least(min(dd), 0) AS max_drawdown,
  CASE WHEN count(*) >= 3 AND count(market_return) = count(*) THEN regr_slope(total_net - cash, market_return - cash) END AS realized_market_beta,
  avg(turnover) AS mean_traded_nav, avg(one_way_turnover) AS mean_one_way_turnover, 12 * avg(one_way_turnover) AS annual_one_way_turnover,
  exp(sum(ln(1 + total_net))) AS ending_nav_billion, sum(cost) AS total_cost_nav_fractions, avg(gross) AS mean_gross,
  max(abs(market_beta)) AS max_abs_estimated_beta, max(max_sector_net) AS max_sector_net, min(positions) AS min_positions,
  avg(missing_return_gross) AS mean_missing_return_gross FROM wd GROUP BY {keys})
"""


def summary_cols(keys):
    return f"SELECT {keys}, months, min_positions, " + ", ".join(f"{r6(c)} AS {c}" for c in SUMMARY) + " FROM summ"


def summary_out(df, keys):
    return df.select(*keys, "months", "min_positions", *[near(c).alias(c) for c in SUMMARY])


@query("i07_summarize", with_(*TO_LEDGER) + summary_sql("trial", "ledger") + summary_cols("trial"))
def summarize(spark, sf):
    return summary_out(A.summarize(D.trial_ledger(spark, sf), KEYS), KEYS)


@query("i08_period_split", with_(*TO_LEDGER) + """
, per AS (SELECT *, CASE WHEN target_mi < 1999 * 12 + 1 THEN 'before' ELSE 'from' END AS period FROM ledger)
""" + summary_sql("trial, period", "per") + summary_cols("trial, period"))
def period_split(spark, sf):
    return summary_out(A.period_split(D.trial_ledger(spark, sf), KEYS, "1999-01"), ["trial", "period"])


@query("i09_pnl_split", with_(*TO_BOOK, CASH) + f"""
, rs AS (SELECT s.target_mi, s.sector, sum(p.ret * s.me) / sum(s.me) AS rs FROM scored s JOIN panel p ON p.permno = s.permno AND p.mi = s.target_mi
  WHERE p.ret IS NOT NULL GROUP BY 1, 2)
SELECT b.trial, {label('b.target_mi')} AS month, {r6('sum(weight * (coalesce(rs, filled) - cash))')} AS sector_pnl,
  {r6('sum(weight * (filled - coalesce(rs, filled)))')} AS selection_pnl
FROM book b JOIN cashm c ON c.mi = b.target_mi LEFT JOIN rs ON rs.target_mi = b.target_mi AND rs.sector = b.sector GROUP BY b.trial, b.target_mi""")
def pnl_split(spark, sf):
    book = D.book(spark, sf).drop("raw_return", "filled")
    return out(A.pnl_split(book, D.scored(spark, sf), D.returns(spark, sf), D.cash(spark, sf), KEYS), "sector_pnl", "selection_pnl")


@query("i10_sector_exposure", with_(*TO_BOOK) + f"""
SELECT trial, {label('target_mi')} AS month, sector, {r6('sum(weight)')} AS net_exposure FROM book GROUP BY trial, target_mi, sector""")
def sector_exposure(spark, sf):
    return out(A.sector_exposure_table(D.book(spark, sf), KEYS), "net_exposure", exact=("sector",))


OVERLAY = f"""rc AS (
  SELECT *, turnover * {TRADE} + short_gross * {BORROW} / 12 AS cost_full, total_gross - turnover * {TRADE} - short_gross * {BORROW} / 12 - cash AS x,
    market_return - cash AS mx FROM ledger),
hd AS (
  SELECT *, CASE WHEN len(past) >= 12 THEN
    list_sum(list_transform(past, lambda p: (p.m - list_avg(list_transform(past, lambda q: q.m))) * (p.x - list_avg(list_transform(past, lambda q: q.x)))))
    / list_sum(list_transform(past, lambda p: (p.m - list_avg(list_transform(past, lambda q: q.m))) ** 2)) ELSE 0 END AS h
  FROM (SELECT *, (list_reverse(coalesce(list({{'m': mx, 'x': x}}) FILTER (mx IS NOT NULL AND x IS NOT NULL)
      OVER (PARTITION BY trial ORDER BY target_mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])))[1:24] AS past FROM rc)),
hx AS (SELECT *, x - h * coalesce(mx, 0) AS x_hedged FROM hd),
kx AS (
  SELECT *, CASE WHEN count(x_hedged) OVER w >= 12 AND stddev_samp(x_hedged) OVER w > 0
    THEN least(greatest(0.10 / (stddev_samp(x_hedged) OVER w * sqrt(12)), 0.25), 1.0) ELSE 1.0 END AS k
  FROM hx WINDOW w AS (PARTITION BY trial ORDER BY target_mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""

TO_OVERLAY = (*TO_LEDGER, OVERLAY)


def recosted(spark, sf):
    return A.recost(D.trial_ledger(spark, sf), TRADE, BORROW)


def overlaid(spark, sf):
    return shared_stage(spark, sf, "overlay", lambda: A.overlay(recosted(spark, sf), KEYS))


@query("i11_recost", with_(*TO_OVERLAY) + sel("cost_full", "x", src="rc"))
def recost(spark, sf):
    return out(recosted(spark, sf), "cost_full", "x")


@query("i12_hedge_ratio", with_(*TO_OVERLAY) + sel("h", src="kx"))
def hedge_ratio(spark, sf):
    return out(A.hedge_ratio(recosted(spark, sf), KEYS), "h")


@query("i13_vol_target", with_(*TO_OVERLAY) + sel("x_hedged", "k", src="kx"))
def vol_target(spark, sf):
    return out(A.overlay(recosted(spark, sf), KEYS), "x_hedged", "k")


SCALED = f"""kb AS (SELECT b.*, k.k, b.weight * k.k AS ws FROM book b JOIN kx k USING (trial, target_mi)),
ts AS (
  SELECT coalesce(a.trial, b.trial) AS trial, coalesce(a.target_mi, b.target_mi) AS target_mi, sum(abs(coalesce(a.ws, 0) - coalesce(b.ws, 0))) AS traded_s
  FROM kb a FULL JOIN (SELECT trial, target_mi + 1 AS target_mi, permno, ws FROM kb) b
    ON a.trial = b.trial AND a.target_mi = b.target_mi AND a.permno = b.permno GROUP BY 1, 2),
sb AS (
  SELECT kx.*, traded_s, traded_s * {TRADE} + short_gross * k * {BORROW} / 12 AS cost_s,
    cash + k * (total_gross - cash - h * coalesce(mx, 0)) - (traded_s * {TRADE} + short_gross * k * {BORROW} / 12) AS ret
  FROM kx JOIN ts USING (trial, target_mi)),
sc AS (SELECT *, 1e9 * exp(sum(ln(1 + ret)) OVER (PARTITION BY trial ORDER BY target_mi)) AS nav FROM sb),
scaled AS (SELECT *, coalesce(lag(nav) OVER (PARTITION BY trial ORDER BY target_mi), 1e9) AS nav_open FROM sc)"""


def scaled_rows(spark, sf):
    return shared_stage(spark, sf, "scaled", lambda: A.scale_book(overlaid(spark, sf), D.book(spark, sf), KEYS, TRADE, BORROW))


@query("i14_scale_book", with_(*TO_OVERLAY, SCALED) + sel("traded_s", "cost_s", "ret", src="scaled"))
def scale_book(spark, sf):
    return out(scaled_rows(spark, sf), "traded_s", "cost_s", "ret")


@query("i14_nav_open", with_(*TO_OVERLAY, SCALED) + f"SELECT trial, {label('target_mi')} AS month, {r6('nav_open / 1e9')} AS nav_open FROM scaled")
def nav_open(spark, sf):
    return out(scaled_rows(spark, sf).withColumn("nav_open", F.col("nav_open") / 1e9), "nav_open")


# Drifted overlay: hedge over the last rows as they are, then a recursion on the scaled book.
DRIFTED = f"""h2 AS (
  SELECT *, CASE WHEN count(*) OVER w >= 12 THEN regr_slope(x, mx) OVER w ELSE 0 END AS h
  FROM rc WINDOW w AS (PARTITION BY trial ORDER BY target_mi ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
h3 AS (SELECT *, x - h * mx AS x_hedged FROM h2),
k2 AS (
  SELECT *, CASE WHEN count(x_hedged) OVER w >= 12 AND stddev_samp(x_hedged) OVER w > 0
    THEN least(greatest(0.10 / (stddev_samp(x_hedged) OVER w * sqrt(12)), 0.25), 1.0) ELSE 1.0 END AS k
  FROM h3 WINDOW w AS (PARTITION BY trial ORDER BY target_mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
k3 AS (SELECT *, cash + k * (total_gross - cash) - k * h * mx AS gross_return, k * short_gross * {BORROW} / 12 AS other_cost FROM k2),
b2 AS (SELECT b.*, k.k, b.weight * k.k AS ws FROM book b JOIN k3 k USING (trial, target_mi)),
p2 AS (
  SELECT trial, target_mi, list({{'w': w, 'd': d}} ORDER BY permno) AS pairs FROM (
    SELECT coalesce(a.trial, b.trial) AS trial, coalesce(a.target_mi, b.target_mi) AS target_mi, coalesce(a.permno, b.permno) AS permno,
      coalesce(a.ws, 0) AS w, coalesce(b.d, 0) AS d
    FROM b2 a FULL JOIN (SELECT trial, target_mi + 1 AS target_mi, permno, ws * (1 + filled) AS d FROM b2) b
      ON a.trial = b.trial AND a.target_mi = b.target_mi AND a.permno = b.permno) GROUP BY 1, 2),
s2 AS (SELECT k3.*, p.pairs, row_number() OVER (PARTITION BY trial ORDER BY target_mi) AS n FROM k3 JOIN p2 p USING (trial, target_mi)),
f2 AS (
  SELECT trial, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS target_mi, CAST(0 AS DOUBLE) AS traded, CAST(0 AS DOUBLE) AS cost_s, CAST(0 AS DOUBLE) AS net_return
  FROM (SELECT DISTINCT trial FROM k3)
  UNION ALL
  SELECT trial, n, target_mi, tv, tv * {TRADE} + other_cost, gross_return - tv * {TRADE} - other_cost FROM (
    SELECT s.trial, s.n, s.target_mi, s.gross_return, s.other_cost,
      list_sum(list_transform(s.pairs, lambda e: abs(e.w - e.d / (1 + f.net_return)))) AS tv
    FROM f2 f JOIN s2 s ON s.trial = f.trial AND s.n = f.n + 1)),
d0 AS (SELECT k3.* EXCLUDE (hurdle), cash + 0.04 / 12 AS hurdle, f2.traded, f2.cost_s, f2.net_return, f2.traded / 2 AS one_way FROM k3 JOIN f2 USING (trial, target_mi) WHERE f2.n > 0),
d1 AS (SELECT *, 1e9 * exp(sum(ln(1 + net_return)) OVER (PARTITION BY trial ORDER BY target_mi)) AS nav FROM d0),
drifted AS (SELECT *, coalesce(lag(nav) OVER (PARTITION BY trial ORDER BY target_mi), 1e9) AS nav_start FROM d1)"""

TO_DRIFTED = (*TO_OVERLAY, DRIFTED)


def drifted_rows(spark, sf):
    return shared_stage(spark, sf, "drifted", lambda: A.scale_book_drifted(recosted(spark, sf), D.book(spark, sf), KEYS, TRADE, BORROW))


@query("i15_scale_book_drifted", with_(*TO_DRIFTED) + sel("k", "h", "gross_return", "traded", "cost_s", "net_return", src="drifted"))
def scale_book_drifted(spark, sf):
    return out(drifted_rows(spark, sf), "k", "h", "gross_return", "traded", "cost_s", "net_return")


SHARES = """ss AS (SELECT trial, target_mi, sector, sum(abs(weight)) AS sg FROM book GROUP BY 1, 2, 3),
shares AS (
  SELECT trial, target_mi, arg_max(sector, {'a': sg, 'b': -ascii(right(sector, 1))}) AS largest_sector, max(sg) / sum(sg) AS largest_sector_gross_share,
    coalesce(sum(sg) FILTER (sector = '12'), 0) / sum(sg) AS named_gross_share FROM ss GROUP BY 1, 2)"""

TOTALS = """sct AS (
  SELECT trial, target_mi, sector, count(*) FILTER (abs(weight * k) > 1e-6) AS n, sum(abs(weight * k)) AS g, sum(weight * k) AS net, max(abs(weight * k)) AS mx,
    min(me) FILTER (side < 0) AS sm, sum(weight * beta_use) AS eb FROM b2 GROUP BY 1, 2, 3),
totals AS (SELECT trial, target_mi, CAST(sum(n) AS BIGINT) AS names, sum(g) AS gross, sum(net) AS net, max(mx) AS max_name, min(sm) AS min_short_me,
  count(*) FILTER (g > 1e-6) AS sectors_held, max(abs(net)) AS max_sector_net, sum(eb) AS ex_ante_beta FROM sct GROUP BY 1, 2)"""

FLAGS = {"names": "NOT names BETWEEN 15 AND 20", "gross": "gross > 2.000001", "net": "abs(net) > 0.500001", "name5": "max_name > 0.050001"}
LEDGER_FLAGS = {**FLAGS, "short500": "short_usd < 5e8", "sectors5": "sectors_held < 5", "sector20": "max_sector_net > 0.200001"}
NAME_FLAGS = {**FLAGS, "short_me": "coalesce(min_short_me < 250000, FALSE)", "sectors5": "sectors_held < 5", "sector20": "max_sector_net > 0.200001"}


def flag_sql(flags):
    return ", ".join(f"{e} AS breach_{n}" for n, e in flags.items()) + ", " + " + ".join(f"CAST({e} AS BIGINT)" for e in flags.values()) + " AS breaches"


BREACHES = f"""mb AS (
  SELECT t.*, d.k * d.short_gross * d.nav_start * 1.25 AS short_usd FROM totals t JOIN drifted d USING (trial, target_mi)),
breach AS (SELECT *, {flag_sql({**LEDGER_FLAGS})} FROM mb)"""


def breach_rows(spark, sf):
    rows = drifted_rows(spark, sf)
    scaled = D.book(spark, sf).join(rows.select("trial", "target_mi", "k"), ["trial", "target_mi"])
    totals = H.scaled_book_totals(scaled, ["trial", "target_mi"])
    usd = rows.select("trial", "target_mi", (F.col("k") * F.col("short_gross") * F.col("nav_start") * 1.25).alias("short_usd"))
    return H.mandate_breaches(totals.join(usd, ["trial", "target_mi"]), 15, 20)


@query("i16_overlay_metrics", with_(*TO_DRIFTED, SHARES, TOTALS, BREACHES) + f"""
, wl AS (SELECT d.*, s.largest_sector_gross_share, s.named_gross_share, b.breaches,
    exp(sum(ln(1 + net_return)) OVER (PARTITION BY trial ORDER BY target_mi)) AS wealth
  FROM drifted d JOIN shares s USING (trial, target_mi) JOIN breach b USING (trial, target_mi)),
wd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY trial ORDER BY target_mi) - 1 AS dd FROM wl)
SELECT trial, {r6('sqrt(12) * avg(net_return - hurdle) / stddev_samp(net_return - hurdle)')} AS net_ir,
  {r6('sqrt(12) * avg(gross_return - hurdle) / stddev_samp(gross_return - hurdle)')} AS gross_ir,
  {r6('stddev_samp(net_return) * sqrt(12)')} AS vol, {r6('min(dd)')} AS max_drawdown, {r6('max(k * max_sector_net)')} AS max_sector_net,
  {r6('median(largest_sector_gross_share)')} AS sector_share_median, {r6('max(largest_sector_gross_share)')} AS sector_share_max,
  {r6('median(named_gross_share)')} AS named_share_median, {r6('max(named_gross_share)')} AS named_share_max,
  {r6('avg(one_way)')} AS monthly_one_way, {r6('avg(cost_s) * 12')} AS annual_cost, {r6('avg(k)')} AS mean_k,
  CAST(sum(breaches) AS BIGINT) AS breaches, count(*) FILTER (breaches > 0) AS months_with_breach FROM wd GROUP BY trial""")
def overlay_metrics(spark, sf):
    shares = A.sector_share_of_gross(D.book(spark, sf), KEYS, "12")
    shares = shares.join(breach_rows(spark, sf).select("trial", "target_mi", "breaches"), ["trial", "target_mi"])
    m = A.overlay_metrics(drifted_rows(spark, sf), shares, KEYS)
    whole = ("trial", "breaches", "months_with_breach")
    return m.select(*whole, *[near(c).alias(c) for c in m.columns if c not in whole])


@query("i17_beta_with_se", with_(*TO_LEDGER) + f"""
SELECT trial, {r6('regr_slope(y, x)')} AS beta, {r6('sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x))')} AS se
FROM (SELECT trial, total_net - cash AS y, market_return - cash AS x FROM ledger) GROUP BY trial""")
def beta_with_se(spark, sf):
    rows = D.trial_ledger(spark, sf).withColumn("y", F.col("total_net") - F.col("cash")).withColumn("xm", F.col("market_return") - F.col("cash"))
    b = A.beta_with_se(rows, KEYS, "y", "xm")
    return b.select("trial", near("beta").alias("beta"), near("se").alias("se"))


FILLED = """lab AS (
  SELECT permno, mi, coalesce(last_value(ticker IGNORE NULLS) OVER a, first_value(ticker IGNORE NULLS) OVER b) AS tick_f,
    coalesce(last_value(company_name IGNORE NULLS) OVER a, first_value(company_name IGNORE NULLS) OVER b) AS name_f
  FROM panel WINDOW a AS (PARTITION BY permno ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY permno ORDER BY mi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def month_end_sql(mi):
    return f"last_day(make_date(CAST(({mi} - 1) // 12 AS BIGINT), CAST(({mi} - 1) % 12 + 1 AS BIGINT), CAST(1 AS BIGINT)))"


@query("i18_usd_positions", with_(*TO_OVERLAY, SCALED, FILLED) + f"""
SELECT b.trial, {month_end_sql('(b.target_mi - 1)')} AS date, coalesce(b.ticker, l.tick_f) AS ticker, coalesce(b.company_name, l.name_f) AS name,
  round(b.weight * s.k * s.nav_open / 1000, 0) + 0.0 AS position_usd
FROM book b JOIN scaled s USING (trial, target_mi) JOIN lab l ON l.permno = b.permno AND l.mi = b.target_mi - 1
UNION ALL SELECT trial, {month_end_sql('(target_mi - 1)')}, 'HEDGE', 'index futures hedge', round(-h * k * nav_open / 1000, 0) + 0.0 FROM scaled""")
def usd_positions(spark, sf):
    labels = P.fill_labels(D.panel(spark, sf).select("permno", "mi", "ticker", "company_name"), ["ticker", "company_name"])
    labels = labels.select("permno", (F.col("mi") + 1).alias("target_mi"), "ticker_filled", "company_name_filled")
    book = D.book(spark, sf).join(labels, ["permno", "target_mi"])
    pos = A.usd_positions(book, scaled_rows(spark, sf), KEYS)
    # Thousands of dollars, so that the last bits of the compounded NAV do not decide a digit.
    return pos.withColumn("position_usd", F.round(F.col("position_usd") / 1000, 0))


@query("i19_sector_share_of_gross", with_(*TO_BOOK, SHARES) + f"""
SELECT trial, {label('target_mi')} AS month, largest_sector, {r6('largest_sector_gross_share')} AS largest_sector_gross_share,
  {r6('named_gross_share')} AS named_gross_share FROM shares""")
def sector_share_of_gross(spark, sf):
    # Rounded gross, so that equal sectors tie exactly and the earlier name wins.
    s = A.sector_share_of_gross(D.book(spark, sf), KEYS, "12")
    return out(s, "largest_sector_gross_share", "named_gross_share", exact=("largest_sector",))


@query("i20_bootstrap_ir", with_(*TO_LEDGER) + f"""
, nb AS (SELECT trial, total_net - hurdle AS active, row_number() OVER (PARTITION BY trial ORDER BY target_mi) - 1 AS slot, count(*) OVER (PARTITION BY trial) AS months FROM ledger),
dr AS (SELECT trial, rep, ('0x' || substr(md5('42:' || rep || ':' || slot), 1, 12))::BIGINT % months AS slot FROM nb, (SELECT unnest(generate_series(1, 500)) AS rep)),
ir AS (SELECT dr.trial, rep, sqrt(12) * avg(active) / nullif(stddev_samp(active), 0) AS ir FROM dr JOIN nb ON nb.trial = dr.trial AND nb.slot = dr.slot GROUP BY 1, 2)
SELECT trial, count(ir) AS reps, {r6('avg(ir)')} AS mean_ir, {r6('stddev_samp(ir)')} AS se_ir FROM ir GROUP BY 1""")
def bootstrap_ir(spark, sf):
    made = A.bootstrap_ir(D.trial_ledger(spark, sf), KEYS, 500, 42)
    return made.select("trial", "reps", near("mean_ir").alias("mean_ir"), near("se_ir").alias("se_ir"))
