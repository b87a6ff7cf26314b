"""SQL text of the shared inputs, as WITH clauses for the checks."""

LABEL = "printf('%04d-%02d', ({0} - 1) // 12, ({0} - 1) % 12 + 1)"


def label(expr: str) -> str:
    return LABEL.format(expr)


def r6(expr: str) -> str:
    """Six places; the small shift keeps exact halves from rounding either way."""
    return f"round(({expr}) + 3e-11, 6) + 0.0"


MONEY = "CAST({0} AS DECIMAL(18,2))"

PANEL = f"""cell AS (
  SELECT l_suppkey AS permno, year(l_shipdate) * 12 + month(l_shipdate) AS mi, count(*) AS lines,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS me,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc,
    CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax,
    CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(l_discount AS DECIMAL(14,2)) - CAST(l_tax AS DECIMAL(14,2))) AS DECIMAL(30,4))) AS DOUBLE) AS flow,
    CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(14,2)) AS DECIMAL(30,4))) AS DOUBLE) AS disc_value,
    max(l_discount) AS disc_max, max(l_tax) AS tax_max, max(l_returnflag) AS gvkey, max(l_linestatus) AS iid,
    stddev_samp(l_extendedprice / l_quantity) AS unit_sd, avg(l_extendedprice / l_quantity) AS unit_avg
  FROM lineitem GROUP BY 1, 2),
rates AS (SELECT mi, CAST(sum(CAST(tax AS DECIMAL(18,2))) AS DOUBLE) / sum(lines) * 100 AS rate FROM cell GROUP BY 1),
priced AS (SELECT *, me / qty AS prc FROM cell),
hist AS (
  SELECT p.*, r.rate, r.rate / 1200 AS cash,
    CASE WHEN lag(p.mi) OVER w = p.mi - 1
         THEN 0.2 * least(greatest(prc / lag(prc) OVER w - 1, -0.5), 0.5) END AS ret,
    sum(me) OVER (PARTITION BY permno ORDER BY p.mi ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS dolvol_126d,
    lag(prc, 1) OVER w / lag(prc, 12) OVER w - 1 AS ret_12_1
  FROM priced p JOIN rates r ON p.mi = r.mi WINDOW w AS (PARTITION BY permno ORDER BY p.mi)),
panel AS (
  SELECT h.permno, h.mi, {label('h.mi')} AS month,
    last_day(make_date(CAST((h.mi - 1) // 12 AS BIGINT), CAST((h.mi - 1) % 12 + 1 AS BIGINT), CAST(1 AS BIGINT))) AS eom,
    lines, me, prc, qty, disc_value, cash, rate, ret, ret - cash AS ret_exc,
    CASE WHEN lead(h.mi) OVER w = h.mi + 1 THEN lead(ret - cash) OVER w END AS ret_exc_lead1m,
    dolvol_126d, ret_12_1,
    CASE WHEN h.permno % 97 <> 0 THEN printf('1%d%02d10', n_regionkey, n_nationkey) END AS gics,
    ['nano', 'micro', 'small', 'large', 'mega'][ntile(5) OVER (PARTITION BY h.mi ORDER BY me, h.permno)] AS size_grp,
    CASE WHEN lines >= 3 THEN disc / lines * 20 END AS betabab_1260d,
    tax / lines * 25 AS betadown_252d, CAST(1.0 AS DOUBLE) AS beta_60m,
    round(unit_sd / unit_avg, 10) AS rvol_21d, flow / me AS ni_me,
    disc / lines AS avg_disc, tax / lines AS avg_tax,
    CASE WHEN (h.permno + h.mi) % 11 <> 0 THEN 'T' || (h.permno % 37) END AS ticker,
    CASE WHEN (h.permno + h.mi) % 7 <> 0 THEN s_name END AS company_name,
    gvkey, iid, ret AS ret_1_0, me AS market_equity,
    CASE WHEN lines >= 6 THEN disc_max END AS disc_top,
    CASE WHEN lines >= 9 THEN tax_max END AS tax_top,
    CASE WHEN lines >= 4 THEN qty / lines END AS qty_line
  FROM hist h JOIN supplier ON s_suppkey = h.permno JOIN nation ON n_nationkey = s_nationkey
  WINDOW w AS (PARTITION BY h.permno ORDER BY h.mi))"""

FORECASTS = f"""forecasts AS (
  SELECT permno, mi + 1 AS target_mi, avg_disc * 0.4 - avg_tax * 0.2 - 0.01 AS forecast, avg_tax * 0.2 AS alt_forecast
  FROM panel WHERE {label('(mi + 1)')} BETWEEN '1995-02' AND '2001-07')"""

FILINGS = """filings AS (
  SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS filing_date,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS content_report_date,
    'T' || ((l_suppkey + l_linenumber % 2) % 37) AS ticker, l_orderkey * 10 + l_linenumber AS document_id,
    l_returnflag = 'R' AS is_amendment, CASE WHEN l_linenumber <> 5 THEN l_suppkey END AS cik,
    year(l_shipdate) * 12 + month(l_shipdate) AS mi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def unit_rank(value: str, part: str) -> str:
    """Average-tie rank of a non-null value inside `part` (a partition list)."""
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) "
            f"+ (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)")


JOINED = """joined AS (
  SELECT f.permno, f.target_mi, f.forecast, f.alt_forecast, p.mi AS observed_mi, p.eom, p.prc, p.me, p.size_grp, p.gics,
    p.rvol_21d, p.dolvol_126d, p.ticker, p.company_name, p.ni_me,
    least(greatest(coalesce(p.betabab_1260d, p.betadown_252d, p.beta_60m), -0.5), 3.5) AS beta_use,
    coalesce(substr(p.gics, 1, 2), 'na') AS sector
  FROM forecasts f JOIN panel p ON p.permno = f.permno AND p.mi = f.target_mi - 1)"""

PE = """pe_hist AS (
  SELECT permno, mi, ni_me, list(ni_me) OVER (PARTITION BY permno ORDER BY mi ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS past
  FROM panel),
pe AS (
  SELECT permno, mi, CASE WHEN ni_me > 0 AND len(past) >= 36 THEN
    1 - (len(list_filter(past, lambda x: x < ni_me)) + (len(list_filter(past, lambda x: x = ni_me)) + 1) / 2.0) / len(past) END AS pe_pct
  FROM pe_hist)"""

UNIVERSE = """universe AS (
  SELECT j.*, pe.pe_pct FROM joined j LEFT JOIN pe ON pe.permno = j.permno AND pe.mi = j.observed_mi
  WHERE abs(prc) >= 1500 AND size_grp NOT IN ('nano', 'micro') AND beta_use IS NOT NULL AND rvol_21d > 0 AND me > 0)"""

SCORED = f"""ur AS (
  SELECT *, {unit_rank('forecast', 'target_mi')} AS rf, {unit_rank('me', 'target_mi')} AS rm FROM universe),
uz AS (
  SELECT *, (rf - avg(rf) OVER m) / coalesce(nullif(stddev_pop(rf) OVER m, 0), 1) AS signal,
    (rm - avg(rm) OVER m) / coalesce(nullif(stddev_pop(rm) OVER m, 0), 1) AS size
  FROM ur WINDOW m AS (PARTITION BY target_mi)),
dm AS (
  SELECT *, signal - avg(signal) OVER s AS dy, size - avg(size) OVER s AS d1, beta_use - avg(beta_use) OVER s AS d2
  FROM uz WINDOW s AS (PARTITION BY target_mi, sector)),
ne AS (
  SELECT target_mi, sum(d1*d1) AS s11, sum(d1*d2) AS s12, sum(d2*d2) AS s22, sum(d1*dy) AS s1y, sum(d2*dy) AS s2y
  FROM dm GROUP BY 1),
sl AS (
  SELECT target_mi,
    CASE WHEN s11*s22 - s12*s12 > 1e-12*s11*s22 THEN (s22*s1y - s12*s2y)/(s11*s22 - s12*s12) WHEN s11 > 0 THEN s1y/s11 ELSE 0 END AS b1,
    CASE WHEN s11*s22 - s12*s12 > 1e-12*s11*s22 THEN (s11*s2y - s12*s1y)/(s11*s22 - s12*s12) WHEN s11 > 0 THEN 0
         WHEN s22 > 0 THEN s2y/s22 ELSE 0 END AS b2 FROM ne),
resid AS (SELECT dm.*, dy - b1*d1 - b2*d2 AS residual FROM dm JOIN sl USING (target_mi)),
scored AS (
  SELECT *, round(avg(residual) OVER (PARTITION BY permno ORDER BY target_mi ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 10) + 0.0 AS score
  FROM resid)"""

TO_UNIVERSE = (PANEL, FORECASTS, JOINED, PE, UNIVERSE)
TO_SCORED = (*TO_UNIVERSE, SCORED)


def _pick(ids: str, held: str, n: str, zone: str, skip_kept: str, skip_fill: str) -> tuple[str, str]:
    """SQL for the retained ids and for the ids that fill up to n (given `kept`)."""
    kept = f"list_filter(list_filter({ids}[1:{zone}], lambda p: list_contains({held}, p) AND NOT list_contains({skip_kept}, p)), lambda p, i: i <= {n})"
    fill = f"list_filter(list_filter({ids}, lambda p: NOT list_contains(kept, p) AND NOT list_contains({skip_fill}, p)), lambda p, i: i <= {n} - len(kept))"
    return kept, fill


def selection(n_long: int, n_short: int, exclude_kept: bool, name: str = "picks") -> str:
    """Whole-order lists per month, then one recursion step per month."""
    zl, zs = int(n_long * 2.5), int(n_short * 2.5)
    none = "CAST([] AS BIGINT[])"
    kept_l, fill_l = _pick("o.ids_l", "s.hl", str(n_long), str(zl), "s.hs" if exclude_kept else none, "s.hs")
    kept_s, fill_s = _pick("ids_s", "hs0", str(n_short), str(zs), "longs", "longs")
    return f"""ords AS (
  SELECT target_mi, list(permno ORDER BY score DESC, permno) AS ids_l,
    coalesce(list(permno ORDER BY score, permno DESC) FILTER (me >= 200000), {none}) AS ids_s,
    row_number() OVER (ORDER BY target_mi) AS k FROM scored GROUP BY 1),
sel AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS target_mi, {none} AS hl, {none} AS hs
  UNION ALL
  SELECT k, target_mi, longs, list_concat(kept, {fill_s}) FROM (
    SELECT *, {kept_s} AS kept FROM (
      SELECT k, target_mi, ids_s, hs0, list_concat(kept, {fill_l.replace('o.ids_l', 'ids_l').replace('s.hs', 'hs0')}) AS longs FROM (
        SELECT o.k, o.target_mi, o.ids_l, o.ids_s, s.hs AS hs0, {kept_l} AS kept FROM sel s JOIN ords o ON o.k = s.k + 1)))),
{name} AS (
  SELECT target_mi, 1 AS side, unnest(hl) AS permno, unnest(generate_series(1, len(hl))) AS place FROM sel WHERE k > 0
  UNION ALL SELECT target_mi, -1, unnest(hs), unnest(generate_series(1, len(hs))) FROM sel WHERE k > 0)"""


CANDIDATES = selection(10, 10, False) + """,
candidates AS (SELECT s.*, p.side, p.place FROM picks p JOIN scored s USING (target_mi, permno))"""

TO_CANDIDATES = (*TO_SCORED, CANDIDATES)

QUOTA = """sup AS (SELECT target_mi, sector, count(*) AS names, count(*) FILTER (me >= 200000) AS short_names FROM scored GROUP BY 1, 2),
want AS (
  SELECT *, least(names, short_names) AS cap,
    least(least(names, short_names), 10 * names // CAST(sum(names) OVER (PARTITION BY target_mi) AS BIGINT)) AS want FROM sup),
rem AS (SELECT target_mi, 10 - CAST(sum(want) AS BIGINT) AS rem FROM want GROUP BY 1),
slot AS (
  SELECT target_mi, sector, row_number() OVER (PARTITION BY target_mi ORDER BY j DESC, sector DESC) AS n FROM (
    SELECT target_mi, sector, unnest(generate_series(1, cap - want)) AS j FROM want WHERE cap > want)),
extra AS (SELECT target_mi, sector, count(*) AS extra FROM slot JOIN rem USING (target_mi) WHERE n <= rem GROUP BY 1, 2),
quota AS (
  SELECT w.target_mi, w.sector, names, short_names, CAST(want + coalesce(extra, 0) AS INTEGER) AS slots
  FROM want w LEFT JOIN extra e ON e.target_mi = w.target_mi AND e.sector = w.sector)"""


def balanced() -> str:
    none = "CAST([] AS BIGINT[])"
    kept_l, fill_l = _pick("ids_l", "hl0", "slots", "zone", none, none)
    kept_s, fill_s = _pick("ids_s", "hs0", "slots", "zone", "longs", "longs")
    return f"""cells AS (
  SELECT q.target_mi, q.sector, q.slots, CAST(floor(q.slots * 2.5) AS BIGINT) AS zone,
    (SELECT list(permno ORDER BY score DESC, permno) FROM scored s WHERE s.target_mi = q.target_mi AND s.sector = q.sector) AS ids_l,
    (SELECT list(permno ORDER BY score, permno) FROM scored s WHERE s.target_mi = q.target_mi AND s.sector = q.sector AND me >= 200000) AS ids_s,
    dense_rank() OVER (ORDER BY q.target_mi) AS k FROM quota q WHERE q.slots > 0),
bal AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS target_mi, {none} AS hl, {none} AS hs
  UNION ALL
  SELECT k, target_mi, flatten(list(longs ORDER BY sector)), flatten(list(shorts ORDER BY sector)) FROM (
    SELECT k, target_mi, sector, longs, list_concat(kept, {fill_s}) AS shorts FROM (
      SELECT *, {kept_s} AS kept FROM (
        SELECT k, target_mi, sector, slots, zone, ids_s, hs0, list_concat(kept, {fill_l}) AS longs FROM (
          SELECT *, {kept_l} AS kept FROM (
            SELECT c.*, b.hl AS hl0, b.hs AS hs0 FROM bal b JOIN cells c ON c.k = b.k + 1))))) GROUP BY k, target_mi),
bpicks AS (
  SELECT target_mi, 1 AS side, unnest(hl) AS permno FROM bal WHERE k > 0
  UNION ALL SELECT target_mi, -1, unnest(hs) FROM bal WHERE k > 0),
bcand AS (SELECT s.*, p.side FROM bpicks p JOIN scored s USING (target_mi, permno))"""


TO_BALANCED = (*TO_SCORED, QUOTA, balanced())


def spread(name: str, src: str, part: str, appeal: str, budget: str, cap: str, floor: str, tie: str, out: str) -> str:
    """CTEs that share a budget by appeal with a floor and a cap, frozen rows first."""
    o = f"PARTITION BY {part} ORDER BY {appeal} DESC, {tie}"
    return f"""{name}_a AS (
  SELECT *, {budget} AS sb, {cap} AS sc, {floor} AS sf, row_number() OVER ({o}) AS si, count(*) OVER (PARTITION BY {part}) AS sn,
    sum({appeal}) OVER ({o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS st FROM {src}),
{name}_b AS (SELECT *, CAST(sf + (sb - (si - 1) * sc - (sn - si + 1) * sf) * {appeal} / st > sc AS INTEGER) AS sh FROM {name}_a),
{name}_c AS (SELECT *, min(sh) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sz FROM {name}_b),
{name} AS (
  SELECT * EXCLUDE (sb, sc, sf, si, sn, st, sh, sz), CASE WHEN sz = 1 THEN sc ELSE
    sf + (sb - sum(sz) OVER q * sc - (sn - sum(sz) OVER q) * sf) * {appeal} / sum(CASE WHEN sz = 0 THEN {appeal} END) OVER q END AS {out}
  FROM {name}_c WINDOW q AS (PARTITION BY {part}))"""


def inverse_vol(name: str, src: str, part: str, budget: str, cap: str, out: str) -> str:
    return f"""{name}_v AS (
  SELECT *, 1 / least(greatest(rvol_21d, quantile_cont(rvol_21d, 0.05) OVER p), quantile_cont(rvol_21d, 0.95) OVER p) AS inv,
    least({budget}, count(*) OVER p * {cap}) AS ib FROM {src} WINDOW p AS (PARTITION BY {part})),
{spread(name + '_s', name + '_v', part, 'inv', 'ib', cap, '0.0', 'permno', out)},
{name} AS (SELECT * EXCLUDE (inv, ib) FROM {name}_s)"""


def beta_matched(name: str, src: str, keys: str) -> str:
    """Needs columns gross_limit, position_limit, net_min, net_max."""
    leg = f"{keys}, side"
    return f"""{inverse_vol(name + '1', src, leg, '1.0', '1.0', 'shr')},
{name}2 AS (
  SELECT *, sum(CASE WHEN side > 0 THEN shr * beta_use END) OVER m AS bl, sum(CASE WHEN side < 0 THEN shr * beta_use END) OVER m AS bs,
    count(*) FILTER (side > 0) OVER m AS nl, count(*) FILTER (side < 0) OVER m AS ns FROM {name}1 WINDOW m AS (PARTITION BY {keys})),
{name}3 AS (SELECT *, least(greatest(2 * CASE WHEN bl > 0 AND bs > 0 THEN gross_limit * bs / (bl + bs) ELSE gross_limit / 2 END - gross_limit, net_min), net_max) AS bnet FROM {name}2),
{name}4 AS (SELECT *, (gross_limit + bnet) / 2 AS lb, gross_limit - (gross_limit + bnet) / 2 AS hb FROM {name}3),
{name}5 AS (
  SELECT *, CASE WHEN side > 0 THEN lb ELSE hb END
    * least(1.0, nl * position_limit / greatest(lb, 1e-12), ns * position_limit / greatest(hb, 1e-12)) AS bud FROM {name}4),
{inverse_vol(name + '6', name + '5', leg, 'bud', 'position_limit', 'aw')},
{name} AS (SELECT * EXCLUDE (shr, bl, bs, nl, ns, bnet, lb, hb, bud, aw), side * aw AS weight FROM {name}6)"""


def rank_tilt(name: str, src: str, keys: str, kind: str) -> str:
    """Needs columns gross_limit, position_limit, minimum_position_weight."""
    leg = f"{keys}, sector, side"
    tilt = {"flat": "1.0", "linear": "CAST(rc - rp + 1 AS DOUBLE)", "steep": "1.0 / rp"}[kind]
    return f"""{name}1 AS (
  SELECT *, row_number() OVER (PARTITION BY {leg} ORDER BY side * score DESC, permno) AS rp, count(*) OVER (PARTITION BY {leg}) AS rc,
    count(*) FILTER (side > 0) OVER (PARTITION BY {keys}) AS nl FROM {src}),
{name}2 AS (SELECT *, {tilt} AS tl, greatest(least(gross_limit / 2 * rc / nl, rc * position_limit), rc * minimum_position_weight) AS rb FROM {name}1),
{spread(name + '3', name + '2', leg, 'tl', 'rb', 'position_limit', 'minimum_position_weight', 'rp', 'aw')},
{name} AS (SELECT * EXCLUDE (rp, rc, nl, tl, rb, aw), side * aw AS weight FROM {name}3)"""


SCHED_COLS = "target_mi, permno, side, sector, score, forecast, rvol_21d, beta_use, size, me, dolvol_126d, pe_pct, ticker, company_name"

BOOK = f"""trials(trial, schedule, rule, gross_limit, position_limit, trading_cost_bps) AS (
  SELECT * FROM (VALUES ('matched_1.0', 'global', 'beta_matched', CAST(1.0 AS DOUBLE), CAST(0.08 AS DOUBLE), CAST(20.0 AS DOUBLE)),
    ('matched_0.75', 'global', 'beta_matched', 0.75, 0.05, 35.0), ('steep_0.75', 'balanced', 'rank_steep', 0.75, 0.06, 20.0),
    ('equal_1.0', 'global', 'equal', 1.0, 0.08, 20.0)) t),
tset AS (SELECT *, CAST(-0.1 AS DOUBLE) AS net_min, CAST(0.1 AS DOUBLE) AS net_max, CAST(0.001 AS DOUBLE) AS minimum_position_weight FROM trials),
sched AS (SELECT {SCHED_COLS}, 'global' AS schedule FROM candidates UNION ALL SELECT {SCHED_COLS}, 'balanced' FROM bcand),
tb AS (SELECT * FROM sched JOIN tset USING (schedule)),
tb_m AS (SELECT * FROM tb WHERE rule = 'beta_matched'), tb_s AS (SELECT * FROM tb WHERE rule = 'rank_steep'),
{beta_matched('wm', 'tb_m', 'trial, target_mi')},
{rank_tilt('ws', 'tb_s', 'trial, target_mi', 'steep')},
we AS (SELECT *, side * gross_limit / count(*) OVER (PARTITION BY trial, target_mi) AS weight FROM tb WHERE rule = 'equal'),
sized AS (SELECT * FROM wm UNION ALL BY NAME SELECT * FROM ws UNION ALL BY NAME SELECT * FROM we),
book AS (
  SELECT s.*, p.ret AS raw_return, coalesce(p.ret, 0) AS filled,
    least(greatest(3 * 0.1 * coalesce(dolvol_126d_, 0) / 2e7, minimum_position_weight), position_limit) AS liquidity_limit,
    3 * 0.1 * coalesce(dolvol_126d_, 0) / 2e7 AS liquidity_uncapped
  FROM (SELECT *, dolvol_126d AS dolvol_126d_ FROM sized) s LEFT JOIN panel p ON p.permno = s.permno AND p.mi = s.target_mi)"""

MARKET = """lv AS (SELECT CAST(o_orderdate AS DATE) AS dt, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS level FROM orders GROUP BY 1),
lm AS (SELECT year(dt) * 12 + month(dt) AS mi, max_by(level, dt) AS level FROM lv GROUP BY 1),
mraw AS (SELECT mi, level / lag(level) OVER (ORDER BY mi) - 1 AS mr FROM lm),
market AS (SELECT mi, 0.2 * least(greatest(mr, -0.5), 0.5) AS market_return FROM mraw WHERE mr IS NOT NULL
  UNION ALL SELECT mi, NULL FROM mraw WHERE mr IS NULL)"""

CASH = "cashm AS (SELECT mi, max(cash) AS cash, max(rate) AS rate FROM panel GROUP BY 1)"

PAIRS = """pairs AS (
  SELECT trial, target_mi, list({'w': w, 'd': d} ORDER BY permno) AS pairs FROM (
    SELECT coalesce(a.trial, b.trial) AS trial, coalesce(a.target_mi, b.target_mi) AS target_mi, coalesce(a.permno, b.permno) AS permno,
      coalesce(a.weight, 0) AS w, coalesce(b.d, 0) AS d
    FROM book a FULL JOIN (SELECT trial, target_mi + 1 AS target_mi, permno, weight * (1 + filled) AS d FROM book) b
      ON a.trial = b.trial AND a.target_mi = b.target_mi AND a.permno = b.permno)
  GROUP BY 1, 2)"""

LEDGER = f"""{MARKET},
{CASH},
gr AS (SELECT b.trial, b.target_mi, max(c.cash) AS cash, max(c.cash) + sum(weight * (filled - c.cash)) AS total_gross,
    max(trading_cost_bps) / 10000 AS rate_c FROM book b JOIN cashm c ON c.mi = b.target_mi GROUP BY 1, 2),
{PAIRS},
steps AS (SELECT g.*, p.pairs, row_number() OVER (PARTITION BY g.trial ORDER BY g.target_mi) AS k FROM gr g JOIN pairs p USING (trial, target_mi)),
fold AS (
  SELECT trial, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS target_mi, CAST(0 AS DOUBLE) AS turnover, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS total_net
  FROM (SELECT DISTINCT trial FROM gr)
  UNION ALL
  SELECT trial, k, target_mi, tv, tv * rate_c, total_gross - tv * rate_c FROM (
    SELECT s.trial, s.k, s.target_mi, s.rate_c, s.total_gross,
      list_sum(list_transform(s.pairs, lambda x: abs(x.w - x.d / (1 + f.total_net)))) AS tv
    FROM fold f JOIN steps s ON s.trial = f.trial AND s.k = f.k + 1)),
sexp AS (SELECT trial, target_mi, sector, sum(weight) AS sn, sum(abs(weight)) AS sg FROM book GROUP BY 1, 2, 3),
ex AS (
  SELECT trial, target_mi, sum(abs(weight)) AS gross, sum(weight) AS net, max(abs(weight)) AS max_weight, sum(weight * beta_use) AS market_beta,
    sum(weight * size) AS size_exposure, count(*) FILTER (abs(weight) > 1e-6) AS positions,
    count(*) FILTER (raw_return IS NULL) AS missing_return_positions, coalesce(sum(abs(weight)) FILTER (raw_return IS NULL), 0) AS missing_return_gross,
    coalesce(sum(-weight) FILTER (weight < 0), 0) AS short_gross FROM book GROUP BY 1, 2),
sx AS (SELECT trial, target_mi, max(abs(sn)) AS max_sector_net FROM sexp GROUP BY 1, 2),
ledger AS (
  SELECT f.trial, f.target_mi, f.turnover, f.cost, f.total_net, g.cash, g.total_gross, e.gross, e.net, e.max_weight, e.market_beta, e.size_exposure,
    e.positions, e.missing_return_positions, e.missing_return_gross, e.short_gross, sx.max_sector_net, f.turnover / 2 AS one_way_turnover,
    c.rate / 1200 + 0.04 / 12 AS hurdle, m.market_return
  FROM fold f JOIN gr g USING (trial, target_mi) JOIN ex e USING (trial, target_mi) JOIN sx USING (trial, target_mi)
    JOIN cashm c ON c.mi = f.target_mi LEFT JOIN market m ON m.mi = f.target_mi WHERE f.k > 0)"""

TO_BOOK = (*TO_SCORED, CANDIDATES, QUOTA, balanced(), BOOK)
TO_LEDGER = (*TO_BOOK, LEDGER)
