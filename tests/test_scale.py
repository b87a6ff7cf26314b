"""How the work of the panel queries grows: plans, and results beside the plain form."""

import random
import re

import numpy as np
import pyarrow as pa

from crossweave.operators import accounting as A
from crossweave.operators import boosting as B
from crossweave.operators import columnar as C
from crossweave.operators import crosssection as X
from crossweave.operators import ranks as R
from crossweave.operators import signals as K
from crossweave.session import stage
from crossweave.sources import demo_tables as D

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_cell_meet_before_they_are_summed(spark, monkeypatch):
    """Sums made in the map tasks sorted each task's lines by cell, spilled, and sent more bytes than the lines have."""
    made = {}

    def keep(df, tag):
        made[tag] = df
        return df

    monkeypatch.setattr(D, "stage", keep)
    D.build_panel(spark, SF)
    below = plan(made["cells"]).split("REPARTITION_BY_COL")[1].split("BroadcastExchange")[0]
    assert "Aggregate" not in below and "Sort" not in below


def test_size_bounds_split_like_ntile(spark):
    rng = random.Random(5)
    rows = [(1, p, float(rng.randrange(4))) for p in range(23)] + [(2, p, 1.0) for p in range(3)] + [(3, 7, 2.0)] + [(4, p, float(-p)) for p in range(10)]
    cells = spark.createDataFrame(rows, "mi int, permno long, me double")
    bounds = {r.mi: [tuple(b) for b in r["__bounds"]] for r in D._size_bounds(cells).collect()}
    for month in (1, 2, 3, 4):
        names = sorted((me, p) for mi, p, me in rows if mi == month)
        small, extra = divmod(len(names), 5)
        want = [q for q in range(1, 6) for _ in range(small + (q <= extra))]
        assert [1 + sum(b < x for b in bounds[month]) for x in names] == want


def test_cents_round_halves_away_from_zero(spark):
    rows = spark.createDataFrame([(v,) for v in (1.005, -1.005, 0.07, 1.23, -0.29, 104949.5, None)], "x double")
    assert [r[0] for r in rows.select(D._cents("x")).collect()] == [101, -101, 7, 123, -29, 10494950, None]


def test_equal_sectors_tie_whatever_the_order_of_their_sums(spark):
    """Ten times 0.1 is a bit less than 0.5 + 0.5 in doubles: the earlier name still wins, as in the SQL."""
    rows = [("t", 1, "11", 0.1 if i % 2 else -0.1) for i in range(10)] + [("t", 1, "12", 0.5), ("t", 1, "12", -0.5)]
    book = spark.createDataFrame(rows, "trial string, target_mi int, sector string, weight double").coalesce(1)
    assert A.sector_share_of_gross(book, ["trial"], "12").first().largest_sector == "11"


def test_small_batches_meet_a_tree_together(monkeypatch):
    """Each small batch used to walk its rows down the tree by itself, and rows that a round does not draw went along."""
    rng = np.random.default_rng(1)
    bins, labels = rng.integers(0, 64, (500, 3)).astype(np.int8), rng.normal(size=500)

    def batch(a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array([1998] * (b - a), pa.int32()), pa.array([True] * (b - a)), pa.array(list(bins[a:b]), pa.list_(pa.int8())),
             pa.array([[v] for v in labels[a:b]]), pa.array([[0.0]] * (b - a)), pa.array(np.arange(a, b) * 7919)],
            names=["fold", "train", "bins", "labels", "state", "draw"])

    tree = B.Tree()
    frontier = list(tree.split(0, 1, 30, False, 1.0, (0.1, -0.1)))
    fit = B.Fit(1998, 0, 0, {}, 0.0, growing=tree, frontier=frontier, features=np.array([0, 2]))
    walked, walk = [], B.leaf_of

    def counted(t, x):
        walked.append(len(x))
        return walk(t, x)

    monkeypatch.setattr(B, "leaf_of", counted)
    out = next(B._histograms([fit], 0, False, 0.7, 63)(batch(a, a + 10) for a in range(0, 500, 10)))
    drawn = B._drawn(np.arange(500) * 7919, 0, 0.7)
    assert walked == [drawn.sum()]
    side = np.where((bins[:, 1] > 0) & (bins[:, 1] <= 30), frontier[0], frontier[1])
    for node, j, sums in zip(*(out.column(c).to_pylist() for c in ("node", "feature", "sums"))):
        here = drawn & (side == node)
        want = [np.bincount(bins[here, j], labels[here], 64), np.bincount(bins[here, j], minlength=64)]
        np.testing.assert_allclose(np.frombuffer(sums, "<f8").reshape(2, 64), want, atol=1e-12)


def test_lines_travel_once_to_their_history(spark, monkeypatch):
    """The supplier months used to be sent again, to where their supplier's other months are."""
    made = {}
    monkeypatch.setattr(D, "stage", lambda df, tag: made.setdefault(tag, df))
    D.build_panel(spark, SF)
    by = re.findall(r"hashpartitioning\(([^()]*)\), REPARTITION_BY_COL", plan(made["cells"]))
    assert by and all("permno#" in keys and "mi#" not in keys for keys in by)


def test_panel_is_written_once(spark, monkeypatch):
    tags, shared = [], D.shared_stage

    def keep(session, source, tag, *rest):
        tags.append(tag)
        return shared(session, source, tag, *rest)

    monkeypatch.setattr(D, "shared_stage", keep)
    D.panel(spark, SF)
    assert tags == ["cells", "size_bounds"]


def test_rows_at_equals_row_numbers(spark):
    """Also for odd values and steps that hold most rows; before, every row was dealt and numbered for four places a month."""
    rng = random.Random(3)
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -1.5, 1e300, 1e-300, None]
    rows = [(g, p, rng.choice([*odd, 7.0, 7.0, rng.gauss(0, 3)])) for g in (1, 2, None) for p in range(150)] + [(5, 0, 2.0), (6, 0, None)]
    df = spark.createDataFrame(rows, "g int, permno long, v double")
    got = R.rows_at(df, ["g"], "v", "permno", lambda n: R.F.array(R.F.lit(1).cast("long"), R.F.floor(n / 3), n, n)).collect()
    for g in (1, 2, None, 5):
        known = [(v if v == v else float("inf"), v != v, p) for h, p, v in rows if h == g and v is not None]
        order = [p for *_, p in sorted(known)]
        want = sorted((at, order[at - 1]) for at in (1, len(order) // 3, len(order), len(order)) if at)
        assert sorted((r["__place"], r.permno) for r in got if r.g == g) == want
    assert {r.g for r in got} == {1, 2, None, 5}


def test_numbered_table_is_not_written_again(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, i, float(i * 7 % 5)) for i in range(200)], "g int, permno long, v double").repartition(4)
    plain = C.ranked_columns(df, ["g"], {"v": "r"}, "average").collect()
    table, tags, write = stage(C.numbered(df), "t"), [], C.stage
    monkeypatch.setattr(C, "stage", lambda rows, tag, **kw: tags.append(tag) or write(rows, tag, **kw))
    out = C.ranked_columns(table, ["g"], {"v": "r"}, "average")
    assert sorted(out.collect()) == sorted(plain) and out.columns == ["g", "permno", "v", "r"]
    assert tags == ["places"]


def test_fit_goes_to_the_rows(spark):
    """The join with the month's fit used to send all rows by month and sector."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(100).selectExpr("id % 3 AS m", "id % 2 AS s", "id * 1.0 AS y", "id % 7 * 1.0 AS x", "id % 5 * 1.0 AS z")
        top = plan(X.neutralise(df, "y", "x", "z", "m", "s", "r")).split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in top and "Exchange hashpartitioning" not in top
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_percentile_meets_rows_where_the_lagged_join_left_them(spark):
    from crossweave.operators import prep as P
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        panel = spark.range(400).selectExpr("id % 5 AS permno", "CAST(id DIV 5 AS INT) AS mi", "id % 13 * 1.0 AS ni_me")
        rows = P.lagged_join(panel.selectExpr("permno", "mi + 1 AS target_mi", "1.0 AS forecast"), panel, checks=D.Checks())
        old, new = X.attach_trailing_percentile(rows, panel), X.attach_trailing_percentile(rows, panel, month="target_mi", ahead=1)
        assert plan(new).count("Exchange hashpartitioning") == plan(old).count("Exchange hashpartitioning") - 1
        assert sorted(old.select(*new.columns).collect(), key=str) == sorted(new.collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_yoy_signal_moves_rows_once_and_equals_the_joins(spark):
    """Copies, gaps, nulls and months without a panel row; the joins sent the series six times."""
    rng = random.Random(9)
    F = R.F
    rows = [(d, rng.choice([1, 2, 3, None]), rng.choice([*range(1, 40), None]), rng.choice([None, 0.0, -2.0, 1.5, 4.0])) for d in ("a", "b", None) for _ in range(300)]
    series = spark.createDataFrame(rows, "d string, permno long, mi int, value double")
    panel = spark.createDataFrame([(p, m) for p in (1, 2, None) for m in range(1, 42) if rng.random() < 0.8] + [(1, 14), (1, 14)], "permno long, mi int")
    known = series.join(panel, ["permno", "mi"], "left_semi")
    num, den = (known.select("d", "permno", (F.col("mi") + n).alias("mi"), F.col("value").alias(c)) for n, c in ((1, "n"), (13, "v")))
    pair = num.join(den, ["d", "permno", "mi"]).filter("n IS NOT NULL AND v <> 0").join(panel, ["permno", "mi"], "left_semi")
    want = pair.select("d", "permno", "mi", (F.col("n") / F.col("v") - 1).alias("growth")).collect()
    got = K.yoy_signal(series, panel, ["d"])
    steps = plan(got)
    assert steps.count("Exchange hashpartitioning") == 1 and "Join" not in steps
    assert len(want) > 50 and sorted(got.collect()) == sorted(want)


def test_terciles_sort_only_rows_near_their_bounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(m, s, p, float(rng.randrange(-3, 9)), rng.gauss(0, 1)) for m in (1, 2) for s, n in (("x", 60), ("y", 2), ("z", 31)) for p in range(n)]
    d = spark.createDataFrame(rows, "mi int, sector string, permno long, growth double, ret_exc_lead1m double")
    dealt, split = [], R.split_rank
    monkeypatch.setattr(R, "split_rank", lambda df, *a, **kw: dealt.append(df) or split(df, *a, **kw))
    got = {r.mi: (r.ls, r.names, r.sectors) for r in K.sector_tercile_spread(d).collect()}
    assert dealt[0].count() < 100  # of 186
    for m in (1, 2):
        total = 0.0
        for s in "xz":
            own = sorted((g, p, r) for a, b, p, g, r in rows if (a, b) == (m, s))
            k = len(own) // 3
            total += len(own) * (sum(r for *_, r in own[-k:]) - sum(r for *_, r in own[:k])) / k
        assert got[m][1:] == (93, 3) and abs(got[m][0] - total / 93) < 1e-12


def test_signal_universe_sends_rows_once(spark):
    """The rows stay where they are written; their few cells come to them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        panel = spark.range(200).selectExpr("id AS permno", "1 AS mi", "10.0 AS prc", "'large' AS size_grp", "CAST(id % 30 % 3 AS string) AS sector", "0.1 AS ret_exc_lead1m")
        out = K.signal_universe(panel.selectExpr("permno", "mi", "1.0 AS growth"), panel)
        assert "Exchange" not in plan(out).split("BroadcastExchange")[0] and out.count() == 200 and "__row" not in out.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
