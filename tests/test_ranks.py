"""Split ranks against pandas: hot groups, heavy ties, missing values, few and many partitions."""

import contextlib
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossweave.operators import crosssection as X
from crossweave.operators import ranks as R


@pytest.fixture(scope="module")
def skewed():
    """One group holds a third of all rows and a third of its rows share one value."""
    rng = np.random.default_rng(3)
    n = 9000
    group = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 12, n))
    value = np.round(rng.normal(size=n), 2)
    value[rng.random(n) < 1 / 3] = 0.25
    value[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"permno": np.arange(n), "g": group, "v": value})


@pytest.fixture(scope="module")
def frame(spark, skewed):
    rows = [(int(p), int(g), None if np.isnan(v) else float(v)) for p, g, v in skewed.itertuples(index=False)]
    return spark.createDataFrame(rows, "permno long, g int, v double")


@pytest.fixture(params=[1, 40])
def partitions(spark, request):
    """Everything in one partition, and hardly any rows in each."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("kind", ["average", "dense", "row"])
def test_split_rank(frame, skewed, kind, ascending, partitions):
    got = R.split_rank(frame, ["g"], "v", "permno", kind=kind, rank="r", total="n", ascending=ascending).toPandas().set_index("permno").sort_index()
    method = {"average": "average", "dense": "dense", "row": "first"}[kind]
    want = skewed.groupby("g").v.rank(method=method, ascending=ascending)
    pd.testing.assert_series_equal(got.r.astype(float), want.set_axis(got.index), check_names=False)
    total = skewed.groupby("g").v.transform("nunique" if kind == "dense" else "count").where(skewed.v.notna())
    pd.testing.assert_series_equal(got.n.astype(float), total.astype(float).set_axis(got.index), check_names=False)


def test_missing_keys_and_copies(spark):
    rows = [(1, None, 2.0), (2, None, 2.0), (3, None, 5.0), (4, 7, None), (5, 7, float("nan")), (6, 7, -0.0), (7, 7, 0.0)]
    df = spark.createDataFrame(rows, "permno long, g int, v double")
    got = {r.permno: (r.r, r.t) for r in R.split_rank(df, ["g"], "v", "permno", rank="r", ties="t").collect()}
    assert got == {1: (1.5, 2), 2: (1.5, 2), 3: (3.0, 1), 4: (None, None), 5: (3.0, 1), 6: (1.5, 2), 7: (1.5, 2)}
    same = spark.createDataFrame([(1, 1, 3.0)] * 3, "permno long, g int, v double")
    assert sorted(r.r for r in R.split_rank(same, ["g"], "v", "permno", kind="row", rank="r").collect()) == [1, 2, 3]


@pytest.mark.parametrize("values", [100, 1000])
@pytest.mark.parametrize("kind", ["average", "dense", "row"])
def test_nothing_is_broadcast_by_force(spark, kind, values):
    """With automatic broadcasts off, no plan has one, however often values repeat; a large group lies in many cells."""
    df = spark.range(20_000).selectExpr("id permno", "cast(if(id % 3 = 0, 0, id % 7) as int) g", f"cast(pmod(hash(id), {values}) as double) v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = R.split_rank(df, ["g"], "v", "permno", kind=kind, rank="r")
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            ranked.explain()
        assert "Broadcast" not in text.getvalue()
        assert ranked.filter("r is not null").count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_large_group_lies_in_many_partitions(frame, spark, partitions):
    cells = R._dealt(frame.where("v is not null"), ["g"], ["v", "permno"], F.lit(1).cast("long")).where("g = 0").groupBy("__part").count().collect()
    assert partitions == 1 or (len(cells) > 5 and max(r["count"] for r in cells) < 2 * 9000 / partitions)


def test_group_quantiles(frame, skewed, partitions):
    got = R.group_quantiles(frame, ["g"], "v", {"q05": 0.05, "mid": 0.5, "q95": 0.95}).toPandas().set_index("g").sort_index()
    for name, q in (("q05", 0.05), ("mid", 0.5), ("q95", 0.95)):
        np.testing.assert_allclose(got[name], skewed.groupby("g").v.quantile(q).sort_index())


def test_rank_moments(frame, skewed):
    got = R.rank_moments(frame, ["g"], "v").toPandas().set_index("g").sort_index()
    ranks = skewed.assign(r=skewed.groupby("g").v.rank()).groupby("g").r
    np.testing.assert_allclose(got.rank_mean, ranks.mean())
    np.testing.assert_allclose(got.rank_sd, ranks.std(ddof=0))


def test_unit_rank_of_one_value_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 5.0), (3, 2, 7.0), (4, 2, None)], "permno long, m int, x double")
    got = {r.permno: r.u for r in X.unit_rank(df, "x", ["m"], "u").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: None}


def test_rank_keep_missing_edges(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 5.0), (3, 1, None), (1, 2, 1.0), (2, 2, 2.0), (3, 2, 4.0)], "permno long, m int, x double")
    got = {(r.m, r.permno): r.ranked for r in X.rank_keep_missing_long(df, ["x"], "m").collect()}
    assert got == {(1, 1): None, (1, 2): None, (1, 3): None, (2, 1): -1.0, (2, 2): 0.0, (2, 3): 1.0}


def test_neutralised_score_is_orthogonal(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"permno": range(300), "m": rng.integers(0, 3, 300), "s": rng.choice(list("abcd"), 300),
                        "y": rng.normal(size=300), "x1": rng.normal(size=300), "x2": rng.normal(size=300)})
    out = X.neutralise(spark.createDataFrame(pdf), "y", "x1", "x2", "m", "s", "e").toPandas()
    for _, g in out.groupby("m"):
        design = np.column_stack([np.ones(len(g)), g.x1, g.x2, pd.get_dummies(g.s, drop_first=True, dtype=float)])
        want = g.y - design @ np.linalg.lstsq(design, g.y, rcond=None)[0]
        np.testing.assert_allclose(g.e, want, atol=1e-12)


def test_neutralise_collinear_and_constant(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=40)
    for x1, x2 in ((x, 2 * x), (np.ones(40), x), (x, np.ones(40)), (np.ones(40), np.ones(40))):
        pdf = pd.DataFrame({"permno": range(40), "m": 1, "s": ["a", "b"] * 20, "y": rng.normal(size=40), "x1": x1, "x2": x2})
        out = X.neutralise(spark.createDataFrame(pdf), "y", "x1", "x2", "m", "s", "e").toPandas().sort_values("permno")
        design = np.column_stack([np.ones(40), x1, x2, (pdf.s == "b").astype(float)])
        want = pdf.y - design @ np.linalg.lstsq(design, pdf.y, rcond=None)[0]
        np.testing.assert_allclose(out.e, want, atol=1e-9)


def test_trailing_percentile(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"permno": np.repeat([1, 2], 80), "mi": list(range(80)) * 2, "v": np.round(rng.normal(size=160), 1)})
    out = X.trailing_percentile(spark.createDataFrame(pdf), "v").toPandas().sort_values(["permno", "mi"])
    want = 1 - pdf.groupby("permno").v.transform(lambda s: s.rolling(60, min_periods=36).rank(pct=True))
    want[pdf.v <= 0] = np.nan
    np.testing.assert_allclose(out.pe_pct.astype(float), want)


@pytest.mark.parametrize("largest", [True, False])
def test_long_heads_equal_short_ones(frame, monkeypatch, largest):
    short = {tuple(r) for r in X.top_n(frame, "v", 40, ["g"], largest).select("g", "permno", "position").collect()}
    monkeypatch.setattr(X, "HEAD", 10)
    assert {tuple(r) for r in X.top_n(frame, "v", 40, ["g"], largest).select("g", "permno", "position").collect()} == short
