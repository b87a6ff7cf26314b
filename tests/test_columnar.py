"""Columnar ranks against pandas: many columns, hot groups cut into ranges, ties, missing values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossweave.operators import columnar as C
from crossweave.operators import crosssection as X


def sample(n=5000, columns=4):
    rng = np.random.default_rng(11)
    out = pd.DataFrame({"permno": np.arange(n), "g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 9, n)), "s": rng.choice(["a", "b", None], n)})
    for j in range(columns):
        v = np.round(rng.normal(size=n), j % 3)
        v[rng.random(n) < 0.3] = 0.5
        v[rng.random(n) < 0.1] = np.nan
        out[f"x{j}"] = v
    return out


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(),
                                 ", ".join(f"{c} {'string' if c == 's' else 'long' if c in ('permno', 'g') else 'double'}" for c in pdf.columns))


@pytest.mark.parametrize("large,bits", [(200_000, 15), (150, 6)])
@pytest.mark.parametrize("form", C.FORMS)
def test_forms_equal_pandas(spark, monkeypatch, form, large, bits):
    monkeypatch.setattr(C, "LARGE", large)
    monkeypatch.setattr(C, "CHUNK_BITS", bits)
    pdf = sample()
    names = [c for c in pdf if c.startswith("x")]
    got = C.ranked_columns(frame(spark, pdf).repartition(3), ["g"], {c: f"r_{c}" for c in names}, form).toPandas().sort_values("permno").reset_index(drop=True)
    for c in names:
        by = pdf.groupby("g")[c]
        if form == "scaled":
            want = (by.rank(method="dense") - 1) / (by.transform("nunique") - 1) * 2 - 1
        elif form == "percentile":
            want = (by.rank() - 1) / (by.transform("count") - 1) - 0.5
        else:
            r = by.rank()
            want = r if form == "average" else (r - r.groupby(pdf.g).transform("mean")) / r.groupby(pdf.g).transform(lambda v: v.std(ddof=0))
        np.testing.assert_allclose(got[f"r_{c}"], want, atol=1e-12)
        np.testing.assert_array_equal(got[c], pdf[c])


def test_edges_of_groups_and_values(spark):
    rows = [(1, None, 2.0), (2, None, 2.0), (3, None, 5.0), (4, 7, None), (5, 7, float("nan")), (6, 7, -0.0), (7, 7, 0.0), (8, 9, 3.0), (9, 10, None)]
    df = spark.createDataFrame(rows, "permno long, g int, v double")
    got = {r.permno: r.r for r in C.ranked_columns(df, ["g"], {"v": "r"}, "average").collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 3.0, 4: None, 5: 3.0, 6: 1.5, 7: 1.5, 8: 1.0, 9: None}
    assert {r.r for r in C.ranked_columns(df, ["g"], {"v": "r"}, "unit").where("g = 9").collect()} == {0.0}
    assert {r.r for r in C.ranked_columns(df, ["g"], {"v": "r"}, "z").where("g = 9").collect()} == {None}
    assert C.ranked_columns(df.limit(0), ["g"], {"v": "r"}, "scaled").count() == 0
    with pytest.raises(ValueError):
        C.ranked_columns(df, ["g"], {"v": "r"}, "other")


def test_two_keys(spark):
    pdf = sample(800, 1)
    got = C.ranked_columns(frame(spark, pdf), ["g", "s"], {"x0": "r"}, "average").toPandas().sort_values("permno").reset_index(drop=True)
    np.testing.assert_allclose(got.r, pdf.groupby(["g", "s"], dropna=False).x0.rank())


def test_147_columns_do_not_multiply_rows(spark):
    names = [f"f{j}" for j in range(147)]
    df = spark.range(3000).select(F.col("id").alias("permno"), (F.col("id") % 5).cast("int").alias("m"),
                                  *[F.when(F.xxhash64("id", F.lit(j)) % 7 != 0, (F.xxhash64(F.lit(j), "id") % 100).cast("double")).alias(c) for j, c in enumerate(names)])
    wide = X.rank_keep_missing(df, names, "m")
    assert wide.columns == ["permno", "m", *names]
    assert "Generate" not in wide._jdf.queryExecution().toString() and "Expand" not in wide._jdf.queryExecution().toString()
    got, pdf = wide.toPandas().sort_values("permno").reset_index(drop=True), df.toPandas()
    for c in names[::29]:
        by = pdf.groupby("m")[c]
        np.testing.assert_allclose(got[c], (by.rank(method="dense") - 1) / (by.transform("nunique") - 1) * 2 - 1)


def test_several_ranks_share_one_deal(spark):
    df = frame(spark, sample(600, 3))
    plan = X.blend(df, "x0", ["g"], {"x1": 0.5, "x2": 0.1}, 0.4)._jdf.queryExecution().toString()
    # the counts are dealt out before; what is left brings places back to their rows
    assert plan.count("Join") == 0 and plan.count("FlatMapCoGroupsInArrow") >= 1
