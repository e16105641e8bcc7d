"""Ordered operators against pandas and numpy, on groups that span many cells."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedtrace.operators import interp as I
from bedtrace.operators import metrics as M
from bedtrace.operators import sequence as S
from bedtrace.operators.cells import index_rows
from bedtrace.operators.quantiles import grouped_quantiles


@pytest.fixture(scope="module")
def log(skewed):
    df, pdf = skewed
    return index_rows(df, ["g"], ["x", "eid"], "x", count="n").cache(), pdf


def ordered(df):
    return df.toPandas().sort_values(["g", "row_idx"]).reset_index(drop=True)


def test_index_rows(log):
    ix, p = log
    r = ordered(ix)
    assert (r.eid == p.eid).all() and (r.row_idx == p.row_idx).all()
    assert (r.n == p.groupby("g").eid.transform("size")).all()


def test_rolling(log):
    ix, p = log
    r = ordered(S.rolling(ix, ["g"], "v", [5, 21], ["mean", "std"], "r"))
    for w in (5, 21):
        roll = p.groupby("g").v.transform(lambda s: s.rolling(w, center=True, min_periods=1).mean())
        assert np.allclose(r[f"r_mean{w}"], roll, equal_nan=True)
        roll = p.groupby("g").v.transform(lambda s: s.rolling(w, center=True, min_periods=1).std())
        assert np.allclose(r[f"r_std{w}"], roll, equal_nan=True)


def test_result_does_not_depend_on_partitioning(log):
    ix, _ = log
    a = ordered(S.rolling(ix, ["g"], "v", [21], ["mean"], "r"))
    b = ordered(S.rolling(ix.orderBy(F.rand(3)).repartition(7), ["g"], "v", [21], ["mean"], "r"))
    assert np.allclose(a.r_mean21, b.r_mean21, equal_nan=True)


def test_gap_fill_and_expanding(log):
    ix, p = log
    r = ordered(S.gap_fill(ix, ["g"], "v", "f"))
    assert np.allclose(r.f, p.groupby("g").v.transform(lambda s: s.interpolate(limit_direction="both")))
    r = ordered(S.expanding(ix, ["g"], "v", "m"))
    assert np.allclose(r.m, p.groupby("g").v.transform(lambda s: s.expanding().mean()), equal_nan=True)


def test_gap_fill_all_null_group(spark):
    d = spark.createDataFrame([("a", i, None) for i in range(100)], "g string, row_idx long, v double")
    assert {r.f for r in S.gap_fill(d, ["g"], "v", "f", 7.0).collect()} == {7.0}


def test_lags(log):
    ix, p = log
    r = ordered(S.lags(ix, ["g"], "x", [1, 15], "l"))
    for k in (1, 15):
        assert np.allclose(r[f"l_lag{k}"], p.groupby("g").x.transform(lambda s: s.shift(k).bfill()))
        assert np.allclose(r[f"l_lead{k}"], p.groupby("g").x.transform(lambda s: s.shift(-k).ffill()))


def test_quantiles(log):
    ix, p = log
    q = grouped_quantiles(ix, ["g"], {"m": (F.col("v"), 0.5), "p9": (F.col("v"), 0.9), "x1": (F.col("x"), 0.25)}).toPandas().set_index("g").sort_index()
    assert np.allclose(q.m, p.groupby("g").v.quantile(0.5))
    assert np.allclose(q.p9, p.groupby("g").v.quantile(0.9))
    assert np.allclose(q.x1, p.groupby("g").x.quantile(0.25))


def test_quantile_of_copies(spark):
    d = spark.createDataFrame([(5.0,)] * 500 + [(float(i),) for i in range(100)], "v double")
    got = grouped_quantiles(d, [], {"a": (F.col("v"), 0.5), "b": (F.col("v"), 0.95)}).first()
    assert (got.a, got.b) == tuple(np.quantile([5.0] * 500 + list(range(100)), [0.5, 0.95]))


def test_interp_modes_and_band_mean(spark, log):
    ix, p = log
    rng = np.random.default_rng(2)
    probes = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 120), "px": np.round(rng.uniform(-5, 60, 120), 1), "k": range(120)})
    pr = spark.createDataFrame(probes)
    held = I.interp_join(pr, ix, ["g"], "px", "x", "v", "y").toPandas()
    inside = I.interp_join(pr, ix, ["g"], "px", "x", "v", "y", "null").toPandas().set_index("k")
    const = I.interp_join(pr, ix, ["g"], "px", "x", "v", "y", "const", -1.0, -2.0).toPandas().set_index("k")
    band = I.band_mean(pr, ix, ["g"], "px", "x", "v", 2.0, "y").toPandas().set_index("k")
    for g, s in held.groupby("g"):
        c = p[(p.g == g) & p.v.notna()].groupby("x").v.mean()
        assert np.allclose(s.y, np.interp(s.px, c.index, c.values))
        for k, x, y in zip(s.k, s.px, s.y):
            out = np.interp(x, c.index, c.values, left=np.nan, right=np.nan)
            assert np.isclose(inside.y[k], out, equal_nan=True)
            assert np.isclose(const.y[k], np.interp(x, c.index, c.values, left=-1, right=-2))
            near = c[(c.index >= x - 2) & (c.index <= x + 2)]
            assert np.isclose(band.y[k], near.mean() if len(near) else y)


def test_one_knot_curve(spark):
    pr = spark.createDataFrame([("a", -1.0), ("a", 3.0), ("a", 9.0), ("b", 1.0)], "g string, px double")
    cv = spark.createDataFrame([("a", 3.0, 5.0)], "g string, x double, v double")
    got = {(r.g, r.px): r.y for r in I.interp_join(pr, cv, ["g"], "px", "x", "v", "y").collect()}
    assert got == {("a", -1.0): 5.0, ("a", 3.0): 5.0, ("a", 9.0): 5.0, ("b", 1.0): None}


def test_smooth_poly(log):
    ix, _ = log
    r = ordered(S.smooth_poly(S.gap_fill(ix, ["g"], "v", "f"), ["g"], "f", 17, 3, "sm"))
    for _, s in r.groupby("g"):
        y, n = s.f.to_numpy(), len(s)
        w = min(17, n if n % 2 else n - 1)
        for i in range(n):
            st = min(max(i - w // 2, 0), n - w)
            assert np.isclose(np.polyval(np.polyfit(np.arange(w), y[st : st + w], 3), i - st), s.sm.to_numpy()[i])


def test_even_sample(log):
    ix, p = log
    for g, s in S.even_sample(ix, ["g"], 7).toPandas().groupby("g"):
        n = (p.g == g).sum()
        assert set(s.row_idx) == set(np.linspace(0, n - 1, min(7, n), dtype=int))


def test_average_ranks(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double")
    got = sorted((r.v, r.r) for r in M.average_ranks(d, "v", "r").where("v is not null").collect())
    assert got == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (3.0, 4.0)]


def test_share_below(log):
    ix, p = log
    r = M.share_below(ix, ix, ["g"], "x", "x", "q").toPandas()
    for g, s in r.groupby("g"):
        known = np.sort(p[p.g == g].x.to_numpy())
        assert np.allclose(s.q, np.searchsorted(known, s.x, "left") / len(known))
