"""Candidates of the prefix backtest see the prefix of their cut only, and other groups never their own rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedtrace.operators import guard as G
from bedtrace.session import CELL_ROWS_CONF


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(2)
    parts = []
    for g in range(3):
        x = np.arange(200.0)
        parts.append(pd.DataFrame({"g": g, "row_idx": np.arange(200), "x": x, "slot": (x // 20).astype(int), "v": 3 * g + 0.1 * x + rng.normal(size=200) * 0.1}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf["signal"] = 5 * pdf["v"] + 1
    pdf.loc[(pdf["g"] == 2) & (pdf["row_idx"] > 150), "signal"] = np.nan
    pdf.loc[(pdf["g"] == 1) & (pdf["slot"] == 4), "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("v", "signal")}).withColumn("known", F.col("row_idx") < 180)
    return pdf, df


@pytest.fixture(autouse=True)
def large_cells(spark):
    """Cell borders are tested elsewhere; a small table in many cells costs minutes here."""
    old = spark.conf.get(CELL_ROWS_CONF)
    spark.conf.set(CELL_ROWS_CONF, "100000")
    yield
    spark.conf.set(CELL_ROWS_CONF, old)


def candidates(df, cuts=(0.8,)):
    df = G.others_line(G.others_mean(df, "g", ["slot"], "v", "dense"), "g", "x", "v", "surface")
    cuts = G.prefix_cuts(df, "g", "known", cuts)
    return G.shifted_candidates(cuts, ["g", "cut"], "v", ["dense", "surface"], ["signal"]).unionByName(
        G.polynomial_cut_candidates(cuts, "g", "x", "v", [60, None], [1, 2], solves=1))


def test_others_leave_the_own_group_out(log):
    pdf, df = log
    got = G.others_line(G.others_mean(df, "g", ["slot"], "v", "dense"), "g", "x", "v", "surface").toPandas().set_index(["g", "row_idx"])
    for g in range(3):
        rest = pdf[(pdf["g"] != g) & pdf["v"].notna()]
        mean = rest.groupby("slot")["v"].mean()
        a, b = np.polyfit(rest["x"], rest["v"], 1)
        own = pdf[pdf["g"] == g]
        assert np.allclose(got.loc[g]["dense"].loc[own["row_idx"]], mean.loc[own["slot"]])
        assert np.allclose(got.loc[g]["surface"].loc[own["row_idx"]], a * own["x"] + b)
    alone = G.others_line(G.others_mean(df.where("g = 0"), "g", ["slot"], "v", "dense"), "g", "x", "v", "surface")
    assert alone.where("dense is not null or surface is not null").count() == 0


def test_holdout_of_a_cut_does_not_reach_its_own_group_candidates(spark, log):
    _, df = log
    changed = df.withColumn("v", F.when((F.col("g") == 0) & (F.col("row_idx") >= 144), F.col("v") + 1000).otherwise(F.col("v")))
    cols = ["cut", "row_idx", "name", F.round("pred", 6)]
    pick = (F.col("g") == 0) & (F.col("cut") == 0.8)
    a = {tuple(r) for r in candidates(df).where(pick).select(*cols).collect()}
    b = {tuple(r) for r in candidates(changed).where(pick).select(*cols).collect()}
    assert a == b and len({r[2] for r in a}) == 7


def test_pool_finds_the_signal_and_drops_thin_candidates(log):
    _, df = log
    c = candidates(df)
    kept = {tuple(r) for r in G.enough_values(c, ["g", "cut"]).select("g", "cut", "name").distinct().collect()}
    gone = {tuple(r) for r in c.select("g", "cut", "name").distinct().collect()} - kept
    assert gone == {(2, 0.8, "signal")}  # 7 of 36 rows have one
    rep = {r["g"]: r for r in G.prefix_report(c, "g", "dense")[0].collect()}
    assert rep[0]["best_name"] == "signal" and rep[0]["best_score"] < 1e-6


def test_pool_errors_equal_those_of_the_long_candidates(spark, log):
    _, df = log
    df = G.others_line(G.others_mean(df, "g", ["slot"], "v", "dense"), "g", "x", "v", "surface")
    cuts = G.prefix_cuts(df, "g", "known", [0.6, 0.8])
    keys = ["g", "cut"]
    rows = G.simple_candidates(cuts, keys, "x", "v").where("name <> 'slope'").unionByName(
        G.shifted_candidates(cuts, keys, "v", ["dense", "surface"], ["signal"])).unionByName(G.polynomial_cut_candidates(cuts, "g", "x", "v", [60, None], [1, 2], solves=1))
    e = F.col("pred") - F.col("truth")
    want = G.enough_values(rows, keys).where(e.isNotNull()).groupBy(*keys, "name").agg(F.sqrt(F.avg(e * e)).alias("err"))
    got = G.pool_errors(df, "g", "known", "x", "v", [0.6, 0.8], ["dense", "surface"], ["signal"], [60, None], [1, 2])
    a, b = (d.toPandas().set_index([*keys, "name"])["err"].sort_index() for d in (want, got))
    assert list(a.index) == list(b.index) and np.allclose(a, b) and (2, 0.8, "signal") not in a.index


def test_pool_writes_known_rows_not_candidates(spark, monkeypatch, tmp_path):
    """The rows written on the way grow with the known rows, not with cuts x configurations."""
    import bedtrace.session as S
    from bedtrace.plans import REGISTRY

    written, store = [], S.store

    def counted(df, by=()):
        path = store(df, by)
        written.append(spark.read.parquet(path).count())
        return path

    monkeypatch.setattr(S, "store", counted)
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    REGISTRY["d23_pool_errors"].run(spark, "/root/testdata/sf0.001").collect()
    assert sum(written) < 1.5 * n  # 0.3 n known rows, written three times
