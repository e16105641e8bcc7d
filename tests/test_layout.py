"""The stored layout: plans without an exchange, hot groups over many buckets, found again by another session."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedtrace.operators.cells import centred
from bedtrace.operators.interp import bracket_join
from bedtrace.plans import REGISTRY
from bedtrace.sources import layout

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def copartitioned(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset(name)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name, scans", [("w1_stored_rolling", 1), ("w4_stored_lags", 1), ("j1_stored_features", 3), ("j4_stored_interp", 1)])
def test_one_scan_a_table_and_no_exchange(spark, copartitioned, name, scans):
    text = plan(REGISTRY[name].run(spark, SF))
    assert "Exchange" not in text
    assert text.count("FileScan parquet") == scans


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """One group with 80 % of the rows, ties on the axis, cells of 40 rows; a curve with knots at the same places."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(900) < 0.8, "hot", rng.choice(["b", "c"], 900))
    log = pd.DataFrame({"g": g, "x": np.round(rng.exponential(8, 900)), "v": rng.normal(size=900), "eid": np.arange(900)})
    log.loc[log["eid"] % 60 < 2, "x"] = 7.0
    curve = pd.DataFrame({"g": rng.choice(["hot", "b", "d"], 120), "cx": np.round(rng.exponential(12, 120) * 2) / 2, "cy": rng.normal(size=120)})
    df, cdf = spark.createDataFrame(log), spark.createDataFrame(curve)
    root = str(tmp_path_factory.mktemp("layout"))
    stored = layout.store_log(df, root, {"v": 1}, ["g"], ["x", "eid"], "x", halo=12, buckets=8, curves={"c": layout.Curve(cdf, "cx", "cy")})
    return log, df, cdf, stored, root


def test_every_row_once_and_hot_group_spread(hot):
    log, _, _, stored, _ = hot
    rows = stored.rows().toPandas()
    want = log.sort_values(["g", "x", "eid"]).reset_index(drop=True)
    want["row_idx"] = want.groupby("g").cumcount()
    got = rows.sort_values(["g", "row_idx"]).reset_index(drop=True)
    assert got["eid"].tolist() == want["eid"].tolist() and got["row_idx"].tolist() == want["row_idx"].tolist()
    files = stored.rows().where("g = 'hot'").select(F.input_file_name()).distinct().count()
    assert files > 4
    assert stored.read().where("_kind in ('row', 'halo')").groupBy("g", "_cell").count().agg(F.max("count")).first()[0] <= 40 + 2 * 12


def test_frames_cross_cells(hot):
    log, _, _, stored, _ = hot
    got = stored.framed(10, 10, lambda w: {"m": F.avg("v").over(centred(w, 21))}).toPandas().sort_values(["g", "row_idx"])
    want = log.sort_values(["g", "x", "eid"]).groupby("g")["v"].rolling(21, center=True, min_periods=1).mean()
    assert np.allclose(got["m"], want)
    with pytest.raises(ValueError):
        stored.framed(13, 0, lambda w: {})


def test_curve_brackets_equal_the_plain_join(hot):
    _, df, cdf, stored, _ = hot
    got = layout.bracketed(stored, "c", "x")
    assert "Exchange" not in plan(got)
    cols = ["g", "eid", "_prev", "_next"]
    got = {tuple(r) for r in got.select(*cols).collect()}
    assert got == {tuple(r) for r in bracket_join(df, cdf, ["g"], "x", "cx", "cy").select(*cols).collect()}
    assert len(got) == 900


def test_found_again_and_new_version_written(spark, hot):
    _, df, cdf, stored, root = hot
    curves = {"c": layout.Curve(cdf, "cx", "cy")}
    spark.sql(f"DROP TABLE {stored.name}")  # as a later session finds it: files without a catalog entry
    again = layout.store_log(df.where("eid < 5"), root, {"v": 1}, ["g"], ["x", "eid"], "x", halo=12, buckets=8, curves=curves)
    assert again.path == stored.path and again.rows().count() == 900
    assert "Exchange" not in plan(again.framed(2, 2, lambda w: {"m": F.avg("v").over(w.rowsBetween(-2, 2))}))
    other = layout.store_log(df.where("eid < 5"), root, {"v": 2}, ["g"], ["x", "eid"], "x", halo=12, buckets=8, curves=curves)
    assert other.path != stored.path and other.rows().count() == 5


def test_empty_log(spark, hot):
    _, df, cdf, _, root = hot
    none = layout.store_log(df.where("eid < 0"), root, {"v": 3}, ["g"], ["x", "eid"], "x", halo=12, buckets=2,
                            curves={"c": layout.Curve(cdf, "cx", "cy")})
    assert none.rows().count() == 0 and layout.bracketed(none, "c", "x").count() == 0
