"""Cells stay small on skewed and tied axes, and what is built on them does not change."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedtrace.operators.cells import CELL, add_cells, index_rows, neighbours, running
from bedtrace.operators.quantiles import grouped_quantiles

ROWS = 100


def axes():
    rng = np.random.default_rng(0)
    n = 6000
    even = rng.random(n)
    outlier = even.copy()
    outlier[0] = 1e12
    return {
        "even": even,
        "outlier": outlier,
        "lognormal": rng.lognormal(0, 4, n),
        "ties": np.where(rng.random(n) < 0.8, 5.0, even * 10),
        "infinite": np.where(even < 0.01, np.inf, even),
    }


@pytest.fixture(scope="module", params=list(axes()))
def table(spark, request):
    x = axes()[request.param]
    rng = np.random.default_rng(1)
    # one hot group with nine rows of ten
    pdf = pd.DataFrame({"g": np.where(rng.random(len(x)) < 0.9, "hot", rng.choice(["a", "b"], len(x))), "x": x, "eid": rng.permutation(len(x)), "v": rng.normal(size=len(x))})
    return spark.createDataFrame(pdf).repartition(3), pdf


def test_no_cell_is_larger_than_twice_the_target(table):
    df, pdf = table
    for group in (["g"], []):
        d = add_cells(df, group, "x", ROWS, order=["eid"])
        sizes = d.groupBy(*group, CELL).agg(F.count("*").alias("n"), F.min(F.struct("x", "eid")).alias("lo"), F.max(F.struct("x", "eid")).alias("hi")).collect()
        assert max(r.n for r in sizes) <= 2 * ROWS
        for g in {r.g if group else None for r in sizes}:
            cells = sorted((r for r in sizes if not group or r.g == g), key=lambda r: r[CELL])
            assert all(a.hi <= b.lo for a, b in zip(cells, cells[1:]))


def test_a_group_that_fits_gets_one_cell_and_no_join(spark):
    d = add_cells(spark.range(50).withColumn("g", F.lit(1)), ["g"], "id", ROWS)
    assert d.select(CELL).distinct().count() == 1
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()


def test_results_are_those_of_the_plain_window(table):
    df, pdf = table
    p = pdf.sort_values(["g", "x", "eid"]).reset_index(drop=True)
    got = index_rows(df, ["g"], ["x", "eid"], "x").toPandas().sort_values(["g", "row_idx"]).reset_index(drop=True)
    assert (got.eid == p.eid).all() and (got.row_idx == p.groupby("g").cumcount()).all()
    celled = add_cells(df, ["g"], "x", order=["eid"])
    run = running(celled, ["g"], ["x", "eid"], {"s": F.col("v")}).toPandas().sort_values(["g", "x", "eid"]).reset_index(drop=True)
    assert np.allclose(run.s, p.groupby("g").v.cumsum())
    positive = F.when(F.col("v") > 1, F.col("v"))
    near = neighbours(celled, ["g"], ["x", "eid"], {"before": positive}, {"after": positive}).toPandas().sort_values(["g", "x", "eid"]).reset_index(drop=True)
    pos = p.v.where(p.v > 1)
    assert np.allclose(near.before, pos.groupby(p.g).ffill(), equal_nan=True)
    assert np.allclose(near.after, pos.groupby(p.g).bfill(), equal_nan=True)


def test_quantiles(table):
    df, pdf = table
    got = {r.g: (r.q1, r.q5) for r in grouped_quantiles(df, ["g"], {"q1": (F.col("x"), 0.1), "q5": (F.col("x"), 0.5)}).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part.x, [0.1, 0.5]))


def test_groups_of_one_cell_are_numbered_without_a_join(spark):
    from bedtrace.operators.cells import index_rows
    from bedtrace.session import CELL_ROWS_CONF

    df = spark.createDataFrame([(g, float(i // 2), i, i * g) for g in range(3) for i in range(30 + g)], "g long, x double, e long, v long").repartition(5, "e")
    old = spark.conf.get(CELL_ROWS_CONF)

    def numbered(rows):
        spark.conf.set(CELL_ROWS_CONF, rows)
        return index_rows(df, ["g"], ["x", "e"], "x", count="n_rows")

    try:
        one, many = numbered("100"), numbered("8")
        assert one.columns == many.columns and sorted(one.collect()) == sorted(many.collect())
        assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(CELL_ROWS_CONF, old)


def test_feature_table_of_one_cell_groups_matches_many_cells(spark):
    """Running means, filled gaps and the curve come out of shared tasks: no carry between cells, rows exchanged while narrow."""
    from bedtrace.operators.features import feature_table
    from bedtrace.session import CELL_ROWS_CONF

    rows = [(u, i, float(i), float(u + i % 7), None if (u + i) % 3 == 0 else float(i % 5), i * 10 < 450, 45) for u in range(4) for i in range(45)]
    log = spark.createDataFrame(rows, "u long, row_idx long, x double, value double, sig double, known boolean, n_rows long")
    curve = spark.createDataFrame([(u, float(c), float(c + u)) for u in range(3) for c in range(0, 45, 5)], "u long, cx double, cy double")
    old = spark.conf.get(CELL_ROWS_CONF)

    def table(cell):
        spark.conf.set(CELL_ROWS_CONF, cell)
        return feature_table(log, ["u"], "x", "value", "sig", "known", curve, windows=(5, 101), steps=(1,), z_window=5, z_rows=2)

    try:
        one, many = table("1000"), table("10")
        cols = sorted(one.columns)
        pick = [c if c in ("u", "row_idx", "known") else f"round(cast({c} as double), 9) as {c}" for c in cols]
        key = ["u", "row_idx"]
        assert one.selectExpr(*pick).orderBy(*key).toPandas().equals(many.selectExpr(*pick).orderBy(*key).toPandas())
        assert len(re.findall(r"\bJoin \w", one._jdf.queryExecution().optimizedPlan().toString())) == 1  # the group statistics
    finally:
        spark.conf.set(CELL_ROWS_CONF, old)
