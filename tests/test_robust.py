"""Robust fits of groups that fit one cell: exchanged once, with the same result as by passes."""

import numpy as np
import pandas as pd
import pytest

from bedtrace.operators import robust as R
from bedtrace.session import CELL_ROWS_CONF


@pytest.mark.parametrize("centre", [False, True])
def test_small_groups_are_written_twice_and_fit_alike(spark, monkeypatch, centre):
    rng = np.random.default_rng(6)
    d = pd.DataFrame({"g": np.repeat(range(5), 36), "s": np.tile(np.linspace(0, 1, 36), 5), "deg": np.repeat([1, 2, 3, 3, 2], 36)})
    d["y"] = 2 + d.s * d.g - 3 * d.s**2 + rng.standard_t(2, len(d))
    df, written, keep = spark.createDataFrame(d), [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda t: written.append(1) or keep(t))

    def fit():
        f = R.robust_polynomial(df, ["g"], "s", "y", R.F.col("deg"), 6, 2.5, True, 3, centre)
        return {r.g: (r.n, list(r.coef)) for r in f.collect()}

    once = fit()
    assert len(written) == 2  # the rows and the fits, not two tables for every round
    cells = spark.conf.get(CELL_ROWS_CONF)
    try:
        spark.conf.set(CELL_ROWS_CONF, "20")
        passes = fit()
    finally:
        spark.conf.set(CELL_ROWS_CONF, cells)
    assert once.keys() == passes.keys()
    for g, (n, coef) in once.items():
        assert n == passes[g][0] == 36 and np.allclose(coef, passes[g][1], rtol=1e-6, atol=1e-8)
