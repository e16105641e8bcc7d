import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedtrace.session import CELL_ROWS_CONF, local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    # Tiny cells: every ordered operator has to cross cell borders in the tests.
    s.conf.set(CELL_ROWS_CONF, "40")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """Three groups, one with 80 % of the rows, 30 % missing values, ties in x."""
    rng = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]), "x": np.round(rng.exponential(10, n), 1), "v": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.3, "v"] = np.nan
    pdf["eid"] = np.arange(n)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    pdf = pdf.sort_values(["g", "x", "eid"]).reset_index(drop=True)
    pdf["row_idx"] = pdf.groupby("g").cumcount()
    return df, pdf


@pytest.fixture(scope="session")
def wells():
    """Logs with a planted surface: TVT = surface - Z + c, GR = a * curve(TVT) + b, and the curve itself."""
    rng = np.random.default_rng(1)
    logs, curves = [], []
    t = np.arange(0, 400, 0.5)
    gr = 60 + 25 * np.sin(t / 9) + 10 * np.sin(t / 3.1) + 5 * np.sin(t / 23)
    for w in range(6):
        n = 300
        md = np.arange(n) * 1.0
        x, y = 1000.0 * (w % 3) + md, 800.0 * (w // 3) + 0 * md
        surface = 500 + 0.01 * x + 0.02 * y
        z = 300 + 0.05 * md + 2 * np.sin(md / 40)
        tvt = surface - z + w
        g = (1 + 0.1 * w) * np.interp(tvt, t, gr) + 3 * w
        g[rng.random(n) < 0.3] = np.nan
        logs.append(pd.DataFrame({"well": f"w{w}", "MD": md, "X": x, "Y": y, "Z": z, "GR": g, "TVT": tvt, "ANCC": surface,
                                  "TVT_input": np.where(np.arange(n) < 100, tvt, np.nan)}))
        curves.append(pd.DataFrame({"well": f"w{w}", "TVT": t, "GR": gr, "Geology": None}))
    return pd.concat(logs, ignore_index=True), pd.concat(curves, ignore_index=True)
