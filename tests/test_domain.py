"""Spatial joins, robust fits, decoding, stacks and guarded corrections against brute force on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedtrace.operators import align as L
from bedtrace.operators import calibrate as A
from bedtrace.operators import decode as Dc
from bedtrace.operators import ensemble as E
from bedtrace.operators import guard as G
from bedtrace.operators import models as D
from bedtrace.operators import robust as R
from bedtrace.operators import samples as P
from bedtrace.operators import spatial as X
from bedtrace.operators.cells import index_rows
from bedtrace.operators.interp import interp_join
from bedtrace.operators.sequence import gap_fill
from bedtrace.session import BATCH_BYTES


@pytest.mark.parametrize("leaf", [4, 32])
def test_knn_with_copies_clusters_and_owners(spark, leaf):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(5, 0.01, (150, 2)), np.repeat([[2.0, 2.0]], 150, 0)])
    owner = rng.choice([0, 1, 2, 3], len(xy), p=[0.7, 0.1, 0.1, 0.1])
    pdf = pd.DataFrame({"pid": np.arange(len(xy)), "owner": owner, "x": xy[:, 0], "y": xy[:, 1]})
    b = spark.createDataFrame(pdf)
    got = X.knn_join(b, b, 6, ["pid"], ("x", "y"), ("x", "y"), "pid", "owner", "owner", leaf=leaf).toPandas()
    s = xy / xy.std(0)
    for i in range(0, len(xy), 7):
        d = np.sqrt(((s - s[i]) ** 2).sum(1))
        d[owner == owner[i]] = np.inf
        want = np.lexsort((np.arange(len(xy)), np.round(d, 12)))[:6]
        mine = got[got.pid == i].sort_values("rank")
        assert len(mine) == 6 and np.allclose(mine.dist, d[want])
        assert not (owner[mine.nb_id] == owner[i]).any()


def test_a_dense_spot_is_cut_into_small_leaves(spark):
    """Distinct points inside 2^-25 of the square, far below where cells of a fixed depth would end."""
    rng = np.random.default_rng(12)
    spot = 0.3 + rng.random((4_000, 2)) * 2.0**-25
    pdf = pd.DataFrame(np.vstack([spot, rng.random((200, 2)), [[0.0, 0.0], [1.0, 1.0]]]), columns=["_bx", "_by"]).assign(_sp=0, _x0=0.0, _y0=0.0, _size=1.000001)
    pdf["_bid"] = np.arange(len(pdf))
    pdf["_bo"] = pdf["_bid"]
    tree, homes = X._cell_tree(spark.createDataFrame(pdf), 64)
    sizes = homes.groupBy("lv", "cx", "cy").count().toPandas()
    assert sizes["count"].max() <= 64 and sizes["count"].sum() == len(pdf) and homes.select("_bid").distinct().count() == len(pdf)
    assert 25 < tree.agg(F.max("lv")).first()[0] <= X.DEEPEST
    b = spark.createDataFrame(pdf.rename(columns={"_bx": "x", "_by": "y", "_bid": "pid"})[["pid", "x", "y"]])
    ask = pdf.iloc[[0, 777, 3_999, 4_050, 4_201]]
    q = b.where(F.col("pid").isin(ask["_bid"].tolist()))
    got = X.knn_join(q, b, 5, ["pid"], ("x", "y"), ("x", "y"), "pid", scaled=False, leaf=64).toPandas()
    xy = pdf[["_bx", "_by"]].to_numpy()
    for i in ask["_bid"]:
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        want = np.lexsort((np.arange(len(d)), d))[:5]
        assert got[got.pid == i].sort_values("rank").nb_id.tolist() == want.tolist()


def test_knn_in_many_small_tiles(spark, monkeypatch):
    """Several chunks of queries and packs of points per cell; a tile gives back k points per query, never its pairs."""
    for name, n in (("TILE", 64), ("CHUNK", 8), ("PACK", 16), ("ROWS", 5)):
        monkeypatch.setattr(X, name, n)
    rng = np.random.default_rng(21)
    xy = np.concatenate([rng.random((150, 2)), np.repeat([[0.5, 0.5]], 30, 0), 3 + rng.random((60, 2)) * 1e-4])
    owner = rng.integers(0, 4, len(xy))
    schema = "pid long, owner int, x double, y double, v double, w double"
    b = spark.createDataFrame([(i, int(owner[i]), float(x), float(y), float(i % 7), float(i % 5)) for i, (x, y) in enumerate(xy)], schema)
    nb = X.knn_join(b, b, 6, ["pid"], ("x", "y"), ("x", "y"), "pid", "owner", "owner", ["v", "w"], scaled=False, leaf=8)
    assert "ArrowEvalPython" in nb._jdf.queryExecution().toString()
    both = X.idw_columns(nb, ["pid"], {"v": ("v_mean", "v_std"), "w": ("w_mean", "w_std")}, 1 / (F.col("dist") + 1e-3)).toPandas().set_index("pid")
    got = nb.toPandas().sort_values(["pid", "rank"]).groupby("pid").nb_id.agg(list)
    for i in range(len(xy)):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        d[owner == owner[i]] = np.inf
        want = np.lexsort((np.arange(len(xy)), d))[:6]
        assert got[i] == want.tolist()
        wt = 1 / (d[want] + 1e-3)
        assert np.isclose(both.v_mean[i], (wt * (want % 7)).sum() / wt.sum()) and np.isclose(both.w_mean[i], (wt * (want % 5)).sum() / wt.sum())


def test_window_match_gives_back_some_tiles_at_a_time(spark, monkeypatch):
    """The rows Python holds are bounded by OUT_ROWS and the batch size, whatever the number of groups; same result."""
    rng = np.random.default_rng(8)
    rows = [(g, i, float(rng.normal()), float(i)) for g in range(12) for i in range(60)]
    log = spark.createDataFrame(rows, "g long, row_idx long, v double, x double")
    evals = log.where("row_idx < 9")
    whole = {(r.g, r.row_idx): tuple(r) for r in L.window_match(log, evals, "g", "v", "x", 3).collect()}
    assert len(whole) == 12 * 9 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
    monkeypatch.setattr(L, "OUT_ROWS", 4)
    assert {(r.g, r.row_idx): tuple(r) for r in L.window_match(log, evals, "g", "v", "x", 3, block=5).collect()} == whole


def test_knn_fewer_points_than_k(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 1.0, 0.0), (3, 2, 9.0, 0.0)], "pid int, owner int, x double, y double")
    got = X.knn_join(b, b, 5, ["pid"], ("x", "y"), ("x", "y"), "pid", "owner", "owner").groupBy("pid").count().collect()
    assert {r.pid: r["count"] for r in got} == {1: 2, 2: 1, 3: 1}


def test_changing_a_point_of_the_own_group_never_changes_its_surface(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"pid": range(60), "owner": [i % 5 for i in range(60)], "x": rng.random(60), "y": rng.random(60), "v": rng.random(60)})
    other = pdf.assign(v=np.where(pdf.owner == 2, 1e6, pdf.v))

    def surface(p):
        b = spark.createDataFrame(p)
        nb = X.knn_join(b, b, 8, ["pid"], ("x", "y"), ("x", "y"), "pid", "owner", "owner", ["v"])
        return X.idw(nb, ["pid"], "v", 1 / (F.col("dist") + 1e-3)).toPandas().set_index("pid").idw

    own = pdf[pdf.owner == 2].pid
    assert np.allclose(surface(pdf)[own], surface(other)[own])


def test_plane_is_recovered(spark):
    rng = np.random.default_rng(5)
    x, y = rng.random(80) * 100, rng.random(80) * 100
    pdf = pd.DataFrame({"pid": range(80), "owner": range(80), "x": x, "y": y, "v": 3 + 0.5 * x - 0.2 * y})
    b = spark.createDataFrame(pdf)
    nb = X.knn_join(b, b, 10, ["pid"], ("x", "y"), ("x", "y"), "pid", "owner", "owner", ["v"])
    fit = X.plane_fit(nb, ["pid"], ["v"], 1 / (F.col("dist") + 1e-3)).toPandas().set_index("pid").v
    assert np.allclose(fit.sort_index(), pdf.v, atol=1e-5)


def brute_robust(s, y, deg, solves, intercept=True):
    a = np.column_stack([s**k for k in range(0 if intercept else 1, deg + 1)])
    w = np.ones(len(s))
    for _ in range(solves):
        c = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
        r = y - a @ c
        w = 1 / (1 + (r / (2 * (1.4826 * np.median(np.abs(r)) + 1e-6))) ** 2)
    return a @ c


@pytest.mark.parametrize("deg,solves,intercept", [(4, 5, True), (3, 4, False)])
def test_robust_projection(spark, deg, solves, intercept):
    rng = np.random.default_rng(6)
    parts = []
    for g, n in (("a", 150), ("b", 30), ("c", deg + 1)):
        s = np.linspace(0, 1, n)
        y = np.sin(3 * s) * 5 + rng.normal(0, 0.1, n)
        y[rng.random(n) < 0.1] += 8
        parts.append(pd.DataFrame({"g": g, "s": s, "y": y}))
    pdf = pd.concat(parts)
    got = R.robust_project(spark.createDataFrame(pdf), ["g"], "s", "y", deg, solves, 0.75, intercept).toPandas().sort_values(["g", "s"])
    for g, p in pdf.groupby("g"):
        want = p.y if g == "c" else 0.25 * p.y + 0.75 * brute_robust(p.s.to_numpy(), p.y.to_numpy(), deg, solves, intercept)
        assert np.allclose(got[got.g == g].projected, want, atol=1e-6)


def test_segments_of_a_broken_line(spark):
    x = np.arange(0, 600.0, 2)
    y = np.where(x < 200, 0.1 * x, np.where(x < 420, 20 - 0.05 * (x - 200), 9 + 0.2 * (x - 420)))
    d = spark.createDataFrame(pd.DataFrame({"g": "a", "row_idx": np.arange(len(x)), "x": x, "y": y}))
    got = R.segment_curve(d, "g", "x", "y", 0.2, 20.0).orderBy("a").toPandas()
    assert list(got.a) == [0, 100, 210] and list(got.b) == [100, 210, 299]
    assert np.allclose(got.rate, [0.1, -0.05, 0.2])


def test_polynomial_candidates_extend_a_line(spark):
    n = 90
    pdf = pd.DataFrame({"g": "a", "row_idx": np.arange(n), "x": np.arange(n) * 2.0, "y": 4 + 0.3 * np.arange(n) * 2.0})
    d = spark.createDataFrame(pdf).withColumn("known", F.col("row_idx") < 60)
    got = R.polynomial_candidates(d, "g", "x", "y", "known", [40, None], [1, 2]).toPandas()
    assert set(got.name) == {"poly_deg1_tail40", "poly_deg2_tail40", "poly_deg1_tailall", "poly_deg2_tailall"}
    assert np.allclose(got.pred, 4 + 0.3 * got.row_idx * 2, atol=1e-5)


def test_window_match(spark):
    rng = np.random.default_rng(7)
    k, e, half, stride = rng.normal(size=120), rng.normal(size=50), 4, 3
    known = spark.createDataFrame(pd.DataFrame({"g": "a", "row_idx": range(120), "s": k, "v": np.arange(120) * 1.5}))
    evals = spark.createDataFrame(pd.DataFrame({"g": "a", "row_idx": range(50), "s": e}))
    # a second group, too short for one window and one more row, holds its last known value
    short = known.where("row_idx < 9").withColumn("g", F.lit("b"))
    both = evals.unionByName(evals.withColumn("g", F.lit("b")))
    got = L.window_match(known.unionByName(short), both, "g", "s", "v", half, stride, block=16).toPandas().sort_values(["g", "row_idx"])
    assert (got[got.g == "b"].match_value == 12.0).all() and (got[got.g == "b"].match_score == 0).all() and (got.g == "b").sum() == 50
    got = got[got.g == "a"]
    k, e = (pd.Series(x).rolling(5, center=True, min_periods=1).mean().to_numpy() for x in (k, e))
    win = 2 * half + 1
    st = np.arange(0, 120 - win + 1, stride)
    nrm = lambda m: (m - m.mean(1, keepdims=True)) / (m.std(1, keepdims=True) + 1e-6)
    c = nrm(k[st[:, None] + np.arange(win)])
    h = nrm(np.pad(e, half, mode="edge")[np.arange(50)[:, None] + np.arange(win)])
    score = h @ c.T / win
    assert np.allclose(got.match_score, score.max(1)) and np.allclose(got.match_value, (st[score.argmax(1)] + half) * 1.5)


def test_decode_follows_the_planted_surface(spark, wells):
    log, curve = wells
    log = log[log.well.isin(["w0", "w3"])].assign(row_idx=lambda d: d.groupby("well").cumcount())
    hw = gap_fill(spark.createDataFrame(log).replace(float("nan"), None), ["well"], "GR", "gr").cache()
    cv = spark.createDataFrame(curve[["well", "TVT", "GR"]])
    known = hw.where("TVT_input is not null")
    hit = interp_join(known, cv, ["well"], "TVT_input", "TVT", "GR", "t")
    cal = A.affine(hit, ["well"], F.col("t"), F.col("gr"))
    cv = cv.join(cal, "well").withColumn("GR", F.col("a") * F.col("GR") + F.col("b")).select("well", "TVT", "GR")
    starts = known.groupBy("well").agg(F.max_by(F.col("TVT_input") + F.col("Z"), "row_idx").alias("u0")).withColumns({"s0": F.lit(0.01), "gamma": F.lit(8.0)})
    rows = hw.where("TVT_input is null").select("well", "row_idx", F.col("MD").alias("md"), F.col("Z").alias("z"), F.col("gr").alias("signal"))
    slopes = [round(-0.03 + 0.01 * i, 3) for i in range(7)]
    got = Dc.segment_decode(rows, cv, starts, "well", "TVT", "GR", 50.0, slopes, keep=16, evidence=1.0)
    d = got.join(hw.select("well", "row_idx", "TVT"), ["well", "row_idx"]).toPandas()
    assert len(d) == 400 and np.sqrt(((d.decoded_best - d.TVT) ** 2).mean()) < 0.5


def test_lattice_decode_follows_a_line(spark):
    t = np.arange(0, 200, 0.5)
    gr = 60 + 25 * np.sin(t / 5) + 10 * np.sin(t / 2.1)
    step = np.arange(0, 41)
    z, u = 0.3 * step, 80 + np.where(step <= 20, 0.2 * step, 4.0 - 0.1 * (step - 20))
    rows = pd.concat([pd.DataFrame({"g": g, "step": step, "z": z, "signal": np.interp(u - z, t, gr)})[: 41 - cut] for g, cut in (("a", 0), ("b", 7))])
    curve = spark.createDataFrame(pd.DataFrame({"g": np.repeat(["a", "b"], len(t)), "x": np.tile(t, 2), "y": np.tile(gr, 2)}))
    starts = spark.createDataFrame([("a", 80.0, 0.0, 5.0), ("b", 80.0, 0.0, 5.0)], "g string, u0 double, s0 double, gamma double")
    slopes = [-0.2, -0.1, 0.0, 0.1, 0.2]
    got = Dc.lattice_decode(spark.createDataFrame(rows), curve, starts, "g", "x", "y", [10, 20], slopes, 1.0, np.log(15), 1.0, keep=6, sigma=0.2, evidence=1.0, grid_step=0.1).toPandas()
    assert len(got) == 40 + 33
    assert np.abs(got.surface - u[got.step]).max() < 0.3


def test_curve_families(spark):
    runs = {"a": [1, 2, 3, 9], "b": [7, 2, 3, 8], "c": [5, 3, 8, 6], "d": [1, 3, 2, 4]}
    d = spark.createDataFrame([(g, i, v) for g, vs in runs.items() for i, v in enumerate(vs)], "g string, row_idx long, v int")
    assert {r.g: r.family for r in L.curve_families(d, "g", "v", 2).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_positive_ridge_matches_direct_minimisation():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) + 2
    y = x @ np.array([0.6, -0.4, 0.2]) + 1 + rng.normal(0, 0.1, 200)
    m = np.column_stack([x, y])
    pack = np.concatenate([[200], m.sum(0), (m.T @ m)[np.triu_indices(4)]])
    free = D.ridge_from_moments(pack, 1.66, False)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(free[:3], np.linalg.solve(xc.T @ xc + 1.66 * np.eye(3), xc.T @ yc))
    pos = D.ridge_from_moments(pack, 1.66, True)
    cost = lambda w: ((yc - xc @ w) ** 2).sum() + 1.66 * (w**2).sum()
    assert (pos[:3] >= 0).all() and pos[1] == 0
    assert all(cost(pos[:3]) <= cost(np.maximum(0, pos[:3] + rng.normal(0, 0.01, 3))) + 1e-9 for _ in range(200))
    assert np.isclose(D.squared_error(pack, pos), ((y - x @ pos[:3] - pos[3]) ** 2).sum())


def test_group_folds_are_balanced_and_whole(spark):
    d = spark.createDataFrame([(g, i) for g in range(20) for i in range(3 + g)], "g int, i int")
    f = d.join(D.group_folds(d, "g", 4), "g")
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert f.count() == d.count() and max(sizes) - min(sizes) <= 8


def test_pinned_folds_stay(spark, tmp_path):
    d = spark.createDataFrame([(g, i) for g in range(9) for i in range(3)], "g int, i int")
    path = str(tmp_path / "folds")
    first = {r.g: r.fold for r in D.pinned_folds(d, "g", 3, path).collect()}
    more = d.unionByName(spark.createDataFrame([(99, 0)], "g int, i int"))
    second = {r.g: r.fold for r in D.pinned_folds(more, "g", 3, path).collect()}
    assert 99 in second and all(second[g] == f for g, f in first.items())


def test_affine_is_recovered_and_guarded(spark, wells):
    log, curve = wells
    kn = spark.createDataFrame(log[log.TVT_input.notna()]).replace(float("nan"), None)
    hit = interp_join(kn, spark.createDataFrame(curve[["well", "TVT", "GR"]]).withColumnRenamed("GR", "cgr"), ["well"], "TVT_input", "TVT", "cgr", "t")
    got = A.affine(hit, ["well"], F.col("t"), F.col("GR")).toPandas().set_index("well").sort_index()
    assert np.allclose(got.a, [1 + 0.1 * w for w in range(6)], atol=1e-6) and np.allclose(got.b, [3.0 * w for w in range(6)], atol=1e-4)
    few = A.affine(hit, ["well"], F.col("t"), F.col("GR"), min_rows=1000).toPandas()
    assert (few.a == 1).all()


def test_surface_identity_gives_the_target_back(spark, wells):
    log, _ = wells
    d = spark.createDataFrame(log)
    off = d.where("TVT_input is not null and not isnan(TVT_input)").groupBy("well").agg(F.avg(F.col("TVT_input") + F.col("Z") - F.col("ANCC")).alias("off"))
    e = d.join(off, "well").agg(F.max(F.abs(-F.col("Z") + F.col("ANCC") + F.col("off") - F.col("TVT"))).alias("e")).first().e
    assert e < 1e-6


def test_override_statuses(spark):
    base = spark.createDataFrame([(g, float(i), 0.0, float(i) if i < 20 else None) for g in "abc" for i in range(40)], "g string, x double, v double, kv double")
    ref = spark.createDataFrame([("a", float(i), float(i)) for i in range(30)] + [("b", float(i), i + 5.0) for i in range(30)], "g string, rx double, rv double")
    got = G.guarded_override(base, ref, "g", "x", "v", "kv", "rx", "rv", 10, 10, 1.0).toPandas()
    assert {g: s.status.iloc[0] for g, s in got.groupby("g")} == {"a": "ok", "b": "prefix_mismatch", "c": "no_reference"}
    a = got[got.g == "a"].sort_values("x")
    assert list(a.value_out) == [float(i) if i < 30 else 0.0 for i in range(40)]


def test_tracks_softmax(spark):
    tr = spark.createDataFrame([("w", r, s, float(10 * s + r)) for r in range(3) for s in range(4)], "g string, r int, s int, p double")
    ll = spark.createDataFrame([("w", s, float(-s)) for s in range(4)], "g string, s int, ll double")
    got = E.combine_tracks(tr, ll, "g", "r", "s", "p", "ll", [3.0]).orderBy("r").toPandas()
    w = np.exp(-np.arange(4) / 3)
    assert np.allclose(got.scale_3, [(w * (10 * np.arange(4) + r)).sum() / w.sum() for r in range(3)])


def test_sequence_samples_on_planted_wells(spark, wells):
    log, curve = wells
    log = log[log.well.isin(["w0", "w1"])].assign(row_idx=lambda d: d.groupby("well").cumcount())
    hw = spark.createDataFrame(log).replace(float("nan"), None)
    hw = gap_fill(hw, ["well"], "GR", "gr").withColumn("gr_gap", F.when(F.col("GR").isNull(), 1.0).otherwise(0.0)).withColumn("known", F.col("TVT_input").isNotNull()).cache()
    cuts = P.sample_cuts(hw, "well", "known", [0.5], 40, 30)
    d = P.sequence_samples(hw, spark.createDataFrame(curve[["well", "TVT", "GR"]]), cuts, "well", "known", "MD", "Z", "TVT", "gr", "TVT", "GR", 4.0, 16, (-8, 0, 8)).toPandas()
    assert set(d.cut) == {"nat", "c50"} and set(d.well) == {"w0", "w1"}
    s = d[(d.well == "w0") & (d.cut == "nat")].sort_values("step")
    md = 99 + 4.0 * (s.step.to_numpy() - 16)
    w0 = log[log.well == "w0"]
    want = np.clip((np.interp(md, w0.MD, w0.TVT) - w0.TVT.iloc[99]) / 10, -12, 12)
    assert np.allclose(s.target, want) and (s.is_tail.to_numpy() == (md > 99)).all()


def test_trees_predict_rows_with_missing_features(spark):
    """A user with one known row has no slope, one without views no curve; nulls in a target are not learned from."""
    from bedtrace.operators.features import feature_table
    from bedtrace.operators.models import group_folds, oof_trees

    rows = [(u, i, float(i), float(u + i), None if u == 7 else float(i % 3), i * 10 < n * 3, n) for u in range(12) for n in [3 if u == 5 else 20] for i in range(n)]
    log = spark.createDataFrame(rows, "u long, row_idx long, x double, value double, sig double, known boolean, n_rows long")
    curve = spark.createDataFrame([(u, float(c), float(c + u)) for u in range(12) if u != 7 for c in range(0, 21, 5)], "u long, cx double, cy double")
    d = feature_table(log, ["u"], "x", "value", "sig", "known", curve).where(~F.col("known")).join(group_folds(log, "u", 3), "u")
    inputs = ["s_mean201", "frac", "known_mean", "known_slope", "curve"]
    params = {"maxIter": 3, "maxDepth": 2}
    out, gains = oof_trees(d, inputs, "value", "u", "fold", 3, params, anchor="known_mean")
    got = out.toPandas()
    assert got.known_slope.isna().any() and got.curve.isna().any() and got.s_mean201.isna().any()
    assert len(got) == d.count() and got.oof.notna().all() and {5, 7} <= set(got.u)
    assert set(out.columns) == {*d.columns, "oof"}
    table = gains.toPandas()
    assert sorted(table.feature) == sorted(inputs * 3) and np.allclose(table.groupby("fold").gain.sum(), 1)

    d = spark.createDataFrame([(g, g % 2, float(i), None if i == 4 else 10.0) for g in range(40) for i in range(5)], "g long, fold int, a double, y double")
    got = oof_trees(d, ["a"], "y", "g", "fold", 2, params)[0].toPandas()
    assert len(got) == 200 and np.allclose(got.oof, 10)


def test_sequence_samples_write_cuts_not_the_grid(spark, monkeypatch):
    """On the way only rows per cut and the few steps before it are written, not the whole grid several times."""
    import bedtrace.session as S
    from bedtrace.plans import REGISTRY

    written, store = [], S.store

    def counted(df, by=()):
        path = store(df, by)
        written.append(spark.read.parquet(path).count())
        return path

    old = spark.conf.get(S.CELL_ROWS_CONF)
    spark.conf.set(S.CELL_ROWS_CONF, "100000")
    monkeypatch.setattr(S, "store", counted)
    try:
        n = REGISTRY["d27_sequence_samples"].run(spark, "/root/testdata/sf0.01").count()
    finally:
        spark.conf.set(S.CELL_ROWS_CONF, old)
    assert sum(written) < 1.5 * n
