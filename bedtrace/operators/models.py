"""Folds, out-of-fold models and stacks.

Linear stacks only need sums of products: one aggregation per (tier, fold), then small solves over one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.functions.columns import is_finite
from bedtrace.operators.cells import index_rows
from bedtrace.session import cut_lineage


def group_folds(df: DataFrame, group: str, k: int, name: str = "fold") -> DataFrame:
    """Fold per group, balanced by rows: groups from large to small are dealt out back and forth (0..k-1, k-1..0, ...)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_neg", -F.col("_rows"))
    d = index_rows(sizes, [], ["_neg", group], "_neg", "_r")
    lap = F.floor(F.col("_r") / k) % 2
    return d.select(group, F.when(lap == 0, F.col("_r") % k).otherwise(k - 1 - F.col("_r") % k).cast("int").alias(name))


def spatial_folds(df: DataFrame, group: str, x: str, y: str, cell: float, k: int, name: str = "fold") -> DataFrame:
    """Fold per group from the XY cell of its mean place, so that close groups share a fold."""
    at = df.groupBy(group).agg(F.floor(F.avg(x) / cell).alias("_cx"), F.floor(F.avg(y) / cell).alias("_cy"))
    return at.select(group, hash_fold(F.concat_ws(",", "_cx", "_cy"), k).alias(name))


def hash_fold(text: Column, k: int) -> Column:
    """0..k-1 from the first eight hex digits of a text's MD5, the same in every engine."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % k).cast("int")


def pinned_folds(df: DataFrame, group: str, k: int, path: str) -> DataFrame:
    """The stored fold table at ``path``; made and stored on first use. Groups that are new since then get folds of
    their own by hash, stored folds never change."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        group_folds(df, group, k).write.parquet(path)
    stored = spark.read.parquet(path)
    new = df.select(group).distinct().join(stored, group, "left_anti")
    return stored.unionByName(new.select(group, F.pmod(F.xxhash64(group), F.lit(k)).cast("int").alias("fold")))


def oof_trees(
    df: DataFrame, features: Sequence[str], target: str, group: str, fold: str, folds: int, params: dict | None = None,
    winsor: float | None = 90.0, anchor: str | None = None, out: str = "oof",
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of a gradient-boosted tree model, one fit per fold, and the gain of each feature in each fit.

    Rows without a fold are new to all models and get the mean of their predictions. A missing feature (null or NaN)
    drops no row: it counts as the least value of its column, beside a flag that tells the two apart and whose gain is
    added to the feature's. Rows without a target are predicted and not learned from; without an ``anchor`` value the
    prediction is null.

    The target is limited to +-``winsor`` while fitting; with ``anchor`` the model learns the residual to that column. A
    tenth of the training groups (by hash) stops the boosting early.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    params = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 7, **(params or {})}
    base = F.col(anchor) if anchor else F.lit(0.0)
    y = F.col(target) - base
    bounded = y if winsor is None else F.least(F.greatest(y, F.lit(-winsor)), F.lit(winsor))
    bounded = F.when(y.isNotNull() & ~F.isnan(y), bounded)  # greatest and least pass over nulls
    ready = df.withColumns({"_y": bounded, "_stop": F.pmod(F.xxhash64(group, F.lit("stop")), F.lit(10)) == 0})
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    ready = cut_lineage(ready)
    seen = ready.agg(*[F.min(value[c]).alias(f"v{i}") for i, c in enumerate(features)], *[F.count_if(value[c].isNull()).alias(f"n{i}") for i, c in enumerate(features)]).first()  # one row
    gaps = [i for i in range(len(features)) if seen[f"n{i}"]]
    filled = {f"_f{i}": F.coalesce(value[c], F.lit(seen[f"v{i}"]), F.lit(0.0)) for i, c in enumerate(features)}
    flags = {f"_g{i}": value[features[i]].isNull().cast("double") for i in gaps}
    ready = ready.withColumns(filled | flags)
    ready = VectorAssembler(inputCols=[*filled, *flags], outputCol="_x").transform(ready).drop(*filled, *flags)
    ready = cut_lineage(ready)
    learned = ready.where(F.col("_y").isNotNull())
    parts, gains, models = [], [], []
    # few groups can leave the training folds of a fit without a stopping group: all its trees are then grown
    stops = {r[0] for r in learned.where(F.col("_stop") & F.col(fold).isNotNull()).select(fold).distinct().collect()}  # at most one row per fold
    for f in range(folds):
        early = {"validationIndicatorCol": "_stop"} if stops - {f} else {}
        model = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", **early, **params).fit(
            learned.where(F.col(fold) != f).select("_x", "_y", "_stop"))
        parts.append(model.transform(ready.where(F.col(fold) == f)))
        models.append(model)
        gain = model.featureImportances.toArray()
        of_flag = dict(zip(gaps, gain[len(features):]))
        gains += [(f, name, float(gain[i] + of_flag.get(i, 0.0))) for i, name in enumerate(features)]
    new = ready.where(F.col(fold).isNull())
    for i, model in enumerate(models):
        new = model.transform(new).withColumnRenamed("_p", f"_p{i}")
    new = new.withColumn("_p", sum((F.col(f"_p{i}") for i in range(folds)), F.lit(0.0)) / folds).drop(*[f"_p{i}" for i in range(folds)])
    parts.append(new)
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    table = df.sparkSession.createDataFrame(gains, "fold int, feature string, gain double")  # features x folds rows
    return res.withColumn(out, F.col("_p") + base).drop("_x", "_y", "_stop", "_p"), table


def moments(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Row count, sums and products of the columns and the target (last) per key, as columns ``_n``, ``_s*``, ``_p*``."""
    names = [*cols, target]
    ok = F.lit(True)
    for c in names:
        ok = ok & is_finite(F.col(c))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return df.where(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.sum(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).cast("double").alias(f"_p{i}_{j}") for i, j in pairs])


def packed_moments(m: DataFrame, size: int) -> Column:
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    return F.array(F.col("_n"), *[F.col(f"_s{i}") for i in range(size)], *[F.col(f"_p{i}_{j}") for i, j in pairs])


def train_and_test(m: DataFrame, keys: Sequence[str], fold: str, size: int) -> DataFrame:
    """Moments of each fold (``test``) and of all other folds of the same key (``train``)."""
    w = Window.partitionBy(*keys)  # one row per fold
    cols = [c for c in m.columns if c.startswith("_")]
    own = m.withColumn("test", packed_moments(m, size))
    rest = own.withColumns({c: F.sum(c).over(w) - F.col(c) for c in cols})
    return rest.withColumn("train", packed_moments(m, size)).select(*keys, fold, "train", "test")


def _unpack(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    size = int((-3 + np.sqrt(9 + 8 * (len(v) - 1))) / 2 + 0.5)
    s = v[1 : 1 + size]
    p = np.zeros((size, size))
    p[np.triu_indices(size)] = v[1 + size :]
    return float(v[0]), s, p + np.triu(p, 1).T


def ridge_from_moments(v: np.ndarray, alpha: float, positive: bool, use: np.ndarray | None = None) -> np.ndarray:
    """Coefficients and intercept (last) of a ridge fit with penalty on the coefficients only, optionally >= 0.

    Coordinate descent on the centred Gram matrix; ``use`` masks the members.
    """
    n, s, p = _unpack(np.asarray(v, float))
    k = len(s) - 1
    w = np.zeros(k)
    if n < 2:
        return np.append(w, s[-1] / n if n else 0.0)
    g = p[:k, :k] - np.outer(s[:k], s[:k]) / n
    c = p[:k, k] - s[:k] * s[k] / n
    keep = np.flatnonzero(np.ones(k, bool) if use is None else np.asarray(use, bool))
    if not positive and len(keep):
        w[keep] = np.linalg.solve(g[np.ix_(keep, keep)] + alpha * np.eye(len(keep)), c[keep])
    else:
        w = _non_negative(g + alpha * np.eye(k), c, keep)
    return np.append(w, (s[k] - s[:k] @ w) / n)


def _non_negative(a: np.ndarray, c: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """The w >= 0 (0 outside ``usable``) with the least w'aw / 2 - c'w, by active sets.

    A coordinate with a positive slope is freed, the free ones are solved for exactly, and a step stops where one of
    them would turn negative, which is then fixed at 0. Each round lowers the objective, so no set of free coordinates
    comes twice and the search ends; the limit is for rounding only and is reported.
    """
    w, free = np.zeros(len(c)), np.zeros(len(c), bool)
    scale = 1e-12 * max(1.0, float(np.abs(c).max(initial=0.0)))
    for _ in range(20 * len(c) + 20):
        slope = c - a @ w
        able = [j for j in usable if not free[j] and slope[j] > scale]
        if not able:
            return w
        free[max(able, key=lambda j: slope[j])] = True
        while True:
            z = np.zeros(len(c))
            z[free] = np.linalg.solve(a[np.ix_(free, free)], c[free])
            low = free & (z <= 0)
            if not low.any():
                break
            part = (w[low] / np.maximum(w[low] - z[low], 1e-300)).min()
            w = w + part * (z - w)
            free &= w > 1e-15 * max(1.0, float(np.abs(w).max()))
            w[~free] = 0.0
        w = z
    raise ArithmeticError("non-negative least squares did not settle")


def squared_error(v: np.ndarray, coef: np.ndarray) -> float:
    """Sum of squared errors of a linear model, out of the moments alone."""
    n, s, p = _unpack(np.asarray(v, float))
    full = np.zeros((len(s) + 1, len(s) + 1))
    full[: len(s), : len(s)], full[-1, : len(s)], full[: len(s), -1], full[-1, -1] = p, s, s, n
    k = len(s) - 1
    e = np.concatenate([coef[:k], [-1.0], [coef[k]]])
    return float(max(0.0, e @ full @ e))


RIDGE = T.StructType([T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType()), T.StructField("n", T.DoubleType())])


@F.pandas_udf(RIDGE)
def fit_ridge(train: pd.Series, test: pd.Series, use: pd.Series, alpha: pd.Series, positive: pd.Series) -> pd.DataFrame:
    out = []
    for tr, te, u, a, pos in zip(train, test, use, alpha, positive):
        coef = ridge_from_moments(tr, float(a), bool(pos), u)
        out.append((coef.tolist(), squared_error(te, coef), float(te[0])))
    return pd.DataFrame(out, columns=["coef", "sse", "n"])


def linear_prediction(coef: Column, cols: Sequence[str]) -> Column:
    v = F.get(coef, F.lit(len(cols)))
    for i, c in enumerate(cols):
        v = v + F.get(coef, F.lit(i)) * F.col(c)
    return v


def ridge_table(
    df: DataFrame, cols: Sequence[str], target: str, fold: str, keys: Sequence[str] = (), alphas: Sequence[float] = (1.66,),
    subsets: Sequence[Sequence[bool]] | None = None, positive: bool = True,
) -> DataFrame:
    """Per key, fold, member subset and alpha: the fit on the other folds and its squared error on the fold itself."""
    size = len(cols) + 1
    m = moments(df, cols, target, [*keys, fold])
    t = train_and_test(m, keys, fold, size)
    masks = [[bool(b) for b in s] for s in (subsets or [[True] * len(cols)])]
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("subset"), F.array(*[F.lit(b) for b in s]).alias("use"), F.lit(float(a)).alias("alpha"))
                               for i, s in enumerate(masks) for a in alphas]))
    d = t.withColumn("_g", grid).select(*keys, fold, "train", "test", "_g.*")
    d = d.withColumn("_f", fit_ridge("train", "test", "use", "alpha", F.lit(positive)))
    return d.select(*keys, fold, "subset", "alpha", "_f.*")


def oof_ridge(df: DataFrame, cols: Sequence[str], target: str, fold: str, keys: Sequence[str] = (), alpha: float = 1.66,
              positive: bool = True, out: str = "stack") -> DataFrame:
    """Out-of-fold stack: every row is predicted by the model of the other folds (of its own tier when ``keys`` is given)."""
    return with_stack(df, ridge_table(df, cols, target, fold, keys, [alpha], None, positive), cols, [*keys, fold], out)


def with_stack(df: DataFrame, table: DataFrame, cols: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """Predictions by the coefficients ``coef`` of a table per key. It is written first, so the planner knows its size and
    broadcasts it only while it is small."""
    coef = cut_lineage(table.select(*keys, "coef"))
    return df.join(coef, list(keys), "left").withColumn(out, linear_prediction(F.col("coef"), cols)).drop("coef")


def risk_quartiles(df: DataFrame, risk: str, order: Sequence[str], name: str = "tier") -> DataFrame:
    """Quarter 0..3 of each row by the rank of ``risk`` over all rows (missing counts as 0), ties by ``order``."""
    d = df.withColumn("_risk", F.coalesce(F.nanvl(F.col(risk).cast("double"), F.lit(0.0)), F.lit(0.0)))
    d = index_rows(d, [], ["_risk", *order], "_risk", "_rank", "_rows")
    quarter = sum((4 * F.col("_rank") > j * (F.col("_rows") - 1)).cast("int") for j in (1, 2, 3))
    return d.withColumn(name, quarter).drop("_risk", "_rank", "_rows")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def recalibrate(train: pd.Series, coef: pd.Series, alpha: pd.Series, min_rows: pd.Series) -> pd.Series:
    """Coefficients of c + a * model, the ridge of the target on the model's own prediction, out of the same moments."""
    out = []
    for v, w, a, least in zip(train, coef, alpha, min_rows):
        w = np.asarray(w, float)
        n, s, p = _unpack(np.asarray(v, float))
        if n < least:
            out.append(w.tolist())
            continue
        x = w[:-1]
        g = p - np.outer(s, s) / n  # centred: predictions differ little beside their size
        slope = (x @ g[:-1, -1]) / (x @ g[:-1, :-1] @ x + a)
        out.append([*(slope * x), (s[-1] - slope * (s[:-1] @ x)) / n])
    return pd.Series(out)


def recalibrated_ridge(
    df: DataFrame, cols: Sequence[str], target: str, fold: str, tier: str, alpha: float = 1.66, second: float = 10.0,
    min_rows: int = 1000, positive: bool = True, out: str = "stack",
) -> DataFrame:
    """One out-of-fold ridge for all tiers, then a line on its predictions per tier, both fitted on the other folds only.

    Tiers with fewer than ``min_rows`` training rows keep the first stage. Both stages come from one aggregation of the
    rows by (tier, fold): sums over predictions follow from the sums over members.
    """
    size = len(cols) + 1
    m = cut_lineage(moments(df, cols, target, [tier, fold]))
    sums = [c for c in m.columns if c.startswith("_")]
    whole = m.groupBy(fold).agg(*[F.sum(c).alias(c) for c in sums])
    use = F.array(*[F.lit(True)] * len(cols))
    first = train_and_test(whole, [], fold, size).select(
        fold, fit_ridge("train", "train", use, F.lit(float(alpha)), F.lit(positive))["coef"].alias("_first"))
    # every tier meets every fold, also one in which it has no complete row
    blank = m.select(tier).distinct().crossJoin(m.select(fold).distinct())  # tiers x folds rows
    full = blank.join(m, [tier, fold], "left").fillna(0.0, sums)
    table = train_and_test(full, [tier], fold, size).join(first, fold)
    return with_stack(df, table.withColumn("coef", recalibrate("train", "_first", F.lit(float(second)), F.lit(min_rows))), cols, [tier, fold], out)


def huber_ridge(
    df: DataFrame, cols: Sequence[str], target: str, fold: str, keys: Sequence[str] = (), delta: float = 8.0, alpha: float = 1.66,
    rounds: int = 20, tol: float = 1e-9, positive: bool = False, out: str = "stack",
) -> DataFrame:
    """Out-of-fold ridge under Huber's loss (quadratic up to ``delta``, linear beyond), fitted apart for each of ``keys``.

    Each round weighs a row by min(1, delta / |residual|) of every model that learns from it and sums weighted products
    per (key, model), map-side combined: rows are read once a round and never shuffled but for the sums. The rounds end
    when no coefficient moves by more than ``tol`` of the largest, or after ``rounds``. Rows with a member or target that
    is not finite are not learned from.
    """
    names = [*cols, target]
    ok = F.lit(True)
    for c in names:
        ok = ok & is_finite(F.col(c))
    rows = df.where(ok).select(*keys, F.col(fold).alias("_fold"), *[F.col(c).cast("double").alias(c) for c in names])
    models = [r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect()]  # one row per fold
    kind = df.schema[fold].dataType
    others = F.explode(F.filter(F.array(*[F.lit(f).cast(kind) for f in models]), lambda f: f != F.col("_fold")))
    rows = cut_lineage(rows.withColumn(fold, others))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    at = [*keys, fold]
    use = F.array(*[F.lit(True)] * len(cols))
    coef = None
    for _ in range(rounds + 1):
        if coef is None:
            d = rows.withColumn("_w", F.lit(1.0))
        else:
            r = F.abs(linear_prediction(F.col("coef"), cols) - F.col(target))
            d = rows.join(coef, at).withColumn("_w", F.when(r <= delta, 1.0).otherwise(delta / r))
        w = F.col("_w")
        m = d.groupBy(*at).agg(
            F.sum(w).alias("_n"), *[F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in enumerate(names)],
            *[F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"_p{i}_{j}") for i, j in pairs])
        train = m.select(*at, packed_moments(m, len(names)).alias("_t"))
        new = cut_lineage(train.select(*at, fit_ridge("_t", "_t", use, F.lit(float(alpha)), F.lit(positive))["coef"].alias("coef")))
        if coef is not None:
            moved = new.join(coef.withColumnRenamed("coef", "_old"), at).select(
                F.array_max(F.zip_with("coef", "_old", lambda a, b: F.abs(a - b))).alias("d"), F.array_max(F.transform("coef", F.abs)).alias("m"))
            top = moved.agg(F.max(F.col("d") - tol * F.col("m")).alias("d")).first()["d"]  # one row
            if top is None or top <= 0:
                return with_stack(df, new, cols, at, out)
        coef = new
    return with_stack(df, coef, cols, at, out)


def search_score(table: DataFrame, keys: Sequence[str] = ("subset", "alpha")) -> DataFrame:
    """Out-of-fold error of every configuration of a ridge table."""
    return table.groupBy(*keys).agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"), F.sum("n").cast("long").alias("n"))


def risk_weight(risk: Column, strength: float, edge: float = 3.39, span: float = 2.0) -> Column:
    """1 + strength * clip((risk - edge) / span, 0, 1)."""
    return 1 + strength * F.least(F.greatest((risk - edge) / span, F.lit(0.0)), F.lit(1.0))


def keep_columns(df: DataFrame, keep: str | None = None, drop: str | None = None, listed: Sequence[str] | None = None) -> list[str]:
    """Column names chosen by pattern or list."""
    import re

    names = [c for c in df.columns if listed is None or c in set(listed)]
    names = [c for c in names if keep is None or re.search(keep, c)]
    return [c for c in names if drop is None or not re.search(drop, c)]
