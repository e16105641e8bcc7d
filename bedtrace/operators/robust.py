"""Robust polynomial fits per group and piecewise-linear segmentation.

Groups that fit one cell are exchanged once and fitted in their task. For larger ones rows never leave Spark: each pass sums
powers per group (map-side combined) and only the small normal equations, one row per group, go through numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.operators.cells import with_group_stats
from bedtrace.operators.quantiles import grouped_quantiles
from bedtrace.session import bounded_batches, cell_rows, cut_lineage

BROADCAST_GROUPS = 50_000


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(powers: pd.Series, rhs: pd.Series) -> pd.Series:
    """Coefficients from power sums: ``powers[k]`` is the sum of w s^(k0 + k), ``rhs`` one entry per coefficient."""
    out = []
    for p, r in zip(powers, rhs):
        p, r = np.asarray(p, float), np.asarray(r, float)
        n = len(r)
        a = p[np.add.outer(np.arange(n), np.arange(n))]
        out.append(np.linalg.lstsq(a, r, rcond=None)[0] if np.isfinite(a).all() and np.isfinite(r).all() else np.full(n, np.nan))
    return pd.Series(out)


def polynomial(coef: Column, s: Column, degree: int, intercept: bool = True) -> Column:
    """Value at ``s`` of the polynomial with ascending coefficients (at most ``degree``); absent ones count as 0."""
    top = degree if intercept else degree - 1
    v = F.get(coef, F.lit(0)) if top == 0 else F.coalesce(F.get(coef, F.lit(top)), F.lit(0.0))
    for i in range(top - 1, -1, -1):
        c = F.get(coef, F.lit(i))
        v = v * s + (c if i == 0 else F.coalesce(c, F.lit(0.0)))
    return v if intercept else v * s


def _powers(s: Column, top: int) -> list[Column]:
    out = [F.lit(1.0)]
    for _ in range(top):
        out.append(out[-1] * s)
    return out


def _square(c: Column) -> Column:
    return c * c


def robust_polynomial(
    df: DataFrame, group: Sequence[str], s: str, y: str, degree: int | Column, solves: int = 5, width: float = 2.0,
    intercept: bool = True, max_degree: int | None = None, centre_residual: bool = False,
) -> DataFrame:
    """Iteratively reweighted polynomial per group; returns one row per group with ``coef`` (ascending) and ``n``.

    The first solve is unweighted. Later rows are weighted by 1 / (1 + (r / (width sigma))^2) with
    sigma = 1.4826 median |r|; the weight multiplies the residual, so its square enters the sums. ``degree`` may be a
    column of the frame (constant per group); then ``max_degree`` is needed. ``s`` should be scaled to about [0, 1].
    """
    top = max_degree or int(degree)
    deg = degree if isinstance(degree, Column) else F.lit(int(degree))
    shift = 0 if intercept else 1
    rows = df.where(F.col(s).isNotNull() & F.col(y).isNotNull()).select(
        *group, F.col(s).cast("double").alias("_s"), F.col(y).cast("double").alias("_y"), deg.alias("_deg"))
    rows = cut_lineage(rows)
    size = rows.groupBy(*group).count().agg(F.max("count").alias("largest"), F.count(F.lit(1)).alias("groups")).first()  # two numbers
    fits_task = (size["largest"] or 0) <= cell_rows(df.sparkSession)

    def small(d: DataFrame) -> DataFrame:
        # One row per group; joined by broadcast only while the number of groups is known to be small.
        return F.broadcast(d) if size["groups"] <= BROADCAST_GROUPS else d

    def medians(d: DataFrame, value: Column, name: str) -> DataFrame:
        # Groups that are known to fit one cell can use the built-in exact percentile: one shuffle instead of four.
        if fits_task:
            return d.groupBy(*group).agg(F.percentile(value, F.lit(0.5)).alias(name))
        return grouped_quantiles(d, group, {name: (value, 0.5)})

    if fits_task and solves > 1:
        return cut_lineage(_fitted_in_task(rows, group, shift, solves, width, centre_residual))
    fit = None
    for i in range(solves):
        d, w2 = rows, F.lit(1.0)
        if fit is not None:
            d = rows.join(small(fit.drop("n")), list(group))
            w = 1.0 / (1.0 + _square((F.col("_y") - polynomial(F.col("coef"), F.col("_s"), top, intercept)) / (width * F.col("_sigma"))))
            w2 = w * w
        pw = _powers(F.col("_s"), 2 * top)
        sums = d.withColumn("_w", w2).groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"), F.max("_deg").alias("_d"),
            *[F.sum(F.col("_w") * pw[k]).alias(f"_p{k}") for k in range(2 * shift, 2 * top + 1)],
            *[F.sum(F.col("_w") * F.col("_y") * pw[k]).alias(f"_t{k}") for k in range(shift, top + 1)])
        width_ = F.col("_d") + 1 - shift
        powers = F.slice(F.array(*[F.col(f"_p{k}") for k in range(2 * shift, 2 * top + 1)]), F.lit(1), 2 * width_ - 1)
        rhs = F.slice(F.array(*[F.col(f"_t{k}") for k in range(shift, top + 1)]), F.lit(1), width_)
        fit = cut_lineage(sums.select(*group, "n", solve_normal(powers, rhs).alias("coef")))
        if i < solves - 1:
            res = rows.join(small(fit), list(group)).withColumn("_r", F.col("_y") - polynomial(F.col("coef"), F.col("_s"), top, intercept))
            if centre_residual:
                mid = medians(res, F.col("_r"), "_mid")
                res = res.join(mid, list(group)).withColumn("_r", F.col("_r") - F.col("_mid"))
            med = medians(res, F.abs(F.col("_r")), "_med")
            fit = cut_lineage(fit.join(med, list(group)).withColumn("_sigma", 1.4826 * F.col("_med") + 1e-6).drop("_med"))
    return fit


def _fitted_in_task(rows: DataFrame, group: Sequence[str], shift: int, solves: int, width: float, centre: bool) -> DataFrame:
    """All rounds of ``robust_polynomial`` for groups that fit one cell: their values are exchanged once, not per round."""

    def one(s: np.ndarray, y: np.ndarray, deg: int) -> np.ndarray:
        powers = s[None, :] ** np.arange(2 * shift, 2 * deg + 1)[:, None]
        design, w2, at = s[None, :] ** np.arange(shift, deg + 1)[:, None], np.ones(len(s)), np.add.outer(np.arange(deg + 1 - shift), np.arange(deg + 1 - shift))
        for i in range(solves):
            a, r = (powers @ w2)[at], design @ (w2 * y)
            if not (np.isfinite(a).all() and np.isfinite(r).all()):
                return np.full(len(r), np.nan)
            coef = np.linalg.lstsq(a, r, rcond=None)[0]
            if i < solves - 1:
                res = y - coef @ design
                sigma = 1.4826 * np.median(np.abs(res - np.median(res) if centre else res)) + 1e-6
                w2 = 1.0 / np.square(1.0 + np.square(res / (width * sigma)))
        return coef

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fitted(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, y, deg in parts:
            yield pd.Series([one(np.asarray(a, float), np.asarray(b, float), int(g)) for a, b, g in zip(s, y, deg)], dtype=object)

    bounded_batches(rows.sparkSession)
    d = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_s", "_y"))).alias("_v"), F.max("_deg").alias("_d"))
    return d.select(*group, F.size("_v").cast("long").alias("n"), fitted("_v._s", "_v._y", "_d").alias("coef"))


def robust_project(
    df: DataFrame, group: Sequence[str], s: str, y: str, degree: int, solves: int = 5, blend: float | None = 0.75,
    intercept: bool = True, out: str = "projected",
) -> DataFrame:
    """Blend the series with its robust polynomial: (1 - blend) y + blend fit.

    Groups with fewer than degree + 2 rows stay unchanged. ``blend=None`` takes 0.85 where the fit leaves 0 by more than
    15 and 0.60 elsewhere.
    """
    fit = robust_polynomial(df, group, s, y, degree, solves, 2.0, intercept)
    d = df.join(fit, list(group), "left").withColumn("_fit", polynomial(F.col("coef"), F.col(s), degree, intercept))
    if blend is None:
        d = with_group_stats(d, group, {"_exc": F.max(F.abs("_fit"))})
        b = F.when(F.col("_exc") > 15, 0.85).otherwise(0.60)
    else:
        b = F.lit(float(blend))
    ok = (F.col("n") >= degree + 2) & F.col("_fit").isNotNull()
    return d.withColumn(out, F.when(ok, (1 - b) * F.col(y) + b * F.col("_fit")).otherwise(F.col(y))).drop("coef", "n", "_fit", "_exc")


def polynomial_candidates(
    df: DataFrame, group: str, x: str, y: str, known: str, tails: Sequence[int | None], degrees: Sequence[int],
    min_rows: int = 30, spare: int = 12, solves: int = 6, pos: str = "row_idx",
) -> DataFrame:
    """Polynomials fitted to the last known rows and read off on every row: one candidate per (tail, degree).

    A tail of None takes all known rows. Returns long rows ``(group, pos, name, pred)``. x is scaled by the span of the tail.
    """
    k = F.col(known)
    d = with_group_stats(df, [group], {"_end": F.max(F.when(k, F.col(pos)))})
    configs = F.explode(F.array(*[F.struct(F.lit(-1 if t is None else int(t)).alias("tail"), F.lit(int(g)).alias("deg")) for t in tails for g in degrees]))
    fitted = d.where(k).select(group, pos, x, y, "_end", configs.alias("_c")).select("*", "_c.tail", "_c.deg").where(
        (F.col("tail") < 0) | (F.col(pos) > F.col("_end") - F.col("tail")))  # -1: all known rows
    key = [group, "tail", "deg"]
    scale = fitted.groupBy(*key).agg(F.min_by(x, pos).alias("_x0"), (F.max(x) - F.min(x)).alias("_span"), F.count(y).alias("_n"))
    scale = scale.where((F.col("_n") >= min_rows) & (F.col("_n") >= F.col("deg") + spare)).withColumn(
        "_span", F.when(F.col("_span") < 1e-6, 1.0).otherwise(F.col("_span")))
    scale = cut_lineage(scale)
    fitted = fitted.join(scale, key).withColumn("_xs", (F.col(x) - F.col("_x0")) / F.col("_span"))
    coef = robust_polynomial(fitted, key, "_xs", y, F.col("deg"), solves, 2.5, True, max(degrees), True)
    both = coef.join(scale.drop("_n"), key)
    name = F.concat(F.lit("poly_deg"), F.col("deg").cast("string"), F.lit("_tail"), F.when(F.col("tail") < 0, "all").otherwise(F.col("tail").cast("string")))
    return d.select(group, pos, x).join(both, group).select(
        group, pos, name.alias("name"), polynomial(F.col("coef"), (F.col(x) - F.col("_x0")) / F.col("_span"), max(degrees)).alias("pred"))


def segment_curve(df: DataFrame, group: str, x: str, y: str, eps: float = 1.5, min_len: float = 40.0, pos: str = "row_idx") -> DataFrame:
    """Piecewise-linear segmentation by recursive splitting at the largest deviation from the chord.

    All open segments of all groups are handled in one pass per recursion level, and only rows of segments that were
    split go on. x and y must be set on every row. Returns ``(group, a, b, length, rate)``.
    """
    point = F.struct(F.col(pos).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = df.select(group, point.alias("pt"))
    ends = rows.groupBy(group).agg(F.min_by("pt", "pt.p").alias("s"), F.max_by("pt", "pt.p").alias("e"))
    rows = cut_lineage(rows.join(ends.where(F.col("e.p") > F.col("s.p")), group))
    s, e, pt = F.col("s"), F.col("e"), F.col("pt")
    done = None
    while True:
        t = F.try_divide(pt.x - s.x, F.greatest(e.x - s.x, F.lit(1e-9)))
        dev = F.abs(pt.y - (s.y + t * (e.y - s.y)))
        # The split point is the farthest row, at least two rows away from both ends.
        judged = rows.groupBy(group, F.col("s.p").alias("seg")).agg(
            F.first("s").alias("s"), F.first("e").alias("e"), F.max(F.struct(dev.alias("dev"), (-pt.p).alias("n"), pt.alias("pt"))).alias("w"),
            F.max(F.when(pt.p == s.p + 2, pt)).alias("near"), F.max(F.when(pt.p == e.p - 2, pt)).alias("far"))
        span = F.col("e.x") - F.col("s.x")
        mid = F.when(F.col("w.pt.p") < F.col("s.p") + 2, F.col("near")).when(F.col("w.pt.p") > F.col("e.p") - 2, F.col("far")).otherwise(F.col("w.pt"))
        can = (F.col("e.p") - F.col("s.p") >= 4) & (span >= 2 * min_len) & (F.col("w.dev") > eps)
        judged = cut_lineage(judged.select(group, "seg", "s", "e", F.when(can, mid).alias("mid")))
        safe = F.greatest(span, F.lit(1.0))
        final = judged.where(F.col("mid").isNull()).select(
            group, F.col("s.p").alias("a"), F.col("e.p").alias("b"), safe.alias("length"), ((F.col("e.y") - F.col("s.y")) / safe).alias("rate"))
        done = final if done is None else done.unionByName(final)
        split = judged.where(F.col("mid").isNotNull()).select(group, "seg", "mid")
        if split.isEmpty():
            return done
        right = F.col("pt.p") >= F.col("mid.p")
        rows = cut_lineage(rows.withColumn("seg", F.col("s.p")).join(split, [group, "seg"]).select(
            group, "pt", F.when(right, F.col("mid")).otherwise(F.col("s")).alias("s"), F.when(right, F.col("e")).otherwise(F.col("mid")).alias("e")))
