"""Bringing a reference curve to the units of a log, and measures of how well both agree on the known prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtrace.functions.columns import clip
from bedtrace.operators.cells import framed, index_rows, with_group_stats
from bedtrace.operators.interp import interp_join
from bedtrace.operators.quantiles import grouped_quantiles
from bedtrace.operators.sequence import rolling


def both_set(*cols: Column) -> Column:
    out = cols[0].isNotNull()
    for c in cols[1:]:
        out = out & c.isNotNull()
    return out


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate; null without spread on either side."""
    ok = both_set(x, y)
    px, py = F.when(ok, x), F.when(ok, y)
    return F.try_divide(F.covar_pop(px, py), F.sqrt(F.var_pop(px) * F.var_pop(py)))


def slope(df: DataFrame, group: Sequence[str], x: Column, y: Column, out: str = "slope") -> DataFrame:
    """Least-squares slope per group; 0 below two rows or without spread in x."""
    ok = both_set(x, y)
    px, py = F.when(ok, x), F.when(ok, y)
    s = df.groupBy(*group).agg(
        F.count(px).alias("_n"), F.stddev_pop(px).alias("_s"), F.regr_slope(py, px).alias("_b"))
    return s.select(*group, F.when((F.col("_n") >= 2) & (F.col("_s") >= 1e-6), F.col("_b")).otherwise(0.0).alias(out))


def affine(
    df: DataFrame, group: Sequence[str], x: Column, y: Column, min_rows: int = 20, lo: float = 0.2, hi: float = 5.0
) -> DataFrame:
    """``(a, b)`` of y = a x + b per group.

    Falls back to ``(1, mean y - mean x)`` when there are too few rows, x has no spread, or a is outside [lo, hi].
    """
    ok = both_set(x, y)
    px, py = F.when(ok, x), F.when(ok, y)
    s = df.groupBy(*group).agg(
        F.count(px).alias("_n"), F.stddev_pop(px).alias("_s"), F.regr_slope(py, px).alias("_a"),
        F.regr_intercept(py, px).alias("_b"), (F.avg(py) - F.avg(px)).alias("_d"))
    good = (F.col("_n") >= min_rows) & (F.col("_s") >= 1e-6) & F.col("_a").between(lo, hi)
    return s.select(
        *group,
        F.col("_n").alias("pairs"),
        F.when(good, F.col("_a")).otherwise(1.0).alias("a"),
        F.when(good, F.col("_b")).otherwise(F.coalesce("_d", F.lit(0.0))).alias("b"),
    )


def curve_band(curve: DataFrame, known: DataFrame, group: Sequence[str], cx: str, x: str, margin: float, min_rows: int) -> DataFrame:
    """Curve rows within ``margin`` of the known x range; the whole curve where fewer than ``min_rows`` remain."""
    span = known.groupBy(*group).agg((F.min(x) - margin).alias("_lo"), (F.max(x) + margin).alias("_hi"))
    c = curve.join(span, list(group)).withColumn("_in", F.col(cx).between(F.col("_lo"), F.col("_hi")))
    c = with_group_stats(c, group, {"_nin": F.count_if("_in")})
    return c.where(F.col("_in") | (F.col("_nin") < min_rows)).drop("_lo", "_hi", "_in", "_nin")


def band_calibrate(
    known: DataFrame,
    curve: DataFrame,
    group: Sequence[str],
    x: str,
    y: str,
    cx: str,
    cy: str,
    margin: float = 10.0,
    min_rows: int = 30,
    min_band: int = 20,
) -> DataFrame:
    """Per group the ``(a, b)`` of three ways to map the curve to log units: offset, variance match, affine.

    ``known`` holds the known prefix. All three come from one pass over the band and one over the interpolated prefix.
    """
    band = curve_band(curve, known, group, cx, x, margin, min_band).groupBy(*group).agg(
        F.avg(cy).alias("bm"), F.stddev_pop(cy).alias("sb"))
    hit = interp_join(known, curve, group, x, cx, cy, "_t")
    t, g = F.col("_t"), F.col(y)
    pt, pg = F.when(g.isNotNull(), t), F.when(t.isNotNull(), g)
    fit = hit.groupBy(*group).agg(
        F.count(g).alias("n"), F.avg(g).alias("km"), F.stddev_pop(g).alias("sk"), F.count(pt).alias("np"),
        F.stddev_pop(pt).alias("st"), F.regr_slope(pg, pt).alias("ra"), F.regr_intercept(pg, pt).alias("rb"))
    d = fit.join(band, list(group))
    shift = F.col("km") - F.col("bm")
    enough = F.col("n") >= min_rows
    va = F.when(F.col("sb") > 1e-6, clip(F.try_divide("sk", "sb"), 0.2, 5.0)).otherwise(1.0)
    ok = enough & (F.col("np") >= min_rows) & (F.col("st") >= 1e-6) & F.col("ra").between(0.2, 5.0)
    return d.select(
        *group,
        F.when(enough, shift).otherwise(0.0).alias("offset_b"),
        F.when(enough, va).otherwise(1.0).alias("var_a"),
        F.when(enough, F.col("km") - va * F.col("bm")).otherwise(0.0).alias("var_b"),
        F.when(ok, F.col("ra")).otherwise(1.0).alias("affine_a"),
        F.when(ok, F.col("rb")).when(enough, shift).otherwise(0.0).alias("affine_b"),
    )


def segment_offsets(df: DataFrame, group: Sequence[str], b: str, pos: str = "row_idx", late_rows: int = 50) -> DataFrame:
    """Per group: median of ``b`` over all rows, the first third, the middle third, the last rows, and an average that
    favours late rows by ``exp(0.02 i)``."""
    d = with_group_stats(df, group, {"_n": F.max(pos) + 1})
    n, p = F.col("_n"), F.col(pos)
    t1, t2 = F.floor(n / 3), F.floor(2 * n / 3)
    first = p < F.greatest(F.lit(1).cast("long"), t1)
    middle = (p >= t1) & (p < F.greatest(t1 + 1, t2))
    v = F.col(b)
    q = grouped_quantiles(d, group, {
        "b_full": (v, 0.5),
        "b_early": (F.when(first, v), 0.5),
        "b_mid": (F.when(middle, v), 0.5),
        "b_late": (F.when(p >= n - late_rows, v), 0.5),
    })
    w = F.exp(0.02 * (p - n + 1))  # shifted by the last row, so long groups do not overflow
    weighted = d.where(v.isNotNull()).groupBy(*group).agg((F.sum(w * v) / F.sum(w)).alias("b_wls"))
    return q.join(weighted, list(group))


def residual_stats(df: DataFrame, group: Sequence[str], residual: Column) -> DataFrame:
    """Root mean square, bias and population spread of a residual per group."""
    return df.groupBy(*group).agg(
        F.sqrt(F.avg(residual * residual)).alias("rmse"), F.avg(residual).alias("bias"), F.stddev_pop(residual).alias("spread"))


def noise_scale(df: DataFrame, group: Sequence[str], signal: str, reference: str) -> DataFrame:
    """Two noise scales: population std of (signal, missing taken as 0) - reference limited to 10..60, and the median
    absolute residual limited to 5..40. Taking missing as 0 is deliberate: gaps widen the scale."""
    zero = F.coalesce(F.col(signal), F.lit(0.0)) - F.col(reference)
    wide = df.groupBy(*group).agg(clip(F.stddev_pop(zero), 10, 60).alias("std_scale"))
    med = grouped_quantiles(df, group, {"_m": (F.abs(F.col(signal) - F.col(reference)), 0.5)})
    return wide.join(med, list(group), "left").select(*group, "std_scale", clip(F.col("_m"), 5, 40).alias("median_scale"))


def exit_slope(df: DataFrame, group: Sequence[str], y: str, x: str, rows: int = 30, pos: str = "row_idx") -> DataFrame:
    """Median slope between consecutive rows among the last ``rows`` rows; 0 with fewer than three positive steps."""
    d = with_group_stats(df, group, {"_end": F.max(pos)}).where(F.col(pos) > F.col("_end") - rows)
    start = F.greatest(F.lit(0).cast("long"), F.col("_end") - rows + 1)
    d = framed(d, group, 1, 0, lambda w: {"_px": F.lag(x).over(w), "_py": F.lag(y).over(w)}, pos)
    step = F.col(x) - F.col("_px")
    rate = F.when((F.col(pos) > start) & (step > 0), F.try_divide(F.col(y) - F.col("_py"), step))
    counts = d.groupBy(*group).agg(F.count(rate).alias("_k"))
    med = grouped_quantiles(d, group, {"_m": (rate, 0.5)})
    return counts.join(med, list(group), "left").select(
        *group, F.when(F.col("_k") >= 3, F.col("_m")).otherwise(0.0).alias("exit_slope"))


def agreement(
    known: DataFrame,
    curve: DataFrame,
    group: Sequence[str],
    x: str,
    y: str,
    cx: str,
    cy: str,
    window: int = 101,
    min_rows: int = 100,
    min_band: int = 40,
    margin: float = 10.0,
) -> DataFrame:
    """How much log and curve agree on the known prefix: correlation, correlation after removing the rolling mean, spread
    of the detrended curve near the known range, and the gap between both correlations."""
    hit = interp_join(known.where(F.col(y).isNotNull()), curve, group, x, cx, cy, "_t")
    hit = index_rows(hit.drop("row_idx"), group, [x, "event_id"] if "event_id" in hit.columns else [x], x)
    hit = rolling(hit, group, y, [window], ["mean"], "_ym")
    hit = rolling(hit, group, "_t", [window], ["mean"], "_tm")
    ah, bh = F.col(y) - F.col(f"_ym_mean{window}"), F.col("_t") - F.col(f"_tm_mean{window}")
    flat = 1e-6

    def guarded(n: str, a: str, b: str, c: str) -> Column:
        return F.when((F.col(n) >= min_rows) & (F.col(a) > flat) & (F.col(b) > flat), F.col(c))

    agg = hit.withColumns({"_ah": ah, "_bh": bh}).groupBy(*group).agg(
        F.count(y).alias("_n"), F.stddev_pop(y).alias("_s1"), F.stddev_pop("_t").alias("_s2"), correlation(F.col(y), F.col("_t")).alias("_c1"),
        F.stddev_pop("_ah").alias("_s3"), F.stddev_pop("_bh").alias("_s4"), correlation(F.col("_ah"), F.col("_bh")).alias("_c2"))
    band = curve_band(curve, known, group, cx, x, margin, 0)
    band = index_rows(band, group, [cx, cy], cx, "_ci")
    band = rolling(band, group, cy, [window], ["mean"], "_cm", pos="_ci")
    hf = band.groupBy(*group).agg(
        F.count(cy).alias("_nb"), F.stddev_samp(F.col(cy) - F.col(f"_cm_mean{window}")).alias("_hf"))
    out = agg.join(hf, list(group), "left")
    raw, detrended = guarded("_n", "_s1", "_s2", "_c1"), guarded("_n", "_s3", "_s4", "_c2")
    return out.select(
        *group, raw.alias("corr_raw"), detrended.alias("corr_detrended"),
        F.when(F.col("_nb") >= min_band, F.col("_hf")).alias("curve_hf_std"), (raw - detrended).alias("corr_gap"))
