"""Features of one ordered log per group: known prefix, anchor, windows, gaps, gradients.

All functions take a frame with a dense row position (see ``index_rows``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedtrace.functions.columns import clip
from bedtrace.operators.cells import centred, framed, neighbours, position_cells, running, with_group_stats

AGGREGATES: Mapping[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": lambda c: F.when(F.count(c) > 1, F.stddev_samp(c)),
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "count": F.count,
}


def anchor(df: DataFrame, group: Sequence[str], known: str, fields: Sequence[str], pos: str = "row_idx") -> DataFrame:
    """Last known row per group, as ``last_{field}`` columns."""
    k = F.col(known)
    return df.where(k).groupBy(*group).agg(F.max_by(F.struct(*fields), F.col(pos)).alias("_a")).select(
        *group, *[F.col(f"_a.{f}").alias(f"last_{f}") for f in fields]
    )


def eligible(df: DataFrame, group: Sequence[str], known: str, min_known: int, min_eval: int) -> DataFrame:
    """Groups with enough known and enough withheld rows, known rows forming one leading block."""
    k = F.col(known)
    counts = df.groupBy(*group).agg(
        F.count_if(k).alias("known_rows"),
        F.count_if(~k).alias("eval_rows"),
        F.max(F.when(k, F.col("row_idx"))).alias("_lk"),
        F.min(F.when(~k, F.col("row_idx"))).alias("_fe"),
    )
    ok = (F.col("known_rows") >= min_known) & (F.col("eval_rows") >= min_eval) & (F.col("_lk") < F.col("_fe"))
    return counts.where(ok).drop("_lk", "_fe")


def rolling(
    df: DataFrame,
    group: Sequence[str],
    col: str | Column,
    windows: Sequence[int],
    funcs: Sequence[str],
    prefix: str,
    min_rows: int = 1,
    pos: str = "row_idx",
) -> DataFrame:
    """Centred rolling statistics ``{prefix}_{func}{n}``; null when fewer than ``min_rows`` values are in the frame."""
    c = F.col(col) if isinstance(col, str) else col
    half = (max(windows) - 1) // 2

    def build(w: Window) -> dict[str, Column]:
        out = {}
        for n in windows:
            frame = centred(w, n)
            for f in funcs:
                value = F.stddev_samp(c).over(frame) if f == "std" else AGGREGATES[f](c).over(frame)
                least = max(min_rows, 2 if f == "std" else 1)
                if least > 1:
                    value = F.when(F.count(c).over(frame) >= least, value)
                out[f"{prefix}_{f}{n}"] = value
        return out

    return framed(df, group, half, half, build, pos)


def lags(df: DataFrame, group: Sequence[str], col: str, steps: Sequence[int], prefix: str, pos: str = "row_idx") -> DataFrame:
    """``{prefix}_lag{k}`` / ``{prefix}_lead{k}``; beyond the ends the first / last row's value is repeated."""
    k = max(steps)

    def build(w: Window) -> dict[str, Column]:
        out = {f"_g{s}": F.lag(col, s).over(w) for s in steps}
        out.update({f"_d{s}": F.lead(col, s).over(w) for s in steps})
        return out

    out = framed(df, group, k, k, build, pos)
    out = with_group_stats(
        out, group, {"_first": F.min_by(col, pos), "_last": F.max_by(col, pos), "_end": F.max(pos)}
    )
    fill = {f"{prefix}_lag{s}": F.when(F.col(pos) < s, F.col("_first")).otherwise(F.col(f"_g{s}")) for s in steps}
    fill.update({f"{prefix}_lead{s}": F.when(F.col(pos) > F.col("_end") - s, F.col("_last")).otherwise(F.col(f"_d{s}")) for s in steps})
    return out.withColumns(fill).drop("_first", "_last", "_end", *[f"_g{s}" for s in steps], *[f"_d{s}" for s in steps])


def differences(df: DataFrame, group: Sequence[str], col: str, prefix: str, pos: str = "row_idx") -> DataFrame:
    """First and second difference, 0 at the start."""

    def build(w: Window) -> dict[str, Column]:
        return {"_p1": F.lag(col, 1).over(w), "_p2": F.lag(col, 2).over(w)}

    c = F.col(col)
    first = F.when(F.col(pos) < 1, F.lit(0.0)).otherwise(c - F.col("_p1"))
    before = F.when(F.col(pos) < 2, F.lit(0.0)).otherwise(F.col("_p1") - F.col("_p2"))
    second = F.when(F.col(pos) < 1, F.lit(0.0)).otherwise(first - before)
    return framed(df, group, 2, 0, build, pos).withColumns({f"{prefix}_d1": first, f"{prefix}_d2": second}).drop("_p1", "_p2")


def slope_per_axis(df: DataFrame, group: Sequence[str], cols: Sequence[str], axis: str, pos: str = "row_idx") -> DataFrame:
    """``d_{col}``: change per unit of ``axis`` since the previous row; null for a zero step and at the start."""

    def build(w: Window) -> dict[str, Column]:
        step = F.nullif(F.col(axis) - F.lag(axis, 1).over(w), F.lit(0.0))
        return {f"d_{c}": (F.col(c) - F.lag(c, 1).over(w)) / step for c in cols}

    return framed(df, group, 1, 0, build, pos)


def gradient(df: DataFrame, group: Sequence[str], y: str, out: str, x: str | None = None, pos: str = "row_idx") -> DataFrame:
    """Central gradient, one-sided at the ends; with ``x`` the uneven second-order form is used."""
    d = framed(df, group, 1, 1, lambda w: gradient_steps(w, y, x), pos)
    return d.withColumn(out, gradient_value(y, x)).drop("_yp", "_yn", "_hp", "_hn")


def gradient_steps(w: Window, y: str, x: str | None = None) -> dict[str, Column]:
    """What ``gradient_value`` needs of the rows beside a row: ``_yp``, ``_yn``, with ``x`` also ``_hp``, ``_hn``."""
    cols = {"_yp": F.lag(y, 1).over(w), "_yn": F.lead(y, 1).over(w)}
    if x:
        cols.update({"_hp": F.col(x) - F.lag(x, 1).over(w), "_hn": F.lead(x, 1).over(w) - F.col(x)})
    return cols


def gradient_value(y: str, x: str | None = None) -> Column:
    hp, hn = (F.col("_hp"), F.col("_hn")) if x else (F.lit(1.0), F.lit(1.0))
    yp, yn, c = F.col("_yp"), F.col("_yn"), F.col(y)
    back, ahead = F.try_divide(c - yp, hp), F.try_divide(yn - c, hn)
    middle = F.try_divide(hn * back + hp * ahead, hp + hn)
    return F.when(yp.isNotNull() & yn.isNotNull(), middle).otherwise(F.coalesce(back, ahead))


def expanding(df: DataFrame, group: Sequence[str], col: str, out: str, pos: str = "row_idx", one: bool = False) -> DataFrame:
    """Mean of all values up to and including the row. ``one`` as in ``position_cells``."""
    c = F.col(col)
    run = running(position_cells(df, pos, one=one), group, [pos], {"_s": c, "_n": F.when(c.isNotNull(), F.lit(1.0))})
    return run.withColumn(out, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))).drop("_s", "_n", "_cell")


def gap_fill(
    df: DataFrame, group: Sequence[str], col: str, out: str, fallback: float | None = None, pos: str = "row_idx", one: bool = False
) -> DataFrame:
    """Fill nulls by linear interpolation in row position; ends repeat the nearest value, all-null groups get ``fallback``.
    ``one`` as in ``position_cells``."""
    seen = F.when(F.col(col).isNotNull(), F.struct(F.col(pos).alias("x"), F.col(col).cast("double").alias("y")))
    d = neighbours(position_cells(df, pos, one=one), group, [pos], {"_p": seen}, {"_q": seen})
    p, q = F.col("_p"), F.col("_q")
    line = F.when(q.x == p.x, p.y).otherwise(p.y + (q.y - p.y) * (F.col(pos) - p.x) / (q.x - p.x))
    value = F.coalesce(line, p.y, q.y, F.lit(fallback).cast("double"))
    return d.withColumn(out, value).drop("_p", "_q", "_cell")


def missing_density(df: DataFrame, group: Sequence[str], col: str, windows: Sequence[int], prefix: str, pos: str = "row_idx") -> DataFrame:
    """Share of null values in centred windows, plus the 0/1 flag of the row itself."""
    flag = F.when(F.col(col).isNull(), 1.0).otherwise(0.0)
    out = rolling(df.withColumn("_flag", flag), group, "_flag", windows, ["mean"], prefix, pos=pos)
    return out.withColumnRenamed("_flag", f"{prefix}_flag")


def rolling_zscore(
    df: DataFrame, group: Sequence[str], col: str, window: int, min_rows: int, limit: float, out: str, pos: str = "row_idx"
) -> DataFrame:
    """(value - rolling mean) / rolling sample std, limited to +-``limit``; null where the window is too thin."""
    d = rolling(df, group, col, [window], ["mean", "std"], "_z", min_rows, pos)
    m, s = F.col(f"_z_mean{window}"), F.col(f"_z_std{window}")
    return d.withColumn(out, clip(F.when(s > 1e-12, (F.col(col) - m) / s), -limit, limit)).drop(f"_z_mean{window}", f"_z_std{window}")


def known_zone_scale(df: DataFrame, group: Sequence[str], col: str, known: str, out: str) -> DataFrame:
    """(value - known mean) / (known population std + 1e-3)."""
    k = F.when(F.col(known), F.col(col))
    d = with_group_stats(df, group, {"_m": F.avg(k), "_s": F.stddev_pop(k)})
    return d.withColumn(out, (F.col(col) - F.col("_m")) / (F.col("_s") + 1e-3)).drop("_m", "_s")


def even_sample(df: DataFrame, group: Sequence[str], m: int, pos: str = "row_idx") -> DataFrame:
    """At most ``m`` rows per group, evenly spaced from the first to the last (positions truncated to whole rows)."""
    d = with_group_stats(df, group, {"_n": F.max(pos) + 1})
    n, k = F.col("_n"), F.least(F.lit(m).cast("long"), F.col("_n"))
    # Row p is picked iff some j in 0..k-1 has floor(j*(n-1)/(k-1)) = p: the smallest j at or past p decides.
    j = F.ceil(F.try_divide(F.col(pos) * (k - 1), n - 1))
    at = F.floor(j * F.try_divide(n - 1, k - 1))
    hit = F.when(k == n, F.lit(True)).when(k == 1, F.col(pos) == 0).otherwise(at == F.col(pos))
    return d.where(hit).drop("_n")


def tail_rows(df: DataFrame, group: Sequence[str], count: Column | int, pos: str = "row_idx") -> DataFrame:
    """The last ``count`` rows of each group; ``count`` may use ``group_rows``."""
    d = with_group_stats(df, group, {"_end": F.max(pos)}).withColumn("group_rows", F.col("_end") + 1)
    n = F.lit(count) if isinstance(count, int) else F.floor(count)
    return d.where(F.col(pos) > F.col("_end") - n).drop("_end", "group_rows")


def smooth_poly(df: DataFrame, group: Sequence[str], col: str, window: int, degree: int, out: str, pos: str = "row_idx") -> DataFrame:
    """Local polynomial smoothing: every row gets the value at its place of the least-squares polynomial of its window.

    Rows near the ends use the polynomial of the first / last full window. Groups shorter than the window use the
    largest odd window that fits; groups too short for the degree stay unchanged.
    """
    d = with_group_stats(df, group, {"_n": F.max(pos) + 1})
    odd = F.when(F.col("_n") % 2 == 0, F.col("_n") - 1).otherwise(F.col("_n"))
    d = d.withColumn("_w", F.least(F.lit(window).cast("long"), odd))
    weights = smoothing_weights(window, degree)
    options = [o for o in range(degree + 1 + (degree % 2 == 1), window + 1) if o % 2 == 1]
    table = None
    for o in options:
        entry = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights[o]])
        table = F.when(F.col("_w") == o, entry) if table is None else table.when(F.col("_w") == o, entry)
    reach = window - 1

    def build(w: Window) -> dict[str, Column]:
        return {"_vals": F.collect_list(F.col(col).cast("double")).over(w.rowsBetween(-reach, reach))}

    d = framed(d, group, reach, reach, build, pos)
    p, half, n, width = F.col(pos), F.floor((F.col("_w") - 1) / 2), F.col("_n"), F.col("_w")
    start = F.least(F.greatest(p - half, F.lit(0).cast("long")), n - width)
    frame_start = F.greatest(p - reach, F.lit(0).cast("long"))
    piece = F.slice("_vals", (start - frame_start + 1).cast("int"), width.cast("int"))
    place = (p - start).cast("int")
    row = F.get(table, place)
    value = F.aggregate(F.zip_with(piece, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return d.withColumn(out, F.coalesce(value, F.col(col).cast("double"))).drop("_vals", "_n", "_w")


def smoothing_weights(window: int, degree: int) -> dict[int, list[list[float]]]:
    """For each odd width the hat matrix of the polynomial fit: row i holds the weights for place i of the window."""
    import numpy as np

    out = {}
    for width in range(1, window + 1, 2):
        if width <= degree:
            continue
        t = np.arange(width) - (width - 1) / 2
        basis, _ = np.linalg.qr(np.vander(t / max(1.0, (width - 1) / 2), degree + 1))
        out[width] = (basis @ basis.T).tolist()
    return out
