"""One wide table of features per log row, assembled in a fixed number of passes.

The families exist one by one in ``sequence`` and ``interp``; asked for one after another each would number, shuffle and
sort the log again. Here the numbered log is written once, the curve, running means and gap filling take one pass each while the
rows are narrow, group statistics one aggregation, and all frames of bounded reach share one window pass at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedtrace.functions.columns import clip
from bedtrace.operators.cells import centred, fits_cell, framed
from bedtrace.operators.interp import PREV, NEXT, bracket_join, interpolated
from bedtrace.operators.sequence import expanding, gap_fill
from bedtrace.session import cut_lineage


def feature_table(
    log: DataFrame, group: Sequence[str], x: str, value: str, signal: str, known: str, curve: DataFrame | None = None, cx: str = "cx", cy: str = "cy",
    windows: Sequence[int] = (5, 21, 51, 101, 201), steps: Sequence[int] = (1, 5, 15, 30), z_window: int = 101, z_rows: int = 20, z_limit: float = 8.0,
    count: str = "n_rows", pos: str = "row_idx",
) -> DataFrame:
    """``log`` with its features.

    Prefix ``s_`` is for ``signal`` (may be missing), ``v_`` for ``value``. Rolling means and deviations, largest value and
    energy over 21 rows, share of missing values, limited z-score; lags and leads (the ends repeated), differences,
    running mean, filled gaps; place past the known prefix, distance to its last row, and its mean, deviation and slope;
    the reference curve at ``x`` (end knots held) and the difference to it.
    """
    log = d = cut_lineage(log)
    # The curve comes first: its knots bring the one exchange. Where the groups fit one cell all else follows in its tasks.
    if curve is not None:
        d = bracket_join(d, curve, group, x, cx, cy).withColumn("curve", interpolated(F.col(x))).drop(PREV, NEXT)
        d = d.withColumn("from_curve", F.col(value) - F.col("curve"))
    one = fits_cell(log, pos)
    d = gap_fill(expanding(d, group, signal, "s_running", pos, one), group, signal, "s_filled", 0.0, pos, one)
    s, v, p, k = F.col(signal), F.col(value), F.col(pos), F.col(known)
    stats = {
        "_first": F.min_by(v, p), "_last": F.max_by(v, p), "known_len": F.count_if(k), "_kx": F.max_by(F.when(k, F.col(x)), F.when(k, p)),
        "known_mean": F.avg(F.when(k, v)), "known_std": F.stddev_pop(F.when(k, v)), "known_slope": F.regr_slope(F.when(k, v), F.when(k, F.col(x))),
        "s_group_mean": F.avg(s),
    }
    d = d.join(log.groupBy(*group).agg(*[c.alias(n) for n, c in stats.items()]), list(group))
    sq = s * s
    missing = F.when(s.isNull(), 1.0).otherwise(0.0)
    reach = max((max([*windows, z_window]) - 1) // 2, *steps)

    def build(w: Window) -> dict[str, Column]:
        out = {}
        for n in windows:
            f = centred(w, n)
            out[f"s_mean{n}"] = F.avg(s).over(f)
            out[f"s_std{n}"] = F.coalesce(F.stddev_samp(s).over(f), F.lit(0.0))
        f = centred(w, 21)
        out |= {"s_max21": F.max(s).over(f), "s_energy21": F.sqrt(F.avg(sq).over(f)), "s_missing21": F.avg(missing).over(f), "s_missing101": F.avg(missing).over(centred(w, 101))}
        z = centred(w, z_window)
        out |= {"_zn": F.count(s).over(z), "_zm": F.avg(s).over(z), "_zs": F.stddev_samp(s).over(z)}
        out |= {f"_lag{t}": F.lag(v, t).over(w) for t in {1, 2, *steps}} | {f"_lead{t}": F.lead(v, t).over(w) for t in steps}
        return out

    d = framed(d, group, reach, reach, build, pos)
    ends = {f"v_lag{t}": F.when(p < t, F.col("_first")).otherwise(F.col(f"_lag{t}")) for t in steps}
    ends |= {f"v_lead{t}": F.when(p > F.col(count) - 1 - t, F.col("_last")).otherwise(F.col(f"_lead{t}")) for t in steps}
    first = F.when(p < 1, 0.0).otherwise(v - F.col("_lag1"))
    before = F.when(p < 2, 0.0).otherwise(F.col("_lag1") - F.col("_lag2"))
    z = F.when((F.col("_zn") >= z_rows) & (F.col("_zs") > 1e-12), (s - F.col("_zm")) / F.col("_zs"))
    frac = F.when(~k, (p - F.col("known_len") + 1) / (F.col(count) - F.col("known_len")))
    d = d.withColumns(ends | {
        "v_d1": first, "v_d2": F.when(p < 1, 0.0).otherwise(first - before), "s_z": clip(z, -z_limit, z_limit), "s_from_mean": s - F.col("s_group_mean"),
        "frac": frac, "past_known": F.col(x) - F.col("_kx"),
    })
    d = d.drop("_first", "_last", "_kx", "_zn", "_zm", "_zs", *[f"_lag{t}" for t in {1, 2, *steps}], *[f"_lead{t}" for t in steps])
    return d
