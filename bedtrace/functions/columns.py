"""Column helpers that keep nulls null and stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    """Limit to [lo, hi]; null stays null (``greatest`` / ``least`` alone would return the bound)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def finite_or(c: Column, default: float = 0.0) -> Column:
    """The value when finite, else ``default``."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(c)


def is_finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def array_quantile(sorted_array: Column, p: float) -> Column:
    """Linear quantile of an ascending array without nulls."""
    h = (F.size(sorted_array) - 1) * F.lit(float(p))
    i = F.floor(h).cast("int")
    a = F.get(sorted_array, i)
    b = F.coalesce(F.get(sorted_array, i + 1), a)
    return a + (h - i) * (b - a)


def panel_stats(cols: Sequence[str], prefix: str) -> dict[str, Column]:
    """Row-wise statistics over several columns: mean, population std, median, inter-quartile range, range."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda v: v.isNotNull())
    ordered = F.array_sort(values)
    mean = array_mean(values)
    n = F.size(values)
    var = F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / n
    some = n > 0
    return {
        f"{prefix}_mean": F.when(some, mean),
        f"{prefix}_std": F.when(some, F.sqrt(var)),
        f"{prefix}_median": F.when(some, array_quantile(ordered, 0.5)),
        f"{prefix}_iqr": F.when(some, array_quantile(ordered, 0.75) - array_quantile(ordered, 0.25)),
        f"{prefix}_range": F.when(some, F.array_max(values) - F.array_min(values)),
    }


def row_id(group: str, pos: str) -> Column:
    """Row identity ``{group}_{position}``."""
    return F.concat_ws("_", F.col(group).cast("string"), F.col(pos).cast("string"))


def split_row_id(c: Column) -> tuple[Column, Column]:
    """Group and position back from a row identity; the group may itself contain underscores."""
    pattern = "^(.*)_([0-9]+)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2).cast("long")


def bias_corrected_skew(pop_skew: Column, n: Column) -> Column:
    """Sample skewness from the population one; null below three values."""
    n = n.cast("double")
    return F.when(n > 2, pop_skew * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(pop_kurt: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population one; null below four values."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * pop_kurt + 6))
