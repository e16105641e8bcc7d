"""Exact quantiles for groups of any size (linear interpolation between order statistics)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedtrace.operators.cells import CELL, add_cells


def grouped_quantiles(df: DataFrame, group: Sequence[str], specs: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """One row per group with column ``name`` = quantile ``p`` of ``value`` for every ``name: (value, p)``.

    The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here a histogram of value cells
    (map-side combined) finds which cells hold the wanted ranks, and only rows of those cells are sorted.
    Null values are ignored; groups without any value are absent from the result.
    """
    names = list(specs)
    metrics: list[tuple[Column, list[str]]] = []
    for n in names:
        value = specs[n][0]
        for known, users in metrics:
            if str(known) == str(value):
                users.append(n)
                break
        else:
            metrics.append((value, [n]))
    one = not group
    keys = list(group) or ["_all"]
    base = df.withColumn("_all", F.lit(0)) if one else df
    entries = [F.struct(F.lit(i).alias("m"), v.cast("double").alias("v")) for i, (v, _) in enumerate(metrics)]
    long = base.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(
        *keys, F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v")
    ).where(F.col("_v").isNotNull())

    def low(p: float, n: Column) -> Column:
        return F.floor((n - 1) * F.lit(float(p))).cast("long")

    n = F.col("_n")
    wanted = F.lit(None).cast("array<bigint>")
    for i, (_, users) in enumerate(metrics):
        ranks = [low(specs[u][1], n) + d for u in users for d in (0, 1)]
        wanted = F.when(F.col("_m") == i, F.array_distinct(F.array(*ranks))).otherwise(wanted)

    gm = [*keys, "_m"]
    celled = add_cells(long, gm, "_v")
    sizes = celled.groupBy(*gm, CELL).agg(F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(*gm)
    sizes = sizes.withColumn("_n", F.sum("_c").over(over)).withColumn(
        "_off", F.sum("_c").over(over.orderBy(CELL)) - F.col("_c")
    )
    sizes = sizes.withColumn("_ranks", wanted).withColumn(
        "_hit", F.filter("_ranks", lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_c")))
    ).where(F.size("_hit") > 0)
    inside = (
        celled.join(sizes.drop("_c", "_ranks"), [*gm, CELL])
        .groupBy(*gm, CELL, "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.first("_off").alias("_off"), F.first("_hit").alias("_hit"))
    )
    upto = Window.partitionBy(*gm, CELL).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_off") + F.sum("_c").over(upto))
    picked = inside.select(
        *gm,
        "_n",
        "_v",
        F.explode(F.filter("_hit", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))).alias("_r"),
    )
    outs = []
    for i, (_, users) in enumerate(metrics):
        for u in users:
            p = specs[u][1]
            lo = F.max(F.when((F.col("_m") == i) & (F.col("_r") == low(p, n)), F.col("_v")))
            hi = F.max(F.when((F.col("_m") == i) & (F.col("_r") == low(p, n) + 1), F.col("_v")))
            share = F.max(F.when(F.col("_m") == i, (n - 1) * F.lit(float(p)) - low(p, n)))
            outs.append((lo + share * (F.coalesce(hi, lo) - lo)).alias(u))
    res = picked.groupBy(*keys).agg(*outs)
    return res.drop("_all") if one else res


def grouped_median(df: DataFrame, group: Sequence[str], value: Column, name: str) -> DataFrame:
    return grouped_quantiles(df, group, {name: (value, 0.5)})
