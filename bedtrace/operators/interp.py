"""Interpolation of reference curves at probe positions, within groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtrace.operators.cells import CELL, add_cells, neighbours, running

PREV, NEXT = "_prev", "_next"


def clean_curve(curve: DataFrame, group: Sequence[str], cx: str, cy: str) -> DataFrame:
    """Knots as ``(group, _kx, _ky)``: null knots dropped, knots at the same x averaged."""
    usable = curve.where(F.col(cx).isNotNull() & F.col(cy).isNotNull())
    return usable.groupBy(*group, F.col(cx).cast("double").alias("_kx")).agg(F.avg(F.col(cy).cast("double")).alias("_ky"))


def bracket_join(probe: DataFrame, curve: DataFrame, group: Sequence[str], x: str, cx: str, cy: str) -> DataFrame:
    """Add ``_prev`` (last knot with cx <= x) and ``_next`` (first knot with cx > x) as ``struct(x, y)``.

    Probes and knots are put in one ordered stream per group, so there is no range join and no pair of every probe with
    every knot; the stream is cut into cells, so hot groups spread over many tasks. Probes with a null ``x`` get nulls.
    """
    px = F.col(x).cast("double")
    nowhere = probe.where(px.isNull()).withColumns(
        {PREV: F.lit(None).cast("struct<x:double,y:double>"), NEXT: F.lit(None).cast("struct<x:double,y:double>")}
    )
    knots = clean_curve(curve, group, cx, cy).select(
        *group, F.col("_kx").alias("_x"), F.lit(0).alias("_kind"), F.struct(F.col("_kx").alias("x"), F.col("_ky").alias("y")).alias("_knot")
    )
    probes = probe.where(px.isNotNull()).withColumns({"_x": px, "_kind": F.lit(1)})
    stream = probes.unionByName(knots, allowMissingColumns=True)
    celled = add_cells(stream, group, "_x", order=["_kind"])
    knot = F.when(F.col("_kind") == 0, F.col("_knot"))
    found = neighbours(celled, group, ["_x", "_kind"], {PREV: knot}, {NEXT: knot})
    found = found.where(F.col("_kind") == 1).select(*probe.columns, PREV, NEXT)
    return found.unionByName(nowhere.select(*probe.columns, PREV, NEXT))


def interpolated(x: Column, edge: str = "clamp", left: float | None = None, right: float | None = None) -> Column:
    """Linear interpolation at ``x`` from the ``_prev`` / ``_next`` knots.

    ``edge``: ``clamp`` holds the end knots, ``null`` gives null outside, ``const`` gives ``left`` / ``right``.
    """
    x = x.cast("double")
    p, q = F.col(PREV), F.col(NEXT)
    inside = p.y + (q.y - p.y) * (x - p.x) / (q.x - p.x)
    below: Column = {"clamp": q.y, "null": F.lit(None), "const": F.lit(left)}[edge].cast("double")
    above: Column = {"clamp": p.y, "null": F.lit(None), "const": F.lit(right)}[edge].cast("double")
    beyond = F.when(p.x == x, p.y).otherwise(above)
    return (
        F.when(p.isNotNull() & q.isNotNull(), inside)
        .when(q.isNotNull(), below)
        .when(p.isNotNull(), beyond)
        .otherwise(F.lit(None).cast("double"))
    )


def interp_join(
    probe: DataFrame,
    curve: DataFrame,
    group: Sequence[str],
    x: str,
    cx: str,
    cy: str,
    out: str,
    edge: str = "clamp",
    left: float | None = None,
    right: float | None = None,
) -> DataFrame:
    """Add ``out``: the curve of the row's own group, interpolated linearly at ``x``."""
    both = bracket_join(probe, curve, group, x, cx, cy)
    return both.withColumn(out, interpolated(F.col(x), edge, left, right)).drop(PREV, NEXT)


def interp_columns(probe: DataFrame, curve: DataFrame, group: Sequence[str], x: str, cx: str, columns: Mapping[str, str]) -> DataFrame:
    """Several curve columns (``{out: column}``) read off at the same ``x`` in one pass, end knots held.

    Knots where any of the columns is missing are left out.
    """
    outs = list(columns)
    full = curve.select(*group, F.col(cx).cast("double").alias("_kx"), *[F.col(columns[o]).cast("double").alias(f"_k_{o}") for o in outs]).na.drop()
    knots = full.groupBy(*group, "_kx").agg(*[F.avg(f"_k_{o}").alias(o) for o in outs])
    knots = knots.select(*group, F.col("_kx").alias("_x"), F.lit(0).alias("_kind"), F.struct(F.col("_kx").alias("x"), *outs).alias("_knot"))
    stream = probe.withColumns({"_x": F.col(x).cast("double"), "_kind": F.lit(1)}).unionByName(knots, allowMissingColumns=True)
    knot = F.when(F.col("_kind") == 0, F.col("_knot"))
    d = neighbours(add_cells(stream, group, "_x", order=["_kind"]), group, ["_x", "_kind"], {PREV: knot}, {NEXT: knot}).where(F.col("_kind") == 1)
    p, q, at = F.col(PREV), F.col(NEXT), F.col("_x")
    share = F.when(p.isNotNull() & q.isNotNull(), (at - p.x) / (q.x - p.x))
    values = [F.coalesce(p[o] + share * (q[o] - p[o]), p[o], q[o]).alias(o) for o in outs]
    return d.select(*[c for c in probe.columns if c not in outs], *values)


def nearest_knot(probe: DataFrame, curve: DataFrame, group: Sequence[str], x: str, cx: str, cy: str) -> DataFrame:
    """Add ``knot_x`` / ``knot_y`` of the nearest knot; equally near knots resolve to the lower one."""
    both = bracket_join(probe, curve, group, x, cx, cy)
    p, q, v = F.col(PREV), F.col(NEXT), F.col(x).cast("double")
    lower = q.isNull() | (v - p.x <= q.x - v)
    pick = F.when(p.isNotNull() & lower, p).otherwise(q)
    return both.withColumn("_k", pick).withColumns({"knot_x": F.col("_k.x"), "knot_y": F.col("_k.y")}).drop("_k", PREV, NEXT)


def offset_profile(
    probe: DataFrame,
    curve: DataFrame,
    group: Sequence[str],
    x: str,
    signal: str,
    cx: str,
    cy: str,
    offsets: Sequence[float],
) -> DataFrame:
    """One row per probe and offset with ``mismatch`` = signal - curve(x + offset), curve ends held."""
    grid = probe.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    grid = grid.withColumn("_at", F.col(x).cast("double") + F.col("offset"))
    hit = interp_join(grid, curve, group, "_at", cx, cy, "_ref")
    return hit.withColumn("mismatch", F.col(signal).cast("double") - F.col("_ref")).drop("_at", "_ref")


def best_offset(profile: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Per probe row: smallest absolute mismatch, mismatch at offset 0, gap between both, and the first best offset."""
    a = F.abs(F.col("mismatch"))
    return profile.where(a.isNotNull()).groupBy(*row_key).agg(
        F.max(F.when(F.col("offset") == 0, a)).alias("at_zero"),
        F.min(a).alias("best"),
        F.min_by("offset", F.struct(a, F.col("offset"))).alias("best_offset"),
    ).withColumn("gap", F.col("at_zero") - F.col("best"))


def regrid(
    curve: DataFrame, group: Sequence[str], cx: str, cy: str, step: float, start: float | None = None, stop: float | None = None
) -> DataFrame:
    """Curve on an even grid ``(group, grid_x, grid_y)`` from its first knot (or ``start``) up to its last (or ``stop``)."""
    ends = curve.where(F.col(cx).isNotNull() & F.col(cy).isNotNull()).groupBy(*group).agg(
        F.min(F.col(cx).cast("double")).alias("_a"), F.max(F.col(cx).cast("double")).alias("_b")
    )
    a = F.lit(float(start)) if start is not None else F.col("_a")
    b = F.lit(float(stop)) if stop is not None else F.col("_b")
    steps = F.floor((b - a) / F.lit(float(step)) + F.lit(1e-9)).cast("long")
    # A long grid is unfolded in blocks, so no single row carries the whole grid of a group.
    block = 4096
    blocks = ends.where(steps >= 0).withColumns({"_s": steps, "_o": a}).select(
        *group, "_s", "_o", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_s") / block).cast("long"))).alias("_blk")
    )
    points = blocks.select(
        *group,
        "_o",
        F.explode(F.sequence(F.col("_blk") * block, F.least(F.col("_s"), F.col("_blk") * block + (block - 1)))).alias("step"),
    ).withColumn("grid_x", F.col("_o") + F.col("step") * F.lit(float(step)))
    return interp_join(points.drop("_o"), curve, group, "grid_x", cx, cy, "grid_y")


def band_mean(
    probe: DataFrame, curve: DataFrame, group: Sequence[str], x: str, cx: str, cy: str, band: float, out: str
) -> DataFrame:
    """Mean of the knots with ``|cx - x| <= band``; the interpolated value where the band holds no knot.

    Two prefix-sum lookups per probe replace the probe x knot range join.
    """
    keyed = probe.withColumn("_row", F.monotonically_increasing_id())
    knots = clean_curve(curve, group, cx, cy)
    edges = keyed.select("*", F.explode(F.array(
        F.struct(F.lit(-1).alias("s"), (F.col(x).cast("double") - band).alias("x")),
        F.struct(F.lit(1).alias("s"), (F.col(x).cast("double") + band).alias("x")),
    )).alias("_e")).select(*group, "_row", F.col("_e.s").alias("_s"), F.col("_e.x").alias("_x"))
    # The lower edge sorts before a knot at the same x, the upper edge after it: the band is closed on both sides.
    stream = edges.select(*group, "_row", "_s", "_x").unionByName(
        knots.select(*group, F.col("_kx").alias("_x"), F.lit(0).alias("_s"), F.col("_ky")), allowMissingColumns=True
    )
    knot = F.col("_s") == 0
    run = running(
        add_cells(stream.where(F.col("_x").isNotNull()), group, "_x", order=["_s"]), group, ["_x", "_s"],
        {"_sy": F.when(knot, F.col("_ky")), "_sn": F.when(knot, F.lit(1.0))},
    ).where(~knot)
    sums = run.groupBy("_row").agg(F.sum(F.col("_s") * F.col("_sy")).alias("_y"), F.sum(F.col("_s") * F.col("_sn")).alias("_n"))
    plain = interp_join(keyed, curve, group, x, cx, cy, "_plain")
    mean = F.when(F.col("_n") > 0, F.col("_y") / F.col("_n")).otherwise(F.col("_plain"))
    return plain.join(sums, "_row", "left").withColumn(out, mean).drop("_row", "_y", "_n", "_plain")


def band_pairs(
    probe: DataFrame, curve: DataFrame, group: Sequence[str], x: str, cx: str, cy: str, band: float
) -> DataFrame:
    """Probe rows with the knots ``(_kx, _ky)`` at most ``band`` away: an equi-join on cells as wide as the band."""
    width = F.lit(float(band))
    knots = clean_curve(curve, group, cx, cy).withColumn("_b", F.floor(F.col("_kx") / width))
    at = F.floor(F.col(x).cast("double") / width)
    near = probe.withColumn("_b", F.explode(F.array(at - 1, at, at + 1)))
    return near.join(knots, [*group, "_b"]).where(F.abs(F.col("_kx") - F.col(x)) <= width).drop("_b")


def lookalike_share(
    probe: DataFrame,
    curve: DataFrame,
    group: Sequence[str],
    row_key: Sequence[str],
    x: str,
    signal: str,
    cx: str,
    cy: str,
    bands: Sequence[float],
    gamma: float,
) -> DataFrame:
    """Share of the knots within each band around x whose value is within ``gamma`` of the observed signal."""
    pairs = band_pairs(probe, curve, group, x, cx, cy, max(bands))
    like = F.abs(F.col("_ky") - F.col(signal)) < gamma
    return pairs.groupBy(*row_key).agg(*[
        F.avg(F.when(F.abs(F.col("_kx") - F.col(x)) <= b, F.when(like, 1.0).otherwise(0.0))).alias(f"alias_{b:g}") for b in bands])
