"""Sequence samples for models, and the way back from grid to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedtrace.functions.columns import clip, panel_stats
from bedtrace.operators.cells import centred, framed, with_group_stats
from bedtrace.operators.interp import interp_columns, interp_join
from bedtrace.operators.sequence import gradient_steps, gradient_value
from bedtrace.session import cut_lineage


def sample_cuts(log: DataFrame, group: str, known: str, fracs: Sequence[float], min_known: int = 120, min_rest: int = 60, pos: str = "row_idx") -> DataFrame:
    """Cut positions per group: the natural end of the known prefix (``nat``) and shares of it (``c40`` and so on)."""
    n = log.where(F.col(known)).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    options = [F.struct(F.lit("nat").alias("cut"), F.col("_n").alias("at"))] + [
        F.struct(F.lit(f"c{int(f * 100)}").alias("cut"), F.bround(F.col("_n") * float(f)).cast("long").alias("at")) for f in fracs]
    d = n.select(group, "_n", F.explode(F.array(*options)).alias("c")).select(group, "_n", "c.*")
    nat = F.col("cut") == "nat"
    return d.where(nat | ((F.col("at") >= min_known) & (F.col("_n") - F.col("at") >= min_rest))).select(group, "cut", "at")


def sequence_samples(
    log: DataFrame, curve: DataFrame, cuts: DataFrame, group: str, known: str, md: str, z: str, target: str, signal: str, cx: str, cy: str,
    step: float = 4.0, context: int = 256, offsets: Sequence[float] = (-48, -40, -32, -24, -16, -8, 0, 8, 16, 24, 32, 40, 48),
    min_tail: int = 8, scale: float = 10.0, pos: str = "row_idx",
) -> DataFrame:
    """Long samples ``(group, cut, step, is_tail, target, channels...)`` on an even grid around each cut.

    Before the cut the target is known and used as position hypothesis, after it the last known value is. ``signal`` must
    be filled; ``{signal}_gap`` is a 0/1 column.

    Where the groups fit one cell, the rows of the grid are exchanged once, with the log's knots: what belongs to their cut
    is on them, and the windows follow in the same tasks. The hypothesis of all steps past a cut is one value, so the curve
    is read once per cut for them, beside the at most ``context + 1`` steps before it.
    """
    key = [group, "cut"]
    gap = f"{signal}_gap"
    c = log.join(cuts, group)
    head = F.col(pos) < F.col("at")
    stats = c.groupBy(*key).agg(
        F.avg(F.when(head, F.col(signal))).alias("mu"), F.stddev_pop(F.when(head, F.col(signal))).alias("sd"),
        F.max_by(target, F.when(head, F.col(pos))).alias("last_t"), F.max(F.when(head, F.col(md))).alias("cut_md"), F.max(md).alias("end_md"))
    first = F.col("cut_md") - context * float(step)
    steps = F.floor((F.col("end_md") - first) / float(step) + 0.5).cast("long")
    stats = stats.withColumns({"sd": F.col("sd") + 1e-3, "_g0": first, "_steps": steps})
    place = lambda s: F.col("_g0") + s * float(step)
    zero = F.lit(0).cast("long")
    tail = F.size(F.filter(F.sequence(zero, F.col("_steps")), lambda s: place(s) > F.col("cut_md")))
    stats = cut_lineage(stats.withColumn("_tail", tail).where(F.col("_tail") >= min_tail).withColumn("_s0", F.col("_steps") + 1 - F.col("_tail")))

    before = stats.where(F.col("_s0") > 0).withColumn("step", F.explode(F.sequence(zero, F.col("_s0") - 1)))
    prefix = c.where(head).select(*key, F.col(md).alias("px"), F.col(target).alias("py"))
    before = interp_join(before.select(*key, "step", place(F.col("step")).alias("md")), prefix, key, "md", "px", "py", "_hyp")
    past = stats.select(*key, F.lit(-1).cast("long").alias("step"), F.lit(None).cast("double").alias("md"), F.col("last_t").cast("double").alias("_hyp"))
    long = cut_lineage(before.select(*past.columns).unionByName(past)).withColumn("_o", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    long = interp_join(long.withColumn("_at", F.col("_hyp") + F.col("_o")), curve, [group], "_at", cx, cy, "_ref")
    refs = [f"_r{j}" for j in range(len(offsets))]
    wide = cut_lineage(long.groupBy(*key, "step").agg(
        F.max("md").alias("md"), F.max("_hyp").alias("_hyp"), *[F.max(F.when(F.col("_o") == float(o), F.col("_ref"))).alias(r) for o, r in zip(offsets, refs)]))

    z0 = interp_columns(stats.select(*key, place(F.col("_s0")).alias("md")), log, [group], "md", md, {"_sig": signal, "gap": gap, "_z0": z, "_t": target})
    of_cut = ["mu", "sd", "last_t", "cut_md", "end_md", "_z0"]
    per_cut = cut_lineage(stats.join(z0.select(*key, "_z0"), key).join(wide.where("step < 0").select(*key, *refs), key))
    shared = [*key, "step", "md", "is_tail", "_hyp", *refs, *of_cut]
    rest = per_cut.withColumn("step", F.explode(F.sequence(F.col("_s0"), F.col("_steps"))))
    rest = rest.withColumns({"md": place(F.col("step")), "is_tail": F.lit(True), "_hyp": F.lit(None).cast("double")}).select(*shared)
    grid = wide.where("step >= 0").withColumn("is_tail", F.lit(False)).join(per_cut.select(*key, *of_cut), key).select(*shared)
    grid = interp_columns(rest.unionByName(grid), log, [group], "md", md, {"_sig": signal, "gap": gap, "_z": z, "_t": target})
    grid = grid.withColumn("sigz", (F.col("_sig") - F.col("mu")) / F.col("sd"))

    def build(w: Window) -> dict[str, Column]:
        s = F.col("sigz")
        return {"sigz_mean21": F.avg(s).over(centred(w, 21)), "sigz_mean101": F.avg(s).over(centred(w, 101)),
                "sigz_std21": F.when(F.count(s).over(centred(w, 21)) > 1, F.stddev_samp(s).over(centred(w, 21))), **gradient_steps(w, "_z", "md")}

    grid = framed(grid, key, 50, 50, build, "step").fillna(0.0, ["sigz_std21"]).withColumn("_dz", gradient_value("_z", "md"))
    return grid.select(
        *key, "step", "is_tail", clip((F.col("_t") - F.col("last_t")) / scale, -12, 12).alias("target"), "sigz",
        "sigz_mean21", "sigz_mean101", "sigz_std21", "gap", (clip(F.col("_dz"), -0.5, 0.5) * 20).alias("dz"),
        ((F.col("_z") - F.col("_z0")) / 100).alias("z_rel"), (F.greatest(F.col("md") - F.col("cut_md"), F.lit(0.0)) / 1000).alias("from_cut"),
        ((F.col("end_md") - F.col("md")) / 1000).alias("to_end"),
        F.when(F.col("is_tail"), 0.0).otherwise((F.col("_hyp") - F.col("last_t")) / scale).alias("path"),
        *[clip(F.abs(F.col("sigz") - (F.col(r) - F.col("mu")) / F.col("sd")), 0, 6).alias(f"mm{j}") for j, r in enumerate(refs)])


def row_map(log: DataFrame, group: str, known: str, md: str, target: str, pos: str = "row_idx") -> DataFrame:
    """Withheld rows with their distance past the cut, residual target and anchor."""
    from bedtrace.functions.columns import row_id

    k = F.when(F.col(known), F.col(pos))
    d = with_group_stats(log, [group], {"_m": F.max_by(md, k), "anchor": F.max_by(target, k)})
    return d.where(~F.col(known)).select(row_id(group, pos).alias("id"), group, (F.col(md) - F.col("_m")).alias("md_rel"), (F.col(target) - F.col("anchor")).alias("y"), "anchor")


def to_rows(grid: DataFrame, rows: DataFrame, group: str, gx: str, gy: str, x: str = "md_rel", out: str = "pred") -> DataFrame:
    """Grid predictions read off at the rows' own distances."""
    return interp_join(rows, grid, [group], x, gx, gy, out)


def overlap_add(df: DataFrame, group: Sequence[str], pred: Column, length: int, stride: int, pos: str = "row_idx", out: str = "blended") -> DataFrame:
    """Weighted mean of windowed predictions: windows of ``length`` start every ``stride`` rows and weigh their rows by a
    triangle that is at least 1e-3. ``pred`` may use ``window`` (its number) and ``at`` (the place inside)."""
    p = F.col(pos)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((p - (length - 1)) / F.lit(stride)).cast("long"))
    d = df.withColumn("window", F.explode(F.sequence(first, F.floor(p / F.lit(stride)).cast("long"))))
    d = d.withColumn("at", p - F.col("window") * stride)
    centre = (length - 1) / 2
    w = F.greatest(1 - F.abs(F.col("at") - centre) / (centre + 1), F.lit(1e-3))
    return d.groupBy(*group, pos).agg((F.sum(w * pred) / F.sum(w)).alias(out))


def surface_channels(df: DataFrame, group: Sequence[str], known: str, target: str, surfaces: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Re-anchored surfaces, their confidence exp(-std/30) exp(-dist/0.02), and the consensus over all of them.

    ``surfaces``: names of (value, std, distance) columns.
    """
    d = with_group_stats(df, group, {f"_o_{v}": F.avg(F.when(F.col(known), F.col(target) - F.col(v))) for v, _, _ in surfaces})
    d = d.withColumns({f"{v}_anchored": F.col(v) + F.col(f"_o_{v}") for v, _, _ in surfaces})
    d = d.withColumns({f"{v}_conf": F.exp(-F.col(s) / 30) * F.exp(-F.col(m) / 0.02) for v, s, m in surfaces})
    names = [f"{v}_anchored" for v, _, _ in surfaces]
    stats = panel_stats(names, "surf")
    d = d.withColumns({"surf_median": stats["surf_median"], "surf_std": stats["surf_std"]})
    best = F.array_max(F.array(*[F.struct(F.col(f"{v}_conf").alias("c"), F.col(f"{v}_anchored").alias("v")) for v, _, _ in surfaces]))
    return d.withColumn("surf_best", best["v"]).withColumn("surf_gap", F.col(names[0]) - F.col("surf_median")).drop(*[f"_o_{v}" for v, _, _ in surfaces])

