"""Combining tracks and predictions: softmax over seeds, variants, blends, tiers, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtrace.functions.columns import clip, is_finite
from bedtrace.operators.cells import CELL, add_cells, running, with_group_stats
from bedtrace.operators.metrics import rmse
from bedtrace.operators.quantiles import grouped_quantiles

# Fixed values of the variant selector.
SELECTOR_MIN_EVAL = 4840.0
SELECTOR_SPANS = (136.73000000000016, 185.5133333333342)
# bin -> (scale, beam weight, hold weight)
SELECTOR_VARIANTS = {
    0: (5.0, 0.0, 0.2),
    1: (3.0, 0.0, 0.15),
    2: (12.0, 0.2, 0.15),
    3: (5.0, 0.0, 0.15),
    4: (5.0, 0.05, 0.05),
    5: (12.0, 0.2, 0.05),
}


def combine_tracks(
    tracks: DataFrame, likelihood: DataFrame, group: str, row: str, seed: str, pred: str, ll: str, scales: Sequence[float]
) -> DataFrame:
    """Per row: for every scale the softmax(ll / scale) weighted mean over seeds, plus plain mean, mean of the scale
    columns 3, 5 and 8 where present, and the population spread over seeds."""
    top = with_group_stats(likelihood.select(group, seed, F.col(ll).alias("_ll")), [group], {"_top": F.max("_ll")})
    weights = top.select(group, seed, *[F.exp((F.col("_ll") - F.col("_top")) / float(s)).alias(f"_w{s:g}") for s in scales])
    p = F.col(pred)
    d = tracks.join(weights, [group, seed]).groupBy(group, row).agg(
        *[(F.sum(F.col(f"_w{s:g}") * p) / F.sum(f"_w{s:g}")).alias(f"scale_{s:g}") for s in scales],
        F.avg(p).alias("track_mean"), F.stddev_pop(p).alias("track_std"))
    core = [F.col(f"scale_{s:g}") for s in scales if s in (3.0, 5.0, 8.0)]
    return d.withColumn("scale_core", sum(core[1:], core[0]) / len(core)) if core else d


def likelihood_quality(likelihood: DataFrame, group: str, ll: str, rows: DataFrame) -> DataFrame:
    """Best log likelihood per row of the group and the population spread over seeds."""
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return likelihood.groupBy(group).agg(F.max(ll).alias("_b"), F.stddev_pop(ll).alias("ll_std")).join(n, group).select(
        group, (F.col("_b") / F.col("_n")).alias("best_ll_per_row"), "ll_std")


def mix(a: Column, b: Column, weight: float | Column) -> Column:
    """(1 - weight) a + weight b."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return (1 - w) * a + w * b


def damp(delta: Column, depth: Column, scale: float = 85.0) -> Column:
    """Fade a correction in from the anchor."""
    return delta * (1 - F.exp(-F.greatest(depth, F.lit(0.0)) / scale))


def selector_bin(eval_rows: Column, span: Column, min_eval: float = SELECTOR_MIN_EVAL, spans: Sequence[float] = SELECTOR_SPANS) -> Column:
    """Bin number from the withheld length and the vertical span; a span on an edge falls into the upper bin."""
    upper = sum((F.when(span >= e, 1).otherwise(0) for e in spans), F.lit(0))
    return F.when(eval_rows > min_eval, 1).otherwise(0) + 2 * upper


def variant_value(by_scale: Mapping[float, Column], beam: Column, last: Column, scale: Column, beam_w: Column, hold_w: Column) -> Column:
    """(1 - hold) ((1 - beam) scale + beam beam) + hold last, with the scale column picked per row."""
    base = None
    for s, c in by_scale.items():
        base = F.when(scale == s, c) if base is None else base.when(scale == s, c)
    return mix(mix(base, beam, beam_w), last, hold_w)


def variant_table(spark, variants: Mapping[int, tuple[float, float, float]]) -> DataFrame:
    rows = [(int(b), *map(float, v)) for b, v in variants.items()]
    return spark.createDataFrame(rows, "bin int, scale double, beam_w double, hold_w double")


def blend_report(df: DataFrame, base: str, other: str, truth: str, weights: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """For every weight: error of the blend, and rms and 95 % size of its move away from the base."""
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights]))
    d = df.where(is_finite(F.col(base)) & is_finite(F.col(other))).select(*keys, base, other, truth, grid.alias("weight"))
    b = mix(F.col(base), F.col(other), F.col("weight"))
    d = d.withColumns({"_e": b - F.col(truth), "_m": F.abs(b - F.col(base))})
    s = d.groupBy(*keys, "weight").agg(rmse(F.col("_e")).alias("rmse"), rmse(F.col("_m")).alias("move_rms"))
    return s.join(grouped_quantiles(d, [*keys, "weight"], {"move_p95": (F.col("_m"), 0.95)}), [*keys, "weight"])


def tiered_blend(
    df: DataFrame, group: Sequence[str], risk: str, members: Sequence[str], normal: Sequence[float], risky: Sequence[float],
    last: str, edge: float = 3.39, gain: float = 1.09, extra: tuple[str, float] | None = None, out: str = "blend",
) -> DataFrame:
    """Weights by the group's mean risk; risky groups are also pushed away from the anchor by ``gain``. A finite extra
    member is mixed in last."""
    d = with_group_stats(df, group, {"_risk": F.avg(risk)})
    high = F.coalesce(F.col("_risk") >= edge, F.lit(False))

    def weighted(w: Sequence[float]) -> Column:
        terms = [F.col(m) * float(v) for m, v in zip(members, w)]
        return sum(terms[1:], terms[0])

    b = F.when(high, F.col(last) + gain * (weighted(risky) - F.col(last))).otherwise(weighted(normal))
    if extra:
        b = F.when(is_finite(F.col(extra[0])), mix(b, F.col(extra[0]), extra[1])).otherwise(b)
    return d.withColumn(out, b).drop("_risk")


def dense_gate(df: DataFrame, group: Sequence[str], distance: str, threshold_q: float, base: Column, dense: Column, weight: float, out: str) -> DataFrame:
    """Mix in the dense surface only for groups whose median neighbour distance is at or below the given quantile of all
    group medians."""
    med = grouped_quantiles(df, group, {"_md": (F.col(distance), 0.5)})
    thr = grouped_quantiles(med, [], {"_thr": (F.col("_md"), threshold_q)})
    gate = med.crossJoin(F.broadcast(thr)).select(*group, (F.col("_md") <= F.col("_thr")).alias("_g"))  # one threshold row
    return df.join(gate, list(group), "left").withColumn(out, F.when(F.col("_g"), mix(base, dense, weight)).otherwise(base)).drop("_g")


def hold_gate(df: DataFrame, group: Sequence[str], pred: str, last: str, gate: Column, max_excursion: float, weight: float, out: str) -> DataFrame:
    """Mix in the anchor for groups that pass ``gate`` and never leave the anchor by ``max_excursion``."""
    d = with_group_stats(df, group, {"_exc": F.max(F.abs(F.col(pred) - F.col(last)))})
    on = F.coalesce(gate, F.lit(False)) & (F.col("_exc") < max_excursion)
    return d.withColumn(out, F.when(on, mix(F.col(pred), F.col(last), weight)).otherwise(F.col(pred))).drop("_exc")


def inverse_error_ensemble(preds: DataFrame, scores: DataFrame, group: Sequence[str], row: str, floor: float = 0.25) -> DataFrame:
    """Mean of named predictions weighted by 1 / max(prefix error, floor)^2, where a group has at least two of them."""
    w = scores.withColumn("_w", F.pow(1.0 / F.greatest(F.col("rmse"), F.lit(floor)), 2))
    w = with_group_stats(w, group, {"_names": F.count("rmse")}).where(F.col("_names") >= 2)
    return preds.join(w.select(*group, "name", "_w"), [*group, "name"]).groupBy(*group, row).agg(
        (F.sum(F.col("_w") * F.col("pred")) / F.sum("_w")).alias("weighted_pred"))


def two_branch(df: DataFrame, group: Sequence[str], level: str, weight: str, tie: str, min_mass: float = 0.05) -> DataFrame:
    """Best cut of a weighted 1-D sample into two branches (least squared error), with both centres and masses.

    Running sums over the ordered levels give the error of every cut; groups of any size work.
    """
    d = with_group_stats(df, group, {"_tw": F.sum(weight)}).withColumn("_w", F.col(weight) / F.col("_tw"))
    x, w = F.col(level), F.col("_w")
    d = with_group_stats(d, group, {"_tx": F.sum(w * x), "_tx2": F.sum(w * x * x)})
    d = running(add_cells(d, group, level, order=[tie]), group, [level, tie], {"_cw": w, "_cx": w * x, "_cx2": w * x * x}).drop(CELL)
    wr = 1 - F.col("_cw")
    left = F.col("_cx2") - F.try_divide(F.col("_cx") * F.col("_cx"), F.col("_cw"))
    rx = F.col("_tx") - F.col("_cx")
    right = (F.col("_tx2") - F.col("_cx2")) - F.try_divide(rx * rx, wr)
    ok = (F.col("_cw") >= min_mass) & (wr >= min_mass)
    best = d.where(ok).withColumn("_sse", left + right).groupBy(*group).agg(
        F.min_by(F.struct(F.try_divide("_cx", "_cw").alias("lo"), F.try_divide(rx, wr).alias("hi"), F.col("_cw").alias("ml"),
                          wr.alias("mh"), F.col("_tx").alias("mean")), F.struct("_sse", level, tie)).alias("b"))
    return best.select(*group, F.col("b.lo").alias("center_low"), F.col("b.hi").alias("center_high"), F.col("b.ml").alias("mass_low"),
                       F.col("b.mh").alias("mass_high"), F.col("b.mean").alias("weighted_center"))


def branch_shift(stats: DataFrame, strength: float, cap: float, min_mass: float = 0.25, sep_lo: float = 4.0, sep_hi: float = 40.0) -> DataFrame:
    """Shift towards the middle of the two branches; 0 where a gate fails or the shift is below 0.01."""
    sep = F.abs(F.col("center_high") - F.col("center_low"))
    mid = 0.5 * (F.col("center_low") + F.col("center_high"))
    shift = clip(strength * (mid - F.col("weighted_center")), -cap, cap)
    on = (F.least("mass_low", "mass_high") >= min_mass) & sep.between(sep_lo, sep_hi) & (F.abs(shift) >= 0.01)
    return stats.withColumn("shift", F.when(on, shift).otherwise(0.0))
