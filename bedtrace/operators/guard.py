"""Guarded corrections: replace or move a base prediction only where the visible prefix supports it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedtrace.functions.columns import clip, is_finite
from bedtrace.operators.cells import with_group_stats
from bedtrace.operators.interp import interp_join
from bedtrace.operators.metrics import best_and_second, rmse
from bedtrace.operators.quantiles import grouped_quantiles
from bedtrace.operators.robust import polynomial, polynomial_candidates, solve_normal
from bedtrace.session import cut_lineage

# Fixed values of the three move profiles.
PROFILES = {
    "conservative": {"min_gain": 1.00, "max_best": 9.0, "min_consistency": 0.67, "base": 0.06, "gain_scale": 0.12,
                     "margin_scale": 0.04, "quality_bonus": 0.02, "cap": 0.22, "clip_base": 8.0, "clip_gain": 3.0,
                     "clip_max": 18.0, "delta_soft": 22.0, "p95_hard": 55.0, "family_bonus": 0.03},
    "balanced": {"min_gain": 0.55, "max_best": 12.0, "min_consistency": 0.50, "base": 0.08, "gain_scale": 0.20,
                 "margin_scale": 0.06, "quality_bonus": 0.04, "cap": 0.36, "clip_base": 10.0, "clip_gain": 4.5,
                 "clip_max": 28.0, "delta_soft": 30.0, "p95_hard": 75.0, "family_bonus": 0.03},
    "aggressive": {"min_gain": 0.25, "max_best": 15.0, "min_consistency": 0.34, "base": 0.12, "gain_scale": 0.32,
                   "margin_scale": 0.10, "quality_bonus": 0.06, "cap": 0.56, "clip_base": 14.0, "clip_gain": 7.0,
                   "clip_max": 45.0, "delta_soft": 42.0, "p95_hard": 110.0, "family_bonus": 0.06},
}
FAMILY_PREFIXES = ("surface_", "dense_", "poly_", "contact_")


def guarded_override(
    base: DataFrame, reference: DataFrame, group: str, x: str, value: str, known_value: str, rx: str, rv: str,
    min_reference: int = 100, min_overlap: int = 50, max_rmse: float = 1.0, out: str = "value_out",
) -> DataFrame:
    """Replace ``value`` by the reference measurement of the same group, looked up by depth, where it can be trusted.

    A group qualifies with enough reference rows, enough known rows inside the reference range, and a known-row error of
    at most ``max_rmse``. Rows outside the range keep ``value``. ``status`` gives the reason.
    """
    ref = reference.where(F.col(rx).isNotNull() & F.col(rv).isNotNull())
    sizes = ref.groupBy(group).agg(F.count(F.lit(1)).alias("_ref_rows"))
    d = interp_join(base, ref, [group], x, rx, rv, "_ref", edge="null")
    e = F.col("_ref") - F.col(known_value)
    check = d.where(e.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_overlap"), rmse(e).alias("_rmse"))
    verdict = sizes.join(check, group, "left").select(group, F.when(F.col("_ref_rows") < min_reference, "few_reference_rows").when(
        F.coalesce("_overlap", F.lit(0)) < min_overlap, "few_overlap_rows").when(
        F.col("_rmse") <= max_rmse, "ok").otherwise("prefix_mismatch").alias("status"))
    d = d.join(verdict, group, "left").withColumn("status", F.coalesce("status", F.lit("no_reference")))
    take = (F.col("status") == "ok") & F.col("_ref").isNotNull()
    return d.withColumn(out, F.when(take, F.col("_ref")).otherwise(F.col(value))).drop("_ref")


def prefix_cuts(df: DataFrame, group: str, known: str, fracs: Sequence[float], min_known: int = 140, min_prefix: int = 50,
                min_hold: int = 35, pos: str = "row_idx") -> DataFrame:
    """Known rows repeated per cut, with ``cut`` and ``in_prefix``; the rest of the known rows is the holdout of the cut."""
    k = with_group_stats(df.where(F.col(known)), [group], {"_n": F.count(F.lit(1))}).where(F.col("_n") >= min_known)
    d = _cut_places(k, fracs, min_prefix, min_hold)
    return d.withColumn("in_prefix", F.col(pos) < F.col("_at")).drop("_n", "_at")


def _cut_places(df: DataFrame, fracs: Sequence[float], min_prefix: int, min_hold: int) -> DataFrame:
    """Rows repeated per ``cut``, with its place ``_at`` among the ``_n`` known rows of the group."""
    d = df.withColumn("cut", F.explode(F.array(*[F.lit(float(f)) for f in fracs])))
    at = F.greatest(F.lit(min_prefix), F.least(F.bround(F.col("_n") * F.col("cut")).cast("long"), F.col("_n") - min_hold))
    return d.withColumn("_at", at).where((F.col("_at") > 0) & (F.col("_n") - F.col("_at") >= min_hold))


def simple_candidates(cuts: DataFrame, keys: Sequence[str], x: str, y: str, pos: str = "row_idx") -> DataFrame:
    """Three extrapolations of each prefix on its holdout: last value, mean, straight line. Long rows (keys, pos, name, pred)."""
    p = F.col("in_prefix")
    px, py = F.when(p, F.col(x)), F.when(p, F.col(y))
    fit = cuts.groupBy(*keys).agg(
        F.max_by(y, F.when(p & F.col(y).isNotNull(), F.col(pos))).alias("_last"), F.avg(py).alias("_mean"),
        F.regr_slope(py, px).alias("_a"), F.regr_intercept(py, px).alias("_b"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("pred")) for n, c in (
        ("last", F.col("_last")), ("mean", F.col("_mean")), ("slope", F.col("_a") * F.col(x) + F.col("_b")))]))
    return cuts.where(~p).join(fit, list(keys)).select(*keys, pos, F.col(y).alias("truth"), named.alias("_c")).select(
        *keys, pos, "truth", "_c.name", "_c.pred")


def others_mean(df: DataFrame, group: str, slot: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean ``value`` of all other groups in the same slot; null where no other group has one. Own rows never count.

    Sums per (group, slot) and per slot are joined, rows are not paired.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(group, *slot).agg(F.sum(value).alias("_os"), F.count(value).alias("_on"))
    whole = own.groupBy(*slot).agg(F.sum("_os").alias("_s"), F.sum("_on").alias("_n"))
    d = df.join(whole, list(slot), "left").join(own, [group, *slot], "left")
    n = F.col("_n") - F.coalesce("_on", F.lit(0))
    mean = F.when(n > 0, (F.col("_s") - F.coalesce("_os", F.lit(0.0))) / n)
    return d.withColumn(out, mean).drop("_s", "_n", "_os", "_on")


def others_line(df: DataFrame, group: str, x: str, value: str, out: str) -> DataFrame:
    """Value at ``x`` of the straight line through the points of all other groups, out of sums per group; null without one."""
    one = df.agg(F.avg(F.when(F.col(value).isNotNull(), F.col(x))).alias("_x0"))  # one row: keeps the sums of squares small
    d = df.crossJoin(F.broadcast(one)).withColumn("_xc", F.when(F.col(value).isNotNull(), F.col(x) - F.col("_x0")))
    xc, y = F.col("_xc"), F.col(value)
    sums = {"_n": F.count(xc).cast("double"), "_sx": F.sum(xc), "_sy": F.sum(F.when(xc.isNotNull(), y)), "_xx": F.sum(xc * xc), "_xy": F.sum(xc * y)}
    own = cut_lineage(d.groupBy(group).agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in sums.items()]))
    total = own.agg(*[F.sum(n).alias(f"{n}_t") for n in sums])
    rest = own.crossJoin(F.broadcast(total)).select(group, *[(F.col(f"{n}_t") - F.col(n)).alias(n) for n in sums])  # one row
    spread = F.col("_xx") - F.try_divide(F.col("_sx") * F.col("_sx"), F.col("_n"))
    slope = F.try_divide(F.col("_xy") - F.try_divide(F.col("_sx") * F.col("_sy"), F.col("_n")), F.when(spread > 1e-9, spread))
    line = rest.select(group, slope.alias("_a"), F.try_divide(F.col("_sy") - slope * F.col("_sx"), F.col("_n")).alias("_b"))
    return d.join(line, group, "left").withColumn(out, F.col("_b") + F.col("_a") * (F.col(x) - F.col("_x0"))).drop("_x0", "_xc", "_a", "_b")


def shifted_candidates(cuts: DataFrame, keys: Sequence[str], y: str, estimates: Sequence[str], signals: Sequence[str] = (),
                       pos: str = "row_idx") -> DataFrame:
    """Candidates on the holdout of each (group, cut), fitted on its prefix only. Long rows (keys, pos, truth, name, pred).

    ``estimates`` are columns in the unit of ``y``, moved by their mean difference on the prefix. ``signals`` are columns of
    another unit, calibrated by the prefix's line of ``y`` on them. The name of a candidate is that of its column.
    """
    p = F.col("in_prefix")
    py = F.when(p, F.col(y))
    fits = [F.avg(py - F.col(c)).alias(f"_s{i}") for i, c in enumerate(estimates)]
    for i, c in enumerate(signals):
        fits += [F.regr_slope(py, F.col(c).cast("double")).alias(f"_a{i}"), F.regr_intercept(py, F.col(c).cast("double")).alias(f"_b{i}")]
    made = [(c, F.col(c) + F.col(f"_s{i}")) for i, c in enumerate(estimates)]
    made += [(c, F.col(f"_a{i}") * F.col(c) + F.col(f"_b{i}")) for i, c in enumerate(signals)]
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("pred")) for n, v in made]))
    d = cuts.where(~p).join(cuts.groupBy(*keys).agg(*fits), list(keys)).select(*keys, pos, F.col(y).alias("truth"), named.alias("_c"))
    return d.select(*keys, pos, "truth", "_c.name", "_c.pred")


def polynomial_cut_candidates(cuts: DataFrame, group: str, x: str, y: str, tails: Sequence[int | None], degrees: Sequence[int],
                              solves: int = 6, pos: str = "row_idx") -> DataFrame:
    """Polynomials fitted to the last rows of each prefix, read off on its holdout. (group, cut) is fitted as one key."""
    gc = F.struct(group, "cut")
    d = cuts.withColumn("_gc", gc)
    p = polynomial_candidates(d.withColumn(y, F.when(F.col("in_prefix"), F.col(y))), "_gc", x, y, "in_prefix", tails, degrees, solves=solves, pos=pos)
    p = p.select(F.col(f"_gc.{group}").alias(group), F.col("_gc.cut").alias("cut"), pos, F.regexp_replace("name", "^poly_deg", "poly_").alias("name"), "pred")
    hold = cuts.where(~F.col("in_prefix")).select(group, "cut", pos, F.col(y).alias("truth"))
    return hold.join(p, [group, "cut", pos]).select(group, "cut", pos, "truth", "name", "pred")


def enough_values(candidates: DataFrame, keys: Sequence[str], least: int = 20, share: float = 0.05) -> DataFrame:
    """Candidates of a key with too few finite values on its holdout go: fewer than ``least`` or than that ``share`` of rows."""
    ok = F.count_if(is_finite(F.col("pred"))).alias("_ok")
    n = candidates.groupBy(*keys, "name").agg(ok, F.count(F.lit(1)).alias("_n")).where(
        (F.col("_ok") >= least) & (F.col("_ok") >= F.floor(F.col("_n") * share))).select(*keys, "name")
    return candidates.join(n, [*keys, "name"], "left_semi").select(*candidates.columns)


def pool_errors(
    df: DataFrame, group: str, known: str, x: str, y: str, fracs: Sequence[float], estimates: Sequence[str], signals: Sequence[str],
    tails: Sequence[int | None], degrees: Sequence[int], finite: bool = False, min_known: int = 140, min_prefix: int = 50,
    min_hold: int = 35, min_rows: int = 30, spare: int = 12, least: int = 20, share: float = 0.05, pos: str = "row_idx",
) -> DataFrame:
    """Holdout error ``(group, cut, name, err)`` of a pool: last value, mean, ``shifted_candidates``, plain polynomials.

    Cuts are those of ``prefix_cuts``, ``pos`` is dense; candidates go by the rule of ``enough_values``. ``finite`` leaves out
    errors that are not finite, else only missing ones are.

    Rows are repeated neither per candidate nor per configuration of a fit, and never written per cut: each pass repeats
    the known rows per cut inside its tasks and adds them up there. What is joined to them is one row per group.
    """
    p, v, at, px = F.col(pos), F.col(y).cast("double"), F.col("_at"), F.col(x).cast("double")
    key, top = [group, "cut"], max(degrees)
    rows = with_group_stats(df.where(F.col(known)), [group], {"_n": F.count(F.lit(1))}).where(F.col("_n") >= min_known)
    rows = cut_lineage(rows.select(group, p, px.alias(x), v.alias(y), *[F.col(c).cast("double").alias(c) for c in (*estimates, *signals)], "_n"))
    inside = [F.lit(True) if t is None else p >= at - t for t in tails]
    fits = [F.first("_at").alias("_at"), F.max_by(y, F.when(F.col(y).isNotNull(), p)).alias("_last"), F.avg(y).alias("_mean")]
    fits += [F.avg(F.col(y) - F.col(c)).alias(f"_s{i}") for i, c in enumerate(estimates)]
    for i, c in enumerate(signals):
        fits += [F.regr_slope(y, c).alias(f"_a{i}"), F.regr_intercept(y, c).alias(f"_b{i}")]
    for t, m in enumerate(inside):
        tx = F.when(m, F.col(x))
        span = F.max(tx) - F.min(tx)
        fits += [F.min_by(x, F.when(m, p)).alias(f"_x{t}"), F.when(span < 1e-6, 1.0).otherwise(span).alias(f"_w{t}"), F.count(F.when(m, F.col(y))).alias(f"_n{t}")]
    fit = cut_lineage(_cut_places(rows, fracs, min_prefix, min_hold).where(p < at).groupBy(*key).agg(*fits))

    def per_cut(table: DataFrame) -> DataFrame:
        """The rows of each cut beside its row of ``table``."""
        own = table.groupBy(group).agg(F.collect_list(F.struct(*[c for c in table.columns if c != group])).alias("_f"))  # at most one entry per cut
        return rows.drop("_n").join(own, group).withColumn("_c", F.explode("_f")).select(*[c for c in rows.columns if c != "_n"], "_c.*")

    def scaled(t: int) -> Column:
        return (F.col(x) - F.col(f"_x{t}")) / F.col(f"_w{t}")

    scale = [f"_{c}{t}" for t in range(len(tails)) for c in "xw"]
    d = per_cut(fit.select(*key, "_at", *scale)).where((p < at) & F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.select(*key, y, *[F.when(m, scaled(t)).alias(f"_u{t}") for t, m in enumerate(inside)])
    sums = []
    for t in range(len(tails)):
        u, power = F.col(f"_u{t}"), F.when(F.col(f"_u{t}").isNotNull(), F.lit(1.0))
        for k in range(2 * top + 1):
            sums += [F.sum(power).alias(f"_p{t}_{k}")] + ([F.sum(power * F.col(y)).alias(f"_t{t}_{k}")] if k <= top else [])
            power = power * u
    sums = d.groupBy(*key).agg(*sums)
    solved = {}
    for t in range(len(tails)):
        for g in degrees:
            coef = solve_normal(F.array(*[F.col(f"_p{t}_{k}") for k in range(2 * g + 1)]), F.array(*[F.col(f"_t{t}_{k}") for k in range(g + 1)]))
            solved[f"_c{t}_{g}"] = F.when(F.col(f"_n{t}") >= max(min_rows, g + spare), coef)
    fit = cut_lineage(fit.join(sums, key, "left").select(*fit.columns, *[c.alias(n) for n, c in solved.items()]))

    made = {"last": F.col("_last"), "mean": F.col("_mean")} | {c: F.col(c) + F.col(f"_s{i}") for i, c in enumerate(estimates)}
    made |= {c: F.col(f"_a{i}") * F.col(c) + F.col(f"_b{i}") for i, c in enumerate(signals)}
    made |= {f"poly_{g}_tail{'all' if tail is None else tail}": polynomial(F.col(f"_c{t}_{g}"), scaled(t), g) for t, tail in enumerate(tails) for g in degrees}
    hold = per_cut(fit.drop(*[f"_n{t}" for t in range(len(tails))])).where(p >= at).select(*key, y, *[c.alias(f"_v{i}") for i, c in enumerate(made.values())])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i in range(len(made)):
        e = F.col(f"_v{i}") - F.col(y)
        aggs += [F.count_if(is_finite(F.col(f"_v{i}"))).alias(f"_k{i}"), rmse(F.when(is_finite(e), e) if finite else e).alias(f"_e{i}")]
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_e{i}").alias("err"), F.col(f"_k{i}").alias("_k")) for i, n in enumerate(made)]))
    d = hold.groupBy(*key).agg(*aggs).select(*key, "_rows", named.alias("_c")).select(*key, "_rows", "_c.*")
    return d.where(F.col("err").isNotNull() & (F.col("_k") >= least) & (F.col("_k") >= F.floor(F.col("_rows") * share))).select(*key, "name", "err")


def prefix_report(candidates: DataFrame, group: str, default: str, lead: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Backtest report per group and per (group, cut) from long holdout predictions with ``truth``."""
    e = F.col("pred") - F.col("truth")
    return error_report(candidates.where(is_finite(e)).groupBy(group, "cut", "name").agg(rmse(e).alias("err")), group, default, lead)


def error_report(per_cut: DataFrame, group: str, default: str, lead: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Backtest report per group and per (group, cut) from the holdout error ``err`` of each (group, cut, name).

    Score of a candidate: median over cuts + 0.10 population std. Consistency: share of cuts whose best candidate beats
    the default by at least ``lead``.
    """
    scores = grouped_quantiles(per_cut, [group, "name"], {"_m": (F.col("err"), 0.5)}).join(
        per_cut.groupBy(group, "name").agg(F.stddev_pop("err").alias("_s")), [group, "name"])
    scores = scores.select(group, "name", (F.col("_m") + 0.10 * F.col("_s")).alias("score"))
    best = best_and_second(scores, [group], "name", "score")
    base = scores.groupBy(group).agg(F.max(F.when(F.col("name") == default, F.col("score"))).alias("_d"), F.count("name").alias("candidate_count"))
    cuts = per_cut.groupBy(group, "cut").agg(
        F.min(F.struct("err", "name")).alias("_b"), F.max(F.when(F.col("name") == default, F.col("err"))).alias("default_rmse"),
        F.count(F.lit(1)).alias("candidates")).select(
        group, "cut", F.col("_b.name").alias("best_name"), F.col("_b.err").alias("best_rmse"), "default_rmse", "candidates")
    won = F.when(F.col("default_rmse").isNotNull(), F.when(F.col("best_rmse") <= F.col("default_rmse") - lead, 1.0).otherwise(0.0))
    votes = cuts.join(best.select(group, F.col("best_name").alias("_best")), group).groupBy(group).agg(
        F.count(F.lit(1)).alias("cuts"), F.avg(won).alias("_c"),
        F.avg(F.when(F.col("best_name") == F.col("_best"), 1.0).otherwise(0.0)).alias("_v"))
    rep = best.join(base, group).join(votes, group)
    default_score = F.coalesce("_d", "second_score")
    rep = rep.select(
        group, "cuts", "candidate_count", "best_name", "best_score", "second_score", default_score.alias("default_score"),
        (default_score - F.col("best_score")).alias("gain"), (F.col("second_score") - F.col("best_score")).alias("rank_margin"),
        F.coalesce("_c", "_v").alias("consistency"))
    return rep, cuts


def gated_move(df: DataFrame, report: DataFrame, group: str, base: str, candidate: str, profile: str | dict, pos: str = "move_idx") -> DataFrame:
    """Move the base towards a candidate by an amount the backtest report supports.

    ``pos`` counts the moved rows of a group from 0. Groups with a missing candidate value stay as they are. Adds
    ``moved``, ``alpha`` and ``move``.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    diff = F.col(candidate) - F.col(base)
    d = df.withColumn("_diff", F.when(is_finite(diff), diff))
    size = d.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count("_diff").alias("_ok"), rmse(F.col("_diff")).alias("_rms")).join(
        grouped_quantiles(d, [group], {"_p95": (F.abs("_diff"), 0.95)}), group, "left")
    r = size.join(report, group, "left")
    gain, best, margin, cons = F.col("gain"), F.col("best_score"), F.col("rank_margin"), F.col("consistency")
    alpha = p["base"] + p["gain_scale"] * clip(gain, 0, 5) / 5 + p["margin_scale"] * clip(margin, 0, 3) / 3
    alpha = alpha + F.when(best <= 5.0, p["quality_bonus"]).otherwise(0.0)
    family = F.lit(False)
    for f in FAMILY_PREFIXES:
        family = family | F.col("best_name").startswith(f)
    alpha = alpha + F.when(family & (cons >= 0.67), p["family_bonus"]).otherwise(0.0)
    soft = F.greatest(F.lit(0.20), F.try_divide(F.lit(p["delta_soft"]), F.greatest("_rms", F.lit(1e-6))))
    alpha = alpha * F.when(F.col("_rms") > p["delta_soft"], soft).otherwise(1.0)
    blocked = best.isNull() | (best > p["max_best"]) | (gain < p["min_gain"]) | (cons < p["min_consistency"]) | (F.col("_p95") > p["p95_hard"])
    blocked = blocked | (F.col("_ok") < F.col("_n"))
    r = r.withColumn("alpha", F.when(blocked, 0.0).otherwise(clip(alpha, 0.0, p["cap"])))
    r = r.withColumn("_max", F.least(F.lit(p["clip_max"]), p["clip_base"] + p["clip_gain"] * F.sqrt(F.greatest(F.coalesce(gain, F.lit(0.0)), F.lit(0.0)) + 1e-9)))
    d = d.join(r.select(group, "alpha", "_max", "_n"), group)
    ramp = 1 - F.exp(-F.col(pos) / F.greatest(F.lit(80.0), 0.12 * F.col("_n")))
    move = F.coalesce(clip(F.col("alpha") * ramp * F.col("_diff"), -F.col("_max"), F.col("_max")), F.lit(0.0))
    return d.withColumn("move", move).withColumn("moved", F.col(base) + F.col("move")).drop("_diff", "_max", "_n")

