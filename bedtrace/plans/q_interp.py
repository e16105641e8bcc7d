"""Queries on reference curves: interpolation, offsets, grids and calibration.

Curve: the ``view`` events of a user; probes: the ``click`` events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.operators import calibrate as A
from bedtrace.operators import interp as I
from bedtrace.operators.cells import framed, index_rows
from bedtrace.operators.sequence import gradient, rolling
from bedtrace.plans.bindings import EVENTS_SQL, PARTS_SQL, event_log, events, part_log
from bedtrace.plans.registry import query, shown, sql_rounded, sql_shown
from bedtrace.session import cut_lineage

U = ["user_id"]
E = ["user_id", "event_id"]

KNOTS = """knots AS (SELECT user_id, x AS kx, avg(value) AS ky FROM ev WHERE event_type = 'view' GROUP BY user_id, x),
probe AS (SELECT * FROM seq WHERE event_type = 'click')"""


def bracket_sql(probe: str, x: str = "x", knots: str = "knots", g: str = "user_id") -> str:
    return f"""SELECT p.*, a.kx AS ax, a.ky AS ay, b.kx AS bx, b.ky AS byy FROM {probe} p
ASOF LEFT JOIN {knots} a ON p.{g} = a.{g} AND p.{x} >= a.kx ASOF LEFT JOIN {knots} b ON p.{g} = b.{g} AND p.{x} < b.kx"""


def at_sql(x: str = "x") -> str:
    return f"CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN ay + (byy - ay) * ({x} - ax) / (bx - ax) ELSE coalesce(ay, byy) END"


def curve_sql(inner: str, keys: list[str], values: list[str], digits: int = 6, extra: str = "") -> str:
    return f"WITH {EVENTS_SQL}, {KNOTS}{extra} SELECT {sql_shown(keys, values, digits)} FROM ({inner})"


def curve_of(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where(F.col("event_type") == "view").select("user_id", F.col("x").alias("cx"), F.col("value").alias("cy"))


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where(F.col("event_type") == "click").select("user_id", "event_id", "x", "value")


def known_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).where(F.col("known") & (F.col("event_type") == "click"))


# --- interpolation -----------------------------------------------------------------------------------------------


@query("j4_interp_join", curve_sql(
    f"""SELECT user_id, event_id, {at_sql()} AS held,
 CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN {at_sql()} WHEN ax = x THEN ay END AS inside,
 CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN {at_sql()} WHEN ax = x THEN ay WHEN ax IS NULL THEN -1 ELSE -2 END AS marked
 FROM ({bracket_sql('probe')})""", E, ["held", "inside", "marked"]))
def interp_modes(spark: SparkSession, sf: str) -> DataFrame:
    both = I.bracket_join(clicks(spark, sf), curve_of(spark, sf), U, "x", "cx", "cy")
    x = F.col("x")
    d = both.withColumns({
        "held": I.interpolated(x), "inside": I.interpolated(x, "null"), "marked": I.interpolated(x, "const", -1.0, -2.0)})
    return shown(d, E, ["held", "inside", "marked"])


OFFSETS = [-80.0, -40.0, -20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0, 40.0, 80.0]
GRID = f""", grid AS (SELECT p.user_id, p.event_id, p.value, p.x, o.o AS off, p.x + o.o AS gx FROM probe p CROSS JOIN
 (SELECT unnest({OFFSETS}::DOUBLE[]) AS o) o), prof AS (SELECT user_id, event_id, off, value - ({at_sql('gx')}) AS mismatch FROM ({bracket_sql('grid', 'gx')}))"""


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return I.offset_profile(clicks(spark, sf), curve_of(spark, sf), U, "x", "value", "cx", "cy", OFFSETS)


@query("j5_offset_profile", curve_sql(
    "SELECT user_id, event_id, " + ", ".join(f"max(mismatch) FILTER (off = {o}) AS o{i}" for i, o in enumerate(OFFSETS))
    + " FROM prof GROUP BY user_id, event_id", E, [f"o{i}" for i in range(len(OFFSETS))], extra=GRID))
def offset_profile(spark: SparkSession, sf: str) -> DataFrame:
    wide = profile(spark, sf).groupBy(*E).agg(*[
        F.max(F.when(F.col("offset") == o, F.col("mismatch"))).alias(f"o{i}") for i, o in enumerate(OFFSETS)])
    return shown(wide, E, [f"o{i}" for i in range(len(OFFSETS))])


@query("w16_best_local_shift", curve_sql(
    "SELECT user_id, event_id, z AS at_zero, b AS best, o AS best_offset, z - b AS gap FROM (SELECT user_id, event_id, "
    "max(abs(mismatch)) FILTER (off = 0) AS z, min(abs(mismatch)) AS b, arg_min(off, struct_pack(m := abs(mismatch), o := off)) AS o "
    "FROM prof WHERE mismatch IS NOT NULL GROUP BY user_id, event_id)", E, ["at_zero", "best", "best_offset", "gap"], extra=GRID))
def best_shift(spark: SparkSession, sf: str) -> DataFrame:
    return shown(I.best_offset(profile(spark, sf), E), E, ["at_zero", "best", "best_offset", "gap"])


@query("w15_smoothed_mismatch_profile", curve_sql(
    "SELECT user_id, event_id, max(m) FILTER (off = 0) AS at_zero, max(m) FILTER (off = 0) - min(m) AS gap, "
    "arg_min(off, struct_pack(m := m, o := off)) AS best_offset FROM (SELECT q.user_id, q.event_id, off, round(avg(abs(mismatch)) OVER (PARTITION BY "
    "q.user_id, off ORDER BY s.row_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 9) AS m FROM prof q JOIN seq s ON q.event_id = s.event_id) "
    "WHERE m IS NOT NULL GROUP BY user_id, event_id", E, ["at_zero", "gap", "best_offset"], extra=GRID))
def smoothed_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Mismatch per (row, offset), averaged over 21 neighbouring rows of the same offset, then reduced per row."""
    log = index_rows(clicks(spark, sf), U, ["x", "event_id"], "x")
    prof = I.offset_profile(log, curve_of(spark, sf), U, "x", "value", "cx", "cy", OFFSETS).withColumn("m", F.abs("mismatch"))
    smooth = framed(prof, ["user_id", "offset"], 10, 10, lambda w: {"s": F.avg("m").over(w.rowsBetween(-10, 10))})
    # Rounded so that two equally good offsets tie exactly and the first one wins.
    smooth = smooth.withColumn("s", F.round("s", 9))
    d = smooth.where(F.col("s").isNotNull()).groupBy(*E).agg(
        F.max(F.when(F.col("offset") == 0, F.col("s"))).alias("at_zero"), F.min("s").alias("low"),
        F.min_by("offset", F.struct("s", "offset")).alias("best_offset"))
    return shown(d.withColumn("gap", F.col("at_zero") - F.col("low")), E, ["at_zero", "gap", "best_offset"])


@query("j6_interp_by_depth_between_copies", curve_sql(
    f"SELECT user_id, event_id, CASE WHEN ax = x THEN ay WHEN ax IS NOT NULL AND bx IS NOT NULL THEN {at_sql()} END AS ref_value "
    f"FROM ({bracket_sql('pr', knots='ord')}) WHERE CASE WHEN ax = x THEN TRUE ELSE ax IS NOT NULL AND bx IS NOT NULL END", E, ["ref_value"],
    extra=""", pr AS (SELECT user_id, event_id, x FROM seq),
 ord AS (SELECT user_id, x AS kx, avg(value) AS ky FROM seq WHERE event_type = 'purchase' GROUP BY 1, 2)"""))
def depth_copies(spark: SparkSession, sf: str) -> DataFrame:
    """A second measurement of the same group on its own depth axis; only rows inside its range are kept."""
    every = events(spark, sf)
    other = every.where(F.col("event_type") == "purchase").select("user_id", F.col("x").alias("cx"), F.col("value").alias("cy"))
    d = I.interp_join(every, other, U, "x", "cx", "cy", "ref_value", "null").where(F.col("ref_value").isNotNull())
    return shown(d, E, ["ref_value"])


@query("j7_nearest_knot", curve_sql(
    f"SELECT user_id, event_id, CASE WHEN ax IS NOT NULL AND (bx IS NULL OR x - ax <= bx - x) THEN ax ELSE bx END AS knot_x, "
    f"CASE WHEN ax IS NOT NULL AND (bx IS NULL OR x - ax <= bx - x) THEN ay ELSE byy END AS knot_y FROM ({bracket_sql('probe')})",
    E, ["knot_x", "knot_y"]))
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return shown(I.nearest_knot(clicks(spark, sf), curve_of(spark, sf), U, "x", "cx", "cy"), E, ["knot_x", "knot_y"])


@query("j8_regrid", curve_sql(
    f"SELECT user_id, step, {at_sql()} AS grid_y FROM ({bracket_sql('g')})", ["user_id", "step"], ["grid_y"],
    extra=""", g AS (SELECT user_id, CAST(s AS BIGINT) AS step, 24.0::DOUBLE * s AS x FROM
 (SELECT user_id, unnest(generate_series(0, CAST(floor(max(kx) / 24 + 1e-9) AS BIGINT))) AS s FROM knots GROUP BY user_id))"""))
def regrid(spark: SparkSession, sf: str) -> DataFrame:
    """Daily grid from day 0 to the last knot of each curve, the first knot held before it."""
    return shown(I.regrid(curve_of(spark, sf), U, "cx", "cy", 24.0, 0.0), ["user_id", "step"], ["grid_y"])


@query("j8_regrid_own_range", curve_sql(
    f"SELECT user_id, step, x AS grid_x, {at_sql()} AS grid_y FROM ({bracket_sql('g')})", ["user_id", "step"], ["grid_x", "grid_y"],
    extra=""", g AS (SELECT user_id, CAST(s AS BIGINT) AS step, lo + 0.5::DOUBLE * s AS x FROM
 (SELECT user_id, min(kx) AS lo, unnest(generate_series(0, CAST(floor((max(kx) - min(kx)) / 0.5 + 1e-9) AS BIGINT))) AS s FROM knots GROUP BY user_id))"""))
def regrid_own(spark: SparkSession, sf: str) -> DataFrame:
    """Grid of 0.5 steps from the first to the last knot of each curve."""
    return shown(I.regrid(curve_of(spark, sf), U, "cx", "cy", 0.5), ["user_id", "step"], ["grid_x", "grid_y"])


SPAN = """, span AS (SELECT user_id, min(x) AS lo, max(x) AS hi FROM seq WHERE known AND event_type = 'click' GROUP BY user_id),
band AS (SELECT k.*, s.lo, s.hi, count(*) FILTER (k.x BETWEEN lo - 10 AND hi + 10) OVER (PARTITION BY k.user_id) AS nin
 FROM ev k JOIN span s USING (user_id) WHERE event_type = 'view')"""


@query("j9_band_filter", curve_sql(
    "SELECT user_id, x AS cx, value AS cy FROM band WHERE x BETWEEN lo - 10 AND hi + 10 OR nin < 3", ["user_id"], ["cx", "cy"], extra=SPAN))
def band_filter(spark: SparkSession, sf: str) -> DataFrame:
    return shown(A.curve_band(curve_of(spark, sf), known_clicks(spark, sf), U, "cx", "x", 10.0, 3), U, ["cx", "cy"])


@query("j19_band_mean", curve_sql(
    f"SELECT user_id, event_id, coalesce((SELECT avg(ky) FROM knots k WHERE k.user_id = q.user_id AND k.kx BETWEEN q.x - 24 AND q.x + 24), {at_sql()}) AS bm "
    f"FROM ({bracket_sql('probe')}) q", E, ["bm"]))
def band_mean(spark: SparkSession, sf: str) -> DataFrame:
    return shown(I.band_mean(clicks(spark, sf), curve_of(spark, sf), U, "x", "cx", "cy", 24.0, "bm"), E, ["bm"])


@query("w19_curve_variability", curve_sql(
    f"SELECT user_id, event_id, {at_sql()} AS local_std FROM ({bracket_sql('probe', knots='ks')})", E, ["local_std"],
    extra=""", ks AS (SELECT user_id, kx, CASE WHEN count(*) OVER w > 1 THEN stddev_samp(ky) OVER w ELSE 0 END AS ky FROM knots
 WINDOW w AS (PARTITION BY user_id ORDER BY kx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING))"""))
def curve_variability(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling std of the curve itself (41 knots), looked up at the probes."""
    knots = index_rows(curve_of(spark, sf), U, ["cx"], "cx")
    knots = rolling(knots, U, "cy", [41], ["std"], "c").fillna(0.0, ["c_std41"])
    return shown(I.interp_join(clicks(spark, sf), knots, U, "x", "cx", "c_std41", "local_std"), E, ["local_std"])


@query("w19_curve_slope", curve_sql(
    f"SELECT user_id, event_id, {at_sql()} AS local_slope FROM ({bracket_sql('probe', knots='ks')})", E, ["local_slope"], 4,
    extra=""", kg AS (SELECT *, lag(ky) OVER w AS p, lead(ky) OVER w AS n, kx - lag(kx) OVER w AS hp, lead(kx) OVER w - kx AS hn FROM knots
 WINDOW w AS (PARTITION BY user_id ORDER BY kx)), ks AS (SELECT user_id, kx, CASE WHEN p IS NULL THEN (n - ky) / hn WHEN n IS NULL THEN (ky - p) / hp
 ELSE (hn * (ky - p) / hp + hp * (n - ky) / hn) / (hp + hn) END AS ky FROM kg)"""))
def curve_slope(spark: SparkSession, sf: str) -> DataFrame:
    knots = gradient(index_rows(curve_of(spark, sf), U, ["cx"], "cx"), U, "cy", "slope", "cx")
    return shown(I.interp_join(clicks(spark, sf), knots, U, "x", "cx", "slope", "local_slope"), E, ["local_slope"], 4)


@query("w20_lookalike_share", curve_sql(
    "SELECT p.user_id, p.event_id, avg(CASE WHEN abs(ky - value) < 15 THEN 1.0::DOUBLE ELSE 0 END) FILTER (abs(kx - x) <= 60) AS alias_60, "
    "avg(CASE WHEN abs(ky - value) < 15 THEN 1.0::DOUBLE ELSE 0 END) AS alias_120 FROM probe p JOIN knots k ON p.user_id = k.user_id "
    "AND abs(kx - x) <= 120 GROUP BY ALL", E, ["alias_60", "alias_120"]))
def lookalike(spark: SparkSession, sf: str) -> DataFrame:
    d = I.lookalike_share(clicks(spark, sf), curve_of(spark, sf), U, E, "x", "value", "cx", "cy", [60.0, 120.0], 15.0)
    return shown(d, E, ["alias_60", "alias_120"])


# --- calibration -------------------------------------------------------------------------------------------------


@query("a10_simple_slope", f"""WITH {EVENTS_SQL} SELECT user_id, {sql_rounded('CASE WHEN n >= 2 AND s >= 1e-6 THEN b ELSE 0 END')} AS slope FROM (
 SELECT user_id, count(sig) AS n, stddev_pop(x) FILTER (sig IS NOT NULL) AS s, regr_slope(sig, x) AS b FROM seq WHERE known GROUP BY user_id)""")
def simple_slope(spark: SparkSession, sf: str) -> DataFrame:
    d = A.slope(event_log(spark, sf).where("known"), U, F.col("x"), F.col("sig"))
    return shown(d, U, ["slope"])


AFF = """, lagged AS (SELECT user_id, known, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY row_idx) AS px FROM seq),
fit AS (SELECT user_id, CAST(count(px) AS BIGINT) AS pairs, regr_slope(y, px) AS ra, regr_intercept(y, px) AS rb,
 stddev_pop(px) AS s, avg(y) FILTER (px IS NOT NULL) - avg(px) AS d FROM lagged GROUP BY user_id)"""
AFF_OK = "pairs >= 20 AND s >= 1e-6 AND ra BETWEEN 0.01 AND 5"


def lagged(spark: SparkSession, sf: str) -> DataFrame:
    return framed(event_log(spark, sf), U, 1, 0, lambda w: {"px": F.lag("value").over(w)})


@query("a11_affine", f"""WITH {EVENTS_SQL}{AFF} SELECT user_id, pairs, {sql_rounded(f'CASE WHEN {AFF_OK} THEN ra ELSE 1 END')} AS a,
 {sql_rounded(f'CASE WHEN {AFF_OK} THEN rb ELSE d END')} AS b FROM fit""")
def affine(spark: SparkSession, sf: str) -> DataFrame:
    return shown(A.affine(lagged(spark, sf), U, F.col("px"), F.col("value"), 20, 0.01, 5.0), ["user_id", "pairs"], ["a", "b"])


BAND_OUT = ["offset_b", "var_a", "var_b", "affine_a", "affine_b"]
KNOWN_HIT = f", kn AS (SELECT * FROM seq WHERE known AND event_type = 'click'), hit AS (SELECT *, {at_sql()} AS t FROM ({bracket_sql('kn')}))"


@query("a12_band_calibration", curve_sql(
    """SELECT user_id, CASE WHEN n >= 3 THEN km - bm ELSE 0 END AS offset_b, CASE WHEN n >= 3 THEN va ELSE 1 END AS var_a,
 CASE WHEN n >= 3 THEN km - va * bm ELSE 0 END AS var_b, CASE WHEN ok THEN ra ELSE 1 END AS affine_a,
 CASE WHEN ok THEN rb WHEN n >= 3 THEN km - bm ELSE 0 END AS affine_b FROM (
 SELECT *, CASE WHEN sb > 1e-6 THEN least(greatest(sk / sb, 0.2), 5) ELSE 1 END AS va,
  n >= 3 AND np >= 3 AND st >= 1e-6 AND ra BETWEEN 0.2 AND 5 AS ok FROM (
  SELECT user_id, count(value) AS n, avg(value) AS km, stddev_pop(value) AS sk, count(t) AS np, stddev_pop(t) AS st,
   CASE WHEN count(t) > 1 THEN regr_slope(value, t) END AS ra, CASE WHEN count(t) > 1 THEN regr_intercept(value, t) END AS rb FROM hit GROUP BY user_id)
 JOIN (SELECT user_id, avg(value) AS bm, stddev_pop(value) AS sb FROM band WHERE x BETWEEN lo - 10 AND hi + 10 OR nin < 3 GROUP BY user_id) USING (user_id))""",
    U, BAND_OUT, extra=SPAN + KNOWN_HIT))
def band_calibration(spark: SparkSession, sf: str) -> DataFrame:
    d = A.band_calibrate(known_clicks(spark, sf), curve_of(spark, sf), U, "x", "value", "cx", "cy", 10.0, 3, 3)
    return shown(d, U, BAND_OUT)


SEG_OUT = ["b_full", "b_early", "b_mid", "b_late", "b_wls"]


@query("a13_segment_offsets", f"""WITH {PARTS_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY well) AS n FROM plog WHERE known)
SELECT {sql_shown(['well'], SEG_OUT, 4)} FROM (SELECT well, quantile_cont(price, 0.5) AS b_full,
 quantile_cont(price, 0.5) FILTER (row_idx < greatest(1, n // 3)) AS b_early,
 quantile_cont(price, 0.5) FILTER (row_idx >= n // 3 AND row_idx < greatest(n // 3 + 1, 2 * n // 3)) AS b_mid,
 quantile_cont(price, 0.5) FILTER (row_idx >= n - 50) AS b_late,
 sum(exp(0.02 * (row_idx - n + 1)) * price) / sum(exp(0.02 * (row_idx - n + 1))) AS b_wls FROM k GROUP BY well)""")
def segment_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return shown(A.segment_offsets(cut_lineage(part_log(spark, sf).where("known").select("well", "row_idx", "price")), ["well"], "price"), ["well"], SEG_OUT, 4)


@query("a14_residual_stats", curve_sql(
    "SELECT user_id, sqrt(avg((value - t) * (value - t))) AS rmse, avg(value - t) AS bias, stddev_pop(value - t) AS spread FROM hit GROUP BY user_id",
    U, ["rmse", "bias", "spread"], extra=KNOWN_HIT))
def residual_stats(spark: SparkSession, sf: str) -> DataFrame:
    hit = I.interp_join(known_clicks(spark, sf), curve_of(spark, sf), U, "x", "cx", "cy", "t")
    return shown(A.residual_stats(hit, U, F.col("value") - F.col("t")), U, ["rmse", "bias", "spread"])


@query("a15_noise_scale", curve_sql(
    "SELECT user_id, least(greatest(stddev_pop(coalesce(sig, 0) - t), 10), 60) AS std_scale, "
    "CASE WHEN count(sig - t) > 0 THEN least(greatest(quantile_cont(abs(sig - t), 0.5), 5), 40) END AS median_scale FROM kh GROUP BY user_id",
    U, ["std_scale", "median_scale"],
    extra=f", kn AS (SELECT * FROM seq WHERE known AND event_type <> 'view'), kh AS (SELECT * FROM (SELECT *, {at_sql()} AS t FROM ({bracket_sql('kn')})) WHERE t IS NOT NULL)"))
def noise_scale(spark: SparkSession, sf: str) -> DataFrame:
    known = event_log(spark, sf).where(F.col("known") & (F.col("event_type") != "view"))
    hit = I.interp_join(known, curve_of(spark, sf), U, "x", "cx", "cy", "t").where(F.col("t").isNotNull())
    return shown(A.noise_scale(hit, U, "sig", "t"), U, ["std_scale", "median_scale"])


@query("a16_exit_slope", f"""WITH {EVENTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) AS r FROM seq WHERE known),
d AS (SELECT user_id, x - lag(x) OVER w AS dx, value - lag(value) OVER w AS dy FROM t WHERE r <= 30 WINDOW w AS (PARTITION BY user_id ORDER BY row_idx))
SELECT user_id, {sql_rounded('CASE WHEN count(*) FILTER (dx > 0) >= 3 THEN quantile_cont(dy / dx, 0.5) FILTER (dx > 0) ELSE 0 END')} AS exit_slope FROM d GROUP BY user_id""")
def exit_slope(spark: SparkSession, sf: str) -> DataFrame:
    return shown(A.exit_slope(event_log(spark, sf).where("known"), U, "value", "x"), U, ["exit_slope"])


AGREE = ["corr_raw", "corr_detrended", "curve_hf_std", "corr_gap"]


@query("a17_alias_stats", curve_sql(
    """SELECT user_id, cr AS corr_raw, cd AS corr_detrended, hf AS curve_hf_std, cr - cd AS corr_gap FROM (
 SELECT user_id, CASE WHEN count(*) >= 5 AND stddev_pop(value) > 1e-6 AND stddev_pop(t) > 1e-6 THEN corr(value, t) END AS cr, CASE WHEN count(*) >= 5 AND stddev_pop(value - ym) > 1e-6 AND stddev_pop(t - tm) > 1e-6 THEN corr(value - ym, t - tm) END AS cd FROM (
  SELECT *, avg(value) OVER w AS ym, avg(t) OVER w AS tm FROM hit WINDOW w AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING))
 GROUP BY user_id) LEFT JOIN (SELECT user_id, CASE WHEN count(*) >= 3 THEN stddev_samp(value - m) END AS hf FROM (
  SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY x ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS m FROM band WHERE x BETWEEN lo - 10 AND hi + 10)
 GROUP BY user_id) USING (user_id)""", U, AGREE, extra=SPAN + KNOWN_HIT.replace("event_type = 'click'", "event_type = 'click'")))
def alias_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = A.agreement(known_clicks(spark, sf), curve_of(spark, sf), U, "x", "value", "cx", "cy", 101, 5, 3)
    return shown(d, U, AGREE)


@query("flow_calibrated_error", f"""WITH {EVENTS_SQL}, {KNOTS}{KNOWN_HIT}, cal AS (SELECT user_id,
 CASE WHEN count(*) >= 5 AND stddev_pop(t) >= 1e-6 AND regr_slope(value, t) BETWEEN 0.2 AND 5 THEN regr_slope(value, t) ELSE 1 END AS a,
 CASE WHEN count(*) >= 5 AND stddev_pop(t) >= 1e-6 AND regr_slope(value, t) BETWEEN 0.2 AND 5 THEN regr_intercept(value, t) ELSE avg(value) - avg(t) END AS b
 FROM hit WHERE t IS NOT NULL GROUP BY user_id),
ev2 AS (SELECT q.*, {at_sql()} AS t2 FROM ({bracket_sql('(SELECT * FROM seq WHERE NOT known AND event_type = ' + chr(39) + 'click' + chr(39) + ')')}) q)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, {sql_rounded('sqrt(avg(pow(value - (a * t2 + b), 2)))')} AS rmse FROM ev2 JOIN cal USING (user_id) WHERE t2 IS NOT NULL GROUP BY user_id""")
def calibrated_error(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix -> affine calibration of the curve -> interpolation on the withheld rows -> error per group."""
    log = event_log(spark, sf).where(F.col("event_type") == "click")
    hit = I.interp_join(log, curve_of(spark, sf), U, "x", "cx", "cy", "t").where(F.col("t").isNotNull())
    cal = A.affine(hit.where("known"), U, F.col("t"), F.col("value"), 5)
    e = F.col("value") - (F.col("a") * F.col("t") + F.col("b"))
    d = hit.where(~F.col("known")).join(cal, U).groupBy(*U).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return shown(d, ["user_id", "n"], ["rmse"])
