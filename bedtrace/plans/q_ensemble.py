"""Queries for track combination, blends, robust fits and guarded corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.operators import calibrate as A
from bedtrace.operators import ensemble as E
from bedtrace.operators import guard as G
from bedtrace.operators import metrics as M
from bedtrace.operators import robust as R
from bedtrace.operators.cells import framed, index_rows, with_group_stats
from bedtrace.operators.interp import regrid
from bedtrace.plans.bindings import EVENTS_SQL, PARTS_SQL, event_log, events, part_log, table
from bedtrace.plans.q_interp import KNOTS, KNOWN_HIT, at_sql, bracket_sql, curve_of, known_clicks
from bedtrace.plans.q_metrics import FC_SQL, four_errors, forecasts
from bedtrace.plans.registry import query, rounded, shown, sql_rounded, sql_shown
from bedtrace.session import cut_lineage

U = ["user_id"]
K = ["user_id", "row_idx"]

# --- seed tracks: group supplier, row month, seed line number ----------------------------------------------------------

TRACKS = """tr AS (SELECT l_suppkey AS well, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS r, l_linenumber AS seed, avg(l_extendedprice) / 1000 AS pred
 FROM lineitem GROUP BY 1, 2, 3), ll AS (SELECT l_suppkey AS well, l_linenumber AS seed, -avg(l_quantity) AS ll FROM lineitem GROUP BY 1, 2),
lw AS (SELECT *, ll - max(ll) OVER (PARTITION BY well) AS d FROM ll)"""
SCALES = [3.0, 5.0, 8.0, 12.0]
TRACK_OUT = [f"scale_{s:g}" for s in SCALES] + ["track_mean", "track_std", "scale_core"]
COMBINED = ", cb AS (SELECT well, r, " + ", ".join(f"sum(exp(d/{s}) * pred) / sum(exp(d/{s})) AS scale_{s:g}" for s in SCALES) + \
    ", avg(pred) AS track_mean, stddev_pop(pred) AS track_std FROM tr JOIN lw USING (well, seed) GROUP BY well, r)"


def tracks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").withColumns({
        "well": F.col("l_suppkey"), "seed": F.col("l_linenumber"), "r": (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")})
    tr = li.groupBy("well", "r", "seed").agg((F.avg("l_extendedprice") / 1000).alias("pred"))
    return tr, li.groupBy("well", "seed").agg((-F.avg("l_quantity")).alias("ll"))


def combined(spark: SparkSession, sf: str) -> DataFrame:
    tr, ll = tracks(spark, sf)
    return E.combine_tracks(tr, ll, "well", "r", "seed", "pred", "ll", SCALES)


@query("d5_combine_tracks", f"WITH {TRACKS}{COMBINED} SELECT {sql_shown(['well', 'r'], TRACK_OUT[:-1])}, {sql_rounded('(scale_3 + scale_5 + scale_8) / 3')} AS scale_core FROM cb")
def combine_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return shown(combined(spark, sf), ["well", "r"], TRACK_OUT)


@query("d5_likelihood_quality", f"""WITH {TRACKS} SELECT well, {sql_rounded('max(ll) / any_value(n)')} AS best_ll_per_row, {sql_rounded('stddev_pop(ll)')} AS ll_std
FROM ll JOIN (SELECT well, count(*) AS n FROM tr GROUP BY well) USING (well) GROUP BY well""")
def ll_quality(spark: SparkSession, sf: str) -> DataFrame:
    tr, ll = tracks(spark, sf)
    return shown(E.likelihood_quality(ll, "well", "ll", tr), ["well"], ["best_ll_per_row", "ll_std"])


@query("d6_two_pass_mix", f"WITH {TRACKS}{COMBINED} SELECT well, r, {sql_rounded('0.65 * scale_5 + 0.35 * track_mean')} AS mixed FROM cb")
def two_pass(spark: SparkSession, sf: str) -> DataFrame:
    return shown(combined(spark, sf).withColumn("mixed", E.mix(F.col("scale_5"), F.col("track_mean"), 0.35)), ["well", "r"], ["mixed"])


# --- forecasts as members ---------------------------------------------------------------------------------------------

MEMBERS = f"""{FC_SQL}, mb AS (SELECT f.*, a.last, row_idx - a.la AS depth FROM fc f JOIN (SELECT user_id, arg_max(value, row_idx) AS last, max(row_idx) AS la FROM seq WHERE known GROUP BY user_id) a USING (user_id) WHERE NOT known)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    k = F.when(F.col("known"), F.col("row_idx"))
    d = with_group_stats(forecasts(spark, sf), U, {"last": F.max_by("value", k), "la": F.max(k)})
    return d.where(~F.col("known")).withColumn("depth", F.col("row_idx") - F.col("la"))


@query("d15_warmup_damping", f"WITH {MEMBERS} SELECT user_id, row_idx, {sql_rounded('last + (lag1 - last) * (1 - exp(-greatest(depth, 0) / 85.0))')} AS damped FROM mb")
def damping(spark: SparkSession, sf: str) -> DataFrame:
    d = members(spark, sf)
    return shown(d.withColumn("damped", F.col("last") + E.damp(F.col("lag1") - F.col("last"), F.col("depth"))), K, ["damped"])


BINS = """, bn AS (SELECT user_id, (count(*) > 48)::INT + 2 * ((max(value) - min(value) >= 185.51)::INT + (max(value) - min(value) >= 136.73)::INT) AS bin FROM mb GROUP BY user_id)"""


def bins(d: DataFrame) -> DataFrame:
    return d.groupBy(*U).agg(E.selector_bin(F.count(F.lit(1)), F.max("value") - F.min("value"), 48, (136.73, 185.51)).alias("bin"))


@query("d16_selector_bins", f"WITH {MEMBERS}{BINS} SELECT user_id, CAST(bin AS INTEGER) AS bin FROM bn")
def selector_bins(spark: SparkSession, sf: str) -> DataFrame:
    return bins(members(spark, sf)).select("user_id", F.col("bin").cast("int").alias("bin"))


@query("d17_variant_evaluation", f"""WITH {MEMBERS}{BINS}, vt(bin, scale, b, h) AS (VALUES (0, 5, 0.0, 0.2), (1, 3, 0.0, 0.15), (2, 12, 0.2, 0.15), (3, 5, 0.0, 0.15), (4, 5, 0.05, 0.05), (5, 12, 0.2, 0.05))
SELECT user_id, row_idx, {sql_rounded('(1 - h::DOUBLE) * ((1 - b::DOUBLE) * CASE scale WHEN 3 THEN lag1 WHEN 5 THEN lag2 WHEN 12 THEN mean3 END + b::DOUBLE * flat) + h::DOUBLE * last')} AS pred FROM mb JOIN bn USING (user_id) JOIN vt USING (bin)""")
def variants(spark: SparkSession, sf: str) -> DataFrame:
    d = cut_lineage(members(spark, sf).select(*K, "value", "lag1", "lag2", "mean3", "flat", "last"))
    chosen = bins(d).join(F.broadcast(E.variant_table(spark, E.SELECTOR_VARIANTS)), "bin")  # six fixed rows
    v = E.variant_value({3.0: F.col("lag1"), 5.0: F.col("lag2"), 12.0: F.col("mean3")}, F.col("flat"), F.col("last"),
                        F.col("scale"), F.col("beam_w"), F.col("hold_w"))
    return shown(d.join(chosen, U).withColumn("pred", v), K, ["pred"])


VGRID = [(s, b, h) for s in (3.0, 5.0, 12.0) for b in (0.0, 0.2) for h in (0.0, 0.1, 0.2)]


def variant_errors(spark: SparkSession, sf: str) -> DataFrame:
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(b).alias("b"), F.lit(h).alias("h"), F.lit(f"v_{s:g}_{b}_{h}").alias("method")) for s, b, h in VGRID]))
    d = members(spark, sf).select("user_id", "value", "lag1", "lag2", "mean3", "flat", "last", grid.alias("g")).select("*", "g.*")
    v = E.variant_value({3.0: F.col("lag1"), 5.0: F.col("lag2"), 12.0: F.col("mean3")}, F.col("flat"), F.col("last"), F.col("scale"), F.col("b"), F.col("h"))
    return d.select("user_id", "method", (v - F.col("value")).alias("error"))


VSQL = f"""{MEMBERS}, vt(scale, b, h, method) AS (VALUES {', '.join(f"({s}, {b}, {h}, 'v_{s:g}_{b}_{h}')" for s, b, h in VGRID)}),
ve AS (SELECT user_id, method, (1 - h::DOUBLE) * ((1 - b::DOUBLE) * CASE scale WHEN 3 THEN lag1 WHEN 5 THEN lag2 WHEN 12 THEN mean3 END + b::DOUBLE * flat) + h::DOUBLE * last - value AS error FROM mb CROSS JOIN vt),
vg AS (SELECT user_id, method, count(*) AS n, sqrt(avg(error * error)) AS rmse FROM ve GROUP BY user_id, method)"""


@query("j16_variant_grid", f"WITH {VSQL} SELECT method, {sql_rounded('sqrt(avg(error * error))')} AS rmse FROM ve GROUP BY method")
def variant_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every row under every variant of a small fixed table, scored over all groups."""
    return shown(variant_errors(spark, sf).groupBy("method").agg(M.rmse(F.col("error")).alias("rmse")), ["method"], ["rmse"])


@query("d18_oracle_variant", f"""WITH {VSQL} SELECT user_id, method, {sql_rounded('rmse')} AS rmse FROM vg QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(rmse, 9), method) = 1""")
def oracle_variant(spark: SparkSession, sf: str) -> DataFrame:
    per = M.group_rmse(variant_errors(spark, sf), ["user_id", "method"]).withColumn("r", F.round("rmse", 9))
    best = per.groupBy("user_id").agg(F.min_by(F.struct("method", "rmse"), F.struct("r", "method")).alias("b"))
    return shown(best.select("user_id", "b.*"), ["user_id", "method"], ["rmse"])


@query("d19_blend_grid_report", f"""WITH {MEMBERS}, g AS (SELECT w.w / 100.0::DOUBLE AS weight, lag1 + w.w / 100.0::DOUBLE * (mean3 - lag1) AS bl, lag1, value FROM mb CROSS JOIN (SELECT unnest([30, 50, 52, 54, 56, 58, 60]) AS w) w)
SELECT {sql_rounded('weight')} AS weight, {sql_rounded('sqrt(avg(pow(bl - value, 2)))')} AS rmse, {sql_rounded('sqrt(avg(pow(bl - lag1, 2)))')} AS move_rms, {sql_rounded('quantile_cont(abs(bl - lag1), 0.95)')} AS move_p95 FROM g GROUP BY weight""")
def blend_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = E.blend_report(members(spark, sf), "lag1", "mean3", "value", [0.30, 0.50, 0.52, 0.54, 0.56, 0.58, 0.60])
    return shown(d, [], ["weight", "rmse", "move_rms", "move_p95"])


@query("d20_risk_tiered_blend", f"""WITH {MEMBERS}, r AS (SELECT *, avg(abs(lag1 - lag2)) OVER (PARTITION BY user_id) AS risk FROM mb)
SELECT user_id, row_idx, {sql_rounded('0.9 * (CASE WHEN risk >= 60 THEN last + 1.09 * (0.15 * lag1 + 0.45 * lag2 + 0.40 * mean3 - last) ELSE 0.10 * lag1 + 0.40 * lag2 + 0.50 * mean3 END) + 0.1 * flat')} AS blend FROM r""")
def tiered(spark: SparkSession, sf: str) -> DataFrame:
    d = members(spark, sf).withColumn("risk", F.abs(F.col("lag1") - F.col("lag2")))
    b = E.tiered_blend(d, U, "risk", ["lag1", "lag2", "mean3"], [0.10, 0.40, 0.50], [0.15, 0.45, 0.40], "last", 60.0, 1.09, ("flat", 0.10))
    return shown(b, K, ["blend"])


@query("d21_gated_chain", f"""WITH {MEMBERS}, t1 AS (SELECT *, 0.65 * lag1 + 0.35 * mean3 AS p1 FROM mb),
md AS (SELECT user_id, quantile_cont(abs(lag1 - lag2), 0.5) AS md FROM t1 GROUP BY user_id), th AS (SELECT quantile_cont(md, 0.75) AS thr FROM md),
t2 AS (SELECT t1.*, CASE WHEN md <= thr THEN 0.8 * p1 + 0.2 * lag2 ELSE p1 END AS p2 FROM t1 JOIN md USING (user_id) CROSS JOIN th),
t4 AS (SELECT *, max(abs(p2 - last)) OVER (PARTITION BY user_id) AS exc, stddev_pop(p2) OVER (PARTITION BY user_id) AS sp FROM t2)
SELECT user_id, row_idx, {sql_rounded('CASE WHEN sp < 40 AND exc < 90 THEN 0.75 * p2 + 0.25 * last ELSE p2 END')} AS chained FROM t4""")
def gated_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated mix, then a dense mix for groups with near neighbours, then a hold gate (the projection step is d14)."""
    d = cut_lineage(members(spark, sf).withColumns({
        "p1": E.mix(F.col("lag1"), F.col("mean3"), 0.35), "dist": F.abs(F.col("lag1") - F.col("lag2"))}))
    d = E.dense_gate(d, U, "dist", 0.75, F.col("p1"), F.col("lag2"), 0.2, "p2")
    d = with_group_stats(d, U, {"sp": F.stddev_pop("p2")})
    return shown(E.hold_gate(d, U, "p2", "last", F.col("sp") < 40, 90.0, 0.25, "chained"), K, ["chained"])


# --- branches ---------------------------------------------------------------------------------------------------------

BRANCH = f"""lv AS (SELECT l_partkey AS well, l_extendedprice / 1000 AS level, l_quantity / sum(l_quantity) OVER (PARTITION BY l_partkey) AS w, l_orderkey * 10 + l_linenumber AS tie FROM lineitem),
cs AS (SELECT *, sum(w) OVER o AS cw, sum(w*level) OVER o AS cx, sum(w*level*level) OVER o AS cx2, sum(w*level) OVER (PARTITION BY well) AS tx, sum(w*level*level) OVER (PARTITION BY well) AS tx2
 FROM lv WINDOW o AS (PARTITION BY well ORDER BY level, tie ROWS UNBOUNDED PRECEDING)),
br AS (SELECT well, cx/cw AS center_low, (tx-cx)/(1-cw) AS center_high, cw AS mass_low, 1-cw AS mass_high, tx AS weighted_center FROM cs WHERE cw >= 0.05 AND 1 - cw >= 0.05
 QUALIFY row_number() OVER (PARTITION BY well ORDER BY (cx2 - cx*cx/cw) + (tx2 - cx2 - (tx-cx)*(tx-cx)/(1-cw)), level, tie) = 1)"""
BRANCH_OUT = ["center_low", "center_high", "mass_low", "mass_high", "weighted_center"]


def branches(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("well"), (F.col("l_extendedprice") / 1000).alias("level"), F.col("l_quantity").alias("w"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return E.two_branch(d, ["well"], "level", "w", "tie")


@query("d11_two_branch_split", f"WITH {BRANCH} SELECT {sql_shown(['well'], BRANCH_OUT)} FROM br")
def two_branch(spark: SparkSession, sf: str) -> DataFrame:
    return shown(branches(spark, sf), ["well"], BRANCH_OUT)


@query("d12_branch_shift", f"""WITH {BRANCH}, s AS (SELECT *, least(greatest(0.6 * (0.5 * (center_low + center_high) - weighted_center), -2), 2) AS s FROM br)
SELECT well, {sql_rounded('CASE WHEN least(mass_low, mass_high) >= 0.25 AND abs(center_high - center_low) BETWEEN 4 AND 40 AND abs(s) >= 0.01 THEN s ELSE 0 END')} AS shift FROM s""")
def branch_shift(spark: SparkSession, sf: str) -> DataFrame:
    return shown(E.branch_shift(branches(spark, sf), 0.6, 2.0), ["well"], ["shift"])


# --- contacts, augmented curve ----------------------------------------------------------------------------------------


@query("d1_contact_reconstruction", f"""WITH {PARTS_SQL}, ref AS (SELECT well, coalesce(min(x) FILTER (disc = 0.05), min(x)) AS ref FROM plog GROUP BY well),
r AS (SELECT well, row_idx, known, ref - (price / 1000 - qty) AS raw, x FROM plog JOIN ref USING (well)), o AS (SELECT well, avg(x - raw) AS off FROM r WHERE known GROUP BY well)
SELECT well, row_idx, {sql_rounded('raw + off')} AS contact_pred FROM r JOIN o USING (well)""")
def contact_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """ref - (z - surface) + mean known offset; the reference is the first position of a marker, else the first position."""
    log = part_log(spark, sf)
    ref = log.groupBy("well").agg(F.coalesce(F.min(F.when(F.col("disc") == 0.05, F.col("x"))), F.min("x")).alias("ref"))
    d = log.join(ref, "well").withColumn("raw", F.col("ref") - (F.col("price") / 1000 - F.col("qty")))
    d = with_group_stats(d, ["well"], {"off": F.avg(F.when(F.col("known"), F.col("x") - F.col("raw")))})
    return shown(d.withColumn("contact_pred", F.col("raw") + F.col("off")), ["well", "row_idx"], ["contact_pred"])


@query("d4_self_augmented_curve", f"""WITH {EVENTS_SQL}, {KNOTS}{KNOWN_HIT}, cal AS (SELECT user_id, CASE WHEN ok THEN ra ELSE 1 END AS a, CASE WHEN ok THEN rb ELSE d END AS b FROM (
 SELECT user_id, count(*) >= 5 AND stddev_pop(t) >= 1e-6 AND regr_slope(value, t) BETWEEN 0.2 AND 5 AS ok, regr_slope(value, t) AS ra, regr_intercept(value, t) AS rb, avg(value) - avg(t) AS d FROM hit GROUP BY user_id)),
own AS (SELECT user_id, x AS kx, value AS ky FROM kn), gr AS (SELECT user_id, CAST(s AS BIGINT) AS step, 24.0::DOUBLE * s AS x FROM (SELECT user_id, unnest(generate_series(0, CAST(floor(max(kx) / 24 + 1e-9) AS BIGINT))) AS s FROM knots GROUP BY user_id)),
g1 AS (SELECT user_id, step, x, {at_sql()} AS y FROM ({bracket_sql('gr')})),
g2 AS (SELECT user_id, step, x, y, CASE WHEN ax = x THEN ay WHEN ax IS NOT NULL AND bx IS NOT NULL THEN {at_sql()} END AS self FROM ({bracket_sql('g1', knots='own')}))
SELECT user_id, step, {sql_rounded('CASE WHEN self IS NOT NULL THEN 0.4 * (a * y + b) + 0.6 * self ELSE a * y + b END')} AS aug FROM g2 JOIN cal USING (user_id)""")
def augmented_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Curve in log units on a grid, overlaid with the own prefix at weight 0.6 where the prefix covers the grid."""
    from bedtrace.operators.interp import interp_join

    curve, known = curve_of(spark, sf), known_clicks(spark, sf)
    hit = interp_join(known, curve, U, "x", "cx", "cy", "t").where(F.col("t").isNotNull())
    cal = A.affine(hit, U, F.col("t"), F.col("value"), 5)
    grid = regrid(curve, U, "cx", "cy", 24.0, 0.0)
    d = interp_join(grid, known.select("user_id", "x", "value"), U, "grid_x", "x", "value", "own", edge="null").join(cal, U)
    mapped = F.col("a") * F.col("grid_y") + F.col("b")
    return shown(d.withColumn("aug", F.coalesce(E.mix(mapped, F.col("own"), 0.6), mapped)), ["user_id", "step"], ["aug"])


# --- robust fits ------------------------------------------------------------------------------------------------------


def scaled_prices(spark: SparkSession, sf: str) -> DataFrame:
    log = part_log(spark, sf)
    return cut_lineage(log.select("well", "row_idx", ((F.col("row_idx") + 1) / F.col("n_rows")).alias("s"), (F.col("price") / 1000).alias("y")))


@query("d14_projection_straight_line", f"""WITH {PARTS_SQL}, p AS (SELECT well, row_idx, (row_idx + 1.0::DOUBLE) / n_rows AS s, price / 1000 AS y FROM plog),
f1 AS (SELECT well, regr_slope(y, s) AS a, regr_intercept(y, s) AS b FROM p GROUP BY well), sg AS (SELECT well, 1.4826 * quantile_cont(abs(y - a*s - b), 0.5) + 1e-6 AS sig FROM p JOIN f1 USING (well) GROUP BY well),
w AS (SELECT p.*, pow(1 / (1 + pow((y - a*s - b) / (2 * sig), 2)), 2) AS w FROM p JOIN f1 USING (well) JOIN sg USING (well)),
m AS (SELECT well, sum(w*s)/sum(w) AS ms, sum(w*y)/sum(w) AS my FROM w GROUP BY well), f2 AS (SELECT well, sum(w*(s-ms)*(y-my))/sum(w*(s-ms)*(s-ms)) AS a, any_value(ms) AS ms, any_value(my) AS my FROM w JOIN m USING (well) GROUP BY well)
SELECT well, row_idx, {sql_rounded('0.25 * y + 0.75 * (my + a * (s - ms))')} AS projected FROM p JOIN f2 USING (well)""")
def projection_line(spark: SparkSession, sf: str) -> DataFrame:
    """Two solves of degree 1: the case plain SQL can restate."""
    return shown(R.robust_project(scaled_prices(spark, sf), ["well"], "s", "y", 1, solves=2), ["well", "row_idx"], ["projected"])


@query("d14_robust_projection", None)
def projection(spark: SparkSession, sf: str) -> DataFrame:
    """Degree 4, five solves, blend 0.75."""
    return shown(R.robust_project(scaled_prices(spark, sf), ["well"], "s", "y", 4), ["well", "row_idx"], ["projected"])


@query("d14_anchored_projection", None)
def anchored_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Degree 3 without intercept, four solves, blend by excursion."""
    d = scaled_prices(spark, sf)
    d = with_group_stats(d, ["well"], {"y0": F.min_by("y", "row_idx")}).withColumn("y", F.col("y") - F.col("y0"))
    return shown(R.robust_project(d, ["well"], "s", "y", 3, solves=4, blend=None, intercept=False), ["well", "row_idx"], ["projected"])


@query("d14_ramped_blend", f"""WITH {PARTS_SQL}, p AS (SELECT well, row_idx, price / 1000 AS y, regr_intercept(price / 1000, row_idx) OVER g + row_idx * regr_slope(price / 1000, row_idx) OVER g AS f FROM plog WINDOW g AS (PARTITION BY well))
SELECT well, row_idx, {sql_rounded('y + 0.75 * least(row_idx / 300.0::DOUBLE, 1) * (f - y)')} AS ramp300, {sql_rounded('y + 0.75 * least(row_idx / 900.0::DOUBLE, 1) * (f - y)')} AS ramp900 FROM p""")
def ramped_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Blend weight rising with depth over 300 and 900 rows."""
    d = part_log(spark, sf).withColumn("y", F.col("price") / 1000)
    fit = d.groupBy("well").agg(F.regr_slope("y", "row_idx").alias("a"), F.regr_intercept("y", "row_idx").alias("b"))
    f = F.col("a") * F.col("row_idx") + F.col("b")
    d = d.join(fit, "well").withColumns({
        f"ramp{n}": E.mix(F.col("y"), f, 0.75 * F.least(F.col("row_idx") / float(n), F.lit(1.0))) for n in (300, 900)})
    return shown(d, ["well", "row_idx"], ["ramp300", "ramp900"])


@query("d13_polynomial_extrapolation", None)
def poly_extrapolation(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees 1..3 on the last 80 / 160 / 320 / 640 / all known rows, robustly reweighted."""
    log = part_log(spark, sf).withColumn("y", F.col("price") / 1000)
    d = R.polynomial_candidates(log, "well", "x", "y", "known", [80, 160, 320, 640, None], [1, 2, 3])
    return shown(d, ["well", "row_idx", "name"], ["pred"], 4)


@query("d31_segment_curve", None)
def segment_curve(spark: SparkSession, sf: str) -> DataFrame:
    log = with_group_stats(event_log(spark, sf), U, {"m": F.avg("value")})
    from bedtrace.operators.cells import position_cells, running

    walk = running(position_cells(log), U, ["row_idx"], {"walk": F.col("value") - F.col("m")}).drop("_cell")
    return shown(R.segment_curve(walk, "user_id", "x", "walk", 30.0, 40.0), ["user_id", "a", "b"], ["length", "rate"])


# --- guarded corrections ----------------------------------------------------------------------------------------------


# The reference of a user: the high-valued signups, another measurement on the same axis. The limits are such that every status occurs.
@query("d22_guarded_override", f"""WITH {EVENTS_SQL}, ord AS (SELECT user_id, x AS kx, avg(value) AS ky FROM seq WHERE event_type = 'signup' AND value > 60 GROUP BY 1, 2),
hit AS (SELECT *, CASE WHEN ax = x THEN ay WHEN ax IS NOT NULL AND bx IS NOT NULL THEN {at_sql()} END AS ref FROM ({bracket_sql('seq', knots='ord')})),
v AS (SELECT user_id, n_ref, count(ref) FILTER (known) AS ov, sqrt(avg(pow(ref - value, 2)) FILTER (known)) AS rm FROM hit LEFT JOIN (SELECT user_id, count(*) AS n_ref FROM ord GROUP BY 1) USING (user_id) GROUP BY user_id, n_ref),
s AS (SELECT user_id, CASE WHEN n_ref IS NULL THEN 'no_reference' WHEN n_ref < 3 THEN 'few_reference_rows' WHEN ov < 8 THEN 'few_overlap_rows' WHEN rm <= 80 THEN 'ok' ELSE 'prefix_mismatch' END AS status FROM v)
SELECT user_id, row_idx, status, {sql_rounded("CASE WHEN status = 'ok' AND ref IS NOT NULL THEN ref ELSE value END")} AS value_out FROM hit JOIN s USING (user_id)""")
def override(spark: SparkSession, sf: str) -> DataFrame:
    base = event_log(spark, sf).withColumn("kv", F.when(F.col("known"), F.col("value")))
    ref = base.where((F.col("event_type") == "signup") & (F.col("value") > 60)).select("user_id", F.col("x").alias("rx"), F.col("value").alias("rv"))
    d = G.guarded_override(base, ref, "user_id", "x", "value", "kv", "rx", "rv", 3, 8, 80.0)
    return shown(d, ["user_id", "row_idx", "status"], ["value_out"])


CUTS = [0.55, 0.70, 0.84]
REPORT = ["best_score", "second_score", "default_score", "gain", "rank_margin", "consistency"]
BACK_SQL = f"""{EVENTS_SQL}, kc AS (SELECT s.*, c.cut, greatest(8, least(CAST(round_even(n * c.cut, 0) AS BIGINT), n - 5)) AS ap FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM seq WHERE known) s
 CROSS JOIN (SELECT unnest({CUTS}::DOUBLE[]) AS cut) c WHERE n >= 15),
ft AS (SELECT user_id, cut, arg_max(value, row_idx) AS l, avg(value) AS m, regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM kc WHERE row_idx < ap GROUP BY user_id, cut),
pr AS (SELECT user_id, cut, row_idx, value, 'last' AS name, l AS pred FROM kc JOIN ft USING (user_id, cut) WHERE row_idx >= ap UNION ALL SELECT user_id, cut, row_idx, value, 'mean', m FROM kc JOIN ft USING (user_id, cut) WHERE row_idx >= ap
 UNION ALL SELECT user_id, cut, row_idx, value, 'slope', a * x + b FROM kc JOIN ft USING (user_id, cut) WHERE row_idx >= ap),
pc AS (SELECT user_id, cut, name, sqrt(avg(pow(pred - value, 2))) AS err FROM pr GROUP BY ALL),
sc AS (SELECT user_id, name, quantile_cont(err, 0.5) + 0.1 * stddev_pop(err) AS score, row_number() OVER (PARTITION BY user_id ORDER BY quantile_cont(err, 0.5) + 0.1 * stddev_pop(err), name) AS k FROM pc GROUP BY user_id, name),
bs AS (SELECT user_id, CAST(count(*) AS BIGINT) AS candidate_count, max(name) FILTER (k = 1) AS best_name, max(score) FILTER (k = 1) AS best_score, max(score) FILTER (k = 2) AS second_score, max(score) FILTER (name = 'last') AS default_score FROM sc GROUP BY user_id),
cn AS (SELECT user_id, CAST(count(*) AS BIGINT) AS cuts, avg(CASE WHEN b <= d - 0.25 THEN 1.0::DOUBLE ELSE 0 END) AS consistency FROM (SELECT user_id, cut, min(err) AS b, max(err) FILTER (name = 'last') AS d FROM pc GROUP BY user_id, cut) GROUP BY user_id),
rep AS (SELECT *, default_score - best_score AS gain, second_score - best_score AS rank_margin FROM bs JOIN cn USING (user_id))"""


def backtest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cuts = cut_lineage(G.prefix_cuts(event_log(spark, sf), "user_id", "known", CUTS, 15, 8, 5))
    return G.prefix_report(cut_lineage(G.simple_candidates(cuts, ["user_id", "cut"], "x", "value")), "user_id", "last")


@query("d23_prefix_backtest", f"WITH {BACK_SQL} SELECT {sql_shown(['user_id', 'cuts', 'candidate_count', 'best_name'], REPORT)} FROM rep")
def prefix_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return shown(backtest(spark, sf)[0], ["user_id", "cuts", "candidate_count", "best_name"], REPORT)


@query("d23_prefix_backtest_cuts", f"""WITH {BACK_SQL} SELECT user_id, {sql_rounded('cut')} AS cut, arg_min(name, struct_pack(e := err, n := name)) AS best_name, {sql_rounded('min(err)')} AS best_rmse,
 {sql_rounded("max(err) FILTER (name = 'last')")} AS default_rmse FROM pc GROUP BY user_id, cut""")
def prefix_backtest_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return shown(backtest(spark, sf)[1], ["user_id", "best_name"], ["cut", "best_rmse", "default_rmse"])


@query("d24_gated_move", f"""WITH {BACK_SQL}, ev2 AS (SELECT user_id, row_idx, lag(value) OVER (PARTITION BY user_id ORDER BY row_idx) AS base, 50 + 0.1 * value AS cand, known FROM seq),
mv AS (SELECT *, cand - base AS diff, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev2 WHERE NOT known),
st AS (SELECT user_id, sqrt(avg(diff*diff)) AS rms, quantile_cont(abs(diff), 0.95) AS p95 FROM mv GROUP BY user_id),
al AS (SELECT s.user_id, CASE WHEN best_score IS NULL OR best_score > 40 OR gain < 0.25 OR consistency < 0.34 OR p95 > 110 THEN 0 ELSE
 least(greatest((0.12 + 0.32 * least(greatest(gain, 0), 5) / 5 + 0.10 * least(greatest(rank_margin, 0), 3) / 3 + CASE WHEN best_score <= 5 THEN 0.06 ELSE 0 END) * CASE WHEN rms > 42 THEN greatest(0.2, 42 / rms) ELSE 1 END, 0), 0.56) END AS alpha,
 least(45, 14 + 7 * sqrt(greatest(coalesce(gain, 0), 0) + 1e-9)) AS mx FROM st s LEFT JOIN rep USING (user_id))
SELECT user_id, row_idx, {sql_rounded('alpha')} AS alpha, {sql_rounded('base + least(greatest(alpha * (1 - exp(-i / greatest(80.0, 0.12 * n))) * diff, -mx), mx)')} AS moved FROM mv JOIN al USING (user_id)""")
def gated_move(spark: SparkSession, sf: str) -> DataFrame:
    """The aggressive profile; its score limit is 40 here because these values spread over 0..100."""
    rep = cut_lineage(backtest(spark, sf)[0])
    d = framed(event_log(spark, sf), U, 1, 0, lambda w: {"base": F.lag("value").over(w)})
    d = with_group_stats(d, U, {"first": F.min(F.when(~F.col("known"), F.col("row_idx")))}).where(~F.col("known"))
    d = cut_lineage(d.withColumns({"cand": 50 + 0.1 * F.col("value"), "move_idx": F.col("row_idx") - F.col("first")}))
    m = G.gated_move(d, rep, "user_id", "base", "cand", {**G.PROFILES["aggressive"], "max_best": 40.0})
    return shown(m, K, ["alpha", "moved"])


@query("d25_prefix_weighted_ensemble", f"""WITH {FC_SQL}, sc AS (SELECT user_id, method, sqrt(avg(error*error)) AS rmse FROM ok JOIN (SELECT user_id, row_idx, known FROM seq) USING (user_id, row_idx) WHERE known GROUP BY user_id, method),
ww AS (SELECT *, pow(1 / greatest(rmse, 0.25), 2) AS w FROM sc)
SELECT user_id, row_idx, {sql_rounded('sum(w * (error + value)) / sum(w)')} AS weighted_pred FROM ok JOIN (SELECT user_id, row_idx, known, value FROM seq) USING (user_id, row_idx) JOIN ww USING (user_id, method) WHERE NOT known GROUP BY user_id, row_idx""")
def weighted_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    fc = forecasts(spark, sf)
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("pred")) for m in ("lag1", "lag2", "mean3", "flat")]))
    d = fc.select(*K, "known", "value", named.alias("c")).select("*", "c.name", "c.pred").drop("c").where(F.col("pred").isNotNull())
    scores = d.where("known").groupBy("user_id", "name").agg(M.rmse(F.col("pred") - F.col("value")).alias("rmse"))
    return shown(E.inverse_error_ensemble(d.where(~F.col("known")), scores, U, "row_idx"), K, ["weighted_pred"])


@query("d26_prefix_bias_probe", f"""WITH {FC_SQL}, k AS (SELECT *, count(*) FILTER (known) OVER (PARTITION BY user_id) AS nk FROM fc),
b AS (SELECT user_id, avg(mean3 - value) FILTER (known AND row_idx * 4 >= nk * 3) AS pb, avg(mean3 - value) FILTER (NOT known) AS eb, count(*) FILTER (NOT known) AS n FROM k GROUP BY user_id)
SELECT {sql_rounded('kk.k')} AS k, {sql_rounded('any_value(c)')} AS corr, {sql_rounded('sqrt(sum(n * pow(eb - kk.k * pb, 2)) / sum(n))')} AS bias_rms FROM b CROSS JOIN (SELECT corr(pb, eb) AS c FROM b)
CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS k) kk GROUP BY kk.k""")
def bias_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Does the bias on the last quarter of the prefix tell the later bias? Correlation, and a grid of correction shares."""
    d = with_group_stats(forecasts(spark, sf), U, {"nk": F.count_if("known")})
    e, k = F.col("mean3") - F.col("value"), F.col("known")
    hidden = k & (F.col("row_idx") * 4 >= F.col("nk") * 3)
    b = d.groupBy(*U).agg(F.avg(F.when(hidden, e)).alias("pb"), F.avg(F.when(~k, e)).alias("eb"), F.count_if(~k).alias("n"))
    b = cut_lineage(b)
    c = b.agg(A.correlation(F.col("pb"), F.col("eb")).alias("corr"))
    g = b.withColumn("k", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))).groupBy("k").agg(
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("eb") - F.col("k") * F.col("pb"), 2)) / F.sum("n")).alias("bias_rms"))
    return shown(M.one_row(g, c), [], ["k", "corr", "bias_rms"])
