"""Queries over ordered logs: row order, known prefix, projections and window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.functions import columns as C
from bedtrace.operators import sequence as S
from bedtrace.operators.cells import framed, running, position_cells, with_group_stats
from bedtrace.operators.interp import interp_join, offset_profile
from bedtrace.plans.bindings import EVENTS_SQL, PARTS_SQL, event_log, events, part_log
from bedtrace.plans.registry import query, shown, sql_shown

U = ["user_id"]
K = ["user_id", "row_idx"]
W = "PARTITION BY user_id ORDER BY row_idx"


def wc(n: int) -> str:
    h = (n - 1) // 2
    return f"({W} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"


def seq_sql(select: str, tail: str = "FROM seq", extra: str = "") -> str:
    return f"WITH {EVENTS_SQL}{extra} SELECT {select} {tail}"


def stats_sql(inner: str, keys: list[str], values: list[str], digits: int = 6, extra: str = "") -> str:
    return f"WITH {EVENTS_SQL}{extra} SELECT {sql_shown(keys, values, digits)} FROM ({inner})"


# --- row order, known prefix, projections -------------------------------------------------------------------------


@query("s3_row_order", seq_sql("user_id, event_id, row_idx, n_rows"))
def row_order(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).select("user_id", "event_id", "row_idx", "n_rows")


@query("p1_known_eval_split", seq_sql(
    "user_id, CAST(count(*) FILTER (known) AS BIGINT) AS known_rows, CAST(count(*) FILTER (NOT known) AS BIGINT) AS eval_rows",
    "FROM seq GROUP BY user_id"))
def known_eval(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).groupBy("user_id").agg(
        F.count_if("known").alias("known_rows"), F.count_if(~F.col("known")).alias("eval_rows"))


@query("p2_eligible_groups", f"""WITH {EVENTS_SQL}
SELECT user_id, CAST(k AS BIGINT) AS known_rows, CAST(e AS BIGINT) AS eval_rows FROM (
  SELECT user_id, count(*) FILTER (known) AS k, count(*) FILTER (NOT known) AS e FROM seq GROUP BY user_id)
WHERE k >= 20 AND e >= 1""")
def eligible_groups(spark: SparkSession, sf: str) -> DataFrame:
    return S.eligible(event_log(spark, sf), U, "known", 20, 1)


@query("p3_anchor_row", stats_sql(
    f"SELECT user_id, row_idx AS last_row, x AS last_x, value AS last_value FROM seq WHERE known "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) = 1",
    ["user_id", "last_row"], ["last_x", "last_value"]))
def anchor_row(spark: SparkSession, sf: str) -> DataFrame:
    a = S.anchor(event_log(spark, sf), U, "known", ["row_idx", "x", "value"])
    return shown(a.withColumnRenamed("last_row_idx", "last_row"), ["user_id", "last_row"], ["last_x", "last_value"])


ANCHORED = """, anchored AS (
  SELECT s.*, a.x AS last_x, a.value AS last_value FROM seq s JOIN (
    SELECT user_id, x, value FROM seq WHERE known
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) = 1) a USING (user_id))"""


def anchored(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    return log.join(S.anchor(log, U, "known", ["x", "value"]), U)


@query("p4_delta_space", stats_sql(
    "SELECT user_id, row_idx, value - last_value AS value_d, sig - last_value AS sig_d FROM anchored WHERE NOT known",
    K, ["value_d", "sig_d"], extra=ANCHORED))
def delta_space(spark: SparkSession, sf: str) -> DataFrame:
    d = anchored(spark, sf).where(~F.col("known"))
    d = d.withColumns({f"{c}_d": F.col(c) - F.col("last_value") for c in ("value", "sig")})
    return shown(d, K, ["value_d", "sig_d"])


@query("p5_displacement", stats_sql(
    "SELECT user_id, row_idx, x - last_x AS dx, value - last_value AS dy, sqrt((x-last_x)*(x-last_x) + "
    "(value-last_value)*(value-last_value)) AS dxy FROM anchored", K, ["dx", "dy", "dxy"], extra=ANCHORED))
def displacement(spark: SparkSession, sf: str) -> DataFrame:
    d = anchored(spark, sf).withColumns({"dx": F.col("x") - F.col("last_x"), "dy": F.col("value") - F.col("last_value")})
    return shown(d.withColumn("dxy", F.hypot("dx", "dy")), K, ["dx", "dy", "dxy"])


@query("p6_position_fractions", stats_sql(
    f"SELECT user_id, row_idx, f AS frac, f*f AS frac2, sqrt(f) AS frac_root FROM (SELECT *, CAST(row_number() OVER ({W}) "
    f"AS DOUBLE) / count(*) OVER (PARTITION BY user_id) AS f FROM seq WHERE NOT known)", K, ["frac", "frac2", "frac_root"]))
def fractions(spark: SparkSession, sf: str) -> DataFrame:
    log = with_group_stats(event_log(spark, sf), U, {"known_len": F.count_if("known")}).where(~F.col("known"))
    f = (F.col("row_idx") - F.col("known_len") + 1) / (F.col("n_rows") - F.col("known_len"))
    return shown(log.withColumns({"frac": f, "frac2": f * f, "frac_root": F.sqrt(f)}), K, ["frac", "frac2", "frac_root"])


@query("p7_ratios", stats_sql(
    "SELECT user_id, row_idx, (x - last_x) / (span + 1.0) AS extrap_ratio, s * (x - last_x) AS unc_x_dist, "
    "s * (row_idx + 1) / n_rows AS unc_x_frac FROM (SELECT *, max(x) FILTER (known) OVER (PARTITION BY user_id) - "
    "min(x) FILTER (known) OVER (PARTITION BY user_id) AS span, stddev_pop(value) FILTER (known) OVER (PARTITION BY user_id) AS s "
    "FROM anchored)", K, ["extrap_ratio", "unc_x_dist", "unc_x_frac"], extra=ANCHORED))
def ratios(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("known")
    log = event_log(spark, sf)
    traits = log.where(k).groupBy(*U).agg(
        F.max_by("x", "row_idx").alias("last_x"), (F.max("x") - F.min("x")).alias("span"), F.stddev_pop("value").alias("s"))
    d = log.join(traits, U)
    md = F.col("x") - F.col("last_x")
    d = d.withColumns({"extrap_ratio": md / (F.col("span") + 1.0), "unc_x_dist": F.col("s") * md,
                       "unc_x_frac": F.col("s") * (F.col("row_idx") + 1) / F.col("n_rows")})
    return shown(d, K, ["extrap_ratio", "unc_x_dist", "unc_x_frac"])


@query("p8_heading_inclination", stats_sql(
    f"SELECT user_id, row_idx, dx / h AS head_sin, dy / h AS head_cos, dz / h AS incl FROM (SELECT *, sqrt(dx*dx + dy*dy) + 1e-6 AS h "
    f"FROM (SELECT user_id, row_idx, x - lag(x) OVER ({W}) AS dx, value - lag(value) OVER ({W}) AS dy, "
    f"sig - lag(sig) OVER ({W}) AS dz FROM seq))", K, ["head_sin", "head_cos", "incl"]))
def heading(spark: SparkSession, sf: str) -> DataFrame:
    d = framed(event_log(spark, sf), U, 1, 0, lambda w: {
        "dx": F.col("x") - F.lag("x").over(w), "dy": F.col("value") - F.lag("value").over(w),
        "dz": F.col("sig") - F.lag("sig").over(w)})
    h = F.hypot("dx", "dy") + 1e-6
    d = d.withColumns({"head_sin": F.col("dx") / h, "head_cos": F.col("dy") / h, "incl": F.col("dz") / h})
    return shown(d, K, ["head_sin", "head_cos", "incl"])


@query("p9_clip", stats_sql(
    "SELECT user_id, row_idx, CASE WHEN sig IS NOT NULL THEN least(greatest(sig - last_value, -20), 20) END AS clipped FROM anchored",
    K, ["clipped"], extra=ANCHORED))
def clip_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = anchored(spark, sf)
    return shown(d.withColumn("clipped", C.clip(F.col("sig") - F.col("last_value"), -20, 20)), K, ["clipped"])


@query("p10_finite_or_zero", stats_sql(
    f"SELECT user_id, row_idx, coalesce(sig, 0) AS sig_z, CASE WHEN lag(x) OVER ({W}) IS NULL THEN 0 ELSE ln(1 + x - lag(x) OVER ({W})) END AS step_z FROM seq",
    K, ["sig_z", "step_z"]))
def finite(spark: SparkSession, sf: str) -> DataFrame:
    d = framed(event_log(spark, sf), U, 1, 0, lambda w: {"step": F.log1p(F.col("x") - F.lag("x").over(w))})
    return shown(d.withColumns({"sig_z": C.finite_or(F.col("sig")), "step_z": C.finite_or(F.col("step"))}), K, ["sig_z", "step_z"])


@query("p11_known_zone_znorm", stats_sql(
    "SELECT user_id, row_idx, (sig - m) / (s + 1e-3) AS z FROM (SELECT *, avg(sig) FILTER (known) OVER (PARTITION BY user_id) AS m, "
    "stddev_pop(sig) FILTER (known) OVER (PARTITION BY user_id) AS s FROM seq)", K, ["z"]))
def znorm(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.known_zone_scale(event_log(spark, sf), U, "sig", "known", "z"), K, ["z"])


@query("p12_standardise", stats_sql(
    "SELECT e.user_id, e.row_idx, CASE WHEN sig IS NOT NULL THEN least(greatest((sig - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END, -8), 8) END AS z "
    "FROM seq e CROSS JOIN (SELECT avg(sig) AS m, stddev_pop(sig) AS s FROM seq WHERE known)", K, ["z"]))
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    one_row = log.where("known").agg(F.avg("sig").alias("m"), F.stddev_pop("sig").alias("s"))
    d = log.crossJoin(F.broadcast(one_row))  # a single row of statistics
    z = (F.col("sig") - F.col("m")) / F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s"))
    return shown(d.withColumn("z", C.clip(z, -8, 8)), K, ["z"])


PANEL = ["l_quantity", "l_discount", "l_tax", "t4"]


@query("p13_panel_stats", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice/1000 AS t4, l_quantity, l_discount, l_tax FROM lineitem),
u AS (SELECT l_orderkey, l_linenumber, list_sort([l_quantity, l_discount, l_tax, t4]) AS s FROM t),
v AS (SELECT l_orderkey, l_linenumber, list_avg(s) AS panel_mean, list_stddev_pop(s) AS panel_std,
 0.5*s[2] + 0.5*s[3] AS panel_median, (s[3] + 0.25*(s[4]-s[3])) - (s[1] + 0.75*(s[2]-s[1])) AS panel_iqr, s[4]-s[1] AS panel_range FROM u)
SELECT {sql_shown(['l_orderkey', 'l_linenumber'], ['panel_mean', 'panel_std', 'panel_median', 'panel_iqr', 'panel_range'])} FROM v""")
def panel(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("t4", F.col("l_extendedprice") / 1000)
    stats = C.panel_stats(PANEL, "panel")
    return shown(li.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in stats.items()]), ["l_orderkey", "l_linenumber"], list(stats))


@query("p15_tracker_differences", f"""WITH {PARTS_SQL}
SELECT {sql_shown(['well', 'row_idx'], ['pxq', 'span', 'pxd'])} FROM (SELECT well, row_idx, price/1000 - qty AS pxq,
 greatest(price/1000, qty, disc*100) - least(price/1000, qty, disc*100) AS span, price/1000 - disc*100 AS pxd FROM plog)""")
def tracker_differences(spark: SparkSession, sf: str) -> DataFrame:
    p, q, d = F.col("price") / 1000, F.col("qty"), F.col("disc") * 100
    out = part_log(spark, sf).withColumns({"pxq": p - q, "span": F.greatest(p, q, d) - F.least(p, q, d), "pxd": p - d})
    return shown(out, ["well", "row_idx"], ["pxq", "span", "pxd"])


@query("p16_group_sample", """SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(concat(user_id, '_7')), user_id LIMIT 40""")
def group_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded sample of 40 groups; the draw is a hash order, so it is the same on every run."""
    groups = events(spark, sf).select("user_id").distinct()
    return groups.withColumn("h", F.md5(F.concat_ws("_", "user_id", F.lit(7)))).orderBy("h", "user_id").limit(40).select("user_id")


# --- window features ---------------------------------------------------------------------------------------------

W1 = [5, 21, 51, 101, 201]
W1_OUT = [f"sig_mean{n}" for n in W1]


@query("w1_rolling_mean", stats_sql(
    "SELECT user_id, row_idx, " + ", ".join(f"avg(sig) OVER {wc(n)} AS sig_mean{n}" for n in W1) + " FROM seq", K, W1_OUT))
def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.rolling(event_log(spark, sf), U, "sig", W1, ["mean"], "sig"), K, W1_OUT)


W2_OUT = [f"sig_std{n}" for n in W1]


@query("w2_rolling_std", stats_sql(
    "SELECT user_id, row_idx, " + ", ".join(
        f"CASE WHEN count(sig) OVER {wc(n)} > 1 THEN stddev_samp(sig) OVER {wc(n)} ELSE 0 END AS sig_std{n}" for n in W1) + " FROM seq",
    K, W2_OUT))
def rolling_std(spark: SparkSession, sf: str) -> DataFrame:
    d = S.rolling(event_log(spark, sf), U, "sig", W1, ["std"], "sig")
    return shown(d.fillna(0.0, W2_OUT), K, W2_OUT)


@query("w3_rolling_max_energy", stats_sql(
    f"SELECT user_id, row_idx, max(sig) OVER {wc(21)} AS sig_max21, sqrt(avg(sig*sig) OVER {wc(21)}) AS energy21 FROM seq",
    K, ["sig_max21", "energy21"]))
def rolling_energy(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf).withColumn("sq", F.col("sig") * F.col("sig"))
    d = framed(log, U, 10, 10, lambda w: {
        "sig_max21": F.max("sig").over(w.rowsBetween(-10, 10)), "energy21": F.sqrt(F.avg("sq").over(w.rowsBetween(-10, 10)))})
    return shown(d, K, ["sig_max21", "energy21"])


STEPS = [1, 5, 15, 30]
W4_OUT = [f"v_lag{s}" for s in STEPS] + [f"v_lead{s}" for s in STEPS]


@query("w4_lag_lead_filled", stats_sql(
    "SELECT user_id, row_idx, " + ", ".join(
        [f"coalesce(lag(value,{s}) OVER ({W}), first_value(value) OVER ({W})) AS v_lag{s}" for s in STEPS]
        + [f"coalesce(lead(value,{s}) OVER ({W}), last_value(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v_lead{s}" for s in STEPS])
    + " FROM seq", K, W4_OUT))
def lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.lags(event_log(spark, sf), U, "value", STEPS, "v"), K, W4_OUT)


@query("w5_differences", stats_sql(
    f"SELECT user_id, row_idx, d1 AS v_d1, coalesce(d1 - lag(d1) OVER ({W}), 0) AS v_d2 FROM "
    f"(SELECT *, coalesce(value - lag(value) OVER ({W}), 0) AS d1 FROM seq)", K, ["v_d1", "v_d2"]))
def diffs(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.differences(event_log(spark, sf), U, "value", "v"), K, ["v_d1", "v_d2"])


@query("w6_derivative_per_axis", stats_sql(
    f"SELECT user_id, row_idx, (value - lag(value) OVER ({W})) / nullif(x - lag(x) OVER ({W}), 0) AS d_value, "
    f"(sig - lag(sig) OVER ({W})) / nullif(x - lag(x) OVER ({W}), 0) AS d_sig FROM seq", K, ["d_value", "d_sig"], 4))
def derivative(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.slope_per_axis(event_log(spark, sf), U, ["value", "sig"], "x"), K, ["d_value", "d_sig"], 4)


@query("w7_gradient", stats_sql(
    f"""SELECT user_id, row_idx,
 CASE WHEN p IS NULL THEN n - value WHEN n IS NULL THEN value - p ELSE (n - p) / 2 END AS g_even,
 CASE WHEN p IS NULL THEN (n - value) / hn WHEN n IS NULL THEN (value - p) / hp
      ELSE (hn * (value - p) / hp + hp * (n - value) / hn) / (hp + hn) END AS g_uneven
FROM (SELECT *, lag(value) OVER ({W}) AS p, lead(value) OVER ({W}) AS n, x - lag(x) OVER ({W}) AS hp, lead(x) OVER ({W}) - x AS hn FROM seq)""",
    K, ["g_even", "g_uneven"], 4))
def gradients(spark: SparkSession, sf: str) -> DataFrame:
    d = S.gradient(event_log(spark, sf), U, "value", "g_even")
    return shown(S.gradient(d, U, "value", "g_uneven", "x"), K, ["g_even", "g_uneven"], 4)


@query("w8_expanding_mean", stats_sql(
    f"SELECT user_id, row_idx, avg(sig) OVER ({W} ROWS UNBOUNDED PRECEDING) AS m FROM seq", K, ["m"]))
def expanding_mean(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.expanding(event_log(spark, sf), U, "sig", "m"), K, ["m"])


FILL_SQL = f""", filled AS (
 SELECT *, coalesce(CASE WHEN qx = px THEN py ELSE py + (qy - py) * (row_idx - px) / (qx - px) END, py, qy, 0) AS fill FROM (
  SELECT *, last_value(sig IGNORE NULLS) OVER b AS py, last_value(pos IGNORE NULLS) OVER b AS px,
   first_value(sig IGNORE NULLS) OVER a AS qy, first_value(pos IGNORE NULLS) OVER a AS qx
  FROM (SELECT *, CASE WHEN sig IS NOT NULL THEN CAST(row_idx AS DOUBLE) END AS pos FROM seq)
  WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


def filled_log(spark: SparkSession, sf: str) -> DataFrame:
    return S.gap_fill(event_log(spark, sf), U, "sig", "fill", 0.0)


@query("w9_gap_fill", stats_sql("SELECT user_id, row_idx, fill FROM filled", K, ["fill"], extra=FILL_SQL))
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return shown(filled_log(spark, sf), K, ["fill"])


@query("w10_missing_density", stats_sql(
    f"SELECT user_id, row_idx, f AS sig_flag, avg(f) OVER {wc(21)} AS sig_mean21, avg(f) OVER {wc(101)} AS sig_mean101 FROM "
    "(SELECT *, CASE WHEN sig IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f FROM seq)", K, ["sig_flag", "sig_mean21", "sig_mean101"]))
def missing(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.missing_density(event_log(spark, sf), U, "sig", [21, 101], "sig"), K, ["sig_flag", "sig_mean21", "sig_mean101"])


@query("w11_rolling_zscore", stats_sql(
    f"SELECT user_id, row_idx, CASE WHEN n >= 20 AND s > 1e-12 AND sig IS NOT NULL THEN least(greatest((sig - m) / s, -8), 8) END AS z FROM "
    f"(SELECT *, count(sig) OVER {wc(101)} AS n, avg(sig) OVER {wc(101)} AS m, stddev_samp(sig) OVER {wc(101)} AS s FROM seq)", K, ["z"]))
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.rolling_zscore(event_log(spark, sf), U, "sig", 101, 20, 8.0, "z"), K, ["z"])


@query("w12_group_mean_on_rows", stats_sql(
    "SELECT user_id, row_idx, avg(sig) OVER (PARTITION BY user_id) AS m, sig - avg(sig) OVER (PARTITION BY user_id) AS d FROM seq", K, ["m", "d"]))
def group_mean(spark: SparkSession, sf: str) -> DataFrame:
    d = with_group_stats(event_log(spark, sf), U, {"m": F.avg("sig")})
    return shown(d.withColumn("d", F.col("sig") - F.col("m")), K, ["m", "d"])


@query("w13_tail_rows", f"""WITH {EVENTS_SQL} SELECT user_id, row_idx FROM seq
WHERE n_rows - row_idx <= greatest(12, floor(CAST(0.4 AS DOUBLE) * n_rows))""")
def tail(spark: SparkSession, sf: str) -> DataFrame:
    return S.tail_rows(event_log(spark, sf), U, F.greatest(F.lit(12.0), 0.4 * F.col("group_rows"))).select(*K)


def _smoothing_sql() -> str:
    """Every row against the 17 rows of its window (the first or last full window near the ends), with the weights of its place."""
    weights = S.smoothing_weights(17, 3)[17]
    rows = ", ".join(f"({p}, {i}, {w!r}::DOUBLE)" for p, row in enumerate(weights) for i, w in enumerate(row))
    return f"""SELECT s.user_id, s.row_idx, sum(h.w * o.value) AS sm
 FROM (SELECT *, least(greatest(row_idx - 8, 0), n_rows - 17) AS first FROM seq) s
 JOIN seq o ON o.user_id = s.user_id AND o.row_idx BETWEEN s.first AND s.first + 16
 JOIN (VALUES {rows}) h(place, i, w) ON h.place = s.row_idx - s.first AND h.i = o.row_idx - s.first
 GROUP BY s.user_id, s.row_idx"""


@query("w14_local_poly_smooth", stats_sql(_smoothing_sql(), K, ["sm"]))
def local_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return shown(S.smooth_poly(event_log(spark, sf), U, "value", 17, 3, "sm"), K, ["sm"])


@query("w17_running_sse_curve", stats_sql(
    "SELECT user_id, row_idx, sum(e) OVER (PARTITION BY user_id ORDER BY row_idx) AS sse, sum(e) OVER (PARTITION BY user_id ORDER BY row_idx) / "
    f"sum(e) OVER (PARTITION BY user_id) AS share FROM (SELECT *, coalesce(pow(value - lag(value) OVER ({W}), 2), 0) AS e FROM seq)",
    K, ["sse", "share"], 5))
def running_sse(spark: SparkSession, sf: str) -> DataFrame:
    d = framed(event_log(spark, sf), U, 1, 0, lambda w: {"e": F.coalesce(F.pow(F.col("value") - F.lag("value").over(w), 2), F.lit(0.0))})
    d = running(position_cells(d), U, ["row_idx"], {"sse": F.col("e")})
    d = with_group_stats(d, U, {"total": F.sum("e")}).withColumn("share", F.try_divide("sse", "total"))
    return shown(d, K, ["sse", "share"], 5)


@query("w18_ramp", stats_sql(
    "SELECT user_id, row_idx, 1 - exp(-CAST(row_idx AS DOUBLE) / greatest(80.0, 0.12 * n_rows)) AS ramp FROM seq", K, ["ramp"]))
def ramp(spark: SparkSession, sf: str) -> DataFrame:
    r = 1 - F.exp(-F.col("row_idx") / F.greatest(F.lit(80.0), 0.12 * F.col("n_rows")))
    return shown(event_log(spark, sf).withColumn("ramp", r), K, ["ramp"])
