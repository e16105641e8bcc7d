"""The assembled feature table, and models on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.operators.features import feature_table
from bedtrace.plans.bindings import EVENTS_SQL, event_log
from bedtrace.plans.q_interp import KNOTS, at_sql, bracket_sql, curve_of
from bedtrace.plans.q_sequence import FILL_SQL, STEPS, W, W1, wc
from bedtrace.plans.registry import query, shown, sql_shown

K = ["user_id", "row_idx"]
FEATURES = [
    *[f"s_{f}{n}" for n in W1 for f in ("mean", "std")], "s_max21", "s_energy21", "s_missing21", "s_missing101", "s_z", "s_group_mean", "s_from_mean", "s_running", "s_filled",
    *[f"v_{f}{t}" for t in STEPS for f in ("lag", "lead")], "v_d1", "v_d2", "frac", "past_known", "known_mean", "known_std", "known_slope", "curve", "from_curve",
]


def _features_sql() -> str:
    whole = "PARTITION BY user_id"
    flag = "CASE WHEN sig IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    cols = [f"avg(sig) OVER {wc(n)} AS s_mean{n}, coalesce(CASE WHEN count(sig) OVER {wc(n)} > 1 THEN stddev_samp(sig) OVER {wc(n)} END, 0) AS s_std{n}" for n in W1]
    cols += [f"max(sig) OVER {wc(21)} AS s_max21, sqrt(avg(sig * sig) OVER {wc(21)}) AS s_energy21, avg({flag}) OVER {wc(21)} AS s_missing21, avg({flag}) OVER {wc(101)} AS s_missing101"]
    cols += [f"count(sig) OVER {wc(101)} AS zn, avg(sig) OVER {wc(101)} AS zm, CASE WHEN count(sig) OVER {wc(101)} > 1 THEN stddev_samp(sig) OVER {wc(101)} END AS zs"]
    cols += [f"coalesce(lag(value, {t}) OVER ({W}), first_value(value) OVER ({W})) AS v_lag{t}, coalesce(lead(value, {t}) OVER ({W}), last_value(value) OVER "
             f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v_lead{t}" for t in STEPS]
    cols += [f"coalesce(value - lag(value) OVER ({W}), 0) AS v_d1, avg(sig) OVER ({W} ROWS UNBOUNDED PRECEDING) AS s_running, fill AS s_filled"]
    cols += [f"avg(sig) OVER ({whole}) AS s_group_mean, count(*) FILTER (known) OVER ({whole}) AS kl, max(x) FILTER (known) OVER ({whole}) AS kx_"]
    return f"""WITH {EVENTS_SQL}{FILL_SQL}, {KNOTS}, f AS (SELECT *, {', '.join(cols)} FROM filled),
kn AS (SELECT user_id, avg(value) AS known_mean, stddev_pop(value) AS known_std, regr_slope(value, x) AS known_slope FROM seq WHERE known GROUP BY user_id),
cu AS (SELECT user_id, event_id, {at_sql()} AS curve FROM ({bracket_sql('seq')})),
t AS (SELECT f.*, known_mean, known_std, known_slope, curve, value - curve AS from_curve, coalesce(v_d1 - lag(v_d1) OVER ({W.replace('user_id', 'f.user_id')}), 0) AS v_d2,
 CASE WHEN zn >= 20 AND zs > 1e-12 AND sig IS NOT NULL THEN least(greatest((sig - zm) / zs, -8), 8) END AS s_z, sig - s_group_mean AS s_from_mean,
 CASE WHEN NOT known THEN (row_idx - kl + 1) / CAST(n_rows - kl AS DOUBLE) END AS frac, x - kx_ AS past_known
 FROM f JOIN kn USING (user_id) JOIN cu USING (user_id, event_id))
SELECT {sql_shown(K, FEATURES)} FROM t"""


@query("f1_feature_table", _features_sql())
def features(spark: SparkSession, sf: str) -> DataFrame:
    """All window, prefix and curve features of every row in one table."""
    return shown(feature_table(event_log(spark, sf), ["user_id"], "x", "value", "sig", "known", curve_of(spark, sf)), K, FEATURES)


@query("f2_features_to_scores", None)
def features_to_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Features, out-of-fold trees on the withheld rows, and the error per fold against the known mean and the curve.

    All withheld rows count in ``n``; the error of the curve is over the rows that have one."""
    from bedtrace.operators.metrics import rmse
    from bedtrace.operators.models import group_folds, oof_trees
    from bedtrace.session import cut_lineage

    log = cut_lineage(event_log(spark, sf))
    d = feature_table(log, ["user_id"], "x", "value", "sig", "known", curve_of(spark, sf)).where(~F.col("known"))
    # only what is known without the row's own value
    inputs = ["s_mean201", "s_missing101", "frac", "past_known", "known_mean", "known_std", "known_slope", "curve"]
    d = d.select("user_id", "value", *inputs).join(group_folds(log, "user_id", 5), "user_id")  # other features are never computed
    t, _ = oof_trees(d, inputs, "value", "user_id", "fold", 5, {"maxIter": 8, "maxDepth": 3}, anchor="known_mean")
    e = lambda c: rmse(F.col(c) - F.col("value"))
    return shown(t.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), e("oof").alias("trees"), e("known_mean").alias("flat"), e("curve").alias("reference")), ["fold", "n"], ["trees", "flat", "reference"], 4)
