"""Queries for scans and contracts, joins of feature tables, folds, stacks, samples, alignment and diagnostics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.functions.columns import row_id, split_row_id
from bedtrace.operators import align as L
from bedtrace.operators import calibrate as A
from bedtrace.operators import decode as Dc
from bedtrace.operators import metrics as M
from bedtrace.operators import models as D
from bedtrace.operators import samples as P
from bedtrace.operators import sequence as S
from bedtrace.operators.cells import framed, index_rows, with_group_stats
from bedtrace.operators.interp import interp_join, offset_profile, regrid
from bedtrace.operators.quantiles import grouped_quantiles
from bedtrace.operators.spatial import idw_columns, knn_join
from bedtrace.plans.bindings import BANK_SQL, EVENTS_SQL, PARTS_SQL, bank, event_log, events, part_log, table
from bedtrace.plans.q_ensemble import MEMBERS, members
from bedtrace.plans.q_interp import GRID, KNOTS, OFFSETS, curve_of, profile
from bedtrace.plans.q_metrics import FC_SQL, forecasts, lag1_rmse
from bedtrace.plans.q_sequence import FILL_SQL, filled_log
from bedtrace.plans.registry import query, rounded, shown, sql_rounded, sql_shown
from bedtrace.plans.sql_ridge import sql_moments, sql_prediction, sql_solved, sql_subsets
from bedtrace.session import cut_lineage
from bedtrace.sources import logs, store

U = ["user_id"]
K = ["user_id", "row_idx"]
WELL = ["well"]

# --- scans, contracts, sinks ------------------------------------------------------------------------------------------


@query("s2_curve_fill_by_mean", f"""WITH {EVENTS_SQL} SELECT user_id, event_id, {sql_rounded('coalesce(sig, avg(sig) OVER (PARTITION BY user_id))')} AS sig FROM ev""")
def fill_by_mean(spark: SparkSession, sf: str) -> DataFrame:
    return shown(logs.fill_curve(events(spark, sf), "user_id", "x", "sig"), ["user_id", "event_id"], ["sig"])


@query("s2_curve_fill_nearest", f"""WITH {EVENTS_SQL} SELECT user_id, event_id, {sql_rounded('coalesce(sig, last_value(sig IGNORE NULLS) OVER b, first_value(sig IGNORE NULLS) OVER a)')} AS sig FROM ev
WINDOW b AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return shown(logs.fill_curve(events(spark, sf), "user_id", "x", "sig", "nearest"), ["user_id", "event_id"], ["sig"])


@query("s4_projected_scan", "SELECT doc_id, n_chars FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL")
def projected_scan(spark: SparkSession, sf: str) -> DataFrame:
    return logs.projected(table(spark, sf, "documents"), ["doc_id", "n_chars"])


@query("s5_predicate_scan", "SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def predicate_scan(spark: SparkSession, sf: str) -> DataFrame:
    return logs.rows_of(spark, f"{sf}/customer.parquet", ["BUILDING", "MACHINERY"], ["c_custkey", "c_nationkey"], "c_mktsegment")


@query("s6_feature_upgrade", "SELECT c_custkey, c_nationkey, CAST(n AS BIGINT) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def feature_upgrade(spark: SparkSession, sf: str) -> DataFrame:
    """Old feature table plus newly built columns, checked for coverage."""
    old = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return store.upgrade_features(old, new, "c_custkey", 0.5).select("c_custkey", "c_nationkey", "n_orders")


@query("s7_coverage", f"SELECT 'quality' AS column, {sql_rounded('avg(CASE WHEN quality IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)')} AS share FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', {sql_rounded('avg(CASE WHEN toxic IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)')} FROM documents LEFT JOIN labels USING (doc_id)")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return shown(store.coverage(d, ["quality", "toxic"]), ["column"], ["share"])


@query("s8_float32", "SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price32 FROM orders")
def float32(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("float").cast("double").alias("price32"))


@query("s9_prediction_sink", f"SELECT d.doc_id, {sql_rounded('coalesce(quality, -1)')} AS pred FROM documents d LEFT JOIN labels USING (doc_id)")
def prediction_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Every sample row in sample order, with the fallback where no prediction exists."""
    sample = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("sample_pos"))
    pred = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("pred"))
    d = store.predictions_in_order(pred, sample, "doc_id", "pred", -1.0, "sample_pos")
    return shown(d.orderBy("sample_pos"), ["doc_id"], ["pred"])


@query("s11_frame_contract", "SELECT CAST(count(*) FILTER (CASE WHEN event_type = 'error' THEN NULL ELSE value END IS NULL) AS BIGINT) AS bad, CAST(count(*) AS BIGINT) AS rows FROM events")
def frame_contract(spark: SparkSession, sf: str) -> DataFrame:
    return store.bad_values(events(spark, sf), ["sig"])


@query("s12_output_audit", f"""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS expected, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS out_of_place, {sql_rounded('min(o_totalprice)', 2)} AS min, {sql_rounded('max(o_totalprice)', 2)} AS max,
 {sql_rounded('avg(o_totalprice)', 4)} AS mean, {sql_rounded('stddev_pop(o_totalprice)', 4)} AS std FROM orders""")
def output_audit(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").cast("double").alias("axis"))
    sample = store.with_position(o, ["o_orderkey"], "axis")
    a = store.audit_output(sample, sample.select("o_orderkey", "sample_pos"), "o_orderkey", "o_totalprice", "sample_pos")
    return a.select("rows", "expected", "not_finite", "out_of_place", rounded(F.col("min"), 2).alias("min"), rounded(F.col("max"), 2).alias("max"),
                    rounded(F.col("mean"), 4).alias("mean"), rounded(F.col("std"), 4).alias("std"))


@query("p14_column_sets", f"SELECT {sql_shown(['l_orderkey', 'l_linenumber'], ['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax'])} FROM lineitem")
def column_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Measure columns by pattern: keys, flags and dates are dropped before the scan."""
    li = table(spark, sf, "lineitem")
    cols = D.keep_columns(li, keep="^l_", drop="(key|flag|status|date|number)$")
    return shown(li, ["l_orderkey", "l_linenumber"], sorted(cols))


@query("row_identity", f"""WITH {EVENTS_SQL} SELECT concat(user_id, '_', row_idx) AS id, CAST(user_id AS VARCHAR) AS well, row_idx AS pos FROM seq""")
def row_identity(spark: SparkSession, sf: str) -> DataFrame:
    d = event_log(spark, sf).select(row_id("user_id", "row_idx").alias("id"))
    well, pos = split_row_id(F.col("id"))
    return d.select("id", well.alias("well"), pos.alias("pos"))


# --- joins of feature tables ------------------------------------------------------------------------------------------


@query("j1_feature_left_join", "SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def feature_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")


@query("j2_checked_inner_join", "SELECT CAST(count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS BIGINT) AS both, CAST(count(*) FILTER (l.doc_id IS NULL) AS BIGINT) AS only_left, CAST(count(*) FILTER (d.doc_id IS NULL) AS BIGINT) AS only_right FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def checked_join(spark: SparkSession, sf: str) -> DataFrame:
    return store.key_overlap(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("j3_group_table_join", f"SELECT o_orderkey, c_mktsegment, {sql_rounded('o_totalprice / (1 + abs(c_acctbal))')} AS ratio FROM orders JOIN customer ON o_custkey = c_custkey")
def group_table_join(spark: SparkSession, sf: str) -> DataFrame:
    """Group traits on rows. No broadcast hint: the planner broadcasts the trait table while it is small and joins by
    shuffle beyond."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    d = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(c, "o_custkey")
    return shown(d.withColumn("ratio", F.col("o_totalprice") / (1 + F.abs("c_acctbal"))), ["o_orderkey", "c_mktsegment"], ["ratio"])


@query("j15_membership_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    users = events(spark, sf).select(F.col("user_id").alias("o_custkey")).distinct()
    big = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(users, "o_custkey", "left_semi").join(big, "o_orderkey", "left_anti").select("o_orderkey")


# --- folds and stacks -------------------------------------------------------------------------------------------------

FOLD_SQL = """fo AS (SELECT user_id, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM
 (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS r FROM events GROUP BY user_id))"""


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return D.group_folds(events(spark, sf), "user_id", 5)


@query("d32_group_folds", f"WITH {FOLD_SQL} SELECT user_id, fold FROM fo")
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return folds(spark, sf)


def sql_hash_fold(text: str, k: int) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 8))::BIGINT % {k} AS INTEGER)"


@query("d32_spatial_folds", f"""WITH {BANK_SQL} SELECT owner, {sql_hash_fold("CAST(cx AS BIGINT) || ',' || CAST(cy AS BIGINT)", 5)} AS fold FROM
 (SELECT owner, floor(avg(px) / 0.05) AS cx, floor(avg(py) / 0.05) AS cy FROM bank GROUP BY owner)""")
def spatial_folds(spark: SparkSession, sf: str) -> DataFrame:
    return D.spatial_folds(bank(spark, sf), "owner", "px", "py", 0.05, 5)


STACK = ["lag1", "lag2", "mean3", "flat2"]


def stack_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = framed(event_log(spark, sf), U, 6, 0, lambda w: {
        "lag1": F.lag("value", 1).over(w), "lag2": F.lag("value", 2).over(w), "mean3": F.avg("value").over(w.rowsBetween(-3, -1)),
        "flat2": F.avg("value").over(w.rowsBetween(-6, -4))})
    return d.na.drop(subset=STACK).join(folds(spark, sf), "user_id")


STACK_SQL = f"""{EVENTS_SQL}, {FOLD_SQL}, st AS (SELECT s.*, fold, lag(value) OVER w AS lag1, lag(value, 2) OVER w AS lag2, avg(value) OVER (PARTITION BY s.user_id ORDER BY row_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3,
 avg(value) OVER (PARTITION BY s.user_id ORDER BY row_idx ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING) AS flat2 FROM seq s JOIN fo ON s.user_id = fo.user_id WINDOW w AS (PARTITION BY s.user_id ORDER BY row_idx)),
sr AS (SELECT * FROM st WHERE flat2 IS NOT NULL), fs AS (SELECT unnest(generate_series(0, 4)) AS f)"""
TRAIN = "sr JOIN fs ON fold <> f"
STACK_MOMENTS = f"{STACK_SQL}, {sql_moments(STACK, 'value', TRAIN)}"


@query("d34_positive_ridge_stack", f"""WITH {STACK_MOMENTS}, {sql_subsets(4, [1.66])}, best AS (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY f ORDER BY gain DESC) = 1)
SELECT user_id, row_idx, fold, {sql_rounded(sql_prediction(STACK))} AS stack FROM sr JOIN best ON fold = f JOIN mo USING (f)""")
def ridge_stack(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold stack of four members, alpha 1.66, coefficients >= 0."""
    return shown(D.oof_ridge(stack_rows(spark, sf), STACK, "value", "fold"), [*K, "fold"], ["stack"])


@query("d34_single_member_ridge", f"""WITH {STACK_SQL}, co AS (SELECT f, greatest(0, covar_pop(value, mean3) * count(*) / (var_pop(mean3) * count(*) + 1.66)) AS a, avg(value) AS my, avg(mean3) AS mx FROM sr JOIN fs ON fold <> f GROUP BY f)
SELECT user_id, row_idx, fold, {sql_rounded('my + a * (mean3 - mx)')} AS stack FROM sr JOIN co ON fold = f""")
def single_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """One member: the case with a closed form in SQL."""
    return shown(D.oof_ridge(stack_rows(spark, sf), ["mean3"], "value", "fold"), [*K, "fold"], ["stack"])


@query("d35_tiered_stack", f"""WITH {STACK_SQL}, ti AS (SELECT *, (row_idx >= 30)::INT AS tier FROM sr), co AS (SELECT f, tier, greatest(0, covar_pop(value, mean3) * count(*) / (var_pop(mean3) * count(*) + 1.66)) AS a, avg(value) AS my, avg(mean3) AS mx FROM ti JOIN fs ON fold <> f GROUP BY f, tier)
SELECT user_id, row_idx, fold, {sql_rounded('my + a * (mean3 - mx)')} AS stack FROM ti JOIN co ON fold = f AND ti.tier = co.tier""")
def tiered_stack(spark: SparkSession, sf: str) -> DataFrame:
    d = stack_rows(spark, sf).withColumn("tier", F.when(F.col("row_idx") >= 30, 1).otherwise(0))
    return shown(D.oof_ridge(d, ["mean3"], "value", "fold", ["tier"]), [*K, "fold"], ["stack"])


CROSSED = [*STACK, *[f"{c}_x" for c in STACK]]
CROSSED_SQL = f"""{STACK_SQL}, rk AS (SELECT *, (abs(lag1 - lag2) - avg(abs(lag1 - lag2)) OVER ()) / (stddev_pop(abs(lag1 - lag2)) OVER () + 1e-9) AS rz FROM sr),
cr AS (SELECT *, {', '.join(f'{c} * rz AS {c}_x' for c in STACK)} FROM rk), {sql_moments(CROSSED, 'value', 'cr JOIN fs ON fold <> f')}, {', '.join(sql_solved(range(8), 8, [1.66]))}"""


@query("d35_risk_interactions", f"""WITH {CROSSED_SQL} SELECT user_id, row_idx, fold, {sql_rounded(sql_prediction(CROSSED))} AS stack FROM cr JOIN s ON fold = f JOIN mo USING (f)""")
def risk_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """One unconstrained ridge with members and members times standardised risk."""
    d = stack_rows(spark, sf).withColumn("risk", F.abs(F.col("lag1") - F.col("lag2")))
    one = d.agg(F.avg("risk").alias("m"), F.stddev_pop("risk").alias("s"))
    d = d.crossJoin(F.broadcast(one)).withColumn("rz", (F.col("risk") - F.col("m")) / (F.col("s") + 1e-9))  # one row of statistics
    d = d.withColumns({f"{c}_x": F.col(c) * F.col("rz") for c in STACK})
    return shown(D.oof_ridge(d, [*STACK, *[f"{c}_x" for c in STACK]], "value", "fold", positive=False), [*K, "fold"], ["stack"])


QUARTERS_SQL = f"""{STACK_SQL}, rn AS (SELECT *, row_number() OVER (ORDER BY abs(lag1 - lag2), user_id, row_idx) - 1 AS r, count(*) OVER () - 1 AS z FROM sr),
ti AS (SELECT *, (4 * r > z)::INT + (4 * r > 2 * z)::INT + (4 * r > 3 * z)::INT AS tier FROM rn)"""


@query("d35_quartile_tiers", f"""WITH {QUARTERS_SQL}, {sql_moments(STACK, 'value', 'ti JOIN fs ON fold <> f', 'f, tier')}, {sql_subsets(4, [1.66], 'f, tier')},
best AS (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY f, tier ORDER BY gain DESC) = 1)
SELECT user_id, row_idx, fold, tier, {sql_rounded(sql_prediction(STACK))} AS stack FROM ti JOIN best ON fold = f AND ti.tier = best.tier JOIN mo ON mo.f = fold AND mo.tier = ti.tier""".replace("fold, tier, round", "fold, ti.tier, round"))
def quartile_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Four ridges of four members, one per quarter of the rows by the spread of two members."""
    d = stack_rows(spark, sf).withColumn("risk", F.abs(F.col("lag1") - F.col("lag2")))
    d = cut_lineage(D.risk_quartiles(d, "risk", K))
    return shown(D.oof_ridge(d, STACK, "value", "fold", ["tier"]), [*K, "fold", "tier"], ["stack"])


def recalibrated_sql(tiers: str) -> str:
    return f"""WITH {tiers}, {sql_moments(STACK, 'value', 'ti JOIN fs ON fold <> f')}, {sql_subsets(4, [1.66])}, best AS (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY f ORDER BY gain DESC) = 1),
fi AS (SELECT ti.*, best.f, {sql_prediction(STACK)} AS base FROM ti CROSS JOIN best JOIN mo USING (f)),
ca AS (SELECT f, tier, count(*) AS n, covar_pop(base, value) * count(*) / (var_pop(base) * count(*) + 10) AS a, avg(base) AS mb, avg(value) AS mv FROM fi WHERE fold <> f GROUP BY f, tier)
SELECT user_id, row_idx, fold, fi.tier, {sql_rounded('CASE WHEN n >= 1000 THEN mv + a * (base - mb) ELSE base END')} AS stack FROM fi JOIN ca ON fi.f = ca.f AND fi.tier = ca.tier WHERE fold = fi.f"""


@query("d35_recalibrated_sides", recalibrated_sql(f"{STACK_SQL}, ti AS (SELECT *, (row_idx >= 30)::INT AS tier FROM sr)"))
def recalibrated_sides(spark: SparkSession, sf: str) -> DataFrame:
    """One ridge, then a line on its predictions for the near and the far rows."""
    d = stack_rows(spark, sf).withColumn("tier", F.when(F.col("row_idx") >= 30, 1).otherwise(0))
    return shown(D.recalibrated_ridge(d, STACK, "value", "fold", "tier"), [*K, "fold", "tier"], ["stack"])


@query("d35_recalibrated_quartiles", recalibrated_sql(QUARTERS_SQL))
def recalibrated_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    d = stack_rows(spark, sf).withColumn("risk", F.abs(F.col("lag1") - F.col("lag2")))
    d = cut_lineage(D.risk_quartiles(d, "risk", K))
    return shown(D.recalibrated_ridge(d, STACK, "value", "fold", "tier"), [*K, "fold", "tier"], ["stack"])


@query("d36_subset_alpha_search", f"""WITH {STACK_MOMENTS}, {sql_subsets(4, [0.5, 1.66, 10.0, 100.0])},
best AS (SELECT u.mask AS whole, sub.* FROM sub JOIN (SELECT unnest(generate_series(1, 15)) AS mask) u ON (sub.mask & u.mask) = sub.mask QUALIFY row_number() OVER (PARTITION BY u.mask, f, alpha ORDER BY gain DESC) = 1)
SELECT CAST(whole - 1 AS INTEGER) AS subset, alpha, CAST(count(*) AS BIGINT) AS n, {sql_rounded(f"sqrt(avg(pow({sql_prediction(STACK)} - value, 2)))")} AS rmse FROM sr JOIN best ON fold = f JOIN mo USING (f) GROUP BY whole, alpha""")
def subset_search(spark: SparkSession, sf: str) -> DataFrame:
    """All 15 member subsets at four penalties, scored out of fold from the same pairwise sums."""
    subsets = [[bool(i >> b & 1) for b in range(4)] for i in range(1, 16)]
    t = D.ridge_table(stack_rows(spark, sf), STACK, "value", "fold", (), [0.5, 1.66, 10.0, 100.0], subsets)
    return shown(D.search_score(t), ["subset", "alpha", "n"], ["rmse"])


@query("d33_oof_trees", None)
def oof_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds; rows of an unseen share of groups (no fold) get the mean of the five models."""
    d = stack_rows(spark, sf).withColumn("fold", F.when(F.pmod(F.xxhash64("user_id"), F.lit(20)) > 0, F.col("fold")))
    t, _ = D.oof_trees(d, STACK, "value", "user_id", "fold", 5, winsor=90.0, anchor="mean3")
    return shown(t, [*K, "fold"], ["oof"])


@query("a22_tree_importance", None)
def tree_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Gains of the out-of-fold models, summed over the folds."""
    _, gains = D.oof_trees(stack_rows(spark, sf), STACK, "value", "user_id", "fold", 5, winsor=90.0, anchor="mean3")
    return M.importance_table(gains, "feature", "gain")


@query("d38_target_transforms", f"""WITH {STACK_SQL}, q AS (SELECT *, value / sqrt(row_idx + 1.0::DOUBLE) AS yr FROM sr), co AS (SELECT f, greatest(0, covar_pop(yr, mean3) * count(*) / (var_pop(mean3) * count(*) + 1.66)) AS a, avg(yr) AS my, avg(mean3) AS mx FROM q JOIN fs ON fold <> f GROUP BY f)
SELECT (row_idx >= 30) AS far, CAST(count(*) AS BIGINT) AS n, {sql_rounded('sqrt(avg(pow((my + a * (mean3 - mx)) * sqrt(row_idx + 1.0::DOUBLE) - value, 2)))')} AS rmse FROM q JOIN co ON fold = f GROUP BY 1""")
def target_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """Target per root of depth, turned back after prediction, scored near and far."""
    root = F.sqrt(F.col("row_idx") + 1.0)
    d = stack_rows(spark, sf).withColumn("yr", F.col("value") / root)
    d = D.oof_ridge(d, ["mean3"], "yr", "fold")
    e = F.col("stack") * root - F.col("value")
    return shown(d.groupBy((F.col("row_idx") >= 30).alias("far")).agg(F.count(F.lit(1)).alias("n"), M.rmse(e).alias("rmse")), ["far", "n"], ["rmse"])


HUBER_ROUNDS = 6


def huber_sql() -> str:
    cte = ["co0 AS (SELECT f, tier, 0 AS a, 0 AS mx, 0 AS my FROM ti JOIN fs ON fold <> f GROUP BY f, tier)"]
    for i in range(HUBER_ROUNDS + 1):
        r = f"abs(co{i}.my + co{i}.a * (mean3 - co{i}.mx) - value)"
        w = f"CASE WHEN {r} <= 8 THEN 1.0::DOUBLE ELSE 8 / {r} END" if i else "1.0::DOUBLE"
        cte.append(f"""wt{i} AS (SELECT fs.f, ti.tier, mean3 - 50 AS x, value - 50 AS y, {w} AS w FROM ti JOIN fs ON fold <> f JOIN co{i} ON co{i}.f = fs.f AND co{i}.tier = ti.tier),
co{i + 1} AS (SELECT f, tier, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) + 1.66) AS a, 50 + sum(w * x) / sum(w) AS mx, 50 + sum(w * y) / sum(w) AS my FROM wt{i} GROUP BY f, tier)""")
    c = f"co{HUBER_ROUNDS + 1}"
    return f"""WITH {STACK_SQL}, ti AS (SELECT *, (row_idx >= 30)::INT AS tier FROM sr), {', '.join(cte)}
SELECT user_id, row_idx, fold, ti.tier, {sql_rounded('my + a * (mean3 - mx)')} AS stack FROM ti JOIN {c} ON fold = f AND ti.tier = {c}.tier"""


@query("d38_huber_near_far", huber_sql())
def huber_near_far(spark: SparkSession, sf: str) -> DataFrame:
    """Huber's loss with a bend at 8, near and far rows fitted apart; a fixed number of reweightings, which SQL can follow."""
    d = stack_rows(spark, sf).withColumn("tier", F.when(F.col("row_idx") >= 30, 1).otherwise(0))
    d = D.huber_ridge(d, ["mean3"], "value", "fold", ["tier"], 8.0, rounds=HUBER_ROUNDS, tol=0.0)
    return shown(d, [*K, "fold", "tier"], ["stack"])


@query("d42_oof_collection", f"""WITH {FC_SQL} SELECT user_id, row_idx, {sql_rounded('value')} AS target, {sql_rounded('lag1')} AS lag1, {sql_rounded('lag2')} AS lag2, {sql_rounded('mean3')} AS mean3, {sql_rounded('flat')} AS flat FROM fc""")
def oof_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Long member predictions gathered into one column per member (known names, so no extra pass)."""
    fc = forecasts(spark, sf)
    names = ["lag1", "lag2", "mean3", "flat"]
    long = fc.select(*K, "value", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("p")) for m in names])).alias("c"))
    d = long.groupBy(*K).pivot("c.m", names).agg(F.max("c.p")).join(fc.select(*K, F.col("value").alias("target")), K)
    return shown(d, K, ["target", *names])


@query("d43_risk_weights", f"""WITH {MEMBERS}, r AS (SELECT *, avg(abs(lag1 - lag2)) OVER (PARTITION BY user_id) AS risk FROM mb)
SELECT user_id, row_idx, {sql_rounded('1 + 0.5 * least(greatest((risk - 30) / 10, 0), 1)')} AS weight FROM r WHERE row_idx % 4 NOT IN (1, 3)""")
def risk_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Sample weight by the group's mean spread; two of four cuts dropped (the cut is the row's number mod 4 here)."""
    d = with_group_stats(members(spark, sf), U, {"risk": F.avg(F.abs(F.col("lag1") - F.col("lag2")))})
    d = d.withColumn("cut", F.col("row_idx") % 4).where(~F.col("cut").isin(1, 3))
    return shown(d.withColumn("weight", D.risk_weight(F.col("risk"), 0.5, 30.0, 10.0)), K, ["weight"])


DOSES = {"lags": ["lag1", "lag2"], "means": ["mean3", "flat2"], "all": STACK}
DOSE_SQL = ", ".join(c for n, cols in DOSES.items() for c in sql_solved([STACK.index(c) for c in cols], 4, [1.66], name=n + "_fit"))


@query("d44_feature_doses", f"""WITH {STACK_MOMENTS}, {DOSE_SQL}, fits AS ({' UNION ALL '.join(f"SELECT '{n}' AS features, * FROM {n}_fit" for n in DOSES)})
SELECT features, CAST(count(*) AS BIGINT) AS n, {sql_rounded(f"sqrt(avg(pow({sql_prediction(STACK)} - value, 2)))")} AS rmse FROM sr JOIN fits ON fold = f JOIN mo USING (f) GROUP BY features""")
def feature_doses(spark: SparkSession, sf: str) -> DataFrame:
    """Named feature sets on the same rows, scored out of fold."""
    masks = [[c in cols for c in STACK] for cols in DOSES.values()]
    t = D.search_score(D.ridge_table(stack_rows(spark, sf), STACK, "value", "fold", (), [1.66], masks, positive=False), ["subset"])
    names = F.array(*[F.lit(n) for n in DOSES])
    return shown(t.withColumn("features", F.get(names, F.col("subset"))), ["features", "n"], ["rmse"])


HOLDOUT_SQL = f"""{STACK_SQL}, hd AS (SELECT *, {sql_hash_fold("user_id || ',11'", 5)} = 0 AS held FROM sr), {sql_moments(STACK, 'value', 'hd JOIN fs ON fold <> f WHERE NOT held')}, {sql_subsets(4, [0.5, 1.66, 10.0, 100.0])},
fit AS (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY f, alpha ORDER BY gain DESC) = 1),
rank AS (SELECT alpha, avg(pow({sql_prediction(STACK)} - value, 2)) AS e FROM hd JOIN fit ON fold = f JOIN mo USING (f) WHERE NOT held GROUP BY alpha),
best AS (SELECT arg_min(alpha, struct_pack(e := e, a := alpha)) AS best FROM rank), fac AS (SELECT unnest([1.0, 1.25, 1.4]::DOUBLE[]) AS factor)"""


def holdout_sql() -> str:
    solve = sql_subsets(4, [0.0], "factor").replace("CROSS JOIN (SELECT unnest([0.0]::DOUBLE[]) AS alpha)", "JOIN (SELECT factor, best * factor AS alpha FROM fac, best) USING (factor)")
    for old in ("mo", "sub", *[f"s{m}" for m in range(1, 16)], *[f"s{m}_{n}" for m in range(1, 16) for n in range(5)]):
        solve = re.sub(rf"\b{old}\b", f"{old}h", solve)
    return f"""WITH {HOLDOUT_SQL}, {sql_moments(STACK, 'value', 'hd CROSS JOIN fac WHERE NOT held', 'factor', 'moh')}, {solve},
win AS (SELECT * FROM subh QUALIFY row_number() OVER (PARTITION BY factor ORDER BY gain DESC) = 1)
SELECT {sql_rounded('any_value(factor)')} AS factor, {sql_rounded('any_value(alpha)')} AS alpha, {sql_rounded(f"sqrt(avg(pow({sql_prediction(STACK)} - value, 2)))")} AS rmse FROM hd CROSS JOIN win JOIN moh USING (factor) WHERE held GROUP BY win.factor"""


@query("d45_group_holdout", holdout_sql())
def group_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the groups held out by hash; inner folds rank the penalties, factors on the best one are scored on the
    holdout."""
    held = D.hash_fold(F.concat_ws(",", F.col("user_id").cast("string"), F.lit("11")), 5) == 0
    d = cut_lineage(stack_rows(spark, sf).withColumn("held", held).select("user_id", "value", "fold", "held", *STACK))
    inner = D.search_score(D.ridge_table(d.where(~F.col("held")), STACK, "value", "fold", (), [0.5, 1.66, 10.0, 100.0]), ["alpha"])
    best = inner.agg(F.min_by("alpha", F.struct("rmse", "alpha")).alias("best"))
    outer = d.withColumn("side", F.when(F.col("held"), 1).otherwise(0))
    m = D.train_and_test(D.moments(outer, STACK, "value", ["side"]), [], "side", len(STACK) + 1).where("side = 1")
    grid = m.crossJoin(F.broadcast(best)).withColumn("factor", F.explode(F.array(*[F.lit(f) for f in (1.0, 1.25, 1.4)])))  # one row
    fit = grid.withColumn("f", D.fit_ridge("train", "test", F.array(*[F.lit(True)] * len(STACK)), F.col("best") * F.col("factor"), F.lit(True)))
    return shown(fit.select("factor", (F.col("best") * F.col("factor")).alias("alpha"), F.sqrt(F.col("f.sse") / F.col("f.n")).alias("rmse")), [], ["factor", "alpha", "rmse"])


@query("d46_error_ladder", f"""WITH {FC_SQL}, e AS (SELECT user_id, row_idx, lag1 - value AS e FROM fc WHERE lag1 IS NOT NULL), g AS (SELECT user_id, avg(e) AS m, regr_slope(e, row_idx) AS a, regr_intercept(e, row_idx) AS b FROM e GROUP BY user_id)
SELECT {sql_rounded('sqrt(avg(e*e))')} AS rmse_all, {sql_rounded('sqrt(avg(pow(e - m, 2)))')} AS rmse_no_mean, {sql_rounded('sqrt(avg(pow(e - a * row_idx - b, 2)))')} AS rmse_no_line FROM e JOIN g USING (user_id)""")
def error_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled error left after removing each group's mean error, then its straight line."""
    d = forecasts(spark, sf).withColumn("e", F.col("lag1") - F.col("value")).where(F.col("e").isNotNull())
    d = with_group_stats(d, U, {"m": F.avg("e"), "a": F.regr_slope("e", "row_idx"), "b": F.regr_intercept("e", "row_idx")})
    e = F.col("e")
    s = d.agg(M.rmse(e).alias("rmse_all"), M.rmse(e - F.col("m")).alias("rmse_no_mean"), M.rmse(e - F.col("a") * F.col("row_idx") - F.col("b")).alias("rmse_no_line"))
    return shown(s, [], ["rmse_all", "rmse_no_mean", "rmse_no_line"])


@query("d47_half_split_check", f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM seq WHERE row_idx * 2 < n_rows GROUP BY user_id)
SELECT user_id, {sql_rounded('sqrt(avg(pow(value - a * x - b, 2)))', 4)} AS rmse FROM seq JOIN f USING (user_id) WHERE row_idx * 2 >= n_rows GROUP BY user_id""")
def half_split(spark: SparkSession, sf: str) -> DataFrame:
    """Line fitted on the first half of each group, scored on the second."""
    log = event_log(spark, sf)
    first = F.col("row_idx") * 2 < F.col("n_rows")
    fit = log.where(first).groupBy(*U).agg(F.regr_slope("value", "x").alias("a"), F.regr_intercept("value", "x").alias("b"))
    e = F.col("value") - F.col("a") * F.col("x") - F.col("b")
    return shown(log.where(~first).join(fit, U).groupBy(*U).agg(M.rmse(e).alias("rmse")), U, ["rmse"], 4)


# --- samples ----------------------------------------------------------------------------------------------------------


@query("d27_sequence_samples", None)
def sequence_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Natural cut plus two earlier ones; 12 hour grid with 16 steps of context."""
    log = filled_log(spark, sf).withColumn("fill_gap", F.when(F.col("sig").isNull(), 1.0).otherwise(0.0)).withColumn("z", F.col("row_idx") * 0.1)
    log = cut_lineage(log.withColumn("tvt", F.col("x") + F.col("z")))
    cuts = P.sample_cuts(log, "user_id", "known", [0.5, 0.7], 5, 3)
    d = P.sequence_samples(log, curve_of(spark, sf), cuts, "user_id", "known", "x", "z", "tvt", "fill", "cx", "cy", 12.0, 16, (-48, -24, 0, 24, 48), 3)
    values = [c for c in d.columns if c not in ("user_id", "cut", "step", "is_tail")]
    return shown(d, ["user_id", "cut", "step", "is_tail"], values)


@query("d27_row_map", f"""WITH {EVENTS_SQL} SELECT concat(s.user_id, '_', row_idx) AS id, s.user_id, {sql_rounded('x - m')} AS md_rel, {sql_rounded('value - v')} AS y, {sql_rounded('v')} AS anchor FROM seq s
JOIN (SELECT user_id, arg_max(x, row_idx) AS m, arg_max(value, row_idx) AS v FROM seq WHERE known GROUP BY user_id) a ON s.user_id = a.user_id WHERE NOT known""")
def row_map(spark: SparkSession, sf: str) -> DataFrame:
    return shown(P.row_map(event_log(spark, sf), "user_id", "known", "x", "value"), ["id", "user_id"], ["md_rel", "y", "anchor"])


SURFACES = ["pz", "p1", "p2", "p3", "p4", "p5"]


@query("d28_surface_channels", None)
def surface_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Six neighbour surfaces re-anchored per owner, with confidence and consensus."""
    e = F.col("embedding")
    b = bank(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), *[e[2 + k].cast("double").alias(f"p{k}") for k in range(1, 6)]), "pid")
    nb = knn_join(b, b, 20, ["pid"], ("px", "py"), ("px", "py"), "pid", "owner", "owner", SURFACES)
    d = b.join(idw_columns(nb, ["pid"], {c: (f"u{i}", f"s{i}") for i, c in enumerate(SURFACES)}, 1 / (F.col("dist") + 1e-3)), "pid")
    out = P.surface_channels(d.withColumn("known", F.col("pid") % 3 == 0), ["owner"], "known", "py", [(f"u{i}", f"s{i}", "nearest") for i in range(6)])
    return shown(out, ["pid"], [*[f"u{i}_conf" for i in range(6)], "surf_median", "surf_std", "surf_best", "surf_gap"])


@query("d29_grid_to_rows", f"""WITH {EVENTS_SQL}, r AS (SELECT s.user_id, s.event_id, x - m AS rel FROM seq s JOIN (SELECT user_id, arg_max(x, row_idx) AS m FROM seq WHERE known GROUP BY user_id) a ON s.user_id = a.user_id WHERE NOT known)
SELECT user_id, event_id, {sql_rounded('pow(floor(rel / 24), 2) + (rel / 24 - floor(rel / 24)) * (2 * floor(rel / 24) + 1)')} AS pred FROM r""")
def grid_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions on a daily grid (here day squared, up to each user's last row) read off at each row's distance past the cut."""
    rows = S.anchor(event_log(spark, sf), U, "known", ["x"]).join(event_log(spark, sf).where(~F.col("known")), U)
    rows = rows.select("user_id", "event_id", (F.col("x") - F.col("last_x")).alias("md_rel"))
    days = rows.groupBy("user_id").agg((F.floor(F.max("md_rel") / 24) + 1).cast("int").alias("last"))
    grid = days.withColumn("day", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "user_id", (F.col("day") * 24.0).alias("gx"), (F.col("day") * F.col("day")).cast("double").alias("gy"))
    return shown(P.to_rows(grid, rows, "user_id", "gx", "gy"), ["user_id", "event_id"], ["pred"])


@query("d30_overlap_add", f"""WITH {EVENTS_SQL}, w AS (SELECT s.*, w.k AS win, row_idx - 8 * w.k AS at_ FROM seq s JOIN (SELECT unnest(generate_series(0, 1000)) AS k) w ON 8 * w.k <= row_idx AND row_idx < 8 * w.k + 16)
SELECT user_id, row_idx, {sql_rounded('sum(greatest(1 - abs(at_ - 7.5) / 8.5, 1e-3) * (value + 0.1 * win)) / sum(greatest(1 - abs(at_ - 7.5) / 8.5, 1e-3))')} AS blended FROM w GROUP BY user_id, row_idx""")
def overlap_add(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 16 rows every 8 rows, each predicting value + 0.1 * window number."""
    return shown(P.overlap_add(event_log(spark, sf), U, F.col("value") + 0.1 * F.col("window"), 16, 8), K, ["blended"])


# --- alignment --------------------------------------------------------------------------------------------------------


def match_sql(half: int) -> str:
    """Best known window of every withheld row of a supplier, by comparing all of them."""
    w = 2 * half + 1
    norm = lambda l: f"list_transform({l}, lambda v: (v - list_avg({l})) / (list_aggregate({l}, 'stddev_pop') + 1e-6))"  # noqa: E731, E741
    return f"""m{half} AS (SELECT well, row_idx, x, sc FROM (
 SELECT e.well, e.row_idx, k.x, round(list_dot_product(e.win, k.win) / {w}, 12) AS sc, k.s FROM
 (SELECT well, row_idx, {norm('win')} AS win FROM (SELECT well, i + nk AS row_idx, list_transform(generate_series(i - {half}, i + {half}), lambda o: el[least(greatest(o, 0), ne - 1) + 1]) AS win FROM (SELECT *, unnest(generate_series(0, ne - 1)) AS i FROM ls))) e
 JOIN (SELECT well, s, x, {norm('win')} AS win FROM (SELECT well, s, xl[s + {half + 1}] AS x, kl[s + 1 : s + {w}] AS win FROM (SELECT *, unnest(generate_series(0, nk - {w}, 3)) AS s FROM ls))) k USING (well))
 QUALIFY row_number() OVER (PARTITION BY well, row_idx ORDER BY sc DESC, s) = 1)"""


@query("j17_window_match", f"""WITH {PARTS_SQL}, sm AS (SELECT well, known, row_idx, x, avg(qty) OVER (PARTITION BY well, known ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM plog),
ls AS (SELECT well, list(v ORDER BY row_idx) FILTER (known) AS kl, list(x ORDER BY row_idx) FILTER (known) AS xl, list(v ORDER BY row_idx) FILTER (NOT known) AS el, count(*) FILTER (known) AS nk, count(*) FILTER (NOT known) AS ne FROM sm GROUP BY well),
{match_sql(8)}, {match_sql(15)}, {match_sql(25)}
SELECT well, CAST(row_idx AS BIGINT) AS row_idx, {sql_rounded('sum(exp(3 * sc) * x) / (sum(exp(3 * sc)) + 1e-9)', 4)} AS match_ensemble, {sql_rounded('max(sc)', 4)} AS best_score FROM (SELECT * FROM m8 UNION ALL SELECT * FROM m15 UNION ALL SELECT * FROM m25) GROUP BY well, row_idx""")
def window_match(spark: SparkSession, sf: str) -> DataFrame:
    """Best known window for every withheld row of a supplier at half-widths 8, 15 and 25, and their ensemble."""
    log = cut_lineage(part_log(spark, sf).select("well", "row_idx", "known", "x", "qty"))
    cut = log.groupBy("well").agg(F.count_if("known").alias("k"))
    evals = cut_lineage(log.where(~F.col("known")).join(cut, WELL).withColumn("row_idx", F.col("row_idx") - F.col("k")).drop("k"))
    found = [cut_lineage(L.window_match(log.where("known"), evals, "well", "qty", "x", h)) for h in (8, 15, 25)]
    out = L.match_ensemble(found, "well").join(cut, WELL).withColumn("row_idx", F.col("row_idx") + F.col("k"))
    return shown(out, [*WELL, "row_idx"], ["match_ensemble", "best_score"], 4)


SLOPES = [-0.06, -0.03, 0.0, 0.03, 0.06]


def decode_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = filled_log(spark, sf).withColumn("z", -0.5 * F.col("x"))
    starts = S.anchor(log, U, "known", ["x", "z"]).select("user_id", (F.col("last_x") + F.col("last_z")).alias("u0"), F.lit(0.0).alias("s0"), F.lit(20.0).alias("gamma"))
    # every withheld row is decoded; errors have no signal, and views, which are the curve itself, give no evidence
    seen = F.when(F.col("event_type") != "view", F.col("sig"))
    rows = log.where(~F.col("known")).select("user_id", "row_idx", F.col("x").alias("md"), "z", seen.alias("signal"))
    return cut_lineage(rows), curve_of(spark, sf), starts


@query("d7_cost_volume", f"""WITH {EVENTS_SQL}{FILL_SQL}, {KNOTS}, gm AS (SELECT user_id, min(kx) AS g0, max(kx) AS g1 FROM knots GROUP BY user_id),
st AS (SELECT user_id, arg_max(0.5 * x, row_idx) AS u, arg_max(x, row_idx) AS m FROM seq WHERE known GROUP BY user_id),
rw AS (SELECT f.user_id, f.row_idx, f.x, CASE WHEN event_type <> 'view' THEN sig END AS seen, r.r AS slope, g0, least(greatest(floor((u + r.r * (f.x - m) + 0.5 * f.x - g0) / 24.0), 0), floor((g1 - g0) / 24.0 + 1e-9)) AS c FROM filled f JOIN st USING (user_id) JOIN gm USING (user_id)
 CROSS JOIN (SELECT unnest({SLOPES}::DOUBLE[]) AS r) r WHERE NOT known),
pp AS (SELECT *, g0 + 24.0 * c AS gx FROM rw), rf AS (SELECT *, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN ay + (byy - ay) * (gx - ax) / (bx - ax) ELSE coalesce(ay, byy) END AS ref FROM (
 SELECT p.*, a.kx AS ax, a.ky AS ay, b.kx AS bx, b.ky AS byy FROM pp p ASOF LEFT JOIN knots a ON p.user_id = a.user_id AND p.gx >= a.kx ASOF LEFT JOIN knots b ON p.user_id = b.user_id AND p.gx < b.kx))
SELECT user_id, {sql_rounded('slope')} AS slope, {sql_rounded('coalesce(sum(-ln(1 + pow((seen - ref) / 20, 2))), 0)')} AS ll FROM rf GROUP BY user_id, slope""")
def cost_volume(spark: SparkSession, sf: str) -> DataFrame:
    """One segment per group: the whole withheld part, five slopes, curve on a 24 hour grid."""
    rows, curve, starts = decode_inputs(spark, sf)
    grid = regrid(curve, U, "cx", "cy", 24.0)
    frame = grid.groupBy(*U).agg(F.min("grid_x").alias("grid_min"), F.max("step").alias("grid_last"))
    m = S.anchor(event_log(spark, sf), U, "known", ["x"]).select("user_id", F.col("last_x").alias("md_prev"))
    part = rows.join(m, U).join(starts.select("user_id", "gamma"), U).join(frame, U).withColumn("grid_step", F.lit(24.0))
    ll = Dc.cost_volume(part, starts.select("user_id", F.lit(0).alias("sid"), F.col("u0").alias("u")), grid.withColumnRenamed("grid_y", "ref"), "user_id", SLOPES, ["sid"])
    return shown(ll, ["user_id"], ["slope", "ll"])


RATES = [round(-0.06 + 0.002 * k, 3) for k in range(61)]
SEG_LEN, CELL = 100.0, 5.0


def supplier_decode(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, curve and starts of the supplier log: the first line of each order is the curve, the others are the signal.
    Start slope and noise scale come from the known prefix."""
    log = cut_lineage(part_log(spark, sf).select("well", "row_idx", "known", "x", "qty", "l_linenumber").withColumn("z", -0.98 * F.col("x")))
    curve = log.where("l_linenumber = 1").select("well", F.col("x").alias("cx"), F.col("qty").alias("cy"))
    log = log.withColumn("seen", F.when(F.col("l_linenumber") != 1, F.col("qty")))
    known = cut_lineage(log.where("known").withColumn("surface", F.col("x") + F.col("z")))
    gamma = A.noise_scale(interp_join(known, curve, WELL, "x", "cx", "cy", "ref"), WELL, "seen", "ref").select("well", F.col("median_scale").alias("gamma"))
    slope = A.exit_slope(known, WELL, "surface", "x").select("well", F.greatest(F.lit(-0.06), F.least(F.lit(0.06), "exit_slope")).alias("s0"))
    starts = known.groupBy("well").agg(F.max_by("surface", "row_idx").alias("u0")).join(slope, WELL).join(gamma, WELL).where("gamma is not null")
    rows = log.where(~F.col("known")).select("well", "row_idx", F.col("x").alias("md"), "z", F.col("seen").alias("signal"))
    return cut_lineage(rows), curve, cut_lineage(starts)


DECODE_SQL = f"""{PARTS_SQL}, dl AS (SELECT *, -0.98 * x AS z, CASE WHEN l_linenumber <> 1 THEN qty END AS seen FROM plog),
kn AS (SELECT well, x AS kx, avg(qty) AS ky FROM dl WHERE l_linenumber = 1 GROUP BY well, x),
br AS (SELECT p.*, a.kx AS ax, a.ky AS ay, b.kx AS bx, b.ky AS byy FROM (SELECT * FROM dl WHERE known) p ASOF LEFT JOIN kn a ON p.well = a.well AND p.x >= a.kx ASOF LEFT JOIN kn b ON p.well = b.well AND p.x < b.kx),
rs AS (SELECT well, abs(seen - CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN ay + (byy - ay) * (x - ax) / (bx - ax) ELSE coalesce(ay, byy) END) AS e FROM br),
gam AS (SELECT well, least(greatest(quantile_cont(e, 0.5), 5), 40) AS gamma FROM rs WHERE e IS NOT NULL GROUP BY well),
tl AS (SELECT * FROM (SELECT well, x, x + z AS sf, row_idx, max(row_idx) OVER (PARTITION BY well) AS e FROM dl WHERE known) WHERE row_idx > e - 30),
rt AS (SELECT well, CASE WHEN dx > 0 THEN ds / dx END AS r FROM (SELECT well, x - lag(x) OVER w AS dx, sf - lag(sf) OVER w AS ds FROM tl WINDOW w AS (PARTITION BY well ORDER BY row_idx))),
ex AS (SELECT well, least(greatest(CASE WHEN count(r) >= 3 THEN quantile_cont(r, 0.5) ELSE 0 END, -0.06), 0.06) AS s0 FROM rt GROUP BY well),
an AS (SELECT well, arg_max(x + z, row_idx) AS u0 FROM dl WHERE known GROUP BY well),
gb AS (SELECT well, min(kx) AS g0, max(kx) AS g1 FROM kn GROUP BY well),
fx AS MATERIALIZED (SELECT an.well, u0, s0, gamma, g0, floor((g1 - g0) / {CELL} + 1e-9) AS gl FROM an JOIN ex USING (well) JOIN gam USING (well) JOIN gb USING (well)),
gp AS (SELECT well, k AS step, g0 + k * {CELL} AS gx FROM (SELECT well, g0, unnest(generate_series(0, CAST(gl AS BIGINT))) AS k FROM fx)),
gd AS MATERIALIZED (SELECT p.well, p.step, CASE WHEN a.kx IS NOT NULL AND b.kx IS NOT NULL THEN a.ky + (b.ky - a.ky) * (gx - a.kx) / (b.kx - a.kx) ELSE coalesce(a.ky, b.ky) END AS ref
  FROM gp p ASOF LEFT JOIN kn a ON p.well = a.well AND p.gx >= a.kx ASOF LEFT JOIN kn b ON p.well = b.well AND p.gx < b.kx),
wr AS (SELECT well, row_idx, x, z, seen, floor((x - min(x) OVER (PARTITION BY well)) / {SEG_LEN}) AS seg FROM dl WHERE NOT known AND well IN (SELECT well FROM fx)),
h AS (SELECT well, m0, min(x) FILTER (WHERE x > m0) AS m1 FROM (SELECT well, x, min(x) OVER (PARTITION BY well) AS m0 FROM wr) GROUP BY ALL),
sg AS MATERIALIZED (SELECT s.well, seg, md_last, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, coalesce(lag(md_last) OVER w, 2 * m0 - m1, m0) AS md_prev
  FROM (SELECT well, seg, max(x) AS md_last FROM wr GROUP BY ALL) s JOIN h USING (well) WINDOW w AS (PARTITION BY s.well ORDER BY seg)),
rw AS MATERIALIZED (SELECT wr.*, ord, md_prev FROM wr JOIN sg USING (well, seg)), rates AS MATERIALIZED (SELECT unnest({RATES}::DOUBLE[]) AS r)"""


def beam_sql(name: str, evidence: float, keep: int = 96) -> str:
    """A recursive CTE of the kept states of every round, with their paths."""
    return f"""{name} AS (
SELECT well, -1 AS ord, CAST(1 AS BIGINT) AS sid, u0 AS u, s0 AS s, CAST(0 AS DOUBLE) AS score, CAST([] AS DOUBLE[]) AS us, CAST([] AS DOUBLE[]) AS rs FROM fx
UNION ALL
SELECT k.well, k.ord, k.sid, k.u1, k.r, k.score1, list_append(t.us, t.u), list_append(t.rs, k.r) FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY score1 DESC, u1, r, parent) AS sid FROM (SELECT * FROM (
  SELECT well, ord, u1, r, parent, floor((score + {evidence} * ll - CASE WHEN r = s THEN 0 ELSE least(pow((r - s) / 0.012, 2), 25) END) * 1e7 + 0.5) / 1e7 AS score1 FROM (
    SELECT x.well, ord, parent, r, u1, s, score, coalesce(sum(-ln(1 + pow((seen - ref) / gamma, 2))), 0) AS ll
    FROM (SELECT t.well, sg.ord, t.sid AS parent, r, t.s, t.score, t.u + r * (md_last - sg.md_prev) AS u1, seen, gamma, CAST(least(greatest(floor((t.u + r * (rw.x - sg.md_prev) - rw.z - g0) / {CELL}), 0), gl) AS BIGINT) AS cell
      FROM {name} t JOIN sg ON t.well = sg.well AND sg.ord = t.ord + 1 JOIN fx ON fx.well = t.well JOIN rw ON rw.well = sg.well AND rw.ord = sg.ord CROSS JOIN rates
      LIMIT 1000000000000) x JOIN gd ON gd.well = x.well AND gd.step = cell
    GROUP BY ALL))
  QUALIFY row_number() OVER (PARTITION BY well, floor(u1 * 2 + 0.5), r ORDER BY score1 DESC, u1, parent) = 1)) k JOIN {name} t ON t.well = k.well AND t.sid = k.parent WHERE k.sid <= {keep}),
{name}_top AS (SELECT *, max(score) OVER (PARTITION BY well) AS best FROM (SELECT *, max(ord) OVER (PARTITION BY well) AS e FROM {name}) WHERE ord = e AND ord >= 0 AND sid <= 32)"""


def paths_sql(name: str, temperature: float) -> str:
    """Position of every row by the mean of the best chains and by the best one."""
    return f"""(SELECT rw.well, rw.row_idx, sum(exp((score - best) / {temperature}) * (us[rw.ord + 1] + rs[rw.ord + 1] * (rw.x - rw.md_prev))) / sum(exp((score - best) / {temperature})) - any_value(rw.z) AS decoded,
  max(CASE WHEN sid = 1 THEN us[rw.ord + 1] + rs[rw.ord + 1] * (rw.x - rw.md_prev) END) - any_value(rw.z) AS decoded_best FROM rw JOIN {name}_top USING (well) GROUP BY rw.well, rw.row_idx)"""


@query("d8_segment_decode", f"""WITH RECURSIVE {DECODE_SQL}, {beam_sql('b1', 0.1)}
SELECT well, row_idx, {sql_rounded('decoded', 4)} AS decoded, {sql_rounded('decoded_best', 4)} AS decoded_best FROM {paths_sql('b1', 8.0)}""")
def segment_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The withheld part of every supplier: 61 slopes, beam of 96, mean of the best 32."""
    rows, curve, starts = supplier_decode(spark, sf)
    d = Dc.segment_search(rows, curve, starts, "well", "cx", "cy", Dc.Beam(tuple(RATES)), SEG_LEN, CELL).decoded()
    return shown(d, [*WELL, "row_idx"], ["decoded", "decoded_best"], 4)


@query("d9_lattice_decode", None)
def lattice_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Six lengths from 100 to 760 days on a lattice of 10 days with a log-normal prior, 41 slopes."""
    rows, curve, starts = supplier_decode(spark, sf)
    ends = part_log(spark, sf).where("known").groupBy("well").agg(F.max_by("x", "row_idx").alias("last_x"))
    starts = cut_lineage(starts.join(ends, WELL))
    rel = rows.join(starts.select("well", "last_x"), WELL).withColumn("rel", F.col("md") - F.col("last_x"))
    lattice = regrid(rel, WELL, "rel", "signal", 10.0, start=0.0).join(starts.select("well", "last_x"), WELL)
    lattice = lattice.select("well", "step", (-0.98 * (F.col("last_x") + F.col("grid_x"))).alias("z"), F.col("grid_y").alias("signal"))
    slopes = [round(-0.10 + 0.005 * k, 3) for k in range(41)]
    d = Dc.lattice_decode(lattice, curve, starts, "well", "cx", "cy", [10, 16, 24, 36, 52, 76], slopes, 10.0, 5.6, 0.6, keep=96, top=32, grid_step=CELL)
    return shown(d, [*WELL, "step"], ["surface"], 4)


@query("d10_decode_variants", f"""WITH RECURSIVE {DECODE_SQL}, {beam_sql('b1', 0.1)}, {beam_sql('b2', 0.05)}, {beam_sql('b3', 0.2)}
SELECT well, row_idx, form, {sql_rounded('decoded', 4)} AS decoded FROM (
SELECT well, row_idx, 'sharp' AS form, decoded FROM {paths_sql('b1', 2.0)} UNION ALL SELECT well, row_idx, 'soft', decoded FROM {paths_sql('b1', 32.0)}
UNION ALL SELECT well, row_idx, 'stiff', decoded FROM {paths_sql('b2', 8.0)} UNION ALL SELECT well, row_idx, 'loose', decoded FROM {paths_sql('b3', 8.0)})""")
def decode_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Two temperatures read off one search, and two other weights of the evidence: three searches for four forms."""
    rows, curve, starts = supplier_decode(spark, sf)
    beams = [Dc.Beam(tuple(RATES), evidence=evidence) for evidence in (0.1, 0.05, 0.2)]
    plain, stiff, loose = Dc.segment_searches(rows, curve, starts, "well", "cx", "cy", beams, SEG_LEN, CELL)
    forms = {"sharp": (plain, 2.0), "soft": (plain, 32.0), "stiff": (stiff, 8.0), "loose": (loose, 8.0)}
    return shown(Dc.decoded_forms(forms), [*WELL, "row_idx", "form"], ["decoded"], 4)


@query("d39_shift_scan", f"""WITH {EVENTS_SQL}, {KNOTS}{GRID}, j AS (SELECT user_id, off, CAST(sum(CAST(floor(mismatch * mismatch * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS cost FROM prof WHERE mismatch IS NOT NULL GROUP BY user_id, off),
m AS (SELECT *, cost < coalesce(lag(cost) OVER w, 1e308) AND cost < coalesce(lead(cost) OVER w, 1e308) AS lo FROM j WINDOW w AS (PARTITION BY user_id ORDER BY off)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost, off) AS k FROM m WHERE lo)
SELECT user_id, CAST(count(*) AS BIGINT) AS minima, {sql_rounded('max(off) FILTER (k = 1)')} AS first_offset, {sql_rounded('max(cost) FILTER (k = 1)')} AS first_cost, {sql_rounded('max(off) FILTER (k = 2)')} AS second_offset, {sql_rounded('max(cost) FILTER (k = 2) / nullif(max(cost) FILTER (k = 1), 0)')} AS ratio FROM r GROUP BY user_id""")
def shift_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Best two offsets per user by the mean squared mismatch, squares taken to six decimals so that ties are ties. A first
    cost of zero has no ratio."""
    d = L.two_minima(L.shift_scan(profile(spark, sf), U, 6), U)
    return shown(d, ["user_id", "minima"], ["first_offset", "first_cost", "second_offset", "ratio"])


@query("d40_curve_families", f"""WITH RECURSIVE o AS (SELECT o_custkey AS g, CAST(round(o_totalprice / 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
rn AS (SELECT DISTINCT g, run FROM (SELECT g, concat(v, '|', lead(v) OVER (PARTITION BY g ORDER BY p)) AS run, lead(v) OVER (PARTITION BY g ORDER BY p) AS nx FROM o) WHERE nx IS NOT NULL),
sh AS (SELECT g, run FROM rn WHERE run IN (SELECT run FROM rn GROUP BY run HAVING count(*) > 1)), ed AS (SELECT DISTINCT a.g AS a, b.g AS b FROM sh a JOIN sh b ON a.run = b.run),
rc AS (SELECT DISTINCT g AS a, g AS b FROM o UNION SELECT rc.a, ed.b FROM rc JOIN ed ON rc.b = ed.a)
SELECT a AS g, min(b) AS family FROM rc GROUP BY a""")
def curve_families(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose order values (in hundreds) share two consecutive values, directly or through others."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("g"), F.round(F.col("o_totalprice") / 100).cast("long").alias("v"), "o_orderdate", "o_orderkey",
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("t"))
    log = index_rows(o, ["g"], ["o_orderdate", "o_orderkey"], "t")
    return L.curve_families(log, "g", "v", 2)


@query("d41_draw_distribution", f"""WITH {FC_SQL}, dr AS (SELECT d.d AS draw, g1.*, row_number() OVER (PARTITION BY d.d ORDER BY md5(concat(user_id, '_', d.d, '_7')), user_id) AS k FROM g1 CROSS JOIN (SELECT unnest(generate_series(0, 49)) AS d) d)
SELECT CAST(draw AS INTEGER) AS draw, CAST(count(*) AS BIGINT) AS groups, {sql_rounded('sqrt(sum(rmse*rmse*n)/sum(n))')} AS rmse FROM dr WHERE k <= 52 GROUP BY draw""")
def draw_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Score of 50 random samples of 52 groups."""
    return shown(L.draw_scores(lag1_rmse(spark, sf), "user_id", 50, 52), ["draw", "groups"], ["rmse"])
