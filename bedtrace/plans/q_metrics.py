"""Queries for error measures, traits and reports. Forecasts: earlier values of the same user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.functions.columns import bias_corrected_kurtosis, bias_corrected_skew
from bedtrace.operators import metrics as M
from bedtrace.operators.cells import framed, with_group_stats
from bedtrace.plans.bindings import EVENTS_SQL, PARTS_SQL, event_log, events, part_log, table
from bedtrace.plans.q_sequence import FILL_SQL, filled_log, wc
from bedtrace.plans.registry import query, rounded, shown, sql_rounded, sql_shown
from bedtrace.session import cut_lineage

U = ["user_id"]
K = ["user_id", "row_idx"]
WIN = "PARTITION BY user_id ORDER BY row_idx"
METHODS = ["lag1", "lag2", "mean3", "flat"]

FC_SQL = f"""{EVENTS_SQL}, fc AS (
 SELECT *, lag(value) OVER w AS lag1, lag(value, 2) OVER w AS lag2, avg(value) OVER ({WIN} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3, 50.0::DOUBLE AS flat
 FROM seq WINDOW w AS ({WIN})),
er AS (SELECT user_id, row_idx, 'lag1' AS method, lag1 - value AS error FROM fc UNION ALL SELECT user_id, row_idx, 'lag2', lag2 - value FROM fc
 UNION ALL SELECT user_id, row_idx, 'mean3', mean3 - value FROM fc UNION ALL SELECT user_id, row_idx, 'flat', flat - value FROM fc),
ok AS (SELECT * FROM er WHERE error IS NOT NULL),
gm AS (SELECT user_id, method, CAST(count(*) AS BIGINT) AS n, sqrt(avg(error*error)) AS rmse FROM ok GROUP BY user_id, method),
g1 AS (SELECT * FROM gm WHERE method = 'lag1')"""


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return framed(event_log(spark, sf), U, 3, 0, lambda w: {
        "lag1": F.lag("value", 1).over(w), "lag2": F.lag("value", 2).over(w), "mean3": F.avg("value").over(w.rowsBetween(-3, -1)),
        "flat": F.lit(50.0)})


def errors(spark: SparkSession, sf: str) -> DataFrame:
    return M.long_methods(forecasts(spark, sf), K, METHODS, "value")


def lag1_rmse(spark: SparkSession, sf: str) -> DataFrame:
    """One row per group, read several times by the reports: kept once instead of recomputed."""
    return cut_lineage(M.group_rmse(errors(spark, sf).where("method = 'lag1'"), ["user_id"]))


@query("a1_pooled_rmse", f"WITH {FC_SQL} SELECT {sql_rounded('sqrt(avg(pow(lag1 - value, 2)))')} AS rmse, CAST(count(lag1) AS BIGINT) AS n FROM fc")
def pooled(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("lag1") - F.col("value")
    d = forecasts(spark, sf).agg(M.rmse(e).alias("rmse"), F.count("lag1").alias("n"))
    return d.select(rounded(F.col("rmse")).alias("rmse"), "n")


@query("a2_group_rmse", f"WITH {FC_SQL} SELECT {sql_shown(['user_id', 'method', 'n'], ['rmse'])} FROM gm")
def per_group(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.group_rmse(errors(spark, sf), ["user_id", "method"]), ["user_id", "method", "n"], ["rmse"])


@query("a3_method_scores", f"WITH {FC_SQL} SELECT method, CAST(count(*) AS BIGINT) AS n, {sql_rounded('sqrt(avg(error*error))')} AS rmse FROM ok GROUP BY method ORDER BY rmse")
def method_scores(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.group_rmse(errors(spark, sf), ["method"]).orderBy("rmse"), ["method", "n"], ["rmse"])


@query("a4_weighted_pooled", f"WITH {FC_SQL} SELECT method, {sql_rounded('sqrt(sum(rmse*rmse*n)/sum(n))')} AS rmse FROM gm GROUP BY method")
def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.weighted_pooled(M.group_rmse(errors(spark, sf), ["user_id", "method"]), ["method"]), ["method"], ["rmse"])


@query("a5_tail_share", f"""WITH {FC_SQL}, s AS (SELECT rmse*rmse*n AS sse, row_number() OVER (ORDER BY rmse*rmse*n DESC, user_id) AS r, count(*) OVER () AS c FROM g1)
SELECT {sql_rounded('sum(sse) FILTER (r <= greatest(1, c // 10)) / sum(sse)')} AS share, CAST(count(*) FILTER (r <= greatest(1, c // 10)) AS BIGINT) AS worst_groups,
 CAST(max(c) AS BIGINT) AS groups FROM s""")
def tail_share(spark: SparkSession, sf: str) -> DataFrame:
    d = M.tail_share(lag1_rmse(spark, sf), "user_id")
    return d.select(rounded(F.col("share")).alias("share"), "worst_groups", "groups")


@query("a5_error_curve", f"""WITH {FC_SQL} SELECT user_id, CAST(r AS BIGINT) AS rank, {sql_rounded('c / t')} AS share FROM (SELECT user_id, row_number() OVER o - 1 AS r,
 sum(rmse*rmse*n) OVER (ORDER BY rmse*rmse*n DESC, user_id) AS c, sum(rmse*rmse*n) OVER () AS t FROM g1 WINDOW o AS (ORDER BY rmse*rmse*n DESC, user_id))""")
def error_curve(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.sse_curve(lag1_rmse(spark, sf), "user_id"), ["user_id", "rank"], ["share"])


TRAITS = ["known_len", "eval_len", "nan_known", "nan_eval", "span_eval", "drift_end", "drift_max", "escape", "edge_margin", "known_std"]
TRAIT_SQL = """, tr AS (SELECT user_id, count(*) FILTER (known) AS known_len, count(*) FILTER (NOT known) AS eval_len,
 avg(CASE WHEN sig IS NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (known) AS nan_known, avg(CASE WHEN sig IS NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT known) AS nan_eval,
 max(x) FILTER (NOT known) - min(x) FILTER (NOT known) AS span_eval, abs(arg_max(value, row_idx) - any_value(last)) AS drift_end,
 max(abs(value - last)) FILTER (NOT known) AS drift_max, avg(CASE WHEN value < lo OR value > hi THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT known) AS escape,
 least(any_value(last) - any_value(lo), any_value(hi) - any_value(last)) AS edge_margin, stddev_pop(value) FILTER (known) AS known_std
 FROM (SELECT *, arg_max(value, row_idx) FILTER (known) OVER p AS last, min(value) FILTER (known) OVER p AS lo, max(value) FILTER (known) OVER p AS hi FROM seq WINDOW p AS (PARTITION BY user_id))
 GROUP BY user_id)"""


def trait_table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("known")
    v = F.col("value")
    log = with_group_stats(event_log(spark, sf), U, {
        "last": F.max_by("value", F.when(k, F.col("row_idx"))), "lo": F.min(F.when(k, v)), "hi": F.max(F.when(k, v))})
    gap = F.when(F.col("sig").isNull(), 1.0).otherwise(0.0)
    xe = F.when(~k, F.col("x"))
    out = F.when((v < F.col("lo")) | (v > F.col("hi")), 1.0).otherwise(0.0)
    return M.traits(log, U, {
        "known_len": F.count_if(k), "eval_len": F.count_if(~k), "nan_known": F.avg(F.when(k, gap)), "nan_eval": F.avg(F.when(~k, gap)),
        "span_eval": F.max(xe) - F.min(xe), "drift_end": F.abs(F.max_by("value", "row_idx") - F.max("last")),
        "drift_max": F.max(F.when(~k, F.abs(v - F.col("last")))), "escape": F.avg(F.when(~k, out)),
        "edge_margin": F.least(F.max("last") - F.max("lo"), F.max("hi") - F.max("last")), "known_std": F.stddev_pop(F.when(k, v))})


def rated_traits(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(trait_table(spark, sf).join(lag1_rmse(spark, sf), "user_id"))


@query("a6_trait_table", f"WITH {FC_SQL}{TRAIT_SQL} SELECT {sql_shown(['user_id'], TRAITS)} FROM tr")
def trait_report(spark: SparkSession, sf: str) -> DataFrame:
    return shown(trait_table(spark, sf), U, TRAITS)


RATED = ["nan_eval", "drift_end", "drift_max", "known_std", "eval_len"]
LONG_TRAITS = TRAIT_SQL + ", rt AS (SELECT * FROM tr JOIN g1 USING (user_id)), lt AS (" + " UNION ALL ".join(
    f"SELECT user_id, '{t}' AS trait, CAST({t} AS DOUBLE) AS v, rmse AS y FROM rt" for t in RATED) + ")"


@query("a7_rank_correlations", f"""WITH {FC_SQL}{LONG_TRAITS}, rk AS (SELECT *, rank() OVER a + (count(*) OVER (PARTITION BY trait, v) - 1) / 2.0 AS rv,
 rank() OVER b + (count(*) OVER (PARTITION BY trait, y) - 1) / 2.0 AS ry FROM lt WHERE v IS NOT NULL WINDOW a AS (PARTITION BY trait ORDER BY v), b AS (PARTITION BY trait ORDER BY y))
SELECT trait, {sql_rounded('corr(rv, ry)')} AS spearman, {sql_rounded('corr(v, ln(1 + y))')} AS pearson_log FROM rk GROUP BY trait""")
def rank_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.rank_correlations(rated_traits(spark, sf), RATED, "rmse"), ["trait"], ["spearman", "pearson_log"])


@query("a8_cohort_medians", f"""WITH {FC_SQL}{LONG_TRAITS}, e AS (SELECT quantile_cont(rmse, 0.9) AS edge FROM rt),
m AS (SELECT trait, quantile_cont(v, 0.5) FILTER (y >= edge) AS top_median, quantile_cont(v, 0.5) FILTER (y < edge) AS rest_median FROM lt CROSS JOIN e GROUP BY trait)
SELECT trait, {sql_rounded('top_median')} AS top_median, {sql_rounded('rest_median')} AS rest_median, {sql_rounded('top_median / nullif(rest_median, 0)')} AS ratio FROM m""")
def cohort_medians(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.cohort_medians(rated_traits(spark, sf), RATED, "rmse"), ["trait"], ["top_median", "rest_median", "ratio"])


@query("a9_ols_r2", f"""WITH {FC_SQL}{TRAIT_SQL}, r AS (SELECT corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab, count(*) AS n FROM
 (SELECT ln(1 + rmse) AS y, ln(1 + drift_end) AS a, known_std AS b FROM tr JOIN g1 USING (user_id)))
SELECT {sql_rounded('(ya*ya + yb*yb - 2*ya*yb*ab) / (1 - ab*ab)')} AS r2, CAST(n AS BIGINT) AS n FROM r""")
def ols(spark: SparkSession, sf: str) -> DataFrame:
    d = rated_traits(spark, sf).select(F.log1p("rmse").alias("y"), F.log1p("drift_end").alias("a"), F.col("known_std").alias("b"))
    return M.ols_r2(d, ["a", "b"], "y").select(rounded(F.col("r2")).alias("r2"), "n")


SHIFT = ["shift_mean", "shift_logstd", "shift_skew", "shift_kurt", "novelty"]


@query("a19_distribution_shift", f"""WITH {PARTS_SQL}, q AS (SELECT *, quantile_cont(CASE WHEN known THEN price END, 0.01) OVER p AS lo, quantile_cont(CASE WHEN known THEN price END, 0.99) OVER p AS hi FROM plog WINDOW p AS (PARTITION BY well)),
s AS (SELECT well, avg(price) FILTER (known) AS km, stddev_samp(price) FILTER (known) AS ks, skewness(price) FILTER (known) AS kw, kurtosis(price) FILTER (known) AS kk,
 avg(price) FILTER (NOT known) AS em, stddev_samp(price) FILTER (NOT known) AS es, skewness(price) FILTER (NOT known) AS ew, kurtosis(price) FILTER (NOT known) AS ek,
 avg(CASE WHEN price < lo OR price > hi THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT known) AS novelty FROM q GROUP BY well HAVING count(price) FILTER (known) >= 30 AND count(price) FILTER (NOT known) > 10)
SELECT {sql_shown(['well'], SHIFT, 5)} FROM (SELECT well, (em - km) / (ks + 1e-6) AS shift_mean, ln((es + 1e-6) / (ks + 1e-6)) AS shift_logstd, ew - kw AS shift_skew, ek - kk AS shift_kurt, novelty FROM s)""")
def shift(spark: SparkSession, sf: str) -> DataFrame:
    return shown(M.distribution_shift(part_log(spark, sf), ["well"], "price", "known", 30, 10), ["well"], SHIFT, 5)


@query("a19_rank_in_known", f"""WITH {EVENTS_SQL}{FILL_SQL} SELECT user_id, row_idx, {sql_rounded("b / nullif(t, 0)")} AS qrank FROM (
 SELECT f.user_id, f.row_idx, (SELECT count(*) FROM seq k WHERE k.user_id = f.user_id AND k.known AND k.sig < f.fill)::DOUBLE AS b,
 (SELECT count(sig) FROM seq k WHERE k.user_id = f.user_id AND k.known) AS t FROM filled f WHERE NOT known)""")
def rank_in_known(spark: SparkSession, sf: str) -> DataFrame:
    log = filled_log(spark, sf)
    d = M.share_below(log.where(~F.col("known")), log.where("known"), U, "fill", "sig", "qrank")
    return shown(d, K, ["qrank"])


@query("a20_rolling_skew_kurtosis", f"""WITH {EVENTS_SQL}{FILL_SQL} SELECT user_id, row_idx, {sql_rounded(f'CASE WHEN n >= 20 THEN sk END', 4)} AS skew101, {sql_rounded('CASE WHEN n >= 20 THEN ku END', 4)} AS kurt101 FROM (
 SELECT *, count(*) OVER {wc(101)} AS n, skewness(fill) OVER {wc(101)} AS sk, kurtosis(fill) OVER {wc(101)} AS ku FROM filled)""")
def rolling_shape(spark: SparkSession, sf: str) -> DataFrame:
    def build(w):
        f = w.rowsBetween(-50, 50)
        n = F.count("fill").over(f)
        return {"skew101": F.when(n >= 20, bias_corrected_skew(F.skewness("fill").over(f), n)),
                "kurt101": F.when(n >= 20, bias_corrected_kurtosis(F.kurtosis("fill").over(f), n))}

    return shown(framed(filled_log(spark, sf), U, 50, 50, build), K, ["skew101", "kurt101"], 4)


@query("a21_member_mean", f"SELECT l_orderkey, CAST(count(*) AS BIGINT) AS members, {sql_rounded('avg(l_extendedprice)')} AS mean_pred FROM lineitem GROUP BY l_orderkey")
def member_mean(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("members"), F.avg("l_extendedprice").alias("mean_pred"))
    return shown(d, ["l_orderkey", "members"], ["mean_pred"])


@query("a22_importance", f"""WITH s AS (SELECT p_type AS feature, sum(p_retailprice) AS gain FROM part GROUP BY p_type)
SELECT feature, {sql_rounded('gain', 4)} AS gain, {sql_rounded('100 * gain / sum(gain) OVER ()')} AS share_pct, CAST(row_number() OVER (ORDER BY round(gain, 4) DESC, feature) AS BIGINT) AS rank FROM s""")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    gains = table(spark, sf, "part").groupBy(F.col("p_type").alias("feature")).agg(F.round(F.sum("p_retailprice"), 4).alias("g"))
    d = M.importance_table(gains, "feature", "g")
    return d.select("feature", rounded(F.col("gain"), 4).alias("gain"), rounded(F.col("share_pct")).alias("share_pct"), "rank")


ERRS_SQL = f"""{FC_SQL}, e4 AS (SELECT user_id, row_idx, lag1 - value AS e1, lag2 - value AS e2, mean3 - value AS e3, flat - value AS e4 FROM fc WHERE lag2 IS NOT NULL)"""
GRAM_SQL = "g AS (" + " UNION ALL ".join(
    f"SELECT 'e{a}' AS a, 'e{b}' AS b, CAST(count(*) AS BIGINT) AS n, avg(e{a}*e{b}) AS mean_product, corr(e{a}, e{b}) AS corr FROM e4"
    for a in range(1, 5) for b in range(a, 5)) + ")"


def four_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = forecasts(spark, sf)
    return d.select(*K, *[(F.col(m) - F.col("value")).alias(f"e{i + 1}") for i, m in enumerate(METHODS)])


@query("a23_gram_error_correlation", f"WITH {ERRS_SQL}, {GRAM_SQL} SELECT {sql_shown(['a', 'b', 'n'], ['mean_product', 'corr'])} FROM g")
def error_correlation(spark: SparkSession, sf: str) -> DataFrame:
    g = M.error_correlation(M.gram(four_errors(spark, sf), ["e1", "e2", "e3", "e4"]))
    return shown(g, ["a", "b", "n"], ["mean_product", "corr"])


WEIGHTS = [i * 0.025 for i in range(25)]


@query("d37_blend_weight_scan", f"""WITH {ERRS_SQL} SELECT {sql_rounded('w.i * 0.025')} AS weight, {sql_rounded('sqrt(avg(pow((1 - w.i * 0.025::DOUBLE) * e1 + w.i * 0.025::DOUBLE * e3, 2)))')} AS rmse
FROM e4 CROSS JOIN (SELECT unnest(generate_series(0, 24)) AS i) w GROUP BY w.i""")
def blend_scan(spark: SparkSession, sf: str) -> DataFrame:
    """25 weights from 0 to 0.6 out of one pass of pairwise sums."""
    d = M.blend_scan(M.gram(four_errors(spark, sf), ["e1", "e2", "e3", "e4"]), "e1", "e3", WEIGHTS)
    return shown(d, [], ["weight", "rmse"])


PRIOR = ["len_mu", "len_sigma", "len_median", "len_p10", "len_p90", "rate_std", "rate_p99_abs", "rate_change_mad"]


@query("a24_segment_prior", f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, row_idx, x - lag(x) OVER w AS len, (value - lag(value) OVER w) / (1 + x - lag(x) OVER w) AS rate FROM seq WINDOW w AS ({WIN})),
t AS (SELECT *, rate - lag(rate) OVER (PARTITION BY user_id ORDER BY row_idx) AS dr FROM s), u AS (SELECT * FROM t WHERE len IS NOT NULL), m AS (SELECT quantile_cont(dr, 0.5) AS dm FROM u)
SELECT CAST(count(*) AS BIGINT) AS n_segments, {sql_rounded('avg(ln(greatest(len, 2)))')} AS len_mu, {sql_rounded('stddev_pop(ln(greatest(len, 2)))')} AS len_sigma, {sql_rounded('exp(quantile_cont(ln(greatest(len, 2)), 0.5))')} AS len_median,
 {sql_rounded('quantile_cont(len, 0.1)')} AS len_p10, {sql_rounded('quantile_cont(len, 0.9)')} AS len_p90, {sql_rounded('stddev_pop(rate)')} AS rate_std,
 {sql_rounded('quantile_cont(abs(rate), 0.99)')} AS rate_p99_abs, {sql_rounded('1.4826 * quantile_cont(abs(dr - dm), 0.5)')} AS rate_change_mad FROM u CROSS JOIN m""")
def segment_prior(spark: SparkSession, sf: str) -> DataFrame:
    """Every step between two events plays a segment."""
    rate = lambda w, t: (F.lag("value", t).over(w) - F.lag("value", t + 1).over(w)) / (1 + F.lag("x", t).over(w) - F.lag("x", t + 1).over(w))
    d = framed(event_log(spark, sf), U, 2, 0, lambda w: {"len": F.col("x") - F.lag("x").over(w), "rate": rate(w, 0), "_before": rate(w, 1)})
    d = cut_lineage(d.where(F.col("len").isNotNull()).select("len", "rate", (F.col("rate") - F.col("_before")).alias("dr")))
    return shown(M.lognormal_prior(d, "len", "rate", "dr", 2.0), ["n_segments"], PRIOR)


@query("a25_quartile_cohorts_by_value", f"""WITH {FC_SQL}{TRAIT_SQL}, r AS (SELECT * FROM tr JOIN g1 USING (user_id)), e AS (SELECT quantile_cont(drift_end, 0.25) AS q1, quantile_cont(drift_end, 0.5) AS q2, quantile_cont(drift_end, 0.75) AS q3 FROM r)
SELECT CAST((drift_end > q1)::INT + (drift_end > q2)::INT + (drift_end > q3)::INT AS INTEGER) AS quartile, CAST(count(*) AS BIGINT) AS n, {sql_rounded('avg(rmse)')} AS mean_rmse FROM r CROSS JOIN e GROUP BY 1""")
def cohorts_by_value(spark: SparkSession, sf: str) -> DataFrame:
    d = M.quartile_edges(rated_traits(spark, sf).drop("n"), "drift_end", "quartile").groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rmse").alias("mean_rmse"))
    return shown(d, ["quartile", "n"], ["mean_rmse"])


@query("a25_quartile_cohorts_by_rank", f"""WITH {FC_SQL}{TRAIT_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY eval_len, user_id) - 1 AS k, count(*) OVER () - 1 AS m FROM tr JOIN g1 USING (user_id))
SELECT CAST((k > m * 0.25)::INT + (k > m * 0.5)::INT + (k > m * 0.75)::INT AS INTEGER) AS quartile, CAST(count(*) AS BIGINT) AS n, {sql_rounded('avg(rmse)')} AS mean_rmse FROM r GROUP BY 1""")
def cohorts_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = M.quartile_ranks(rated_traits(spark, sf).drop("n"), "eval_len", "user_id", "quartile").groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rmse").alias("mean_rmse"))
    return shown(d, ["quartile", "n"], ["mean_rmse"])


@query("a26_distinct_groups", "SELECT DISTINCT user_id FROM events ORDER BY user_id")
def distinct_groups(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("user_id").distinct().orderBy("user_id")


# --- top-k, ranks, sets ------------------------------------------------------------------------------------------


@query("k1_top_rows", f"WITH {FC_SQL} SELECT user_id, method, {sql_rounded('rmse')} AS rmse FROM (SELECT * FROM gm ORDER BY rmse, user_id, method LIMIT 10)")
def top_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best (group, method) scores."""
    return shown(M.group_rmse(errors(spark, sf), ["user_id", "method"]).orderBy("rmse", "user_id", "method").limit(10), ["user_id", "method"], ["rmse"])


@query("k3_best_and_second", f"""WITH {FC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rmse, method) AS k FROM gm)
SELECT user_id, max(method) FILTER (k = 1) AS best_name, {sql_rounded('max(rmse) FILTER (k = 1)')} AS best_score, {sql_rounded('max(rmse) FILTER (k = 2)')} AS second_score FROM r GROUP BY user_id""")
def best_second(spark: SparkSession, sf: str) -> DataFrame:
    d = M.best_and_second(M.group_rmse(errors(spark, sf), ["user_id", "method"]), U, "method", "rmse")
    return shown(d, ["user_id", "best_name"], ["best_score", "second_score"])


@query("k4_dedup_keep_best", """SELECT l_partkey, qbin, l_orderkey, l_linenumber FROM (SELECT *, CAST(round(2 * l_discount * 10) AS BIGINT) AS qbin FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_partkey, qbin ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""")
def dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    """Per (group, binned key) the row with the highest score; a partial maximum is taken before the shuffle."""
    d = table(spark, sf, "lineitem").withColumn("qbin", F.round(F.col("l_discount") * 2 * 10).cast("long"))
    best = d.groupBy("l_partkey", "qbin").agg(
        F.max_by(F.struct("l_orderkey", "l_linenumber"), F.struct(F.col("l_extendedprice"), -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("r"))
    return best.select("l_partkey", "qbin", "r.l_orderkey", "r.l_linenumber")


@query("u1_union_of_frames", f"""SELECT k, kind, {sql_rounded('v')} AS v FROM (SELECT c_custkey AS k, 'customer' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier)""")
def union_frames(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("v"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return shown(a.unionByName(b), ["k", "kind"], ["v"])


@query("u2_candidate_pool", f"""WITH {FC_SQL}, c AS (SELECT user_id, method, count(error) AS n FROM er GROUP BY user_id, method), s AS (SELECT user_id, count(*) AS rows_in_group FROM seq GROUP BY user_id)
SELECT user_id, method, CAST(n AS BIGINT) AS n FROM c JOIN s USING (user_id) WHERE n >= greatest(20, rows_in_group // 20)""")
def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Long candidates (group, row, name, prediction); a candidate stays when enough of its values are finite."""
    fc = forecasts(spark, sf)
    parts = [fc.select("user_id", "n_rows", F.lit(m).alias("method"), F.col(m).alias("pred")) for m in METHODS]
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    d = pool.groupBy("user_id", "method").agg(F.count("pred").alias("n"), F.max("n_rows").alias("rows_in_group"))
    return d.where(F.col("n") >= F.greatest(F.lit(20).cast("long"), F.floor(F.col("rows_in_group") / 20))).select("user_id", "method", "n")


@query("u3_set_difference", """SELECT doc_id, 'unlabelled' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'both' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return a.exceptAll(b).distinct().withColumn("side", F.lit("unlabelled")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))
