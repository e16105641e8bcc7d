"""The pool of candidates in the prefix backtest, on the supplier log.

Per (supplier, cut) only the prefix is seen: polynomials of its tails, the line of all other suppliers (surface) and their mean
of the same month (dense), both moved to the prefix, and the price calibrated by quantity (contact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.operators import guard as G
from bedtrace.plans.bindings import PARTS_SQL, part_log
from bedtrace.plans.registry import query, rounded, shown, sql_rounded, sql_shown
from bedtrace.plans.sql_ridge import sql_moments, sql_prediction, sql_solved
from bedtrace.session import cut_lineage

CUTS = [0.55, 0.70, 0.84]
TAILS, DEGREES = [40, 80, None], [1, 2]
REPORT = ["best_score", "second_score", "default_score", "gain", "rank_margin", "consistency"]
CALIBRATED = "contact_qty"


def pool(spark: SparkSession, sf: str, finite: bool = False) -> DataFrame:
    """Holdout error of every candidate per (supplier, cut). Only known rows are learned from and judged."""
    log = part_log(spark, sf).where("known").select("well", "x", "row_idx", "known", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias(CALIBRATED))
    log = cut_lineage(log).withColumn("month", F.floor(F.col("x") / 30))
    log = G.others_mean(log, "well", ["month"], "price", "dense_month")
    log = G.others_line(cut_lineage(log), "well", "x", "price", "surface_line")
    return G.pool_errors(log, "well", "known", "x", "price", CUTS, ["dense_month", "surface_line"], [CALIBRATED], TAILS, DEGREES, finite)


def poly_sql() -> str:
    ctes, rows = [], []
    for t in TAILS:
        for g in DEGREES:
            n = f"p{g}_{t or 'all'}"
            cols = ["u", "u * u"][:g]
            tail = f"WHERE row_idx >= ap - {t}" if t else ""
            ctes += [f"{n}r AS (SELECT well, cut, price, (x - x0) / span AS u FROM pre JOIN (SELECT well, cut, min(x) AS x0, max(x) - min(x) AS span FROM pre {tail} GROUP BY ALL) USING (well, cut) {tail})",
                     f"{n}s AS (SELECT well, cut, min(x) AS x0, max(x) - min(x) AS span FROM pre {tail} GROUP BY ALL)",
                     sql_moments(cols, "price", f"{n}r", "well, cut", f"{n}m"), *sql_solved(range(g), g, [0.0], "well, cut", f"{n}m", f"{n}f")]
            name = f"poly_{g}_tail{t or 'all'}"
            value = sql_prediction(["(x - x0) / span", "pow((x - x0) / span, 2)"][:g])
            rows.append(f"SELECT well, cut, row_idx, price, '{name}' AS name, {value} AS pred FROM ho JOIN {n}f USING (well, cut) JOIN {n}m USING (well, cut) JOIN {n}s USING (well, cut)")
    return ", ".join(ctes) + f", poly AS ({' UNION ALL '.join(rows)})"


POOL_SQL = f"""{PARTS_SQL}, lg AS (SELECT well, x, row_idx, known, CAST(price AS DOUBLE) AS price, CAST(qty AS DOUBLE) AS q, floor(x / 30) AS month FROM plog),
om AS (SELECT well, month, sum(price) AS s, count(*) AS c FROM lg WHERE known GROUP BY ALL), am AS (SELECT month, sum(s) AS ts, sum(c) AS tc FROM om GROUP BY month),
ol AS (SELECT w.well, regr_slope(lg.price, lg.x) AS la, avg(lg.price) AS lmy, avg(lg.x) AS lmx FROM (SELECT DISTINCT well FROM lg) w JOIN lg ON lg.well <> w.well WHERE lg.known GROUP BY w.well),
fe AS (SELECT lg.*, CASE WHEN tc > coalesce(c, 0) THEN (ts - coalesce(s, 0)) / (tc - coalesce(c, 0)) END AS dense, lmy + la * (x - lmx) AS surf FROM lg LEFT JOIN am USING (month) LEFT JOIN om USING (well, month) LEFT JOIN ol USING (well)),
kc AS (SELECT s.*, c.cut, greatest(50, least(CAST(round_even(n * c.cut, 0) AS BIGINT), n - 35)) AS ap FROM (SELECT *, count(*) OVER (PARTITION BY well) AS n FROM fe WHERE known) s CROSS JOIN (SELECT unnest({CUTS}::DOUBLE[]) AS cut) c WHERE n >= 140),
pre AS (SELECT * FROM kc WHERE row_idx < ap), ho AS (SELECT * FROM kc WHERE row_idx >= ap),
ft AS (SELECT well, cut, arg_max(price, row_idx) AS l, avg(price) AS m, avg(price - dense) AS sd, avg(price - surf) AS ss, regr_slope(price, q) AS qa, regr_intercept(price, q) AS qb FROM pre GROUP BY well, cut),
one AS (SELECT well, cut, row_idx, price, unnest([{{'n': 'last', 'p': l}}, {{'n': 'mean', 'p': m}}, {{'n': 'dense_month', 'p': dense + sd}}, {{'n': 'surface_line', 'p': surf + ss}}, {{'n': '{CALIBRATED}', 'p': qa * q + qb}}]) AS c FROM ho JOIN ft USING (well, cut)),
{poly_sql()}, every AS (SELECT well, cut, row_idx, price, c.n AS name, c.p AS pred FROM one UNION ALL SELECT * FROM poly),
pr AS (SELECT * FROM every QUALIFY count(pred) OVER (PARTITION BY well, cut, name) >= 20),
pc AS (SELECT well, cut, name, sqrt(avg(pow(pred - price, 2))) AS err FROM pr GROUP BY ALL),
sc AS (SELECT well, name, quantile_cont(err, 0.5) + 0.1 * stddev_pop(err) AS score, row_number() OVER (PARTITION BY well ORDER BY quantile_cont(err, 0.5) + 0.1 * stddev_pop(err), name) AS k FROM pc GROUP BY well, name),
bs AS (SELECT well, CAST(count(*) AS BIGINT) AS candidate_count, max(name) FILTER (k = 1) AS best_name, max(score) FILTER (k = 1) AS best_score, max(score) FILTER (k = 2) AS second_score, max(score) FILTER (name = 'last') AS default_score FROM sc GROUP BY well),
cn AS (SELECT well, CAST(count(*) AS BIGINT) AS cuts, avg(CASE WHEN b <= d - 0.25 THEN 1.0::DOUBLE ELSE 0 END) AS consistency FROM (SELECT well, cut, min(err) AS b, max(err) FILTER (name = 'last') AS d FROM pc GROUP BY well, cut) GROUP BY well),
rep AS (SELECT *, default_score - best_score AS gain, second_score - best_score AS rank_margin FROM bs JOIN cn USING (well))"""


@query("d23_pool_errors", f"WITH {POOL_SQL} SELECT well, name, {sql_rounded('cut')} AS cut, {sql_rounded('err', 3)} AS err FROM pc")
def pool_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Holdout error of every candidate of the pool per (supplier, cut)."""
    d = pool(spark, sf)
    return d.select("well", "name", rounded(F.col("cut")).alias("cut"), rounded(F.col("err"), 3).alias("err"))


@query("d23_pool_backtest", f"WITH {POOL_SQL} SELECT {sql_shown(['well', 'cuts', 'candidate_count', 'best_name'], REPORT, 3)} FROM rep")
def pool_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return shown(G.error_report(cut_lineage(pool(spark, sf, finite=True)), "well", "last")[0], ["well", "cuts", "candidate_count", "best_name"], REPORT, 3)
