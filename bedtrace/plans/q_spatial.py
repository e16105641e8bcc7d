"""Queries over the spatial bank (``embeddings``): nearest neighbours, surfaces, banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.operators import spatial as S
from bedtrace.operators.cells import index_rows
from bedtrace.operators.quantiles import grouped_quantiles
from bedtrace.operators.sequence import even_sample
from bedtrace.plans.bindings import BANK_SQL, PARTS_SQL, bank, part_log
from bedtrace.plans.registry import query, shown, sql_rounded, sql_shown


def knn_sql(k: int, sx: str = "sx", sy: str = "sy", b: str = "bank", cond: str = "b.owner <> q.owner", q: str = "bank", xcol: str = "") -> str:
    return f"""{BANK_SQL}, sc AS (SELECT CASE WHEN stddev_pop(px) < 1e-3 THEN 1 ELSE stddev_pop(px) END AS sx,
 CASE WHEN stddev_pop(py) < 1e-3 THEN 1 ELSE stddev_pop(py) END AS sy FROM bank){xcol},
nb AS (SELECT * FROM (SELECT q.pid, q.px AS qx, q.py AS qy, b.pid AS nid, b.owner AS nowner, b.px AS bx, b.py AS byy, b.pz AS bz,
  sqrt(pow(q.px/{sx} - b.px/{sx}, 2) + pow(q.py/{sy} - b.py/{sy}, 2)) AS dist FROM {q} q CROSS JOIN sc JOIN {b} b ON {cond})
 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, nid) <= {k})"""


def neighbours(spark: SparkSession, sf: str, k: int, scaled: bool = True, leaf: int = S.LEAF) -> DataFrame:
    b = bank(spark, sf)
    return S.knn_join(b, b, k, ["pid"], ("px", "py"), ("px", "py"), "pid", "owner", "owner", ["pz"], scaled=scaled, leaf=leaf)


@query("k2_knn_rows", f"WITH {knn_sql(10)} SELECT pid, nid AS nb_id, CAST(row_number() OVER (PARTITION BY pid ORDER BY dist, nid) AS INTEGER) AS rank, {sql_rounded('dist')} AS dist FROM nb")
def knn_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest foreign points of every point."""
    return shown(neighbours(spark, sf, 10), ["pid", "nb_id", "rank"], ["dist"])


@query("j10_plane_bank", f"""WITH {BANK_SQL}, med AS (SELECT owner, quantile_cont(px, 0.5) AS px, quantile_cont(py, 0.5) AS py, quantile_cont(pz, 0.5) AS pz FROM bank GROUP BY owner),
sc AS (SELECT stddev_pop(px) AS sx, stddev_pop(py) AS sy FROM med),
nb AS (SELECT * FROM (SELECT q.pid, m.owner, m.px - q.px AS u, m.py - q.py AS v, m.pz AS z, sqrt(pow((q.px - m.px)/sx, 2) + pow((q.py - m.py)/sy, 2)) AS dist
 FROM bank q CROSS JOIN sc JOIN med m ON m.owner <> q.owner) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, owner) <= 10),
s AS (SELECT pid, min(dist) AS nearest, sum(w) + 1e-9 AS ww, sum(w*u) AS wu, sum(w*v) AS wv, sum(w*u*u) + 1e-9 AS uu, sum(w*u*v) AS uv, sum(w*v*v) + 1e-9 AS vv,
 sum(w*z) AS z, sum(w*u*z) AS zu, sum(w*v*z) AS zv FROM (SELECT *, 1/(dist + 1e-3) AS w FROM nb) GROUP BY pid)
SELECT pid, {sql_rounded('(uu*(vv*z-wv*zv) - uv*(uv*z-wv*zu) + wu*(uv*zv-vv*zu)) / (uu*(vv*ww-wv*wv) - uv*(uv*ww-wv*wu) + wu*(uv*wv-vv*wu))')} AS surface,
 {sql_rounded('nearest')} AS nearest FROM s""")
def plane_bank(spark: SparkSession, sf: str) -> DataFrame:
    """One median point per owner, ten nearest foreign owners, weighted plane at the query (also a18)."""
    b = bank(spark, sf)
    med = S.group_medians(b, "owner", ["px", "py", "pz"])
    nb = S.knn_join(b, med, 10, ["pid"], ("px", "py"), ("px", "py"), "owner", "owner", "owner", ["pz"])
    w = 1 / (F.col("dist") + 1e-3)
    fit = S.plane_fit(nb, ["pid"], ["pz"], w).join(nb.groupBy("pid").agg(F.min("dist").alias("nearest")), "pid")
    return shown(fit.withColumnRenamed("pz", "surface"), ["pid"], ["surface", "nearest"])


@query("a18_plane_fit", f"""WITH {knn_sql(20)}, s AS (SELECT pid, sum(w) + 1e-9 AS ww, sum(w*u) AS wu, sum(w*v) AS wv, sum(w*u*u) + 1e-9 AS uu, sum(w*u*v) AS uv, sum(w*v*v) + 1e-9 AS vv,
 sum(w*z) AS z, sum(w*u*z) AS zu, sum(w*v*z) AS zv FROM (SELECT pid, bx - qx AS u, byy - qy AS v, bz AS z, 1/(dist + 1e-3) AS w FROM nb) GROUP BY pid)
SELECT pid, {sql_rounded('(uu*(vv*z-wv*zv) - uv*(uv*z-wv*zu) + wu*(uv*zv-vv*zu)) / (uu*(vv*ww-wv*wv) - uv*(uv*ww-wv*wu) + wu*(uv*wv-vv*wu))')} AS surface FROM s""")
def plane(spark: SparkSession, sf: str) -> DataFrame:
    fit = S.plane_fit(neighbours(spark, sf, 20), ["pid"], ["pz"], 1 / (F.col("dist") + 1e-3))
    return shown(fit.withColumnRenamed("pz", "surface"), ["pid"], ["surface"])


@query("j11_dense_bank_idw", f"""WITH {knn_sql(20)}, m AS (SELECT *, sum(bz/(dist+1e-3)) OVER w / sum(1/(dist+1e-3)) OVER w AS idw FROM nb WINDOW w AS (PARTITION BY pid))
SELECT pid, {sql_rounded('max(idw)')} AS idw, {sql_rounded('sqrt(sum(pow(bz-idw,2)/(dist+1e-3))/sum(1/(dist+1e-3)))')} AS idw_std, {sql_rounded('min(dist)')} AS nearest FROM m GROUP BY pid""")
def dense_bank(spark: SparkSession, sf: str) -> DataFrame:
    d = S.idw(neighbours(spark, sf, 20), ["pid"], "pz", 1 / (F.col("dist") + 1e-3))
    return shown(d, ["pid"], ["idw", "idw_std", "nearest"])


@query("j12_fold_safe_surfaces", f"""WITH {BANK_SQL}, bk AS (SELECT surface, fold, pid, owner, px, py, z FROM (
 SELECT 0 AS surface, pid, owner, px, py, pz AS z FROM bank UNION ALL SELECT 1, vec_id, label, embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[4]::DOUBLE FROM embeddings) b
 JOIN (SELECT unnest(generate_series(0, 4)) AS fold) f ON b.owner % 5 <> f.fold),
sc AS (SELECT surface, fold, stddev_pop(px) AS sx, stddev_pop(py) AS sy FROM bk GROUP BY surface, fold),
nb AS (SELECT * FROM (SELECT q.pid, b.surface, b.fold, b.z, b.pid AS nid, sqrt(pow(q.px/sx - b.px/sx, 2) + pow(q.py/sy - b.py/sy, 2)) AS dist
 FROM bank q JOIN bk b ON q.owner <> b.owner JOIN sc USING (surface, fold)) QUALIFY row_number() OVER (PARTITION BY pid, surface, fold ORDER BY dist, nid) <= 20)
SELECT pid, surface, CAST(fold AS INTEGER) AS fold, {sql_rounded('sum(z/(dist+1e-3))/sum(1/(dist+1e-3))')} AS idw, {sql_rounded('min(dist)')} AS nearest FROM nb GROUP BY pid, surface, fold""")
def fold_safe(spark: SparkSession, sf: str) -> DataFrame:
    """Two surfaces, five folds: the bank of a fold holds only owners outside it, for every query row."""
    e = F.col("embedding")
    b = bank(spark, sf).join(spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("pid"), e[3].cast("double").alias("pw")), "pid")
    both = b.select("pid", "owner", "px", "py", F.explode(F.array(
        F.struct(F.lit(0).alias("surface"), F.col("pz").alias("z")), F.struct(F.lit(1).alias("surface"), F.col("pw").alias("z")))).alias("s"))
    folds = F.explode(F.sequence(F.lit(0), F.lit(4)))
    banks = both.select("pid", "owner", "px", "py", "s.*", folds.alias("fold")).where(F.col("owner") % 5 != F.col("fold"))
    asks = b.select("pid", "owner", "px", "py", folds.alias("fold"), F.lit(0).alias("surface"))
    asks = asks.unionByName(asks.withColumn("surface", F.lit(1)))
    nb = S.knn_join(asks, banks, 20, ["pid"], ("px", "py"), ("px", "py"), "pid", "owner", "owner", ["z"], ["surface", "fold"])
    d = S.idw(nb, ["pid", "surface", "fold"], "z", 1 / (F.col("dist") + 1e-3))
    return shown(d, ["pid", "surface", "fold"], ["idw", "nearest"])


@query("j13_neighbour_curve", f"""WITH {knn_sql(12, '1', '1')}, u AS (SELECT pid, sum(bz/pow(greatest(dist,0.001),2))/sum(1/pow(greatest(dist,0.001),2)) AS u, min(dist) AS nearest FROM nb GROUP BY pid),
r AS (SELECT b.pid, b.owner, b.pz, u.u, u.nearest, CASE WHEN b.pid % 3 = 0 THEN b.pz - u.u END AS diff FROM bank b JOIN u USING (pid)),
g AS (SELECT owner, quantile_cont(nearest, 0.5) AS gate, quantile_cont(diff, 0.5) AS off, count(diff) AS k FROM r GROUP BY owner)
SELECT pid, owner, {sql_rounded('u - pz + off')} AS neighbour_pred FROM r JOIN g USING (owner) WHERE k >= 5 AND gate <= 600""")
def neighbour_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse-square transfer on unscaled axes; every third point counts as known. The axes span less than 1, so the
    distance floor of the weights is 0.001 here instead of 1."""
    b = bank(spark, sf)
    nb = neighbours(spark, sf, 12, scaled=False)
    known = F.when(F.col("pid") % 3 == 0, F.col("pz"))
    nb = nb.withColumnRenamed("pz", "nb_z")
    d = S.neighbour_curve(b, nb, "owner", ["pid"], "nb_z", "pz", known, 600.0, 5, floor=0.001)
    return shown(d, ["pid", "owner"], ["neighbour_pred"])


@query("j14_enriched_bank", f"""WITH {BANK_SQL}, a AS (SELECT * FROM bank WHERE owner % 2 = 0),
pn AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY pid) - 1 AS p, count(*) OVER (PARTITION BY owner) AS n FROM bank WHERE owner % 2 = 1),
pk AS (SELECT DISTINCT owner, CAST(floor(j * ((n-1)::DOUBLE / (least(40, n) - 1))) AS BIGINT) AS p FROM (SELECT DISTINCT owner, n FROM pn) CROSS JOIN (SELECT unnest(generate_series(0, 39)) AS j) WHERE j < least(40, n)),
b2 AS (SELECT pid, owner, px, py, pz FROM a UNION ALL SELECT pid, owner, px, py, pz FROM pn JOIN pk USING (owner, p)),
nb AS (SELECT * FROM (SELECT q.pid, b.pz AS bz, b.pid AS nid, sqrt(pow(q.px - b.px, 2) + pow(q.py - b.py, 2)) AS dist FROM bank q JOIN b2 b ON b.owner <> q.owner)
 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, nid) <= 20)
SELECT pid, {sql_rounded('sum(bz/(dist+1e-3))/sum(1/(dist+1e-3))')} AS idw, {sql_rounded('min(dist)')} AS nearest FROM nb GROUP BY pid""")
def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Bank of one half of the owners plus at most 40 evenly spaced points of every other owner."""
    b = bank(spark, sf)
    extra = index_rows(b.where("owner % 2 = 1").withColumn("axis", F.col("pid").cast("double")), ["owner"], ["pid"], "axis")
    both = b.where("owner % 2 = 0").unionByName(even_sample(extra, ["owner"], 40).select(*b.columns))
    nb = S.knn_join(b, both, 20, ["pid"], ("px", "py"), ("px", "py"), "pid", "owner", "owner", ["pz"], scaled=False)
    return shown(S.idw(nb, ["pid"], "pz", 1 / (F.col("dist") + 1e-3)), ["pid"], ["idw", "nearest"])


@query("j18_even_sample", f"""WITH {PARTS_SQL}, g AS (SELECT well, max(n_rows) AS n FROM plog GROUP BY well),
pk AS (SELECT DISTINCT well, CAST(floor(j * ((n-1)::DOUBLE / (least(60, n) - 1))) AS BIGINT) AS row_idx FROM g CROSS JOIN (SELECT unnest(generate_series(0, 59)) AS j) WHERE j < least(60, n))
SELECT well, row_idx, {sql_rounded('price')} AS price FROM plog JOIN pk USING (well, row_idx)""")
def even(spark: SparkSession, sf: str) -> DataFrame:
    return shown(even_sample(part_log(spark, sf), ["well"], 60), ["well", "row_idx"], ["price"])


@query("d2_surface_anchored", f"""WITH {knn_sql(20)}, u AS (SELECT pid, sum(bz/(dist+1e-3))/sum(1/(dist+1e-3)) AS s FROM nb GROUP BY pid),
r AS (SELECT b.pid, b.owner, b.px AS z, u.s, b.pid % 3 = 0 AS known, b.py + b.px - u.s AS bw FROM bank b JOIN u USING (pid)),
o AS (SELECT owner, quantile_cont(bw, 0.5) FILTER (known) AS off, stddev_pop(bw) FILTER (known) AS spread FROM r GROUP BY owner)
SELECT pid, owner, {sql_rounded('-z + s + off')} AS anchored, {sql_rounded('spread')} AS spread FROM r JOIN o USING (owner)""")
def surface_anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction -z + surface + median known offset, per owner (here z = x axis, target = y axis)."""
    b = bank(spark, sf)
    u = S.idw(neighbours(spark, sf, 20), ["pid"], "pz", 1 / (F.col("dist") + 1e-3))
    r = b.join(u, "pid").withColumn("bw", F.when(F.col("pid") % 3 == 0, F.col("py") + F.col("px") - F.col("idw")))
    off = grouped_quantiles(r, ["owner"], {"off": (F.col("bw"), 0.5)}).join(r.groupBy("owner").agg(F.stddev_pop("bw").alias("spread")), "owner")
    d = r.join(off, "owner").withColumn("anchored", -F.col("px") + F.col("idw") + F.col("off"))
    return shown(d, ["pid", "owner"], ["anchored", "spread"])


@query("d3_dense_anchored", f"""WITH {knn_sql(20)}, m AS (SELECT *, sum(bz/(dist+1e-3)) OVER w / sum(1/(dist+1e-3)) OVER w AS s FROM nb WINDOW w AS (PARTITION BY pid)),
u AS (SELECT pid, max(s) AS s, sqrt(sum(pow(bz-s,2)/(dist+1e-3))/sum(1/(dist+1e-3))) AS sd FROM m GROUP BY pid),
r AS (SELECT b.pid, b.owner, b.px AS z, b.py AS y, u.s, u.sd, b.pid % 3 = 0 AS known, b.py + b.px - u.s AS bw FROM bank b JOIN u USING (pid)),
o AS (SELECT owner, quantile_cont(bw, 0.5) AS off, avg(sd) AS nb_std FROM r WHERE known GROUP BY owner)
SELECT owner, {sql_rounded('any_value(off)')} AS off, {sql_rounded('any_value(nb_std)')} AS nb_std, {sql_rounded('sqrt(avg(pow(-z + s + off - y, 2)))')} AS known_rmse,
 {sql_rounded('avg(-z + s + off - y)')} AS known_bias FROM r JOIN o USING (owner) WHERE known GROUP BY owner""")
def dense_anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Known-zone error, bias and neighbour spread of the anchored dense surface, per owner."""
    b = bank(spark, sf)
    u = S.idw(neighbours(spark, sf, 20), ["pid"], "pz", 1 / (F.col("dist") + 1e-3))
    r = b.where("pid % 3 = 0").join(u, "pid").withColumn("bw", F.col("py") + F.col("px") - F.col("idw"))
    off = grouped_quantiles(r, ["owner"], {"off": (F.col("bw"), 0.5)})
    e = -F.col("px") + F.col("idw") + F.col("off") - F.col("py")
    d = r.join(off, "owner").groupBy("owner").agg(
        F.max("off").alias("off"), F.avg("idw_std").alias("nb_std"), F.sqrt(F.avg(e * e)).alias("known_rmse"), F.avg(e).alias("known_bias"))
    return shown(d, ["owner"], ["off", "nb_std", "known_rmse", "known_bias"])
