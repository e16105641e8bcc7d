"""Queries over the stored layout of the event log: same results as the plain ones, without numbering or exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.operators import interp as I
from bedtrace.operators.cells import centred
from bedtrace.plans.bindings import EVENTS_SQL, events
from bedtrace.plans.q_interp import curve_of
from bedtrace.plans.q_sequence import STEPS, W1, W1_OUT, W4_OUT
from bedtrace.plans.registry import REGISTRY, query, shown, sql_shown
from bedtrace.session import shared_folder
from bedtrace.sources import layout

K = ["user_id", "row_idx"]


def files_of(spark: SparkSession, path: str) -> dict[str, object]:
    """Names, sizes and times of the files of a table: its version."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return {"files": sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(p))}


def stored_events(spark: SparkSession, sf: str) -> tuple[layout.StoredLog, dict[str, object]]:
    version = files_of(spark, f"{sf}/events.parquet")
    views = {"views": layout.Curve(curve_of(spark, sf), "cx", "cy")}
    root = shared_folder(spark, "bedtrace_logs")
    return layout.store_log(events(spark, sf), root, version, ["user_id"], ["x", "event_id"], "x", curves=views), version


@query("w1_stored_rolling", REGISTRY["w1_rolling_mean"].sql)
def stored_rolling(spark: SparkSession, sf: str) -> DataFrame:
    half = (max(W1) - 1) // 2
    d = stored_events(spark, sf)[0].framed(half, half, lambda w: {f"sig_mean{n}": F.avg("sig").over(centred(w, n)) for n in W1}, K)
    return shown(d, K, W1_OUT)


@query("w4_stored_lags", REGISTRY["w4_lag_lead_filled"].sql)
def stored_lags(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of a frame that stops at the ends of the group is the row ``s`` before, or the first one."""
    def build(w):
        return {f"v_lag{s}": F.first("value").over(w.rowsBetween(-s, 0)) for s in STEPS} | {
            f"v_lead{s}": F.last("value").over(w.rowsBetween(0, s)) for s in STEPS}

    return shown(stored_events(spark, sf)[0].framed(max(STEPS), max(STEPS), build, K), K, W4_OUT)


@query("j1_stored_features", f"""WITH {EVENTS_SQL} SELECT {sql_shown(['user_id', 'row_idx', 'event_type'], ['value', 'before', 'energy'])} FROM (
 SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY row_idx) AS before,
 sqrt(avg(sig * sig) OVER (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS energy FROM seq)""")
def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored feature tables joined to their log, in the buckets of the log."""
    log, version = stored_events(spark, sf)
    before = log.framed(1, 0, lambda w: {"before": F.lag("value").over(w)}, K).drop("_cell")
    energy = log.framed(10, 10, lambda w: {"energy": F.sqrt(F.avg(F.col("sig") * F.col("sig")).over(centred(w, 21)))}, K).drop("_cell")
    tables = [layout.store_features(log, f, version) for f in (before, energy)]
    return shown(layout.with_features(log, *tables), ["user_id", "row_idx", "event_type"], ["value", "before", "energy"])


@query("j4_stored_interp", REGISTRY["j4_interp_join"].sql)
def stored_interp(spark: SparkSession, sf: str) -> DataFrame:
    log, _ = stored_events(spark, sf)
    x = F.col("x")
    d = layout.bracketed(log, "views", "x", ["event_id", "event_type"]).where(F.col("event_type") == "click").withColumns({
        "held": I.interpolated(x), "inside": I.interpolated(x, "null"), "marked": I.interpolated(x, "const", -1.0, -2.0)})
    return shown(d, ["user_id", "event_id"], ["held", "inside", "marked"])
