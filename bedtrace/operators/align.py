"""Aligning a log to its curve: window matching, shift scans, shared curves. Decoders are in ``decode``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.operators.cells import framed, with_group_stats
from bedtrace.operators.sequence import rolling
from bedtrace.session import bounded_batches, cut_lineage

BLOCK = 4096
OUT_ROWS = 1 << 15


def _normalised(m: np.ndarray) -> np.ndarray:
    return (m - m.mean(1, keepdims=True)) / (m.std(1, keepdims=True) + 1e-6)


def window_match(
    known: DataFrame, evals: DataFrame, group: str, signal: str, value: str, half: int, stride: int = 3,
    pos: str = "row_idx", block: int = BLOCK, smooth: int = 5,
) -> DataFrame:
    """Best known window (normalised correlation) for the window around every withheld row, every ``stride``-th start.

    Both frames count their own rows from 0 in ``pos``. Each side is packed into blocks of plain values with ``half`` rows
    of its neighbours; windows exist only inside a task. A known block meets the withheld blocks of its group, a tile
    returns one candidate per withheld row, so no pair and no window is ever written and no task sees a whole group.
    Returns ``(group, pos, match_value, match_score)``; equal scores resolve to the earliest known window. Both
    signals are first averaged over ``smooth`` rows. A group whose known part is too short for a window and one more row
    gets its last known value with score 0.
    """
    sizes = known.groupBy(group).agg((F.max(pos) + 1).alias("_rows"), F.max_by(value, pos).cast("double").alias("_held"))
    sizes = cut_lineage(sizes)
    fits = F.col("_rows") >= 2 * half + 2
    short = evals.select(group, pos).join(sizes.where(~fits), group).select(group, pos, F.col("_held").alias("match_value"), F.lit(0.0).alias("match_score"))
    known = known.select(group, pos, signal, value).join(sizes.where(fits).select(group), group, "left_semi")
    evals = evals.select(group, pos, signal).join(sizes.where(fits).select(group), group, "left_semi")
    if smooth > 1:
        name = f"_s_mean{smooth}"
        known = rolling(known, [group], signal, [smooth], ["mean"], "_s", pos=pos).withColumn(signal, F.col(name)).drop(name)
        evals = rolling(evals, [group], signal, [smooth], ["mean"], "_s", pos=pos).withColumn(signal, F.col(name)).drop(name)
    span, wide = block * stride, 2 * half
    first, last = F.greatest(F.lit(0), F.floor((F.col(pos) - wide) / span)).cast("int"), F.floor(F.col(pos) / span).cast("int")
    k = known.select(group, F.col(pos).alias("p"), F.col(signal).cast("double").alias("v"), F.col(value).cast("double").alias("w")).withColumnRenamed("p", pos)
    k = with_group_stats(k, [group], {"k_last": F.max(pos)}).withColumn("kb", F.explode(F.sequence(first, last)))
    k = k.groupBy(group, "kb").agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), "v", "w"))).alias("k"), F.first("k_last").alias("k_last"))
    e = with_group_stats(evals.select(group, pos, F.col(signal).cast("double").alias("v")), [group], {"e_last": F.max(pos)})
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col(pos) - half) / block)).cast("int"), F.floor(F.least(F.col("e_last"), F.col(pos) + half) / block).cast("int"))
    e = e.withColumn("eb", F.explode(near)).groupBy(group, "eb").agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), "v"))).alias("e"), F.first("e_last").alias("e_last"))
    # each withheld block goes to every known block of its group, by number
    blocks = sizes.where(fits).select(group, F.floor((F.col("_rows") - 1 - wide) / span).cast("int").alias("_top"))
    tiles = e.join(blocks, group).withColumn("kb", F.explode(F.sequence(F.lit(0), F.col("_top")))).drop("_top").join(k, [group, "kb"])
    tiles = tiles.select(group, "eb", "kb", "e_last", "k_last", F.col("e.p").alias("ep"), F.col("e.v").alias("ev"), F.col("k.v").alias("kv"), F.col("k.w").alias("kw"), F.get("k.p", F.lit(0)).alias("k0"))
    found = T.StructType([tiles.schema[group], T.StructField(pos, T.LongType()), T.StructField("k", T.LongType()), T.StructField("match_value", T.DoubleType()), T.StructField("match_score", T.DoubleType())])
    offsets = np.arange(-half, half + 1)

    def best_of(r) -> pd.DataFrame | None:
        ep, ev, kv, kw = np.asarray(r.ep), np.asarray(r.ev, float), np.asarray(r.kv, float), np.asarray(r.kw, float)
        at = np.arange(r.eb * block, min((r.eb + 1) * block, r.e_last + 1))
        starts = np.arange(r.kb * span, min((r.kb + 1) * span, r.k_last - wide + 1), stride) - r.k0
        if not len(starts) or not len(at):
            return None
        cn = _normalised(kv[starts[:, None] + np.arange(wide + 1)])
        middle, top = np.empty(len(at), np.int64), np.empty(len(at))
        for lo in range(0, len(at), 512):
            c = at[lo : lo + 512]
            hn = _normalised(ev[np.clip(c[:, None] + offsets, 0, r.e_last) - ep[0]])  # beyond the ends the end values repeat
            score = np.round(hn @ cn.T / (wide + 1), 12)
            middle[lo : lo + 512], top[lo : lo + 512] = starts[score.argmax(1)] + half, score.max(1)
        return pd.DataFrame({group: [getattr(r, group)] * len(at), pos: at, "k": -(middle + r.k0), "match_value": kw[middle], "match_score": top})

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # given back as plain columns, some tiles at a time
        for f in frames:
            held, rows = [], 0
            for r in f.itertuples():
                if (d := best_of(r)) is not None:
                    held, rows = [*held, d], rows + len(d)
                if rows >= OUT_ROWS:
                    yield pd.concat(held)
                    held, rows = [], 0
            if held:
                yield pd.concat(held)

    bounded_batches(tiles.sparkSession)
    best = tiles.mapInPandas(match, found)
    top = best.groupBy(group, pos).agg(F.max(F.struct("match_score", "k", "match_value")).alias("b"))
    return top.select(group, pos, "b.match_value", "b.match_score").unionByName(short)


def match_ensemble(matches: Sequence[DataFrame], group: str, pos: str = "row_idx", sharpness: float = 3.0) -> DataFrame:
    """Mean of several matches of a row weighted by exp(sharpness * score)."""
    allm = matches[0]
    for m in matches[1:]:
        allm = allm.unionByName(m)
    w = F.exp(sharpness * F.col("match_score"))
    return allm.groupBy(group, pos).agg((F.sum(w * F.col("match_value")) / (F.sum(w) + 1e-9)).alias("match_ensemble"), F.max("match_score").alias("best_score"))


def shift_scan(profile: DataFrame, group: Sequence[str], digits: int | None = None) -> DataFrame:
    """Mean squared mismatch per group and offset, with a flag on local minima (few offsets per group).

    With ``digits`` every square is first rounded to that many decimals and the sum is exact: it does not hang on the
    order of the rows, so equal costs are equal and none of them is a minimum.
    """
    square = F.col("mismatch") * F.col("mismatch")
    cost = F.avg(square)
    if digits is not None:
        whole = F.floor(square * 10.0**digits + 0.5).cast("decimal(28,0)")
        cost = F.sum(whole).cast("double") / F.count(F.lit(1)) / 10.0**digits
    j = profile.where(F.col("mismatch").isNotNull()).groupBy(*group, "offset").agg(cost.alias("cost"))
    w = Window.partitionBy(*group).orderBy("offset")
    low = (F.col("cost") < F.coalesce(F.lag("cost").over(w), F.lit(float("inf")))) & (F.col("cost") < F.coalesce(F.lead("cost").over(w), F.lit(float("inf"))))
    return j.withColumn("is_minimum", low)


def two_minima(scan: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group the best two local minima and how close the second comes to the first."""
    w = Window.partitionBy(*group).orderBy("cost", "offset")
    m = scan.where("is_minimum").withColumn("_r", F.row_number().over(w))
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    d = m.groupBy(*group).agg(F.count(F.lit(1)).alias("minima"), pick(1, "offset").alias("first_offset"), pick(1, "cost").alias("first_cost"),
                              pick(2, "offset").alias("second_offset"), pick(2, "cost").alias("second_cost"))
    return d.withColumn("ratio", F.try_divide("second_cost", "first_cost"))


def curve_families(df: DataFrame, group: str, value: str, length: int, pos: str = "row_idx") -> DataFrame:
    """Groups that share exact runs of ``length`` consecutive values, directly or through others: ``(group, family)``.

    Runs are compared by value. Members of a run are linked to its smallest label only, never pairwise; labels travel
    until nothing changes, two joins per round.
    """
    runs = framed(df, [group], 0, length - 1, lambda w: {"_run": F.collect_list(value).over(w.rowsBetween(0, length - 1))}, pos)
    runs = runs.where(F.size("_run") == length).select(group, F.sha2(F.concat_ws("|", F.transform("_run", lambda v: v.cast("string"))), 256).alias("run")).distinct()
    shared = runs.groupBy("run").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    runs = cut_lineage(runs.join(shared.select("run"), "run", "left_semi"))
    labels = cut_lineage(df.select(group).distinct().withColumn("family", F.col(group)))
    while True:
        low = runs.join(labels, group).groupBy("run").agg(F.min("family").alias("_f"))
        best = runs.join(low, "run").groupBy(group).agg(F.min("_f").alias("_f"))
        new = labels.join(best, group, "left").select(group, F.least("family", F.coalesce("_f", "family")).alias("family"), F.col("family").alias("_old"))
        # A label is itself a group: following it once more halves the number of rounds.
        hop = new.select(F.col(group).alias("family"), F.col("family").alias("_next"))
        new = cut_lineage(new.join(hop, "family", "left").select(group, F.least("family", F.coalesce("_next", "family")).alias("family"), "_old"))
        labels = new.select(group, "family")
        if new.where(F.col("family") != F.col("_old")).isEmpty():
            return labels


def draw_scores(per_group: DataFrame, group: str, draws: int, size: int, seed: int = 7) -> DataFrame:
    """Pooled error of ``draws`` samples of ``size`` groups each; a draw takes the groups with the smallest hash."""
    d = per_group.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    h = F.md5(F.concat_ws("_", F.col(group), "draw", F.lit(seed)))
    d = d.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy("draw").orderBy("_h", group))).where(F.col("_r") <= size)
    r, n = F.col("rmse"), F.col("n")
    return d.groupBy("draw").agg(F.count(F.lit(1)).alias("groups"), F.sqrt(F.sum(r * r * n) / F.sum(n)).alias("rmse"))
