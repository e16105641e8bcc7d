"""Error measures, group traits, rank correlations, cohorts and Gram matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedtrace.functions.columns import is_finite
from bedtrace.operators.calibrate import correlation
from bedtrace.operators.cells import CELL, add_cells, index_rows, running
from bedtrace.operators.quantiles import grouped_quantiles


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def long_methods(df: DataFrame, keys: Sequence[str], methods: Sequence[str], truth: str) -> DataFrame:
    """One row per row and method with its ``error``; rows without a finite error are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), (F.col(m) - F.col(truth)).alias("error")) for m in methods]))
    return df.select(*keys, pairs.alias("_p")).select(*keys, "_p.method", "_p.error").where(is_finite(F.col("error")))


def group_rmse(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    return errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rmse(F.col("error")).alias("rmse"))


def weighted_pooled(per_group: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled error out of per-group errors and row counts."""
    r, n = F.col("rmse"), F.col("n")
    return per_group.groupBy(*keys).agg(F.sqrt(F.sum(r * r * n) / F.sum(n)).alias("rmse"))


def sse_curve(per_group: DataFrame, group: str) -> DataFrame:
    """Groups from worst to best with rank, squared error, and running share of the total.

    The order is global, so it is cut into cells like any long ordered log.
    """
    d = per_group.select(group, (F.col("rmse") * F.col("rmse") * F.col("n")).alias("sse")).withColumn("_neg", -F.col("sse"))
    d = index_rows(d, [], ["_neg", group], "_neg", "rank", "groups")
    d = running(add_cells(d, [], "rank"), [], ["rank"], {"cum": F.col("sse")}).drop(CELL)
    total = d.agg(F.sum("sse").alias("_total"))
    return d.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide("cum", "_total")).drop("_neg", "_total", "cum")


def tail_share(per_group: DataFrame, group: str, part: float = 0.1) -> DataFrame:
    """Share of the squared error held by the worst ``part`` of the groups (at least one group)."""
    c = sse_curve(per_group, group)
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("groups") * part))
    worst = F.when(F.col("rank") < k, F.col("sse"))
    return c.agg((F.sum(worst) / F.sum("sse")).alias("share"), F.count(worst).alias("worst_groups"), F.max("groups").alias("groups"))


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """1-based rank over the whole table, equal values share their mean rank; null stays null."""
    ranked = index_rows(df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v")), [], ["_v"], "_v", "_r")
    means = ranked.groupBy("_v").agg((F.avg("_r") + 1).alias(out))
    return df.join(means, F.col(col).cast("double") == F.col("_v"), "left").drop("_v")


def rank_correlations(df: DataFrame, traits: Sequence[str], target: str) -> DataFrame:
    """Per trait: Spearman correlation with the target and Pearson correlation with log1p(target)."""
    longs = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).cast("double").alias("v")) for t in traits]))
    d = df.select(F.col(target).cast("double").alias("y"), longs.alias("_t")).select("y", "_t.trait", "_t.v")
    d = d.where(is_finite(F.col("v")) & is_finite(F.col("y")))

    def ranked(d: DataFrame, c: str, out: str) -> DataFrame:
        r = index_rows(d.select("trait", c), ["trait"], [c], c, "_r")
        means = r.groupBy("trait", c).agg(F.avg("_r").alias(out))
        return d.join(means, ["trait", c])

    d = ranked(ranked(d, "v", "rv"), "y", "ry")
    return d.groupBy("trait").agg(
        correlation(F.col("rv"), F.col("ry")).alias("spearman"), correlation(F.col("v"), F.log1p("y")).alias("pearson_log"))


def cohort_medians(df: DataFrame, traits: Sequence[str], target: str, part: float = 0.9) -> DataFrame:
    """Median of each trait among the rows with the target at or above its ``part`` quantile, and among the others."""
    edge = grouped_quantiles(df, [], {"_edge": (F.col(target), part)})
    d = df.crossJoin(F.broadcast(edge)).withColumn("top", F.col(target) >= F.col("_edge"))
    longs = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).cast("double").alias("v")) for t in traits]))
    d = d.select("top", longs.alias("_t")).select("_t.trait", "_t.v", "top")
    med = grouped_quantiles(d, ["trait"], {"top_median": (F.when(F.col("top"), F.col("v")), 0.5), "rest_median": (F.when(~F.col("top"), F.col("v")), 0.5)})
    return med.withColumn("ratio", F.try_divide(F.col("top_median"), F.col("rest_median")))


def ols_r2(df: DataFrame, traits: Sequence[str], target: str) -> DataFrame:
    """Share of the target's variance explained by a linear model on the traits, one row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    clean = df.select(*traits, F.col(target).cast("double").alias("_y")).na.drop()
    data = VectorAssembler(inputCols=list(traits), outputCol="_x").transform(clean)
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", regParam=0.0, standardization=False).fit(data)
    scored = model.transform(data)
    e = F.col("_y") - F.col("prediction")
    return scored.agg((1 - F.var_pop(e) / F.var_pop("_y")).alias("r2"), F.count(F.lit(1)).alias("n"))


def gram(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """All pairwise sums of products in one aggregation: rows ``(keys, a, b, n, sum_ab, sum_a, sum_b)`` for a <= b.

    Rows with any missing value are left out. Every weight grid over the columns is closed form from here.
    """
    ok = F.lit(True)
    for c in cols:
        ok = ok & is_finite(F.col(c))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.where(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c)).alias(f"_s_{i}") for i, c in enumerate(cols)],
        *[F.sum(F.col(a) * F.col(b)).alias(f"_p_{i}") for i, (a, b) in enumerate(pairs)],
    )
    at = {c: i for i, c in enumerate(cols)}
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_p_{i}").alias("sum_ab"), F.col(f"_s_{at[a]}").alias("sum_a"),
                     F.col(f"_s_{at[b]}").alias("sum_b")) for i, (a, b) in enumerate(pairs)]
    return wide.select(*keys, "n", F.explode(F.array(*rows)).alias("_r")).select(*keys, "n", "_r.*")


def error_correlation(g: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Correlations of all pairs from a Gram table, for each value of the ``keys`` the table was made with."""
    n, keys = F.col("n"), list(keys)
    diag = g.where(F.col("a") == F.col("b")).select(
        *keys, F.col("a").alias("_c"), (F.col("sum_ab") / n - F.pow(F.col("sum_a") / n, 2)).alias("_v"))
    d = g.join(diag.select(*keys, F.col("_c").alias("a"), F.col("_v").alias("_va")), [*keys, "a"])
    d = d.join(diag.select(*keys, F.col("_c").alias("b"), F.col("_v").alias("_vb")), [*keys, "b"])
    cov = F.col("sum_ab") / n - F.col("sum_a") / n * F.col("sum_b") / n
    return d.select(*keys, "a", "b", "n", (F.col("sum_ab") / n).alias("mean_product"),
                    F.try_divide(cov, F.sqrt(F.col("_va") * F.col("_vb"))).alias("corr"))


def blend_scan(g: DataFrame, a: str, b: str, weights: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Error of (1 - w) a + w b for every weight, from the Gram table of the two error columns, for each of its ``keys``."""
    s = g.where(F.col("a").isin(a, b) & F.col("b").isin(a, b)).groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(F.when((F.col("a") == a) & (F.col("b") == a), F.col("sum_ab"))).alias("aa"),
        F.max(F.when((F.col("a") == b) & (F.col("b") == b), F.col("sum_ab"))).alias("bb"),
        F.max(F.when(F.col("a") != F.col("b"), F.col("sum_ab"))).alias("ab"))
    w = F.col("weight")
    d = s.withColumn("weight", F.explode(F.array(*[F.lit(float(v)) for v in weights])))
    mse = ((1 - w) * (1 - w) * F.col("aa") + 2 * w * (1 - w) * F.col("ab") + w * w * F.col("bb")) / F.col("n")
    return d.select(*keys, "weight", F.sqrt(F.greatest(mse, F.lit(0.0))).alias("rmse"))


def quartile_edges(df: DataFrame, col: str, out: str) -> DataFrame:
    """Quartile 0..3 of ``col`` by value edges; a value on an edge belongs to the lower quartile."""
    e = grouped_quantiles(df, [], {f"_q{i}": (F.col(col), i / 4) for i in (1, 2, 3)})
    d = df.crossJoin(F.broadcast(e))
    q = sum((F.when(F.col(col) > F.col(f"_q{i}"), 1).otherwise(0) for i in (1, 2, 3)), F.lit(0))
    return d.withColumn(out, F.when(F.col(col).isNotNull(), q)).drop("_q1", "_q2", "_q3")


def quartile_ranks(df: DataFrame, col: str, tie: str, out: str) -> DataFrame:
    """Quartile 0..3 by rank, so that all four are equally large; equal values are told apart by ``tie``."""
    d = index_rows(df, [], [col, tie], col, "_r", "_count")
    # Edges are the linear quantiles of the ranks 1..n.
    q = sum((F.when(F.col("_r") > (F.col("_count") - 1) * (i / 4), 1).otherwise(0) for i in (1, 2, 3)), F.lit(0))
    return d.withColumn(out, q).drop("_r", "_count")


def share_below(df: DataFrame, reference: DataFrame, group: Sequence[str], value: str, ref: str, out: str) -> DataFrame:
    """Share of the group's reference values that are smaller than the row's value."""
    ask = df.withColumns({"_v": F.col(value).cast("double"), "_kind": F.lit(0)})
    known = reference.where(F.col(ref).isNotNull()).select(*group, F.col(ref).cast("double").alias("_v"), F.lit(1).alias("_kind"))
    stream = add_cells(ask.where(F.col("_v").isNotNull()).unionByName(known, allowMissingColumns=True), group, "_v", order=["_kind"])
    below = running(stream, group, ["_v", "_kind"], {"_below": F.col("_kind").cast("double")}).where(F.col("_kind") == 0)
    totals = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_t"))
    return below.join(totals, list(group), "left").withColumn(out, F.try_divide("_below", "_t")).select(*df.columns, out)


def lognormal_prior(segments: DataFrame, length: str, rate: str, rate_change: str, floor: float = 20.0) -> DataFrame:
    """Summary of segment lengths and rates in one row: log-normal location and scale of the lengths (at least ``floor``),
    length quantiles, spread and 99 % size of the rates, and the robust spread of rate changes."""
    ln = F.log(F.greatest(F.col(length), F.lit(floor)))
    base = segments.agg(
        F.count(F.lit(1)).alias("n_segments"), F.avg(ln).alias("len_mu"), F.stddev_pop(ln).alias("len_sigma"),
        F.stddev_pop(rate).alias("rate_std"))
    q = grouped_quantiles(segments, [], {
        "len_p10": (F.col(length), 0.1), "len_p90": (F.col(length), 0.9), "_lm": (ln, 0.5),
        "rate_p99_abs": (F.abs(F.col(rate)), 0.99), "_dm": (F.col(rate_change), 0.5)})
    mad = grouped_quantiles(segments.crossJoin(F.broadcast(q.select("_dm"))), [], {"_mad": (F.abs(F.col(rate_change) - F.col("_dm")), 0.5)})
    d = base.crossJoin(q).crossJoin(mad)  # three tables of one row each
    return d.select("n_segments", "len_mu", "len_sigma", F.exp("_lm").alias("len_median"), "len_p10", "len_p90", "rate_std",
                    "rate_p99_abs", (F.col("_mad") * 1.4826).alias("rate_change_mad"))


def distribution_shift(df: DataFrame, group: Sequence[str], value: str, known: str, min_known: int, min_eval: int) -> DataFrame:
    """How the withheld part of a signal differs from the known part: shift of mean, log std, skewness and kurtosis, and
    the share of withheld values outside the known 1 %..99 % range."""
    from bedtrace.functions.columns import bias_corrected_kurtosis, bias_corrected_skew

    k, e = F.when(F.col(known), F.col(value)), F.when(~F.col(known), F.col(value))
    s = df.groupBy(*group).agg(
        F.count(k).alias("_kn"), F.avg(k).alias("_km"), F.stddev_samp(k).alias("_ks"), F.skewness(k).alias("_kw"), F.kurtosis(k).alias("_kk"),
        F.count(e).alias("_en"), F.avg(e).alias("_em"), F.stddev_samp(e).alias("_es"), F.skewness(e).alias("_ew"), F.kurtosis(e).alias("_ek"))
    s = s.where((F.col("_kn") >= min_known) & (F.col("_en") > min_eval))
    edge = grouped_quantiles(df, group, {"_lo": (k, 0.01), "_hi": (k, 0.99)})
    out_of = (F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))
    nov = df.where(~F.col(known) & F.col(value).isNotNull()).join(edge, list(group)).groupBy(*group).agg(
        F.avg(F.when(out_of, 1.0).otherwise(0.0)).alias("novelty"))
    sd = F.col("_ks") + 1e-6
    return s.join(nov, list(group), "left").select(
        *group, ((F.col("_em") - F.col("_km")) / sd).alias("shift_mean"), F.log((F.col("_es") + 1e-6) / sd).alias("shift_logstd"),
        (bias_corrected_skew(F.col("_ew"), F.col("_en")) - bias_corrected_skew(F.col("_kw"), F.col("_kn"))).alias("shift_skew"),
        (bias_corrected_kurtosis(F.col("_ek"), F.col("_en")) - bias_corrected_kurtosis(F.col("_kk"), F.col("_kn"))).alias("shift_kurt"),
        "novelty")


def importance_table(gains: DataFrame, feature: str, gain: str) -> DataFrame:
    """Gain per feature summed over folds, percentage of the total and rank."""
    s = gains.groupBy(feature).agg(F.sum(gain).alias("gain"))
    total = s.agg(F.sum("gain").alias("_t"))
    s = s.crossJoin(F.broadcast(total)).withColumn("share_pct", 100 * F.try_divide("gain", "_t")).drop("_t")
    s = s.withColumn("_neg", -F.col("gain"))
    return index_rows(s, [], ["_neg", feature], "_neg", "rank").drop("_neg").withColumn("rank", F.col("rank") + 1)


def best_and_second(scores: DataFrame, group: Sequence[str], name: str, score: str) -> DataFrame:
    """Best and second best name per group with both scores (ties by name)."""
    w = Window.partitionBy(*group).orderBy(score, name)
    r = scores.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
    first, second = F.col("_r") == 1, F.col("_r") == 2
    return r.groupBy(*group).agg(
        F.max(F.when(first, F.col(name))).alias("best_name"), F.max(F.when(first, F.col(score))).alias("best_score"),
        F.coalesce(F.max(F.when(second, F.col(score))), F.max(F.when(first, F.col(score)))).alias("second_score"))


def one_row(*parts: DataFrame) -> DataFrame:
    """Side by side join of single-row summaries."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def traits(df: DataFrame, group: Sequence[str], named: Mapping[str, Column]) -> DataFrame:
    """Group-level traits from conditional aggregates, one pass."""
    return df.groupBy(*group).agg(*[c.alias(n) for n, c in named.items()])
