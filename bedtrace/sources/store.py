"""Feature store versions, contracts, sinks and audits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.functions.columns import is_finite
from bedtrace.operators.cells import index_rows


class ContractError(ValueError):
    """A table does not have the promised columns, values or coverage."""


def version_path(root: str, config: Mapping[str, object]) -> str:
    """Folder of a feature version: the same configuration always gives the same folder."""
    text = json.dumps(dict(sorted(config.items())), sort_keys=True, default=str)
    return f"{root}/v_{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_features(spark: SparkSession, root: str, config: Mapping[str, object], build, on: str = "id", previous: str | None = None,
                    min_cov: float = 0.95) -> DataFrame:
    """Features of a configuration: read when stored, upgraded from ``previous`` where that lacks columns, else built.

    ``build(missing)`` returns a frame keyed by ``on`` with at least the missing columns (all when ``missing`` is None).
    """
    path = version_path(root, config)
    if not _exists(spark, path):
        if previous and _exists(spark, previous):
            old = spark.read.parquet(previous)
            wanted = list(config.get("columns", []))
            missing = [c for c in wanted if c not in old.columns]
            new = upgrade_features(old, build(missing), on, min_cov) if missing else old
        else:
            new = build(None)
        new.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upgrade_features(df: DataFrame, extra: DataFrame, on: str = "id", min_cov: float = 0.95) -> DataFrame:
    """Left join of the columns ``extra`` adds; too low coverage raises."""
    new = [c for c in extra.columns if c != on and c not in df.columns]
    joined = df.join(extra.select(on, *new), on, "left")
    require_coverage(joined, new, min_cov)
    return joined


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of set values per column, one row per column."""
    wide = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)).alias(f"_c{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("share")) for i, c in enumerate(cols)])).alias("r")).select("r.*")


def require_coverage(df: DataFrame, cols: Sequence[str], min_cov: float) -> None:
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ContractError(f"missing columns: {absent}")
    thin = coverage(df, cols).where(F.coalesce("share", F.lit(0.0)) <= min_cov).collect()  # one row per thin column
    if thin:
        raise ContractError("low coverage: " + ", ".join(f"{r['column']} {r['share']}" for r in thin))


def require_frame(df: DataFrame, types: Mapping[str, str], finite: Sequence[str]) -> DataFrame:
    """Check that columns exist, cast them and check that the ``finite`` ones hold only finite numbers."""
    absent = [c for c in types if c not in df.columns]
    if absent:
        raise ContractError(f"missing columns: {absent}")
    out = df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    bad = bad_values(out, finite).first()["bad"]
    if bad:
        raise ContractError(f"{bad} non-finite values")
    return out


def bad_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    flags = [F.when(is_finite(F.col(c)), 0).otherwise(1) for c in cols]
    return df.agg(F.coalesce(F.sum(sum(flags[1:], flags[0])), F.lit(0)).cast("long").alias("bad"), F.count(F.lit(1)).alias("rows"))


def predictions_in_order(pred: DataFrame, sample: DataFrame, key: str, value: str, fallback: float, order: str) -> DataFrame:
    """Every sample row with its prediction or the fallback."""
    return sample.select(key, order).join(pred.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(fallback)))


def write_predictions(pred: DataFrame, sample: DataFrame, path: str, key: str = "id", value: str = "tvt", fallback: float = 0.0,
                      order: str = "sample_pos") -> None:
    """CSV parts in sample order: parts are ranges of the order, so reading them by name gives the whole in order."""
    d = predictions_in_order(pred, sample, key, value, fallback, order)
    d.orderBy(order).select(key, value).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = report.write.mode("overwrite")
    w.parquet(path) if fmt == "parquet" else w.option("header", True).csv(path)


def joined_predictions(a: DataFrame, b: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Inner join of two predictions that must cover the same keys; a difference raises with the counts."""
    if check:
        only_a = a.join(b, key, "left_anti").count()
        only_b = b.join(a, key, "left_anti").count()
        if only_a or only_b:
            raise ContractError(f"{only_a} keys only on the left, {only_b} only on the right")
    return a.join(b, key)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of keys on both sides, only left, only right, in one full join."""
    both = a.select(key, F.lit(True).alias("_a")).join(b.select(key, F.lit(True).alias("_b")), key, "full")
    return both.agg(F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_left"),
                    F.count_if(F.col("_a").isNull()).alias("only_right"))


def audit_output(pred: DataFrame, sample: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row: counts, keys out of place, non-finite values, min/max/mean/std and an order-free content digest.

    ``order`` is the position column of both frames; a key is out of place when its positions differ.
    """
    v = F.col(value).cast("double")
    own = pred.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~is_finite(v)).alias("not_finite"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.sum(F.xxhash64(F.col(key).cast("string"), F.round(v, 6)).cast("decimal(38,0)")).cast("string").alias("digest"))
    place = sample.select(key, F.col(order).alias("_s")).join(pred.select(key, F.col(order).alias("_p")), key, "full").agg(
        F.count("_s").alias("expected"), F.count_if(~F.coalesce(F.col("_s") == F.col("_p"), F.lit(False))).alias("out_of_place"))
    return own.crossJoin(place)  # one row each


def with_position(df: DataFrame, order: Sequence[str], axis: str, name: str = "sample_pos") -> DataFrame:
    return index_rows(df, [], order, axis, name)


def ordered_digest(df: DataFrame, cols: Sequence[str]) -> Column:
    """Digest of one row's content, for comparing two ordered outputs row by row."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
