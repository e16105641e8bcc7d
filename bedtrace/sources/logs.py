"""Scans of per-group log files, with explicit schemas and row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.operators.cells import framed, index_rows, neighbours, position_cells
from bedtrace.session import cut_lineage

# Fixed column names of the input files.
LOG_COLUMNS = ["MD", "X", "Y", "Z", "GR", "TVT_input"]
TRAIN_COLUMNS = ["TVT", "ANCC", "ASTNU", "ASTNL", "EGFDU", "EGFDL", "BUDA"]
LOG_SUFFIX = "__horizontal_well.csv"
CURVE_SUFFIX = "__typewell.csv"


def _named_csv(spark: SparkSession, path: str, suffix: str, fields: Sequence[T.StructField], extra: Sequence[Column] = ()) -> DataFrame:
    """All files ``{path}/*{suffix}``; columns are matched by name, since files of different splits differ in columns."""
    raw = spark.read.option("header", True).option("enforceSchema", False)
    text = raw.option("pathGlobFilter", f"*{suffix}").csv(path)
    have = set(text.columns)
    well = F.regexp_extract(F.col("_metadata.file_name"), f"^(.*){suffix.replace('.', '[.]')}$", 1)
    cols = [(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
    return text.select(well.alias("well"), *extra, *cols)


def read_wells(spark: SparkSession, path: str, split: str | None = None, train: bool | None = None) -> DataFrame:
    """Log rows of all groups under ``path[/split]`` with ``well``, ``row_idx`` (place in the file), ``is_known``, ``md_falls``.

    NaN is read as null. Rows keep the order of the file, since row numbers are part of the ids of predictions; rows
    without MD stay. ``md_falls`` marks rows whose MD is below that of the row before.
    """
    folder = f"{path}/{split}" if split else path
    names = LOG_COLUMNS + (TRAIN_COLUMNS if train is not False else [])
    place = [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    d = _named_csv(spark, folder, LOG_SUFFIX, [T.StructField(n, T.DoubleType()) for n in names], place)
    d = d.select("well", "_block", "_line", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    d = index_rows(cut_lineage(d), ["well"], ["_block", "_line"], "_block").drop("_block", "_line")  # written: line numbers must stay
    d = framed(d, ["well"], 1, 0, lambda w: {"_before": F.lag("MD").over(w)})
    d = d.withColumn("md_falls", F.coalesce(F.col("MD") < F.col("_before"), F.lit(False))).drop("_before")
    return d.withColumn("is_known", F.col("TVT_input").isNotNull())


def read_typewells(spark: SparkSession, path: str, split: str | None = None, fill: str = "mean") -> DataFrame:
    """Reference curves ordered by TVT. Missing GR is filled with the curve's mean, or (``fill='nearest'``) with the
    previous, else the next value."""
    folder = f"{path}/{split}" if split else path
    fields = [T.StructField("TVT", T.DoubleType()), T.StructField("GR", T.DoubleType()), T.StructField("Geology", T.StringType())]
    d = _named_csv(spark, folder, CURVE_SUFFIX, fields)
    d = d.withColumn("GR", F.when(~F.isnan("GR"), F.col("GR"))).where(F.col("TVT").isNotNull() & ~F.isnan("TVT"))
    return fill_curve(d, "well", "TVT", "GR", fill)


def fill_curve(curve: DataFrame, group: str, x: str, y: str, fill: str = "mean") -> DataFrame:
    if fill == "mean":
        means = curve.groupBy(group).agg(F.avg(y).alias("_m"))
        return curve.join(means, group).withColumn(y, F.coalesce(F.col(y), F.col("_m"))).drop("_m")
    d = position_cells(index_rows(curve, [group], [x], x, "_ci"), "_ci")
    d = neighbours(d, [group], ["_ci"], {"_p": F.col(y)}, {"_q": F.col(y)})
    return d.withColumn(y, F.coalesce(F.col(y), "_p", "_q")).drop("_p", "_q", "_ci", "_cell")


def projected(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The named columns of rows where all of them are set."""
    return df.select(*cols).na.drop()


def rows_of(spark: SparkSession, path: str, groups: Sequence[str], cols: Sequence[str], group: str = "well") -> DataFrame:
    """Parquet rows of a few groups: both the filter and the column list reach the scan."""
    return spark.read.parquet(path).where(F.col(group).isin(list(groups))).select(*cols)


def compact(df: DataFrame, path: str, keys: Sequence[str] = (), partition: str | None = None) -> None:
    """One-time conversion to Parquet with doubles stored as floats (``keys`` stay as they are)."""
    narrowed = df.select(*[
        F.col(f.name).cast("float").alias(f.name) if f.dataType == T.DoubleType() and f.name not in keys else F.col(f.name)
        for f in df.schema.fields])
    w = narrowed.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)
