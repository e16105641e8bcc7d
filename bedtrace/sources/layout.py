"""A stored layout of a numbered log: ordered once, then read by any number of queries without a shuffle.

Numbering a log costs a shuffle and a sort. ``store_log`` pays it once and writes the rows bucketed by (group, cell),
sorted by position, where a cell is a run of ``spark.bedtrace.cellRows`` positions of one group. So a hot group lies in as
many buckets as it has cells. Every cell also holds ``halo`` rows of its neighbours (``halo / cellRows`` extra rows), so
bounded row frames need no exchange either. The knots of reference curves lie in the cells that need them, feature tables in the
buckets of their log.

A layout is keyed by a version; it is written once per version and found again by later sessions. Group columns must not be
null; an empty log gives an empty layout.

Joins of a log with its feature tables run without an exchange where ``spark.sql.requireAllClusterKeysForCoPartition`` is
false (Spark asks for buckets by all join keys otherwise). Without it they are right but shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedtrace.operators.cells import CELL, add_cells, index_rows, neighbours
from bedtrace.operators.interp import NEXT, PREV, bracket_join, clean_curve
from bedtrace.session import cell_rows, cut_lineage
from bedtrace.sources.store import version_path

POS, SIZE, KIND = "row_idx", "n_rows", "_kind"
ROW, HALO = "row", "halo"  # other kinds are names of curves
OWN = (KIND, "_kx", "_ky")


@dataclass(frozen=True)
class Curve:
    """Knots (group, ``x``, ``y``) of a reference curve."""

    knots: DataFrame
    x: str
    y: str


@dataclass(frozen=True)
class Bucketed:
    """A table in buckets by (group, cell)."""

    spark: SparkSession
    path: str
    group: tuple[str, ...]
    buckets: int

    @property
    def keys(self) -> list[str]:
        return [*self.group, CELL]

    @property
    def name(self) -> str:
        return "bedtrace_" + self.path.rsplit("/", 1)[1]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def keep(self, build: Callable[[], DataFrame], sort: Sequence[str]) -> None:
        """Write ``build()`` unless a finished table lies at the path, and make it known to the catalog."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS"))
        if done and self.spark.catalog.tableExists(self.name):
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if done:
            schema = self.spark.read.parquet(self.path).schema.toDDL()
            by = ", ".join(f"`{k}`" for k in self.keys)
            order = ", ".join(f"`{c}`" for c in sort)
            self.spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
            return
        fs.delete(p, True)  # what an interrupted write left behind
        # the same hash decides partition and bucket: one file a bucket
        d = build().repartition(self.buckets, *self.keys)
        d.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*sort).option("path", self.path).saveAsTable(self.name)


@dataclass(frozen=True)
class StoredLog(Bucketed):
    """A numbered log. ``row_idx`` and ``n_rows`` are added columns."""

    halo: int
    cell: int

    def rows(self) -> DataFrame:
        """The rows of the log, each once, with their ``_cell``."""
        return self.read().where(F.col(KIND) == ROW).drop(*OWN)

    def framed(self, before: int, after: int, build: Callable[[Window], Mapping[str, Column]], columns: Sequence[str] = ()) -> DataFrame:
        """Add columns over row frames that reach at most ``before`` rows back and ``after`` ahead; no exchange.

        Only ``columns`` (all when empty) and what the frames use are scanned.
        """
        if max(before, after) > self.halo:
            raise ValueError(f"frames reach {max(before, after)} rows, the layout keeps {self.halo} of the neighbours")
        d = self.read().where(F.col(KIND).isin(ROW, HALO))
        new = build(Window.partitionBy(*self.keys).orderBy(POS))
        kept = [*self.keys, POS, *[c for c in columns or d.columns if c not in (*self.keys, POS, *OWN)], KIND]
        return d.select(*kept, *[c.alias(n) for n, c in new.items()]).where(F.col(KIND) == ROW).drop(KIND)


def store_log(df: DataFrame, root: str, version: Mapping[str, object], group: Sequence[str], order: Sequence[str], axis: str,
              halo: int = 1024, buckets: int | None = None, curves: Mapping[str, Curve] | None = None) -> StoredLog:
    """The stored layout of ``df``, numbered by ``order`` inside ``group``; written when ``version`` is new.

    ``version`` must change with the content of ``df`` and ``curves`` (for example their files and times). With ``curves``,
    by name, ``axis`` must not fall along ``order``; it is the axis of the knots. Rows with a null axis get none.
    """
    spark = df.sparkSession
    rows = max(cell_rows(spark), halo)
    if buckets is None:
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
        buckets = max(1, min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))))
    config = {**version, "group": list(group), "order": list(order), "axis": axis, "halo": halo, "cell": rows, "buckets": buckets,
              "columns": df.schema.simpleString(), "curves": sorted(curves or ())}
    log = StoredLog(spark, version_path(root, config), tuple(group), buckets, halo, rows)

    def build() -> DataFrame:
        d = index_rows(df, group, order, axis, POS, SIZE)
        p, n = F.col(POS), F.lit(rows)
        first = F.greatest(F.lit(0).cast("long"), F.floor((p - halo) / n).cast("long"))
        last = F.floor(F.least(p + halo, F.col(SIZE) - 1) / n).cast("long")
        spread = d.withColumn(CELL, F.explode(F.sequence(first, last)))
        spread = spread.withColumn(KIND, F.when(F.col(CELL) == F.floor(p / n).cast("long"), ROW).otherwise(HALO))
        if not curves:
            return spread
        spread = cut_lineage(spread)
        knots = [_cell_knots(spread, [*group, CELL], c, axis, name) for name, c in curves.items()]
        return spread.unionByName(reduce(DataFrame.unionByName, knots), allowMissingColumns=True)

    log.keep(build, [*group, CELL, POS])
    return log


def store_features(log: StoredLog, features: DataFrame, version: Mapping[str, object]) -> Bucketed:
    """``features`` (group, ``row_idx``, columns) in the buckets of ``log``, for joins on (group, ``_cell``, ``row_idx``)."""
    config = {**version, "log": log.path, "columns": features.schema.simpleString()}
    out = Bucketed(log.spark, version_path(log.path.rsplit("/", 1)[0], config), log.group, log.buckets)
    celled = features.withColumn(CELL, F.floor(F.col(POS) / F.lit(log.cell)).cast("long"))
    out.keep(lambda: celled, [*out.keys, POS])
    return out


def with_features(log: StoredLog, *tables: Bucketed) -> DataFrame:
    """Rows of the log with the columns of stored feature tables, null where a table lacks the row."""
    d = log.rows()
    for t in tables:
        d = d.join(t.read(), [*log.keys, POS], "left")
    return d


def _cell_knots(rows: DataFrame, keys: list[str], curve: Curve, x: str, name: str) -> DataFrame:
    """The knots each cell of the log needs: those inside its range of ``x`` and the nearest one on either side."""
    group = keys[:-1]
    ends = cut_lineage(rows.where((F.col(KIND) == ROW) & F.col(x).isNotNull()).groupBy(*group, F.col(CELL).alias("_c")).agg(
        F.min(F.col(x).cast("double")).alias("_lo"), F.max(F.col(x).cast("double")).alias("_hi")))
    knots = cut_lineage(clean_curve(curve.knots, group, curve.x, curve.y))
    # a knot above the start of a cell belongs to the last such cell, if that reaches so far
    stream = knots.select(*group, F.col("_kx").alias("_x"), F.lit(-1).cast("long").alias("_c"), "_ky").unionByName(
        ends.select(*group, F.col("_lo").alias("_x"), "_c", "_hi"), allowMissingColumns=True)
    start = F.when(F.col("_c") >= 0, F.struct(F.col("_c").alias("c"), F.col("_hi").alias("hi")))
    found = neighbours(add_cells(stream, group, "_x", order=["_c"]), group, ["_x", "_c"], {"_s": start})
    parts = [found.where((F.col("_c") < 0) & (F.col("_x") <= F.col("_s.hi"))).select(
        *group, F.col("_s.c").alias(CELL), F.col("_x").alias("_kx"), "_ky")]
    for end, side in (("_lo", PREV), ("_hi", NEXT)):
        parts.append(bracket_join(ends, knots, group, end, "_kx", "_ky").where(F.col(side).isNotNull()).select(
            *group, F.col("_c").alias(CELL), F.col(f"{side}.x").alias("_kx"), F.col(f"{side}.y").alias("_ky")))
    return reduce(DataFrame.unionByName, parts).withColumn(KIND, F.lit(name))


def bracketed(log: StoredLog, curve: str, x: str, columns: Sequence[str] = ()) -> DataFrame:
    """Rows of the log with ``_prev`` and ``_next``, the knots around ``x`` of the curve stored with the log, for ``interpolated``.

    One scan, no exchange: the knots of a cell lie beside its rows.
    """
    d = log.read()
    kept = list(dict.fromkeys([*log.keys, POS, x, *(columns or [c for c in d.columns if c not in OWN])]))
    row = F.col(KIND) == ROW
    stream = d.where(F.col(KIND).isin(ROW, curve)).withColumns({
        "_x": F.when(row, F.col(x).cast("double")).otherwise(F.col("_kx")), "_row": row,
        "_knot": F.when(~row, F.struct(F.col("_kx").alias("x"), F.col("_ky").alias("y")))})
    cell = Window.partitionBy(*log.keys)
    upto = cell.orderBy("_x", "_row").rowsBetween(Window.unboundedPreceding, 0)
    back = cell.orderBy(F.desc("_x"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    out = stream.select("*", F.last("_knot", ignorenulls=True).over(upto).alias(PREV), F.last("_knot", ignorenulls=True).over(back).alias(NEXT))
    has_x = F.col("_x").isNotNull()
    return out.where("_row").select(*kept, F.when(has_x, F.col(PREV)).alias(PREV), F.when(has_x, F.col(NEXT)).alias(NEXT))
