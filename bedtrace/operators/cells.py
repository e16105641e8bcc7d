"""Ordered work on groups of any size.

A plain ``Window.partitionBy(group)`` sends a whole group to one task, which breaks once one group holds a large share
of the table. The helpers here cut every group into ordered *cells* of about ``spark.bedtrace.cellRows`` rows, run the
window inside ``(group, cell)`` and carry the little that crosses a cell border:

* bounded row frames get a halo of neighbouring rows (``framed``),
* running sums get the total of the earlier cells (``running``),
* previous / next value lookups get the last / first value of the other cells (``neighbours``).

The result equals that of the plain window. Group and axis columns must not be null.

Every operator reads its input more than once (statistics or cell totals first, then the rows). Between chained operators
keep the intermediate table (``cut_lineage`` or a written table), otherwise the work before them is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.session import cell_rows, cut_lineage

CELL = "_cell"
ONE_CELL = "bedtrace.one_cell"  # metadata of a cell column: a count has shown that every group fits one cell


def add_cells(df: DataFrame, group: Sequence[str], axis: str, rows: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Add ``_cell``, a slice number that never falls along (``axis``, ``order``) inside each group.

    No cell holds more than twice ``rows`` rows, whatever the distribution: cells start as equal slices of the range, and
    any that is too full is cut again inside its own range, until none is. Rows tied on ``axis`` are cut by the next
    column of ``order`` that is a number, date or time. Only rows equal in all of these stay together. Each pass
    aggregates per cell and writes one row per cell that is too full, so its cost falls with the rows still to be cut.

    When every group fits one cell (one count decides), all rows get the same cell and nothing is joined. Otherwise the
    input is written once, because it is read by each pass.
    """
    rows = rows or cell_rows(df.sparkSession)
    keys = list(group)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= rows:
        return df.withColumn(CELL, F.array(F.lit(0).cast("long"))).withMetadata(CELL, {ONE_CELL: True})
    out = cut_lineage(df).withColumn(CELL, F.array(F.lit(0).cast("long")))
    for column in dict.fromkeys([axis, *order]):
        if not isinstance(df.schema[column].dataType, SORTED_AS_NUMBER):
            break
        a = _as_number(df, column)
        while True:
            full = out.groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("_c"), F.min(a).alias("_lo"), F.max(a).alias("_hi"))
            full = full.where((F.col("_c") > 2 * rows) & (F.col("_hi") > F.col("_lo")))
            full = cut_lineage(full.select(*keys, F.col(CELL).alias("_from"), F.ceil(F.col("_c") / F.lit(rows)).alias("_k"), "_lo", "_hi"))
            if full.isEmpty():
                break
            same = F.col(CELL) == F.col("_from")
            for k in keys:
                same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
            inner = F.floor((a - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_k"))
            # the ends get different slices even where the range is not finite, so each pass makes progress
            slice_no = F.when(a >= F.col("_hi"), F.col("_k") - 1).when(a <= F.col("_lo"), F.lit(0)).otherwise(F.least(inner, F.col("_k") - 1))
            path = F.concat(F.col(CELL), F.array(F.coalesce(slice_no, F.lit(0)).cast("long")))
            cols = [F.col(f"x.{c}") for c in out.columns if c != CELL]
            out = out.alias("x").join(full.alias("y"), same, "left").select(*cols, path.alias(CELL))
    return out


def one_cell(df: DataFrame) -> bool:
    """Whether every group of a frame with cells is known to be one cell, so that nothing is carried between cells."""
    return bool(df.schema[CELL].metadata.get(ONE_CELL))


SORTED_AS_NUMBER = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _as_number(df: DataFrame, column: str) -> Column:
    """A double that never falls as the column rises."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def position_cells(df: DataFrame, pos: str = "row_idx", rows: int | None = None, one: bool = False) -> DataFrame:
    """Add ``_cell`` from a dense row position: no statistics pass is needed. ``one``: the caller has shown (``fits_cell``)
    that every group fits one cell."""
    if one:
        return df.withColumn(CELL, F.lit(0).cast("long")).withMetadata(CELL, {ONE_CELL: True})
    rows = rows or cell_rows(df.sparkSession)
    return df.withColumn(CELL, F.floor(F.col(pos) / F.lit(rows)).cast("long"))


def fits_cell(df: DataFrame, pos: str = "row_idx") -> bool:
    """Whether the row positions show that every group fits one cell; reads the frame once."""
    return (df.agg(F.max(pos)).first()[0] or 0) < cell_rows(df.sparkSession)


def index_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], axis: str, name: str = "row_idx", count: str | None = None
) -> DataFrame:
    """Number the rows of each group 0..n-1 by ``order``; ``axis`` must be monotone in that order.

    ``count`` optionally names a column that receives the group size.
    """
    celled = add_cells(df, group, axis, order=order)
    whole = Window.partitionBy(*group)
    if one_cell(celled):  # one exchange, no join
        out = df.withColumn(name, (F.row_number().over(whole.orderBy(*order)) - 1).cast("long"))
        return out.withColumn(count, F.count(F.lit(1)).over(whole)) if count else out
    sizes = celled.groupBy(*group, CELL).agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.select(
        *group,
        CELL,
        (F.sum("_c").over(whole.orderBy(CELL)) - F.col("_c")).alias("_off"),
        F.sum("_c").over(whole).alias("_n"),
    )
    inside = F.row_number().over(Window.partitionBy(*group, CELL).orderBy(*order))
    out = celled.withColumn("_rn", inside).join(starts, [*group, CELL])
    out = out.withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
    if count:
        out = out.withColumn(count, F.col("_n").cast("long"))
    return out.drop(CELL, "_rn", "_off", "_n")


def framed(
    df: DataFrame,
    group: Sequence[str],
    before: int,
    after: int,
    build: Callable[[Window], Mapping[str, Column]],
    pos: str = "row_idx",
) -> DataFrame:
    """Add columns over row frames that reach at most ``before`` rows back and ``after`` rows ahead.

    ``build(w)`` receives a window ordered by ``pos``. Rows near a cell border are also copied into the neighbouring
    cell as context and dropped again afterwards: ``(before + after) / cellRows`` extra rows, one shuffle in total.
    """
    rows = max(cell_rows(df.sparkSession), before + after)
    p = F.col(pos)
    home = F.floor(p / F.lit(rows)).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.floor((p - after) / F.lit(rows)).cast("long"))
    last = F.floor((p + before) / F.lit(rows)).cast("long")
    spread = df.withColumn(CELL, F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*group, CELL).orderBy(pos)
    new = build(w)
    out = spread.select("*", *[c.alias(n) for n, c in new.items()])
    return out.where(F.col(CELL) == home).drop(CELL)


def centred(w: Window, n: int) -> Window:
    """Centred frame of ``n`` rows (odd ``n``)."""
    half = (n - 1) // 2
    return w.rowsBetween(-half, half)


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add inclusive running sums of ``sums`` over a frame that already has ``_cell``. Nulls count as zero."""
    named = {n: F.coalesce(e.cast("double"), F.lit(0.0)) for n, e in sums.items()}
    if one_cell(df):
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.select("*", *[F.sum(e).over(upto).alias(f"_in_{n}") for n, e in named.items()])
        return out.select(*[c for c in df.columns if c not in named], *[F.col(f"_in_{n}").alias(n) for n in named])
    keys = [*group, CELL]
    totals = df.groupBy(*keys).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in named.items()])
    earlier = Window.partitionBy(*group).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)).alias(f"_carry_{n}") for n in named]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select("*", *[F.sum(e).over(inside).alias(f"_in_{n}") for n, e in named.items()]).join(carry, keys)
    cols = [c for c in df.columns if c not in named]
    return out.select(*cols, *[(F.col(f"_in_{n}") + F.col(f"_carry_{n}")).alias(n) for n in named])


def neighbours(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add the last non-null value at or before each row (``previous``) and the first at or after it (``following``).

    The frame already has ``_cell``. Values may be structs.
    """
    previous, following = dict(previous or {}), dict(following or {})
    keys = list(group) if one_cell(df) else [*group, CELL]
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # The look-ahead runs as a look-back over the reversed order: growing frames cost O(1) per row, shrinking ones do not.
    back = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    found = {n: F.last(e, ignorenulls=True).over(upto) for n, e in previous.items()} | {n: F.last(e, ignorenulls=True).over(back) for n, e in following.items()}
    if one_cell(df):
        return df.select("*", *[e.alias(f"_i_{n}") for n, e in found.items()]).select(*df.columns, *[F.col(f"_i_{n}").alias(n) for n in found])
    rank = F.struct(*order)

    def when_set(e: Column) -> Column:
        return F.when(e.isNotNull(), rank)

    ends = df.groupBy(*keys).agg(
        *[F.max_by(e, when_set(e)).alias(f"_e_{n}") for n, e in previous.items()],
        *[F.min_by(e, when_set(e)).alias(f"_e_{n}") for n, e in following.items()],
    )
    cells = Window.partitionBy(*group).orderBy(CELL)
    before = cells.rowsBetween(Window.unboundedPreceding, -1)
    beyond = cells.rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(
        *keys,
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in previous],
        *[F.first(f"_e_{n}", ignorenulls=True).over(beyond).alias(f"_c_{n}") for n in following],
    )
    out = df.select("*", *[e.alias(f"_i_{n}") for n, e in found.items()]).join(carry, keys)
    return out.select(
        *df.columns, *[F.coalesce(F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n in [*previous, *following]]
    )


def with_group_stats(df: DataFrame, group: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Repeat group aggregates on every row: partial aggregation, then a join, never a whole-group window."""
    stats = df.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, list(group)) if group else df.join(F.broadcast(stats))
