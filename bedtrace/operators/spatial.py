"""Exact nearest-neighbour joins against a bank of points, and what is built on them.

The join never pairs every query with every point. The bank is described by a tree of square cells (point counts per
level, built with one aggregation). Query cells walk down that tree together, one join per level, keeping only the bank
cells that can still hold one of the k nearest points; the surviving cells, each at most ``leaf`` points large, are then
brought to the queries in tiles of bounded size. Distances exist only inside a task, which gives back k points per query.
Nothing is dropped that could matter, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.functions.columns import array_sum
from bedtrace.operators.cells import index_rows
from bedtrace.operators.quantiles import grouped_quantiles
from bedtrace.operators.sequence import even_sample
from bedtrace.session import bounded_batches, cut_lineage

LEAF = 128
DEEPEST = 52  # the bits of a double: below this level the places of two points in the square are the same number
LEVELS = 4  # of the tree in one pass over the points that are still in full cells
PLACE = ["_sp", "gl", "gx", "gy"]  # the cell in which queries are worked on
TILE, CHUNK, PACK, ROWS = 1024, 1024, 8192, 128  # points of a query cell, queries and points of a tile, queries at a time


def _trim_copies(bank: DataFrame, k: int) -> DataFrame:
    """Among points at the same place keep those that can be one of k neighbours of anyone.

    That is the first k points per owner (by id) of the first k + 1 owners (by their first id): whoever asks, at most one
    owner is excluded. The rank filters run partially before the shuffle, so a mass of copies is cut on the map side.
    """
    place = ["_sp", "_bx", "_by"]
    first = Window.partitionBy(*place, "_bo").orderBy("_bid")
    kept = bank.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
    owners = kept.groupBy(*place, "_bo").agg(F.min("_bid").alias("_f"))
    ranked = owners.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("_f", "_bo")))
    return kept.join(ranked.where(F.col("_r") <= k + 1).drop("_r", "_f"), [*place, "_bo"], "left_semi")


def _cell(v: Column, lo: Column, size: Column, level: Column | int) -> Column:
    return F.floor((v - lo) / size * F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))).cast("long")


def knn_join(
    query: DataFrame,
    bank: DataFrame,
    k: int,
    query_key: Sequence[str],
    query_xy: tuple[str, str],
    bank_xy: tuple[str, str],
    bank_id: str,
    query_owner: str | None = None,
    bank_owner: str | None = None,
    values: Sequence[str] = (),
    space: Sequence[str] = (),
    scaled: bool = True,
    leaf: int = LEAF,
) -> DataFrame:
    """The k nearest bank points of every query row, own points excluded, ties in distance by ``bank_id``.

    ``space`` names columns both sides share that split the bank into separate banks (for example surface and fold).
    With ``scaled`` both axes are divided by the population std of the bank (1 where that is below 1e-3), per space.
    Returns ``query_key``, ``space``, ``query_x/query_y``, ``nb_id``, ``nb_x``, ``nb_y``, ``values``, ``dist`` and
    ``rank``; coordinates are unscaled.
    """
    sp = F.struct(*space) if space else F.lit(0)
    bx, by = (F.col(c).cast("double") for c in bank_xy)
    qx, qy = (F.col(c).cast("double") for c in query_xy)
    pts = bank.select(
        sp.alias("_sp"), bx.alias("_ux"), by.alias("_uy"), F.col(bank_id).alias("_bid"),
        (F.col(bank_owner) if bank_owner else F.lit(0)).alias("_bo"), *values,
    ).where(F.col("_ux").isNotNull() & F.col("_uy").isNotNull())
    asks = query.select(
        *query_key, *space, qx.alias("query_x"), qy.alias("query_y"), sp.alias("_sp"), *([query_owner] if query_owner else [])
    ).where(F.col("query_x").isNotNull() & F.col("query_y").isNotNull())
    frame = cut_lineage(_frame(pts, asks, scaled))
    place = {"_bx": F.col("_ux") / F.col("_sx"), "_by": F.col("_uy") / F.col("_sy")}
    pts = cut_lineage(_trim_copies(pts.join(frame, "_sp").withColumns(place).drop("_sx", "_sy"), k))
    tree, homes = _cell_tree(pts, leaf)
    depth = tree.agg(F.max("lv")).first()[0] or 0  # one number

    # Queries are worked on by cell of the tree; all query cells walk down the tree together.
    asks = asks.join(frame, "_sp").withColumns({"_qx": F.col("query_x") / F.col("_sx"), "_qy": F.col("query_y") / F.col("_sy")})
    asks = asks.withColumns({
        "_fx": _cell(F.col("_qx"), F.col("_x0"), F.col("_size"), depth),
        "_fy": _cell(F.col("_qy"), F.col("_y0"), F.col("_size"), depth)}).drop("_x0", "_y0", "_size", "_qx", "_qy")
    cells = _query_cells(asks, tree, depth)
    unit = F.col("_size") / F.pow(F.lit(2.0), F.col("gl"))
    reach = cells.select(*PLACE, "_chunks").distinct().join(frame.drop("_sx", "_sy"), "_sp").withColumns({
        "_ax": F.col("_x0") + F.col("gx") * unit, "_ay": F.col("_y0") + F.col("gy") * unit, "_u": unit})
    reach = reach.join(tree.where("lv = 0").drop("px", "py").withColumn("_most", F.col("m")), "_sp")
    for level in range(depth):
        stay = reach.where(F.col("is_leaf"))
        kids = tree.where(F.col("lv") == level + 1).select("_sp", F.col("px").alias("cx"), F.col("py").alias("cy"),
                                                           F.struct("lv", "cx", "cy", "n", "m", "is_leaf").alias("_kid"))
        down = reach.where(~F.col("is_leaf")).drop("lv", "n", "m", "is_leaf").join(kids, ["_sp", "cx", "cy"])
        down = down.drop("cx", "cy").select("*", "_kid.*").drop("_kid")
        reach = _still_possible(stay.unionByName(down), k)
        if level % 2 == 1 and level < depth - 1:
            reach = cut_lineage(reach)
    # the leaves of a query cell are taken together up to PACK points, so one tile is bounded whatever the reach
    before = Window.partitionBy(*PLACE).orderBy("lv", "cx", "cy").rowsBetween(Window.unboundedPreceding, -1)
    reach = cut_lineage(reach.select(*PLACE, "_chunks", "lv", "cx", "cy", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / PACK).alias("_pack")))

    both_owned = bool(query_owner and bank_owner)
    leaves = homes.groupBy("_sp", "lv", "cx", "cy").agg(F.collect_list(F.struct("_bid", "_ux", "_uy", *(["_bo"] if both_owned else []), *values)).alias("_pts"))
    near = reach.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).join(leaves, ["_sp", "lv", "cx", "cy"])
    near = near.select(*PLACE, "_chunk", "_pack", "_pts").repartition(*PLACE, "_chunk")
    near = near.groupBy(*PLACE, "_chunk", "_pack").agg(F.sort_array(F.flatten(F.collect_list("_pts"))).alias("_pts"))
    asks = asks.join(cells, ["_sp", "_fx", "_fy"]).withColumn("_chunk", F.pmod(F.xxhash64(*query_key), F.col("_chunks")))
    asked = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(query_key)], "query_x", "query_y", *([F.col(query_owner).alias("_qo")] if both_owned else []))
    asks = asks.groupBy(*PLACE, "_chunk").agg(F.collect_list(asked).alias("_asks"), F.first("_sx").alias("_sx"), F.first("_sy").alias("_sy"))
    return _neighbour_rows(asks.join(near, [*PLACE, "_chunk"]), query_key, space, values, k, both_owned)


def _frame(pts: DataFrame, asks: DataFrame, scaled: bool) -> DataFrame:
    """Per space: the scale of both axes and the square around all points and queries, in scaled units."""
    both = pts.select("_sp", F.col("_ux").alias("x"), F.col("_uy").alias("y"), F.lit(True).alias("b")).unionByName(
        asks.select("_sp", F.col("query_x").alias("x"), F.col("query_y").alias("y"), F.lit(False).alias("b")))

    def axis(c: str) -> Column:
        s = F.stddev_pop(F.when(F.col("b"), F.col(c))) if scaled else F.lit(1.0)
        return F.when(F.coalesce(s, F.lit(0.0)) < 1e-3, 1.0).otherwise(s)

    d = both.groupBy("_sp").agg(axis("x").alias("_sx"), axis("y").alias("_sy"), F.min("x").alias("x0"), F.min("y").alias("y0"),
                                F.max("x").alias("x1"), F.max("y").alias("y1"))
    side = F.greatest((F.col("x1") - F.col("x0")) / F.col("_sx"), (F.col("y1") - F.col("y0")) / F.col("_sy"), F.lit(1e-9))
    return d.select("_sp", "_sx", "_sy", (F.col("x0") / F.col("_sx")).alias("_x0"), (F.col("y0") / F.col("_sy")).alias("_y0"),
                    (side * 1.000001).alias("_size"))


def _cell_tree(pts: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Cells with point count ``n`` and the largest count of one owner ``m``, children only of full cells, and the points
    with the leaf they lie in.

    A pass writes the points out for LEVELS levels; those in cells that are still full afterwards go on to the next
    pass, so a point meets the levels down to its leaf and a dense spot is cut until no leaf holds more than ``leaf``
    points, however small the spot is. Only points at one place (cut to a bounded number before) stay together.
    """
    todo, trees, homes, low = pts, [], [], 0
    while True:
        top = min(low + LEVELS, DEEPEST + 1)
        at = todo.withColumn("lv", F.explode(F.sequence(F.lit(low), F.lit(top - 1)))).withColumns({
            "cx": _cell(F.col("_bx"), F.col("_x0"), F.col("_size"), F.col("lv")), "cy": _cell(F.col("_by"), F.col("_y0"), F.col("_size"), F.col("lv"))})
        owners = at.groupBy("_sp", "lv", "cx", "cy", "_bo").agg(F.count(F.lit(1)).alias("c"), *[f(c).alias(f"{n}{c}") for c in ("_bx", "_by") for n, f in (("lo", F.min), ("hi", F.max))])
        cells = owners.groupBy("_sp", "lv", "cx", "cy").agg(
            F.sum("c").alias("n"), F.max("c").alias("m"), ((F.min("lo_bx") == F.max("hi_bx")) & (F.min("lo_by") == F.max("hi_by"))).alias("_one"))
        cells = cut_lineage(cells.withColumn("is_leaf", (F.col("n") <= leaf) | F.col("_one") | (F.col("lv") == DEEPEST)).drop("_one"))
        # a cell counts only below a full one; all cells of the first level do, since the pass before let only those through
        kept = cells.where(F.col("lv") == low)
        for lv in range(low + 1, top):
            full = kept.where((F.col("lv") == lv - 1) & ~F.col("is_leaf")).select("_sp", F.col("cx").alias("px"), F.col("cy").alias("py"))
            level = cells.where(F.col("lv") == lv).withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)})
            kept = kept.unionByName(level.join(full, ["_sp", "px", "py"], "left_semi").drop("px", "py"))
        kept = cut_lineage(kept)
        trees.append(kept)
        homes.append(at.join(kept.where("is_leaf").select("_sp", "lv", "cx", "cy"), ["_sp", "lv", "cx", "cy"], "left_semi").drop("_x0", "_y0", "_size"))
        open_cells = kept.where((F.col("lv") == top - 1) & ~F.col("is_leaf")).select("_sp", "lv", "cx", "cy")
        if open_cells.isEmpty():
            break
        todo = cut_lineage(at.join(open_cells, ["_sp", "lv", "cx", "cy"], "left_semi").drop("lv", "cx", "cy"))
        low = top
    tree = cut_lineage(reduce(DataFrame.unionByName, trees).withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)}))
    return tree, cut_lineage(reduce(DataFrame.unionByName, homes))


def _still_possible(reach: DataFrame, k: int) -> DataFrame:
    """Drop bank cells that lie farther from the query cell than k certain neighbours do."""
    side = F.col("_size") / F.pow(F.lit(2.0), F.col("lv"))
    left, low = F.col("_x0") + F.col("cx") * side, F.col("_y0") + F.col("cy") * side
    gap_x = F.greatest(left - F.col("_ax") - F.col("_u"), F.col("_ax") - left - side, F.lit(0.0))
    gap_y = F.greatest(low - F.col("_ay") - F.col("_u"), F.col("_ay") - low - side, F.lit(0.0))
    far_x = F.greatest(F.abs(left + side - F.col("_ax")), F.abs(F.col("_ax") + F.col("_u") - left))
    far_y = F.greatest(F.abs(low + side - F.col("_ay")), F.abs(F.col("_ay") + F.col("_u") - low))
    r = reach.withColumns({"_near": F.hypot(gap_x, gap_y), "_far": F.hypot(far_x, far_y)})
    per_cell = Window.partitionBy(*PLACE)
    upto = per_cell.orderBy("_far", "lv", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)
    # Whoever owns the query: a cell holds at least n - m foreign points, and all cells so far at least sum(n) - most.
    enough = (F.sum(F.col("n") - F.col("m")).over(upto) >= k) | (F.sum("n").over(upto) >= F.col("_most") + k)
    r = r.withColumn("_ok", F.when(enough, F.col("_far")))
    r = r.withColumn("_ub", F.min("_ok").over(per_cell))
    # The margin covers rounding of the cell borders; it can only keep a cell too many.
    margin = (F.col("_size") + F.abs("_x0") + F.abs("_y0")) * 1e-14
    return r.where(F.col("_ub").isNull() | (F.col("_near") <= F.col("_ub") + margin)).drop("_near", "_far", "_ok", "_ub")


def _query_cells(asks: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """Per finest cell with queries the cell ``(gl, gx, gy)`` they are worked on in, and into how many ``_chunks`` it is cut.

    That is the first cell on the way down with at most TILE points, or the first without any.
    """
    spots = asks.groupBy("_sp", "_fx", "_fy").agg(F.count(F.lit(1)).alias("_c"))
    way = spots.select("_sp", "_fx", "_fy", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("lv"))
    way = way.withColumns({"cx": F.expr(f"shiftright(_fx, {depth} - lv)"), "cy": F.expr(f"shiftright(_fy, {depth} - lv)")})
    small = F.when((F.col("n") <= TILE) | F.col("is_leaf"), F.col("lv"))
    way = way.join(tree.select("_sp", "lv", "cx", "cy", "n", "is_leaf"), ["_sp", "lv", "cx", "cy"])
    level = way.groupBy("_sp", "_fx", "_fy").agg(F.coalesce(F.min(small), F.max("lv") + 1).alias("gl"))
    d = spots.join(level, ["_sp", "_fx", "_fy"])
    d = d.withColumns({"gx": F.expr(f"shiftright(_fx, {depth} - gl)"), "gy": F.expr(f"shiftright(_fy, {depth} - gl)")})
    sizes = d.groupBy(*PLACE).agg(F.ceil(F.sum("_c") / CHUNK).alias("_chunks"))
    return cut_lineage(d.drop("_c").join(sizes, PLACE))


def _owner_code(c: Column, kind: T.DataType) -> Column:
    """Equal for equal owners, nulls included, and never null."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.coalesce(c.cast("long"), F.lit(1 << 40))
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _nearest(k: int):
    """Places of the k nearest points (ordered by id, so that the first of equal ones wins) of every query of a tile."""
    found = T.ArrayType(T.StructType([T.StructField("q", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("dist", T.DoubleType())]))

    def tile(qx, qy, px, py, qo=None, po=None) -> list[tuple]:
        if qo is not None:
            codes = pd.factorize(np.concatenate([np.asarray(qo), np.asarray(po)]))[0]
            qo, po = codes[: len(qx)], codes[len(qx) :]
        out = []
        for lo in range(0, len(qx), ROWS):
            at = slice(lo, lo + ROWS)
            dx, dy = qx[at, None] - px, qy[at, None] - py
            dist = np.sqrt(dx * dx + dy * dy)
            if qo is not None:
                dist[qo[at, None] == po] = np.inf
            edge = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] if dist.shape[1] > k else np.inf
            q, p = np.nonzero((dist <= edge) & (dist < np.inf))
            d = dist[q, p]
            order = np.lexsort((p, d, q))
            q, p, d = q[order], p[order], d[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            out += zip((q[first] + lo).tolist(), p[first].tolist(), d[first].tolist())
        return out

    def nearest(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in parts:
            yield pd.Series([tile(*[np.asarray(c) for c in row]) for row in zip(*cols)], dtype=object)

    return F.pandas_udf(nearest, found)


def _neighbour_rows(tiles: DataFrame, query_key: Sequence[str], space: Sequence[str], values: Sequence[str], k: int, owned: bool) -> DataFrame:
    """The nearest points inside every tile, then the k nearest of them for every query."""
    bounded_batches(tiles.sparkSession)
    args = [F.transform("_asks", lambda a: a["query_x"] / F.col("_sx")), F.transform("_asks", lambda a: a["query_y"] / F.col("_sy")),
            F.transform("_pts", lambda p: p["_ux"] / F.col("_sx")), F.transform("_pts", lambda p: p["_uy"] / F.col("_sy"))]
    if owned:
        kinds = [tiles.schema[c].dataType.elementType[f].dataType for c, f in (("_asks", "_qo"), ("_pts", "_bo"))]
        args += [F.transform("_asks", lambda a: _owner_code(a["_qo"], kinds[0])), F.transform("_pts", lambda p: _owner_code(p["_bo"], kinds[1]))]
    d = tiles.withColumn("_found", _nearest(k)(*args))
    hit = F.transform("_found", lambda f: F.struct(F.get("_asks", f["q"]).alias("a"), F.get("_pts", f["p"]).alias("b"), f["dist"].alias("dist")))
    d = d.select("_sp", F.explode(hit).alias("_h")).select("_sp", "_h.*")
    d = d.select(*[F.col(f"a.k{i}").alias(c) for i, c in enumerate(query_key)], *[F.col(f"_sp.{c}").alias(c) for c in space], "a.query_x", "a.query_y",
                 F.col("b._bid").alias("nb_id"), F.col("b._ux").alias("nb_x"), F.col("b._uy").alias("nb_y"), *[F.col(f"b.{c}").alias(c) for c in values], "dist")
    w = Window.partitionBy(*query_key, *space).orderBy("dist", "nb_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def idw(nb: DataFrame, key: Sequence[str], value: str, weight: Column) -> DataFrame:
    """Weighted mean, weighted population std and nearest distance of the (at most k) neighbours of every key."""
    return idw_columns(nb, key, {value: ("idw", "idw_std")}, weight)


def idw_columns(nb: DataFrame, key: Sequence[str], values: Mapping[str, tuple[str, str]], weight: Column) -> DataFrame:
    """``idw`` of several columns in one pass: ``{column: (name of the mean, name of the std)}``."""
    near = F.collect_list(F.struct(weight.alias("w"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)]))
    d = nb.groupBy(*key).agg(near.alias("_n"), F.min("dist").alias("nearest"))
    d = d.withColumn("_t", array_sum(F.transform("_n", lambda e: e.w)))

    def mean(v: str) -> Column:
        return F.try_divide(array_sum(F.transform("_n", lambda e: e.w * e[v])), F.col("_t"))

    def spread(v: str, m: str) -> Column:
        return F.try_divide(array_sum(F.transform("_n", lambda e: e.w * (e[v] - F.col(m)) * (e[v] - F.col(m)))), F.col("_t"))

    d = d.withColumns({f"_m{i}": mean(f"v{i}") for i in range(len(values))})
    out = []
    for i, (name, std) in enumerate(values.values()):
        out += [F.col(f"_m{i}").alias(name), F.sqrt(F.greatest(spread(f"v{i}", f"_m{i}"), F.lit(0.0))).alias(std)]
    # The neighbours are costly to find and callers read this more than once: keep the one row per key.
    return cut_lineage(d.select(*key, *out, "nearest"))


def plane_fit(nb: DataFrame, key: Sequence[str], surfaces: Sequence[str], weight: Column, ridge: float = 1e-9) -> DataFrame:
    """Weighted plane z = a x + b y + c through the neighbours, evaluated at the query; one column per surface.

    Coordinates are centred on the query, so the value is the constant term. A singular system gives the weighted mean.
    """
    u, v = F.col("nb_x") - F.col("query_x"), F.col("nb_y") - F.col("query_y")
    sums = {"_w": weight, "_wu": weight * u, "_wv": weight * v, "_uu": weight * u * u, "_uv": weight * u * v, "_vv": weight * v * v}
    for s in surfaces:
        z = F.col(s).cast("double")
        sums.update({f"_z_{s}": weight * z, f"_zu_{s}": weight * u * z, f"_zv_{s}": weight * v * z})
    d = nb.groupBy(*key).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    w, wu, wv, uv = (F.col(c) for c in ("_w", "_wu", "_wv", "_uv"))
    uu, vv, ww = F.col("_uu") + ridge, F.col("_vv") + ridge, w + ridge
    det = uu * (vv * ww - wv * wv) - uv * (uv * ww - wv * wu) + wu * (uv * wv - vv * wu)
    out = []
    for s in surfaces:
        z, zu, zv = F.col(f"_z_{s}"), F.col(f"_zu_{s}"), F.col(f"_zv_{s}")
        top = uu * (vv * z - wv * zv) - uv * (uv * z - wv * zu) + wu * (uv * zv - vv * zu)
        out.append(F.coalesce(F.try_divide(top, det), F.try_divide(z, w)).alias(s))
    return d.select(*key, *out)


def group_medians(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """One median point per group, over rows where all columns are set."""
    return grouped_quantiles(df.na.drop(subset=list(cols)), [group], {c: (F.col(c), 0.5) for c in cols})


def sampled_bank(df: DataFrame, group: str, order: Sequence[str], axis: str, cols: Sequence[str], m: int) -> DataFrame:
    """Up to ``m`` evenly spaced rows per group, over rows where all columns are set."""
    usable = df.na.drop(subset=list(cols)).drop("row_idx")
    return even_sample(index_rows(usable, [group], order, axis), [group], m)


def neighbour_curve(
    rows: DataFrame, nb: DataFrame, group: str, key: Sequence[str], value: str, z: str, known_u: Column, gate: float, min_known: int,
    floor: float = 1.0,
) -> DataFrame:
    """Surface carried over from neighbours: inverse-square weights, moved by the median known offset, minus z.

    A group is left out when a row has no neighbour, its median nearest distance exceeds ``gate`` or it has too few known
    rows.
    """
    d2 = F.greatest(F.col("dist"), F.lit(floor))
    u = idw(nb, key, value, 1.0 / (d2 * d2))
    d = rows.join(u, list(key), "left")
    d = d.withColumn("_diff", known_u - F.col("idw"))
    counts = d.groupBy(group).agg(F.count_if(F.col("idw").isNull()).alias("_bare"), F.count("_diff").alias("_k"))
    med = grouped_quantiles(d, [group], {"_gate": (F.col("nearest"), 0.5), "_off": (F.col("_diff"), 0.5)})
    ok = counts.join(med, group).where((F.col("_bare") == 0) & (F.col("_k") >= min_known) & (F.col("_gate") <= gate))
    return d.join(ok.select(group, "_off"), group).withColumn("neighbour_pred", F.col("idw") - F.col(z) + F.col("_off")).drop("_diff", "_off")
