"""Spatial joins as equi-joins on grid cells.

A distance or intersection predicate alone compiles to a nested loop over all
pairs. Both sides are put into cells of a grid instead: points into one,
extents into all that they cover. Rows meet where they share a cell, the exact
predicate confirms, and the pair is reported from one cell only, that of the
lower left corner of the two extents' common part, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footgrid.storage import stored


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def with_cells(df: DataFrame, extent: tuple[str, str, str, str], size: float, tag: str) -> DataFrame:
    """One row for each cell that the extent (xmin, ymin, xmax, ymax as SQL) covers, and the extent's first cell."""
    xmin, ymin, xmax, ymax = (F.expr(e) for e in extent)
    return (
        df.withColumns({f"_{tag}x": _cell(xmin, size), f"_{tag}y": _cell(ymin, size)})
        .withColumn("_cx", F.explode(F.sequence(F.col(f"_{tag}x"), _cell(xmax, size))))
        .withColumn("_cy", F.explode(F.sequence(F.col(f"_{tag}y"), _cell(ymax, size))))
    )


def with_line_cells(df: DataFrame, x1: str, y1: str, x2: str, y2: str, size: float) -> DataFrame:
    """One row for each cell (_cx, _cy) that the line passes; a long one costs cells along it, not those of its box."""
    a, b, c, d = (F.col(n) for n in (x1, y1, x2, y2))
    cell = lambda v: F.floor(v / F.lit(size)).cast("long")
    strips = df.withColumn("_cx", F.explode(F.sequence(cell(F.least(a, c)), cell(F.greatest(a, c)))))
    left, right = F.greatest(F.col("_cx") * size, F.least(a, c)), F.least((F.col("_cx") + 1) * size, F.greatest(a, c))
    at = lambda v: F.when(a == c, b).otherwise(b + (v - a) / F.nullif(c - a, F.lit(0.0)) * (d - b))
    low = F.when(a == c, F.least(b, d)).otherwise(F.least(at(left), at(right)))
    high = F.when(a == c, F.greatest(b, d)).otherwise(F.greatest(at(left), at(right)))
    return strips.withColumn("_cy", F.explode(F.sequence(cell(low - 1e-6), cell(high + 1e-6))))  # the margin is for rounding


def cell_join(left: DataFrame, right: DataFrame, left_extent, right_extent, predicate: str, size: float) -> DataFrame:
    """Pairs that meet ``predicate``; column names of the sides must differ.

    Extents must be such that two rows can only fulfil the predicate if their
    extents overlap (widen one by the radius of a distance predicate).
    """
    a, b = with_cells(left, left_extent, size, "a"), with_cells(right, right_extent, size, "b")
    first = (F.col("_cx") == F.greatest("_ax", "_bx")) & (F.col("_cy") == F.greatest("_ay", "_by"))
    return a.join(b, ["_cx", "_cy"]).where(first).where(predicate).drop("_cx", "_cy", "_ax", "_ay", "_bx", "_by")


def left_outer(left: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Matches and, with nulls, the rows of ``left`` that have none."""
    return matches.unionByName(left.join(matches.select(key), key, "left_anti"), allowMissingColumns=True)


def point_extent(x: str, y: str, r: float = 0.0) -> tuple[str, str, str, str]:
    return f"{x}-{r}", f"{y}-{r}", f"{x}+{r}", f"{y}+{r}"


def segment_extent(x1: str, y1: str, x2: str, y2: str, r: str | float = 0.0) -> tuple[str, str, str, str]:
    return f"least({x1},{x2})-({r})", f"least({y1},{y2})-({r})", f"greatest({x1},{x2})+({r})", f"greatest({y1},{y2})+({r})"


def nearest_within(left: DataFrame, right: DataFrame, left_key: str, lx: str, ly: str, rx: str, ry: str, radius: float) -> DataFrame:
    """All right rows at the least distance of up to ``radius``; ties keep every row. Adds ``distance``."""
    d2 = f"({lx}-{rx})*({lx}-{rx})+({ly}-{ry})*({ly}-{ry})"
    near = cell_join(left, right, point_extent(lx, ly, radius), point_extent(rx, ry), f"{d2} <= {radius * radius}", radius)
    near = near.withColumn("distance", F.expr(f"sqrt({d2})"))
    return near.withColumn("_r", F.rank().over(Window.partitionBy(left_key).orderBy("distance"))).where("_r = 1").drop("_r")


def nearest_k(queries: DataFrame, points: DataFrame, k: int, query: str, point: str, coordinates: list[str], by: str | None = None, other_only: bool = False) -> DataFrame:
    """(query, by, point, d2, rank) of the k nearest points of each query, without any bound on the distance; the least point of equally near ones.

    Both sides have the coordinates, and ``by`` if only points of the same value
    count; ``other_only`` leaves out the query's own key. Cells are formed over
    the first two coordinates; a query looks at the cells around its own and is
    done once its k-th distance is less than a cell, since no other point can be
    nearer. The others go on to cells of twice the size, until one holds all.
    """
    keys = [by] if by else []
    x, y = coordinates[0], coordinates[1] if len(coordinates) > 1 else coordinates[0]
    box = points.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate((x, y)) for n, f in (("a", F.min), ("b", F.max))], F.count("*").alias("n")).unionByName(
        queries.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate((x, y)) for n, f in (("a", F.min), ("b", F.max))], F.lit(0).cast("long").alias("n"))
    ).collect()  # two rows
    if not box[0]["n"] or box[1]["a0"] is None:
        none = queries.select(query, *keys).crossJoin(points.select(point)).where(F.lit(False))
        return none.select(query, *keys, point, F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
    extent = max(max(r[f"b{i}"] for r in box) - min(r[f"a{i}"] for r in box) for i in (0, 1))
    size = max(extent / max(1.0, (box[0]["n"] / (2.0 * k)) ** 0.5), extent * 1e-6, 1e-9)
    d2 = " + ".join(f"(_q{i}-_p{i})*(_q{i}-_p{i})" for i in range(len(coordinates)))
    targets = points.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(keys)], F.col(point).alias("_point"), *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(coordinates)])
    left = queries.select(F.col(query).alias("_query"), *keys, *[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(coordinates)])
    done, j = None, min(1, len(coordinates) - 1)
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while True:
        last = size >= extent
        cell = lambda c, s=size: F.floor(F.col(c) / F.lit(float(s))).cast("long")
        asked = left.withColumn("_o", F.explode(around)).select("*", (cell("_q0") + F.col("_o.dx")).alias("_cx"), (cell(f"_q{j}") + F.col("_o.dy")).alias("_cy")).drop("_o")
        if j == 0:
            asked = asked.where("_cx = _cy")
        same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(keys)]
        there = targets.withColumns({"_tx": cell("_p0"), "_ty": cell(f"_p{j}")})
        condition = (F.col("_cx") == F.col("_tx")) & (F.col("_cy") == F.col("_ty"))
        for c in same:
            condition = condition & c
        if other_only:
            condition = condition & (F.col("_query") != F.col("_point"))
        near = asked.join(there, condition).withColumn("d2", F.expr(d2))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("_query", *keys).orderBy("d2", "_point"))).where(F.col("rank") <= k)
        found = stored(ranked.select("_query", *keys, "_point", "d2", "rank"), "nearest")
        if last:
            settled = found
        else:
            sure = found.where(F.col("rank") == k).where(F.col("d2") < size * size).select("_query", *keys)
            settled = found.join(sure, ["_query", *keys], "left_semi")
            left = stored(left.join(sure, ["_query", *keys], "left_anti"), "nearest-left")
        done = settled if done is None else done.unionByName(settled)
        if last or left.isEmpty():
            return done.select(F.col("_query").alias(query), *keys, F.col("_point").alias(point), "d2", "rank")
        size *= 2
