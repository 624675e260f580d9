"""Polygon areas: which points lie in which, which segments touch which.

An area is a key and its rings (exterior and holes, in any order). Borders are
cut into horizontal bands; a point meets only the edges of its own band and
their parity to its right decides, so points join areas by an equi-key, with no
shuffle of the points where the bands fit a broadcast. Segments meet border
edges in the cells that both pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footgrid.functions import geometry as G
from footgrid.operators.spatial import left_outer, with_line_cells

RINGS = "array<array<struct<x:double,y:double>>>"
BAND_M, CELL_M = 100.0, 200.0


def area_of(spark: SparkSession, rings) -> DataFrame:
    """One area (area, rings) from lists of (x, y)."""
    return spark.createDataFrame([(0, [[(float(x), float(y)) for x, y in ring] for ring in rings])], f"area int, rings {RINGS}")


def border(areas: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, x1, y1, x2, y2) of every border edge; a closing vertex makes no difference."""
    ring = areas.select(key, F.explode(rings).alias("_ring")).where("size(_ring) > 1")
    edge = F.transform(F.sequence(F.lit(0), F.size("_ring") - 1), lambda i: F.struct(F.get("_ring", i).alias("a"), F.get("_ring", (i + 1) % F.size("_ring")).alias("b")))
    long = ring.select(key, F.explode(edge).alias("e")).select(key, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return long.where("x1 <> x2 OR y1 <> y2")


def _band(c: Column) -> Column:
    return F.floor(c / F.lit(BAND_M)).cast("long")


def containing(points: DataFrame, x: str, y: str, edges: DataFrame, key: str) -> DataFrame:
    """``points`` with the key of every area that holds the point, by the even-odd rule; the left and lower borders are inside."""
    banded = edges.where("y1 <> y2").withColumn("_band", F.explode(F.sequence(_band(F.least("y1", "y2")), _band(F.greatest("y1", "y2")))))
    bands = banded.groupBy("_band", key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"), F.min(F.least("x1", "x2")).alias("_low"), F.max(F.greatest("x1", "x2")).alias("_high"))
    px, py = F.col(x), F.col(y)

    # The point goes with the count: Spark can push a filter to the side of the bands by mistake when a lambda function reads other columns.
    def crossed(s: Column, e: Column) -> Column:
        at = e["x1"] + (s["y"] - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (e["x2"] - e["x1"])
        n = s["n"] + F.when(((e["y1"] > s["y"]) != (e["y2"] > s["y"])) & (s["x"] < at), 1).otherwise(0)
        return F.struct(n.alias("n"), s["x"].alias("x"), s["y"].alias("y"))

    near = points.withColumn("_band", _band(py)).join(bands, "_band").where((px >= F.col("_low")) & (px <= F.col("_high")))
    point = F.struct(F.lit(0).alias("n"), px.alias("x"), py.alias("y"))
    return near.where(F.aggregate("_edges", point, crossed)["n"] % 2 == 1).drop("_band", "_edges", "_low", "_high")


def touching(segments: DataFrame, areas: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(fid, key) of segments and the areas they touch: a border crossed or met, or an end within."""
    edges = border(areas, key, rings)
    a = with_line_cells(segments.select("fid", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", CELL_M).select("fid", "_cx", "_cy", F.struct("x1", "y1", "x2", "y2").alias("a"))
    b = with_line_cells(edges, "x1", "y1", "x2", "y2", CELL_M).select(key, "_cx", "_cy", F.struct("x1", "y1", "x2", "y2").alias("b"))
    met = a.join(b, ["_cx", "_cy"]).where(G.segments_meet("a", "b")).select("fid", key)
    inside = containing(segments.select("fid", F.col("x1").alias("_px"), F.col("y1").alias("_py")), "_px", "_py", edges, key).select("fid", key)
    return met.unionByName(inside).distinct()


def join_areas(segments: DataFrame, areas: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """Segments with the attributes of every area that they touch; nulls where there is none."""
    found = touching(segments, areas, key, rings).join(areas.drop(rings), key)
    return left_outer(segments, segments.join(found, "fid"), "fid")


def _in_box(df: DataFrame, x: str, y: str, area) -> DataFrame:
    xs, ys = [p[0] for p in area[0]], [p[1] for p in area[0]]
    return df.where(F.col(x).between(float(min(xs)), float(max(xs))) & F.col(y).between(float(min(ys)), float(max(ys))))


def points_within(df: DataFrame, x: str, y: str, area: list[list[tuple[float, float]]]) -> DataFrame:
    """Rows whose point lies within one study area, given by its rings; the bounding box is compared first."""
    edges = border(area_of(df.sparkSession, area), "area").withColumnRenamed("area", "_area")
    return containing(_in_box(df, x, y, area), x, y, edges, "_area").drop("_area")


def segments_within(df: DataFrame, area: list[list[tuple[float, float]]]) -> DataFrame:
    """Segments that touch one study area."""
    xs, ys = [p[0] for p in area[0]], [p[1] for p in area[0]]
    near = df.where(G.segment_meets_box("x1", "y1", "x2", "y2", f"{min(xs)}", f"{min(ys)}", f"{max(xs)}", f"{max(ys)}"))
    return near.join(touching(near, area_of(df.sparkSession, area), "area").select("fid"), "fid", "left_semi")
