"""Helpers without a query of their own."""

import pytest
from pyspark.sql import functions as F

from footgrid.functions import scalar as S
from footgrid.operators import dataset, shapes
from footgrid.schema import nan_to_null
from footgrid.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_numbers_and_lists(spark):
    assert one(spark, S.number_or_zero(F.lit("3.5")), S.number_or_zero(F.lit("x")), S.number_or_zero(F.lit(None).cast("string"))) == (3.5, 0.0, 0.0)
    assert one(spark, S.first_of(F.array(F.lit("a"), F.lit("b"))), S.first_of(F.array().cast("array<string>"))) == ("a", None)
    assert one(spark, S.numbers_json(F.lit("[1, 2.5]")), S.numbers_json(F.lit("none"))) == ([1.0, 2.5], None)
    assert one(spark, S.safe_divide(F.lit(6.0), F.lit(3.0)), S.safe_divide(F.lit(6.0), F.lit(0.0)), S.safe_divide(F.lit(6.0), F.lit(0.0), 1.0)) == (2.0, 0.0, 1.0)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 2.0, None)], "i int, v double, s string")
    assert sorted(map(tuple, nan_to_null(df).collect()), key=lambda r: r[0]) == [(1, None, "a"), (2, 2.0, None)]


def test_heat_map_files(spark):
    df = spark.createDataFrame([("/d/heatmap_Tram_Rail.tif",), ("/d/other.tif",)], "path string")
    assert [tuple(r) for r in files.heatmap_catalogue(df).collect()] == [("Tram_Rail", "/d/heatmap_Tram_Rail.tif")]


def test_boxes_of_classes_and_map_corners(spark):
    lines = spark.createDataFrame([("Tram", 0.0, 0.0, 4.0, 0.0), ("Weg", 0.0, 0.0, 0.0, 6.0), ("Weg", 1.0, 1.0, 1.0, 1.0)], "class_name string, x1 double, y1 double, x2 double, y2 double")
    found = {r.class_name: {(round(p.x, 6), round(p.y, 6)) for p in r.corners} for r in shapes.class_boxes(lines, {"Tram": 3.0}).collect()}
    assert found == {"Tram": {(0.0, -1.5), (4.0, -1.5), (4.0, 1.5), (0.0, 1.5)}, "Weg": {(-1.0, 0.0), (1.0, 0.0), (1.0, 6.0), (-1.0, 6.0)}}
    tiles = spark.createDataFrame([([(1.0, 2.0)], 0.5, -0.5, 100.0, 200.0)], "corners array<struct<x:double,y:double>>, a double, e double, c double, f double")
    assert [tuple(p) for p in dataset.georeferenced(tiles).first().corners] == [(100.5, 199.0)]


def test_cells_within_an_area(spark):
    grid = spark.createDataFrame([(0.0, 10.0)], "xmin double, ymax double")
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(5) for c in range(5)], "row long, col long, value double")
    kept = shapes.clip_cells(cells, grid, [[(0.0, 6.0), (4.0, 6.0), (4.0, 10.0), (0.0, 10.0)]], 2.0)
    assert sorted((r.row, r.col) for r in kept.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_parts_of_multi_lines(spark):
    kind = "k int, parts array<array<struct<x:double,y:double>>>"
    df = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 5.0), (6.0, 7.0)]]), (2, []), (3, None)], kind)
    first, last = shapes.ends(F.col("parts"))
    got = {r.k: (r.a, r.b) for r in df.select("k", first.alias("a"), last.alias("b")).collect()}
    assert (tuple(got[1][0]), tuple(got[1][1])) == ((0.0, 0.0), (6.0, 7.0)) and got[2] == got[3] == (None, None)
    assert [(r.k, len(r.line)) for r in shapes.exploded(df, "parts", "line").collect()] == [(1, 2), (1, 2)]


def test_csv_with_a_header(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "n int, s string").coalesce(1).write.option("header", True).csv(f"file://{tmp_path}/t")
    assert files.csv_table(spark, f"file://{tmp_path}/t").dtypes == [("n", "int"), ("s", "string")]
    assert files.csv_table(spark, f"file://{tmp_path}/t", "n long, s string").first().n == 1


def test_label_files_meet_their_tiles(spark):
    labels = spark.createDataFrame([("a", "0 1 2"), ("b", "1 2 3")], "name string, labels string")
    tiles = spark.createDataFrame([("a", 512)], "name string, width int")
    assert [tuple(r) for r in dataset.with_tiles(labels, tiles).collect()] == [("a", "0 1 2", 512)]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_ends_of_nothing(spark, rows):
    df = spark.createDataFrame(rows, "line_id int, line array<struct<x:double,y:double>>")
    assert shapes.snapped(df, 1.0).count() == len(rows)
