"""What went wrong on larger tables, each in small."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from footgrid import storage
from footgrid.functions import geometry as G
from footgrid.operators import depth, features, raster
from tests.compare import query_rows, sql_rows


def test_segment_renode_counts_crossings_where_roads_lie_along_each_other(spark, tmp_path):
    import __spark_entry__

    # Keys of 0.1 GB and more give roads of one direction on one line.
    keys = [k for k in range(0, 200_000) if (k * 197) % 2003 < 60 and (k * 313) % 1999 < 60]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = query_rows(__spark_entry__.queries()["segment_renode"](spark, str(tmp_path)))
    assert got == sql_rows(__spark_entry__.oracle_sql()["segment_renode"], tmp_path)


def test_covered_shares_of_arrays_equal_the_expression():
    rng = random.Random(5)
    rows = [{k: float(rng.choice([0, 0, rng.uniform(-9, 9), rng.randint(-4, 4)])) for k in ("px", "py", "dx", "dy")} | {"a": rng.uniform(0, 4), "b": rng.choice([0.0, 2.0]), "r": rng.choice([0.0, 2.0])} for _ in range(300)]
    share = G.covered_share("px", "py", "dx", "dy", "a", "b", "r")
    values = ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" for x in v.values()) + ")" for v in rows)
    want = [x[0] for x in duckdb.connect().execute(f"SELECT {share} FROM (VALUES {values}) t({', '.join(rows[0])})").fetchall()]
    assert np.allclose(G.covered_shares(*(np.array([v[k] for v in rows]) for k in ("px", "py", "dx", "dy", "a", "b", "r"))), want, atol=1e-9)


def test_overlay_makes_no_row_for_a_pair(spark):
    """Segments and polygons that lie close together: the right sums, from one row for each segment and class of a cell."""
    segs = spark.range(300).selectExpr("id AS fid", "double(id % 20) AS x1", "double(id % 7) AS y1", "double(id % 20 + 10) AS x2", "double(id % 7) AS y2", "10.0D AS length_m")
    polys = spark.range(400).selectExpr("'Schule' AS class_name", "double(id % 30) AS cx", "double(id % 9) AS cy", "2.0D AS hw", "1.0D AS hh", "1.0D AS ca", "0.0D AS sa", "0.5D + id / 1000 AS confidence")
    found = features.overlay(segs, polys)
    got = {r["fid"]: r for r in found.collect()}
    boxes = [(i % 30, i % 9, 0.5 + i / 1000) for i in range(400)]
    for i in range(300):
        x, y = i % 20, i % 7
        parts = [(max(0, min(x + 10, cx + 2) - max(x, cx - 2)), c) for cx, cy, c in boxes if abs(y - cy) <= 1]
        assert got[i]["covered"] == pytest.approx(sum(p for p, _ in parts)) and got[i]["max_conf"] == max(c for p, c in parts if p > 0)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()


def test_dense_images_are_settled_without_pairs(spark):
    """Neighbours by brute force; images in dense cells never reach the comparison of places."""
    rng = random.Random(8)
    rows = [("Crosswalk", f"d{i}", float(rng.randint(0, 6)), float(rng.randint(0, 6))) for i in range(300)]
    rows += [("Crosswalk", f"s{i}", rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(120)] + [("Arrow", "one", 900.0, 900.0), ("Crosswalk", "alone", 900.0, 900.0)]
    images = spark.createDataFrame(rows, "group string, image_id string, x double, y double")
    got = {r["image_id"] for r in raster.lonely(images).collect()}
    least = {"Crosswalk": 2, "Arrow": 1}
    want = {i for g, i, x, y in rows if sum(h == g and (x - a) ** 2 + (y - b) ** 2 < 225 for h, _, a, b in rows) < least[g]}
    assert got == want and "alone" in got
    asked = spark.read.parquet(max((p for p in storage._made[spark.sparkContext.applicationId] if "heat-asked" in p), key=lambda p: spark._jvm.java.io.File(p[7:]).lastModified()))
    assert asked.where("image_id LIKE 'd%'").isEmpty()


@pytest.mark.parametrize("method", depth.METHODS)
def test_box_depths_equal_region_depth(spark, method):
    """Maps of their own size and of half of it, with nulls and invalid values; also repeated image ids. No row holds a map and one box."""
    rng = random.Random(9)
    value = lambda: rng.choice([None, 9999.0, *(float(rng.randint(0, 40)) for _ in range(8))])
    images = spark.createDataFrame([(i // 2, 8, 6) for i in range(12)], "image_id long, width int, height int")
    objects = [(i, [(1, 0.9, x, y, x + rng.randint(0, 5), y + rng.randint(1, 4)) for x, y in ((rng.randint(-2, 7), rng.randint(-2, 5)) for _ in range(4))] + [(1, 0.9, None, 0, 3, 3)]) for i in range(6)]
    det = spark.createDataFrame(objects, "image_id long, objects array<struct<label:int,confidence:double,x1:int,y1:int,x2:int,y2:int>>")
    maps = [(i, 8, 6, [value() for _ in range(48)]) if i % 2 else (i, 4, 3, [value() for _ in range(12)]) for i in range(6)]
    found, _ = depth.combine_maps(images, det, spark.createDataFrame(maps, "image_id long, width int, height int, values array<double>"), method=method)
    got = sorted((r["image_id"], r["object_no"], round(r["depth"], 9)) for r in found.collect())
    want = []
    for (i, boxes), (_, w, h, values) in zip(objects, maps):
        for n, (_, _, *corners) in enumerate(boxes):
            if None in corners:
                continue
            x1, y1, x2, y2 = (max(0, min(c, m)) for c, m in zip(corners, (7, 5, 8, 6)))
            region = [values[int((y + 0.5) * h / 6) * w + int((x + 0.5) * w / 8)] for y in range(y1, y2) for x in range(x1, x2)]
            want += [(i, n, region)] * 2
    regions = spark.createDataFrame(want, "i long, n int, region array<double>").select("i", "n", depth.region_depth(F.col("region"), method).alias("depth")).where("depth IS NOT NULL")
    assert got == sorted((r["i"], r["n"], round(r["depth"], 9)) for r in regions.collect()) and got
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
