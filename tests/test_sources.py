"""Formats: what is written is read again; damaged files are told apart."""

import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from footgrid.sources import files, wkb
from footgrid.sources.vector_files import GeoPackage, Shapefile, write_geopackage

SHAPES = [
    ("Point", [[(1.0, 2.0)]], [0]), ("LineString", [[(0.0, 0.0), (1.0, 1.5)]], [0]), ("Polygon", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]], [0]),
    ("MultiPoint", [[(1.0, 1.0)], [(2.0, 2.0)]], [0, 1]), ("MultiLineString", [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 5.0), (6.0, 6.0)]], [0, 1]),
]


@pytest.mark.parametrize("shape", SHAPES, ids=[s[0] for s in SHAPES])
def test_wkb_round_trip(shape):
    assert wkb.decode(wkb.encode(*shape)) == shape
    assert wkb.decode(b"GP\0\1" + struct.pack("<i", 2056) + wkb.encode(*shape)) == shape


def test_wkb_column(spark):
    df = spark.createDataFrame([(1, bytearray(wkb.encode(*SHAPES[2]))), (2, bytearray(b"junk")), (3, None)], "id long, geometry binary")
    got = {r.id: (r.kind, r.rings and len(r.rings)) for r in wkb.with_geometry(df).collect()}
    assert got == {1: ("Polygon", 2), 2: (None, None), 3: (None, None)}


def test_geopackage(spark, tmp_path):
    path = f"{tmp_path}/a.gpkg"
    rows = spark.createDataFrame([(bytearray(wkb.encode(*s)), i, f"n{i}", i / 2) for i, s in enumerate(SHAPES)], "geometry binary, fid long, name string, v double")
    assert write_geopackage(rows.toLocalIterator(), path, "things") == len(SHAPES)
    spark.dataSource.register(GeoPackage)
    read = spark.read.format("geopackage").option("path", path)
    got = read.option("layer", "things").load().orderBy("fid").collect()
    assert [wkb.decode(bytes(r.geometry)) for r in got] == SHAPES and [r.name for r in got] == [f"n{i}" for i in range(5)]
    assert read.option("columns", "fid").load().columns == ["geometry", "fid"]
    assert spark.read.format("geopackage").option("path", path).option("limit", "2").load().count() == 2
    with pytest.raises(Exception, match="no layer"):
        spark.read.format("geopackage").option("path", path).option("layer", "other").load()
    assert sqlite3.connect(path).execute("SELECT count(*) FROM things").fetchone()[0] == 5


def test_shapefile(spark, tmp_path):
    base = f"{tmp_path}/s"
    points = [(1.0, 2.0), (3.0, 4.0)]
    records = b"".join(struct.pack(">II", i + 1, 10) + struct.pack("<i2d", 1, *p) for i, p in enumerate(points))
    head = struct.pack(">I5II", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, 1, *[0.0] * 8)
    with open(base + ".shp", "wb") as f:
        f.write(head + records)
    fields = [(b"name", b"C", 6, 0), (b"n", b"N", 4, 0)]
    desc = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields)
    with open(base + ".dbf", "wb") as f:
        f.write(bytes([3, 24, 1, 1]) + struct.pack("<IHH", 2, 32 + len(desc) + 1, 11) + b"\0" * 20 + desc + b"\r" + b" first    1" + b" second   ")
    spark.dataSource.register(Shapefile)
    got = spark.read.format("shapefile").option("path", base + ".shp").load().collect()
    assert [(wkb.decode(bytes(r.geometry))[1][0][0], r.name, r.n) for r in got] == [((1.0, 2.0), "first", 1), ((3.0, 4.0), "second", None)]


def test_arrays_and_corrupt_files(spark, tmp_path):
    np.savez(f"{tmp_path}/a.npz", depth=np.array([[1, 9999], [3, 4]], np.float16), xyxy=np.zeros((2, 4)), conf=np.array([0.5, 0.9]), cls=np.array([1, 2]), shape=np.array([2, 2]))
    (tmp_path / "b.npz").write_bytes(b"broken")
    got = {r.path[-5:]: r for r in files.arrays(spark, f"file://{tmp_path}/*.npz", "depth").collect()}
    assert got["a.npz"].values == [1.0, 10000.0, 3.0, 4.0] and got["a.npz"].shape == [2, 2] and not got["b.npz"].success
    objects = files.detections(spark, f"file://{tmp_path}/*.npz").collect()
    assert sorted((r.success, r.conf) for r in objects if r.success) == [(True, 0.5), (True, 0.9)] and sum(not r.success for r in objects) == 1


def test_text_formats(spark, tmp_path):
    (tmp_path / "img1.txt").write_text("1 .5 .5 .1 .2\nbad row\n2 x .5 .1 .2\n\n")
    (tmp_path / "list.lst").write_text(" a/b.jpg \n\n c.png\n")
    (tmp_path / "doc.json").write_text('{"objects": [{"label": "car", "polygon": [[0, 0], [1, 1], [2, 0]]}]}')
    assert [tuple(r) for r in files.label_lines(spark, f"file://{tmp_path}/*.txt").collect()] == [("img1", 1, 0.5, 0.5, 0.1, 0.2)]
    assert sorted(r.path for r in files.path_list(spark, f"file://{tmp_path}/list.lst").collect()) == ["a/b.jpg", "c.png"]
    assert [(r.file, r.label, len(r.polygon)) for r in files.annotations(spark, f"file://{tmp_path}/doc.json").collect()] == [("doc", "car", 3)]
    there = files.with_presence(spark.createDataFrame([("img1",), ("img2",)], "id string"), "id", has_label=files.listing(spark, f"file://{tmp_path}", "*.txt"))
    assert sorted(map(tuple, there.collect())) == [("img1", True), ("img2", False)]


def test_blur_value(spark):
    g = np.arange(25.0).reshape(5, 5) ** 2
    df = spark.createDataFrame([("a", g.ravel().tolist(), [5, 5]), ("b", [1.0], [1, 1])], "path string, values array<double>, shape array<int>")
    want = np.array([[g[i - 1, j] + g[i + 1, j] + g[i, j - 1] + g[i, j + 1] - 4 * g[i, j] for j in range(1, 4)] for i in range(1, 4)]).var()
    assert {r.path: r.blur_value for r in files.blur_values(df).collect()} == {"a": pytest.approx(want), "b": None}


def test_geojson_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 8.5, 47.3)], "id long, x double, y double").select("id", F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"))
    assert files.geojson(df, "geometry", "id").first()[0] == '{"type":"Feature","geometry":{"type":"Point","coordinates":[8.5,47.3]},"properties":{"id":1}}'
    assert files.write_vector(df, f"{tmp_path}/x.geojson") == "geojson"
    assert files.write_vector(df.select("id"), f"{tmp_path}/x.csv") == "csv"


def test_features_and_collections(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"features": [{"geometry": {"type": "Point", "coordinates": [8.5, 47.3]}, "properties": {"id": "a", "is_pano": true}}, {"geometry": null, "properties": {"id": "b"}}]}')
    rows = files.feature_rows(spark, f"file://{tmp_path}/c.json", "id: string, is_pano: boolean").collect()
    assert [(r.id, r.is_pano, r.lon, r.lat) for r in rows] == [("a", True, 8.5, 47.3), ("b", None, None, None)]
    made = files.feature_collection(spark.createDataFrame([("1", "{}"), ("1", "{}"), ("2", "{}")], "k string, feature string"), "k")
    assert {r.k: r.collection for r in made.collect()} == {"1": '{"type":"FeatureCollection","features":[{},{}]}', "2": '{"type":"FeatureCollection","features":[{}]}'}


def test_wkb_written_again(spark):
    df = spark.createDataFrame([(i, bytearray(wkb.encode(*s))) for i, s in enumerate(SHAPES)], "id long, raw binary")
    again = wkb.with_wkb(wkb.with_geometry(df, "raw"))
    assert all(bytes(r.raw) == bytes(r.geometry) for r in again.collect())
