"""Column functions and geometry by hand values and by sampling."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from footgrid.functions import geometry as G
from footgrid.functions import scalar as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize("text, key", [("Fussgängerstreifen mit Insel", "fussgaengerstreifen_mit_insel"), ("30er-Zone-Markierung", "30er_zone_markierung"), ("  Ä/ß ", "ae_ss"), (None, None)])
def test_class_key(spark, text, key):
    assert one(spark, S.class_key(F.col("t")), t=text) == key


@pytest.mark.parametrize("text, tile", [("1234-5678", "1234-5678"), ("1234 5678", "1234-5678"), ("12345678", "1234-5678"), ("123-5678", None), (None, None)])
def test_tile_id(spark, text, tile):
    assert one(spark, S.tile_id(F.col("t")), t=text) == tile


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (150.0,)], "x double")
    got = [r[0] for r in df.select(S.clip(F.col("x"), 0, 100)).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [0.0, 100.0]


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "x int")
    assert [r[0] for r in df.where(S.not_in_or_null(F.col("x"), [1])).collect()] == [None, 2]


def test_base_name(spark):
    assert one(spark, S.base_name(F.col("t")), t="/a/b/c.d.jpg") == "c.d"


def test_geometry_json_reads_both_quotings(spark):
    for text in ("{'type': 'Point', 'coordinates': [1, 2]}", '{"type": "Point", "coordinates": [1, 2]}'):
        assert one(spark, S.geometry_json(F.col("t"))["coordinates"], t=text) == [1.0, 2.0]


def _sql(expression, **values):
    names = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in values.items())
    return duckdb.connect().execute(f"SELECT {expression} FROM (SELECT {names})").fetchall()[0][0]


def test_covered_share_by_sampling():
    rng, share = random.Random(1), G.covered_share("px", "py", "dx", "dy", "a", "b", "r")
    for _ in range(60):
        v = {k: rng.uniform(-20, 20) for k in ("px", "py", "dx", "dy")} | {"a": rng.uniform(0, 8), "b": rng.uniform(0, 8), "r": rng.uniform(0, 6)}
        if rng.random() < 0.2:
            v["dx"] = 0.0
        n, hits = 4000, 0
        for i in range(n):
            t = (i + 0.5) / n
            x, y = v["px"] + t * v["dx"], v["py"] + t * v["dy"]
            hits += math.hypot(max(abs(x) - v["a"], 0), max(abs(y) - v["b"], 0)) <= v["r"]
        assert abs(_sql(share, **v) - hits / n) < 2e-3


def test_covered_steps_equal_the_expression():
    rng, share = random.Random(4), G.covered_share("px", "py", "dx", "dy", "a", "b", "r")
    for _ in range(40):
        v = {k: float(rng.choice([0, 0, rng.uniform(-9, 9)])) for k in ("px", "py", "dx", "dy")} | {"a": rng.uniform(0, 4), "b": 0.0, "r": rng.choice([0.0, 2.0])}
        inner = "SELECT " + ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, x in v.items())
        for step in G.covered_steps("px", "py", "dx", "dy", "a", "b", "r"):
            inner = f"SELECT *, {', '.join(f'{e} AS {k}' for k, e in step.items())} FROM ({inner})"
        assert abs(duckdb.connect().execute(f"SELECT share FROM ({inner})").fetchall()[0][0] - _sql(share, **v)) < 1e-12


def test_point_segment_distance():
    d2 = G.point_segment_dist2("px", "py", "x1", "y1", "x2", "y2")
    assert _sql(d2, px=0, py=5, x1=-3, y1=0, x2=3, y2=0) == 25
    assert _sql(d2, px=7, py=3, x1=-3, y1=0, x2=3, y2=0) == 25
    assert _sql(d2, px=3, py=4, x1=0, y1=0, x2=0, y2=0) == 25


def test_swiss_projection_round_trip():
    lon, lat = 8.54, 47.37
    e, n = (_sql(x, lon=lon, lat=lat) for x in G.swiss_from_wgs84("lon", "lat"))
    back = [_sql(x, e=e, n=n) for x in G.wgs84_from_swiss("e", "n")]
    assert abs(e - 2683000) < 2000 and abs(n - 1247000) < 2000
    assert abs(back[0] - lon) < 3e-5 and abs(back[1] - lat) < 3e-5


def test_bounds_and_normalising(spark):
    df = spark.createDataFrame([([[1.0, 8.0], [3.0, 4.0]],)], "c array<array<double>>")
    assert tuple(df.select(S.bounds(F.col("c"))).first()[0]) == (1.0, 4.0, 3.0, 8.0)
    assert df.select(S.flat_normalised(F.col("c"), 10, 8)).first()[0] == [0.1, 1.0, 0.3, 0.5]
    p = spark.createDataFrame([(1.0, None, 3.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    assert [r[0] for r in p.select(S.normalised_probabilities([F.col(x) for x in "abc"])).collect()] == [[0.25, 0.0, 0.75], [0.0, 0.0, 0.0]]
