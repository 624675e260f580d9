"""Operators against brute force, and the chosen behaviour in the traps."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from footgrid import params
from footgrid.operators import aerial, depth, geolocate, ml, network, raster, routing, scoring
from footgrid.operators.rules import Rules, crossing_rules
from footgrid.operators.spatial import cell_join, left_outer, point_extent
from footgrid.schema import require_columns, unique_or_raise, with_row_id


def test_cell_join_equals_nested_loop(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)]
    b = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)]
    got = cell_join(
        spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "j long, u double, v double"), point_extent("x", "y", 7.0), point_extent("u", "v"), "(x-u)*(x-u)+(y-v)*(y-v) <= 49", 7.0
    ).select("i", "j").collect()
    want = [(p[0], q[0]) for p in a for q in b if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 49]
    assert sorted(map(tuple, got)) == sorted(want)


def test_left_outer_keeps_unmatched(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    out = left_outer(left, spark.createDataFrame([(1, "a")], "k int, v string"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, None)]


def test_many_to_one_raises_on_duplicate(spark):
    df = spark.createDataFrame([("a",), ("a",)], "id string")
    with pytest.raises(Exception, match="duplicate id"):
        unique_or_raise(df, "id").collect()
    with pytest.raises(ValueError):
        require_columns(df, "nope")
    assert [r.n for r in with_row_id(df, "n", "id").collect()] == [0, 1]


def test_blur_null_is_sharp_and_pano_null_stays(spark):
    cams = spark.createDataFrame([("1", None), ("2", 50.0), ("3", 100.0)], "id string, blur_value double")
    assert [r.is_blurry for r in geolocate.blur_flags(cams).orderBy("id").collect()] == [False, True, False]
    row = spark.createDataFrame([(0.0, 0.0, None, 90.0, 0, 1024, "near"), (0.0, 0.0, False, 90.0, 0, 1024, "near"), (0.0, 0.0, False, None, 0, 1024, "near")], "x double, y double, is_pano boolean, compass double, bx1 int, bx2 int, z_class string")
    got = [(round(r.x_adj, 6), round(r.y_adj, 6)) for r in geolocate.adjusted(row).collect()]
    assert got == [(0.0, 0.0), (7.5, 0.0), (0.0, 0.0)]


def test_depth_sentinel_as_stored_in_half_precision(spark):
    df = spark.createDataFrame([([1.0, 3.0, 10000.0, 9999.0],), ([9999.0],), ([],)], "r array<double>")
    assert [r[0] for r in df.select(depth.region_depth(F.col("r"), "median")).collect()] == [2.0, None, None]
    assert [r[0] for r in df.select(depth.region_depth(F.col("r"), "center", width=2)).collect()] == [None, None, None]
    assert df.select(depth.inverted(F.col("r"))).first()[0][:2] == [10000.0, 9998.0]


@pytest.mark.parametrize("method, most", [("thirds", 3), ("quantile", 4), ("thresholds", 3)])
def test_depth_classes_cover_all(spark, method, most):
    df = spark.createDataFrame([("a", float(i), 0.9) for i in range(20)] + [("b", 1.0, 0.9)], "image_id string, depth double, confidence double")
    classes = [r.z_class for r in depth.combine(df, method=method).collect()]
    assert len(classes) == 21 and None not in classes and len(set(classes)) <= most


def test_rules_isolate_failures(spark):
    rules = Rules()
    rules.register("bad", lambda df: df["nothing"] > 0)
    rules.register("good", F.col("x") > 0)
    assert rules.apply(spark.createDataFrame([(1,)], "x int")).collect()[0].asDict() == {"x": 1, "bad": 0, "good": 1}
    out = crossing_rules().apply(spark.createDataFrame([(1, "Tram")], "crossing int, railway string")).first()
    assert out.crossing_with_tram == 1 and out.crossing_with_tram_without_pedestrian == 1 and out.crossing_with_pedestrian == 0


def test_ml_score(spark):
    df = spark.createDataFrame([(0.5, 0.5), (None, 0.0), (2.0, None)], "a double, b double")
    score = scoring.ml_score({"Geeignet": F.col("a"), "nicht empfohlen": F.col("b")})
    assert [r[0] for r in df.select(score).collect()] == [50.5, 0.0, 100.0]
    with pytest.raises(ValueError):
        scoring.ml_score({})


def test_kernel_has_149_cells():
    assert len(raster.kernel(15.0, 2.0)) == 149


def test_edge_cost_of_odd_values(spark):
    df = spark.createDataFrame([(10.0, None), (float("inf"), 10.0), (-5.0, 10.0), (10.0, 150.0)], "l double, s double")
    assert [r[0] for r in df.select(network.edge_cost(F.col("l"), F.col("s"), 1.0, 1.0)).collect()] == [15.0, 0.0, 0.0, 10.0]


def _graph(rng, n, m):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(i, u, v, float(rng.randint(1, 20)), float(rng.randint(0, 100))) for i, (u, v) in enumerate(sorted(pairs))]


def test_k_shortest_equals_enumeration():
    rng = random.Random(5)
    for _ in range(12):
        edges = _graph(rng, 7, 12)
        graph = routing.graph_of(pd.DataFrame(edges, columns=["fid", "u", "v", "length_m", "safety"]))
        cost = {(u, v): l + (100 - s) * l / 100 for _, u, v, l, s in edges} | {(v, u): l + (100 - s) * l / 100 for _, u, v, l, s in edges}
        paths = []
        for k in range(0, 6):
            for middle in itertools.permutations([x for x in range(7) if x not in (0, 6)], k):
                nodes = [0, *middle, 6]
                if all(p in cost for p in zip(nodes, nodes[1:])):
                    paths.append(sum(cost[p] for p in zip(nodes, nodes[1:])))
        got = [x[0] for x in graph.shortest(0, 6, 1.0, 1.0, 4)]
        assert got == pytest.approx(sorted(paths)[:4])


def test_relaxation_equals_heap(spark):
    edges = _graph(random.Random(8), 30, 60)
    df = spark.createDataFrame(edges, "fid long, u long, v long, length_m double, safety double")
    graph = routing.graph_of(pd.DataFrame(edges, columns=["fid", "u", "v", "length_m", "safety"]))
    asked = spark.createDataFrame([("r", 0, 1.0, 2.0)], "request_id string, source long, alpha double, beta double")
    got = {r.node: r.cost for r in routing.relaxed_costs(asked, df).collect()}
    for node in range(1, 30):
        found = graph.path(0, node, 1.0, 2.0)
        assert (found is None) == (node not in got)
        if found:
            assert got[node] == pytest.approx(found[0])


def test_relaxation_runs_until_costs_are_settled(spark):
    line = spark.createDataFrame([(i, i, i + 1, 1.0, 50.0) for i in range(30)], "fid long, u long, v long, length_m double, safety double")
    asked = spark.createDataFrame([("r", 0, 1.0, 0.0)], "request_id string, source long, alpha double, beta double")
    assert {r.node: r.cost for r in routing.relaxed_costs(asked, line).collect()} == {i: float(i) for i in range(31)}



def test_route_request(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 50.0, 50.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 0, 1, 100.0, 0.0), (2, 0, 2, 71.0, 100.0), (3, 2, 1, 71.0, 100.0)], "fid long, u long, v long, length_m double, safety double")
    out = routing.route({"ml": edges}, nodes, (1, 1), (99, 1)).collect()
    assert len(out) == 4 and sum('"coordinates":[[0.0,0.0],[100.0,0.0]]' in r.feature for r in out) == 1
    with pytest.raises(ValueError):
        routing.route({"ml": edges}, nodes, (1, 1), (99, 1), model="other")
    with pytest.raises(LookupError):
        routing.route({"ml": edges}, nodes, (1, 1), (99, 1), model="rule-based")
    with pytest.raises(ValueError):
        routing.cases(1.0, None)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(40)] + [(99, 60, 60, 1.0)], "fid long, u long, v long, length_m double")
    got = {r.node: r.component for r in network.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 60: 60}


def test_oversample_and_smote_balance(spark):
    df = spark.createDataFrame([(i, int(i < 3), float(i)) for i in range(20)], "id long, y int, v double")
    assert {r.y: r["count"] for r in ml.oversample(df, "y", "id").groupBy("y").count().collect()} == {0: 17, 1: 17}
    made = ml.smote(df, "y", "id", ["v"]).collect()
    assert len(made) == 14 and all(0 <= r.v <= 2 for r in made)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "a int, p int")
    m = ml.metrics(ml.confusion(df, "a", "p")).first()
    assert m.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3) and m.accuracy == pytest.approx(0.6)
    assert m.f1_macro == pytest.approx((0.5 + 0.8 + 0) / 3) and m.f1_weighted == pytest.approx((2 * 0.5 + 2 * 0.8) / 5)


def test_predictions_and_rings(spark):
    df = spark.createDataFrame([("1 .5 .5 .2 .2 .9",), ("2 0 0 0 1 1 1 1 0 .8",), ("3 1 2",)], "line string")
    got = [r[0] for r in df.select(aerial.parse_prediction(F.col("line"))).collect()]
    assert got[0].cls == 1 and got[0].conf == 0.9 and got[1].conf == 0.8 and got[2] is None
    ring = df.where("line LIKE '2%'").select(aerial.counter_clockwise(aerial.parse_prediction(F.col("line"))["corners"])).first()[0]
    assert [(p.x, p.y) for p in ring] == [(1, 0), (1, 1), (0, 1), (0, 0)]


def test_parameter_tables():
    assert len(params.NAME_TO_GROUP) == 85 and len(params.GROUP_NAMES) == 23 and len(params.HEAT_GROUPS) == 24
