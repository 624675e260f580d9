"""Routes over graphs whose searches went too far, each in small."""

import random
from heapq import heappop

import pandas as pd
import pytest
from pyspark import SparkFiles

from footgrid.fixtures import fixture
from footgrid.operators import routing
from footgrid.plans import graphs

EDGES = "fid long, u long, v long, length_m double, safety double"


def _random(n, m, seed=1, free=0.0):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    return [(i, u, v, rng.uniform(10, 90), 100.0 if rng.random() < free else rng.uniform(0, 99)) for i, (u, v) in enumerate(pairs)]


def _costs(edges, source, alpha, beta):
    """From the source to every node, by relaxing all edges until nothing changes."""
    costs, changed = {source: 0.0}, True
    while changed:
        changed = False
        for _, u, v, l, s in edges:
            step = alpha * l + beta * (100 - s) * l / 100
            for a, b in ((u, v), (v, u)):
                if a in costs and costs[a] + step < costs.get(b, 1e300) - 1e-12:
                    costs[b], changed = costs[a] + step, True
    return costs


@pytest.fixture
def pops(monkeypatch):
    """Counts the nodes that searches take from their heaps."""
    count = [0]

    def counted(heap):
        count[0] += 1
        return heappop(heap)

    monkeypatch.setattr(routing, "heappop", counted)
    return count


def _graph(edges):
    return routing.graph_of(pd.DataFrame(edges, columns=["fid", "u", "v", "length_m", "safety"]))


def test_nodes_joined_without_cost_are_passed_as_one(pops):
    edges = _random(3000, 9000, free=0.5)
    graph, costs = _graph(edges), _costs(edges, 7, 0.0, 1.0)
    by_fid = {e[0]: e for e in edges}
    for target in range(100, 140):
        found = graph.path(7, target, 0.0, 1.0)
        assert (found is None) == (target not in costs)
        if found:
            cost, fids, nodes = found
            assert cost == pytest.approx(costs[target]) and len(set(nodes)) == len(nodes)
            assert [{a, b} for a, b in zip(nodes, nodes[1:])] == [{by_fid[f][1], by_fid[f][2]} for f in fids]
    assert pops[0] < 40 * 100


def test_a_far_end_is_searched_from_its_own_side(pops):
    """A target at the end of a long road: not all that is nearer to the source is looked at."""
    edges = _random(3000, 9000)
    edges.append((10**6, 50, 5000, 10_000.0, 50.0))
    assert _graph(edges).path(7, 5000, 1.0, 0.0)[0] == pytest.approx(_costs(edges, 7, 1.0, 0.0)[5000])
    assert pops[0] < 1000


def test_k_shortest_searches_only_near_the_cheapest(pops):
    graph = _graph(_random(3000, 9000))
    near = [graph.shortest(s, s + 900, 1.0, 1.0, 3) for s in range(10)]
    taken, pops[0] = pops[0], 0
    slow = []
    for s in range(10):
        a, b = graph.at(s), graph.at(s + 900)
        nodes, path = graph._between(a, b, 1.0, 1.0)
        slow.append(graph._yen((graph._cost(path, 1.0, 1.0), path, nodes), b, 1.0, 1.0, 3, lambda n, banned, closed, b=b: graph._between(n, b, 1.0, 1.0, banned, closed)))
    assert [[round(p[0], 7) for p in x] for x in near] == [[round(p[0], 7) for p in x] for x in slow]
    assert taken < pops[0]


def test_a_graph_in_a_file_is_the_graph(spark):
    edges = [*_random(60, 150), (900, 3, 3, 5.0, None), (901, 1, 70, -4.0, 130.0), (902, 2, 71, float("inf"), None)]
    name = routing.graph_file(spark.createDataFrame(edges, EDGES))
    mapped, made = routing._mapped(SparkFiles.get(name)), _graph([(*e[:4], float("nan") if e[4] is None else e[4]) for e in edges])
    for target in [*range(1, 60), 70, 71, 72]:
        for k in (1, 3):
            assert [p[::2] for p in mapped.shortest(0, target, 1.0, 2.0, k)] == [p[::2] for p in made.shortest(0, target, 1.0, 2.0, k)]


def test_graphs_of_millions_of_edges_fit_the_file():
    import inspect

    assert inspect.signature(routing.routes).parameters["broadcast_edges"].default >= 9_000_000


def test_routes_are_searched_once(spark):
    """Their result is stored: features and summaries of it start no search."""
    edges = spark.createDataFrame(_random(30, 60), EDGES)
    asked = spark.createDataFrame([("a", 0, 9, 1.0, 0.0, "Fastest")], "request_id string, source long, target long, alpha double, beta double, label string")
    found = routing.routes(asked, edges)
    nodes = spark.range(30).selectExpr("id AS node_id", "double(id) AS x", "0.0D AS y")
    for made in (routing.summaries(found, edges), routing.features(found, nodes, routing.summaries(found, edges))):
        assert "MapInPandas" not in made._jdf.queryExecution().toString() and made.count() == 1


def test_nodes_are_never_broadcast(spark, tiny):
    """A small file of customers makes many nodes; Spark would broadcast them by the file's size."""
    plan = fixture(spark, tiny, "fx_edge")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_a_batch_is_searched_once_for_each_network(spark):
    edges = spark.createDataFrame(_random(30, 60), EDGES)
    ends = spark.createDataFrame([("R1", 0, 9)], "route_id string, source long, target long")
    made = routing.batch({"ml": edges, "rule-based": edges}, ends)
    assert "MapInPandas" not in made._jdf.queryExecution().toString() and made.count() == 8


CASES = ((1.0, 0.0), (1.0, 3.0), (0.0, 1.0))


def _odd_graph():
    """With a hub of free edges, a long road, a piece apart and a loop."""
    edges = _random(3000, 9000, free=0.5)
    return edges + [(10**6, 50, 5000, 10_000.0, 50.0), (10**6 + 1, 6000, 6001, 3.0, 20.0), (10**6 + 2, 8, 8, 3.0, 20.0)]


@pytest.mark.parametrize(("places", "arcs"), [(10**6, 10**6), (10**5, 40), (1, 10**6)])
def test_searches_made_at_once_find_the_cheapest(pops, monkeypatch, places, arcs):
    monkeypatch.setattr(routing, "PLACES", places)
    monkeypatch.setattr(routing, "ROUND_ARCS", arcs)
    edges = _odd_graph()
    graph, by_fid = _graph(edges), {e[0]: e for e in edges}
    targets = [*range(100, 160), 7, 5000, 6001, 123456]
    for alpha, beta in CASES:
        costs = _costs(edges, 7, alpha, beta)
        found = graph.cheapest([(7, t) for t in targets] + [(t, 7) for t in targets], alpha, beta)
        for target, path in zip(targets * 2, found):
            assert (path is None) == (target not in costs)
            if path:
                cost, fids, nodes = path
                assert cost == pytest.approx(costs[target], abs=1e-6) and len(set(nodes)) == len(nodes) and {nodes[0], nodes[-1]} == {7, target}
                assert [{a, b} for a, b in zip(nodes, nodes[1:])] == [set(by_fid[f][1:3]) for f in fids]
    assert pops[0] == 0  # one by one, each would fill a heap of its own


def test_a_path_does_not_depend_on_those_searched_with_it():
    graph = _graph(_odd_graph())
    pairs = [(s, s + 900) for s in range(50)]
    for case in CASES:
        assert graph.cheapest(pairs, *case) == [graph.cheapest([p], *case)[0] for p in pairs]


def test_an_end_at_a_long_road_does_not_open_the_graph():
    """The other side waits for it: few of the places are ever reached."""
    graph = _graph([*_random(3000, 9000), (10**6, 50, 5000, 10_000.0, 50.0)])
    graph.cheapest([(7, 8)], 1.0, 0.0)
    graph.room[1][:] = -7
    assert graph.cheapest([(7, 5000)], 1.0, 0.0)[0][1][-1] == 10**6
    assert (graph.room[1] != -7).sum() < 2000


def test_a_graph_is_the_same_in_parts(spark, monkeypatch):
    edges = spark.createDataFrame(_random(60, 150), EDGES)
    files = []
    for part in (1000, 7):
        monkeypatch.setattr(routing, "PART_EDGES", part)
        files.append(routing._mapped(SparkFiles.get(routing.graph_file(edges))))
    whole, parts = files
    pairs = [(0, t) for t in range(1, 60)]
    assert len(whole.fids) == len(parts.fids) == edges.count() and sorted(whole.fids) == sorted(parts.fids)
    assert [x and x[1] for x in whole.cheapest(pairs, 1.0, 2.0)] == [x and x[1] for x in parts.cheapest(pairs, 1.0, 2.0)]


def test_both_ends_are_looked_up_at_once(spark, tiny, monkeypatch):
    calls, looked_up = [], graphs.network.nearest_nodes
    monkeypatch.setattr(graphs.network, "nearest_nodes", lambda *a: calls.append(a) or looked_up(*a))
    assert graphs.nearest_node(spark, tiny).columns == ["od_id", "source", "target"]
    assert len(calls) == 1
