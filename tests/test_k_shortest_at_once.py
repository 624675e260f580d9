"""The k cheapest paths of many requests, searched at once in arrays."""

import pytest

from footgrid.operators import routing
from tests.test_routes_at_size import _graph, _odd_graph, _random, pops  # noqa: F401


def _unbounded(graph, source, target, alpha, beta, k):
    a, b = graph.at(source), graph.at(target)
    return [] if a is None or b is None else graph._unbounded(a, b, alpha, beta, k)


@pytest.mark.parametrize(("places", "arcs"), [(10**6, 10**6), (10**5, 40), (1, 10**6)])
def test_k_paths_searched_at_once_are_the_cheapest(pops, monkeypatch, places, arcs):  # noqa: F811
    monkeypatch.setattr(routing, "NEAR_PLACES", places)
    monkeypatch.setattr(routing, "ROUND_ARCS", arcs)
    graph = _graph(_random(3000, 9000))
    pairs = [(s, s + 900) for s in range(20)]
    found, taken = graph.several(pairs, 1.0, 1.0, 3), pops[0]
    pops[0] = 0
    assert [[(round(c, 7), f, n) for c, f, n in x] for x in found] == [[(round(c, 7), f, n) for c, f, n in graph.shortest(*p, 1.0, 1.0, 3)] for p in pairs]
    assert taken < pops[0]
    slow = [_unbounded(graph, *p, 1.0, 1.0, 3) for p in pairs[:8]]
    assert [[round(p[0], 7) for p in x] for x in found[:8]] == [[round(p[0], 7) for p in x] for x in slow]


@pytest.mark.parametrize(("alpha", "beta"), [(1.0, 0.0), (1.0, 3.0), (0.0, 1.0)])
def test_k_paths_of_an_odd_graph(alpha, beta):
    """Edges without cost, parts of few paths, ends that are the same, unknown or apart."""
    edges = _odd_graph()
    graph, by_fid = _graph(edges), {e[0]: e for e in edges}
    pairs = [(7, 5000), (7, 7), (7, 99_999), (6000, 6001), (7, 6000), (8, 9), *((s, s + 50) for s in range(100, 104))]
    for pair, found in zip(pairs, graph.several(pairs, alpha, beta, 3)):
        want = graph.shortest(*pair, alpha, beta, 3)
        assert [p[0] for p in found] == pytest.approx([p[0] for p in want])
        assert len({tuple(p[2]) for p in found}) == len(found)
        for cost, fids, nodes in found:
            assert nodes[0] == pair[0] and nodes[-1] == pair[1] and len(set(nodes)) == len(nodes)
            assert [{a, b} for a, b in zip(nodes, nodes[1:])] == [{by_fid[f][1], by_fid[f][2]} for f in fids]
            assert cost == pytest.approx(sum(alpha * by_fid[f][3] + beta * (100 - by_fid[f][4]) * by_fid[f][3] / 100 for f in fids))
