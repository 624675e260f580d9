"""Safety-aware shortest paths.

A street graph is small beside the requests put to it: its edges are counted
first, and up to ``broadcast_edges`` are handed to the executors as one file that
tasks map, over which requests spread. In a larger graph, joins relax the costs from each request's source and
target; the edges on ways that cost little more than the cheapest make a small
graph for each request, in which the same search finds the paths.
"""

from __future__ import annotations

import contextlib
import shutil
import uuid
from bisect import bisect_right
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footgrid import params
from footgrid.operators.network import clamped_safety, edge_cost
from footgrid.shipping import release, ship
from footgrid.storage import stored


def _index(ids: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return np.searchsorted(ids, nodes).astype(np.int32)


def _usable(length, safety) -> tuple[np.ndarray, np.ndarray]:
    """(length, risk) of edges: cost is ``alpha * length + beta * risk``; see ``network.edge_cost``."""
    length, safety = np.asarray(length, float), np.asarray(safety, float)
    length = np.where(np.isfinite(length) & (length > 0), length, 0.0)
    return length, (100.0 - np.clip(np.where(np.isnan(safety), 50.0, safety), 0.0, 100.0)) * length / 100.0


def _arcs(u: np.ndarray, v: np.ndarray, n: int, parts: int = 1):
    """(degrees, edges, neighbours) of each part of the ``n`` nodes, by node: each arc's edge and other node; both directions of every edge, no loops."""
    for i in range(parts):
        a, b = n * i // parts, n * (i + 1) // parts
        at, back = (np.flatnonzero((x >= a) & (x < b) & (u != v)).astype(np.int32) for x in (u, v))
        own, other, edges = np.concatenate([u[at], v[back]]), np.concatenate([v[at], u[back]]), np.concatenate([at, back])
        order = np.lexsort((other, own))
        yield np.bincount(own - a, minlength=b - a), edges[order], other[order]


def _adjacency(u: np.ndarray, v: np.ndarray):
    """(ids, ends, edges, neighbours): the nodes in order, where each one's arcs end, and what ``_arcs`` gives."""
    ids = np.unique(np.concatenate([np.unique(u), np.unique(v)]))
    [(degrees, edges, others)] = _arcs(_index(ids, u), _index(ids, v), len(ids))
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(degrees, out=ends[1:])
    return ids, ends, edges, others


#: Nodes joined by edges that cost nothing, from which on they are passed as one node.
HUB_NODES = 64
#: Edges that the driver takes in at once, of 40 bytes each.
PART_EDGES = 2_000_000
#: (end, node) places of the searches that are made at once: 12 bytes each.
PLACES = 16_000_000
#: The same for searches that keep no ways: 8 bytes each.
NEAR_PLACES = 28_000_000
#: How far one round of such searches goes, in mean costs of an edge, and arcs it follows at most at once.
STRIDE, ROUND_ARCS = 0.1, 2_000_000
#: What paths may cost beyond the cheapest in the searches for the k cheapest, before the search is unbounded.
SLACKS = (0.05, 0.15, 0.5)
#: The same for searches made at once, in which another search costs more than a wider one.
NEAR_SLACKS = (0.08, 0.2, 0.5)


@dataclass
class Hub:
    """The most nodes that edges without cost join: whether each node belongs, a tree over them (-1 at its root), and each node's place, the root for those."""

    belongs: bytes
    up: np.ndarray
    edge: np.ndarray
    root: int
    place: np.ndarray

    def way(self, a: int, b: int) -> tuple[list[int], list[int]]:
        """(nodes, edges) between two of its nodes, along the tree."""
        climbs = []
        for node in (a, b):
            nodes, edges = [node], []
            while self.up[nodes[-1]] >= 0:
                edges.append(int(self.edge[nodes[-1]]))
                nodes.append(int(self.up[nodes[-1]]))
            climbs.append((nodes, edges))
        (there, by), (back, over) = climbs
        while len(there) > 1 and len(back) > 1 and there[-2] == back[-2]:
            for x in (there, back, by, over):
                x.pop()
        return there + back[-2::-1], by + over[::-1]


class Graph:
    """A street graph in arrays, which may be mapped from a file.

    ids: nodes in order; ends, edges, others: see ``_adjacency``; fids, lengths, risks: by edge.
    """

    def __init__(self, ids, ends, edges, others, fids, lengths, risks):
        self.ids, self.arrays = ids, (ends, edges, others, lengths, risks)
        self.ends, self.edges, self.others, self.fids, self.lengths, self.risks = map(memoryview, (ends, edges, others, fids, lengths, risks))
        self.hubs: dict[tuple[float, float], Hub | None] = {}
        self.weighed: tuple[tuple[float, float], np.ndarray, float] | None = None
        self.room: tuple[np.ndarray, np.ndarray] | None = None
        self.near_room: np.ndarray | None = None

    def at(self, node: int) -> int | None:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else None

    def hub(self, alpha: float, beta: float) -> Hub | None:
        if (alpha, beta) not in self.hubs:
            self.hubs[alpha, beta] = self._hub(alpha, beta)
        return self.hubs[alpha, beta]

    def _hub(self, alpha: float, beta: float) -> Hub | None:
        ends, edges, others, lengths, risks = self.arrays
        free = alpha * lengths + beta * risks <= 0
        if np.count_nonzero(free) < HUB_NODES - 1:
            return None
        arcs = np.flatnonzero(free[edges])
        own, other = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(ends))[arcs], others[arcs]
        label = np.arange(len(self.ids))
        while True:
            new = label.copy()
            np.minimum.at(new, own, label[other])
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        sizes = np.bincount(label)
        root = int(sizes.argmax())
        if sizes[root] < HUB_NODES:
            return None
        belongs, inside = label == root, label[own] == root
        own, other, by = own[inside], other[inside], edges[arcs[inside]]
        up, edge, seen, front = np.full(len(belongs), -1, np.int32), np.full(len(belongs), -1, np.int32), ~belongs, np.zeros(len(belongs), bool)
        seen[root] = front[root] = True
        while front.any():
            step = front[own] & ~seen[other]
            up[other[step]], edge[other[step]] = own[step], by[step]  # of several ways to a node the last: the same one in both
            front[:] = False
            front[other[step]] = True
            seen |= front
        return Hub(belongs.tobytes(), up, edge, root, np.where(belongs, root, np.arange(len(belongs))).astype(np.int32))

    def _between(self, source: int, target: int, alpha: float, beta: float, banned=frozenset(), closed=frozenset(), hub: Hub | None = None):
        """(nodes, edges) of a cheapest path between two places, None if there is none.

        Searched from both ends, always on the side that has fewer open nodes. A hub
        is one node, -1, which no side ever needs to leave: the search is over once
        it is the next one on both, or one of them has nothing else.
        """
        inside = hub.belongs if hub else None
        first, last = (-1 if inside and inside[x] else x for x in (source, target))
        if first == last:
            return ([source], []) if source == target else hub.way(source, target)
        far, ends, edges, others, lengths, risks = float("inf"), self.ends, self.edges, self.others, self.lengths, self.risks
        costs, before, done, heaps = ({first: 0.0}, {last: 0.0}), ({}, {}), (set(), set()), ([(0.0, first)], [(0.0, last)])
        best, meet = far, None
        while True:
            for heap, settled in zip(heaps, done):
                while heap and heap[0][1] in settled:
                    heappop(heap)
            if not heaps[0] or not heaps[1] or heaps[0][0][0] + heaps[1][0][0] >= best:
                break
            side = 0 if len(heaps[0]) <= len(heaps[1]) else 1
            if heaps[side][0][1] == -1:
                side = 1 - side
            own, there, came, heap, least = costs[side], costs[1 - side], before[side], heaps[side], heaps[1 - side][0][0]
            cost, node = heappop(heap)
            done[side].add(node)
            a, b = ends[node], ends[node + 1]
            for edge, other in zip(edges[a:b].tolist(), others[a:b].tolist()):
                step = alpha * lengths[edge] + beta * risks[edge]
                step = cost + step if step > 0 else cost
                if step + least >= best:
                    continue  # no way over it is cheaper than the best
                if other in closed or (banned and ((node, other) if side == 0 else (other, node)) in banned):
                    continue
                place = -1 if inside and inside[other] else other
                if step < own.get(place, far):
                    own[place], came[place] = step, (node, edge, other)
                    heappush(heap, (step, place))
                    if step + there.get(place, far) < best:
                        best, meet = step + there[place], place
        if meet is None:
            return None
        halves = []
        for side, end in ((0, source), (1, target)):
            at, nodes, by = meet, [], []
            while at in before[side]:
                node, edge, other = before[side][at]
                nodes.append(other)
                by.append(edge)
                at = node
            halves.append(([*nodes, end], by))
        return self._joined(*halves, hub)

    @staticmethod
    def _joined(there, here, hub: Hub | None):
        """(nodes, edges) of the ways back from where two searches met to the one's end and on to the other's."""
        (back, by), (on, over) = there, here
        nodes, path = back[::-1], by[::-1]
        if back[0] != on[0]:  # they met in the hub
            through, free = hub.way(back[0], on[0])
            nodes, path = nodes + through[1:], path + free
        for node, edge in zip(on[1:], over):
            if node in nodes:  # edges that cost nothing can make a loop; it goes
                i = nodes.index(node)
                nodes, path = nodes[: i + 1], path[:i]
            else:
                nodes.append(node)
                path.append(edge)
        return nodes, path

    def _weights(self, alpha: float, beta: float) -> tuple[np.ndarray, float]:
        """What each edge costs, and their mean; the last ones are kept."""
        if self.weighed is None or self.weighed[0] != (alpha, beta):
            weights = alpha * self.arrays[3]
            weights += beta * self.arrays[4]
            weights[~(weights > 0)] = 0.0
            self.weighed = (alpha, beta), weights, float(weights.mean())
        return self.weighed[1:]

    def cheapest(self, pairs: list[tuple[int, int]], alpha: float, beta: float):
        """``path`` of each (source, target), by searches made at once in arrays."""
        out: list = [None] * len(pairs)
        hub, asked = self.hub(alpha, beta), []
        for i, (source, target) in enumerate(pairs):
            if source == target:
                out[i] = (0.0, [], [source])
                continue
            a, b = self.at(source), self.at(target)
            if a is None or b is None:
                continue
            if hub and hub.belongs[a] and hub.belongs[b]:
                out[i] = self._named(*hub.way(a, b), alpha, beta)
            else:
                asked.append((i, a, b))
        most = max(1, PLACES // (2 * max(1, len(self.ids))))
        for start in range(0, len(asked), most):
            part = asked[start : start + most]
            for (i, _, _), found in zip(part, self._together([x[1:] for x in part], alpha, beta, hub)):
                out[i] = found and self._named(*found, alpha, beta)
        return out

    def _named(self, nodes, path, alpha: float, beta: float):
        return self._cost(path, alpha, beta), [self.fids[e] for e in path], [int(self.ids[n]) for n in nodes]

    def _together(self, pairs: list[tuple[int, int]], alpha: float, beta: float, hub: Hub | None):
        """``_between`` of many pairs of places, none of them within the hub.

        In each round every search follows the arcs of its open places up to a stride
        beyond the nearest one; a place that is reached more cheaply later is open
        again. What is cheaper than the nearest open place is final, so a pair is
        done as in ``_between``. Both sides go on unless one has far more open places.
        """
        n, (weights, mean) = len(self.ids), self._weights(alpha, beta)
        ends, edges, others, _, _ = self.arrays
        if self.room is None:
            size = n * 2 * max(1, PLACES // (2 * n))
            self.room = np.full(size, np.inf), np.empty(size, np.int32)
        costs, came = self.room
        slots, stride = 2 * len(pairs), STRIDE * mean
        slot, node = np.arange(slots), np.array(pairs, np.int64).ravel()
        if hub:
            node = hub.place[node]
        base, twin = slot * n, slot ^ 1
        key, label = base + node, np.zeros(slots)
        costs[key], came[key] = 0.0, -1
        touched, best, meet = [key], np.full(len(pairs), np.inf), np.full(len(pairs), -1)
        if hub:
            in_hub, free = base + hub.root, node != hub.root
            slot, key, label = slot[free], key[free], label[free]
        while len(key):
            nearest = np.full(slots, np.inf)
            np.minimum.at(nearest, slot, label)
            hubs = costs[in_hub] if hub else np.inf
            goes = nearest < hubs
            low = np.minimum(nearest, hubs)
            # A way over a place must cost less than this up to it; none is left once the other side has no open place.
            across = np.subtract(best.repeat(2), low[twin], out=np.full(slots, -np.inf), where=np.isfinite(low[twin]))
            goes &= low < across
            count = np.bincount(slot, minlength=slots)
            goes &= ~goes[twin] | (count <= 4 * count[twin])
            kept = label < across[slot]
            if not kept.all():
                slot, key, label = slot[kept], key[kept], label[kept]
            now = label <= np.where(goes, low + stride, -1.0)[slot]
            at, by, cost = key[now], slot[now], label[now]
            slot, key, label = slot[~now], key[~now], label[~now]
            current = costs[at] == cost
            at, by, cost = at[current], by[current], cost[current]
            first = ends[at - base[by]]
            arcs = ends[at - base[by] + 1] - first
            total = np.cumsum(arcs)
            if len(total) and total[-1] > ROUND_ARCS:
                cut = max(1, int(np.searchsorted(total, ROUND_ARCS)))
                slot, key, label = (np.concatenate([x, y[cut:]]) for x, y in ((slot, by), (key, at), (label, cost)))
                by, cost, first, arcs, total = by[:cut], cost[:cut], first[:cut], arcs[:cut], total[:cut]
            if not len(total):
                if not goes.any():
                    break
                continue
            arc = np.arange(total[-1]) + np.repeat(first - total + arcs, arcs)
            by, step = np.repeat(by, arcs), np.repeat(cost, arcs) + weights[edges[arc]]
            short = step < across[by]
            arc, by, step = arc[short], by[short], step[short]
            node = others[arc]
            if hub:
                node = hub.place[node]
            at = base[by] + node
            less = step < costs[at]
            arc, by, step, node, at = arc[less], by[less], step[less], node[less], at[less]
            np.minimum.at(costs, at, step)
            least = np.flatnonzero(costs[at] == step)
            arc, by, step, node, at = arc[least], by[least], step[least], node[least], at[least]
            came[at] = arc
            single = came[at] == arc
            by, step, node, at = by[single], step[single], node[single], at[single]
            touched.append(at)
            whole, pair = step + costs[base[twin[by]] + node], by >> 1
            better = whole < best[pair]
            if better.any():
                whole, pair, node_met = whole[better], pair[better], node[better]
                np.minimum.at(best, pair, whole)
                hit = whole == best[pair]
                meet[pair[hit]] = node_met[hit]
            if hub:
                out = node != hub.root
                by, step, at = by[out], step[out], at[out]
            slot, key, label = np.concatenate([slot, by]), np.concatenate([key, at]), np.concatenate([label, step])
        found = []
        for i, pair in enumerate(pairs):
            if meet[i] < 0:
                found.append(None)
                continue
            halves = []
            for side, end in enumerate(pair):
                at, start, nodes, path = int(meet[i]), int(base[2 * i + side]), [], []
                while (arc := int(came[start + at])) >= 0:
                    nodes.append(int(others[arc]))
                    path.append(int(edges[arc]))
                    at = bisect_right(self.ends, arc) - 1
                halves.append(([*nodes, end], path))
            found.append(self._joined(*halves, hub))
        for x in touched:
            costs[x] = np.inf
        return found

    def _near(self, source: int, target: int, alpha: float, beta: float, slack: float):
        """(limit, arcs by node, costs to the target) of all that lies on paths within ``slack`` above the cheapest; None without a path.

        A node of such a path is within what one side has settled once both sides'
        next nodes together are beyond the limit; each side then goes on over what
        the other has settled.
        """
        far, ends, edges, others, lengths, risks = float("inf"), self.ends, self.edges, self.others, self.lengths, self.risks
        costs, done, heaps, best, limit = ({source: 0.0}, {target: 0.0}), ({}, {}), ([(0.0, source)], [(0.0, target)]), far, far

        def settle(side, cost, node, known, least):
            nonlocal best, limit
            own, there, heap = costs[side], costs[1 - side], heaps[side]
            done[side][node] = cost
            a, b = ends[node], ends[node + 1]
            for edge, other in zip(edges[a:b].tolist(), others[a:b].tolist()):
                step = alpha * lengths[edge] + beta * risks[edge]
                step = cost + step if step > 0 else cost
                if step + known.get(other, least) > limit:
                    continue
                if step < own.get(other, far):
                    own[other] = step
                    heappush(heap, (step, other))
                    if step + there.get(other, far) < best:
                        best = step + there[other]
                        limit = best * (1 + slack) + 1e-9

        while True:
            for heap, settled in zip(heaps, done):
                while heap and heap[0][1] in settled:
                    heappop(heap)
            if not heaps[0] or not heaps[1] or heaps[0][0][0] + heaps[1][0][0] > limit:
                break
            side = 0 if len(heaps[0]) <= len(heaps[1]) else 1
            cost, node = heappop(heaps[side])
            settle(side, cost, node, done[1 - side], heaps[1 - side][0][0])
        if best == far:
            return None
        known = (dict(done[0]), dict(done[1]))
        for side in (0, 1):
            heap, other_side = heaps[side], known[1 - side]
            while heap:
                cost, node = heappop(heap)
                if node not in done[side] and cost + other_side.get(node, far) <= limit:
                    settle(side, cost, node, other_side, far)
        there, back = done
        arcs = {}
        for node, cost in there.items():
            if cost + back.get(node, far) <= limit:
                a, b = ends[node], ends[node + 1]
                near = []
                for edge, other in zip(edges[a:b].tolist(), others[a:b].tolist()):
                    step = max(0.0, alpha * lengths[edge] + beta * risks[edge])
                    if cost + step + back.get(other, far) <= limit:
                        near.append((other, edge, step))
                arcs[node] = near
        return limit, arcs, back

    def _near_together(self, pairs: list[tuple[int, int]], alpha: float, beta: float, slack: float, cap: np.ndarray):
        """``_near`` of many pairs of places, by searches made at once in arrays; a finite ``cap`` is the limit.

        Both sides go on, as in ``_together``, until their nearest open places
        together are beyond the limit. A path within it goes over places that the
        first side has settled, then one arc, then over places that the other has.
        """
        n, (weights, mean) = len(self.ids), self._weights(alpha, beta)
        ends, edges, others, _, _ = self.arrays
        if self.near_room is None:
            self.near_room = np.full(2 * n * max(1, NEAR_PLACES // (2 * n)), np.inf)
        costs, slots, stride = self.near_room, 2 * len(pairs), STRIDE * mean
        slot, node = np.arange(slots), np.array(pairs, np.int64).ravel()
        base, twin = slot * n, slot ^ 1
        key, label = base + node, np.zeros(slots)
        costs[key] = 0.0
        touched, settled, best, limit = [key], [key[:0]], np.full(len(pairs), np.inf), cap.copy()
        while len(key):
            nearest = np.full(slots, np.inf)
            np.minimum.at(nearest, slot, label)
            across = np.subtract(limit.repeat(2), nearest[twin], out=np.full(slots, -np.inf), where=np.isfinite(nearest[twin]))
            goes = nearest <= across
            count = np.bincount(slot, minlength=slots)
            goes &= ~goes[twin] | (count <= 4 * count[twin])
            now = label <= np.where(goes, nearest + stride, -1.0)[slot]
            at, by, cost = key[now], slot[now], label[now]
            kept = ~now & (label <= across[slot])
            slot, key, label = slot[kept], key[kept], label[kept]
            current = costs[at] == cost
            at, by, cost = at[current], by[current], cost[current]
            node = at - base[by]
            first = ends[node]
            arcs = ends[node + 1] - first
            total = np.cumsum(arcs)
            if len(total) and total[-1] > ROUND_ARCS:
                cut = max(1, int(np.searchsorted(total, ROUND_ARCS)))
                slot, key, label = (np.concatenate([x, y[cut:]]) for x, y in ((slot, by), (key, at), (label, cost)))
                at, by, cost, first, arcs, total = at[:cut], by[:cut], cost[:cut], first[:cut], arcs[:cut], total[:cut]
            if not len(total):
                if not goes.any():
                    break
                continue
            settled.append(at[by & 1 == 0])
            arc = np.arange(total[-1]) + np.repeat(first - total + arcs, arcs)
            by, step = np.repeat(by, arcs), np.repeat(cost, arcs) + weights[edges[arc]]
            short = step <= across[by]
            arc, by, step = arc[short], by[short], step[short]
            at = base[by] + others[arc]
            less = step < costs[at]
            by, step, at = by[less], step[less], at[less]
            np.minimum.at(costs, at, step)
            least = costs[at] == step
            by, step, at = by[least], step[least], at[least]
            touched.append(at)
            np.minimum.at(best, by >> 1, step + costs[at - base[by] + base[twin[by]]])
            limit = np.where(np.isfinite(cap), cap, best * (1 + slack) + 1e-9)
            slot, key, label = np.concatenate([slot, by]), np.concatenate([key, at]), np.concatenate([label, step])
        by, node = np.divmod(np.unique(np.concatenate(settled)), n)
        arcs = ends[node + 1] - ends[node]
        arc = np.arange(arcs.sum()) + np.repeat(ends[node] - np.cumsum(arcs) + arcs, arcs)
        by, node, other = np.repeat(by, arcs), np.repeat(node, arcs), others[arc]
        there, step, back = costs[base[by] + node], weights[edges[arc]], costs[base[by + 1] + other]
        met = np.flatnonzero(there + step + back <= limit[by >> 1])
        by, met = by[met] >> 1, [x[met].tolist() for x in (node, other, there + step, step + back)]
        starts = np.searchsorted(by, np.arange(len(pairs) + 1)).tolist()
        found = []
        for i in range(len(pairs)):
            crossings = list(zip(*(x[starts[i] : starts[i + 1]] for x in met)))
            found.append(self._around(crossings, float(limit[i]), costs[base[2 * i] :][:n], costs[base[2 * i + 1] :][:n], weights) if np.isfinite(best[i]) else None)
        costs[np.concatenate(touched)] = np.inf
        return found

    def _around(self, crossings, limit: float, there: np.ndarray, back: np.ndarray, weights: np.ndarray):
        """What ``_near`` returns, from the arcs (node, other, cost from the source to other, cost from node to the target) on which the two sides meet."""
        far, arcs_of = float("inf"), {}

        def around(node):
            if node not in arcs_of:
                a, b = self.ends[node], self.ends[node + 1]
                edge, other = self.arrays[1][a:b], self.arrays[2][a:b]
                arcs_of[node] = list(zip(other.tolist(), edge.tolist(), weights[edge].tolist(), there[other].tolist(), back[other].tolist()))
            return arcs_of[node]

        sides = ({}, {})  # costs from the source to places beyond the meeting, and to the target from those before it
        for side in (0, 1):
            own, done, heap = sides[side], set(), []
            for node, other, to_other, from_node in crossings:
                at, cost = (other, to_other) if side == 0 else (node, from_node)
                if cost < own.get(at, far):
                    own[at] = cost
                    heap.append((cost, at))
            heapify(heap)
            while heap:
                cost, node = heappop(heap)
                if node in done:
                    continue
                done.add(node)
                for other, _, step, *known in around(node):
                    if cost + step + known[1 - side] <= limit and cost + step < own.get(other, far):
                        own[other] = cost + step
                        heappush(heap, (cost + step, other))
        from_source, to_target = sides
        near = from_source.keys() | to_target.keys()
        home = {x: min(to_target.get(x, far), float(back[x])) for x in near}
        arcs = {}
        for node in near:
            cost = min(from_source.get(node, far), float(there[node]))
            if cost + home[node] <= limit:
                arcs[node] = [(other, edge, step) for other, edge, step, _, _ in around(node) if cost + step + home.get(other, far) <= limit]
        return limit, arcs, home

    @staticmethod
    def _spur(arcs, back, source: int, target: int, banned, closed):
        """``_between`` within what ``_near`` found, led by the costs to the target."""
        far, costs, came, done, heap = float("inf"), {source: 0.0}, {}, set(), [(back[source], source)]
        while heap:
            _, node = heappop(heap)
            if node == target:
                nodes, path = [node], []
                while nodes[-1] in came:
                    at, edge = came[nodes[-1]]
                    nodes.append(at)
                    path.append(edge)
                return nodes[::-1], path[::-1]
            if node in done:
                continue
            done.add(node)
            for other, edge, step in arcs.get(node, ()):
                if other in done or other in closed or (node, other) in banned:
                    continue
                if costs[node] + step < costs.get(other, far):
                    costs[other], came[other] = costs[node] + step, (node, edge)
                    heappush(heap, (costs[other] + back[other], other))
        return None

    def _yen(self, first, target: int, alpha: float, beta: float, k: int, spur_of):
        """The k cheapest simple paths (cost, edges, nodes), cheapest first, by Yen's deviations from the first."""
        found, waiting, seen = [first], [], {tuple(first[2])}
        while len(found) < k:
            nodes = found[-1][2]
            for i in range(len(nodes) - 1):
                root = nodes[: i + 1]
                banned = frozenset((p[2][i], p[2][i + 1]) for p in found if len(p[2]) > i + 1 and p[2][: i + 1] == root)
                spur = spur_of(nodes[i], banned, frozenset(root[:-1]))
                if spur is None:
                    continue
                whole = root[:-1] + spur[0]
                if tuple(whole) in seen:
                    continue
                seen.add(tuple(whole))
                path = found[-1][1][:i] + spur[1]
                heappush(waiting, (self._cost(path, alpha, beta), path, whole))
            if not waiting:
                break
            found.append(heappop(waiting))
        return found

    def _cost(self, path, alpha: float, beta: float) -> float:
        return sum((max(0.0, alpha * self.lengths[e] + beta * self.risks[e]) for e in path), 0.0)

    def path(self, source: int, target: int, alpha: float, beta: float):
        """(cost, fids, nodes) of a cheapest path, None if there is none."""
        found = self.shortest(source, target, alpha, beta)
        return found[0] if found else None

    def shortest(self, source: int, target: int, alpha: float, beta: float, k: int = 1):
        """The k cheapest simple paths (cost, fids, nodes), cheapest first."""
        if source == target:
            return [(0.0, [], [source])]
        a, b = self.at(source), self.at(target)
        if a is None or b is None:
            return []
        found = self._shortest(a, b, alpha, beta, k)
        return [(cost, [self.fids[e] for e in path], [int(self.ids[n]) for n in nodes]) for cost, path, nodes in found]

    def _shortest(self, source: int, target: int, alpha: float, beta: float, k: int):
        for slack in SLACKS if k > 1 else ():
            near = self._near(source, target, alpha, beta, slack)
            if near is None:
                return []
            found = self._within(near, source, target, alpha, beta, k)
            if len(found) == k and found[-1][0] <= near[0]:
                return found
        return self._unbounded(source, target, alpha, beta, k)

    def _within(self, near, source: int, target: int, alpha: float, beta: float, k: int):
        """The k cheapest paths in what ``_near`` found."""
        _, arcs, back = near
        spur_of = lambda node, banned, closed: self._spur(arcs, back, node, target, banned, closed)
        nodes, path = spur_of(source, frozenset(), frozenset())
        return self._yen((self._cost(path, alpha, beta), path, nodes), target, alpha, beta, k, spur_of)

    def _unbounded(self, source: int, target: int, alpha: float, beta: float, k: int):
        one = self._between(source, target, alpha, beta, hub=self.hub(alpha, beta))
        if one is None:
            return []
        return self._yen((self._cost(one[1], alpha, beta), one[1], one[0]), target, alpha, beta, k, lambda node, banned, closed: self._between(node, target, alpha, beta, banned, closed))

    def several(self, pairs: list[tuple[int, int]], alpha: float, beta: float, k: int):
        """``shortest`` of each (source, target), by searches made at once in arrays.

        Where k paths were found, of which some may not be the cheapest, the next
        search goes as far as the k-th of them and settles it.
        """
        out, asked = [[] for _ in pairs], []
        for i, (source, target) in enumerate(pairs):
            a, b = self.at(source), self.at(target)
            if source == target:
                out[i] = [(0.0, [], [source])]
            elif a is not None and b is not None:
                asked.append((i, a, b, float("inf")))
        most, answers = max(1, NEAR_PLACES // (2 * max(1, len(self.ids)))), {}
        for slack in (*NEAR_SLACKS, None):  # at last only what has k paths
            waiting = []
            for start in range(0, len(asked), most):
                part = asked[start : start + most]
                for (i, a, b, _), near in zip(part, self._near_together([x[1:3] for x in part], alpha, beta, slack or 0.0, np.array([x[3] for x in part]))):
                    found = [] if near is None else self._within(near, a, b, alpha, beta, k)
                    if near is None or (len(found) == k and found[-1][0] <= near[0]):
                        answers[i] = found
                    elif len(found) == k:
                        waiting.append((i, a, b, found[-1][0] * (1 + 1e-12) + 1e-9))
                    elif slack == NEAR_SLACKS[-1]:
                        answers[i] = self._unbounded(a, b, alpha, beta, k)
                    else:
                        waiting.append((i, a, b, float("inf")))
            asked = waiting
        answers |= {i: self._unbounded(a, b, alpha, beta, k) for i, a, b, _ in asked}
        for i, found in answers.items():
            out[i] = [(cost, [self.fids[e] for e in path], [int(self.ids[n]) for n in nodes]) for cost, path, nodes in found]
        return out


def graph_of(edges: pd.DataFrame) -> Graph:
    """A graph of edges (fid, u, v, length_m, safety) in memory."""
    u, v, fids = (edges[c].to_numpy(np.int64) for c in ("u", "v", "fid"))
    ids, ends, arcs, others = _adjacency(u, v)
    return Graph(ids, ends, arcs, others, fids, *_usable(edges["length_m"], edges["safety"]))


def _pieces(path: Path):
    """A file of node ids, in arrays of bounded size."""
    with path.open("rb") as file:
        while len(x := np.fromfile(file, np.int64, PART_EDGES)):
            yield x


def graph_file(edges: DataFrame, n_edges: int | None = None) -> str:
    """Write the graph into one file that every executor gets; its name.

    All of it goes through the driver in parts, for each of which the edges are
    read; it holds the places of the edges' ends, 8 bytes an edge, and the nodes.
    """
    context, name = edges.sparkSession.sparkContext, f"graph-{uuid.uuid4().hex}"
    n_edges = edges.count() if n_edges is None else n_edges
    target = Path(SparkFiles.getRootDirectory()) / name  # where Spark would put the driver's copy
    columns, parts = edges.select("u", "v", "fid", F.col("length_m").cast("double"), F.col("safety").cast("double")), -(-n_edges // PART_EDGES)
    ids, sides = np.zeros(0, np.int64), {n: target.with_name(f"{name}-{n}") for n in ("u", "v", "fid", "length", "risk", "arcs", "others")}
    with contextlib.ExitStack() as stack:
        files = {n: stack.enter_context(p.open("wb")) for n, p in sides.items()}
        for i in range(parts):
            part = columns.where(F.pmod(F.xxhash64("fid"), F.lit(parts)) == i) if parts > 1 else columns
            table = part.toArrow()
            length, risk = _usable(table["length_m"].to_numpy(), table["safety"].to_numpy())
            for n, x in (("length", length), ("risk", risk)):
                files[n].write(x.data)
            for n in ("u", "v", "fid"):
                files[n].write((x := table[n].to_numpy().astype(np.int64)).data)
                if n != "fid":
                    ids = np.union1d(ids, x)
            del table, part, length, risk, x
            release()
    u, v = (np.concatenate([_index(ids, x) for x in _pieces(sides[n])] or [np.zeros(0, np.int32)]) for n in ("u", "v"))
    n_edges, ends = len(u), np.zeros(len(ids) + 1, np.int64)
    at = 1
    with sides["arcs"].open("wb") as arcs, sides["others"].open("wb") as others:
        for degrees, edge, other in _arcs(u, v, len(ids), max(1, -(-n_edges // (PART_EDGES // 2)))):
            ends[at : at + len(degrees)] = degrees
            at += len(degrees)
            arcs.write(edge.data)
            others.write(other.data)
    del u, v
    np.cumsum(ends, out=ends)
    with target.open("wb") as out:
        out.write(np.array([len(ids), ends[-1], n_edges], np.int64).tobytes())
        for x in (ids, ends):
            out.write(x.data)
        for n, path in sides.items():
            if n not in ("u", "v"):
                with path.open("rb") as part:
                    shutil.copyfileobj(part, out, 1 << 20)
            path.unlink()
    release()
    context.addFile(str(target))
    return name


def _mapped(path: str) -> Graph:
    """The graph in a file of ``graph_file``; tasks of one machine share its pages."""
    n, m, e = np.fromfile(path, np.int64, 3).tolist()
    whole, at, parts = np.memmap(path, np.uint8, "r"), 24, []
    for count, kind in ((n, np.int64), (n + 1, np.int64), (e, np.int64), (e, np.float64), (e, np.float64), (m, np.int32), (m, np.int32)):
        size = count * np.dtype(kind).itemsize
        parts.append(np.asarray(whole[at : at + size]).view(kind))
        at += size
    ids, ends, fids, lengths, risks, arcs, others = parts
    return Graph(ids, ends, arcs, others, fids, lengths, risks)


#: A worker's last graph: tasks of one query share it.
_kept: dict[str, Graph] = {}


def _graph(name: str) -> Graph:
    if name not in _kept:
        _kept.clear()
        _kept[name] = _mapped(SparkFiles.get(name))
    return _kept[name]


def _schema(requests: DataFrame) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema), "rank int", "total_cost double", "fids array<bigint>", "nodes array<bigint>"])


def routes(requests: DataFrame, edges: DataFrame, k: int = 1, broadcast_edges: int = 20_000_000) -> DataFrame:
    """(request columns, rank, total_cost, fids, nodes) of the k cheapest simple paths of each request.

    requests: source, target (node ids), alpha, beta and any others. edges: one a
    node pair (fid, u, v, length_m, safety). A request without a path has no row.
    Edges are read once to be counted, and once for every ``PART_EDGES``; what is
    found is stored, so that no use of it searches again.
    """
    spark = requests.sparkSession
    ship(spark)
    picked = edges.select("fid", "u", "v", "length_m", "safety")
    n_edges = picked.count()
    if n_edges > broadcast_edges:
        return large_routes(requests, picked, k)
    name, columns = graph_file(picked, n_edges), requests.columns  # 46 bytes an edge, bounded by the count above

    def run(frames):
        graph = _graph(name)
        for frame in frames:
            for (alpha, beta), asked in frame.groupby(["alpha", "beta"], dropna=False):
                for start in range(0, len(asked), 500):
                    rows = asked.iloc[start : start + 500].to_dict("records")
                    pairs = [(x["source"], x["target"]) for x in rows]
                    if k == 1:
                        answers = [[x] if x else [] for x in graph.cheapest(pairs, alpha, beta)]
                    else:
                        answers = graph.several(pairs, alpha, beta, k)
                    out = [[*(row[c] for c in columns), rank, *path] for row, paths in zip(rows, answers) for rank, path in enumerate(paths, 1)]
                    yield pd.DataFrame(out, columns=[*columns, "rank", "total_cost", "fids", "nodes"])

    spread = requests.repartition(4 * spark.sparkContext.defaultParallelism, "source", "target", "alpha", "beta")
    return stored(spread.mapInPandas(run, _schema(requests)), "routes")


def large_routes(requests: DataFrame, edges: DataFrame, k: int = 1) -> DataFrame:
    """``routes`` over a graph of any size.

    A path has only edges whose cost, with the least costs from the source to one
    end and from the other end to the target, is within the path's. Each
    request's edges within some slack above its cheapest path go to one task,
    which searches them. A request is answered once its k-th path is within the
    slack, or the slack takes in every edge; for the others it grows.
    """
    ship(requests.sparkSession)
    asked = stored(requests.withColumn("_id", F.monotonically_increasing_id()), "routes-asked")
    ends = {n: asked.select(F.col("_id").alias("request_id"), "alpha", "beta", F.col(n).alias("source")) for n in ("source", "target")}
    there, back = (stored(relaxed_costs(ends[n], edges).withColumnRenamed("request_id", "_id"), f"routes-{n}") for n in ("source", "target"))
    least = asked.select("_id", "alpha", "beta", "target").join(there.withColumnRenamed("node", "target"), ["_id", "target"]).select("_id", "alpha", "beta", F.col("cost").alias("least"))
    both = edges.select("fid", "u", "v", "length_m", "safety")
    both = both.unionByName(both.select("fid", F.col("v").alias("u"), F.col("u").alias("v"), "length_m", "safety"))
    way = (
        least.join(there.withColumnsRenamed({"node": "u", "cost": "from_cost"}), "_id").join(both, "u").join(back.withColumnsRenamed({"node": "v", "cost": "to_cost"}), ["_id", "v"])
        .withColumn("way", F.col("from_cost") + edge_cost(F.col("length_m"), F.col("safety"), F.col("alpha"), F.col("beta")) + F.col("to_cost"))
    )
    way = stored(way.groupBy("_id", "fid").agg(*[F.first(c).alias(c) for c in ("u", "v", "length_m", "safety", "least")], F.min("way").alias("way")), "routes-ways")
    limits = stored(way.groupBy("_id").agg(F.first("least").alias("least"), F.max("way").alias("most")), "routes-limits")
    columns, waiting, done = requests.columns, asked.join(limits.select("_id"), "_id", "left_semi"), None  # without any way there is no path
    schema = f"_id long, {_schema(requests)}, found int"

    def run(key, left, right):
        row = left.to_dict("records")[0]
        paths = graph_of(right[["fid", "u", "v", "length_m", "safety"]].sort_values(["u", "v", "fid"])).shortest(row["source"], row["target"], row["alpha"], row["beta"], k)
        return pd.DataFrame([[row["_id"], *(row[c] for c in columns), rank, cost, fids, nodes, len(paths)] for rank, (cost, fids, nodes) in enumerate(paths, 1)], columns=["_id", *columns, "rank", "total_cost", "fids", "nodes", "found"])

    for slack in (0.0, 0.05, 0.2, 1.0) if k == 1 else (0.05, 0.2, 1.0):
        within = F.col("least") + slack * (F.col("most") - F.col("least")) + 1e-9
        near = way.drop("least").join(limits.join(waiting.select("_id"), "_id"), "_id").where((F.col("way") <= within) | F.lit(slack >= 1.0)).drop("least", "most", "way")
        found = stored(waiting.groupBy("_id").cogroup(near.groupBy("_id")).applyInPandas(run, schema), "routes-found")
        if slack >= 1.0:
            sure = waiting.select("_id")
        else:
            sure = stored(found.where(F.col("rank") == k).select("_id", "total_cost").join(limits, "_id").where(F.col("total_cost") <= within).select("_id"), "routes-sure")
        answered = found.join(sure, "_id", "left_semi").select(*columns, "rank", "total_cost", "fids", "nodes")
        done = answered if done is None else done.unionByName(answered)
        waiting = stored(waiting.join(sure, "_id", "left_anti"), "routes-waiting")
        if waiting.isEmpty():
            break
    return done


def relaxed_costs(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, node, cost) from each request's source to every node it reaches, by rounds of joins until nothing gets cheaper; for graphs of any size."""
    e = edges.select("u", "v", "length_m", "safety")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m", "safety"))
    best = stored(requests.select("request_id", "alpha", "beta", F.col("source").alias("node"), F.lit(0.0).alias("cost")), "relax")
    front = best
    while not front.isEmpty():  # costs are never negative, so this ends
        step = front.join(both, front["node"] == both["u"]).select("request_id", "alpha", "beta", F.col("v").alias("node"), (F.col("cost") + edge_cost(F.col("length_m"), F.col("safety"), F.col("alpha"), F.col("beta"))).alias("cost"))
        least = step.groupBy("request_id", "alpha", "beta", "node").agg(F.min("cost").alias("new"))
        front = stored(least.join(best.select("request_id", "node", F.col("cost").alias("old")), ["request_id", "node"], "left").where("old IS NULL OR new < old").select("request_id", "alpha", "beta", "node", F.col("new").alias("cost")), "relax-front")
        best = stored(best.unionByName(front).groupBy("request_id", "alpha", "beta", "node").agg(F.min("cost").alias("cost")), "relax")
    return best.select("request_id", "node", "cost")


def batch(networks: dict[str, DataFrame], ends: DataFrame, pairs=params.ROUTE_CASES, **kwargs) -> DataFrame:
    """(method, route_id, alpha, beta, total_cost, total_length_m, mean_safety) of every route, method and (alpha, beta).

    ends: route_id, source and target; networks: edges by method; pairs: (alpha, beta) or (alpha, beta, label).
    """
    spark, out = ends.sparkSession, None
    weights = F.broadcast(spark.createDataFrame([(float(p[0]), float(p[1])) for p in pairs], "alpha double, beta double"))  # a few rows
    for method, edges in networks.items():
        requests = ends.select("route_id", "source", "target").crossJoin(weights).withColumn("request_id", F.concat_ws(":", "route_id", "alpha", "beta"))
        found = routes(requests, edges, **kwargs)
        made = found.select("request_id", "route_id", "alpha", "beta").join(summaries(found, edges), "request_id").select(
            F.lit(method).alias("method"), "route_id", "alpha", "beta", "total_cost", "total_length_m", "mean_safety")
        out = made if out is None else out.unionByName(made)
    return out


def case_examples(results: DataFrame, labels=params.BATCH_CASES) -> DataFrame:
    """Batch results of the labelled (alpha, beta), with their ``case``."""
    table = F.broadcast(results.sparkSession.createDataFrame([(float(a), float(b), n) for a, b, n in labels], "alpha double, beta double, case string"))  # a few rows
    return results.join(table, ["alpha", "beta"])


def path_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each edge of each route, in order."""
    long = found.select("*", F.posexplode("fids").alias("at", "fid")).drop("fids", "nodes")
    return long.join(edges.select("fid", "length_m", "safety"), "fid")


def summaries(found: DataFrame, edges: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, rank, total_length_m, total_cost, mean_safety, min_safety, worst_fid); an unknown safety counts as 50."""
    parts = path_edges(found, edges).withColumn("s", clamped_safety(F.col("safety")))
    return parts.groupBy(key, "rank").agg(
        F.sum("length_m").alias("total_length_m"), F.first("total_cost").alias("total_cost"),
        (F.sum(F.col("s") * F.col("length_m")) / F.greatest(F.sum("length_m"), F.lit(1e-9))).alias("mean_safety"),
        F.min("s").alias("min_safety"), F.min_by("fid", F.struct("s", "at")).alias("worst_fid"),
    )


def features(found: DataFrame, nodes: DataFrame, summary: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, rank, feature): each route as a GeoJSON feature with its summary as properties; routes without an edge have none."""
    points = found.where("size(fids) > 0").select(key, "rank", "label", "alpha", "beta", F.posexplode("nodes").alias("at", "node_id")).join(nodes, "node_id")
    lines = points.groupBy(key, "rank", "label", "alpha", "beta").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    properties = F.struct("label", "alpha", "beta", "total_length_m", "total_cost", "mean_safety", "min_safety", "worst_fid")
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    return lines.join(summary, [key, "rank"]).select(key, "rank", feature.alias("feature"))


def cases(alpha: float | None = None, beta: float | None = None):
    """A request's own (alpha, beta), or the standard ones; only one of the two is an error."""
    if (alpha is None) != (beta is None):
        raise ValueError("alpha and beta go together")
    return params.ROUTE_CASES if alpha is None else ((alpha, beta, "Custom"),)


MODELS = {"ml": "safety_ml", "rule-based": "safety_rb", "rule_based": "safety_rb"}


def route(networks: dict[str, DataFrame], nodes: DataFrame, start, end, model: str = "ml", alpha=None, beta=None) -> DataFrame:
    """Answer one request: GeoJSON features of its cases over the model's network."""
    from footgrid.operators.network import nearest_nodes

    name = model.strip().lower()
    if name not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    if name.replace("_", "-") not in {k.replace("_", "-") for k in networks}:
        raise LookupError(f"no network loaded for {model!r}")
    edges = networks.get(name, networks.get(name.replace("_", "-")))
    spark = edges.sparkSession
    ends = spark.createDataFrame([("source", *map(float, start)), ("target", *map(float, end))], "which string, px double, py double")
    found = nearest_nodes(ends, nodes, "which", "px", "py").groupBy().pivot("which", ["source", "target"]).agg(F.first("node_id"))
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases(alpha, beta))], "request_id long, alpha double, beta double, label string")
    answers = routes(table.crossJoin(found), edges)
    return features(answers, nodes, summaries(answers, edges))
