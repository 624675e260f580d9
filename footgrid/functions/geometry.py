"""Planar geometry as SQL expression text, so every engine that runs SQL computes the same.

Points are ``x, y``; segments ``x1, y1, x2, y2``; oriented rectangles
``cx, cy, hw, hh, ca, sa`` (centre, half sizes, cosine and sine of the axis).
"""

from __future__ import annotations

import numpy as np


def dist2(ax, ay, bx, by) -> str:
    return f"(({ax})-({bx}))*(({ax})-({bx}))+(({ay})-({by}))*(({ay})-({by}))"


def point_segment_dist2(px, py, x1, y1, x2, y2) -> str:
    """Squared distance of a point to a segment, also one of no length."""
    dx, dy = f"(({x2})-({x1}))", f"(({y2})-({y1}))"
    len2 = f"({dx}*{dx}+{dy}*{dy})"
    t = f"coalesce(least(1.0e0, greatest(0.0e0, ((({px})-({x1}))*{dx}+(({py})-({y1}))*{dy})/nullif({len2}, 0.0e0))), 0.0e0)"
    return dist2(px, py, f"({x1})+{t}*{dx}", f"({y1})+{t}*{dy}")


def segments_meet(a: str, b: str) -> str:
    """Whether segments ``a.x1..a.y2`` and ``b.x1..b.y2`` share a point: each one's ends lie on both sides of the other, or on it."""

    def side(p, q, x, y):
        return f"(({q}.x2-{q}.x1)*({p}.{y}-{q}.y1)-({q}.y2-{q}.y1)*({p}.{x}-{q}.x1))"

    boxes = f"greatest({a}.x1,{a}.x2)>=least({b}.x1,{b}.x2) AND greatest({b}.x1,{b}.x2)>=least({a}.x1,{a}.x2) AND greatest({a}.y1,{a}.y2)>=least({b}.y1,{b}.y2) AND greatest({b}.y1,{b}.y2)>=least({a}.y1,{a}.y2)"
    return f"({boxes} AND {side(a, b, 'x1', 'y1')}*{side(a, b, 'x2', 'y2')}<=0 AND {side(b, a, 'x1', 'y1')}*{side(b, a, 'x2', 'y2')}<=0)"


def segment_meets_box(x1, y1, x2, y2, xmin, ymin, xmax, ymax) -> str:
    """Whether a segment and a box share a point, borders included: their extents overlap and the line has no side that holds all corners."""
    sides = ",".join(f"(({x2})-({x1}))*(({y})-({y1}))-(({y2})-({y1}))*(({x})-({x1}))" for x in (xmin, xmax) for y in (ymin, ymax))
    extents = f"greatest({x1},{x2})>={xmin} AND least({x1},{x2})<={xmax} AND greatest({y1},{y2})>={ymin} AND least({y1},{y2})<={ymax}"
    return f"({extents} AND least({sides})<=0 AND greatest({sides})>=0)"


def _slab(p, d, a) -> tuple[str, str]:
    """The parameters between which p + t*d lies within [-a, a]; an empty interval where it never does."""
    one, two = f"((-({a})-({p}))/nullif({d},0.0e0))", f"((({a})-({p}))/nullif({d},0.0e0))"
    inside = f"abs({p})<=({a})"
    return (
        f"(CASE WHEN ({d})=0 THEN (CASE WHEN {inside} THEN -1.0e9 ELSE 2.0e9 END) ELSE least({one},{two}) END)",
        f"(CASE WHEN ({d})=0 THEN (CASE WHEN {inside} THEN 1.0e9 ELSE -2.0e9 END) ELSE greatest({one},{two}) END)",
    )


def _box(px, py, dx, dy, a, b) -> tuple[str, str]:
    (x0, x1), (y0, y1) = _slab(px, dx, a), _slab(py, dy, b)
    low, high = f"greatest({x0},{y0})", f"least({x1},{y1})"
    return f"(CASE WHEN {low}<={high} THEN {low} ELSE 2.0e9 END)", f"(CASE WHEN {low}<={high} THEN {high} ELSE -2.0e9 END)"


def _disc(px, py, dx, dy, qx, qy, r) -> tuple[str, str]:
    a, b = f"(({dx})*({dx})+({dy})*({dy}))", f"((({px})-({qx}))*({dx})+(({py})-({qy}))*({dy}))"
    c = f"({dist2(px, py, qx, qy)}-({r})*({r}))"
    root = f"sqrt(greatest({b}*{b}-{a}*{c},0.0e0))"
    some = f"({a})>0 AND {b}*{b}-{a}*{c}>=0"
    return f"(CASE WHEN {some} THEN (-{b}-{root})/nullif({a},0.0e0) ELSE 2.0e9 END)", f"(CASE WHEN {some} THEN (-{b}+{root})/nullif({a},0.0e0) ELSE -2.0e9 END)"


def covered_share(px, py, dx, dy, a, b, r) -> str:
    """The share of the segment p + t*d, t in [0, 1], within the rectangle [-a, a] x [-b, b] dilated by r.

    The dilated rectangle is the union of two boxes and four discs. It is
    convex, so the segment meets it in one interval: from the least to the
    greatest parameter of any of the six.
    """
    pieces = [_box(px, py, dx, dy, f"({a})+({r})", b), _box(px, py, dx, dy, a, f"({b})+({r})")]
    pieces += [_disc(px, py, dx, dy, f"{s}({a})", f"{t}({b})", r) for s in ("", "-") for t in ("", "-")]
    low, high = ",".join(p[0] for p in pieces), ",".join(p[1] for p in pieces)
    return f"greatest(0.0e0, least(1.0e0, greatest({high}))-greatest(0.0e0, least({low})))"


def covered_steps(px, py, dx, dy, a, b, r) -> list[dict[str, str]]:
    """``covered_share`` as columns to add one after the other, the last of them ``share``: every part is computed once."""
    slabs = {"wx": (px, dx, f"({a})+({r})"), "nx": (px, dx, a), "wy": (py, dy, f"({b})+({r})"), "ny": (py, dy, b)}
    first = {f"_{n}{i}": e for n, (p, d, h) in slabs.items() for i, e in enumerate(_slab(p, d, h))} | {"_q": f"({dx})*({dx})+({dy})*({dy})"}
    corners = [(f"{s}({a})", f"{t}({b})") for s in ("", "-") for t in ("", "-")]
    for k, (x, y) in enumerate(corners):
        first |= {f"_h{k}": f"(({px})-({x}))*({dx})+(({py})-({y}))*({dy})", f"_c{k}": f"{dist2(px, py, x, y)}-({r})*({r})"}
    second = {"_l4": "greatest(_wx0,_ny0)", "_u4": "least(_wx1,_ny1)", "_l5": "greatest(_nx0,_wy0)", "_u5": "least(_nx1,_wy1)"}
    second |= {f"_d{k}": f"_h{k}*_h{k}-_q*_c{k}" for k in range(4)}
    third = {f"_l{k}": f"CASE WHEN _q>0 AND _d{k}>=0 THEN (-_h{k}-sqrt(_d{k}))/_q ELSE 2.0e9 END" for k in range(4)}
    third |= {f"_u{k}": f"CASE WHEN _q>0 AND _d{k}>=0 THEN (-_h{k}+sqrt(_d{k}))/_q ELSE -2.0e9 END" for k in range(4)}
    low = ",".join([*(f"_l{k}" for k in range(4)), *(f"CASE WHEN _l{k}<=_u{k} THEN _l{k} ELSE 2.0e9 END" for k in (4, 5))])
    high = ",".join([*(f"_u{k}" for k in range(4)), *(f"CASE WHEN _l{k}<=_u{k} THEN _u{k} ELSE -2.0e9 END" for k in (4, 5))])
    return [first, second, third, {"_low": f"least({low})", "_high": f"greatest({high})"}, {"share": "greatest(0.0e0, least(1.0e0, _high)-greatest(0.0e0, _low))"}]


def covered_shares(px, py, dx, dy, a, b, r) -> np.ndarray:
    """``covered_share`` of arrays."""
    far = 2.0e9

    def slab(p, d, h):
        flat = d == 0
        by = np.where(flat, 1.0, d)
        one, two = (-h - p) / by, (h - p) / by
        low, high = np.minimum(one, two), np.maximum(one, two)
        if flat.any():
            inside = np.abs(p[flat]) <= h[flat]
            low[flat], high[flat] = np.where(inside, -1.0e9, far), np.where(inside, 1.0e9, -far)
        return low, high

    def box(x, y):
        low, high = np.maximum(x[0], y[0]), np.minimum(x[1], y[1])
        empty = low > high
        low[empty], high[empty] = far, -far
        return low, high

    wide, tall = a + r, b + r
    pieces = [box(slab(px, dx, wide), slab(py, dy, b)), box(slab(px, dx, a), slab(py, dy, tall))]
    low, high = np.minimum(pieces[0][0], pieces[1][0]), np.maximum(pieces[0][1], pieces[1][1])
    q = dx * dx + dy * dy
    by = np.where(q > 0, q, 1.0)
    for x in (px - a, px + a):
        for y in (py - b, py + b):
            h = x * dx + y * dy
            under = h * h - q * (x * x + y * y - r * r)
            some = (under >= 0) & (q > 0)
            root = np.sqrt(np.where(some, under, 0.0))
            low = np.minimum(low, np.where(some, (-h - root) / by, far))
            high = np.maximum(high, np.where(some, (root - h) / by, -far))
    return np.maximum(0.0, np.minimum(1.0, high) - np.maximum(0.0, low))


def swiss_from_wgs84(lon, lat) -> tuple[str, str]:
    """East and north in metres by the published approximation formulas (about a metre)."""
    p, l = f"((({lat})*3600-169028.66e0)/10000)", f"((({lon})*3600-26782.5e0)/10000)"
    return (
        f"(2600072.37e0+211455.93e0*{l}-10938.51e0*{l}*{p}-0.36e0*{l}*{p}*{p}-44.54e0*{l}*{l}*{l})",
        f"(1200147.07e0+308807.95e0*{p}+3745.25e0*{l}*{l}+76.63e0*{p}*{p}-194.56e0*{l}*{l}*{p}+119.79e0*{p}*{p}*{p})",
    )


def wgs84_from_swiss(e, n) -> tuple[str, str]:
    """Longitude and latitude in degrees by the published approximation formulas."""
    y, x = f"((({e})-2600000)/1000000)", f"((({n})-1200000)/1000000)"
    lon = f"(2.6779094e0+4.728982e0*{y}+0.791484e0*{y}*{x}+0.1306e0*{y}*{x}*{x}-0.0436e0*{y}*{y}*{y})"
    lat = f"(16.9023892e0+3.238272e0*{x}-0.270978e0*{y}*{y}-0.002528e0*{x}*{x}-0.0447e0*{y}*{y}*{x}-0.0140e0*{x}*{x}*{x})"
    return f"({lon}*100/36)", f"({lat}*100/36)"


def web_mercator(lon, lat) -> tuple[str, str]:
    r = "6378137.0e0"
    return f"({r}*radians({lon}))", f"({r}*ln(tan(radians(45.0e0+({lat})/2))))"
