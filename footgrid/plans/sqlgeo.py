"""Geometry for the oracles, as DuckDB SQL text.

Written apart from the operators' geometry and by other means: segments meet by
solving for both parameters, boxes by their sides, covered lengths by cutting a
segment wherever it can enter or leave and asking each piece's middle.
"""

from __future__ import annotations


def segments_meet(a: str, b: str) -> str:
    """Solve a1 + t * da = b1 + u * db; parallel ones meet on one line where their extents overlap."""
    d = f"(({a}.x2-{a}.x1)*({b}.y2-{b}.y1)-({a}.y2-{a}.y1)*({b}.x2-{b}.x1))"
    t = f"(({b}.x1-{a}.x1)*({b}.y2-{b}.y1)-({b}.y1-{a}.y1)*({b}.x2-{b}.x1))"
    u = f"(({b}.x1-{a}.x1)*({a}.y2-{a}.y1)-({b}.y1-{a}.y1)*({a}.x2-{a}.x1))"
    extents = f"greatest(least({a}.x1,{a}.x2),least({b}.x1,{b}.x2)) <= least(greatest({a}.x1,{a}.x2),greatest({b}.x1,{b}.x2)) AND greatest(least({a}.y1,{a}.y2),least({b}.y1,{b}.y2)) <= least(greatest({a}.y1,{a}.y2),greatest({b}.y1,{b}.y2))"
    return f"(CASE WHEN {d} > 0 THEN {t} BETWEEN 0 AND {d} AND {u} BETWEEN 0 AND {d} WHEN {d} < 0 THEN {t} BETWEEN {d} AND 0 AND {u} BETWEEN {d} AND 0 ELSE {t} = 0 AND {u} = 0 AND {extents} END)"


def segment_meets_box(box: str = "") -> str:
    """An end of x1..y2 lies in the box, or the segment crosses one of its four sides."""
    b = f"{box}." if box else ""
    inside = " OR ".join(f"(x{n} BETWEEN {b}xmin AND {b}xmax AND y{n} BETWEEN {b}ymin AND {b}ymax)" for n in (1, 2))

    def side(p: str, q: str, at: str, low: str, high: str) -> str:
        run, there = f"({p}2-{p}1)", f"({q}1*({p}2-{p}1)+({b}{at}-{p}1)*({q}2-{q}1))"
        return f"({b}{at} BETWEEN least({p}1,{p}2) AND greatest({p}1,{p}2) AND {run} <> 0 AND {there} BETWEEN least({b}{low}*{run},{b}{high}*{run}) AND greatest({b}{low}*{run},{b}{high}*{run}))"

    sides = [side("x", "y", at, "ymin", "ymax") for at in ("xmin", "xmax")] + [side("y", "x", at, "xmin", "xmax") for at in ("ymin", "ymax")]
    return f"({inside} OR {' OR '.join(sides)})"


def point_segment_dist2(px: str, py: str) -> str:
    """Squared distance of a point to x1..y2: to the end it lies behind, else to the line."""
    dot, n = f"(({px}-x1)*(x2-x1)+({py}-y1)*(y2-y1))", "((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))"
    cross = f"(({px}-x1)*(y2-y1)-({py}-y1)*(x2-x1))"
    return f"(CASE WHEN {dot} <= 0 THEN ({px}-x1)*({px}-x1)+({py}-y1)*({py}-y1) WHEN {dot} >= {n} THEN ({px}-x2)*({px}-x2)+({py}-y2)*({py}-y2) ELSE {cross}*{cross}/{n} END)"


def covered_share() -> str:
    """The share of p + t * d, t in [0, 1], within r of the box [xa, xb] x [ya, yb]; columns px, py, dx, dy, xa, xb, ya, yb, r."""
    cuts = [f"(({v})-p{k})/nullif(d{k},0)" for k in "xy" for v in (f"{k}a", f"{k}b", f"{k}a-r", f"{k}b+r")]
    for qx in ("xa", "xb"):
        for qy in ("ya", "yb"):
            half, rest = f"((px-{qx})*dx+(py-{qy})*dy)", f"((px-{qx})*(px-{qx})+(py-{qy})*(py-{qy})-r*r)"
            cuts += [f"CASE WHEN {half}*{half} >= (dx*dx+dy*dy)*{rest} THEN (-{half}{s}sqrt({half}*{half}-(dx*dx+dy*dy)*{rest}))/nullif(dx*dx+dy*dy,0) END" for s in "+-"]
    away = lambda k, t: f"greatest({k}a-(p{k}+{t}*d{k}), 0, (p{k}+{t}*d{k})-{k}b)"
    return f"""list_transform([list_sort(list_filter([0.0e0, 1.0e0, {', '.join(cuts)}], lambda t: t IS NOT NULL AND t BETWEEN 0 AND 1))], lambda l:
list_sum(list_transform(range(1, len(l)), lambda i: CASE WHEN pow({away('x', '((l[i]+l[i+1])/2)')}, 2) + pow({away('y', '((l[i]+l[i+1])/2)')}, 2) <= r*r THEN l[i+1]-l[i] ELSE 0 END)))[1]"""


def inside_rings(edges: str, x: str, y: str) -> str:
    """Whether a point lies within an area by the even-odd rule over a table of edges (key k), as a correlated count."""
    return f"(SELECT count(*) % 2 = 1 FROM {edges} e WHERE e.k = ar.k AND (e.y1 > {y}) <> (e.y2 > {y}) AND ({x} - e.x1) * (e.y2 - e.y1) * sign(e.y2 - e.y1) < ({y} - e.y1) * (e.x2 - e.x1) * sign(e.y2 - e.y1))"
