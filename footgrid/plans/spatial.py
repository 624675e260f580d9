"""Queries on segments, areas, features, rasters and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from footgrid import params
from footgrid.fixtures import ctes, fixture
from footgrid.functions import geometry as G
from footgrid.operators import areas, features, network, raster, scoring, stats
from footgrid.plans import sqlgeo
from footgrid.operators.rules import crossing_rules
from footgrid.operators.spatial import nearest_within
from footgrid.tables import table

SQL: dict[str, str] = {}
_POLY_CLASSES = ["Fussgängerstreifen mit Insel", "Tram", "Auto", "30er-Zone-Markierung", "Pfeil"]
_IN_BOX = sqlgeo.segment_meets_box("fx_district")
_SCORES = "(SELECT *, 'RB' AS method, safety_rb AS score FROM fx_seg UNION ALL SELECT *, 'ML', safety_ml FROM fx_seg)"
_SUMMARY = """count(score) AS n, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, round(stddev_samp(score), 6) AS std_score,
count(*) FILTER (score < 20) AS n_below, round(100.0e0 * count(*) FILTER (score < 20) / nullif(count(score), 0), 6) AS pct_below"""


def _by_area(spark, d, *keys):
    joined = features.districts(fixture(spark, d, "fx_seg"), fixture(spark, d, "fx_district"))
    return stats.summary(stats.by_method(joined, RB="safety_rb", ML="safety_ml"), *keys)


def district_stats(spark, d):
    return _by_area(spark, d, "method", "stadtkreis")


def quarter_stats(spark, d):
    return _by_area(spark, d, "method", "quarter")


def overall_stats(spark, d):
    return stats.summary(stats.by_method(fixture(spark, d, "fx_seg"), RB="safety_rb", ML="safety_ml"), "method")


for _name, _key in (("district_stats", "stadtkreis"), ("quarter_stats", "quarter")):
    SQL[_name] = f"{ctes('fx_seg', 'fx_district')} SELECT method, {_key}, {_SUMMARY} FROM {_SCORES} s JOIN fx_district ON {_IN_BOX} GROUP BY method, {_key}"
SQL["overall_stats"] = f"{ctes('fx_seg')} SELECT method, {_SUMMARY} FROM {_SCORES} s GROUP BY method"


def share_below_threshold(spark, d):
    joined = features.districts(fixture(spark, d, "fx_seg"), fixture(spark, d, "fx_district"))
    return stats.summary(stats.by_method(joined, RB="safety_rb", ML="safety_ml"), "method", "stadtkreis", low=50.0).select("method", "stadtkreis", "n_below", "pct_below")


SQL["share_below_threshold"] = f"""{ctes('fx_seg', 'fx_district')} SELECT method, stadtkreis, count(*) FILTER (score < 50) AS n_below, round(100.0e0 * count(*) FILTER (score < 50) / nullif(count(score), 0), 6) AS pct_below
FROM {_SCORES} s JOIN fx_district ON {_IN_BOX} GROUP BY method, stadtkreis"""


def nearest_midpoint_with_ties(spark, d):
    seg = fixture(spark, d, "fx_seg")
    mid = seg.select("fid", F.round((F.col("x1") + F.col("x2")) / 2, 0).alias("mx"), F.round((F.col("y1") + F.col("y2")) / 2, 0).alias("my"), "highway")
    left = mid.where("fid % 2 = 0").select("fid", "mx", "my")
    right = mid.where("fid % 2 = 1").select(F.col("fid").alias("other"), F.col("mx").alias("ox"), F.col("my").alias("oy"), "highway")
    near = nearest_within(left, right, "fid", "mx", "my", "ox", "oy", params.NEAREST_MAX_M)
    return near.select("fid", "other", "highway", F.round("distance", 6).alias("distance"))


SQL["nearest_midpoint_with_ties"] = f"""{ctes('fx_seg')}, m AS (SELECT fid, round((x1+x2)/2, 0) AS mx, round((y1+y2)/2, 0) AS my, highway FROM fx_seg),
p AS (SELECT a.fid, b.fid AS other, b.highway, sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my)) AS dist FROM m a JOIN m b ON a.fid % 2 = 0 AND b.fid % 2 = 1 AND abs(a.mx-b.mx) <= 10 AND abs(a.my-b.my) <= 10),
r AS (SELECT *, rank() OVER (PARTITION BY fid ORDER BY dist) AS k FROM p WHERE dist <= 10) SELECT fid, other, highway, round(dist, 6) AS distance FROM r WHERE k = 1"""


def polyline_to_segments(spark, d):
    nodes = fixture(spark, d, "fx_node").withColumn("line", F.floor(F.col("node_id") / 5).cast("long"))
    lines = nodes.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))
    pairs = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b"))))
    seg = lines.where("size(path) > 1").select("line", pairs.alias("at", "s"))
    return seg.select("line", F.col("at").cast("long").alias("at"), F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


SQL["polyline_to_segments"] = f"""{ctes('fx_node')}, l AS (SELECT *, CAST(floor(node_id / 5) AS BIGINT) AS line FROM fx_node),
s AS (SELECT line, row_number() OVER w - 1 AS at, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM l WINDOW w AS (PARTITION BY line ORDER BY node_id)) SELECT * FROM s WHERE x2 IS NOT NULL"""


def overlay_cover_pivot(spark, d):
    wide = features.attach(fixture(spark, d, "fx_seg"), fixture(spark, d, "fx_poly"), _POLY_CLASSES)
    return wide.select("fid", *[F.round(c, 6).alias(f"c_{c}") for c in sorted(wide.columns) if c != "fid"])


def _rule_values() -> str:
    rows = [(c, *params.CLASS_RULES[c]) for c in _POLY_CLASSES]
    return ",".join(f"('{c}', {b}e0, {k}e0, {e}e0, {m}e0)" for c, b, k, e, m in rows)


_OVERLAY = f"""{{ctes}}, rule(cname, buffer_m, cover, extend_m, min_conf) AS (VALUES {_rule_values()}),
q AS (SELECT fx_poly.*, rule.*, CASE WHEN extend_m = 0 THEN -hw WHEN hw >= hh THEN -hw-extend_m ELSE hw END AS xa, CASE WHEN extend_m = 0 THEN hw WHEN hw >= hh THEN hw+extend_m ELSE hw END AS xb,
  CASE WHEN extend_m = 0 THEN -hh WHEN hw >= hh THEN -hh ELSE -hh-extend_m END AS ya, CASE WHEN extend_m = 0 THEN hh WHEN hw >= hh THEN -hh ELSE hh+extend_m END AS yb FROM fx_poly JOIN rule ON class_name = cname WHERE confidence >= min_conf),
n AS (SELECT fid, class_name, confidence, cover, length_m, buffer_m AS r, xa, xb, ya, yb, ca*(x1-cx)+sa*(y1-cy) AS px, ca*(y1-cy)-sa*(x1-cx) AS py, ca*(x2-x1)+sa*(y2-y1) AS dx, ca*(y2-y1)-sa*(x2-x1) AS dy FROM fx_seg JOIN q
  ON length_m > 0 AND abs((x1+x2)/2-cx) <= 80 AND abs((y1+y2)/2-cy) <= 80),
parts AS (SELECT fid, class_name, confidence, cover, length_m, {sqlgeo.covered_share()}*length_m AS part FROM n),
ov AS (SELECT fid, class_name, CASE WHEN sum(part) / first(length_m) >= first(cover) THEN max(confidence) ELSE 0 END AS val FROM parts WHERE part > 1e-9 GROUP BY fid, class_name),
feat AS (SELECT s.fid, {', '.join(f"coalesce(max(CASE WHEN class_name = '{c}' THEN val END), 0) AS {chr(34)}{features.key_of(c)}{chr(34)}" for c in _POLY_CLASSES)} FROM fx_seg s LEFT JOIN ov ON s.fid = ov.fid GROUP BY s.fid)"""
SQL["overlay_cover_pivot"] = f"""{_OVERLAY.format(ctes=ctes('fx_seg', 'fx_poly'))} SELECT fid, {', '.join(f'round({chr(34)}{features.key_of(c)}{chr(34)}, 6) AS c_{features.key_of(c)}' for c in sorted(_POLY_CLASSES))} FROM feat"""


def crossing_flag(spark, d):
    return features.crossing(fixture(spark, d, "fx_seg"), fixture(spark, d, "fx_road"))


_CROSS = f"cr AS (SELECT DISTINCT a.fid FROM fx_seg a JOIN fx_road b ON b.objektart IN ({','.join(repr(x) for x in params.ROAD_TYPES)}) AND {sqlgeo.segments_meet('a', 'b')})"
SQL["crossing_flag"] = f"{ctes('fx_seg', 'fx_road')}, {_CROSS} SELECT s.fid, CASE WHEN cr.fid IS NULL THEN 0 ELSE 1 END AS crossing FROM fx_seg s LEFT JOIN cr ON s.fid = cr.fid"


def _ruled(spark, d):
    seg = fixture(spark, d, "fx_seg")
    wide = features.attach(seg, fixture(spark, d, "fx_poly"), _POLY_CLASSES)
    return crossing_rules().apply(seg.select("fid", "length_m").join(wide, "fid").join(features.crossing(seg, fixture(spark, d, "fx_road")), "fid"))


def crossing_rules_applied(spark, d):
    out = _ruled(spark, d)
    return out.select("fid", *[c for c in out.columns if c.startswith("crossing")])


_RULED = f"""{_OVERLAY.format(ctes=ctes('fx_seg', 'fx_poly', 'fx_road'))}, {_CROSS},
b AS (SELECT s.fid, s.length_m, cr.fid IS NOT NULL AS c, fussgaengerstreifen_mit_insel > 0 AS m, tram > 0 AS t, feat.* EXCLUDE (fid) FROM fx_seg s JOIN feat ON s.fid = feat.fid LEFT JOIN cr ON s.fid = cr.fid),
ru AS (SELECT b.*, CAST(c AS INTEGER) AS crossing, CAST(c AND m AS INTEGER) AS crossing_with_pedestrian, CAST(c AND NOT m AS INTEGER) AS crossing_without_pedestrian, CAST(c AND NOT m AS INTEGER) AS crossing_without_marking,
CAST(c AND m AS INTEGER) AS crossing_has_island_and_marked, CAST(c AND t AS INTEGER) AS crossing_with_tram, CAST(c AND t AND m AS INTEGER) AS crossing_with_tram_with_pedestrian, CAST(c AND t AND NOT m AS INTEGER) AS crossing_with_tram_without_pedestrian,
CAST(c AND t AND NOT m AS INTEGER) AS crossing_with_tram_without_marking, CAST(c AND t AND m AS INTEGER) AS crossing_with_tram_has_island_and_marked FROM b)"""
SQL["crossing_rules_applied"] = f"{_RULED} SELECT fid, COLUMNS('crossing.*') FROM ru"


def rule_risk_scores(spark, d):
    out = scoring.rule_risk(_ruled(spark, d).withColumns({"deg_u": F.col("fid") % 7, "deg_v": F.col("fid") % 4}))
    return out.select("fid", *[F.round(c, 5).alias(c) for c in ("risk_raw", "safety_sigmoid", "safety_robust")])


_W = params.RISK_WEIGHTS
_RISK_COLUMNS = ("crossing_without_marking", "crossing_without_pedestrian", "crossing_with_tram", "crossing_with_tram_without_pedestrian", "crossing_with_tram_has_island_and_marked", "auto", "tram", "30er_zone_markierung", "fussgaengerstreifen_mit_insel")


def _risk_sql(ruled: str, columns: tuple[str, ...], gates: tuple[str, ...]) -> str:
    base = "+".join(f'({_W[k]}e0)*coalesce("{k}",0)' for k in columns)
    gate = "+".join(f"({params.GATE_WEIGHTS[k]}e0)*coalesce({k},0)" for k in gates)
    return f"""{ruled}, st AS (SELECT min(length_m) AS l0, max(length_m) AS l1, quantile_cont(fid % 7, 0.25) AS u1, quantile_cont(fid % 7, 0.5) AS u2, quantile_cont(fid % 7, 0.75) AS u3, quantile_cont(fid % 4, 0.25) AS v1, quantile_cont(fid % 4, 0.5) AS v2, quantile_cont(fid % 4, 0.75) AS v3 FROM ru),
nn AS (SELECT ru.*, (length_m - l0) / (l1 - l0) AS ln, (fid % 7 - u2) / (u3 - u1) AS du, (fid % 4 - v2) / (v3 - v1) AS dv FROM ru, st),
rr AS (SELECT fid, pow(greatest(0.0e0, ({base} + {_W['deg_u_norm']}e0*du + {_W['deg_v_norm']}e0*dv + CASE WHEN crossing > 0 THEN {gate} ELSE 0 END) * (1 + 0.5e0*ln) * (1 + 0.4e0*(du+dv))), 1.2e0) AS risk FROM nn),
qq AS (SELECT quantile_cont(risk, 0.01) AS a, quantile_cont(risk, 0.99) AS b FROM rr)
SELECT fid, round(risk, 5) AS risk_raw, round(100 * (1 - 1 / (1 + exp(-(risk - 5) * 0.5e0))), 5) AS safety_sigmoid, round(100 * (1 - (least(greatest(risk, a), b) - a) / (b - a + 1e-9)), 5) AS safety_robust FROM rr, qq"""


SQL["rule_risk_scores"] = _risk_sql(_RULED, _RISK_COLUMNS, ("tram",))


def ground_truth_first_label(spark, d):
    return features.ground_truth(fixture(spark, d, "fx_seg"), fixture(spark, d, "fx_gt"))


SQL["ground_truth_first_label"] = f"""{ctes('fx_seg', 'fx_gt')}, h AS (SELECT fid, arg_min(difficulty, gt_id) AS difficulty FROM fx_seg JOIN fx_gt ON abs(x - (x1+x2)/2) <= 40 AND abs(y - (y1+y2)/2) <= 40
AND {sqlgeo.point_segment_dist2('x', 'y')} <= 6.250001e0 GROUP BY fid) SELECT s.fid, h.difficulty FROM fx_seg s LEFT JOIN h ON s.fid = h.fid"""


def _grouped(spark, d):
    det = fixture(spark, d, "fx_det")
    return det.withColumn("group", F.when(F.col("label") % 3 == 0, "Arrow").when(F.col("label") % 3 == 1, "Crosswalk").otherwise("Unmapped"))


_GROUPED = f"{ctes('fx_det')}, gd AS (SELECT *, CASE WHEN label % 3 = 0 THEN 'Arrow' WHEN label % 3 = 1 THEN 'Crosswalk' ELSE 'Unmapped' END AS grp FROM fx_det)"
_IMG = "img AS (SELECT grp, image_id, arg_min(x, obj_key) AS x, arg_min(y, obj_key) AS y FROM gd GROUP BY grp, image_id)"


def image_neighbour_prefilter(spark, d):
    near = raster.image_neighbours(raster.first_positions(_grouped(spark, d)), 4.0)
    return near.where("neighbours >= 2").groupBy("group").agg(F.count("*").alias("n_images"), F.sum("neighbours").alias("n_pairs"))


SQL["image_neighbour_prefilter"] = f"""{_GROUPED}, {_IMG}, nb AS (SELECT a.grp, a.image_id, count(*) AS k FROM img a JOIN img b ON a.grp = b.grp AND abs(a.x-b.x) < 4 AND abs(a.y-b.y) < 4 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 16 GROUP BY a.grp, a.image_id)
SELECT grp AS "group", count(*) AS n_images, CAST(sum(k) AS BIGINT) AS n_pairs FROM nb WHERE k >= 2 GROUP BY grp"""

_GRID = """hd AS (SELECT min(x) AS xmin, max(y) AS ymax, greatest(ceil((max(x)-min(x))/2), 1) AS w, greatest(ceil((max(y)-min(y))/2), 1) AS h FROM gd),
pc AS (SELECT gd.*, CAST(trunc((x-xmin)/2) AS BIGINT) AS col, CAST(trunc((ymax-y)/2) AS BIGINT) AS "row" FROM gd, hd WHERE trunc((x-xmin)/2) < w AND trunc((ymax-y)/2) < h)"""


def _cells(spark, d):
    det = _grouped(spark, d)
    grid = raster.header(det)
    return raster.to_cells(det, grid), grid


def effort_raster(spark, d):
    return raster.effort(_cells(spark, d)[0])


SQL["effort_raster"] = f'{_GROUPED}, {_GRID} SELECT grp AS "group", "row", col, count(*) AS n FROM pc GROUP BY grp, "row", col'


def p95_cell_raster(spark, d):
    return raster.p95(_cells(spark, d)[0], 0.2).select("group", "row", "col", F.round("value", 6).alias("value"))


_P95 = 'pv AS (SELECT grp, "row", col, quantile_cont(confidence, 0.95) AS val FROM pc WHERE confidence >= 0.2e0 GROUP BY grp, "row", col), ef AS (SELECT grp, "row", col, count(*) AS n FROM pc GROUP BY grp, "row", col)'
SQL["p95_cell_raster"] = f'{_GROUPED}, {_GRID}, {_P95} SELECT grp AS "group", "row", col, round(val, 6) AS value FROM pv'


def _focal(spark, d):
    cells, grid = _cells(spark, d)
    return raster.focal_mean(raster.p95(cells, 0.2), raster.effort(cells), grid, 20, radius=6.0), grid


def focal_mean_masked(spark, d):
    return _focal(spark, d)[0].select("group", "row", "col", F.round("value", 9).alias("value"))


_FOCAL = f"""{_GROUPED}, {_GRID}, {_P95}, ko AS (SELECT a AS dr, b AS dc FROM range(-3, 4) t(a), range(-3, 4) u(b) WHERE a*a+b*b <= 9),
fs AS (SELECT grp, "row"+dr AS r, col+dc AS c, sum(val) AS s, count(*) AS k FROM pv, ko WHERE val <> 0 GROUP BY 1, 2, 3), fe AS (SELECT grp, "row"+dr AS r, col+dc AS c, sum(n) AS n FROM ef, ko GROUP BY 1, 2, 3 HAVING sum(n) >= 20),
fo AS (SELECT fs.grp, fs.r, fs.c, least(greatest(s / k, 0), 1) AS val FROM fs JOIN fe ON fs.grp = fe.grp AND fs.r = fe.r AND fs.c = fe.c, hd WHERE fs.r >= 0 AND fs.c >= 0 AND fs.r < h AND fs.c < w)"""
SQL["focal_mean_masked"] = f'{_FOCAL} SELECT grp AS "group", r AS "row", c AS col, round(val, 9) AS value FROM fo'


def zonal_mean(spark, d):
    cells, grid = _focal(spark, d)
    return raster.zonal_mean(fixture(spark, d, "fx_seg"), cells, grid).select("fid", "group", F.round("mean", 5).alias("mean"))


SQL["zonal_mean"] = f"""{_FOCAL.replace(ctes('fx_det'), ctes('fx_det', 'fx_seg'))}, zs AS (SELECT fid, x1, y1, x2, y2, hd.* FROM fx_seg, hd WHERE greatest(x1,x2)+12 >= xmin AND least(x1,x2)-12 <= xmin+2*w AND greatest(y1,y2)+12 >= ymax-2*h AND least(y1,y2)-12 <= ymax),
zc AS (SELECT fid, c, unnest(range(CAST(greatest(0, floor((ymax-greatest(y1,y2)-12)/2)) AS BIGINT), CAST(least(h, floor((ymax-least(y1,y2)+12)/2)+1) AS BIGINT))) AS r, x1, y1, x2, y2, xmin, ymax FROM
 (SELECT *, unnest(range(CAST(greatest(0, floor((least(x1,x2)-12-xmin)/2)) AS BIGINT), CAST(least(w, floor((greatest(x1,x2)+12-xmin)/2)+1) AS BIGINT))) AS c FROM zs)),
zi AS (SELECT fid, r, c FROM (SELECT *, xmin+2*(c+0.5e0) AS px, ymax-2*(r+0.5e0) AS py FROM zc) WHERE {sqlgeo.point_segment_dist2('px', 'py')} <= 144.000001e0),
zn AS (SELECT fid, count(*) AS n FROM zi GROUP BY fid), zt AS (SELECT fid, grp, sum(val) AS s FROM zi JOIN fo ON zi.r = fo.r AND zi.c = fo.c GROUP BY fid, grp)
SELECT zt.fid, grp AS "group", round(s / n, 5) AS mean FROM zt JOIN zn ON zt.fid = zn.fid"""


_HEAT = ("Crosswalk", "Tram/Rail", "Stop Line", "Traffic Lights", "Vehicles on the Road (motorized)")


def _heat_objects(spark, d):
    """Detections in five groups; their labels stand for the group names."""
    group = F.element_at(F.array(*[F.lit(g) for g in _HEAT]), F.col("label") % 5 + 1)
    return fixture(spark, d, "fx_det").where("label IS NOT NULL").withColumn("group", group)


def heat_maps(spark, d):
    """Heat maps of all groups with each group's parameters, images without neighbours left out first."""
    return raster.heat_maps(_heat_objects(spark, d))[0].select("group", "row", "col", F.round("value", 9).alias("value"))


_HEAT_RULES = ", ".join(f"('{g}', {params.HEAT_GROUPS[g][0]}e0, {params.HEAT_GROUPS[g][1]})" for g in _HEAT)
_HEAT_SQL = f"""{{ctes}}, hr(g, min_conf, min_effort) AS (VALUES {_HEAT_RULES}), ho AS (SELECT fx_det.*, list_extract([{', '.join(f"'{g}'" for g in _HEAT)}], label % 5 + 1) AS grp FROM fx_det WHERE label IS NOT NULL),
hd AS (SELECT min(x) AS xmin, max(y) AS ymax, greatest(ceil((max(x)-min(x))/2), 1) AS w, greatest(ceil((max(y)-min(y))/2), 1) AS h FROM ho),
hi AS (SELECT grp, image_id, arg_min(x, obj_key) AS x, arg_min(y, obj_key) AS y FROM ho GROUP BY grp, image_id),
hc AS (SELECT *, CAST(floor(x/15) AS BIGINT) AS cx, CAST(floor(y/15) AS BIGINT) AS cy FROM hi), ha AS (SELECT *, cx + unnest([-1, 0, 1]) AS nx FROM hc), hb AS (SELECT *, cy + unnest([-1, 0, 1]) AS ny FROM ha),
hn AS (SELECT hb.grp, hb.image_id, count(*) AS k FROM hb JOIN hc ON hb.grp = hc.grp AND nx = hc.cx AND ny = hc.cy WHERE (hb.x-hc.x)*(hb.x-hc.x)+(hb.y-hc.y)*(hb.y-hc.y) < 225 GROUP BY hb.grp, hb.image_id),
hk AS (SELECT hi.grp, hi.image_id, x, y, min_conf, min_effort FROM hi JOIN hn ON hi.grp = hn.grp AND hi.image_id = hn.image_id JOIN hr ON hi.grp = g WHERE k >= min_effort),
hv AS (SELECT ho.grp, CAST(trunc((ymax-ho.y)/2) AS BIGINT) AS r, CAST(trunc((ho.x-xmin)/2) AS BIGINT) AS c, quantile_cont(confidence, 0.95) AS val FROM ho JOIN hk ON ho.grp = hk.grp AND ho.image_id = hk.image_id, hd
  WHERE confidence >= min_conf AND trunc((ho.x-xmin)/2) < w AND trunc((ymax-ho.y)/2) < h GROUP BY 1, 2, 3),
he AS (SELECT grp, CAST(trunc((ymax-y)/2) AS BIGINT) AS r, CAST(trunc((x-xmin)/2) AS BIGINT) AS c, count(*) AS n FROM hk, hd WHERE trunc((x-xmin)/2) < w AND trunc((ymax-y)/2) < h GROUP BY 1, 2, 3),
ko AS (SELECT a AS dr, b AS dc FROM range(-7, 8) t(a), range(-7, 8) u(b) WHERE a*a+b*b <= 49),
hs AS (SELECT grp, r+dr AS r, c+dc AS c, sum(val) AS s, count(*) AS k FROM hv, ko WHERE val <> 0 GROUP BY 1, 2, 3), hf AS (SELECT grp, r+dr AS r, c+dc AS c, sum(n) AS n FROM he, ko GROUP BY 1, 2, 3),
fo AS (SELECT hs.grp, hs.r, hs.c, least(greatest(s / k, 0), 1) AS val FROM hs JOIN hf ON hs.grp = hf.grp AND hs.r = hf.r AND hs.c = hf.c JOIN hr ON hs.grp = g, hd WHERE n >= min_effort AND hs.r >= 0 AND hs.c >= 0 AND hs.r < h AND hs.c < w)"""
SQL["heat_maps"] = f'{_HEAT_SQL.format(ctes=ctes("fx_det"))} SELECT grp AS "group", r AS "row", c AS col, round(val, 9) AS value FROM fo'


def _rastered(spark, d):
    seg = fixture(spark, d, "fx_seg")
    cells, grid = raster.heat_maps(_heat_objects(spark, d))
    return raster.raster_columns(seg.select("fid"), raster.zonal_mean(seg, cells, grid), list(_HEAT))


def raster_columns(spark, d):
    """One column a heat map: its mean around each segment."""
    out = _rastered(spark, d)
    return out.select("fid", *[F.round(c, 6).alias(c) for c in out.columns if c != "fid"])


_RAST_KEYS = tuple(f"rast_{features.key_of(g)}" for g in _HEAT)
_ZONE = SQL["zonal_mean"][SQL["zonal_mean"].index("zs AS ("):SQL["zonal_mean"].index("SELECT zt.fid")].replace("GROUP BY fid, grp)", "GROUP BY fid, grp)").rstrip()
_RAST = f"""{_ZONE}, zm AS (SELECT zt.fid, grp, s / n AS mean FROM zt JOIN zn ON zt.fid = zn.fid),
rc AS (SELECT fx_seg.fid, {', '.join(f"coalesce(max(CASE WHEN grp = '{g}' THEN mean END), 0) AS {k}" for g, k in zip(_HEAT, _RAST_KEYS))} FROM fx_seg LEFT JOIN zm ON zm.fid = fx_seg.fid GROUP BY fx_seg.fid)"""
SQL["raster_columns"] = f"{_HEAT_SQL.format(ctes=ctes('fx_det', 'fx_seg'))}, {_RAST} SELECT fid, {', '.join(f'round({k}, 6) AS {k}' for k in _RAST_KEYS)} FROM rc"


def full_risk_scores(spark, d):
    """The published score from end to end: overlays, crossings, rules, heat maps and their means, then risk."""
    whole = _ruled(spark, d).join(_rastered(spark, d), "fid").withColumns({"deg_u": F.col("fid") % 7, "deg_v": F.col("fid") % 4})
    return scoring.rule_risk(whole).select("fid", *[F.round(c, 5).alias(c) for c in ("risk_raw", "safety_sigmoid", "safety_robust")])


_FULL = f"""{_HEAT_SQL.format(ctes=ctes('fx_det', 'fx_seg', 'fx_poly', 'fx_road'))}, {_RAST}, {_RULED[len(ctes('fx_seg', 'fx_poly', 'fx_road')) + 2:].replace('ru AS (', 'r0 AS (')}, ru AS (SELECT r0.*, rc.* EXCLUDE (fid) FROM r0 JOIN rc ON r0.fid = rc.fid)"""
SQL["full_risk_scores"] = _risk_sql(_FULL, (*_RISK_COLUMNS, *_RAST_KEYS), ("tram", "rast_tram_rail"))

#: Corners of an area in halves of its radius, and of its hole in metres.
_OUTER, _HOLE = ((2, 0), (1, 2), (-1, 2), (-2, 0), (-1, -2), (1, -2)), ((20, 20), (20, -20), (-20, -20), (-20, 20))


def _areas(spark, d):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    outer = F.array(*[point(F.col("cx") + F.col("r") * (a / 2), F.col("cy") + F.col("r") * (b / 2)) for a, b in _OUTER])
    hole = F.array(*[point(F.col("cx") + a, F.col("cy") + b) for a, b in _HOLE])
    return fixture(spark, d, "fx_area").select("k", F.array(outer, hole).alias("rings"))


def polygon_areas(spark, d):
    """Segments and the polygons with holes that they touch."""
    return areas.join_areas(fixture(spark, d, "fx_seg").select("fid", "x1", "y1", "x2", "y2"), _areas(spark, d), "k").select("fid", "k")


_CORNERS = "VALUES " + ", ".join([f"(0, {i}, {a / 2}e0, {b / 2}e0, 0, 0)" for i, (a, b) in enumerate(_OUTER)] + [f"(1, {i}, 0, 0, {a}, {b})" for i, (a, b) in enumerate(_HOLE)])
SQL["polygon_areas"] = f"""{ctes('fx_seg', 'fx_area')}, co(ring, i, a, b, dx, dy) AS ({_CORNERS}), pt AS (SELECT k, ring, i, cx + r*a + dx AS x, cy + r*b + dy AS y FROM fx_area, co),
ed AS (SELECT k, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM pt WINDOW w AS (PARTITION BY k, ring ORDER BY i)),
hit AS (SELECT DISTINCT a.fid, b.k FROM fx_seg a JOIN ed b ON {sqlgeo.segments_meet('a', 'b')} UNION SELECT s.fid, ar.k FROM fx_seg s, fx_area ar WHERE {sqlgeo.inside_rings('ed', 's.x1', 's.y1')})
SELECT fx_seg.fid, hit.k FROM fx_seg LEFT JOIN hit ON hit.fid = fx_seg.fid"""


def node_table(spark, d):
    """Segments as edges between numbered endpoints."""
    return network.node_table(fixture(spark, d, "fx_seg").select("fid", "x1", "y1", "x2", "y2"))[1].select("fid", "u", "v")


SQL["node_table"] = f"""{ctes('fx_seg')}, nd AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS id FROM (SELECT x1 AS x, y1 AS y FROM fx_seg UNION SELECT x2, y2 FROM fx_seg))
SELECT fid, a.id AS u, b.id AS v FROM fx_seg JOIN nd a ON a.x = x1 AND a.y = y1 JOIN nd b ON b.x = x2 AND b.y = y2"""


def ml_score_from_probs(spark, d):
    o = table(spark, d, "orders")
    p = {k: F.when(F.col("o_orderkey") % (i + 5) == 0, None).otherwise((F.col("o_custkey") * (i + 3) % 97) / 97.0) for i, k in enumerate(params.ML_WEIGHTS)}
    return o.select("o_orderkey", F.round(scoring.ml_score(p), 6).alias("safety_score"))


SQL["ml_score_from_probs"] = f"""WITH p AS (SELECT o_orderkey, {', '.join(f'CASE WHEN o_orderkey % {i + 5} = 0 THEN 0.0e0 ELSE (o_custkey * {i + 3} % 97) / 97.0e0 END AS p{i}' for i in range(4))} FROM orders)
SELECT o_orderkey, round(least(100, greatest(0, (100*p0+20*p1+10*p2+p3) / CASE WHEN p0+p1+p2+p3 = 0 THEN 1 ELSE p0+p1+p2+p3 END)), 6) AS safety_score FROM p"""


def method_compare_diff(spark, d):
    seg = fixture(spark, d, "fx_seg")
    rb, ml = seg.select("fid", F.col("safety_rb").alias("rb")), seg.where("safety_ml IS NOT NULL").select("fid", F.col("safety_ml").alias("ml"))
    return rb.join(ml, "fid").select("fid", "rb", "ml", F.round(F.col("ml") - F.col("rb"), 6).alias("diff"))


SQL["method_compare_diff"] = f"{ctes('fx_seg')} SELECT fid, safety_rb AS rb, safety_ml AS ml, round(safety_ml - safety_rb, 6) AS diff FROM fx_seg WHERE safety_ml IS NOT NULL"


def compact_export_halfeven(spark, d):
    joined = features.districts(fixture(spark, d, "fx_seg"), fixture(spark, d, "fx_district")).where("safety_ml IS NOT NULL")
    kept = joined.where(~F.col("stadtkreis").eqNullSafe("Kreis 0"))
    lon, lat = G.wgs84_from_swiss("x1", "y1")
    limit = lambda c: F.least(F.greatest(F.bround(c, 0), F.lit(0.0)), F.lit(100.0)).cast("short").cast("int")
    return kept.select("fid", F.replace("stadtkreis", F.lit("Kreis"), F.lit("District")).alias("district"), limit(F.col("safety_rb")).alias("rb"), limit(F.col("safety_ml")).alias("ml"), F.round(F.expr(lon), 6).alias("lon"), F.round(F.expr(lat), 6).alias("lat"))


_LON, _LAT = G.wgs84_from_swiss("x1", "y1")
SQL["compact_export_halfeven"] = f"""{ctes('fx_seg', 'fx_district')} SELECT fid, replace(stadtkreis, 'Kreis', 'District') AS district, CAST(least(greatest(round_even(safety_rb, 0), 0), 100) AS INTEGER) AS rb, CAST(least(greatest(round_even(safety_ml, 0), 0), 100) AS INTEGER) AS ml,
round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM fx_seg LEFT JOIN fx_district ON {_IN_BOX} WHERE safety_ml IS NOT NULL AND stadtkreis IS DISTINCT FROM 'Kreis 0'"""


def hex_counts(spark, d):
    from footgrid.operators.aerial import hex_index

    cells = hex_index(fixture(spark, d, "fx_cam"), "x", "y", 100.0)
    return cells.groupBy("q", "r").agg(F.count("*").alias("n")).select("q", "r", "n", F.round(F.log1p("n"), 6).alias("log_n"))


SQL["hex_counts"] = f"""{ctes('fx_cam')}, a AS (SELECT sqrt(3.0e0)/3*x/100-y/300 AS fq, 2*y/300 AS fr FROM fx_cam),
b AS (SELECT fq, fr, round(fq) AS rq, round(fr) AS rr, round(-fq-fr) AS rs FROM a), c AS (SELECT *, abs(rq-fq) AS dq, abs(rr-fr) AS dr, abs(rs+fq+fr) AS ds FROM b),
e AS (SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr-rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq-rs ELSE rr END AS BIGINT) AS r FROM c)
SELECT q, r, count(*) AS n, round(ln(1+count(*)), 6) AS log_n FROM e GROUP BY q, r"""
