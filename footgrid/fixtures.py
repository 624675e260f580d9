"""Views derived from the base tables, in SQL that Spark and DuckDB both run.

``{name}`` stands for a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from footgrid.tables import table

VIEWS = {
    "fx_node": """
SELECT n AS node_id, CAST(2680000 + (n * 7919) % 10007 AS DOUBLE) AS x, CAST(1246000 + (n * 104729) % 10009 AS DOUBLE) AS y
FROM (SELECT c_custkey * 4 + k AS n FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) l) m""",
    "fx_edge": """
SELECT e.fid, e.u, e.v, e.safety, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS length_m
FROM (SELECT o_orderkey AS fid, o_custkey * 4 + o_orderkey % 4 AS u, ((o_custkey*31 + o_orderkey*17) % (SELECT count(*) FROM {customer})) * 4 + (o_custkey + o_orderkey * 3) % 4 AS v,
             CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 4000 END AS safety
      FROM {orders}) e
JOIN {fx_node} a ON e.u = a.node_id JOIN {fx_node} b ON e.v = b.node_id""",
    "fx_seg": """
SELECT fid, x1, y1, x1 + dx AS x2, y1 + dy AS y2, sqrt(dx*dx + dy*dy) AS length_m, safety_rb, safety_ml, highway, access
FROM (SELECT p_partkey AS fid, CAST(2680000 + (p_partkey * 37) % 2003 AS DOUBLE) AS x1, CAST(1246000 + (p_partkey * 91) % 1999 AS DOUBLE) AS y1,
             CASE WHEN p_partkey % 97 = 0 THEN 0.0e0 ELSE CAST(p_size - 25 AS DOUBLE) END AS dx,
             CASE WHEN p_partkey % 97 = 0 THEN 0.0e0 ELSE CAST((p_partkey % 41) - 20 AS DOUBLE) END AS dy,
             CAST((p_partkey * 13) % 101 AS DOUBLE) AS safety_rb,
             CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST((p_partkey * 29) % 101 AS DOUBLE) + p_size * 0.25e0 END AS safety_ml,
             CASE p_type WHEN 'ECONOMY' THEN 'footway' WHEN 'SMALL' THEN 'path' WHEN 'MEDIUM' THEN 'steps' WHEN 'PROMO' THEN 'primary' ELSE NULL END AS highway,
             CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'yes' ELSE 'private' END AS access
      FROM {part}) s""",
    "fx_poly": """
SELECT o_orderkey AS poly_id, CAST(2680000 + (o_orderkey * 53) % 2003 AS DOUBLE) AS cx, CAST(1246000 + (o_custkey * 29) % 1999 AS DOUBLE) AS cy,
       CAST(1 + o_orderkey % 7 AS DOUBLE) AS hw, CAST(1 + o_custkey % 13 AS DOUBLE) AS hh,
       CASE o_orderkey % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.6e0 ELSE 0.0e0 END AS ca,
       CASE o_orderkey % 3 WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.8e0 ELSE 1.0e0 END AS sa,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Fussgängerstreifen mit Insel' WHEN '2-HIGH' THEN 'Tram' WHEN '3-MEDIUM' THEN 'Auto'
            WHEN '4-NOT SPECIFIED' THEN '30er-Zone-Markierung' ELSE 'Pfeil' END AS class_name,
       CASE o_orderstatus WHEN 'F' THEN 'M1' WHEN 'O' THEN 'M2' ELSE 'M3' END AS model_name, o_totalprice / 500000 AS confidence
FROM {orders}""",
    "fx_det": """
SELECT CAST(l_orderkey AS STRING) AS image_id, l_extendedprice AS obj_key,
       CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_partkey % 124 AS INT) END AS label,
       l_discount * 10 AS confidence, l_extendedprice / 1000 AS depth,
       CAST(l_quantity * 16 AS INT) AS bx1, CAST(l_linenumber * 20 AS INT) AS by1, CAST(l_quantity * 16 AS INT) + l_linenumber * 30 AS bx2, CAST(l_linenumber * 20 AS INT) + 80 AS by2,
       CAST(2680000 + (l_partkey * 71 + l_linenumber) % 503 AS DOUBLE) AS x, CAST(1246000 + (l_suppkey * 83 + l_linenumber * 7) % 499 AS DOUBLE) AS y
FROM {lineitem}""",
    "fx_cam": """
SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus = 'P' END AS is_pano,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST((o_custkey * 7) % 360 AS DOUBLE) END AS compass,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_totalprice / 2500 END AS blur_value, o_orderdate AS captured_at,
       CAST(2680000 + (o_custkey * 37) % 2003 AS DOUBLE) AS x, CAST(1246000 + (o_orderkey * 91) % 1999 AS DOUBLE) AS y
FROM {orders} WHERE o_orderkey % 10 <> 9""",
    "fx_district": """
SELECT concat('Kreis ', CAST(n_nationkey AS STRING)) AS stadtkreis, n_name AS quarter,
       CAST(2680000 + (n_nationkey % 5) * 401 AS DOUBLE) AS xmin, CAST(2680000 + (n_nationkey % 5) * 401 + 401 AS DOUBLE) AS xmax,
       CAST(1246000 + floor(n_nationkey / 5) * 400 AS DOUBLE) AS ymin, CAST(1246000 + floor(n_nationkey / 5) * 400 + 400 AS DOUBLE) AS ymax
FROM {nation}""",
    "fx_road": """
SELECT s_suppkey AS road_id, CAST(2680000 + (s_suppkey * 197) % 2003 AS DOUBLE) AS x1, CAST(1246000 + (s_suppkey * 313) % 1999 AS DOUBLE) AS y1,
       CAST(2680000 + (s_suppkey * 197) % 2003 + 150 - (s_suppkey % 7) * 40 AS DOUBLE) AS x2, CAST(1246000 + (s_suppkey * 313) % 1999 + 120 - (s_suppkey % 5) * 50 AS DOUBLE) AS y2,
       CASE s_suppkey % 5 WHEN 0 THEN '10m Strasse' WHEN 1 THEN '4m Strasse' WHEN 2 THEN '6m Strasse' WHEN 3 THEN '8m Strasse' ELSE 'Weg' END AS objektart
FROM {supplier}""",
    "fx_gt": """
SELECT c_custkey AS gt_id, CAST(2680000 + ((c_custkey % 400) * 37) % 2003 AS DOUBLE) AS x, CAST(1246000 + ((c_custkey % 400) * 91) % 1999 AS DOUBLE) AS y,
       CASE c_nationkey % 4 WHEN 0 THEN 'Geeignet' WHEN 1 THEN 'erhöhte Anforderung' WHEN 2 THEN 'anspruchsvoll' ELSE 'nicht empfohlen' END AS difficulty
FROM {customer}""",
    "fx_od": """
SELECT s_suppkey AS od_id, CAST(2680000 + (s_suppkey * 4241) % 10007 AS DOUBLE) AS sx, CAST(1246000 + (s_suppkey * 3571) % 10009 AS DOUBLE) AS sy,
       CAST(2680000 + (s_suppkey * 1493) % 10007 AS DOUBLE) AS tx, CAST(1246000 + (s_suppkey * 6007) % 10009 AS DOUBLE) AS ty
FROM {supplier}""",
    "fx_area": """
SELECT n_nationkey AS k, CAST(2680200 + (n_nationkey % 5) * 401 AS DOUBLE) AS cx, CAST(1246200 + floor(n_nationkey / 5) * 400 AS DOUBLE) AS cy, CAST(150 + 10 * (n_nationkey % 7) AS DOUBLE) AS r
FROM {nation}""",
}


def _needed(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    sql = VIEWS[name]
    # Views have many times the rows of the small files they come from, by whose size Spark would broadcast them.
    return spark.sql(sql, **{n: fixture(spark, sf_dir, n).hint("merge") if n in VIEWS else table(spark, sf_dir, n) for n in _needed(sql)})


def ctes(*names: str) -> str:
    """``WITH`` and the views with those they need, for SQL over the base tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _needed(VIEWS[name]):
            if n in VIEWS:
                add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in order)
