"""Queries on street graphs and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from footgrid import params
from footgrid.fixtures import ctes, fixture
from footgrid.operators import network, routing
from footgrid.storage import stored

SQL: dict[str, str] = {}
_COST = "greatest(0.0e0, {a} * length_m + {b} * (100 - CASE WHEN safety IS NULL THEN 50 ELSE least(greatest(safety, 0), 100) END) * length_m / 100)"
_CASES = ", ".join(f"({a}e0, {b}e0, '{n}')" for a, b, n in params.ROUTE_CASES)


def edge_cost_cases(spark, d):
    cases = spark.createDataFrame(list(params.ROUTE_CASES), "alpha double, beta double, label string")
    e = fixture(spark, d, "fx_edge").crossJoin(F.broadcast(cases))  # four rows
    return e.select("fid", "label", F.round(network.edge_cost(F.col("length_m"), F.col("safety"), F.col("alpha"), F.col("beta")), 6).alias("cost"))


SQL["edge_cost_cases"] = f"{ctes('fx_edge')}, cs(alpha, beta, label) AS (VALUES {_CASES}) SELECT fid, label, round({_COST.format(a='alpha', b='beta')}, 6) AS cost FROM fx_edge, cs"


def _collapsed(spark, d, tie):
    return network.collapse_parallels(fixture(spark, d, "fx_edge"), tie).select("a", "b", "fid", F.round("cost", 6).alias("cost"))


def parallel_edge_collapse_safer(spark, d):
    return _collapsed(spark, d, "safer")


def parallel_edge_collapse_riskier(spark, d):
    return _collapsed(spark, d, "riskier")


_E = f"e AS (SELECT *, least(u, v) AS a, greatest(u, v) AS b, {_COST.format(a='1', b='1')} AS cost FROM fx_edge)"
for _tie, _by in (("safer", "CASE WHEN safety IS NULL THEN 50 ELSE least(greatest(safety, 0), 100) END DESC"), ("riskier", "coalesce(safety, 50)")):
    SQL[f"parallel_edge_collapse_{_tie}"] = f"{ctes('fx_edge')}, {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY cost, {_by}, fid) AS k FROM e) SELECT a, b, fid, round(cost, 6) AS cost FROM r WHERE k = 1"


def node_degree_leaf(spark, d):
    return network.with_degrees(fixture(spark, d, "fx_edge")).select("fid", "deg_u", "deg_v", "is_leaf")


def _degree_cte(n: str, source: str) -> str:
    return f"""s{n} AS (SELECT *, least(u, v) AS a, greatest(u, v) AS b, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY fid DESC) AS k FROM {source}),
g{n} AS (SELECT node, count(*) AS degree FROM (SELECT unnest([a, b]) AS node FROM s{n} WHERE k = 1) GROUP BY node),
w{n} AS (SELECT s{n}.fid, s{n}.u, s{n}.v, s{n}.safety, s{n}.length_m, CASE WHEN k = 1 THEN p.degree END AS deg_u, CASE WHEN k = 1 THEN q.degree END AS deg_v FROM s{n} JOIN g{n} p ON p.node = u JOIN g{n} q ON q.node = v)"""


SQL["node_degree_leaf"] = f"{ctes('fx_edge')}, {_degree_cte('1', 'fx_edge')} SELECT fid, deg_u, deg_v, deg_u = 1 OR deg_v = 1 AS is_leaf FROM w1"


def stub_prune_2(spark, d):
    return network.prune_stubs(fixture(spark, d, "fx_edge"), 3000.0, 2).select("fid", F.round("length_m", 6).alias("length_m"))


_KEPT = "SELECT fid, u, v, safety, length_m FROM w{n} WHERE deg_u IS NOT NULL AND NOT ((deg_u = 1 OR deg_v = 1) AND length_m < 3000)"
SQL["stub_prune_2"] = f"{ctes('fx_edge')}, {_degree_cte('1', 'fx_edge')}, k1 AS ({_KEPT.format(n=1)}), {_degree_cte('2', 'k1')}, k2 AS ({_KEPT.format(n=2)}) SELECT fid, round(length_m, 6) AS length_m FROM k2"

_REACH = """pr AS (SELECT u AS a, v AS b FROM fx_edge UNION SELECT v, u FROM fx_edge), cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM pr
  UNION SELECT pr.b, min(cc.component) FROM cc JOIN pr ON pr.a = cc.node JOIN recurring.cc AS old ON old.node = pr.b WHERE cc.component < old.component GROUP BY pr.b)"""


def connected_components(spark, d):
    return network.components(fixture(spark, d, "fx_edge"))


SQL["connected_components"] = f"{ctes('fx_edge')}, {_REACH} SELECT node, component FROM cc"


def network_stats(spark, d):
    return network.statistics(fixture(spark, d, "fx_edge"))


SQL["network_stats"] = f"""{ctes('fx_edge')}, {_REACH}, sm AS (SELECT count(*) AS n_edges FROM (SELECT DISTINCT least(u, v), greatest(u, v) FROM fx_edge)), sz AS (SELECT component, count(*) AS size FROM cc GROUP BY component)
SELECT n_edges, (SELECT round_even(sum(length_m) / 1000, 1) FROM fx_edge) AS total_km, (SELECT count(*) FROM sz) AS components, (SELECT max(size) FROM sz) AS largest_component, (SELECT count(*) FROM cc) AS n_nodes,
round_even(2.0e0 * n_edges / (SELECT count(*) FROM cc), 2) AS mean_degree FROM sm"""


def network_table(spark, d):
    """One row a network: the whole, the pruned, and the one of safe edges."""
    e = fixture(spark, d, "fx_edge")
    parts = [("all", e), ("pruned", network.prune_stubs(e, 3000.0, 2)), ("safe", e.where("safety >= 50"))]
    rows = [network.statistics(x).select(F.lit(n).alias("network"), "n_edges", "n_nodes", "total_km") for n, x in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _stat(name: str, source: str) -> str:
    return f"SELECT '{name}' AS network, (SELECT count(*) FROM (SELECT DISTINCT least(u, v), greatest(u, v) FROM {source})) AS n_edges, (SELECT count(DISTINCT x) FROM (SELECT unnest([u, v]) AS x FROM {source})) AS n_nodes, (SELECT round_even(sum(length_m) / 1000, 1) FROM {source}) AS total_km"


SQL["network_table"] = f"{ctes('fx_edge')}, {_degree_cte('1', 'fx_edge')}, k1 AS ({_KEPT.format(n=1)}), {_degree_cte('2', 'k1')}, k2 AS ({_KEPT.format(n=2)}), sf AS (SELECT * FROM fx_edge WHERE safety >= 50) {_stat('all', 'fx_edge')} UNION ALL {_stat('pruned', 'k2')} UNION ALL {_stat('safe', 'sf')}"


def _ends(spark, d):
    """Both ends of all requests are looked up in one pass."""
    nodes, od = fixture(spark, d, "fx_node"), fixture(spark, d, "fx_od")
    ends = od.selectExpr("od_id * 2 AS end_id", "sx AS px", "sy AS py").unionByName(od.selectExpr("od_id * 2 + 1 AS end_id", "tx AS px", "ty AS py"))
    at = lambda end: F.max(F.expr(f"CASE WHEN pmod(end_id, 2) = {end} THEN node_id END"))
    return network.nearest_nodes(ends, nodes, "end_id", "px", "py").groupBy(F.expr("(end_id - pmod(end_id, 2)) div 2").alias("od_id")).agg(at(0).alias("source"), at(1).alias("target"))


def nearest_node(spark, d):
    return _ends(spark, d)


_ENDS = """sn AS (SELECT od_id, arg_min(node_id, ((x-sx)*(x-sx)+(y-sy)*(y-sy), node_id)) AS source FROM fx_od, fx_node GROUP BY od_id), tn AS (SELECT od_id, arg_min(node_id, ((x-tx)*(x-tx)+(y-ty)*(y-ty), node_id)) AS target FROM fx_od, fx_node GROUP BY od_id)"""
SQL["nearest_node"] = f"{ctes('fx_node', 'fx_od')}, {_ENDS} SELECT sn.od_id, source, target FROM sn JOIN tn ON sn.od_id = tn.od_id"


def _requests(spark, d):
    cases = spark.createDataFrame(list(params.ROUTE_CASES), "alpha double, beta double, label string")
    return _ends(spark, d).crossJoin(F.broadcast(cases)).withColumn("request_id", F.concat_ws(":", "od_id", "label"))


def _network(spark, d):
    """Stored, as routes and their summaries each read it."""
    return stored(network.collapse_parallels(fixture(spark, d, "fx_edge"), "safer").select("fid", F.col("a").alias("u"), F.col("b").alias("v"), "length_m", "safety"), "network")


def shortest_path_cost(spark, d):
    found = routing.routes(_requests(spark, d), _network(spark, d))
    return found.select("od_id", "label", F.round("total_cost", 5).alias("total_cost"))


SQL["shortest_path_cost"] = f"""{ctes('fx_edge', 'fx_od')}, {_E}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY cost, CASE WHEN safety IS NULL THEN 50 ELSE least(greatest(safety, 0), 100) END DESC, fid) AS k FROM e) WHERE k = 1),
{_ENDS}, cs(alpha, beta, label) AS (VALUES {_CASES}), rq AS (SELECT sn.od_id * 10 + row_number() OVER (PARTITION BY sn.od_id ORDER BY label) AS rid, sn.od_id, label, source, target, alpha, beta FROM sn JOIN tn ON sn.od_id = tn.od_id, cs),
es AS (SELECT label, a, b, {_COST.format(a='alpha', b='beta')} AS c FROM one, cs), eb AS (SELECT label, a, b, c FROM es UNION ALL SELECT label, b, a, c FROM es),
dj(rid, label, node, dist) USING KEY (rid, node) AS (SELECT rid, label, source, 0.0e0 FROM rq
  UNION SELECT dj.rid, dj.label, eb.b, min(dj.dist + eb.c) FROM dj JOIN eb ON eb.label = dj.label AND eb.a = dj.node LEFT JOIN recurring.dj AS old ON old.rid = dj.rid AND old.node = eb.b
  WHERE old.dist IS NULL OR dj.dist + eb.c < old.dist - 1e-9 GROUP BY dj.rid, dj.label, eb.b)
SELECT od_id, rq.label, round(dist, 5) AS total_cost FROM rq JOIN dj ON rq.rid = dj.rid AND dj.node = rq.target"""


def route_summary(spark, d):
    edges = _network(spark, d)
    return routing.summaries(routing.routes(_requests(spark, d), edges), edges)


def k_shortest(spark, d):
    found = routing.routes(_requests(spark, d).where("label = 'Balanced'"), _network(spark, d), k=3)
    return found.select("od_id", "rank", F.round("total_cost", 5).alias("total_cost"), F.size("fids").alias("n_edges"))


def routes_geojson(spark, d):
    edges = _network(spark, d)
    found = routing.routes(_requests(spark, d), edges)
    return routing.features(found, fixture(spark, d, "fx_node"), routing.summaries(found, edges))


def routing_batch(spark, d):
    """Every route by two methods and the labelled weights: costs of the case examples."""
    edges = _network(spark, d)
    networks = {"ml": edges, "rule-based": edges.withColumn("safety", 100 - F.coalesce("safety", F.lit(50.0)))}
    found = routing.batch(networks, _ends(spark, d).withColumnRenamed("od_id", "route_id"))
    return routing.case_examples(found).select("method", "route_id", "case", F.round("total_cost", 5).alias("total_cost"))


_BATCH = ", ".join(f"({a}e0, {b}e0, '{n}')" for a, b, n in params.BATCH_CASES)
SQL["routing_batch"] = f"""{ctes('fx_edge', 'fx_od')}, {_E}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY cost, CASE WHEN safety IS NULL THEN 50 ELSE least(greatest(safety, 0), 100) END DESC, fid) AS k FROM e) WHERE k = 1),
{_ENDS}, cs(alpha, beta, label) AS (VALUES {_BATCH}), ms(method) AS (VALUES ('ml'), ('rule-based')), rq AS (SELECT sn.od_id, method, label, source, target, row_number() OVER () AS rid FROM sn JOIN tn ON sn.od_id = tn.od_id, cs, ms),
sf AS (SELECT method, a, b, length_m, least(greatest(CASE WHEN method = 'ml' THEN s ELSE 100 - s END, 0), 100) AS s FROM (SELECT *, least(greatest(coalesce(safety, 50), 0), 100) AS s FROM one), ms),
es AS (SELECT method, label, a, b, greatest(0.0e0, alpha * length_m + beta * (100 - s) * length_m / 100) AS c FROM sf, cs), eb AS (SELECT method, label, a, b, c FROM es UNION ALL SELECT method, label, b, a, c FROM es),
dj(rid, method, label, node, dist) USING KEY (rid, node) AS (SELECT rid, method, label, source, 0.0e0 FROM rq
  UNION SELECT dj.rid, dj.method, dj.label, eb.b, min(dj.dist + eb.c) FROM dj JOIN eb ON eb.method = dj.method AND eb.label = dj.label AND eb.a = dj.node LEFT JOIN recurring.dj AS old ON old.rid = dj.rid AND old.node = eb.b
  WHERE old.dist IS NULL OR dj.dist + eb.c < old.dist - 1e-9 GROUP BY dj.rid, dj.method, dj.label, eb.b)
SELECT rq.method, od_id AS route_id, rq.label AS "case", round(dist, 5) AS total_cost FROM rq JOIN dj ON rq.rid = dj.rid AND dj.node = rq.target WHERE source <> target"""
