"""Street graphs as DataFrames: edges (fid, u, v, length_m, safety) between node ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footgrid import params
from footgrid.operators.spatial import nearest_k
from footgrid.schema import with_row_id
from footgrid.storage import stored


def clamped_safety(safety: Column) -> Column:
    """Within 0..100; unknown is 50. (least and greatest skip nulls, so those are asked for first.)"""
    return F.when(safety.isNull() | F.isnan(safety), 50.0).otherwise(F.least(F.greatest(safety, F.lit(0.0)), F.lit(100.0)))


def edge_cost(length: Column, safety: Column, alpha: Column | float, beta: Column | float) -> Column:
    """``alpha * L + beta * (100 - S) * L / 100``; a length that isn't finite or positive is 0, an unknown safety 50, never below 0."""
    alpha, beta = (x if isinstance(x, Column) else F.lit(float(x)) for x in (alpha, beta))
    usable = length.isNotNull() & ~F.isnan(length) & (F.abs(length) < float("inf")) & (length > 0)
    l = F.when(usable, length).otherwise(0.0)
    return F.greatest(alpha * l + beta * (100.0 - clamped_safety(safety)) * l / 100.0, F.lit(0.0))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})


def collapse_parallels(edges: DataFrame, tie: str = "safer", alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """One edge a node pair: the cheapest, of equally cheap ones the safer (safety clamped) or the riskier (as stored), then the least fid."""
    if tie == "safer":
        edges, by = edges.withColumn("safety", clamped_safety(F.col("safety"))), F.col("safety").desc()
    elif tie == "riskier":
        by = F.coalesce("safety", F.lit(50.0)).asc()
    else:
        raise ValueError(f"unknown tie rule {tie}")
    costed = undirected(edges).withColumn("cost", edge_cost(F.col("length_m"), F.col("safety"), alpha, beta))
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("cost", by, "fid"))
    return costed.withColumn("_r", first).where("_r = 1").drop("_r")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of the simple graph; a self loop counts twice."""
    simple = undirected(edges).select("a", "b").distinct()
    return simple.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def with_degrees(edges: DataFrame) -> DataFrame:
    """Adds deg_u, deg_v and is_leaf. Of parallel edges only the last by fid keeps degrees, the others' are null."""
    deg = degrees(edges)
    last = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("fid"))) == 1
    marked = undirected(edges).withColumn("_last", last)
    out = marked.join(deg.select(F.col("node").alias("u"), F.col("degree").alias("deg_u")), "u", "left").join(deg.select(F.col("node").alias("v"), F.col("degree").alias("deg_v")), "v", "left")
    keep = {c: F.when(F.col("_last"), F.col(c)) for c in ("deg_u", "deg_v")}
    return out.withColumns(keep).withColumn("is_leaf", (F.col("deg_u") == 1) | (F.col("deg_v") == 1)).drop("_last", "a", "b")


def prune_stubs(edges: DataFrame, min_length: float = params.STUB_MIN_M, rounds: int = params.STUB_ROUNDS) -> DataFrame:
    """Remove leaf edges shorter than ``min_length`` and replaced parallels, some rounds or until nothing goes."""
    columns, n = edges.columns, None
    for _ in range(rounds):
        kept = with_degrees(edges).where(F.col("deg_u").isNotNull() & ~(F.col("is_leaf") & (F.col("length_m") < min_length))).select(*columns)
        n = edges.count() if n is None else n
        edges = stored(kept, "stubs")
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component: the least node it reaches.

    Each round a node takes the least label around it and then that label's own
    label, so chains shorten quickly; rounds are written to the shared folder.
    """
    pairs = stored(undirected(edges).where("a <> b").select("a", "b").distinct(), "component-edges")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = undirected(edges).select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    mark = None
    while True:
        labels = stored(labels, "component-labels")
        state = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if state == mark:
            return labels.select("node", F.col("label").alias("component"))
        mark = state
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(around, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = least.join(jump, "label").select("node", F.least("label", "further").alias("label"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: edges and nodes of the simple graph, kilometres of all rows, components, the largest, mean degree."""
    simple = undirected(edges).select("a", "b").distinct()
    by_component = components(edges).groupBy("component").agg(F.count("*").alias("size"))
    parts = by_component.agg(F.count("*").alias("components"), F.max("size").alias("largest_component"), F.sum("size").alias("n_nodes"))
    n = simple.agg(F.count("*").alias("n_edges"))
    km = edges.agg(F.bround(F.sum("length_m") / 1000, 1).alias("total_km"))
    return n.crossJoin(km).crossJoin(parts).select("n_edges", "n_nodes", "total_km", "components", "largest_component", F.bround(2.0 * F.col("n_edges") / F.col("n_nodes"), 2).alias("mean_degree"))


#: Query points up to which they are broadcast against one pass over the nodes.
FEW_POINTS = 256


def nearest_nodes(points: DataFrame, nodes: DataFrame, key: str, x: str, y: str, few: int = FEW_POINTS) -> DataFrame:
    """(key, node_id): the nearest node of each query point, however far; the least id of equally near ones.

    A request's few points, counted first, are broadcast against one pass over
    the nodes, each task keeping one candidate a point; a batch of more meets the
    nodes in cells.
    """
    asked = points.select(F.col(key), F.col(x).alias("x"), F.col(y).alias("y"))
    if asked.limit(few + 1).count() <= few:
        shared = F.broadcast(asked.withColumnsRenamed({"x": "_px", "y": "_py"}))
        d2 = F.pow(F.col("x") - F.col("_px"), 2) + F.pow(F.col("y") - F.col("_py"), 2)
        return nodes.crossJoin(shared).groupBy(key).agg(F.min_by("node_id", F.struct(d2, F.col("node_id"))).alias("node_id"))
    return nearest_k(asked, nodes, 1, key, "node_id", ["x", "y"]).select(key, "node_id")


def node_table(segments: DataFrame, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of segments: distinct rounded endpoints (node_id, x, y), numbered in their order, and the segments with u and v."""
    at = {n: F.round(n, digits) for n in ("x1", "y1", "x2", "y2")}
    ends = segments.select(F.explode(F.array(F.struct(at["x1"].alias("x"), at["y1"].alias("y")), F.struct(at["x2"].alias("x"), at["y2"].alias("y")))).alias("e")).select("e.x", "e.y").distinct()
    nodes = stored(with_row_id(ends, "node_id", "x", "y").select("node_id", "x", "y"), "nodes")
    placed = segments.withColumns({f"_{n}": c for n, c in at.items()})
    for end, name in (("1", "u"), ("2", "v")):
        placed = placed.join(nodes.select(F.col("node_id").alias(name), F.col("x").alias(f"_x{end}"), F.col("y").alias(f"_y{end}")), [f"_x{end}", f"_y{end}"])
    return nodes, placed.drop("_x1", "_y1", "_x2", "_y2")
