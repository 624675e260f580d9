"""Areas, neighbours, learning, large graphs and depth maps against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footgrid import storage
from footgrid.functions import geometry as G
from footgrid.functions import scalar as S
from footgrid.operators import aerial, areas, dataset, depth, ml, network, raster, routing, shapes, stats
from footgrid.operators.spatial import nearest_k
from footgrid.schema import common_columns, flattened, numbered

STAR = [(0.0, 0.0), (40.0, 10.0), (80.0, 0.0), (60.0, 40.0), (80.0, 80.0), (40.0, 60.0), (0.0, 80.0), (20.0, 40.0)]
HOLE = [(35.0, 35.0), (35.0, 45.0), (45.0, 45.0), (45.0, 35.0)]


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                n += 1
    return n % 2 == 1


def meets(a, b):
    """Exact for whole numbers: orientations, and extents for points on the line."""
    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def between(p, q, r):
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    (p, q), (r, s) = a, b
    t = [turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)]
    if any(v == 0 and between(*w) for v, w in zip(t, ((p, q, r), (p, q, s), (r, s, p), (r, s, q)))):
        return True
    return (t[0] > 0) != (t[1] > 0) and (t[2] > 0) != (t[3] > 0) and all(t)


def test_points_and_segments_in_areas(spark):
    rng, rings = random.Random(4), {1: [STAR, HOLE], 2: [[(x + 500.0, y + 300.0) for x, y in STAR]], 3: [[(x * 9, y * 9) for x, y in STAR]]}
    table = spark.createDataFrame([(k, [[p for p in r] for r in rs]) for k, rs in rings.items()], f"k int, rings {areas.RINGS}")
    points = [(i, float(rng.randint(-20, 600)), float(rng.randint(-20, 400)) + 0.5) for i in range(400)]
    got = {(r.i, r.k) for r in areas.containing(spark.createDataFrame(points, "i int, x double, y double"), "x", "y", areas.border(table, "k"), "k").collect()}
    assert got == {(i, k) for i, x, y in points for k, rs in rings.items() if inside(x, y, rs)} and got
    segments = [(i, float(a), float(b), float(a + rng.randint(-60, 60)), float(b + rng.randint(-60, 60))) for i, (a, b) in enumerate((rng.randint(-20, 600), rng.randint(-20, 400)) for _ in range(300))]
    got = {(r.fid, r.k) for r in areas.touching(spark.createDataFrame(segments, "fid int, x1 double, y1 double, x2 double, y2 double"), table, "k").collect()}
    want = {
        (f, k) for f, a, b, c, d in segments for k, rs in rings.items()
        if inside(a, b, rs) or any(meets(((a, b), (c, d)), e) for r in rs for e in zip(r, r[1:] + r[:1]))
    }
    assert got == want


def test_study_area_of_thousands_of_corners(spark):
    circle = [(100 + 50 * math.cos(2 * math.pi * i / 3000), 100 + 50 * math.sin(2 * math.pi * i / 3000)) for i in range(3000)]
    df = spark.createDataFrame([(1, 100.0, 100.0), (2, 149.0, 100.0), (3, 151.0, 100.0), (4, 0.0, 0.0)], "i int, x double, y double")
    assert sorted(r.i for r in areas.points_within(df, "x", "y", [circle]).collect()) == [1, 2]


def test_segment_and_box(spark):
    rng, rows = random.Random(2), []
    for _ in range(500):
        rows.append(tuple(float(rng.randint(-6, 16)) for _ in range(4)))
    box = ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double").withColumn("hit", F.expr(G.segment_meets_box("x1", "y1", "x2", "y2", "0.0D", "0.0D", "10.0D", "10.0D")))
    for r in df.collect():
        a, b = (r.x1, r.y1), (r.x2, r.y2)
        want = all(0 <= v <= 10 for v in a) or any(meets((a, b), (box[i], box[(i + 1) % 4])) for i in range(4))
        assert r.hit == want, r
    pairs = spark.createDataFrame([(*rows[i], *rows[i + 250]) for i in range(250)], "a1 double, a2 double, a3 double, a4 double, b1 double, b2 double, b3 double, b4 double")
    named = lambda p: F.struct(*[F.col(f"{p}{i}").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 1)])
    for r in pairs.withColumns({"a": named("a"), "b": named("b")}).withColumn("hit", F.expr(G.segments_meet("a", "b"))).collect():
        assert r.hit == meets(((r.a1, r.a2), (r.a3, r.a4)), ((r.b1, r.b2), (r.b3, r.b4))), r


@pytest.mark.parametrize("k, dims", [(1, 2), (3, 3), (2, 1)])
def test_nearest_k(spark, k, dims):
    rng = random.Random(k)
    names = ["x", "y", "z"][:dims]
    spread = lambda: rng.choice([rng.uniform(0, 10), rng.uniform(0, 1000)])
    points = [(i, i % 2, *[spread() for _ in names]) for i in range(300)]
    asked = [(i, i % 2, *[rng.uniform(-500, 1500) for _ in names]) for i in range(60)]
    schema = ", ".join(f"{n} double" for n in names)
    got = {}
    for r in nearest_k(spark.createDataFrame(asked, f"q int, g int, {schema}"), spark.createDataFrame(points, f"p int, g int, {schema}"), k, "q", "p", names, by="g").collect():
        got.setdefault(r.q, []).append((r["rank"], r.p))
    for q, g, *at in asked:
        order = sorted((sum((a - b) ** 2 for a, b in zip(at, p[2:])), p[0]) for p in points if p[1] == g)
        assert [p for _, p in sorted(got[q])] == [p for _, p in order[:k]]
    assert nearest_k(spark.createDataFrame([], f"q int, {schema}"), spark.createDataFrame([], f"p int, {schema}"), k, "q", "p", names).count() == 0


def test_nearest_nodes_few_and_many(spark):
    rng = random.Random(1)
    nodes = spark.createDataFrame([(i, float(rng.randint(0, 90)), float(rng.randint(0, 90))) for i in range(200)], "node_id long, x double, y double")
    asked = spark.createDataFrame([(i, rng.uniform(-50, 150), rng.uniform(-50, 150)) for i in range(80)], "k long, px double, py double")
    assert sorted(map(tuple, network.nearest_nodes(asked, nodes, "k", "px", "py").collect())) == sorted(map(tuple, network.nearest_nodes(asked, nodes, "k", "px", "py", few=0).select("k", "node_id").collect()))


def test_numbers_within_groups(spark):
    rows = [(None if i % 5 == 0 else i % 3, i) for i in range(200)]
    got = {(r.g, r.i): r.n for r in numbered(spark.createDataFrame(rows, "g int, i int"), "n", ["g"], "i").collect()}
    for g in (None, 0, 1, 2):
        assert [got[g, i] for h, i in rows if h == g] == list(range(sum(h == g for h, _ in rows)))


def test_exact_quantiles(spark):
    values = [random.Random(3).gauss(0, 5) for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert stats.exact_quantiles(df, "v", (0.01, 0.5, 0.99, 1.0)) == pytest.approx(np.quantile(values, [0.01, 0.5, 0.99, 1.0]).tolist())
    assert stats.exact_quantiles(df.limit(0), "v", (0.5,)) == [None]


def test_disc_sums():
    grid = np.random.default_rng(0).integers(0, 5, (23, 31)).astype(float)
    for radius in (0, 1, 3, 7):
        want = np.zeros_like(grid)
        for dr in range(-radius, radius + 1):
            for dc in range(-radius, radius + 1):
                if dr * dr + dc * dc <= radius * radius:
                    for r in range(23):
                        for c in range(31):
                            if 0 <= r + dr < 23 and 0 <= c + dc < 31:
                                want[r, c] += grid[r + dr, c + dc]
        assert np.array_equal(raster.disc_sums(grid, radius), want)


def test_heat_maps_use_each_groups_parameters(spark):
    rows = [("Crosswalk", f"a{i}", float(i), 0.25, 10.0 * (i % 2), 50.0) for i in range(4)] + [("Traffic Lights", f"b{i}", float(i), 0.3, 10.0 * (i % 2), 50.0) for i in range(4)] + [("Stop Line", "c", 1.0, 0.9, 400.0, 400.0), ("Crosswalk", "alone", 9.0, 0.9, 800.0, 50.0), ("Other", "start", 1.0, 0.1, -1.0, 1.0), ("Other", "end", 1.0, 0.1, 801.0, 401.0)]
    cells, _ = raster.heat_maps(spark.createDataFrame(rows, "group string, image_id string, obj_key double, confidence double, x double, y double"))
    found = {r.group for r in cells.collect()}
    # Lights need 0.4, a lone crosswalk image goes, a lone stop line stays.
    assert found == {"Crosswalk", "Stop Line"} and cells.where("group = 'Crosswalk' AND col > 100").count() == 0


def test_columns_and_target(spark):
    df = spark.createDataFrame([(1, " a ", "yes", 1.0, "x"), (2, "", "no", None, "y"), (3, None, None, 2.0, "x")], "fid int, ground_trouth_difficulty string, flag string, n double, kind string")
    target = ml.resolve_target(df)
    assert target == "ground_trouth_difficulty" and ml.labelled(df, target).count() == 1
    assert ml.feature_columns(df, target) == (["n"], ["flag", "kind"])
    with pytest.raises(ValueError):
        ml.resolve_target(df.drop(target))
    turned = ml.boolish_to_boolean(df, ["flag", "kind"])
    assert dict(turned.dtypes)["flag"] == "boolean" and dict(turned.dtypes)["kind"] == "string"
    filled, most = ml.fill_most_frequent(df.withColumn("kind", F.when(F.col("fid") > 1, F.col("kind"))), ["kind", "flag"])
    assert most == {"kind": "x", "flag": "no"} and filled.where("kind IS NULL OR flag IS NULL").count() == 0


def blobs(spark, sizes, seed=5):
    rng, rows = random.Random(seed), []
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((len(rows), float(k), rng.gauss(4.0 * k, 1.0), rng.gauss(-3.0 * k, 1.0), rng.choice("ab") if k else "a"))
    return spark.createDataFrame(rows, "id long, label double, u double, v double, kind string")


def test_smote_rows_lie_between_neighbours(spark):
    df = blobs(spark, (60, 25, 7))
    made = ml.smote(df, "label", "id", ["u", "v"], k=3).collect()
    assert sorted((k, sum(r.label == k for r in made)) for k in (1.0, 2.0)) == [(1.0, 35), (2.0, 53)]
    rows = [(r.label, r.u, r.v) for r in df.collect()]
    for r in made[:40]:
        own = [(u, v) for k, u, v in rows if k == r.label]
        on_a_line = any(
            abs((b[0] - a[0]) * (r.v - a[1]) - (b[1] - a[1]) * (r.u - a[0])) < 1e-6 and min(a[0], b[0]) - 1e-9 <= r.u <= max(a[0], b[0]) + 1e-9
            for a in own for b in sorted(own, key=lambda p: (p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2)[1:4]
        )
        assert on_a_line


def test_models_are_fitted_chosen_saved_and_reported(spark, tmp_path):
    df = ml.stratified_holdout(blobs(spark, (90, 40, 20)), "label", "id")
    assert {(r.label, r.held_out): r.n for r in df.groupBy("label", "held_out").agg(F.count("*").alias("n")).collect()} == {(0.0, True): 18, (0.0, False): 72, (1.0, True): 8, (1.0, False): 32, (2.0, True): 4, (2.0, False): 16}
    train, held = df.where("NOT held_out"), df.where("held_out")
    bags = ml.balanced_samples(train, "label", "id", 3).groupBy("bag", "label").agg(F.count("*").alias("n")).collect()
    assert len(bags) == 9 and {r.n for r in bags} == {16}
    accuracy = lambda out: out.where("predicted = label").count() / out.count()
    forest = ml.balanced_forest(train, "label", "id", ["u", "v"], ["kind"], 3, bags=3, trees=5)
    assert accuracy(forest.predict(held)) > 0.9
    plain = ml.forest("label", ["u", "v"], ["kind"], trees=10).fit(train)
    assert accuracy(ml.predict(plain, held, 3)) > 0.9
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=["u", "v"], outputCol="features")
    boosted = ml.boosted("label", rounds=4).fit(vectors.transform(train.withColumn("weight", F.lit(1.0))))
    assert accuracy(boosted.transform(vectors.transform(held)).withColumnRenamed("prediction", "predicted")) > 0.85
    scores = {"a": {"balanced_accuracy": 0.7}, "b": {"balanced_accuracy": 0.9}, "c": {"balanced_accuracy": 0.9}}
    assert ml.best_model(scores) == "b"
    report = ml.Report("b", 150, 120, {"0": 72, "1": 32}, ["u", "v"], ["kind"], holdout={"balanced_accuracy": 0.9})
    ml.save(plain, report, f"file://{tmp_path}/run")
    again = ml.load(f"file://{tmp_path}/run")
    assert sorted(map(tuple, ml.predict(again, held, 3).select("id", "predicted").collect())) == sorted(map(tuple, ml.predict(plain, held, 3).select("id", "predicted").collect()))
    assert "balanced_accuracy: 0.9000" in "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/run/report").collect())


def test_threshold_tuning_equals_trying_every_threshold(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), *(round(float(p), 2) for p in np.random.default_rng(i).dirichlet([1, 1, 1]))) for i in range(150)]
    got = {r["class"]: (r.threshold, r.f1_macro) for r in ml.tune_thresholds(spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double"), "y", ["p0", "p1", "p2"]).collect()}
    for k in range(3):
        best = None
        for t in ml.GRID:
            called = [k if r[1 + k] >= t else int(np.argmax(r[1:])) for r in rows]
            f1 = []
            for c in sorted({r[0] for r in rows} | set(called)):
                tp = sum(a == c and r[0] == c for a, r in zip(called, rows))
                f1.append(2 * tp / (sum(r[0] == c for r in rows) + called.count(c)))
            score = round(float(np.mean(f1)), 9)
            if best is None or score > best[1]:
                best = (t, score)
        assert got[k] == pytest.approx(best)


@pytest.mark.parametrize("k", [1, 3])
def test_large_graphs_give_the_same_routes(spark, k):
    rng = random.Random(k)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(45)}
    edges = spark.createDataFrame([(i, u, v, rng.uniform(10, 90), rng.choice([None, rng.uniform(0, 100)])) for i, (u, v) in enumerate(sorted(pairs))], "fid long, u long, v long, length_m double, safety double")
    asked = spark.createDataFrame([(f"{s}-{t}", s, t, 1.0, b) for s, t, b in ((0, 9, 0.0), (3, 17, 1.0), (5, 5, 0.0), (1, 24, 3.0), (2, 99, 0.0))], "request_id string, source long, target long, alpha double, beta double")
    small, large = (sorted((r.request_id, r["rank"], round(r.total_cost, 6), tuple(r.nodes)) for r in routing.routes(asked, edges, k, broadcast_edges=n).collect()) for n in (100, 0))
    assert small == large and small


def test_summary_of_a_route_by_hand(spark):
    edges = spark.createDataFrame([(1, 0, 1, 10.0, 80.0), (2, 1, 2, 30.0, None), (3, 0, 2, 100.0, 100.0)], "fid long, u long, v long, length_m double, safety double")
    ends = spark.createDataFrame([("R1", 0, 2)], "route_id string, source long, target long")
    got = {(r.method, r.case): r for r in routing.case_examples(routing.batch({"ml": edges}, ends)).collect()}
    assert {c for _, c in got} == {"Fastest", "Balanced", "Safest", "Absolute Safest"}
    fast, safe = got["ml", "Fastest"], got["ml", "Absolute Safest"]
    assert (fast.total_length_m, fast.total_cost) == (40.0, 40.0) and fast.mean_safety == pytest.approx((80 * 10 + 50 * 30) / 40)
    assert (safe.total_length_m, safe.total_cost, safe.mean_safety) == (100.0, 0.0, 100.0)


def test_noding_overlaps_snapping_and_repeats(spark):
    schema = "fid int, x1 double, y1 double, x2 double, y2 double"
    parts = shapes.renoded(spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 4.0, 0.0, 14.0, 0.0), (3, 6.0, -3.0, 6.0, 0.0)], schema))
    assert sorted((r.fid, r.x1, r.x2) for r in parts.where("fid < 3").collect()) == [(1, 0.0, 4.0), (1, 4.0, 6.0), (1, 6.0, 10.0), (2, 4.0, 6.0), (2, 6.0, 10.0), (2, 10.0, 14.0)]
    assert sorted((r.fid, r.x1) for r in shapes.without_repeats(parts).where("fid < 3").collect()) == [(1, 0.0), (1, 4.0), (1, 6.0), (2, 10.0)]
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (9.5, 0.4), (20.0, 0.0)]), (2, [(10.0, 0.0), (10.0, 9.0)]), (3, None)], "line_id int, line array<struct<x:double,y:double>>")
    got = {r.line_id: r.line for r in shapes.snapped(lines, 1.0).collect()}
    assert [tuple(p) for p in got[1]] == [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)] and got[3] is None


def test_rings_cut_by_windows(spark):
    rng, rows = random.Random(7), []
    for i in range(60):
        cx, cy = rng.uniform(-5, 15), rng.uniform(-5, 15)
        ring = [(cx + rng.uniform(2, 8) * math.cos(a), cy + rng.uniform(2, 8) * math.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(rng.randint(3, 7)))]
        rows.append((i, ring, 0.0, 0.0, 10.0, 10.0))
    df = spark.createDataFrame([*rows, (99, None, 0.0, 0.0, 1.0, 1.0)], "i int, ring array<struct<x:double,y:double>>, xmin double, ymin double, xmax double, ymax double")
    area = F.when(F.size("clipped") > 2, F.abs(shapes.signed_area(F.col("clipped")))).otherwise(0.0)
    for r in shapes.clipped(df).withColumn("area", area).collect():
        if r.ring is None:
            assert r.clipped is None
            continue
        assert all(-1e-9 <= p.x <= 10 + 1e-9 and -1e-9 <= p.y <= 10 + 1e-9 for p in r.clipped)
        ring = [(p.x, p.y) for p in r.ring]
        if len(ring) == 3:  # convex: the share of points inside both
            n = 120
            hits = sum(inside((a + 0.5) * 10 / n, (b + 0.5) * 10 / n, [ring]) for a in range(n) for b in range(n))
            assert r.area == pytest.approx(hits * (10 / n) ** 2, abs=0.6)


def test_depth_of_boxes_and_misses(spark):
    images = spark.createDataFrame([("a", 4, 2), ("b", 4, 2), ("c", 4, 2)], "image_id string, width int, height int")
    kind = "image_id string, objects array<struct<label:int,confidence:double,x1:int,y1:int,x2:int,y2:int>>"
    det = spark.createDataFrame([("a", [(1, 0.9, -3, 0, 2, 9), (2, 0.1, 0, 0, 4, 2), (3, 0.9, 3, 1, 4, 2)]), ("b", [(1, 0.9, 0, 0, 1, 1)])], kind)
    maps = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9999.0], 4, 2)], "image_id string, values array<double>, width int, height int")
    objects, misses = depth.combine_maps(images, det, maps, min_conf=0.5, classes="thirds")
    assert [(r.label, r.x1, r.x2, r.y2, r.depth) for r in objects.collect()] == [(1, 0, 2, 2, 3.5)]
    assert tuple(misses.first()) == (3, 1, 1)


def test_tiles_boxes_and_small_helpers(spark):
    tiles = spark.createDataFrame([("i", x, y) for x in (0, 10, 20) for y in (0, 10)], "image_id string, x_off int, y_off int")
    boxes = spark.createDataFrame([("i", 12.0, 3.0, 14.0, 4.0), ("j", 1.0, 1.0, 2.0, 2.0)], "image_id string, x1 double, y1 double, x2 double, y2 double")
    assert [(r.x_off, r.y_off) for r in aerial.with_boxes(tiles, boxes, 10).collect()] == [(10, 0)]
    pixels = spark.createDataFrame([(1, [0, 0]), (2, [0, 7]), (3, [255, 255])], "t int, pixels array<int>")
    assert [r.t for r in aerial.not_empty(pixels, nodata=255).collect()] == [2]
    assert dataset.data_yaml(["Tram", "Fußweg"], "/data").splitlines() == ['path: "/data"', "train: train/images", "val: valid/images", "names:", '  0: "Tram"', '  1: "Fußweg"']
    runs = [spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2)], "b int, c int")]
    assert common_columns(runs, ["c", "b", "a"]) == ["b"]
    nested = spark.createDataFrame([(1, [(2, "x"), (3, "y")]), (4, [])], "k int, o array<struct<n:int,s:string>>")
    assert sorted(map(tuple, flattened(nested, "o").collect())) == [(1, 2, "x"), (1, 3, "y")]
    box = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0)], "x1 double, y1 double, x2 double, y2 double")
    assert tuple(box.select(*S.rescaled({c: F.col(c) for c in box.columns}, 100, 100, 250, 50).values()).first()) == (25, 10, 75, 20)
    assert spark.range(1).select(S.run_tag(F.lit("2024-05-06 07:08:09").cast("timestamp"))).first()[0] == "20240506_070809"
    assert spark.range(1).select(S.container_json(F.array(F.lit(1), F.lit(2)))).first()[0] == "[1,2]"


def test_node_table(spark):
    nodes, edges = network.node_table(spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 1.0000000001, 0.0, 1.0, 5.0)], "fid int, x1 double, y1 double, x2 double, y2 double"))
    assert sorted(map(tuple, nodes.collect())) == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 5.0)]
    assert sorted((r.fid, r.u, r.v) for r in edges.collect()) == [(1, 0, 1), (2, 1, 2)]


def test_folders_are_shared_and_deleted(spark):
    made = storage.stored(spark.range(3), "test")
    path = made.inputFiles()[0]
    assert path.startswith("file:")
    folder = storage.new_folder(spark, "other")
    assert folder.startswith(storage.shared_dir(spark))
    storage.delete_folder(spark, folder)

    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere)
