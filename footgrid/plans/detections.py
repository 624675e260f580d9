"""Queries on detections, depth and geolocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from footgrid import params
from footgrid.fixtures import ctes, fixture
from footgrid.functions import scalar as S
from footgrid.operators import depth, geolocate
from footgrid.tables import table

SQL: dict[str, str] = {}
_LABELS = ",".join(map(str, params.EXCLUDED_LABELS))
_NAMES = sorted(params.NAME_TO_GROUP)


def _quoted(values) -> str:
    return ",".join("'" + v.replace("'", "''") + "'" for v in values)


def edge_filter_keep_or_null(spark, d):
    seg = fixture(spark, d, "fx_seg")
    return seg.where(F.col("highway").isin(*params.HIGHWAY_KEEP) & S.keep_or_null(F.col("access"), params.ACCESS_KEEP)).select("fid", "highway", "access", F.round("length_m", 6).alias("length_m"))


SQL["edge_filter_keep_or_null"] = f"""{ctes('fx_seg')} SELECT fid, highway, access, round(length_m, 6) AS length_m FROM fx_seg
WHERE highway IN ({_quoted(params.HIGHWAY_KEEP)}) AND (access IN ({_quoted(params.ACCESS_KEEP)}) OR access IS NULL)"""


def sanitize_class_keys(spark, d):
    names = fixture(spark, d, "fx_poly").select("class_name").unionByName(table(spark, d, "part").select(F.concat(F.lit(" Größe/"), "p_name", F.lit(" Ä!")).alias("class_name")))
    return names.distinct().select("class_name", S.class_key(F.col("class_name")).alias("class_key"), S.file_key(F.col("class_name")).alias("file_key"))


SQL["sanitize_class_keys"] = f"""{ctes('fx_poly')}, n AS (SELECT class_name FROM fx_poly UNION SELECT ' Größe/' || p_name || ' Ä!' FROM part)
SELECT class_name, trim(regexp_replace(lower(replace(replace(replace(replace(replace(replace(replace(class_name,'ä','ae'),'ö','oe'),'ü','ue'),'Ä','ae'),'Ö','oe'),'Ü','ue'),'ß','ss')), '[^0-9a-z]+', '_', 'g'), '_') AS class_key,
regexp_replace(class_name, '[^0-9A-Za-z_]+', '_', 'g') AS file_key FROM n"""


def boolish_detect(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, " Yes").when(F.col("o_orderkey") % 3 == 1, "f").alias("flag"), F.col("o_orderstatus").alias("other"))
    all_bool = [F.coalesce(F.bool_and(S.boolish(F.col(c)).isNotNull() | F.col(c).isNull()), F.lit(False)).alias(f"{c}_is_bool") for c in ("flag", "other")]
    kinds = o.agg(*all_bool)
    # One row, cross-joined: the decision is made over the whole table.
    return o.crossJoin(F.broadcast(kinds)).select("o_orderkey", "flag_is_bool", "other_is_bool", F.when(F.col("flag_is_bool"), S.boolish(F.col("flag"))).alias("flag"))


SQL["boolish_detect"] = """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN 'f' END AS flag, o_orderstatus AS other FROM orders),
k AS (SELECT bool_and(lower(trim(flag)) IN ('true','t','1','yes','y','false','f','0','no','n') OR flag IS NULL) AS a, bool_and(lower(trim(other)) IN ('true','t','1','yes','y','false','f','0','no','n') OR other IS NULL) AS b FROM o)
SELECT o_orderkey, k.a AS flag_is_bool, k.b AS other_is_bool, CASE WHEN k.a THEN CASE WHEN flag IS NULL THEN NULL ELSE lower(trim(flag)) IN ('true','t','1','yes','y') END END AS flag FROM o, k"""


def lookup_group_default(spark, d):
    names = F.array(*[F.lit(x) for x in _NAMES])
    groups = F.create_map(*[F.lit(v) for kv in params.NAME_TO_GROUP.items() for v in kv])
    det = fixture(spark, d, "fx_det").withColumn("name", F.get(names, F.col("label")))
    return det.withColumn("group", F.coalesce(F.try_element_at(groups, F.coalesce("name", F.lit(""))), F.lit(params.UNMAPPED))).groupBy("group").agg(F.count("*").alias("n"))


SQL["lookup_group_default"] = f"""{ctes('fx_det')}, m(label, grp) AS (VALUES {','.join(f"({i}, '{params.NAME_TO_GROUP[n]}')" for i, n in enumerate(_NAMES))})
SELECT coalesce(grp, 'Unmapped') AS "group", count(*) AS n FROM fx_det LEFT JOIN m ON fx_det.label = m.label GROUP BY 1"""


def blur_flag_null_false(spark, d):
    return geolocate.blur_flags(fixture(spark, d, "fx_cam")).select("id", "blur_value", "is_blurry")


SQL["blur_flag_null_false"] = f"{ctes('fx_cam')} SELECT id, blur_value, coalesce(blur_value < 100, false) AS is_blurry FROM fx_cam"


def valid_image_summary(spark, d):
    cams = geolocate.blur_flags(fixture(spark, d, "fx_cam"))
    seen = fixture(spark, d, "fx_det").select(F.col("image_id").alias("id")).distinct().withColumn("seen", F.lit(True))
    images = cams.join(seen, "id", "left").withColumn("has_image", F.coalesce("seen", F.lit(False)))
    pano = F.coalesce("is_pano", F.lit(False))
    ok = F.col("has_image") & ~F.col("is_blurry") & ~pano
    return images.agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), F.count_if(~F.col("has_image")).alias("n_no_image"), F.count_if("is_blurry").alias("n_blurry"),
        F.count_if(F.col("is_pano").isNull()).alias("n_pano_unknown"), F.count_if(F.col("blur_value").isNull()).alias("n_blur_unknown"),
    )


SQL["valid_image_summary"] = f"""{ctes('fx_cam', 'fx_det')}, s AS (SELECT DISTINCT image_id FROM fx_det),
i AS (SELECT fx_cam.*, s.image_id IS NOT NULL AS has_image, coalesce(blur_value < 100, false) AS is_blurry FROM fx_cam LEFT JOIN s ON id = image_id)
SELECT count(*) AS n, count(*) FILTER (has_image AND NOT is_blurry AND NOT coalesce(is_pano, false)) AS n_valid, count(*) FILTER (NOT has_image) AS n_no_image, count(*) FILTER (is_blurry) AS n_blurry,
count(*) FILTER (is_pano IS NULL) AS n_pano_unknown, count(*) FILTER (blur_value IS NULL) AS n_blur_unknown FROM i"""


def exclude_labels_null_safe(spark, d):
    return geolocate.exclude(fixture(spark, d, "fx_det")).groupBy("label").agg(F.count("*").alias("n"))


SQL["exclude_labels_null_safe"] = f"{ctes('fx_det')} SELECT label, count(*) AS n FROM fx_det WHERE label IS NULL OR label NOT IN ({_LABELS}) GROUP BY label"


def anti_resume(spark, d):
    done = fixture(spark, d, "fx_cam").select(F.col("id").alias("image_id"))
    return fixture(spark, d, "fx_det").join(done, "image_id", "left_anti").groupBy("image_id").agg(F.count("*").alias("n"))


SQL["anti_resume"] = f"{ctes('fx_cam', 'fx_det')} SELECT image_id, count(*) AS n FROM fx_det WHERE NOT EXISTS (SELECT 1 FROM fx_cam WHERE id = image_id) GROUP BY image_id"


def depth_thirds(spark, d):
    return depth.thirds(fixture(spark, d, "fx_det"), "image_id", "depth", "obj_key").select("image_id", "obj_key", "z_class")


SQL["depth_thirds"] = f"""{ctes('fx_det')}, r AS (SELECT image_id, obj_key, row_number() OVER (PARTITION BY image_id ORDER BY depth, obj_key) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM fx_det)
SELECT image_id, obj_key, CASE WHEN i < n / 3.0e0 THEN 'near' WHEN i < 2 * n / 3.0e0 THEN 'medium' ELSE 'far' END AS z_class FROM r"""


def depth_quantile(spark, d):
    return depth.quantiles(fixture(spark, d, "fx_det")).select("image_id", "obj_key", "z_class")


_QUANTILE = """q AS (SELECT image_id AS qid, quantile_cont(depth, 0.25) AS q1, quantile_cont(depth, 0.5) AS q2, quantile_cont(depth, 0.75) AS q3 FROM fx_det GROUP BY image_id),
z AS (SELECT fx_det.*, CASE WHEN depth <= q1 THEN 'very near' WHEN depth <= q2 THEN 'near' WHEN depth <= q3 THEN 'medium' ELSE 'far' END AS z_class FROM fx_det JOIN q ON image_id = qid)"""
SQL["depth_quantile"] = f"{ctes('fx_det')}, {_QUANTILE} SELECT image_id, obj_key, z_class FROM z"


def depth_thresholds(spark, d):
    return depth.thresholds(fixture(spark, d, "fx_det")).groupBy("z_class").agg(F.count("*").alias("n"), F.round(F.avg("depth"), 6).alias("mean_depth"))


SQL["depth_thresholds"] = f"{ctes('fx_det')} SELECT CASE WHEN depth < 5 THEN 'near' WHEN depth < 15 THEN 'medium' ELSE 'far' END AS z_class, count(*) AS n, round(avg(depth), 6) AS mean_depth FROM fx_det GROUP BY 1"


def depth_region_stats(spark, d):
    region = F.transform(F.col("embedding"), lambda v: F.when(v < -0.1, F.lit(9999.0)).otherwise(F.round(v.cast("double"), 4)))
    e = table(spark, d, "embeddings").select("vec_id", region.alias("r"))
    return e.select("vec_id", *[F.round(depth.region_depth(F.col("r"), m, width=8), 6).alias(m) for m in depth.METHODS])


SQL["depth_region_stats"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v < CAST(-0.1 AS DOUBLE) THEN 9999.0e0 ELSE round(CAST(v AS DOUBLE), 4) END) AS r FROM embeddings),
f AS (SELECT vec_id, r, list_filter(r, lambda v: v < 9999) AS v FROM e)
SELECT vec_id, round(list_median(v), 6) AS median, round(list_avg(v), 6) AS mean, round((list_min(v) + list_max(v)) / 2, 6) AS minmax_avg, round(CASE WHEN r[37] < 9999 THEN r[37] END, 6) AS center FROM f"""


def many_to_one_join(spark, d):
    cams = fixture(spark, d, "fx_cam").select("id", "is_pano", "compass")
    joined = geolocate.join_cameras(fixture(spark, d, "fx_det").select("image_id", "obj_key"), cams)
    return joined.groupBy("is_pano").agg(F.count("*").alias("n"), F.count("compass").alias("n_compass"))


SQL["many_to_one_join"] = f"{ctes('fx_det', 'fx_cam')} SELECT is_pano, count(*) AS n, count(compass) AS n_compass FROM fx_det LEFT JOIN fx_cam ON image_id = id GROUP BY is_pano"


def _moved(spark, d):
    objects = depth.quantiles(fixture(spark, d, "fx_det").drop("x", "y"))
    return geolocate.adjusted(geolocate.join_cameras(geolocate.exclude(objects), fixture(spark, d, "fx_cam"), check=False))


def geolocate_adjust(spark, d):
    return _moved(spark, d).select("image_id", "obj_key", "z_class", F.round("x_adj", 3).alias("x_adj"), F.round("y_adj", 3).alias("y_adj"))


_MOVED = f"""{ctes('fx_det', 'fx_cam')}, {_QUANTILE},
k AS (SELECT image_id, obj_key, z_class, bx1, bx2 FROM z WHERE (label IS NULL OR label NOT IN ({_LABELS})) AND z_class <> 'far'),
o AS (SELECT k.*, c.x, c.y, c.compass, coalesce(c.is_pano, true) OR c.compass IS NULL AS stay, radians(c.compass + ((bx1 + bx2) / 2.0e0 / 1024 - 0.5e0) * 90) AS a,
      CASE z_class WHEN 'very near' THEN 5.0e0 WHEN 'near' THEN 7.5e0 ELSE 20.0e0 END AS far FROM k LEFT JOIN fx_cam c ON image_id = id),
m AS (SELECT *, CASE WHEN stay THEN x ELSE x + far * sin(a) END AS x_adj, CASE WHEN stay THEN y ELSE y + far * cos(a) END AS y_adj FROM o)"""
SQL["geolocate_adjust"] = f"{_MOVED} SELECT image_id, obj_key, z_class, round(x_adj, 3) AS x_adj, round(y_adj, 3) AS y_adj FROM m"


def displacement_stats(spark, d):
    return geolocate.displacement_stats(_moved(spark, d))


SQL["displacement_stats"] = f"""{_MOVED}, t AS (SELECT z_class, sqrt((x_adj-x)*(x_adj-x)+(y_adj-y)*(y_adj-y)) AS dd FROM m WHERE x IS NOT NULL)
SELECT z_class, count(*) AS n, round(min(dd), 4) AS min_m, round(max(dd), 4) AS max_m, round(avg(dd), 4) AS mean_m, round(median(dd), 4) AS median_m, round(stddev_samp(dd), 4) AS std_m FROM t GROUP BY z_class"""


def bbox_clamp(spark, d):
    det = fixture(spark, d, "fx_det")
    b = S.box_clamp({"x1": F.col("bx1") - 100.7, "y1": F.col("by1"), "x2": F.col("bx2") + 0.9, "y2": F.col("by2")}, 640, 200)
    return det.select("image_id", "obj_key", *[v.alias(k) for k, v in b.items()], ((b["x1"] + b["x2"]) / 2).alias("centre_x"))


SQL["bbox_clamp"] = f"""{ctes('fx_det')}, b AS (SELECT image_id, obj_key, greatest(0, least(CAST(trunc(bx1 - 100.7e0) AS INTEGER), 640)) AS x1, greatest(0, least(by1, 200)) AS y1,
greatest(0, least(CAST(trunc(bx2 + 0.9e0) AS INTEGER), 640)) AS x2, greatest(0, least(by2, 200)) AS y2 FROM fx_det) SELECT *, (x1 + x2) / 2.0e0 AS centre_x FROM b"""


def yolo_to_xyxy(spark, d):
    det = fixture(spark, d, "fx_det")
    c = S.to_centre(F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2"), 1024, 512)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.coalesce("label", F.lit(-1)), c["cx"], c["cy"], c["w"], c["h"])
    parts = F.split(line, " ")
    back = S.from_centre(*[parts[i].cast("double") for i in range(1, 5)], 1024, 512)
    return det.select("image_id", "obj_key", *[F.round(v, 2).alias(k) for k, v in back.items()])


SQL["yolo_to_xyxy"] = f"{ctes('fx_det')} SELECT image_id, obj_key, CAST(bx1 AS DOUBLE) AS x1, CAST(by1 AS DOUBLE) AS y1, CAST(bx2 AS DOUBLE) AS x2, CAST(by2 AS DOUBLE) AS y2 FROM fx_det"


def affine_pixel_to_map(spark, d):
    return fixture(spark, d, "fx_det").select("image_id", "obj_key", (F.lit(2680000.0) + 0.1 * (F.col("bx1") + 0.5)).alias("mx"), (F.lit(1250000.0) - 0.1 * (F.col("by1") + 0.5)).alias("my")).select("image_id", "obj_key", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"))


SQL["affine_pixel_to_map"] = f"{ctes('fx_det')} SELECT image_id, obj_key, round(2680000.0e0 + 0.1e0 * (bx1 + 0.5e0), 4) AS mx, round(1250000.0e0 - 0.1e0 * (by1 + 0.5e0), 4) AS my FROM fx_det"


def detection_stats(spark, d):
    p = fixture(spark, d, "fx_poly")
    return p.groupBy("class_name").agg(F.count("*").alias("n"), *[F.round(f("confidence"), 6).alias(k) for k, f in (("min_conf", F.min), ("max_conf", F.max), ("mean_conf", F.avg), ("median_conf", F.median), ("std_conf", F.stddev_samp))])


SQL["detection_stats"] = f"""{ctes('fx_poly')} SELECT class_name, count(*) AS n, round(min(confidence), 6) AS min_conf, round(max(confidence), 6) AS max_conf, round(avg(confidence), 6) AS mean_conf,
round(median(confidence), 6) AS median_conf, round(stddev_samp(confidence), 6) AS std_conf FROM fx_poly GROUP BY class_name"""


def class_model_crosstab(spark, d):
    return fixture(spark, d, "fx_poly").groupBy("class_name").pivot("model_name", ["M1", "M2", "M3"]).agg(F.count(F.lit(1))).fillna(0)


SQL["class_model_crosstab"] = f"""{ctes('fx_poly')} SELECT class_name, count(*) FILTER (model_name = 'M1') AS "M1", count(*) FILTER (model_name = 'M2') AS "M2", count(*) FILTER (model_name = 'M3') AS "M3" FROM fx_poly GROUP BY class_name"""


def top_n_classes(spark, d):
    return fixture(spark, d, "fx_det").where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(20)


SQL["top_n_classes"] = f"{ctes('fx_det')} SELECT label, count(*) AS n FROM fx_det WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT 20"


def images_per_year(spark, d):
    return fixture(spark, d, "fx_cam").where("captured_at >= TIMESTAMP_NTZ '1993-01-01 00:00:00'").groupBy(F.year("captured_at").cast("long").alias("year")).agg(F.count("*").alias("n"))


SQL["images_per_year"] = f"{ctes('fx_cam')} SELECT CAST(year(captured_at) AS BIGINT) AS year, count(*) AS n FROM fx_cam WHERE captured_at >= TIMESTAMP '1993-01-01 00:00:00' GROUP BY 1"


def curve_first_last(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first_value"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


SQL["curve_first_last"] = "SELECT event_type, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY event_type"


def json_geometry_parse(spark, d):
    e = table(spark, d, "events").where("event_id % 3 < 2 OR event_id > 0")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{'type': 'Point', 'coordinates': ["), F.col("event_id"), F.lit(", 47.5]}"))).when(F.col("event_id") % 3 == 1, F.lit("not a geometry")).otherwise(F.concat(F.lit('{"type": "Point", "coordinates": [8.5, '), F.col("event_id"), F.lit("]}")))
    g = S.geometry_json(text)
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", k.alias("k"), g["coordinates"][0].alias("lon"), g["coordinates"][1].alias("lat"))


SQL["json_geometry_parse"] = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 2 THEN 8.5e0 END AS lon,
CASE event_id % 3 WHEN 0 THEN 47.5e0 WHEN 2 THEN CAST(event_id AS DOUBLE) END AS lat FROM events"""


def union_ragged(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_acctbal")
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_mktsegment")
    return s.unionByName(c, allowMissingColumns=True)


SQL["union_ragged"] = "SELECT s_name AS name, s_acctbal, NULL AS c_mktsegment FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer"


def random_sample_hash(spark, d):
    """A sampling operator: the 100 rows of least keyed hash."""
    keyed = F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string")).cast("binary"))
    return table(spark, d, "orders").orderBy(keyed, "o_orderkey").limit(100).select("o_orderkey")


SQL["random_sample_hash"] = "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100"


def depth_objects(spark, d):
    """Detections, depth maps and images by key: objects with depth and class, from arrays."""
    from footgrid.operators import depth

    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    images = orders.select("image_id", F.lit(16).alias("width"), F.lit(12).alias("height"))
    det = table(spark, d, "lineitem").where("l_orderkey % 11 > 0").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").cast("int").alias("label"), F.col("l_discount").alias("confidence"), (F.col("l_linenumber") - 2).cast("int").alias("x1"), (F.col("l_linenumber") - 1).cast("int").alias("y1"),
        (F.col("l_linenumber") + 3 + F.col("l_partkey") % 9).cast("int").alias("x2"), (F.col("l_linenumber") + 2 + F.col("l_partkey") % 7).cast("int").alias("y2"),
    ))).alias("objects"))
    # Every third map has half the size; maps of every seventh image are missing.
    small = F.col("image_id") % 3 == 0
    w, h = F.when(small, 8).otherwise(16), F.when(small, 6).otherwise(12)
    value = lambda i: F.when((i + F.col("image_id")) % 13 == 0, 9999.0).otherwise(((i * 7 + F.col("image_id")) % 50).cast("double"))
    maps = orders.where("image_id % 7 > 0").select("image_id", w.alias("width"), h.alias("height"), F.transform(F.sequence(F.lit(0), w * h - 1), value).alias("values"))
    objects, _ = depth.combine_maps(images, det, maps, min_conf=0.02)
    return objects.select("image_id", "object_no", "label", "x1", "y1", "x2", "y2", F.round("depth", 6).alias("depth"), "z_class")


SQL["depth_objects"] = """WITH b AS (SELECT l_orderkey AS image_id, l_linenumber AS label, l_discount AS confidence, l_linenumber - 2 AS x1, l_linenumber - 1 AS y1, l_linenumber + 3 + l_partkey % 9 AS x2, l_linenumber + 2 + l_partkey % 7 AS y2 FROM lineitem WHERE l_orderkey % 11 > 0 AND l_orderkey % 7 > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label, confidence, x1, y1, x2, y2) - 1 AS object_no FROM b),
c AS (SELECT image_id, object_no, label, least(greatest(x1, 0), 15) AS x1, least(greatest(y1, 0), 11) AS y1, least(greatest(x2, 0), 16) AS x2, least(greatest(y2, 0), 12) AS y2 FROM n WHERE confidence >= 0.02e0 AND image_id IN (SELECT o_orderkey FROM orders)),
px AS (SELECT *, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y FROM c), py AS (SELECT *, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM px),
pi AS (SELECT *, CASE WHEN image_id % 3 = 0 THEN (y // 2) * 8 + x // 2 ELSE y * 16 + x END AS i FROM py),
dv AS (SELECT image_id, object_no, label, x1, y1, x2, y2, median((i * 7 + image_id) % 50) AS depth FROM pi WHERE (i + image_id) % 13 <> 0 GROUP BY ALL),
q AS (SELECT image_id, quantile_cont(depth, 0.25) AS a, quantile_cont(depth, 0.5) AS b, quantile_cont(depth, 0.75) AS c FROM dv GROUP BY image_id)
SELECT dv.image_id, CAST(object_no AS INTEGER) AS object_no, CAST(label AS INTEGER) AS label, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, round(depth, 6) AS depth,
CASE WHEN depth <= a THEN 'very near' WHEN depth <= b THEN 'near' WHEN depth <= c THEN 'medium' ELSE 'far' END AS z_class FROM dv JOIN q ON q.image_id = dv.image_id"""


def depth_misses(spark, d):
    """How many images lack detections or a depth map."""
    from footgrid.operators import depth

    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    images = orders.select("image_id", F.lit(1).alias("width"), F.lit(1).alias("height"))
    det = orders.where("image_id % 11 > 0").withColumn("objects", F.array().cast("array<struct<label:int,confidence:double,x1:int,y1:int,x2:int,y2:int>>"))
    maps = orders.where("image_id % 7 > 0").select("image_id", F.lit(1).alias("width"), F.lit(1).alias("height"), F.array(F.lit(1.0)).alias("values"))
    return depth.combine_maps(images, det, maps)[1]


SQL["depth_misses"] = "SELECT count(*) AS images, count(*) FILTER (o_orderkey % 11 = 0) AS missing_detections, count(*) FILTER (o_orderkey % 11 > 0 AND o_orderkey % 7 = 0) AS missing_depth FROM orders"


def dense_class_ids(spark, d):
    from pyspark.sql import Window

    names = table(spark, d, "part").select("p_type").distinct()
    return names.select("p_type", (F.dense_rank().over(Window.orderBy("p_type")) - 1).cast("long").alias("class_id"))


SQL["dense_class_ids"] = "SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS class_id FROM (SELECT DISTINCT p_type FROM part)"
