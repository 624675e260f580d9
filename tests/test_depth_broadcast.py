"""Depth maps are large beside what Spark estimates of them."""

import __spark_entry__
from footgrid.operators import depth


def test_depth_maps_are_never_broadcast(spark, tiny):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    plan = __spark_entry__.queries()["depth_objects"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_misses_count_images_without_maps(spark):
    images = spark.range(4).selectExpr("id AS image_id", "2 AS width", "2 AS height")
    det = images.where("image_id > 0").selectExpr("image_id", "CAST(array() AS array<struct<label:int,confidence:double,x1:int,y1:int,x2:int,y2:int>>) AS objects")
    maps = images.where("image_id > 1").selectExpr("image_id", "array(1.0D) AS values", "1 AS width", "1 AS height")
    misses = depth.combine_maps(images, det, maps)[1]
    assert misses.first().asDict() == {"images": 4, "missing_detections": 1, "missing_depth": 1}
    assert "BroadcastHashJoin" not in misses._jdf.queryExecution().executedPlan().toString()
