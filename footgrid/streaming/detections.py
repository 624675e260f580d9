"""Detections as a stream: files of objects are filtered, moved and written as they come.

The steps are the batch ones; none keeps state but the removal of objects that
were seen before, which a watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footgrid.operators import depth, geolocate

SCHEMA = "image_id string, obj_key double, label int, confidence double, depth double, bx1 int, bx2 int, seen_at timestamp"


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def located(objects: DataFrame, cameras: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """New objects with their moved positions; depth classes by fixed thresholds, as an image's quantiles need all of it."""
    fresh = objects.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["image_id", "obj_key"])
    kept = geolocate.exclude(depth.thresholds(fresh.where(F.col("confidence") >= 0.2)))
    return geolocate.adjusted(geolocate.join_cameras(kept, cameras, check=False)).select("image_id", "obj_key", "label", "z_class", "x_adj", "y_adj", "seen_at")


def counts(objects: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Objects by label and window of time."""
    return objects.withWatermark("seen_at", lateness).groupBy(F.window("seen_at", window), "label").agg(F.count("*").alias("n"))


def start(rows: DataFrame, path: str, checkpoint: str):
    """Append to Parquet until all files now there are done."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
