"""From detections in images to objects on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footgrid.functions.scalar import not_in_or_null
from footgrid.params import BLUR_LIMIT, EXCLUDED_LABELS, EXCLUDED_Z, FIELD_OF_VIEW, IMAGE_WIDTH, Z_OFFSETS
from footgrid.schema import unique_or_raise


def blur_flags(cameras: DataFrame, limit: float = BLUR_LIMIT) -> DataFrame:
    """An image without a blur value counts as sharp."""
    return cameras.withColumn("is_blurry", F.coalesce(F.col("blur_value") < limit, F.lit(False)))


def exclude(objects: DataFrame, labels=EXCLUDED_LABELS, z=EXCLUDED_Z) -> DataFrame:
    out = objects.where(not_in_or_null(F.col("label"), labels))
    return out.where(not_in_or_null(F.col("z_class"), z)) if "z_class" in objects.columns else out


def join_cameras(objects: DataFrame, cameras: DataFrame, check: bool = True) -> DataFrame:
    """Left join on the trimmed id; an id that the cameras have twice is an error."""
    right = cameras.withColumn("id", F.trim("id"))
    right = unique_or_raise(right, "id") if check else right
    return objects.withColumn("id", F.trim("image_id")).join(right, "id", "left")


def adjusted(joined: DataFrame, width: int = IMAGE_WIDTH, fov: float = FIELD_OF_VIEW) -> DataFrame:
    """Moved positions x_adj, y_adj: panoramas and unknown images stay, others move by bearing and depth class.

    Expects x, y, is_pano, compass, bx1, bx2 and z_class.
    """
    offsets = F.create_map(*[F.lit(v) for kv in Z_OFFSETS.items() for v in kv])
    pano = F.coalesce("is_pano", F.lit(True))
    turn = F.when(F.col("bx1").isNotNull() & F.col("bx2").isNotNull(), ((F.col("bx1") + F.col("bx2")) / 2 / width - 0.5) * fov).otherwise(F.lit(0.0))
    angle = F.radians(F.col("compass") + turn)
    far = F.coalesce(F.try_element_at(offsets, F.coalesce("z_class", F.lit("unknown"))), F.lit(0.0))
    stay = pano | F.col("compass").isNull()
    return joined.withColumns({
        "x_adj": F.when(stay, F.col("x")).otherwise(F.col("x") + far * F.sin(angle)),
        "y_adj": F.when(stay, F.col("y")).otherwise(F.col("y") + far * F.cos(angle)),
    })


def displacement_stats(moved: DataFrame, digits: int = 4) -> DataFrame:
    """Statistics of the moved distance by depth class, of objects that have a camera."""
    d = F.sqrt(F.pow(F.col("x_adj") - F.col("x"), 2) + F.pow(F.col("y_adj") - F.col("y"), 2))
    return moved.where("x IS NOT NULL").withColumn("d", d).groupBy("z_class").agg(
        F.count("*").alias("n"), F.round(F.min("d"), digits).alias("min_m"), F.round(F.max("d"), digits).alias("max_m"),
        F.round(F.avg("d"), digits).alias("mean_m"), F.round(F.median("d"), digits).alias("median_m"), F.round(F.stddev_samp("d"), digits).alias("std_m"),
    )
