"""Depth maps and depth classes of detections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footgrid.functions.scalar import box_clamp
from footgrid.params import DEPTH_INVALID
from footgrid.shipping import map_arrow

METHODS = ("median", "mean", "minmax_avg", "center")


def region_depth(values: Column, method: str = "median", sentinel: float = DEPTH_INVALID, width: int | None = None) -> Column:
    """A masked region's depth; values from the sentinel on are invalid (half precision may round it up). Null if none is valid.

    ``center`` takes the middle value of a row-major region of ``width`` columns.
    """
    valid = F.filter(values, lambda v: v.isNotNull() & (v < sentinel))
    n = F.size(valid)
    if method == "median":
        ordered = F.sort_array(valid)
        value = (F.try_element_at(ordered, F.floor((n - 1) / 2).cast("int") + 1) + F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2
    elif method == "mean":
        value = F.aggregate(valid, F.lit(0.0), lambda a, v: a + v) / n
    elif method == "minmax_avg":
        value = (F.array_min(valid) + F.array_max(valid)) / 2
    elif method == "center":
        w = F.lit(width) if width else F.nullif(F.sqrt(F.size(values)).cast("int"), F.lit(0))  # an empty region has none
        rows = F.floor(F.size(values) / w).cast("int")
        middle = F.try_element_at(values, (F.floor(rows / 2) * w + F.floor(w / 2)).cast("int") + 1)
        return F.when(middle < sentinel, middle.cast("double"))
    else:
        raise ValueError(f"unknown method {method}")
    return F.when(n > 0, value.cast("double"))


def inverted(values: Column, sentinel: float = DEPTH_INVALID) -> Column:
    """Disparity to depth order: below 1 is invalid, the rest is mirrored between its extremes; null if nothing is valid."""
    positive = F.transform(values, lambda v: F.greatest(v, F.lit(0.0)))
    valid = F.filter(positive, lambda v: v >= 1)
    low, high = F.array_min(valid), F.array_max(valid)
    return F.when(F.size(valid) > 0, F.transform(positive, lambda v: F.when(v < 1, F.lit(float(sentinel))).otherwise(high - (v - low))))


def thirds(df: DataFrame, image: str = "image_id", depth: str = "depth", *tie: str) -> DataFrame:
    """near / medium / far by position in the image's depth order."""
    w = Window.partitionBy(image)
    at, n = F.row_number().over(w.orderBy(depth, *tie)) - 1, F.count("*").over(w)
    return df.withColumn("z_class", F.when(at < n / 3, "near").when(at < 2 * n / 3, "medium").otherwise("far"))


def quantiles(df: DataFrame, image: str = "image_id", depth: str = "depth") -> DataFrame:
    """very near / near / medium / far by the image's quartiles."""
    q = F.percentile(depth, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(Window.partitionBy(image))
    d = F.col(depth)
    out = df.withColumn("_q", q)
    return out.withColumn("z_class", F.when(d <= F.col("_q")[0], "very near").when(d <= F.col("_q")[1], "near").when(d <= F.col("_q")[2], "medium").otherwise("far")).drop("_q")


def thresholds(df: DataFrame, depth: str = "depth", limits: tuple[float, ...] = (5.0, 15.0, 30.0)) -> DataFrame:
    """near / medium / far; only the first two limits count."""
    d = F.col(depth)
    return df.withColumn("z_class", F.when(d < limits[0], "near").when(d < limits[1], "medium").otherwise("far"))


def combine(detections: DataFrame, min_conf: float = 0.2, method: str = "quantile") -> DataFrame:
    """Objects with depth and class: boxes below confidence or without depth go before classes are formed."""
    kept = detections.where((F.col("confidence") >= min_conf) & F.col("depth").isNotNull())
    return {"quantile": quantiles, "thirds": thirds}[method](kept) if method != "thresholds" else thresholds(kept)


def region(values: Column, width: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The values of a row-major array of ``width`` columns within a box of whole pixels, right and lower borders left out."""
    none = F.array().cast("array<double>")
    rows = F.transform(F.sequence(y1, y2 - 1), lambda y: F.slice(values, y * width + x1 + 1, x2 - x1))
    return F.when((x2 > x1) & (y2 > y1), F.flatten(rows)).otherwise(none)


#: Pixels that are gathered at once.
PIXELS = 1_000_000


def _box_depths(batches, method: str, sentinel: float = DEPTH_INVALID):
    """image_id, _boxes and the depth of each box: ``region_depth`` of what each box holds of its image's map, resized by nearest neighbours."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    for batch in batches:
        lists, maps = batch.column("_boxes"), batch.column("_values")
        flat = lists.flatten()
        x1, y1, x2, y2 = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("x1", "y1", "x2", "y2"))
        image = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        width, height, w, h = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("width", "height", "_w", "_h"))
        values, start = maps.flatten().to_numpy(zero_copy_only=False), maps.offsets.to_numpy().astype(np.int64)
        start, length = start[:-1] - start[0], np.diff(start)
        wide, tall = np.maximum(x2 - x1, 0), np.maximum(y2 - y1, 0)
        size = np.where((wide > 0) & (tall > 0), wide * tall, 0)
        if method == "center":  # only the middle one of the region, as if it were square
            side = np.floor(np.sqrt(size)).astype(np.int64)
            middle = np.where(size > 0, (size // np.maximum(side, 1) // 2) * side + side // 2, 0)
            take = (size > 0).astype(np.int64)
        else:
            middle, take = np.zeros_like(size), size
        depths = np.full(len(size), np.nan)
        ends = np.cumsum(take)
        first = 0
        while first < len(take):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIXELS, "right")))
            box = np.repeat(np.arange(first, last), take[first:last])
            k = np.arange(len(box)) - np.repeat(np.cumsum(take[first:last]) - take[first:last], take[first:last]) + middle[box]
            i = image[box]
            x, y = x1[box] + k % wide[box], y1[box] + k // wide[box]
            same = (w[i] == width[i]) & (h[i] == height[i])
            row = np.where(same, y, np.floor((y + 0.5) * h[i] / height[i]).astype(np.int64))
            col = np.where(same, x, np.floor((x + 0.5) * w[i] / width[i]).astype(np.int64))
            at = row * w[i] + col
            held = (at >= 0) & (at < length[i])
            v, box = values[start[i[held]] + at[held]], box[held]
            valid = v < sentinel  # a null is NaN here
            v, box = v[valid], box[valid] - first
            n = np.bincount(box, minlength=last - first)
            some, from_ = np.flatnonzero(n), np.cumsum(n) - n
            if method == "mean":
                depths[first + some] = np.bincount(box, weights=v, minlength=last - first)[some] / n[some]
            else:
                v, lo, m = v[np.lexsort((v, box))], from_[some], n[some]
                pair = (lo, lo + m - 1) if method == "minmax_avg" else (lo + (m - 1) // 2, lo + m // 2)
                depths[first + some] = (v[pair[0]] + v[pair[1]]) / 2
            first = last
        made = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32()), pa.array(depths, mask=np.isnan(depths)))
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), lists, made], ["image_id", "_boxes", "_depths"])


def combine_maps(images: DataFrame, detections: DataFrame, maps: DataFrame, min_conf: float = 0.0, method: str = "median", classes: str = "quantile") -> tuple[DataFrame, DataFrame]:
    """(objects, misses) of images (image_id, width, height), detections (image_id, objects) and depth maps (image_id, values, width, height).

    objects: array of (label, confidence, x1, y1, x2, y2). An image without
    detections or without a depth map is a miss; depth maps of another size are
    resized by nearest neighbours; boxes become whole pixels within the image;
    those without a valid depth go. misses: one row of counts.
    """
    depths = maps.select("image_id", F.col("values").alias("_values"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    # Spark takes an array for one value when it estimates sizes, and would broadcast maps that fill the driver.
    joined = images.join(detections.select("image_id", "objects").hint("merge"), "image_id", "left").join(depths.hint("merge"), "image_id", "left")
    misses = joined.agg(
        F.count("*").alias("images"), F.count_if(F.col("objects").isNull()).alias("missing_detections"),
        F.count_if(F.col("objects").isNotNull() & F.col("_values").isNull()).alias("missing_depth"),
    )
    both = joined.where("objects IS NOT NULL AND _values IS NOT NULL")
    width, height = F.col("width"), F.col("height")

    def box(o, at):
        corners = box_clamp({n: o[n] for n in ("x1", "y1", "x2", "y2")}, width, height)
        corners |= {"x1": F.least(corners["x1"], width - 1), "y1": F.least(corners["y1"], height - 1)}
        return F.struct(at.alias("object_no"), o["label"].alias("label"), o["confidence"].alias("confidence"), *[F.when(o[n].isNotNull(), c).alias(n) for n, c in corners.items()])

    # A map meets all boxes of its image at once: it is neither copied for each of them nor resized where no box looks.
    usable = lambda b: (b["confidence"] >= min_conf) & b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull()
    held = both.withColumn("_boxes", F.filter(F.transform("objects", box), usable)).where("size(_boxes) > 0 AND width > 0 AND height > 0 AND _w IS NOT NULL AND _h IS NOT NULL")
    held = held.select("image_id", "_boxes", "width", "height", F.col("_values").cast("array<double>"), "_w", "_h")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select("image_id", "_boxes").schema)
    made = map_arrow(held, lambda batches: _box_depths(batches, method), f"{kinds}, _depths array<double>")
    deep = made.select("image_id", F.explode(F.arrays_zip("_boxes", "_depths")).alias("z")).select("image_id", "z._boxes.*", F.col("z._depths").alias("depth"))
    return combine(deep, min_conf, classes), misses
