"""Detection data sets: boxes on tiles, label lines, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_ids(boxes: DataFrame, name: str = "class_name") -> DataFrame:
    """(class name, class_id) by the order of names."""
    return boxes.select(name).distinct().withColumn("class_id", (F.dense_rank().over(Window.orderBy(name)) - 1).cast("int"))


def on_tiles(boxes: DataFrame, tile: int) -> DataFrame:
    """Boxes (image_id, x1, y1, x2, y2 in pixels) cut to each tile they touch, normalised to it.

    Tiles come from index arithmetic, so there is no join; parts without area are left out.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.greatest(F.col(b) - 1e-9, F.col(a)) / tile).cast("int")))
    long = boxes.withColumn("tile_col", span("x1", "x2")).withColumn("tile_row", span("y1", "y2"))
    cut = long.withColumns({
        "l": F.greatest(F.col("x1"), F.col("tile_col") * tile) - F.col("tile_col") * tile, "r": F.least(F.col("x2"), (F.col("tile_col") + 1) * tile) - F.col("tile_col") * tile,
        "t": F.greatest(F.col("y1"), F.col("tile_row") * tile) - F.col("tile_row") * tile, "b": F.least(F.col("y2"), (F.col("tile_row") + 1) * tile) - F.col("tile_row") * tile,
    }).where("r > l AND b > t")
    return cut.select(
        *[c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")], "tile_col", "tile_row",
        *[F.round(v / tile, 6).alias(n) for n, v in (("cx", (F.col("l") + F.col("r")) / 2), ("cy", (F.col("t") + F.col("b")) / 2), ("w", F.col("r") - F.col("l")), ("h", F.col("b") - F.col("t")))],
    )


def label_lines(tiled: DataFrame) -> DataFrame:
    """(image_id, tile_row, tile_col, labels): one label text a tile, its lines in order."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    return tiled.groupBy("image_id", "tile_row", "tile_col").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("labels"))


def split(df: DataFrame, key: str, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds subset, train or val, by a keyed hash: a row's never changes as others come."""
    share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000
    return df.withColumn("subset", F.when(share < validation, "val").otherwise("train"))


def crops(images: DataFrame, size: int) -> DataFrame:
    """(image_id, crop_no, left, top) of the whole crops of images (image_id, width, height), numbered by row."""
    grid = images.withColumns({"_c": F.floor(F.col("width") / size).cast("int"), "_r": F.floor(F.col("height") / size).cast("int")}).where("_c > 0 AND _r > 0")
    long = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_r") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    number = (F.row_number().over(Window.partitionBy("image_id").orderBy("i", "j")) - 1).cast("long")
    return long.select("image_id", number.alias("crop_no"), (F.col("j") * size).alias("left"), (F.col("i") * size).alias("top"))


def georeferenced(predictions: DataFrame) -> DataFrame:
    """Pixel corners (corners) to map corners by the tile's affine (a, e, c, f): x = a * col + c, y = e * row + f."""
    return predictions.withColumn("corners", F.transform("corners", lambda p: F.struct((F.col("a") * p["x"] + F.col("c")).alias("x"), (F.col("e") * p["y"] + F.col("f")).alias("y"))))


def data_yaml(classes: list[str], base: str, train: str = "train/images", val: str = "valid/images") -> str:
    """The data set's description: folders and class names by id, in the order given."""
    import json

    names = [f"  {i}: {json.dumps(n, ensure_ascii=False)}" for i, n in enumerate(classes)]
    return "\n".join([f"path: {json.dumps(base, ensure_ascii=False)}", f"train: {train}", f"val: {val}", "names:", *names]) + "\n"


def with_tiles(labels: DataFrame, tiles: DataFrame, key: str = "name") -> DataFrame:
    """Label files and the raster tiles of the same base name; those without a partner go."""
    return labels.join(tiles, key)
