"""Aerial tiles, windows, predictions and hexagons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footgrid import params


def hex_index(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Axial coordinates q, r of the pointy-topped hexagon that holds a point; no geometry test."""
    fq, fr = F.sqrt(F.lit(3.0)) / 3 * F.col(x) / size - F.col(y) / (3 * size), 2 * F.col(y) / (3 * size)
    df = points.withColumns({"_fq": fq, "_fr": fr}).withColumns({"_rq": F.round("_fq"), "_rr": F.round("_fr"), "_rs": F.round(-F.col("_fq") - F.col("_fr"))})
    dq, dr, ds = F.abs(F.col("_rq") - F.col("_fq")), F.abs(F.col("_rr") - F.col("_fr")), F.abs(F.col("_rs") + F.col("_fq") + F.col("_fr"))
    fix_q = (dq > dr) & (dq > ds)
    q = F.when(fix_q, -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq"))
    r = F.when(~fix_q & (dr > ds), -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr"))
    return df.withColumns({"q": q.cast("long"), "r": r.cast("long")}).drop("_fq", "_fr", "_rq", "_rr", "_rs")


def windows(images: DataFrame, tile: int, shifts: tuple[tuple[int, int], ...] = ((0, 0),)) -> DataFrame:
    """Training windows of every image (width, height) and shift that lie wholly within it, numbered by row."""
    moved = images.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sy")) for a, b in shifts])))
    cols, rows = F.floor((F.col("width") - F.col("_s.sx")) / tile), F.floor((F.col("height") - F.col("_s.sy")) / tile)
    grid = moved.withColumns({"_cols": cols.cast("int"), "_rows": rows.cast("int")}).where("_cols > 0 AND _rows > 0")
    grid = grid.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
    return grid.select(*images.columns, F.col("_s.sx").alias("shift_x"), F.col("_s.sy").alias("shift_y"), (F.col("_c") * tile + F.col("_s.sx")).alias("x_off"), (F.col("_r") * tile + F.col("_s.sy")).alias("y_off"), (F.col("_r") * F.col("_cols") + F.col("_c")).alias("tile_no"))


def with_boxes(tiles: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """Windows (image_id, x_off, y_off) that some box (image_id, x1, y1, x2, y2 in pixels) meets, borders included.

    Boxes go to the cells of the tiles' size that they cover, windows to the four
    that they can lie in, so the two meet by an equi-key.
    """
    cell = lambda c: F.floor(c / F.lit(float(tile))).cast("long")
    span = lambda a, b: F.explode(F.sequence(cell(a), cell(b)))
    there = boxes.select("image_id", "x1", "y1", "x2", "y2").withColumn("_cx", span(F.col("x1"), F.col("x2"))).withColumn("_cy", span(F.col("y1"), F.col("y2")))
    dealt = tiles.select("image_id", "x_off", "y_off").distinct().withColumn("_cx", span(F.col("x_off"), F.col("x_off") + tile)).withColumn("_cy", span(F.col("y_off"), F.col("y_off") + tile))
    meets = "x1 <= x_off + {t} AND x2 >= x_off AND y1 <= y_off + {t} AND y2 >= y_off".format(t=tile)
    hit = dealt.join(there, ["image_id", "_cx", "_cy"]).where(meets).select("image_id", "x_off", "y_off").distinct()
    return tiles.join(hit, ["image_id", "x_off", "y_off"], "left_semi")


def not_empty(tiles: DataFrame, pixels: str = "pixels", nodata: float | None = None) -> DataFrame:
    """Tiles with a pixel that is neither 0 throughout nor no-data throughout."""
    kept = tiles.where(F.exists(pixels, lambda v: v != 0))
    return kept if nodata is None else kept.where(F.exists(pixels, lambda v: v != nodata))


def prediction_tiles(images: DataFrame, tile: int) -> DataFrame:
    """Tiles that cover every image, cut at its edges."""
    cols, rows = F.ceil(F.col("width") / tile).cast("int"), F.ceil(F.col("height") / tile).cast("int")
    grid = images.withColumn("_r", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("_c", F.explode(F.sequence(F.lit(0), cols - 1)))
    return grid.select(*images.columns, (F.col("_c") * tile).alias("x_off"), (F.col("_r") * tile).alias("y_off"), F.least(F.lit(tile), F.col("width") - F.col("_c") * tile).alias("w"), F.least(F.lit(tile), F.col("height") - F.col("_r") * tile).alias("h"))


def slices(size: Column, tile: int, overlap: float) -> Column:
    """Number of overlapping slices along one side."""
    step = max(1, int(tile * (1 - overlap)))
    return F.when(size <= tile, 1).otherwise(F.ceil((size - tile) / step) + 1).cast("long")


def slicing_estimate(images: DataFrame, tile: int, overlap: float, models: int = 1, seconds: float = params.TILE_SECONDS) -> DataFrame:
    n = slices(F.col("width"), tile, overlap) * slices(F.col("height"), tile, overlap)
    return images.withColumn("n_tiles", n).withColumn("seconds", (params.STARTUP_SECONDS + F.col("n_tiles") * seconds) * (1 + params.POST_SHARE) * models)


def tile_url(tile: Column, year: Column, resolution: Column, base: str = "https://tiles.example.org/aerial") -> Column:
    """Null if any part is."""
    every = tile.isNotNull() & year.isNotNull() & resolution.isNotNull()
    return F.when(every, F.format_string(base + "/%d/%s_%d.tif", year, tile, resolution))


def parse_prediction(line: Column) -> Column:
    """A label line of 6 (box) or 10 (four corners, then confidence) tokens as class, confidence and normalised corners; null for any other."""
    t = F.split(F.trim(line), r"\s+")
    v = F.transform(t, lambda x: x.try_cast("double"))
    cx, cy, w, h = (v[i] for i in range(1, 5))
    box = F.array(*[F.struct((cx + a * w / 2).alias("x"), (cy + b * h / 2).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    quad = F.array(*[F.struct(F.get(v, F.lit(1 + 2 * i)).alias("x"), F.get(v, F.lit(2 + 2 * i)).alias("y")) for i in range(4)])
    return F.when(F.size(t) == 6, F.struct(v[0].cast("int").alias("cls"), F.get(v, F.lit(5)).alias("conf"), box.alias("corners"))).when(
        F.size(t) == 10, F.struct(v[0].cast("int").alias("cls"), F.get(v, F.lit(9)).alias("conf"), quad.alias("corners"))
    )


def counter_clockwise(corners: Column) -> Column:
    """The ring with its points in counter-clockwise order."""
    n = F.size(corners)
    area = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda a, i: a + F.get(corners, i)["x"] * F.get(corners, (i + 1) % n)["y"] - F.get(corners, (i + 1) % n)["x"] * F.get(corners, i)["y"],
    )
    return F.when(area < 0, F.reverse(corners)).otherwise(corners)
