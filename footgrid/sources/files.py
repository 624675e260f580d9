"""Smaller formats: path lists, annotation and label files, arrays, GeoJSON, listings."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footgrid.functions.scalar import base_name
from footgrid.shipping import map_arrow


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; types from the schema, or looked for in the data."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, polygon) of every object of annotation documents."""
    schema = "objects array<struct<label: string, polygon: array<array<double>>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True).select(base_name(F.input_file_name()).alias("file"), "objects")
    return docs.select("file", F.explode("objects").alias("o")).select("file", "o.label", "o.polygon")


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, cls, cx, cy, w, h) of well-formed rows of five numbers; other rows are left out."""
    rows = spark.read.text(path).select(base_name(F.input_file_name()).alias("file"), F.split(F.trim("value"), r"\s+").alias("t")).where("size(t) = 5")
    v = F.transform("t", lambda x: x.try_cast("double"))
    return rows.select("file", v.alias("v")).where(F.forall("v", lambda x: x.isNotNull())).select("file", F.col("v")[0].cast("int").alias("cls"), *[F.col("v")[i].alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name) of the files of a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", base_name(F.col("path")).alias("name"))


def with_presence(df: DataFrame, key: str, **listings: DataFrame) -> DataFrame:
    """A boolean column for each listing: whether it has the row's key as a name."""
    for column, files in listings.items():
        names = files.select(F.col("name").alias(key)).distinct().withColumn("_there", F.lit(True))
        df = df.join(names, key, "left").withColumn(column, F.coalesce("_there", F.lit(False))).drop("_there")
    return df


def heatmap_catalogue(files: DataFrame, pattern: str = r"heatmap_(.+?)\.") -> DataFrame:
    group = F.regexp_extract("path", pattern, 1)
    return files.where(group != "").select(group.alias("group"), "path")


def arrays(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(path, values, shape, success) of one array of NPZ files; a corrupt file has success false."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            values, shapes, good = [], [], []
            for content in batch.column(1).to_pylist():
                try:
                    found = np.load(io.BytesIO(content), allow_pickle=False)[key]
                    values.append(found.astype(np.float64).ravel().tolist())
                    shapes.append(list(found.shape))
                    good.append(True)
                except (ValueError, KeyError, OSError, zipfile.BadZipFile):
                    values.append(None)
                    shapes.append(None)
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64())), pa.array(shapes, pa.list_(pa.int32())), pa.array(good)], ["path", "values", "shape", "success"])

    return map_arrow(files, run, "path string, values array<double>, shape array<int>, success boolean")


def detections(spark: SparkSession, path: str) -> DataFrame:
    """(path, box, conf, cls, shape, success): one row an object of detector NPZ files; a corrupt file has one row of nulls."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.list_(pa.struct([("box", pa.list_(pa.float64())), ("conf", pa.float64()), ("cls", pa.int32())]))

    def run(batches):
        for batch in batches:
            found, shapes = [], []
            for content in batch.column(1).to_pylist():
                try:
                    z = np.load(io.BytesIO(content), allow_pickle=False)
                    found.append([{"box": b, "conf": c, "cls": int(k)} for b, c, k in zip(z["xyxy"].tolist(), z["conf"].tolist(), z["cls"].tolist())])
                    shapes.append(z["shape"].tolist())
                except (ValueError, KeyError, OSError, zipfile.BadZipFile):
                    found.append(None)
                    shapes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema), pa.array(shapes, pa.list_(pa.int32()))], ["path", "objects", "shape"])

    rows = map_arrow(files, run, "path string, objects array<struct<box:array<double>,conf:double,cls:int>>, shape array<int>")
    long = rows.select("path", "shape", F.col("objects").isNotNull().alias("success"), F.explode_outer("objects").alias("o"))
    return long.select("path", "o.box", "o.conf", "o.cls", "shape", "success")


def blur_values(pixels: DataFrame) -> DataFrame:
    """(path, blur_value): variance of the five-point Laplacian of grey images (values, shape); null for images under 3x3."""

    def run(batches):
        for batch in batches:
            out = []
            for values, shape in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not values or min(shape) < 3:
                    out.append(None)
                    continue
                g = np.array(values).reshape(shape)
                out.append(float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["path", "blur_value"])

    return map_arrow(pixels.select("path", "values", "shape"), run, "path string, blur_value double")


def geojson(df: DataFrame, geometry: str, *properties: str) -> DataFrame:
    """(feature) of rows with a GeoJSON geometry struct."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_vector(df: DataFrame, path: str, layer: str = "layer") -> str:
    """Write by extension: parquet, csv, json lines, geojson lines, else a GeoPackage; returns the format used."""
    from footgrid.sources.vector_files import write_geopackage

    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind == "parquet":
        df.write.parquet(path)
    elif kind == "csv":
        df.write.csv(path, header=True)
    elif kind == "json":
        df.write.json(path)
    elif kind == "geojson":
        geojson(df, "geometry", *[c for c in df.columns if c != "geometry"]).write.text(path)
    else:
        kind = "gpkg"
        write_geopackage(df.toLocalIterator(), path if path.endswith(".gpkg") else f"{path}.gpkg", layer)
    return kind


def feature_rows(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON collections as rows: their properties (a schema) and longitude and latitude."""
    schema = f"features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<{properties}>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def feature_collection(features: DataFrame, by: str | None = None) -> DataFrame:
    """One GeoJSON collection, or one for each value of ``by``, of rows with a ``feature``; for results that fit a document."""
    grouped = features.groupBy(*([by] if by else [])).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("all"))
    return grouped.select(*([by] if by else []), F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("collection"))
