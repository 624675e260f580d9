"""Well-known binary: geometries as nested coordinate arrays and back.

``decode`` gives (kind, rings): a point is one ring of one vertex, a line one
ring, a polygon its rings, a multi geometry the rings of its parts with
``parts`` telling where each part begins.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from footgrid.shipping import map_arrow

KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
CODES = {v: k for k, v in KINDS.items()}
SINGLE = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def geometry(self):
        order = "<" if self.take("B")[0] == 1 else ">"
        (code,) = self.take(order + "I")
        if code & 0x20000000:  # an SRID follows
            self.take(order + "I")
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        dims, code = (dims if code < 1000 else {1: 3, 2: 3, 3: 4}[code // 1000]), code % 1000
        if code not in KINDS:
            raise ValueError(f"geometry type {code}")

        def points(n):
            flat = self.take(f"{order}{n * dims}d")
            return [(flat[i], flat[i + 1]) for i in range(0, n * dims, dims)]

        count = lambda: self.take(order + "I")[0]
        kind = KINDS[code]
        if kind == "Point":
            return kind, [points(1)], [0]
        if kind == "LineString":
            return kind, [points(count())], [0]
        if kind == "Polygon":
            return kind, [points(count()) for _ in range(count())], [0]
        rings, parts = [], []
        for _ in range(count()):
            parts.append(len(rings))
            rings += self.geometry()[1]
        return kind, rings, parts


def decode(data: bytes):
    """(kind, rings, parts) of a geometry; a GeoPackage header before it is skipped."""
    if data[:2] == b"GP":
        envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(data[3] >> 1) & 7]
        data = data[8 + envelope :]
    return _Reader(data).geometry()


def encode(kind: str, rings, parts=(0,)) -> bytes:
    """Little-endian, two dimensions."""
    head = struct.pack("<BI", 1, CODES[kind])

    def points(ring):
        return b"".join(struct.pack("<2d", *p) for p in ring)

    def counted(ring):
        return struct.pack("<I", len(ring)) + points(ring)

    if kind == "Point":
        return head + points(rings[0][:1])
    if kind == "LineString":
        return head + counted(rings[0])
    if kind == "Polygon":
        return head + struct.pack("<I", len(rings)) + b"".join(map(counted, rings))
    bounds = [*parts, len(rings)]
    return head + struct.pack("<I", len(parts)) + b"".join(encode(SINGLE[kind], rings[a:b]) for a, b in zip(bounds, bounds[1:]))


VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def with_geometry(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Adds kind, rings and parts decoded from a binary column; a damaged geometry gives nulls."""
    at = df.columns.index(column)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(at).to_pylist():
                try:
                    found.append(decode(data) if data else (None, None, None))
                except (ValueError, struct.error, KeyError):
                    found.append((None, None, None))
            rings = [None if r is None else [[{"x": x, "y": y} for x, y in ring] for ring in r] for _, r, _ in found]
            made = [pa.array([k for k, _, _ in found], pa.string()), pa.array(rings, pa.list_(pa.list_(VERTEX))), pa.array([p for _, _, p in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "kind", "rings", "parts"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(df, run, f"{fields}, kind string, rings array<array<struct<x:double,y:double>>>, parts array<int>")


def with_wkb(df: DataFrame, kind: str = "kind", rings: str = "rings", parts: str = "parts", name: str = "geometry") -> DataFrame:
    """Adds the binary of decoded geometries, for GeoParquet and other files."""
    at = [df.columns.index(c) for c in (kind, rings, parts)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k, r, p in zip(*(batch.column(i).to_pylist() for i in at)):
                made.append(None if k is None or r is None else encode(k, [[(v["x"], v["y"]) for v in ring] for ring in r], p or (0,)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(df, run, f"{fields}, `{name}` binary")
