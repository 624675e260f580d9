"""GeoPackage and shapefile readers as Spark data sources, and a GeoPackage writer.

    spark.dataSource.register(GeoPackage)
    spark.read.format("geopackage").option("path", file).option("layer", name).load()
    spark.read.format("shapefile").option("path", file).load()

Both read in partitions of row ranges, so a large layer spreads over tasks; the
files must be where every executor can open them. Geometries are well-known
binary (see ``wkb``).
"""

from __future__ import annotations

import sqlite3
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from footgrid.sources import wkb

ROWS = 50_000
_TYPES = {"INTEGER": "bigint", "INT": "bigint", "MEDIUMINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "BOOLEAN": "boolean", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _layer(connection, wanted: str | None) -> tuple[str, str]:
    rows = connection.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
    for name, column in rows:
        if wanted in (None, name):
            return name, column
    raise ValueError(f"no layer {wanted!r}; there are {[r[0] for r in rows]}")


class GeoPackage(DataSource):
    @classmethod
    def name(cls):
        return "geopackage"

    def _open(self):
        return sqlite3.connect(f"file:{self.options['path'].removeprefix('file://')}?mode=ro", uri=True)

    def _columns(self):
        with self._open() as c:
            layer, geometry = _layer(c, self.options.get("layer"))
            info = c.execute(f'PRAGMA table_info("{layer}")').fetchall()
        wanted = [x.strip() for x in self.options.get("columns", "").split(",") if x.strip()]
        kept = [(r[1], r[2].split("(")[0].upper()) for r in info if not wanted or r[1] in wanted or r[1] == geometry]
        return layer, geometry, kept

    def schema(self):
        _, geometry, columns = self._columns()
        return ", ".join(f"`{n}` {'binary' if n == geometry else _TYPES.get(t, 'string')}" for n, t in columns)

    def reader(self, schema):
        return _GeoPackageReader(self, [f.name for f in schema.fields])


class _GeoPackageReader(DataSourceReader):
    def __init__(self, source: GeoPackage, columns: list[str]):
        self.source, self.columns = source, columns
        self.layer, self.geometry, kinds = source._columns()
        self.booleans = {n for n, t in kinds if t == "BOOLEAN"}
        self.limit = int(source.options.get("limit", 0)) or None

    def partitions(self):
        with self.source._open() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.layer}"').fetchone()
        if low is None:
            return [Range(0, 0)]
        if self.limit:
            return [Range(low, high + 1)]
        return [Range(a, min(a + ROWS, high + 1)) for a in range(low, high + 1, ROWS)]

    def read(self, part):
        names = ", ".join(f'"{n}"' for n in self.columns)
        tail = f" LIMIT {self.limit}" if self.limit else ""
        with self.source._open() as c:
            for row in c.execute(f'SELECT {names} FROM "{self.layer}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid{tail}', (part.start, part.end)):
                yield tuple(self._value(n, v) for n, v in zip(self.columns, row))

    def _value(self, name, value):
        if value is None:
            return None
        if name == self.geometry:
            return bytearray(wkb.encode(*wkb.decode(value)))
        return bool(value) if name in self.booleans else value


def write_geopackage(rows, path: str, layer: str, srid: int = 2056) -> int:
    """Write (geometry as well-known binary, attributes) rows, an iterator such as ``df.toLocalIterator()``, as one layer."""
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
        c.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
        n, names = 0, None
        for row in rows:
            data = row.asDict()
            if names is None:
                names = [k for k in data if k != "geometry"]
                kinds = {k: "REAL" if isinstance(data[k], float) else "INTEGER" if isinstance(data[k], int) else "TEXT" for k in names}
                c.execute(f'DROP TABLE IF EXISTS "{layer}"')
                c.execute(f'CREATE TABLE "{layer}" (geometry BLOB, {", ".join(f"{chr(34)}{k}{chr(34)} {kinds[k]}" for k in names)})')
                c.execute("INSERT OR REPLACE INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srid))
                c.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (layer,))
                c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geometry', 'GEOMETRY', ?, 0, 0)", (layer, srid))
            head = b"GP" + bytes([0, 1]) + struct.pack("<i", srid)
            c.execute(f'INSERT INTO "{layer}" VALUES ({", ".join("?" * (len(names) + 1))})', (head + bytes(data["geometry"]), *(data[k] for k in names)))
            n += 1
    return n


class Shapefile(DataSource):
    """Records of a .shp with the attributes of the .dbf beside it."""

    @classmethod
    def name(cls):
        return "shapefile"

    def _base(self):
        return self.options["path"].removeprefix("file://").removesuffix(".shp")

    def fields(self):
        with open(self._base() + ".dbf", "rb") as f:
            head = f.read(32)
            count, head_size, row_size = struct.unpack("<IHH", head[4:12])
            out = []
            while (first := f.read(1)) not in (b"\r", b""):
                raw = first + f.read(31)
                out.append((raw[:11].split(b"\0")[0].decode("latin-1"), chr(raw[11]), raw[16], raw[17]))
        return count, head_size, row_size, out

    def schema(self):
        kinds = {"N": lambda d: "double" if d else "bigint", "F": lambda d: "double", "L": lambda d: "boolean"}
        return ", ".join(["`geometry` binary", *(f"`{n}` {kinds.get(k, lambda d: 'string')(d)}" for n, k, _, d in self.fields()[3])])

    def reader(self, schema):
        return _ShapefileReader(self)


class _ShapefileReader(DataSourceReader):
    def __init__(self, source: Shapefile):
        self.base, (self.count, self.head, self.size, self.fields) = source._base(), source.fields()
        self.encoding = source.options.get("encoding", "utf-8")

    def partitions(self):
        return [Range(a, min(a + ROWS, self.count)) for a in range(0, self.count, ROWS)] or [Range(0, 0)]

    def read(self, part):
        offsets = self._offsets()
        with open(self.base + ".shp", "rb") as shp, open(self.base + ".dbf", "rb") as dbf:
            dbf.seek(self.head + part.start * self.size)
            for i in range(part.start, part.end):
                row = dbf.read(self.size)
                if row[:1] == b"*":
                    continue
                shp.seek(offsets[i] + 8)
                yield (self._shape(shp), *self._attributes(row))

    def _offsets(self):
        out, at = [], 100
        with open(self.base + ".shp", "rb") as f:
            size = struct.unpack(">I", f.read(28)[24:])[0] * 2
            while at < size:
                f.seek(at)
                out.append(at)
                at += 8 + 2 * struct.unpack(">II", f.read(8))[1]
        return out

    def _attributes(self, row):
        at = 1
        for _, kind, width, decimals in self.fields:
            text = row[at : at + width].decode(self.encoding, "replace").strip(" \0")
            at += width
            if kind in "NF":
                yield None if not text or text.startswith("*") else float(text) if decimals or kind == "F" else int(text)
            elif kind == "L":
                yield {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
            else:
                yield text or None

    @staticmethod
    def _shape(f):
        kind = struct.unpack("<i", f.read(4))[0] % 10
        if kind == 0:
            return None
        if kind == 1:
            return bytearray(wkb.encode("Point", [[struct.unpack("<2d", f.read(16))]]))
        f.read(32)
        if kind == 8:
            n = struct.unpack("<i", f.read(4))[0]
            points = [struct.unpack("<2d", f.read(16)) for _ in range(n)]
            return bytearray(wkb.encode("MultiPoint", [[p] for p in points], list(range(n))))
        n_parts, n_points = struct.unpack("<2i", f.read(8))
        starts = [*struct.unpack(f"<{n_parts}i", f.read(4 * n_parts)), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", f.read(16 * n_points))
        rings = [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        if kind == 3:
            return bytearray(wkb.encode("LineString", rings) if n_parts == 1 else wkb.encode("MultiLineString", rings, list(range(n_parts))))
        area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))
        outer = [i for i, r in enumerate(rings) if area(r) <= 0] or [0]  # outer rings run clockwise
        return bytearray(wkb.encode("Polygon", rings) if len(outer) == 1 else wkb.encode("MultiPolygon", rings, outer))
