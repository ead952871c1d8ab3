"""ESRI shapefiles (.shp with .dbf and .prj) and GeoJSON as polygon tables (poly_id, class column, rings)."""

from __future__ import annotations

import re
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

POLYGON = {5, 15, 25}
RINGS = "array<array<struct<x:double,y:double>>>"


def read_shapes(data: bytes):
    """(shape type, rings) of each record."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 12 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", body[:4])[0]
        rings = []
        if kind in POLYGON:
            parts, points = struct.unpack("<ii", body[36:44])
            first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(first, first[1:])]
        yield kind, rings
        at += 8 + size


def read_table(data: bytes) -> tuple[list[str], list[dict[str, str]]]:
    """Field names and rows, as text, of a dBASE table."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), data[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        place, row = head + k * size + 1, {}
        for name, width in fields:
            row[name] = data[place : place + width].decode("utf-8", "replace").strip()
            place += width
        rows.append(row)
    return [f for f, _ in fields], rows


def epsg_of(prj: str | None) -> int | None:
    """WGS84 and its UTM zones, from a projection file's text."""
    if not prj:
        return None
    zone = re.search(r"UTM[_ ]Zone[_ ](\d+)([NS])", prj, re.I)
    if zone:
        return (32600 if zone[2].upper() == "N" else 32700) + int(zone[1])
    return 4326 if prj.startswith("GEOGCS") and "1984" in prj else None


def write_shapefile(path: str, rings: list, classes: list[int], column: str = "class_id", prj: str | None = None) -> None:
    """Polygons with one whole-number column; what tests and small exports need."""
    body = b""
    boxes = []
    for i, polygon in enumerate(rings, 1):
        points = [p for r in polygon for p in r]
        box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
        boxes.append(box)
        first = [sum(len(r) for r in polygon[:k]) for k in range(len(polygon))]
        record = struct.pack("<i4dii", 5, *box, len(polygon), len(points)) + struct.pack(f"<{len(first)}i", *first) + b"".join(struct.pack("<dd", *p) for p in points)
        body += struct.pack(">ii", i, len(record) // 2) + record
    extent = [f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max))]
    head = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *extent, 0, 0, 0, 0)
    base = Path(path).with_suffix("")
    base.with_suffix(".shp").write_bytes(head + body)
    fields = column.encode()[:10].ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    rows = b"".join(b" " + str(c).rjust(10).encode() for c in classes)
    base.with_suffix(".dbf").write_bytes(struct.pack("<B3BIHH20x", 3, 126, 1, 1, len(classes), 65, 11) + fields + b"\r" + rows + b"\x1a")
    if prj:
        base.with_suffix(".prj").write_text(prj)


def validate(path: str, column: str) -> int:
    """The EPSG code of a usable training file; errors in the order column, geometry, system, classes."""
    base = Path(path).with_suffix("")
    if not base.with_suffix(".shp").exists():
        raise FileNotFoundError(path)
    names, rows = read_table(base.with_suffix(".dbf").read_bytes())
    if column not in names:
        raise ValueError(f"column {column!r} is missing; there are {', '.join(names)}")
    kinds = {k for k, _ in read_shapes(base.with_suffix(".shp").read_bytes())}
    if kinds - POLYGON:
        raise ValueError("only polygons can be training areas")
    prj = base.with_suffix(".prj")
    epsg = epsg_of(prj.read_text() if prj.exists() else None)
    if epsg is None:
        raise ValueError("the shapefile has no known reference system")
    if len({r[column] for r in rows}) < 2:
        raise ValueError("at least two classes are needed")
    return epsg


class ShapefileSource(DataSource):
    """spark.read.format("shapefile").option("column", "class_id").load(path)"""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        return f"poly_id int, class_id int, crs_epsg int, rings {RINGS}"

    def reader(self, schema):
        path, column = self.options["path"], self.options.get("column", "class_id")

        class Reader(DataSourceReader):
            def read(self, partition):
                base = Path(path).with_suffix("")
                prj = base.with_suffix(".prj")
                epsg = epsg_of(prj.read_text() if prj.exists() else None)
                _, rows = read_table(base.with_suffix(".dbf").read_bytes())
                for i, ((_, rings), row) in enumerate(zip(read_shapes(base.with_suffix(".shp").read_bytes()), rows)):
                    try:
                        cls = int(float(row[column]))
                    except (KeyError, ValueError):
                        cls = None
                    yield i, cls, epsg, rings

        return Reader()


def read_geojson(spark: SparkSession, path: str, column: str = "class_id") -> DataFrame:
    """Polygons and multipolygons of a feature collection; WGS84 unless said otherwise."""
    schema = f"features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:variant>>>"  # noqa: F541
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("poly_id", "f"))
    xy = lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    one = F.try_variant_get(F.col("f.geometry.coordinates"), "$", "array<array<array<double>>>")
    many = F.flatten(F.try_variant_get(F.col("f.geometry.coordinates"), "$", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    return rows.select("poly_id", F.expr(f"try_cast(f.properties['{column}'] AS INT)").alias("class_id"), F.lit(4326).alias("crs_epsg"), F.transform(rings, xy).alias("rings"))
