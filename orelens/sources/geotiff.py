"""GeoTIFF as a Spark data source (`geotiff` reads pixel tables) and a sink by tiles, with a NumPy codec.

Reading plans one partition per strip of blocks; each task opens the file, decodes its own blocks and yields pixel
rows. Row-range filters are pushed into the partitions, and only the bands asked for become columns.

Writing packs each tile in a task, reduced copies included. The driver knows the tiles' sizes alone, so that the
directories can come first, and then streams packed tiles in file order, one partition at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition, LessThanOrEqual

#: TIFF field types (bytes, struct code).
FIELD_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
#: Tag numbers of the TIFF, GeoTIFF and GDAL formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 34735, 42112, 42113
GEOGRAPHIC_CRS, PROJECTED_CRS = 2048, 3072


@dataclass(frozen=True)
class Layout:
    """A file's magic number, struct codes of an entry count and of a place, bytes that an entry holds itself, and where
    the first directory's place stands."""

    magic: int
    entries: str
    place: str
    inline: int
    start: int


CLASSIC, BIG = Layout(42, "H", "I", 4, 4), Layout(43, "Q", "Q", 8, 8)
LAYOUTS = {form.magic: form for form in (CLASSIC, BIG)}


@dataclass
class Header:
    order: str
    tags: dict

    def get(self, tag, default=None):
        return self.tags.get(tag, (default,))[0]

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[self.get(SAMPLE_FORMAT, 1)]
        return np.dtype(f"{self.order}{kind}{self.get(BITS, 8) // 8}")

    @property
    def nodata(self) -> float | None:
        raw = self.get(GDAL_NODATA)
        return float(raw.strip(b"\0 ")) if raw else None

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(PROJECTED_CRS) or found.get(GEOGRAPHIC_CRS)

    @property
    def transform(self) -> tuple[float, float, float, float]:
        """(x origin, pixel width, y origin, pixel height), north up."""
        sx, sy = (self.tags.get(PIXEL_SCALE) or (1.0, 1.0, 0.0))[:2]
        tie = self.tags.get(TIEPOINT) or (0.0,) * 6
        return tie[3] - tie[0] * sx, sx, tie[4] + tie[1] * sy, sy

    @property
    def metadata(self) -> dict[str, str]:
        import re

        raw = self.get(GDAL_METADATA)
        return dict(re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', raw.rstrip(b"\0").decode("utf-8", "replace"))) if raw else {}

    @property
    def block(self) -> tuple[int, int]:
        if TILES in self.tags:
            return self.get(TILE_HEIGHT), self.get(TILE_WIDTH)
        return min(self.get(HEIGHT), self.get(ROWS_PER_STRIP, self.get(HEIGHT))), self.get(WIDTH)


def read_header(f) -> Header:
    """The first directory's tags; no pixel is read."""
    f.seek(0)
    first = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(first[:2])
    form = LAYOUTS.get(struct.unpack(order + "H", first[2:4])[0]) if order and len(first) >= 8 else None
    if form is None:
        raise ValueError("not a TIFF file")
    f.seek(struct.unpack_from(order + form.place, first, form.start)[0])
    n = struct.unpack(order + form.entries, f.read(struct.calcsize(order + form.entries)))[0]
    entry = struct.Struct(f"{order}HH{form.place}{form.inline}s")
    raw, tags = f.read(entry.size * n), {}
    for k in range(n):
        tag, kind, count, value = entry.unpack_from(raw, entry.size * k)
        if kind not in FIELD_TYPES:
            continue
        size, code = FIELD_TYPES[kind]
        if size * count > form.inline:
            f.seek(struct.unpack(order + form.place, value)[0])
            value = f.read(size * count)
        tags[tag] = (value[:count],) if kind == 2 else struct.unpack(f"{order}{count * len(code)}{code[0]}", value[: size * count])
    return Header(order, tags)


def read_rows(f, head: Header, top: int, bottom: int) -> np.ndarray:
    """(bands, rows, columns) of the rows top <= row < bottom, in whole blocks' time."""
    w, h, bands = head.get(WIDTH), head.get(HEIGHT), head.get(SAMPLES, 1)
    bh, bw = head.block
    offsets, sizes = (head.tags[TILES], head.tags[TILE_BYTES]) if TILES in head.tags else (head.tags[STRIPS], head.tags[STRIP_BYTES])
    planar, across, down = head.get(PLANAR, 1) == 2, -(-w // bw), -(-h // bh)
    out = np.zeros((bands, bottom - top, w), head.dtype.newbyteorder("="))
    own = 1 if planar else bands
    for plane in range(bands if planar else 1):
        for by in range(top // bh, -(-bottom // bh)):
            for bx in range(across):
                k = plane * across * down + by * across + bx
                f.seek(offsets[k])
                rows = bh if TILES in head.tags else min(bh, h - by * bh)
                block = _decode(f.read(sizes[k]), head, rows, bw, own)
                y0, y1 = max(top, by * bh), min(bottom, by * bh + rows, h)
                x1 = min(w, bx * bw + bw)
                out[plane : plane + own, y0 - top : y1 - top, bx * bw : x1] = block[y0 - by * bh : y1 - by * bh, : x1 - bx * bw].transpose(2, 0, 1)
    return out


def _decode(data: bytes, head: Header, rows: int, columns: int, samples: int) -> np.ndarray:
    packing, predictor = head.get(COMPRESSION, 1), head.get(PREDICTOR, 1)
    if packing in (8, 32946):
        data = zlib.decompress(data)
    elif packing != 1:
        raise ValueError(f"compression {packing} is not supported")
    dtype = head.dtype
    if predictor == 3:
        raw = np.frombuffer(data, np.uint8).reshape(rows, -1, samples)
        raw = np.add.accumulate(raw, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, columns * samples)
        return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, columns, samples)
    block = np.frombuffer(data, dtype)[: rows * columns * samples].reshape(rows, columns, samples)
    return np.add.accumulate(block, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else block


def pack_tile(part: np.ndarray, size: int) -> bytes:
    """A deflated tile of (bands, rows, columns), filled up with zeros; floats are differenced bytewise, whole numbers by value."""
    bands, h, w = part.shape
    tile = np.zeros((size, size, bands), part.dtype.newbyteorder("<"))
    tile[:h, :w] = part.transpose(1, 2, 0)
    if tile.dtype.kind == "f":
        width = tile.dtype.itemsize
        tile = tile.astype(tile.dtype.newbyteorder(">")).view(np.uint8).reshape(size, size * bands, width).transpose(0, 2, 1).reshape(size, -1, bands)
    diff = tile.copy()
    diff[:, 1:] -= tile[:, :-1]
    return zlib.compress(diff.tobytes(), 6)


@dataclass
class Level:
    """One directory: a raster's size and where its tiles are."""

    height: int
    width: int
    places: list[int]
    sizes: list[int]


def directories(levels: list[Level], bands: int, dtype: np.dtype, size: int, form: Layout, *, x_origin=0.0, y_origin=0.0, res=1.0, epsg=None, nodata=None, metadata=None) -> bytes:
    """The file's start: header and all directories, first the full raster's. Its length doesn't depend on the places."""
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    out = bytearray(struct.pack("<2sH", b"II", form.magic) + (struct.pack("<HH", 8, 0) if form is BIG else b""))
    link = len(out)
    out += struct.pack("<" + form.place, 0)
    place = 16 if form is BIG else 4
    for n, level in enumerate(levels):
        fields = [(254, 4, [int(n > 0)]), (WIDTH, 4, [level.width]), (HEIGHT, 4, [level.height]), (BITS, 3, [dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [1]), (PREDICTOR, 3, [3 if kind == 3 else 2]), (TILE_WIDTH, 4, [size]), (TILE_HEIGHT, 4, [size]), (TILES, place, level.places), (TILE_BYTES, 4, level.sizes), (SAMPLE_FORMAT, 3, [kind] * bands)]
        if nodata is not None:
            fields.append((GDAL_NODATA, 2, f"{nodata:g}\0".encode()))
        if not n:
            fields += [(PIXEL_SCALE, 12, [res, res, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, x_origin, y_origin, 0.0])]
            if epsg:
                geographic = epsg == 4326
                fields.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC_CRS if geographic else PROJECTED_CRS, 0, 1, epsg]))
            if metadata:
                items = "".join(f'<Item name="{k}">{v}</Item>' for k, v in metadata.items())
                fields.append((GDAL_METADATA, 2, f"<GDALMetadata>{items}</GDALMetadata>\0".encode()))
        entries = b""
        for tag, code, values in sorted(fields, key=lambda x: x[0]):
            packed = values if code == 2 else struct.pack(f"<{len(values)}{FIELD_TYPES[code][1][0]}", *values)
            if len(packed) > form.inline:
                out += b"\0" * (len(out) % 2)
                at, out = len(out), out + packed
                packed = struct.pack("<" + form.place, at)
            entries += struct.pack(f"<HH{form.place}", tag, code, len(values)) + packed.ljust(form.inline, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<" + form.place, out, link, len(out))
        out += struct.pack("<" + form.entries, len(fields)) + entries
        link = len(out)
        out += struct.pack("<" + form.place, 0)
    return bytes(out)


def laid_out(shapes: list[tuple[int, int]], sizes: list[list[int]], bands: int, dtype, size: int, form: Layout | None = None, **geo) -> tuple[bytes, Layout]:
    """The start of a file whose tiles follow it in the order of `sizes`; beyond four gigabytes places take 8 bytes."""
    empty = [Level(h, w, [0] * len(own), own) for (h, w), own in zip(shapes, sizes, strict=True)]
    if form is None:
        total = sum(map(sum, sizes)) + len(directories(empty, bands, dtype, size, CLASSIC, **geo))
        form = CLASSIC if total < 2**32 else BIG
    at, levels = len(directories(empty, bands, dtype, size, form, **geo)), []
    for level in empty:
        ends = np.cumsum([at, *level.sizes]).tolist()
        levels.append(Level(level.height, level.width, ends[:-1], level.sizes))
        at = ends[-1]
    return directories(levels, bands, dtype, size, form, **geo), form


def tile_size(height: int, width: int, block: int = 512) -> int:
    return min(block, max(16, -(-max(height, width) // 16) * 16))


def encode(data: np.ndarray, *, block=512, form: Layout | None = None, **geo) -> bytes:
    """A tiled, deflated GeoTIFF of a small raster that is already in memory: (bands, rows, columns), 2-D arrays as one band."""
    a = data if data.ndim == 3 else data[None]
    bands, h, w = a.shape
    size = tile_size(h, w, block)
    tiles = [pack_tile(a[:, y : y + size, x : x + size], size) for y in range(0, h, size) for x in range(0, w, size)]
    start, _ = laid_out([(h, w)], [[len(t) for t in tiles]], bands, a.dtype, size, form, **geo)
    return start + b"".join(tiles)


META = "path string, filename string, driver string, dtype string, crs_epsg int, width int, height int, bands int, res double, nodata double, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, bounds struct<left:double,bottom:double,right:double,top:double>, tags map<string,string>"


def meta_row(path: str) -> tuple:
    with open(path, "rb") as f:
        head = read_header(f)
    x, sx, y, sy = head.transform
    w, h = head.get(WIDTH), head.get(HEIGHT)
    return (str(path), Path(path).name, "GTiff", head.dtype.name, head.epsg, w, h, head.get(SAMPLES, 1), sx, head.nodata, (sx, 0.0, x, 0.0, -sy, y), (x, y - h * sy, x + w * sx, y), head.metadata)


def header_row(spark: SparkSession, path) -> DataFrame:
    return spark.createDataFrame([meta_row(str(path))], META)


@dataclass
class Rows(InputPartition):
    top: int
    bottom: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.low, self.high = path, columns, 0, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("row",):
                self.low = max(self.low, int(f.value))
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("row",):
                self.high = int(f.value) if self.high is None else min(self.high, int(f.value))
            yield f  # partitions are chosen by it; Spark still applies it

    def partitions(self):
        with open(self.path, "rb") as f:
            head = read_header(f)
        h = head.get(HEIGHT)
        step = max(1, head.block[0])
        low, high = max(0, self.low), h if self.high is None else min(h, self.high + 1)
        return [Rows(max(low, y), min(high, y + step)) for y in range(low // step * step, high, step)] or [Rows(0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if partition.bottom <= partition.top:
            return
        with open(self.path, "rb") as f:
            head = read_header(f)
            data = read_rows(f, head, partition.top, partition.bottom)
        bands, rows, w = data.shape
        r, c = np.divmod(np.arange(rows * w, dtype=np.int32), w)
        arrays = {"row": pa.array(r + np.int32(partition.top)), "col": pa.array(c)}
        for i in range(bands):
            flat = data[i].reshape(-1).astype(np.float64)
            bad = ~np.isfinite(flat)
            if head.nodata is not None:
                bad |= flat == head.nodata
            arrays[f"b{i + 1}"] = pa.array(flat, mask=bad)
        yield pa.RecordBatch.from_arrays([arrays[n] for n in self.columns], self.columns)


def reduced(a: np.ndarray, k: int, how: str) -> np.ndarray:
    """(bands, rows, columns) at a k-th of the size: the first pixel of each cell, or the average of its valid ones."""
    if how == "nearest":
        return a[:, ::k, ::k]
    b, h, w = a.shape
    full = np.full((b, -(-h // k) * k, -(-w // k) * k), np.nan)
    full[:, :h, :w] = a
    cells = full.reshape(b, full.shape[1] // k, k, full.shape[2] // k, k)
    n = np.isfinite(cells).sum(axis=(2, 4))
    return np.where(n > 0, np.nansum(cells, axis=(2, 4)) / np.maximum(n, 1), np.nan)


TILE = "level int, ty int, tx int, y int, x int, h int, w int, data binary"


def _packer(bands: list[str], height: int, width: int, size: int, dtype: np.dtype, nodata: float, factors: list[int], how: str):
    """Two functions for applyInPandas: a tile's pixels to the packed tile and its parts of the reduced copies, and the
    parts of a reduced tile to that packed tile. Both hold one tile."""

    def pack(a: np.ndarray) -> bytes:
        return pack_tile(np.where(np.isfinite(a), a, nodata).astype(dtype), size)

    def full(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        ty, tx = (int(v) for v in key)
        a = np.full((len(bands), size, size), np.nan)
        a[:, t["row"].to_numpy() - ty * size, t["col"].to_numpy() - tx * size] = t[bands].to_numpy(np.float64).T
        out = [(0, ty, tx, 0, 0, size, size, pack(a))]
        own = a[:, : height - ty * size, : width - tx * size]
        for n, k in enumerate(factors, 1):
            part = np.ascontiguousarray(reduced(own, k, how), np.float64)
            out.append((n, ty // k, tx // k, ty % k * (size // k), tx % k * (size // k), *part.shape[1:], part.tobytes()))
        return pd.DataFrame(out, columns=["level", "ty", "tx", "y", "x", "h", "w", "data"])

    def smaller(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        a = np.full((len(bands), size, size), np.nan)
        for r in t.itertuples():
            a[:, r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.data, np.float64).reshape(len(bands), r.h, r.w)
        return pd.DataFrame([(*(int(v) for v in key), 0, 0, size, size, pack(a))], columns=["level", "ty", "tx", "y", "x", "h", "w", "data"])

    return full, smaller, pack


def _write_file(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """The chunks one after the other; paths with a scheme go to Hadoop's file systems. The name appears when all is written."""
    if "://" not in path:
        part = Path(path + ".part")
        with part.open("wb") as f:
            f.writelines(chunks)
        part.replace(path)
        return
    jvm = spark._jvm
    target, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    try:
        for chunk in chunks:
            stream.write(bytearray(chunk))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not rename the finished file to {path}")


def write_raster(pixels: DataFrame, path: str, raster, dtype: str = "float32", nodata: float | None = None, factors: tuple[int, ...] = (), how: str = "average", block: int = 512, form: Layout | None = None) -> None:
    """(row, col, one column a band) as one tiled GeoTIFF with reduced copies, by tiles.

    One shuffle brings a tile's pixels together; its parts of the reduced copies (a third as much at most) take a second,
    smaller one. The driver collects one size a tile. Pixels that the table lacks, nulls, NaN and infinities are nodata;
    tiles without any pixel are stored as such. Of repeated pixels one is taken. Pixels outside the raster are left out.
    """
    from orelens.operators.components import _checkpointed

    if "layer" in pixels.columns:
        raise ValueError("a file holds one raster: choose a layer and drop the column")
    spark, h, w, kind = pixels.sparkSession, raster.height, raster.width, np.dtype(dtype)
    bands = [c for c in pixels.columns if c not in ("row", "col")]
    size = tile_size(h, w, block)
    factors = [k for k in factors if min(h, w) // k >= 1]
    if any(size % k for k in factors):
        raise ValueError(f"factors of reduced copies must divide the tile size {size}")
    if nodata is None:
        nodata = raster.nodata if raster.nodata is not None else (-9999.0 if kind.kind == "f" else -1.0)
    full, smaller, pack = _packer(bands, h, w, size, kind, nodata, factors, how)
    own = pixels.where(F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1)).select(F.col("row").cast("int"), F.col("col").cast("int"), *[F.col(b).cast("double") for b in bands])
    cell = [F.floor(F.col(c) / size).cast("int").alias(t) for c, t in (("row", "ty"), ("col", "tx"))]
    tiles = _checkpointed(own.groupBy(*cell).applyInPandas(full, TILE))
    if factors:
        tiles = _checkpointed(tiles.where("level = 0").unionByName(tiles.where("level > 0").groupBy("level", "ty", "tx").applyInPandas(smaller, TILE)))
    shapes = [(-(-h // k), -(-w // k)) for k in (1, *factors)]
    empty = pack(np.full((len(bands), size, size), np.nan))
    across = [-(-sw // size) for _, sw in shapes]
    sizes = [[len(empty)] * (-(-sh // size) * n) for (sh, _), n in zip(shapes, across, strict=True)]
    known = {(r.level, r.ty * across[r.level] + r.tx): r.n for r in tiles.select("level", "ty", "tx", F.length("data").alias("n")).toLocalIterator()}
    for (level, at), n in known.items():
        sizes[level][at] = n
    geo = {"x_origin": float(raster.x_origin), "y_origin": float(raster.y_origin), "res": float(raster.res), "epsg": raster.epsg, "nodata": nodata}
    start, _ = laid_out(shapes, sizes, len(bands), kind, size, form, **geo)

    def chunks():
        yield start
        parts = 1 + sum(known.values()) // 2**26
        packed = iter(tiles.repartitionByRange(parts, "level", "ty", "tx").sortWithinPartitions("level", "ty", "tx").select("data").toLocalIterator())
        for level, own_sizes in enumerate(sizes):
            for at in range(len(own_sizes)):
                yield bytes(next(packed).data) if (level, at) in known else empty

    _write_file(spark, path, chunks())


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff").load(path); `write_raster` and `write_cog` write."""

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        with open(self.options["path"], "rb") as f:
            n = read_header(f).get(SAMPLES, 1)
        return "row int, col int, " + ", ".join(f"b{i + 1} double" for i in range(n))

    def reader(self, schema):
        return _Reader(self.options["path"], [f.name for f in schema.fields])


class GeoTiffMetaSource(DataSource):
    """spark.read.format("geotiff_meta").load(path): one header row."""

    @classmethod
    def name(cls):
        return "geotiff_meta"

    def schema(self):
        return META

    def reader(self, schema):
        path = self.options["path"]

        class One(DataSourceReader):
            def read(self, partition):
                yield meta_row(path)

        return One()


def register(spark: SparkSession) -> None:
    from .shapefile import ShapefileSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GeoTiffSource, GeoTiffMetaSource, ShapefileSource):
        spark.dataSource.register(source)


def write_cog(pixels: DataFrame, path: str, raster, classes: bool = False, factors: tuple[int, ...] = (2, 4, 8, 16)) -> None:
    """A tiled file with overviews, directories first: nearest for classes (int16, nodata -1), averages for continuous bands (float32, -9999)."""
    write_raster(pixels, path, raster, "int16" if classes else "float32", factors=factors, how="nearest" if classes else "average")
