"""Media columns: TIFF files in a binary column.

`pages` walks a file's image directories in order and gives one row per page: strips or tiles, chunky or planar, are
decoded (none, PackBits, LZW, deflate; either fill order), predictors are undone, and the samples (of 1, 2, 4, 8, 16, 32
or 64 bits; those under 8 a byte each) come back as bytes. `encode` stores a payload as 8-bit RGB of a fixed width, in
one of LAYOUTS that the payload's own checksum selects: deflated strips, LZW tiles, PackBits strips, or several pages.

What a page's fields ask for is held against what its data can unpack to before room is made for it, so that no
file takes more memory than its own size and its compression's greatest ratio explain.

Defined cases: a null file, or one that isn't TIFF, has one row with page null and its `error`; a page that can't be
decoded, whatever its fields hold, has its `error` and null pixels, and the pages after it still come; a directory that
was visited ends the walk; a null text is empty and is stored as one row of spaces; equal texts give equal files; a text
may be as long as a binary value can be; an empty table gives an empty result; other columns pass through as asked for
in `keep`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
ROWS_PER_STRIP = 256
DEFLATE_LEVEL = 1
#: (compression, predictor, width and height of a tile or None, rows of a page or None), by the payload's CRC-32 modulo
#: their number. LZW, whose coding is a loop over bytes, costs some 30 times as much as the others.
LAYOUTS = ((5, 2, (32, 16), None), *[(32773, 1, None, None)] * 3, *[(8, 2, None, 64)] * 4, *[(8, 2, None, None)] * 24)
#: The most bytes that a byte of data can unpack to, by compression.
RATIOS = {1: 1, 32773: 64, 5: 3641, 8: 1032, 32946: 1032}
#: Bytes of output that are handed on at once.
RUN_BYTES = 1 << 23
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of each TIFF field type, from type 1.
TYPE_BYTES = (1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
TYPE_CODES = ("B", "s", "H", "I", "II", "b", "B", "h", "i", "ii", "f", "d")


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three or more equal bytes, and what is between them as it is."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate(([True], raw[1:] != raw[:-1]))) if len(raw) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(raw)))
    out, plain = bytearray(), 0

    def literal(upto: int) -> None:
        for at in range(plain, upto, 128):
            part = data[at : min(at + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3).tolist():
        first, n = int(starts[k]), int(lengths[k])
        literal(first)
        for at in range(0, n, 128):
            part = min(128, n - at)
            out += bytes([257 - part if part > 1 else 0, data[first]])
        plain = first + n
    literal(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes from the high bit, of 9 to 12 bits, one code early; 256 clears and 257 ends."""
    out: list[bytes] = []
    table: list[bytes] = []
    width, bits, held, last, done = 9, 0, 0, b"", 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257 or done >= size:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
        if not last:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code comes before its entry")
            word = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + word[:1])
        out.append(word)
        done += len(word)
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """The other way round: a clearing code first and whenever the table is full, an ending code last."""
    single = {bytes([i]): i for i in range(256)}
    table, width, held, bits, out = dict(single), 9, 256, 9, bytearray()
    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        held, bits = held << width | table[word], bits + width
        table[more] = len(table) + 2
        if len(table) + 2 == 4094:
            held, bits, table, width = held << width | 256, bits + width, dict(single), 9
        elif len(table) + 2 >= 1 << width:
            width += 1
        word = data[i : i + 1]
        if bits >= 64:
            spare = bits % 8
            out += (held >> spare).to_bytes(bits // 8, "big")
            held, bits = held & ((1 << spare) - 1), spare
    if word:
        held, bits = held << width | table[word], bits + width
        # The reader has one entry fewer than were made here, but counts this code's as well.
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    held, bits = held << width | 257, bits + width
    fill = -bits % 8
    return bytes(out + (held << fill).to_bytes((bits + fill) // 8, "big"))


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = unpack_lzw(data, size)
    else:
        out = zlib.decompressobj().decompress(data, size)
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes in a strip or tile")
    return out[:size]


def _undone(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: (rows, columns, samples) of the file's own byte order."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
    if predictor == 3:  # bytes of equal weight stand together, highest first, and are differenced
        rows, columns, samples = block.shape
        raw = block.view(np.uint8).reshape(rows, -1)
        raw = np.add.accumulate(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, block.itemsize, columns * samples)
        return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(block.dtype.newbyteorder(">")).reshape(block.shape)
    raise ValueError(f"predictor {predictor} is not supported")


def directories(data: bytes):
    """(byte order, tags) of each image directory; tags are tuples by number."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise ValueError("a directory lies outside the file")
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise ValueError("a directory lies outside the file")
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if not 1 <= kind <= 12:
                continue
            size, place = TYPE_BYTES[kind - 1] * count, at + 10 + 12 * k
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if place + size > len(data):
                raise ValueError("a field lies outside the file")
            if kind == 2:
                tags[tag] = (data[place : place + size],)
            else:
                code = TYPE_CODES[kind - 1]
                tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _counts(tags: dict, tag: int, default: int | None = None) -> tuple[int, ...]:
    """A field's values, which have to be whole numbers from 0 on."""
    found = tags.get(tag, () if default is None else (default,))
    if not found or not all(isinstance(x, int) and x >= 0 for x in found):
        raise ValueError(f"field {tag} is missing or isn't a count")
    return found


def _count(tags: dict, tag: int, default: int | None = None, least: int = 1) -> int:
    value = _counts(tags, tag, default)[0]
    if not least <= value < 1 << 31:
        raise ValueError(f"field {tag} is {value}")
    return value


def read_page(data: bytes, order: str, tags: dict) -> tuple[int, int, int, int, bytes]:
    """(width, height, samples, bits, samples' bytes in the machine's order, row by row)."""
    width, height, samples = _count(tags, 256), _count(tags, 257), _count(tags, 277, 1)
    found = set(_counts(tags, 258, 1))
    if len(found) > 1 or not found <= {1, 2, 4, 8, 16, 32, 64}:
        raise ValueError("only samples of 1, 2, 4, 8, 16, 32 or 64 bits, all the same, are supported")
    bits = found.pop()
    kind = {2: "i", 3: "f"}.get(_count(tags, 339, 1), "u")
    if kind == "f" and bits < 16:
        raise ValueError(f"floating-point samples of {bits} bits")
    dtype = np.dtype(f"{order}{kind}{bits // 8}" if bits >= 8 else "u1")
    compression, predictor, planar = _count(tags, 259, 1), _count(tags, 317, 1), _count(tags, 284, 1) == 2
    if compression not in RATIOS:
        raise ValueError(f"compression {compression} is not supported")
    if predictor > 1 and bits < 8 or predictor == 3 and kind != "f":
        raise ValueError(f"predictor {predictor} of such samples is not supported")
    tiled = 322 in tags
    w, h = (_count(tags, 322), _count(tags, 323)) if tiled else (width, min(height, _counts(tags, 278, height)[0]) or height)
    offsets, counts = (_counts(tags, 324), _counts(tags, 325)) if tiled else (_counts(tags, 273), _counts(tags, 279))
    across, down, planes, own = -(-width // w), -(-height // h), samples if planar else 1, 1 if planar else samples
    blocks = across * down * planes
    if min(len(offsets), len(counts)) < blocks:
        raise ValueError("strips or tiles are missing")
    row_bytes = (w * own * bits + 7) // 8
    stored = sum(min(c, max(0, len(data) - o)) for o, c in zip(offsets[:blocks], counts[:blocks]))
    asked = planes * row_bytes * (across * down * h if tiled else height)
    if asked > stored * RATIOS[compression] + 4096:
        raise ValueError(f"{stored} bytes of data can't hold the {asked} that the size asks for")
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    turned = _count(tags, 266, 1) == 2
    for k in range(blocks):
        plane, place = divmod(k, across * down)
        y, x = place // across * h, place % across * w
        rows = h if tiled else min(h, height - y)
        raw = data[offsets[k] : offsets[k] + counts[k]]
        if turned:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tobytes()
        raw = _unpacked(raw, compression, rows * row_bytes)
        if bits < 8:
            each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, row_bytes), axis=1)[:, : w * own * bits].reshape(rows, w, own, bits)
            block = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
        else:
            block = _undone(np.frombuffer(raw, dtype).reshape(rows, w, own), predictor, order)
        block = block[: height - y, : width - x]
        out[y : y + h, x : x + w, plane : plane + own] = block
    return width, height, samples, bits, out.tobytes()


def write_image(payload: bytes, layout: tuple | None = None) -> bytes:
    """A TIFF whose samples are the payload, of a positive multiple of ROW bytes."""
    compression, predictor, tile, page_rows = layout or LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    every = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    pack = {DEFLATE: lambda x: zlib.compress(x, DEFLATE_LEVEL), PACKBITS: pack_bits, LZW: pack_lzw}[compression]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(every), page_rows or len(every)):
        pixels = every[top : top + (page_rows or len(every))]
        height = len(pixels)
        if tile:
            w, h = tile
            full = np.zeros((-(-height // h) * h, WIDTH, SAMPLES), np.uint8)
            full[:height] = pixels
            blocks = [full[y : y + h, x : x + w] for y in range(0, height, h) for x in range(0, WIDTH, w)]
        else:
            blocks = [pixels[y : y + ROWS_PER_STRIP] for y in range(0, height, ROWS_PER_STRIP)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
            data = pack(block.tobytes())
            places.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(256, "I", [WIDTH]), (257, "I", [height]), (258, "H", [8] * SAMPLES), (259, "H", [compression]), (262, "H", [2]), (277, "H", [SAMPLES]), (284, "H", [1]), (317, "H", [predictor])]
        fields += [(322, "I", [w]), (323, "I", [h]), (324, "I", places), (325, "I", sizes)] if tile else [(273, "I", places), (278, "I", [ROWS_PER_STRIP]), (279, "I", sizes)]
        out[link : link + 4] = struct.pack("<I", len(out))
        entries, more, tail = [], b"", len(out) + 2 + 12 * len(fields) + 4
        for tag, code, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{code}", *values)
            if len(packed) > 4:
                place, more = tail + len(more), more + packed + b"\0" * (len(packed) % 2)
                packed = struct.pack("<I", place)
            entries.append(struct.pack("<HHI", tag, 3 if code == "H" else 4, len(values)) + packed.ljust(4, b"\0"))
        link = tail - 4
        out += struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0" + more
    return bytes(out)


def feature(width: int, height: int, samples: int, pixels: bytes) -> str:
    """Size, and each channel's sum, minimum, maximum and count of distinct values."""
    planes = np.frombuffer(pixels, np.uint8).reshape(-1, samples)
    parts = []
    for c in range(samples):
        seen = np.bincount(planes[:, c], minlength=256)
        values = np.flatnonzero(seen)
        parts.append(f"{int(seen @ np.arange(256))},{values[0]},{values[-1]},{len(values)}" if len(values) else "0,0,0,0")
    return f"{width}x{height}x{samples};" + ";".join(parts)


def _kinds(read: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {read.schema[c].dataType.simpleString()}, " for c in keep)


def encode(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, n_bytes of the text, `media`, the padded text as a TIFF file, and file_no, a file's number
    among those of its task."""
    read = docs.select(*keep, F.col(text_col).alias("_text"))

    def run(batches):
        number = 0
        for batch in batches:
            texts, sizes, media, first, held = batch.column(len(keep)).cast(pa.large_binary()), [], [], 0, 0
            for k, value in enumerate(texts):
                data = value.as_py() or b""
                sizes.append(len(data))
                padded = max(ROW, -(-len(data) // ROW) * ROW)
                media.append(write_image(data.ljust(padded, b" ")))
                held += len(media[-1])
                if held >= RUN_BYTES or k == len(texts) - 1:
                    numbers = pa.array(range(number, number + len(media)), pa.int64())
                    number += len(media)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, k + 1 - first) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), numbers], [*keep, "n_bytes", "media", "file_no"])
                    sizes, media, first, held = [], [], k + 1, 0

    return read.mapInArrow(run, _kinds(read, keep) + "n_bytes long, media binary, file_no long")


#: What a field of the wrong kind or size, or data that don't fit it, can raise.
BAD_FILE = (ValueError, KeyError, TypeError, IndexError, OverflowError, MemoryError, ZeroDivisionError, zlib.error, struct.error)


def pages(files: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns `keep` and one row per page: page (from 0), width, height, samples, bits, compression, predictor,
    pixels, feature (of 8-bit samples) and error."""
    read = files.select(*keep, F.col(media_col).alias("_media"))
    names = ["page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "feature", "error"]
    kinds = [*[pa.int32()] * 7, pa.binary(), pa.string(), pa.string()]

    def walk(data: bytes | None):
        n = 0
        try:
            for order, tags in directories(data or b""):
                how = tuple(x[0] if x and isinstance(x[0], int) and abs(x[0]) < 1 << 31 else None for x in (tags.get(259, (1,)), tags.get(317, (1,))))
                try:
                    width, height, samples, bits, pixels = read_page(data, order, tags)
                    yield n, width, height, samples, bits, *how, pixels, feature(width, height, samples, pixels) if bits == 8 else None, None
                except BAD_FILE as e:
                    yield n, None, None, None, None, *how, None, None, f"{type(e).__name__}: {e}"
                n += 1
        except BAD_FILE as e:
            yield (n or None), None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for batch in batches:
            rows, taken, held = [], [], 0

            def done():
                own = pa.array(taken, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(len(keep))), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names)))], [*keep, *names])

            for k, value in enumerate(batch.column(len(keep))):
                for row in walk(value.as_py()):
                    rows.append(row)
                    taken.append(k)
                    held += len(row[7] or b"")
                    if held >= RUN_BYTES:
                        yield done()
                        rows, taken, held = [], [], 0
            if rows:
                yield done()

    return read.mapInArrow(run, _kinds(read, keep) + "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, feature string, error string")


def whole(pages_of: DataFrame, keep: list[str]) -> DataFrame:
    """One row a file from the rows of its pages, which follow each other: the columns `keep`, payload_bytes,
    payload_sha256 and tail_crc32 of all pages' pixels together, and their feature. Null where a page has an error."""
    read = pages_of.select(*keep, "file_no", "width", "samples", "pixels")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    at, kinds = len(keep), [*(to_arrow_type(read.schema[c].dataType) for c in keep), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        now, first, parts = None, None, []
        rows: list[tuple] = []

        def done():
            if None in parts or not parts:
                return *first[:at], None, None, None, None
            payload = b"".join(p for _, _, p in parts)
            width, samples = parts[0][:2]
            told = f"{len(parts)}p " + feature(width, len(payload) // (width * samples), samples, payload)
            return *first[:at], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), told

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [*keep, *names])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(at + 3)]
            for k in range(batch.num_rows):
                if columns[at][k] != now:
                    if now is not None:
                        rows.append(done())
                    now, first, parts = columns[at][k], tuple(c[k] for c in columns), []
                pixels = batch.column(at + 3)[k].as_py()
                parts.append(None if pixels is None else (columns[at + 1][k], columns[at + 2][k], pixels))
            if len(rows) >= 1000:
                yield batch_of()
                rows = []
        if now is not None:
            rows.append(done())
        if rows:
            yield batch_of()

    return read.mapInArrow(run, _kinds(read, keep) + "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def digest(docs: DataFrame) -> DataFrame:
    """Each text stored as TIFF and read back from the stored bytes."""
    stored = encode(docs, ["doc_id"]).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    # No shuffle stands between these, so a file's pages stay together and in order.
    return whole(pages(stored, [*keep, "file_no"]), keep).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
