import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from orelens.llm import tiff_media as T


def pack_bits(data):
    out, at = b"", 0
    while at < len(data):
        n = 1
        while at + n < len(data) and n < 128 and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            while at + n < len(data) and n < 128 and data[at + n] != data[at + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return out


def pack_lzw(data):
    bits, held, out = 0, 0, bytearray()

    def put(code, width):
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word], width)
        table[word + c] = len(table) + 2
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            put(256, 12)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = c
    if word:
        put(table[word], width)
        n = len(table) + 3
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257, width)
    put(0, 7)
    return bytes(out)


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}


def image(pages, order="<"):
    """A TIFF of (array (rows, columns, samples), compression, predictor, tiled, planar) pages."""
    out, link = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0)), 4
    for a, compression, predictor, tiled, planar in pages:
        h, w, s = a.shape
        a = a.astype(a.dtype.newbyteorder(order))
        blocks = []
        for plane in [a[:, :, i : i + 1] for i in range(s)] if planar else [a]:
            if tiled:
                for y in range(0, h, 16):
                    for x in range(0, w, 16):
                        t = np.zeros((16, 16, plane.shape[2]), a.dtype)
                        part = plane[y : y + 16, x : x + 16]
                        t[: part.shape[0], : part.shape[1]] = part
                        blocks.append(t)
            else:
                blocks += [plane[y : y + 5] for y in range(0, h, 5)]
        places, sizes = [], []
        for b in blocks:
            if predictor == 2:
                d = b.copy()
                d[:, 1:] = b[:, 1:] - b[:, :-1]
                b = d.astype(a.dtype)
            elif predictor == 3:
                raw = b.astype(b.dtype.newbyteorder(">")).view(np.uint8).reshape(b.shape[0], b.shape[1] * b.shape[2], b.dtype.itemsize).transpose(0, 2, 1).reshape(b.shape[0], -1, b.shape[2])
                d = raw.copy()
                d[:, 1:] -= raw[:, :-1]
                b = d
            packed = PACK[compression](np.ascontiguousarray(b).tobytes())
            places.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        fields = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [a.dtype.itemsize * 8] * s), 259: ("H", [compression]), 277: ("H", [s]), 284: ("H", [2 if planar else 1]), 317: ("H", [predictor]), 339: ("H", [kind] * s)}
        fields |= {322: ("I", [16]), 323: ("I", [16]), 324: ("I", places), 325: ("I", sizes)} if tiled else {273: ("I", places), 278: ("I", [5]), 279: ("I", sizes)}
        entries = b""
        for tag, (code, values) in sorted(fields.items()):
            packed = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(packed) > 4:
                place, out = len(out), out + packed
                packed = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[code], len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def arrays():
    rng = np.random.default_rng(2)
    for dtype, samples in (("u1", 1), ("u1", 3), ("u2", 2), ("f4", 1), ("i4", 1)):
        a = rng.integers(0, 6, (37, 41, samples)).astype(dtype)
        yield a + (rng.random(a.shape).astype(dtype) if dtype[0] == "f" else 0)


@pytest.mark.parametrize("order", ["<", ">"])
def test_every_packing_comes_back(order):
    cases = []
    for a in arrays():
        for compression in (1, 5, 8, 32773):
            for predictor in (1, 3) if a.dtype.kind == "f" else (1, 2):
                for tiled in (False, True):
                    cases.append((a, compression, predictor, tiled, a.shape[2] > 1 and tiled))
    data = image(cases, order)
    n = 0
    for (o, tags), (a, *_) in zip(T.directories(data), cases):
        w, h, s, bits, raw = T.read_page(data, o, tags)
        assert (w, h, s, bits) == (41, 37, a.shape[2], a.dtype.itemsize * 8)
        assert raw == a.tobytes()
        n += 1
    assert n == len(cases)


def test_long_lzw():
    rng = random.Random(1)
    for data in (bytes(rng.randrange(256) for _ in range(40_000)), b"abcab" * 9000, b"", b"x"):
        assert T.unpack_lzw(pack_lzw(data), len(data) + 1) == data
        assert T.unpack_lzw(T.pack_lzw(data), len(data) + 1) == data
        assert T.unpack_bits(T.pack_bits(data), len(data) + 1) == data
    runs = b"aaab" * 500 + bytes(range(256)) + b"z" * 1000
    assert T.unpack_bits(pack_bits(runs), 10_000) == T.unpack_bits(T.pack_bits(runs), 10_000) == runs
    assert len(T.pack_bits(b"z" * 1280)) == 20
    for n in range(300, 5000, 7):  # the code's width changes at many places
        data = bytes(rng.randrange(256) for _ in range(n))
        assert T.unpack_lzw(T.pack_lzw(data), n) == data


@pytest.mark.parametrize("layout", sorted(set(T.LAYOUTS), key=str))
def test_every_layout_comes_back(layout):
    rng = random.Random(2)
    for rows in (1, 15, 16, 63, 64, 65, 129, 700):
        payload = bytes(rng.choice(b"abc  \xff") for _ in range(rows * T.ROW))
        data = T.write_image(payload, layout)
        pages = [T.read_page(data, o, tags) for o, tags in T.directories(data)]
        assert b"".join(p[4] for p in pages) == payload
        assert len(pages) == (-(-rows // layout[3]) if layout[3] else 1)


def test_few_bits_and_the_other_fill_order():
    rng = np.random.default_rng(5)
    for bits in (1, 2, 4):
        values = rng.integers(0, 1 << bits, (5, 13, 3), dtype=np.uint8)
        flat = (values.reshape(5, -1)[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).reshape(5, -1).astype(np.uint8)
        packed = np.packbits(flat, axis=1)
        for fill in (1, 2):
            raw = packed if fill == 1 else np.packbits(np.unpackbits(packed, axis=1), axis=1, bitorder="little")
            tags = {256: (13,), 257: (5,), 258: (bits,) * 3, 277: (3,), 266: (fill,), 273: (0,), 279: (raw.size,)}
            assert T.read_page(raw.tobytes(), "<", tags) == (13, 5, 3, bits, values.tobytes())


def test_fuzzed_files_end_in_rows(spark):
    rng = random.Random(11)
    files = [image([(a, c, p, t, False) for a in list(arrays())[:3]]) for c, p, t in ((1, 1, False), (5, 2, True), (8, 2, False), (32773, 1, True))]
    rows = []
    for i in range(600):
        data = bytearray(rng.choice(files))
        first = struct.unpack("<I", data[4:8])[0]
        for _ in range(rng.randrange(1, 4)):
            at = first + rng.randrange(150) if rng.random() < 0.8 else rng.randrange(len(data))
            data[at % len(data)] = rng.choice([0, 1, 2, 11, 12, 127, 128, 255, rng.randrange(256)])
        rows.append((i, bytes(data)))
    # The cases that once ended the task: 8-bit floats, a float as strip height, a width of 2**31.
    one = image([(np.zeros((4, 4, 1), "u1"), 1, 1, False, False)])
    rows += [(1000, one.replace(struct.pack("<HHIHH", 339, 3, 1, 1, 0), struct.pack("<HHIHH", 339, 3, 1, 3, 0)))]
    rows += [(1001, one.replace(struct.pack("<HHII", 278, 4, 1, 5), struct.pack("<HHIf", 278, 11, 1, 5.0)))]
    rows += [(1002, one.replace(struct.pack("<HHII", 256, 4, 1, 4), struct.pack("<HHII", 256, 4, 1, 1 << 31)))]
    rows += [(1003, one.replace(struct.pack("<HHII", 256, 4, 1, 4), struct.pack("<HHII", 256, 4, 1, 1 << 30)))]
    out = T.pages(spark.createDataFrame(rows, "id int, media binary"), ["id"]).collect()
    assert {r.id for r in out} == {i for i, _ in rows}
    assert all((r.error is None) != (r.pixels is None) for r in out)
    assert all(r.error for r in out if r.id >= 1000)


def test_texts_equal_brute_force(spark):
    texts = ["", None, "a", "é" * 97, "x" * 192, "y" * 193, "日本" * 90_000, "a"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "n", "c")]
    out = T.digest(spark.createDataFrame(rows, "doc_id long, text string, feature string")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        media = T.write_image(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
    assert got[2].feature == got[7].feature and got[0].feature == got[1].feature
    assert T.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_broken_files_are_rows_with_errors(spark):
    good = image([(np.zeros((4, 4, 1), "u1"), 1, 1, False, False)] * 2)
    cut, loop = good[: len(good) // 2], bytearray(good)
    first = struct.unpack("<I", good[4:8])[0]
    n = struct.unpack_from("<H", good, first)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    odd = image([(np.zeros((4, 4, 1), "u1"), 1, 1, False, False)]).replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0))
    rows = [(1, good), (2, None), (3, b"PK"), (4, bytes(loop)), (5, odd), (6, cut)]
    out = T.pages(spark.createDataFrame(rows, "id int, media binary"), ["id"]).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert [r.page for r in by[1]] == [0, 1] and all(r.error is None for r in by[1])
    assert by[2][0].error and by[2][0].page is None and by[3][0].error
    assert len(by[4]) == 1 and by[4][0].error is None
    assert "compression 7" in by[5][0].error and by[5][0].pixels is None
    assert by[6]
