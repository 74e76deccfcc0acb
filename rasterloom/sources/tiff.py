"""TIFF rasters: headers, windows and writing, without an image library. Strips or tiles, plain, LZW or Deflate.

Files come through Spark's binary reader, so any file system that Spark reads will do; each file is parsed by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Field types and tags of TIFF 6.0 and GeoTIFF.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIPS, _BANDS, _ROWS, _COUNTS, _PLANES, _FORMAT, _SCALE, _TIEPOINT, _KEYS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339, 33550, 33922, 34735
_PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_COUNTS = 317, 322, 323, 324, 325
_PLAIN, _LZW, _DEFLATE = (1,), (5,), (8, 32946)
_EXTRA, _NODATA = 338, 42113
_GEOGRAPHIC, _PROJECTED, _UNIT = 2048, 3072, 3076
#: Metres of a unit, by its key in a file and by name; the last key is the US survey foot.
_METRES = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937}
_NAMED = {"metre": 1.0, "foot": 0.3048}


def tags(data) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's fields, of a file or a BigTIFF file. data: bytes, or anything that gives them by slices."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    magic = struct.unpack(order + "H", data[2:4])[0] if order else None
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    count, entry, inline, offset = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    at = struct.unpack(order + offset, data[8:16] if big else data[4:8])[0]
    first = at + struct.calcsize(order + count)
    n_entries = struct.unpack(order + count, data[at:first])[0]
    directory = data[first : first + entry * n_entries]
    found = {}
    for i in range(n_entries):
        field = directory[entry * i : entry * (i + 1)]
        tag, kind = struct.unpack(order + "HH", field[:4])
        n, value = struct.unpack(order + offset, field[4 : 4 + inline])[0], field[4 + inline :]
        if kind not in _TYPES:
            continue
        size = n * struct.calcsize(_TYPES[kind])
        if size > inline:
            start = struct.unpack(order + offset, value)[0]
            value = data[start : start + size]
        found[tag] = struct.unpack(f"{order}{n}{_TYPES[kind]}", value[:size])
    return order, found


def no_data(t: dict[int, tuple]) -> float | None:
    """The number that stands for no data, where the file names one."""
    try:
        return float(b"".join(t[_NODATA]).rstrip(b"\0 ").decode())
    except (KeyError, ValueError):
        return None


def alpha(t: dict[int, tuple]) -> int | None:
    """The number of the band that says how much of a pixel is there."""
    extra, bands = t.get(_EXTRA, ()), t.get(_BANDS, (1,))[0]
    return next((bands - len(extra) + i for i, kind in enumerate(extra) if kind in (1, 2)), None)


def chunks(t: dict[int, tuple]) -> tuple[int, int]:
    """Height and width of a strip or tile."""
    if _TILES in t:
        return t[_TILE_HEIGHT][0], t[_TILE_WIDTH][0]
    return min(t[_HEIGHT][0], t.get(_ROWS, (t[_HEIGHT][0],))[0]), t[_WIDTH][0]


def _unpacked(data: bytes) -> bytes:
    """An LZW stream: codes of 9 to 12 bits, the highest bit first, which widen one code early."""
    pieces: list[bytes] = []
    out = bytearray()
    bits = held = 0
    width, last = 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 256:
            pieces, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        piece = pieces[code] if code < len(pieces) else last + last[:1]
        out += piece
        if last:
            pieces.append(last + piece[:1])
        last = piece
        width = min(12, max(9, (len(pieces) + 1).bit_length()))
    return bytes(out)


def window(data, x: int = 0, y: int = 0, w: int = 1 << 31, h: int = 1 << 31) -> np.ndarray:
    """A window of the raster as height x width x bands, cut at its edges. Only the strips or tiles that it touches are read and decoded. data:
    bytes, or anything that gives them by slices."""
    order, t = tags(data)
    way, ahead, planes = t.get(_COMPRESSION, (1,))[0], t.get(_PREDICTOR, (1,))[0], t.get(_PLANES, (1,))[0]
    if way not in _PLAIN + _LZW + _DEFLATE or ahead not in (1, 2) or planes not in (1, 2) or len(set(t[_BITS])) != 1:
        raise ValueError("only plain, LZW or Deflate TIFF files of bands of one size can be read")
    kind = np.dtype(order + {(8, 1): "u1", (8, 2): "i1", (16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}[(t[_BITS][0], t.get(_FORMAT, (1,))[0])])
    wide, high, bands = t[_WIDTH][0], t[_HEIGHT][0], t.get(_BANDS, (1,))[0]
    tiled = _TILES in t
    step_y, step_x = chunks(t)
    starts, sizes = (t[_TILES], t[_TILE_COUNTS]) if tiled else (t[_STRIPS], t[_COUNTS])
    x, y, right, bottom = min(x, wide), min(y, high), min(wide, x + w), min(high, y + h)
    out = np.zeros((bottom - y, right - x, bands), kind)
    if not out.size:
        return out
    across, down = -(-wide // step_x), -(-high // step_y)
    held = bands if planes == 1 else 1  # bands of a strip or tile
    for plane in range(bands // held):
        for i in range(y // step_y, -(-bottom // step_y)):
            for j in range(x // step_x, -(-right // step_x)):
                n = (plane * down + i) * across + j
                raw = data[starts[n] : starts[n] + sizes[n]]
                raw = raw if way in _PLAIN else _unpacked(raw) if way in _LZW else zlib.decompress(raw)
                rows = step_y if tiled else min(step_y, high - i * step_y)
                part = np.frombuffer(raw, kind, rows * step_x * held).reshape(rows, step_x, held)
                if ahead == 2:
                    part = np.cumsum(part, 1, dtype=kind)
                top, left = max(y, i * step_y), max(x, j * step_x)
                low, far = min(bottom, i * step_y + rows), min(right, (j + 1) * step_x)
                out[top - y : low - y, left - x : far - x, plane * held : (plane + 1) * held] = part[top - i * step_y : low - i * step_y, left - j * step_x : far - j * step_x]
    return out


def array(data: bytes) -> np.ndarray:
    """The raster as height x width x bands."""
    return window(data)


def reference(t: dict[int, tuple]) -> tuple[int | None, float | None]:
    """The EPSG number of a raster's coordinates and the metres of their unit, from its keys; null where they name none."""
    keys = t.get(_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    return found.get(_PROJECTED, found.get(_GEOGRAPHIC)), _METRES.get(found.get(_UNIT))


def encoded(image: np.ndarray, scale: float | None = None, origin: tuple[float, float] = (0.0, 0.0), *, deflate: bool = False, tile: int | None = None, epsg: int | None = None) -> bytes:
    """An 8-bit image (height x width x bands) as a file of one strip, or of square tiles of a multiple of 16 pixels."""
    h, w, bands = image.shape
    image = np.ascontiguousarray(image, "u1")
    if tile:
        image = np.pad(image, ((0, -h % tile), (0, -w % tile), (0, 0)))
    size_y, size_x = (tile, tile) if tile else (h, w)
    parts = [image[i : i + size_y, j : j + size_x].tobytes() for i in range(0, image.shape[0], size_y) for j in range(0, image.shape[1], size_x)]
    parts = [zlib.compress(p) if deflate else p for p in parts]
    places = [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
    body, sizes = b"".join(parts), tuple(map(len, parts))
    fields = [(_WIDTH, 4, (w,)), (_HEIGHT, 4, (h,)), (_BITS, 3, (8,) * bands), (_COMPRESSION, 3, (_DEFLATE[0] if deflate else 1,)), (_PHOTOMETRIC, 3, (2 if bands >= 3 else 1,)), (_BANDS, 3, (bands,))]
    fields += [(_TILE_WIDTH, 4, (tile,)), (_TILE_HEIGHT, 4, (tile,)), (_TILES, 4, tuple(places)), (_TILE_COUNTS, 4, sizes)] if tile else [(_STRIPS, 4, tuple(places)), (_ROWS, 4, (h,)), (_COUNTS, 4, sizes)]
    if scale is not None:
        fields += [(_SCALE, 12, (scale, scale, 0.0)), (_TIEPOINT, 12, (0.0, 0.0, 0.0, *origin, 0.0))]
    if epsg is not None:
        fields += [(_KEYS, 3, (1, 1, 0, 1, _PROJECTED, 0, 1, epsg))]
    fields.sort()
    at = 8 + len(body) + len(body) % 2
    extra = at + 2 + 12 * len(fields) + 4
    entries, more = b"", b""
    for tag, kind, values in fields:
        packed = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
        if len(packed) <= 4:
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, len(values), extra + len(more))
            more += packed + b"\0" * (len(packed) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + more


def as_tiff(px: DataFrame, keys: list[str], bands: list[str], **options) -> DataFrame:
    """keys and tiff, a file for each of them (K10): yy and xx count from 0 in a file, bands are columns of 8 bits; options are those of encoded."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(pdf["yy"].max()) + 1, int(pdf["xx"].max()) + 1, len(bands)), "u1")
        image[pdf["yy"], pdf["xx"]] = pdf[bands].to_numpy()
        return pdf[keys].head(1).assign(tiff=[encoded(image, **options)])

    kinds = ", ".join(f"`{k}` {px.schema[k].dataType.simpleString()}" for k in keys)
    return px.select(*keys, "yy", "xx", *bands).groupBy(*keys).applyInPandas(one, f"{kinds}, tiff binary")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(root).select("path", "content")


def descriptions(spark: SparkSession, root: str, unit: str | None = None) -> DataFrame:
    """path, height, width, bands, origin_x, origin_y, mppx, epsg (S5, S6): metres a pixel, null without a scale. The unit is the file's own
    unless one is given, and metres if it names none; epsg is null where the file has no such number."""
    if unit is not None and unit not in _NAMED:
        raise ValueError("a raster's unit has to be metre or foot")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                _, t = tags(data)
                origin = t.get(_TIEPOINT, (None,) * 6)
                epsg, own = reference(t)
                metres = _NAMED[unit] if unit else own or 1.0
                rows.append((path, t[_HEIGHT][0], t[_WIDTH][0], t.get(_BANDS, (1,))[0], origin[3], origin[4], t[_SCALE][0] * metres if _SCALE in t else None, epsg))
            out = pd.DataFrame(rows, columns=["path", "height", "width", "bands", "origin_x", "origin_y", "mppx", "epsg"])
            yield out.astype({"epsg": "Int32"})

    return _files(spark, root).mapInPandas(each, "path string, height int, width int, bands int, origin_x double, origin_y double, mppx double, epsg int")


def pixels(spark: SparkSession, root: str, box: tuple[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """path, yy, xx, bands of a window ((x, y), (w, h)) or of whole rasters (S3); a window beyond an edge is cut there."""
    (x, y), (w, h) = box or ((0, 0), (1 << 31, 1 << 31))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                image = window(data, x, y, w, h)
                wide = image.shape[1]
                lines = max(1, 100_000 // max(1, wide))
                for i in range(0, image.shape[0], lines):
                    part = image[i : i + lines].astype(float)
                    yy, xx = np.indices(part.shape[:2])
                    yield pd.DataFrame({"path": path, "yy": y + i + yy.ravel(), "xx": x + xx.ravel(), "bands": list(part.reshape(-1, part.shape[2]))})

    return _files(spark, root).mapInPandas(each, "path string, yy long, xx long, bands array<double>")
