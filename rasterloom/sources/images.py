"""PNG and JPEG images. Spark's own image source decodes them; many PNG files are written, listed and read by tasks, which hold their pixels."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.staging import by_groups

# A PNG file's first bytes and its colour types by number of bands.
_FIRST = b"\x89PNG\r\n\x1a\n"
_COLOURS = {1: 0, 2: 4, 3: 2, 4: 6}
#: Pixels of an Arrow batch.
_BATCH = 100_000


def encoded(image: np.ndarray) -> bytes:
    """An 8-bit image (height x width x bands of grey, grey and alpha, RGB or RGBA) as a PNG file; lines are stored as differences to the line above."""
    h, w, bands = image.shape
    image = np.ascontiguousarray(image, "u1")
    above = np.concatenate([np.zeros((1, w, bands), "u1"), image[:-1]])
    lines = np.concatenate([np.full((h, 1), 2, "u1"), (image - above).reshape(h, -1)], 1)
    piece = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return _FIRST + piece(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, _COLOURS[bands], 0, 0, 0)) + piece(b"IDAT", zlib.compress(lines.tobytes())) + piece(b"IEND", b"")


def pixels(spark: SparkSession, root: str) -> DataFrame:
    """path, yy, xx, bands of all PNG and JPEG images below a folder (S1, S3): grey, RGB or RGBA; files that aren't images are left out."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # small images share a batch
        for batch in batches:
            for path, h, w, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = np.frombuffer(data, "u1").reshape(h, w, n)
                image = image[..., [2, 1, 0, *range(3, n)]] if n >= 3 else image  # the source gives blue first
                lines = max(1, _BATCH // w)
                for i in range(0, h, lines):
                    part = image[i : i + lines]
                    count = part.shape[0] * w
                    at = np.arange(count)
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype="i4") * n), pa.array(part.astype("i4").ravel()))
                    held.append(pa.RecordBatch.from_arrays([pa.repeat(path, count), pa.array(i + at // w), pa.array(at % w), bands], ["path", "yy", "xx", "bands"]))
                    size += count
                    if size >= _BATCH:
                        yield pa.concat_batches(held)
                        held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    parts = rows.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return parts.mapInArrow(each, "path string, yy long, xx long, bands array<int>")


def as_png(px: DataFrame, keys: list[str], bands: list[str], tile: int | None = None) -> DataFrame:
    """keys and png, a file for each of them (K1, K11): yy and xx count from 0 in a file, bands are columns of 8 bits, missing pixels are 0.
    Files have tile by tile pixels, or as many as there are."""

    def some(table: pa.Table) -> Iterator[pa.Table]:
        starts = np.flatnonzero(table.column("_n").to_numpy() == 1)
        yy, xx = (table.column(c).to_numpy() for c in ("yy", "xx"))
        colours, made = np.stack([table.column(b).to_numpy(zero_copy_only=False) for b in bands], 1), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            y, x = yy[a:b], xx[a:b]
            image = np.zeros((tile or int(y.max()) + 1, tile or int(x.max()) + 1, len(bands)), "u1")
            image[y, x] = colours[a:b]
            made.append(encoded(image))
        yield table.select(keys).take(pa.array(starts)).append_column("png", pa.array(made, pa.binary()))

    kinds = ", ".join(f"`{k}` {px.schema[k].dataType.simpleString()}" for k in keys)
    return by_groups(px.select(*keys, "yy", "xx", *bands), keys, ["yy", "xx"], some, f"{kinds}, png binary")


def _mounted(root: str) -> str:
    if root.split(":")[0] not in (root, "file"):
        raise ValueError("image files can be written to and read by tasks in mounted folders alone")
    return unquote(urlparse(root).path) if "://" in root or root.startswith("file:") else root


def files(spark: SparkSession, root: str, ending: str = ".png") -> DataFrame:
    """path (below root) and content of the files below a folder that all executors share, by the ending of their names.

    The driver sees what lies in root itself, not what lies further below: tasks list its folders and read their files, one folder a task. Spark's own
    sources list every file in the driver, whose memory then grows with their number.
    """
    local = _mounted(root)
    tops = sorted(e.name for e in os.scandir(local) if e.is_dir() or e.name.lower().endswith(ending))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def below(at: str) -> Iterator[str]:
            if not os.path.isdir(f"{local}/{at}"):
                yield at
                return
            for folder, folders, names in os.walk(f"{local}/{at}"):
                folders.sort()
                yield from (os.path.relpath(f"{folder}/{n}", local) for n in sorted(names) if n.lower().endswith(ending))

        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])
        for tops_here in batches:
            held, size = [], 0
            for path in (p for top in tops_here.column(0).to_pylist() for p in below(top)):
                with open(f"{local}/{path}", "rb") as file:
                    held.append((path, file.read()))
                size += len(held[-1][1])
                if size >= 1 << 22 or len(held) >= 4096:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    rows = spark.createDataFrame([(t,) for t in tops], "top string").repartition(max(1, len(tops)))
    return rows.mapInArrow(each, "path string, content binary")


def decoded(data: bytes) -> np.ndarray:
    """A PNG file of 8 bits a band, not interlaced, as height x width x bands, which are those of the file; a palette's colours are RGB."""
    if data[:8] != _FIRST:
        raise ValueError("not a PNG file")
    at, body, colours, last = 8, [], None, False
    while not last:
        if len(data) < at + 12:
            raise ValueError("a PNG file that ends early")
        size, name = struct.unpack(">I4s", data[at : at + 8])
        piece = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + piece) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG file whose checksum is wrong")
        if name == b"IHDR":
            w, h, bits, kind, _, _, woven = struct.unpack(">IIBBBBB", piece)
        elif name == b"PLTE":
            colours = np.frombuffer(piece, "u1").reshape(-1, 3)
        elif name == b"IDAT":
            body.append(piece)
        last, at = name == b"IEND", at + 12 + size
    if bits != 8 or woven:
        raise ValueError("PNG files of other than 8 bits a band, or interlaced, can't be read")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), "u1").reshape(h, 1 + w * bands)
    image = _unfiltered(lines[:, 0], lines[:, 1:].reshape(h, w, bands))
    return colours[image[..., 0]] if kind == 3 else image


def _unfiltered(filters: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Lines as they were before each was stored as differences to what lies left, above or both."""
    if (filters == 2).all():
        return np.add.accumulate(lines, 0, "u1")
    out, above = np.empty_like(lines), np.zeros_like(lines[0])
    for y, (kind, line) in enumerate(zip(filters.tolist(), lines, strict=True)):
        if kind == 1:
            line = np.add.accumulate(line, 0, "u1")
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            rows, over, bands = line.astype(int).tolist(), above.astype(int).tolist(), range(lines.shape[2])
            left = corner = [0] * len(bands)
            for x, (row, up) in enumerate(zip(rows, over, strict=True)):
                if kind == 3:
                    rows[x] = [(row[b] + (left[b] + up[b]) // 2) & 255 for b in bands]
                else:
                    rows[x] = [(row[b] + min((left[b], up[b], corner[b]), key=lambda p, b=b: abs(left[b] + up[b] - corner[b] - p))) & 255 for b in bands]  # noqa: B023
                left, corner = rows[x], up
            line = np.array(rows, "u1")
        elif kind:
            raise ValueError("a PNG file with an unknown filter")
        out[y] = above = line
    return out


def of_png(made: DataFrame, keys: list[str], png: str = "png") -> DataFrame:
    """keys, yy, xx and bands: the pixels of PNG files in a column, what as_png was made of."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
            of, first, parts = zip(*held, strict=True)
            count = [p.shape[0] * p.shape[1] for p in parts]
            at = np.concatenate([np.arange(n) for n in count])
            wide, line = (np.repeat(v, count) for v in ([p.shape[1] for p in parts], first))
            ends = np.cumsum(np.repeat([p.shape[2] for p in parts], count), dtype="i4")
            bands = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(np.concatenate([p.ravel() for p in parts]).astype("i4")))
            told = rows.take(pa.array(np.repeat(of, count)))
            return pa.RecordBatch.from_arrays([*told.columns, pa.array(line + at // wide), pa.array(at % wide), bands], [*keys, "yy", "xx", "bands"])

        for rows in batches:
            held, size, names = [], 0, rows.select(keys)
            for i, data in enumerate(rows.column(len(keys)).to_pylist()):
                image = decoded(data)
                lines = max(1, _BATCH // image.shape[1])
                for y in range(0, image.shape[0], lines):
                    held.append((i, y, image[y : y + lines]))
                    size += held[-1][2].shape[0] * image.shape[1]
                    if size >= _BATCH:
                        yield batch(names, held)
                        held, size = [], 0
            if held:
                yield batch(names, held)

    kinds = ", ".join(f"`{k}` {made.schema[k].dataType.simpleString()}" for k in keys)
    return made.select(*keys, png).mapInArrow(each, f"{kinds}, yy long, xx long, bands array<int>")


def write(files: DataFrame, root: str, path: str = "path", content: str = "png") -> DataFrame:
    """path and size of a file for each row, written below a folder that all executors share.

    Each is written under a name of its own and then moved, so a task that runs twice leaves whole files.
    """
    local = _mounted(root)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for f in frames:
            for name, data in f.itertuples(index=False):
                target = os.path.join(local, name)
                if (folder := os.path.dirname(target)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                own = f"{target}.{uuid.uuid4().hex}"
                with open(own, "wb") as out:
                    out.write(data)
                os.replace(own, target)
            yield pd.DataFrame({"path": f.iloc[:, 0], "size": f.iloc[:, 1].map(len)})

    return files.select(F.col(path), F.col(content)).mapInPandas(each, "path string, size long")
