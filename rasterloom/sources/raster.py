"""Rasters as a data source of Spark, read by ranges of bytes; and files written with a commit at the end.

    raster.register(spark)
    spark.read.format("raster").load("s3://bucket/mosaic").where("yy between 100 and 199 and xx < 512")
    files.write.format("raster_files").mode("append").save("s3://bucket/tiles")

Paths are plain ones, or URIs of the file systems that Arrow knows (file, s3, gs, hdfs, abfs), in readers and writers alike.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from rasterloom.sources import tiff

#: Pixels of a partition at most, where strips or tiles aren't larger; pixels of an Arrow batch; bytes of a page of small reads.
PART, BATCH, PAGE = 1 << 22, 1 << 16, 1 << 16
#: Small files, of a sixteenth of PART in bytes at most, share a partition: as many bytes as PART and no more files than this.
FILES = 512
_SCHEMA = "path string, yy bigint, xx bigint, bands array<double>, valid boolean"


class Ranges:
    """A file whose bytes are read by slices: short ones through pages that are kept, long ones as they are."""

    def __init__(self, file) -> None:
        self.file, self.size, self.pages, self.read = file, file.size(), {}, 0

    def _bytes(self, start: int, end: int) -> bytes:
        self.read += end - start
        return self.file.read_at(end - start, start)

    def __getitem__(self, part: slice) -> bytes:
        start, end, _ = part.indices(self.size)
        if end - start > PAGE:
            return self._bytes(start, end)
        out = b""
        for n in range(start // PAGE, -(-end // PAGE)):
            if n not in self.pages:
                self.pages[n] = self._bytes(n * PAGE, min(self.size, (n + 1) * PAGE))
            out += self.pages[n][max(start - n * PAGE, 0) : end - n * PAGE]
        return out


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Box(InputPartition):
    """A part of a file: whole strips or tiles, cut to what is asked for."""

    path: str
    x: int
    y: int
    w: int
    h: int


@dataclass
class Whole(InputPartition):
    """Small files, each asked for whole."""

    paths: list[str]


class RasterReader(DataSourceReader):
    """TIFF and BigTIFF files below a folder. A partition is a box of strips or tiles; comparisons of yy and xx with numbers leave out the
    boxes that they can't hold, and cut the rest. Planning reads headers, from the driver; tasks read what their box touches. Small files share
    a partition, and their headers are read by its task alone.

    valid is false where all bands have the file's number for no data (or that of the option nodata), or its alpha is 0.
    """

    def __init__(self, options: dict) -> None:
        self.root, self.pattern, self.asked = options["path"], options.get("glob", "*.tif*"), options.get("nodata")
        self.low, self.high = {"yy": 0, "xx": 0}, {"yy": 1 << 62, "xx": 1 << 62}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            number = getattr(f, "value", None)
            if name not in self.low or not isinstance(number, int) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low[name], number + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high[name] = min(self.high[name], number + 1 - isinstance(f, LessThan))

    def partitions(self) -> list[Box]:
        system, root = _place(self.root)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern)]
        boxes, few, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.size <= PART // 16:
                if few and (len(few) == FILES or size + f.size > PART):
                    boxes.append(Whole(few))
                    few, size = [], 0
                few.append(f.path)
                size += f.size
                continue
            with system.open_input_file(f.path) as file:
                boxes += self.boxes(f.path, tiff.tags(Ranges(file))[1])
        return boxes + [Whole(few)] * bool(few)

    def boxes(self, path: str, t: dict[int, tuple]) -> list[Box]:
        """The boxes of a file that can hold what is asked for."""
        found = []
        step_y, step_x = tiff.chunks(t)
        lines, columns = max(1, PART // max(1, step_y * t[tiff._WIDTH][0])) * step_y, max(1, PART // (step_y * step_x)) * step_x
        for y in range(0, t[tiff._HEIGHT][0], lines):
            for x in range(0, t[tiff._WIDTH][0], columns):
                top, left = max(y, self.low["yy"]), max(x, self.low["xx"])
                bottom, right = min(y + lines, t[tiff._HEIGHT][0], self.high["yy"]), min(x + columns, t[tiff._WIDTH][0], self.high["xx"])
                if top < bottom and left < right:
                    found.append(Box(path, left, top, right - left, bottom - top))
        return found

    def read(self, partition: Box | Whole | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no box at all
            return
        system, _ = _place(self.root)
        if isinstance(partition, Box):
            with system.open_input_file(partition.path) as file:
                yield from self.batches(partition, Ranges(file))
            return
        held, n = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                data = Ranges(file)
                for box in self.boxes(path, tiff.tags(data)[1]):
                    for batch in self.batches(box, data):
                        held.append(batch)
                        n += len(batch)
                        if n >= BATCH:
                            yield pa.concat_batches(held)
                            held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    def batches(self, box: Box, data: Ranges) -> Iterator[pa.RecordBatch]:
        _, t = tiff.tags(data)
        nothing = float(self.asked) if self.asked is not None else tiff.no_data(t)
        clear = tiff.alpha(t)
        lines = max(1, BATCH // box.w)
        step, _ = tiff.chunks(t)
        lines = max(lines // step, 1) * step  # whole strips or tiles, so that none is decoded twice
        at = box.y
        while at < box.y + box.h:
            end = min((at // lines + 1) * lines, box.y + box.h)
            image = tiff.window(data, box.x, at, box.w, end - at)
            flat = image.reshape(-1, image.shape[2]).astype(np.float64)
            valid = np.ones(len(flat), bool)
            colour = flat if clear is None else np.delete(flat, clear, 1)
            if nothing is not None:
                valid &= ~((colour == nothing) | (np.isnan(colour) & np.isnan(nothing))).all(1)
            if clear is not None:
                valid &= flat[:, clear] != 0
            yy, xx = np.indices(image.shape[:2])
            for i in range(0, len(flat), BATCH):
                part = slice(i, i + BATCH)
                n = len(flat[part])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat[part].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([box.path] * n), pa.array(at + yy.ravel()[part]), pa.array(box.x + xx.ravel()[part]), bands, pa.array(valid[part])], ["path", "yy", "xx", "bands", "valid"])
            at = end


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Files of rows with a path and their bytes, below a folder. Tasks write under names of their own beside it; the commit moves all of them to
    their places, so a task that runs twice or a job that fails leaves no part of a file there."""

    def __init__(self, root: str) -> None:
        self.root, self.job = root.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, root = _place(self.root)
        done = []
        for row in iterator:
            path, content = row[0], row[1]
            if posixpath.isabs(path) or ".." in path.split("/"):
                raise ValueError(f"not a path below the folder: {path}")
            own = f"{root}/{self.job}/{uuid.uuid4().hex}"
            system.create_dir(posixpath.dirname(own), recursive=True)
            with system.open_output_stream(own) as out:
                out.write(bytes(content))
            done.append((own, f"{root}/{path}"))
        return Written(done)

    def commit(self, messages: list) -> None:
        system, root = _place(self.root)

        def move(pair: tuple[str, str]) -> None:
            system.create_dir(posixpath.dirname(pair[1]), recursive=True)
            system.move(*pair)

        with ThreadPoolExecutor(16) as pool:
            for message in messages:
                list(pool.map(move, message.files if message else ()))  # a move that failed is raised here
        self._clear(system, root)

    def abort(self, messages: list) -> None:
        self._clear(*_place(self.root))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class Raster(DataSource):
    """Pixels of rasters (S3, S12): path, yy, xx, bands and valid."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options)


class RasterFiles(DataSource):
    """Files from rows of a path and their bytes."""

    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Raster, RasterFiles):
        spark.dataSource.register(source)
