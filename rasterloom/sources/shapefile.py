"""Polygons and attributes of shapefiles (S7): only outer rings, features without a shape left out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shapes(data: bytes) -> list[list[tuple[float, float]] | None]:
    """The first ring of every record of a .shp file, None for a record without a shape."""
    found, at = [], 100
    while at + 8 <= len(data):
        words = struct.unpack(">i", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            found.append(None)
            continue
        parts, points = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        first = 44 + 4 * parts
        found.append([struct.unpack("<2d", body[first + 16 * i : first + 16 * i + 16]) for i in range(starts[0], starts[1])])
    return found


def attributes(data: bytes) -> list[dict[str, str]]:
    """The fields of every record of a .dbf file, as text."""
    count, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        place, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = data[place : place + width].decode("latin-1").strip()
            place += width
        rows.append(row)
    return rows


def features(spark: SparkSession, root: str) -> DataFrame:
    """path, seq, attributes and points of the polygons below root. Both files of a pair are joined by their common name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").option("recursiveFileLookup", "true").load(root).select("path", "content")
    named = files.select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("path"), F.regexp_extract("path", r"\.(shp|dbf)$", 1).alias("kind"), "content")
    pairs = named.groupBy("path").agg(*(F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("shp", "dbf")))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, shp, dbf in zip(f["path"], f["shp"], f["dbf"], strict=True):
                found = shapes(shp)
                about = attributes(dbf) if dbf is not None else [{}] * len(found)
                rows = [(path, i, about[i], [{"x": x, "y": y} for x, y in ring]) for i, ring in enumerate(found) if ring is not None]
                yield pd.DataFrame(rows, columns=["path", "seq", "attributes", "points"])

    return pairs.where("shp is not null").mapInPandas(each, "path string, seq int, attributes map<string,string>, points array<struct<x:double,y:double>>")
