"""Directory listings, and small text formats, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import text as X


def listing(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """path, name, folder of the files below root whose name fits a pattern, case counting (S1, S2); contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    return files.select("path", X.base_name(F.col("path")).alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -3).alias("group"), "modificationTime", "length")


def first_file(files: DataFrame) -> DataFrame:
    """The first path in order."""
    return files.agg(F.min("path").alias("path"))


def corners(lines: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """key, and x and y of each corner in the text output of a raster's description (S9): a line a corner, numbers in the
    first brackets."""
    names = {"Upper Left": "ul", "Lower Left": "ll", "Upper Right": "ur", "Lower Right": "lr"}
    pair = F.split(F.regexp_extract(text, r"\((.*?)\)", 1), ",")
    number = lambda name, i: F.max(F.when(F.col(text).startswith(name), F.trim(pair[i]).cast("double")))
    return lines.groupBy(key).agg(*(number(name, i).alias(f"{short}_{axis}") for name, short in names.items() for i, axis in enumerate("xy")))


def palette(lines: DataFrame, text: str = "value") -> DataFrame:
    """pct, r, g, b of a palette's lines: `N% r g b`, `nv` standing for 0 (S11). Other lines are left out."""
    parts = F.split(F.trim(text), r"\s+")
    pct = F.when(parts[0] == "nv", F.lit(0.0)).otherwise(F.regexp_extract(parts[0], r"^(\d+(?:\.\d+)?)%$", 1).try_cast("double"))
    rows = lines.where(F.size(parts) >= 4).select(pct.alias("pct"), *(parts[i].try_cast("int").alias(n) for i, n in ((1, "r"), (2, "g"), (3, "b"))))
    return rows.where("pct is not null and r is not null and g is not null and b is not null")


def map_data(files: DataFrame, text: str = "value") -> DataFrame:
    """center_x, center_y, proj4 of whole map-data files."""
    found = F.from_json(F.col(text), "struct<ODMCenter:array<double>, PROJ4:string>")
    return files.select(found["ODMCenter"][0].alias("center_x"), found["ODMCenter"][1].alias("center_y"), found["PROJ4"].alias("proj4"))


def legacy_outlines(files: DataFrame, text: str = "value") -> DataFrame:
    """seq and points in metres of whole outline files."""
    found = F.from_json(F.col(text), "struct<contours:array<struct<pts_m:array<array<double>>>>>")
    rows = files.select(F.posexplode(found["contours"]).alias("seq", "c"))
    return rows.select("seq", F.transform("c.pts_m", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))


def manifest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line a row, as a text sink takes it (K7)."""
    return rows.select(F.concat_ws(",", *(F.col(c).cast("string") for c in columns)).alias("value"))
