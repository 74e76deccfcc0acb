"""Augmenting samples, and putting predictions together over scales and super-tiles."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import tiling
from rasterloom.operators.pixels import mean_field


class Model(Protocol):
    """Changes the value column of rows of windows (M1, M2); post turns a field's column into a result."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...

    def post(self, p: Column) -> Column: ...


class Augmentation(Protocol):
    """A seeded change of samples, the same on every run (M4)."""

    def __call__(self, px: DataFrame, epoch: int) -> DataFrame: ...


def draw(seed: int, epoch: int, key: str, n: int) -> Column:
    """A number below n for each key, by the MD5 of seed, epoch and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % n


def drawn(px: DataFrame, **draws: Column) -> DataFrame:
    """px with draws as columns. Each is computed once a row, however often it is used later: plans would copy it to every use, but don't copy through explode."""
    return px.withColumn("_drawn", F.explode(F.array(F.struct(*(c.alias(n) for n, c in draws.items()))))).select(*px.columns, "_drawn.*")


def turned(px: DataFrame, side: int, seed: int, epoch: int) -> DataFrame:
    """Each square image in one of the eight orientations, as drawn."""
    spots = tiling.orientations(F.col("yy"), F.col("xx"), side)
    pick = lambda axis: F.coalesce(*(F.when(F.col("_o") == o, s[axis]) for o, s in enumerate(spots)))
    return drawn(px, _o=draw(seed, epoch, "img", 8)).withColumns({"yy": pick(0), "xx": pick(1)}).drop("_o")


def shifted_crop(px: DataFrame, height: int, width: int, most: int, seed: int, epoch: int) -> DataFrame:
    """The window of height x width pixels that begins at a drawn place, up to `most` from the corner."""
    px = px.where(F.col("yy").between(0, height + most - 1) & F.col("xx").between(0, width + most - 1))  # others are in no window
    rows = drawn(px, _y=draw(seed, epoch, "img", most + 1), _x=draw(seed + 1, epoch, "img", most + 1))
    rows = rows.withColumns({"yy": F.col("yy") - F.col("_y"), "xx": F.col("xx") - F.col("_x")}).drop("_y", "_x")
    return rows.where((F.col("yy") >= 0) & (F.col("yy") < height) & (F.col("xx") >= 0) & (F.col("xx") < width))


def turned_by(px: DataFrame, height: int, width: int, angle: Column, scale: Column, value: str = "v") -> DataFrame:
    """Each image turned about its centre by an angle in degrees and enlarged by a scale, both columns that hold for the whole image (F27); what comes
    from outside is 0."""
    y, x = F.col("yy") - (height - 1) / 2, F.col("xx") - (width - 1) / 2
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    places = px.select("img", "yy", "xx", ((c * y - s * x) / scale + (height - 1) / 2).alias("sy"), ((s * y + c * x) / scale + (width - 1) / 2).alias("sx"))
    return tiling.warped(px, places, value)


def chained(px: DataFrame, steps: list[Augmentation], epoch: int) -> DataFrame:
    """Several augmentations, one after the other."""
    for step in steps:
        px = step(px, epoch)
    return px


def prepared(images: DataFrame, masks: DataFrame, classes: int, augment: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """img, yy, xx, v, p: complete samples with one number a class, augmented together, values as a part of 1."""
    from rasterloom.operators.pixels import fraction, one_hot

    rows = images.join(masks, ["img", "yy", "xx"])
    rows = augment(rows) if augment else rows
    return rows.select("img", "yy", "xx", fraction(F.col("v")).alias("v"), one_hot(F.col("mv"), classes).alias("p"))


def multi_scale(px: DataFrame, height: int, width: int, factors: list[float], window: int, model: Callable[[DataFrame], DataFrame], value: str = "v", smooth: bool = False) -> DataFrame:
    """The mean of a model's blended fields over scales of 1 / factor (T7, T9, A7). Images are shrunk by means, and fields are spread again, by single
    pixels or smooth by cubic taps. Factors that divide no side evenly are smooth in any case."""
    fields = []
    for f in factors:
        whole = float(f).is_integer() and not (height % f or width % f)
        h, w = (height // int(f), width // int(f)) if whole else (max(1, round(height / f)), max(1, round(width / f)))
        small = px.select("img", "yy", "xx", value) if f == 1 else tiling.shrunk(px, int(f), value) if whole else tiling.resampled(px, height, width, h, w, "area", value)
        field = tiling.blend(small, h, w, window, value, model)
        if f != 1:
            field = tiling.resampled(field, h, w, height, width, "cubic", value) if smooth or not whole else tiling.nearest(field, h, w, height, width, value)
        fields.append(field)
    return mean_field([x.select("img", "yy", "xx", F.col(value).cast("double").alias(value)) for x in fields], ["img", "yy", "xx"], value)


def by_super_tile(px: DataFrame, images: DataFrame, tile: int) -> DataFrame:
    """px with the super-tile that each pixel is in, and its place there (T4, T10): tiles meet, they don't overlap."""
    boxes = tiling.clamped_boxes(images, tile).select("img", "bx", "by", "ty", "tx")
    size = images.select("img", "height", "width")
    # the centred grid's first starts are the same for every tile of an image
    lead = lambda n: F.floor(((F.greatest(F.lit(1), F.ceil((n - tile) / tile) + 1) - 1) * tile + tile - n) / 2)
    rows = px.join(size, "img").withColumns({"ty": F.floor((F.col("yy") + lead(F.col("height"))) / tile).cast("int"), "tx": F.floor((F.col("xx") + lead(F.col("width"))) / tile).cast("int")})
    return rows.drop("height", "width").join(boxes, ["img", "ty", "tx"]).withColumns({"iy": F.col("yy") - F.col("by"), "ix": F.col("xx") - F.col("bx")}).drop("by", "bx")


def resumed(ids: DataFrame, folder: str, name: str, make: Callable[[DataFrame], DataFrame], parts: int = 1, key: str = "img") -> DataFrame:
    """make(ids) as a table that is kept in the folder under a name, which should tell inputs and parameters.

    Ids of which the table has rows are not made again. The others are made in parts by a hash of their id, each committed by itself, so
    a run that is killed goes on after its last whole part. Several runs at once aren't kept apart.
    """
    spark, path = ids.sparkSession, f"{folder.rstrip('/')}/{name}.parquet"

    def kept() -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    for part in range(parts):
        asked, before = ids.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part), kept()
        todo = asked if before is None else asked.join(before.select(key).distinct(), key, "left_anti")
        if not todo.isEmpty():
            make(todo).write.mode("append").parquet(path)
    found = kept()
    return make(ids.limit(0)) if found is None else found.join(ids.select(key).distinct(), key, "left_semi")
