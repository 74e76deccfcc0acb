"""Rasterising by runs and tiles by place, against brute force; both stay cheap where they are large."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import annotations, regions, tiling


def filled(points, height, width):
    """Pixels inside by the even-odd rule, or on an edge."""
    out = set()
    for y in range(height):
        for x in range(width):
            odd = on = False
            for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
                side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                odd ^= (ay <= y < by and side > 0) or (by <= y < ay and side < 0)
                on |= side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
            if odd or on:
                out.add((y, x))
    return out


def test_rasterise(spark):
    rng = random.Random(8)
    shapes = []
    for name in range(12):
        for seq in range(rng.randrange(1, 4)):
            n = rng.choice([1, 2, 3, 4, 7, 12])
            shapes.append((f"i{name}", seq, rng.randrange(3), [(rng.randrange(-6, 30), rng.randrange(-6, 24)) for _ in range(n)]))
    shapes += [("same", 0, 1, [(1, 1), (9, 1), (9, 9)]), ("same", 0, 1, [(1, 1), (9, 1), (9, 9)]), ("none", 0, 1, []), ("none", 1, 1, None), ("far", 0, 2, [(50, 50), (60, 50), (60, 70)])]
    df = spark.createDataFrame(shapes, "name string, seq int, cls int, points array<struct<x:int,y:int>>").repartition(3)
    want = {}
    for name, seq, cls, points in sorted(shapes, key=lambda s: s[:3]):
        for p in filled(points or [], 18, 24):
            want[name, *p] = cls
    found = {(r.name, r.yy, r.xx): r.cls for r in annotations.rasterise(df, 18, 24, ["name"]).collect()}
    assert found == want


def test_long_outline(spark):
    """A thousand points in a box of 480 x 480: some seconds at most, whatever the machine."""
    rng = np.random.default_rng(1)
    angle = np.sort(rng.random(1000)) * 2 * np.pi
    far = 100 + 130 * rng.random(1000)
    points = [(int(240 + r * np.cos(a)), int(240 + r * np.sin(a))) for a, r in zip(angle, far, strict=True)]
    df = spark.createDataFrame([("i", 0, 1, points)], "name string, seq int, cls int, points array<struct<x:int,y:int>>")
    start = time.perf_counter()
    n = annotations.rasterise(df, 480, 480, ["name"]).count()
    assert 30_000 < n < 170_000 and time.perf_counter() - start < 30


@pytest.mark.parametrize(("height", "width", "tile"), [(9, 14, 4), (5, 5, 8), (6, 12, 6)])
def test_tiles(spark, height, width, tile):
    rng = np.random.default_rng(4)
    image = rng.integers(-5, 100, (height, width))
    rows = [(1, y, x, int(image[y, x]) if (y, x) != (0, 0) else None) for y in range(height) for x in range(width)]
    tiles = tiling.tiles_of(spark.createDataFrame(rows, "img int, yy long, xx long, v int"), height, width, tile)
    assert dict(tiles.dtypes)["data"] == "array<int>"
    y0, x0 = (tiling.axis_starts(n, tile, tile)[0] for n in (height, width))
    image[0, 0] = 0
    for r in tiles.collect():
        want = np.zeros((tile, tile), int)
        for i in range(tile):
            for j in range(tile):
                y, x = y0 + r.ty * tile + i, x0 + r.tx * tile + j
                if 0 <= y < height and 0 <= x < width:
                    want[i, j] = image[y, x]
        assert np.array_equal(np.reshape(r.data, (tile, tile)), want)
    back = {(r.yy, r.xx): r.v for r in tiling.pixels_of(tiles, height, width, tile).collect()}
    assert back == {(y, x): image[y, x] for y in range(height) for x in range(width)}


def test_large_tile(spark):
    """Tiles of 512 in an image of 1,024 x 1,024 take seconds."""
    n = 1024
    px = spark.range(n * n).select(F.lit(1).alias("img"), F.floor(F.col("id") / n).alias("yy"), (F.col("id") % n).alias("xx"), (F.col("id") % 251).cast("int").alias("v"))
    start = time.perf_counter()
    found = tiling.tiles_of(px, n, n, 512).select(F.size("data").alias("n"), F.aggregate("data", F.lit(0).cast("long"), lambda s, x: s + x).alias("s")).collect()
    assert len(found) == 4 and all(r.n == 512 * 512 for r in found) and sum(r.s for r in found) == sum(i % 251 for i in range(n * n))
    assert time.perf_counter() - start < 60


def test_simplify(spark):
    """Level by level as in one go, with repeated points, far points that tie, and outlines of several sizes."""
    rng = random.Random(5)
    shapes = [(i, [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.choice([1, 2, 3, 4, 5, 30, 90]))]) for i in range(40)]
    shapes += [(100, [(0, 0)] * 9), (101, [(0, 0), (9, 0), (9, 9), (0, 9)] * 3), (102, [(int(200 + 150 * np.cos(a / 60)), int(200 + 90 * np.sin(a / 60))) for a in range(377)]), (103, [])]
    df = spark.createDataFrame(shapes, "id int, points array<struct<x:int,y:int>>").repartition(3)
    for most in (0.0, 1.0, 6.5):
        found = {r.id: [tuple(p) for p in r.points] for r in regions.simplify(df, most).collect()}
        assert found == {i: regions.simplified(p, most) for i, p in shapes}


@pytest.mark.parametrize("kernel", ["area", "linear", "cubic", "lanczos"])
def test_taps(kernel):
    """Weights of a new place add up to 1; a constant stays, and with linear ones a slope does too inside an image; area keeps the mean."""
    for old, new in ((10, 7), (7, 10), (12, 12), (40, 13), (5, 1)):
        w = np.zeros((new, old))
        for at, to, x in tiling.taps(old, new, kernel):
            w[to, at] += x
        assert np.allclose(w.sum(1), 1)
        at = (np.arange(new) + 0.5) * old / new - 0.5
        inner = (at > 1) & (at < old - 2)
        if kernel == "linear":
            assert np.allclose((w @ np.arange(old))[inner], at[inner])
        if kernel == "area":
            assert np.allclose(w.sum(0) * old / new, 1)
    with pytest.raises(ValueError):
        tiling.taps(4, 2, "other")


def test_warped(spark):
    """A slope is the same slope wherever it is asked for; outside counts as told; several askers of one place each get it."""
    px = spark.createDataFrame([(1, y, x, 3 * x + 5 * y) for y in range(6) for x in range(8)], "img int, yy long, xx long, v int")
    asked = [(1, "a", 2.25, 3.5), (1, "b", 0.0, 0.0), (1, "b2", 0.0, 0.0), (1, "c", 5.0, 7.0), (1, "d", -1.0, 2.0), (1, "e", 4.5, 7.5), (2, "f", 1.0, 1.0)]
    places = spark.createDataFrame(asked, "img int, name string, sy double, sx double")
    found = {r.name: r.v for r in tiling.warped(px, places, outside=100.0).collect()}
    assert found == {"a": 21.75, "b": 0, "b2": 0, "c": 46, "d": 100, "e": (3 * 7 + 5 * 4.5) / 2 + 50, "f": 100}


def test_mercator_of_a_transverse_grid(spark):
    """A slope over a transverse mercator raster, brought to mercator tiles: each pixel has the slope's value at its own place."""
    from rasterloom.functions import geo
    from rasterloom.operators import publishing

    middle, x0, y0, step = 9.0, 500_300.0, 5_400_900.0, 25.0
    px = spark.createDataFrame([(1, y, x, 2.0 * x + 7.0 * y) for y in range(30) for x in range(40)], "img int, yy long, xx long, v double")
    rasters = spark.createDataFrame([(1, 30, 40, x0, y0, step)], "img int, height int, width int, x0 double, y0 double, step double")
    found = publishing.mercator_pixels(px, rasters, 14, 64, project=lambda lat, lon: geo.transverse(lat, lon, middle), unproject=lambda x, y: geo.transverse_inverse(x, y, middle))
    z = F.lit(14)
    lat, lon = geo.place(geo.to_metres(F.col("tx") * 256 + (F.col("ix") + 0.5) * 4, z), geo.to_metres((F.col("ty") + 1) * 256 - (F.col("iy") + 0.5) * 4, z))
    x, y = geo.transverse(lat, lon, middle)
    rows = found.select("v", ((x - x0) / step - 0.5).alias("sx"), ((F.lit(y0) - y) / step - 0.5).alias("sy")).collect()
    inner = [r for r in rows if 0 < r.sx < 39 and 0 < r.sy < 29]
    # a pixel of zoom 14 in quarters is 38 m at the equator and 25 m here: nearly one for each of the raster's
    assert len(inner) > 800 and all(abs(r.v - 2 * r.sx - 7 * r.sy) < 1e-6 for r in inner) and len(rows) > len(inner)
