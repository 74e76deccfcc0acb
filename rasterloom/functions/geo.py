"""Tiles of the world: mercator and geodetic grids, affine transforms, map windows. Columns in, columns out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256
RADIUS = 6378137.0
SHIFT = math.pi * RADIUS
#: Where the square mercator world ends.
MOST_LAT = 85.05112878


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres east and north of a place."""
    north = F.log(F.tan((lat + 90) * (math.pi / 360))) * (180 / math.pi)
    return lon * (SHIFT / 180), north * (SHIFT / 180)


def place(mx: Column, my: Column) -> tuple[Column, Column]:
    """Latitude and longitude of metres."""
    lat = F.atan(F.exp(my / SHIFT * math.pi)) * (360 / math.pi) - 90
    return lat, mx / SHIFT * 180


def resolution(zoom: Column) -> Column:
    """Metres a pixel."""
    return F.lit(2 * SHIFT / TILE) / F.pow(F.lit(2.0), zoom)


def to_pixels(m: Column, zoom: Column) -> Column:
    return (m + SHIFT) / resolution(zoom)


def to_metres(px: Column, zoom: Column) -> Column:
    return px * resolution(zoom) - SHIFT


def tile_of(px: Column) -> Column:
    """The tile that a pixel is in; pixel 0 is in tile -1 (F32)."""
    return (F.ceil(px / TILE) - 1).cast("long")


def from_top(py: Column, zoom: Column) -> Column:
    """A pixel row counted from the top."""
    return F.lit(TILE) * F.pow(F.lit(2.0), zoom) - py


def tile_bounds(tx: Column, ty: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a tile in metres."""
    return to_metres(tx * TILE, zoom), to_metres(ty * TILE, zoom), to_metres((tx + 1) * TILE, zoom), to_metres((ty + 1) * TILE, zoom)


def tile_places(tx: Column, ty: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of a tile in degrees."""
    west, south, east, north = tile_bounds(tx, ty, zoom)
    return *place(west, south), *place(east, north)


def zoom_for(pixel: Column, first: float = 2 * SHIFT / TILE) -> Column:
    """The deepest zoom whose resolution is at least the pixel's size, 0 at least; null beyond zoom 31."""
    over = F.get(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: pixel > F.lit(first) / F.pow(F.lit(2.0), i)), F.lit(0))
    return F.when(over.isNotNull(), F.greatest(over - 1, F.lit(0)))


def flipped(ty: Column, zoom: int) -> Column:
    """A tile row counted from the other end."""
    return F.lit((1 << zoom) - 1) - ty


def quadkey(tx: Column, ty: Column, zoom: int) -> Column:
    """The digits of a tile's path from the root; ty counts from the south."""
    y = flipped(ty, zoom)
    digits = [F.shiftright(tx.cast("long"), i).bitwiseAND(F.lit(1)) + F.shiftright(y.cast("long"), i).bitwiseAND(F.lit(1)) * 2 for i in range(zoom - 1, -1, -1)]
    return F.concat_ws("", *(d.cast("string") for d in digits))


def geodetic_resolution(zoom: Column, wide: bool = True) -> Column:
    """Degrees a pixel; wide: zoom 0 has two tiles."""
    return F.lit((180.0 if wide else 360.0) / TILE) / F.pow(F.lit(2.0), zoom)


def geodetic_tile(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """The tile of a place in the geodetic grid."""
    r = geodetic_resolution(zoom)
    return tile_of((lon + 180) / r), tile_of((lat + 90) / r)


def geodetic_bounds(tx: Column, ty: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a geodetic tile."""
    r = geodetic_resolution(zoom) * TILE
    return tx * r - 180, ty * r - 90, (tx + 1) * r - 180, (ty + 1) * r - 90


def raster_zoom(width: Column, height: Column) -> Column:
    """The zoom at which a raster has its own size in tiles."""
    return F.greatest(F.ceil(F.log2(width / TILE)), F.ceil(F.log2(height / TILE)), F.lit(0)).cast("int")


def map_window(left, top, right, bottom, west, north, pixel: float, width: int, height: int) -> dict[str, Column]:
    """The raster window under a map extent, clipped to the raster, and where it lies in a picture of that extent.

    Offsets and sizes are cut to whole pixels after adding 0.001 and 0.5. What lies outside moves the picture's start and
    shrinks its size.
    """
    whole = lambda c: c.cast("int")
    rx, ry = whole((left - west) / pixel + 0.001), whole((north - top) / pixel + 0.001)
    rw, rh = whole((right - left) / pixel + 0.5), whole((top - bottom) / pixel + 0.5)
    out = {}
    for axis, at, size, limit in (("x", rx, rw, width), ("y", ry, rh, height)):
        before = F.greatest(-at, F.lit(0))
        start = F.greatest(at, F.lit(0))
        cut = F.greatest(size - before, F.lit(0))
        kept = F.greatest(F.least(cut, F.lit(limit) - start), F.lit(0))
        out |= {f"r{axis}": start, f"w{axis}": before, f"n{axis}": kept}
    return out


def pixel_of(x: Column, y: Column, t: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """The pixel of a map point by the inverse of an affine transform, half a pixel added and cut."""
    x0, a, b, y0, c, d = t
    det = a * d - b * c
    dx, dy = x - x0, y - y0
    return ((dx * d - dy * b) / det + 0.5).cast("int"), ((dy * a - dx * c) / det + 0.5).cast("int")


def outline_pixels(points: Column, extent: tuple[float, float, float, float], width: int, height: int) -> Column:
    """Points in metres as pixels of an image over an extent (west, south, east, north), y downwards, cut."""
    west, south, east, north = extent
    kx, ky = (width - 1) / (east - west), (height - 1) / (north - south)
    return F.transform(points, lambda p: F.struct(((p["x"] - west) * kx).cast("int").alias("x"), ((F.lit(north) - p["y"]) * ky).cast("int").alias("y")))


def moved(points: Column, dx, dy) -> Column:
    """Points by an offset."""
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rescaled(points: Column, factor) -> Column:
    """Points by a factor, cut to whole numbers."""
    return F.transform(points, lambda p: F.struct((p["x"] * factor).cast("int").alias("x"), (p["y"] * factor).cast("int").alias("y")))


def world(lat: Column, lon: Column, mercator_limits: bool = True) -> tuple[Column, Column]:
    """A place within the limits of the world."""
    most = MOST_LAT if mercator_limits else 90.0
    return F.greatest(F.lit(-most), F.least(F.lit(most), lat)), F.greatest(F.lit(-180.0), F.least(F.lit(180.0), lon))


# WGS 84 and the coefficients of the series that follow from its flattening.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def transverse(lat: Column, lon: Column, middle: float, scale: float = 0.9996, east: float = 500000.0, north: float = 0.0) -> tuple[Column, Column]:
    """Easting and northing in a transverse mercator grid, by the series in the third flattening."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - middle)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a
        y = y + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a
    return x * (scale * _RECT) + east, y * (scale * _RECT) + north


def transverse_inverse(x: Column, y: Column, middle: float, scale: float = 0.9996, east: float = 500000.0, north: float = 0.0) -> tuple[Column, Column]:
    """Latitude and longitude of a transverse mercator place."""
    xi, eta = (y - north) / (scale * _RECT), (x - east) / (scale * _RECT)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b
        v = v - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.sin(chi * 2 * j) * d
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(v), F.cos(u))) + middle
