"""Rasters as published tiles, and height images from what a project has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators.pixels import range_stretch
from rasterloom.operators.tiling import warped


def tiles_at(points: DataFrame, zooms: range, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """z, tx, ty and n: the mercator tiles that hold places, at every zoom, and how many places each has.

    Places are spread over zooms and combined by tile before the shuffle.
    """
    mx, my = geo.mercator(*geo.world(F.col(lat), F.col(lon)))
    rows = points.select(mx.alias("mx"), my.alias("my"), F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[-1]))).alias("z"))
    tile = lambda m: F.greatest(F.lit(0), geo.tile_of(F.round(geo.to_pixels(F.col(m), F.col("z")), 3)))
    return rows.groupBy("z", tile("mx").alias("tx"), tile("my").alias("ty")).agg(F.count("*").alias("n"))


def tile_sets(tiles: DataFrame) -> DataFrame:
    """z, units_per_pixel, n: the levels of a pyramid's description."""
    return tiles.groupBy("z").agg(F.count("*").alias("n")).select("z", geo.resolution(F.col("z")).alias("units_per_pixel"), "n")


def description(levels: DataFrame, title: str) -> DataFrame:
    """One row: the pyramid's description as XML (K12). A row a zoom is collected."""
    line = F.format_string('<TileSet href="%d" units-per-pixel="%.9f" order="%d"/>', "z", "units_per_pixel", "z")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", line.alias("t")))), lambda x: x["t"]), "\n")
    head = f'<TileMap version="1.0.0"><Title>{title}</Title><SRS>EPSG:3857</SRS><TileFormat width="256" height="256" mime-type="image/png" extension="png"/><TileSets profile="mercator">'
    return levels.agg(F.concat(F.lit(head + "\n"), lines, F.lit("\n</TileSets></TileMap>")).alias("xml"))


def bounded_description(levels: DataFrame, places: DataFrame, title: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The description with the bounds of what is published, and their lower corner as origin (K12). As published pyramids have it, x is the
    latitude and y the longitude there. places: latitudes and longitudes of all that lies in the pyramid."""
    edge = places.agg(*(f(c).alias(n) for f, c, n in ((F.min, lat, "_s"), (F.min, lon, "_w"), (F.max, lat, "_n"), (F.max, lon, "_e")))).withColumn("_k", F.lit(1))
    box = F.format_string('<BoundingBox minx="%.14f" miny="%.14f" maxx="%.14f" maxy="%.14f"/><Origin x="%.14f" y="%.14f"/>', "_s", "_w", "_n", "_e", "_s", "_w")
    both = description(levels, title).withColumn("_k", F.lit(1)).join(edge, "_k")  # one row each
    return both.select(F.regexp_replace("xml", F.lit("</SRS>"), F.concat(F.lit("</SRS>"), box)).alias("xml"))


def child_links(tiles: DataFrame) -> DataFrame:
    """z, tx, ty and links: the names of a tile's existing children, in order (K13). A tile has at most four."""
    name = F.format_string("%d/%d/%d.kml", "z", "tx", "ty")
    up = tiles.select((F.col("z") - 1).alias("z"), F.floor(F.col("tx") / 2).alias("tx"), F.floor(F.col("ty") / 2).alias("ty"), name.alias("link"))
    links = up.groupBy("z", "tx", "ty").agg(F.array_sort(F.collect_list("link")).alias("links"))
    return tiles.select("z", "tx", "ty").join(links, ["z", "tx", "ty"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def overlay(tiles: DataFrame) -> DataFrame:
    """z, tx, ty and kml: each tile's document with its bounds and links."""
    south, west, north, east = geo.tile_places(F.col("tx"), F.col("ty"), F.col("z"))
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit("<NetworkLink><Link><href>"), x, F.lit("</href></Link></NetworkLink>"))), "")
    box = F.format_string("<LatLonAltBox><north>%.6f</north><south>%.6f</south><east>%.6f</east><west>%.6f</west></LatLonAltBox>", *(F.round(x, 6) + 0.0 for x in (north, south, east, west)))
    return child_links(tiles).select("z", "tx", "ty", F.concat(F.lit("<kml><Document><Region>"), box, F.lit("</Region>"), links, F.lit("</Document></kml>")).alias("kml"))


def heights(surface: DataFrame, relief: DataFrame, images: DataFrame) -> DataFrame:
    """img, yy, xx, height and source of the images: the stretched surface where an image has one, else the relief's percentage
    of 255 (K3-K5). Neither: no rows."""
    a = range_stretch(surface, "v").select("img", "yy", "xx", F.col("stretched").cast("int").alias("height"), F.lit("surface").alias("source"))
    has = surface.select("img").distinct()
    b = relief.join(has, "img", "left_anti").select("img", "yy", "xx", F.floor(F.col("pct") / 100 * 255).cast("int").alias("height"), F.lit("relief").alias("source"))
    return a.unionByName(b).join(images.select("img").distinct(), "img", "left_semi")


def limits(lat: Column, lon: Column, profile: str) -> tuple[Column, Column]:
    """A place within what a tile profile shows."""
    return geo.world(lat, lon, profile == "mercator")


def pixel_tiles(px: DataFrame, bands: list[str], tile: int) -> DataFrame:
    """img, ty, tx, png: every raster cut into tiles of its pixels, each an image of its own (K11). Tiles at the edges are filled up with 0 and
    have one more band, 255 where there is a pixel and 0 where there is none."""
    from rasterloom.sources.images import as_png

    cut = px.select("img", F.floor(F.col("yy") / tile).alias("ty"), F.floor(F.col("xx") / tile).alias("tx"), (F.col("yy") % tile).alias("yy"), (F.col("xx") % tile).alias("xx"), *bands, F.lit(255).alias("_there"))
    return as_png(cut, ["img", "ty", "tx"], [*bands, "_there"], tile)


def mercator_pixels(px: DataFrame, rasters: DataFrame, zoom: int, size: int = geo.TILE, value: str = "v", project: Callable | None = None, unproject: Callable | None = None) -> DataFrame:
    """img, tx, ty, iy, ix and the value: rasters as pixels of mercator tiles of one zoom (K11, K2), iy counted from a tile's top, ty from the south.

    rasters: img, height, width, x0, y0 (the map place of the upper left corner) and step (of a pixel, in units of the map). project takes
    columns of latitude and longitude to the map and unproject brings them back; without them the map is in mercator metres.

    Each pixel of the tiles that a raster's corners reach asks where it lies in the raster, and is mixed from the four pixels there; the outermost
    half pixel takes the edge's own. Pixels that lie in no raster have no row, nor have tiles that have none. A pixel in several rasters has a row for each.
    """
    to_map = project or (lambda lat, lon: geo.mercator(lat, lon))
    from_map = unproject or geo.place
    x0, y0, step = F.col("x0"), F.col("y0"), F.col("step")
    z = F.lit(zoom)
    corners = [from_map(x, y) for x in (x0, x0 + F.col("width") * step) for y in (y0, y0 - F.col("height") * step)]
    tiles = [[F.floor(geo.to_pixels(m, z) / geo.TILE) for m in axis] for axis in zip(*(geo.mercator(*geo.world(*c)) for c in corners), strict=True)]
    rows = rasters.select("img", "height", "width", "x0", "y0", "step", F.explode(F.sequence(F.least(*tiles[1]), F.greatest(*tiles[1]))).alias("ty"), F.array(*tiles[0]).alias("_tx"))
    rows = rows.withColumn("tx", F.explode(F.sequence(F.array_min("_tx"), F.array_max("_tx")))).drop("_tx")
    to = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    rows = rows.withColumn("iy", F.explode(to)).withColumn("ix", F.explode(to))
    part = geo.TILE / size
    mx, my = geo.to_metres(F.col("tx") * geo.TILE + (F.col("ix") + 0.5) * part, z), geo.to_metres((F.col("ty") + 1) * geo.TILE - (F.col("iy") + 0.5) * part, z)
    x, y = to_map(*geo.place(mx, my))
    rows = rows.withColumns({"_x": (x - x0) / step - 0.5, "_y": (y0 - y) / step - 0.5})
    inside = (F.col("_x") >= -0.5) & (F.col("_x") < F.col("width") - 0.5) & (F.col("_y") >= -0.5) & (F.col("_y") < F.col("height") - 0.5)
    clamp = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(n) - F.lit(1.0), F.col(c)))
    places = rows.where(inside).select("img", "tx", "ty", "iy", "ix", clamp("_y", "height").alias("sy"), clamp("_x", "width").alias("sx"))
    return warped(px, places, value)
