"""Queries that put several operators together, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom.operators import inference as I
from rasterloom.operators import publishing as P
from rasterloom.operators import sampling as S
from rasterloom.plans.rasters import _taps
from rasterloom.plans.registry import Registry, shared_folder
from rasterloom.sources import images as files
from rasterloom.sources import raster, tiff
from rasterloom.sources.synthetic import HEIGHT, MASK, PTS, PX, SQUARE, WIDTH, images, masks, pixels, points, squares

query = Registry()
_HALF = "20037508.342789244::DOUBLE"
_TILES = f"m AS (SELECT lon * {_HALF} / 180 AS mx, ln(tan((90 + greatest(-85.05112878, least(85.05112878, lat))) * pi() / 360)) / pi() * {_HALF} AS my FROM pts), z AS (SELECT range::INTEGER AS z FROM range(2, 6)), t AS (SELECT z, greatest(0, ceil(round((mx + {_HALF}) / (2 * {_HALF} / 256 / pow(2, z)), 3) / 256) - 1)::BIGINT AS tx, greatest(0, ceil(round((my + {_HALF}) / (2 * {_HALF} / 256 / pow(2, z)), 3) / 256) - 1)::BIGINT AS ty, count(*) AS n FROM m, z GROUP BY ALL)"


def rounded(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("base_tiles", f"WITH {PTS}, {_TILES} SELECT z, tx, ty, n FROM t")
def base_tiles(spark, sf_dir):
    return P.tiles_at(points(spark, sf_dir), range(2, 6))


@query("tile_sets", f"WITH {PTS}, {_TILES} SELECT z, round(2 * {_HALF} / 256 / pow(2, z), 6) AS units_per_pixel, count(*) AS n FROM t GROUP BY z")
def tile_sets(spark, sf_dir):
    return rounded(P.tile_sets(P.tiles_at(points(spark, sf_dir), range(2, 6))), 6, "units_per_pixel")


@query("pyramid_description", f"""WITH {PTS}, {_TILES}, l AS (SELECT z, 2 * {_HALF} / 256 / pow(2, z) AS u FROM t GROUP BY z)
SELECT '<TileMap version="1.0.0"><Title>places</Title><SRS>EPSG:3857</SRS><TileFormat width="256" height="256" mime-type="image/png" extension="png"/><TileSets profile="mercator">' || chr(10)
    || string_agg(printf('<TileSet href="%d" units-per-pixel="%.9f" order="%d"/>', z, u, z), chr(10) ORDER BY z) || chr(10) || '</TileSets></TileMap>' AS xml FROM l""")
def pyramid_description(spark, sf_dir):
    return P.description(P.tile_sets(P.tiles_at(points(spark, sf_dir), range(2, 6))), "places")


@query("pyramid_bounds", f"""WITH {PTS}, {_TILES}, l AS (SELECT z, 2 * {_HALF} / 256 / pow(2, z) AS u FROM t GROUP BY z)
SELECT '<TileMap version="1.0.0"><Title>places</Title><SRS>EPSG:3857</SRS>' || (SELECT printf('<BoundingBox minx="%.14f" miny="%.14f" maxx="%.14f" maxy="%.14f"/><Origin x="%.14f" y="%.14f"/>', min(lat), min(lon), max(lat), max(lon), min(lat), min(lon)) FROM pts) || '<TileFormat width="256" height="256" mime-type="image/png" extension="png"/><TileSets profile="mercator">' || chr(10)
    || string_agg(printf('<TileSet href="%d" units-per-pixel="%.9f" order="%d"/>', z, u, z), chr(10) ORDER BY z) || chr(10) || '</TileSets></TileMap>' AS xml FROM l""")
def pyramid_bounds(spark, sf_dir):
    return P.bounded_description(P.tile_sets(P.tiles_at(points(spark, sf_dir), range(2, 6))), points(spark, sf_dir), "places")


@query("child_links", f"WITH {PTS}, {_TILES}, c AS (SELECT z - 1 AS z, tx // 2 AS tx, ty // 2 AS ty, list(z || '/' || tx || '/' || ty || '.kml' ORDER BY z || '/' || tx || '/' || ty || '.kml') AS links FROM t GROUP BY ALL) SELECT t.z, t.tx, t.ty, coalesce(c.links, []) AS links FROM t LEFT JOIN c USING (z, tx, ty)")
def child_links(spark, sf_dir):
    return P.child_links(P.tiles_at(points(spark, sf_dir), range(2, 6)))


_LAT = "round(atan(exp((2 * ({0}) / pow(2, t.z) - 1) * pi())) * 360 / pi() - 90, 6)"


@query("tile_overlays", f"""WITH {PTS}, {_TILES}, c AS (SELECT z - 1 AS z, tx // 2 AS tx, ty // 2 AS ty, string_agg('<NetworkLink><Link><href>' || z || '/' || tx || '/' || ty || '.kml</href></Link></NetworkLink>', '' ORDER BY z || '/' || tx || '/' || ty || '.kml') AS links FROM t GROUP BY ALL)
SELECT t.z, t.tx, t.ty, '<kml><Document><Region>' || printf('<LatLonAltBox><north>%.6f</north><south>%.6f</south><east>%.6f</east><west>%.6f</west></LatLonAltBox>', {_LAT.format('t.ty + 1')}, {_LAT.format('t.ty')},
    (t.tx + 1) * 360.0::DOUBLE / pow(2, t.z) - 180, t.tx * 360.0::DOUBLE / pow(2, t.z) - 180) || '</Region>' || coalesce(links, '') || '</Document></kml>' AS kml FROM t LEFT JOIN c USING (z, tx, ty)""")
def tile_overlays(spark, sf_dir):
    return P.overlay(P.tiles_at(points(spark, sf_dir), range(2, 6)))


@query("height_fallback", f"WITH {PX}, e AS (SELECT img, min(v) AS l, max(v) AS h FROM px WHERE img % 2 = 0 GROUP BY img) SELECT img, yy, xx, ((v - l) * 255 // (h - l))::INTEGER AS height, 'surface' AS source FROM px JOIN e USING (img) UNION ALL SELECT img, yy, xx, floor(v / 256.0 * 255)::INTEGER, 'relief' FROM px WHERE img % 2 = 1")
def height_fallback(spark, sf_dir):
    px = pixels(spark, sf_dir)
    relief = px.select("img", "yy", "xx", (F.col("v") / 256.0 * 100).alias("pct"))
    return P.heights(px.where("img % 2 = 0"), relief, px.select("img"))


_TURN = "CASE o WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} WHEN 5 THEN {5} WHEN 6 THEN {6} ELSE {7} END"
_DRAW = "(('0x' || substr(md5('{seed}:{epoch}:' || img), 1, 8))::BIGINT % {n})"


@query("augment_turn", f"WITH {SQUARE}, o AS (SELECT img, yy, xx, v, {_DRAW.format(seed=3, epoch=2, n=8)} AS o FROM px) SELECT img, {_TURN.format('yy', '47 - xx', '47 - yy', 'xx', 'yy', '47 - xx', '47 - yy', 'xx')} AS yy, {_TURN.format('xx', 'yy', '47 - xx', '47 - yy', '47 - xx', '47 - yy', 'xx', 'yy')} AS xx, v FROM o")
def augment_turn(spark, sf_dir):
    return I.turned(squares(spark, sf_dir), 48, 3, 2)


@query("augment_crop", f"WITH {PX}, d AS (SELECT img, v, yy - {_DRAW.format(seed=3, epoch=2, n=9)} AS yy, xx - {_DRAW.format(seed=4, epoch=2, n=9)} AS xx FROM px) SELECT img, yy, xx, v FROM d WHERE yy BETWEEN 0 AND 31 AND xx BETWEEN 0 AND 39")
def augment_crop(spark, sf_dir):
    return I.shifted_crop(pixels(spark, sf_dir), 32, 40, 8, 3, 2).select("img", "yy", "xx", "v")


@query("prepared_samples", f"WITH {MASK} SELECT img, round(sum(v / 255.0), 4) AS v, sum((mv = 255)::INTEGER)::DOUBLE AS p0, sum((mv = 254)::INTEGER)::DOUBLE AS p1, sum((mv = 0)::INTEGER)::DOUBLE AS rest FROM px JOIN mask USING (img, yy, xx) GROUP BY img")
def prepared_samples(spark, sf_dir):
    rows = I.prepared(pixels(spark, sf_dir), masks(spark, sf_dir), 2, lambda px: px.withColumn("xx", WIDTH - 1 - F.col("xx")))
    return rows.groupBy("img").agg(F.round(F.sum("v"), 4).alias("v"), *(F.sum(F.col("p")[i]).alias(n) for i, n in enumerate(("p0", "p1", "rest"))))


@query("multi_scale", f"WITH {PX}, s AS (SELECT img, yy // 2 AS y2, xx // 2 AS x2, avg(v) AS m FROM px GROUP BY ALL) SELECT px.img, yy, xx, round((v * 0.5 + m * 0.5) / 2, 6) AS v FROM px JOIN s ON s.img = px.img AND y2 = yy // 2 AND x2 = xx // 2")
def multi_scale(spark, sf_dir):
    return rounded(I.multi_scale(pixels(spark, sf_dir), HEIGHT, WIDTH, [1, 2], 8, lambda rows: rows.withColumn("v", F.col("v") * 0.5)), 6, "v")


@query("multi_scale_smooth", f"""WITH {PX}, {_taps(48, 32, 'area', 'ay')}, {_taps(64, 43, 'area', 'ax')}, {_taps(32, 48, 'cubic', 'cy')}, {_taps(43, 64, 'cubic', 'cx')},
a AS (SELECT img, yy, ax.n AS xx, sum(v * w) AS v FROM px JOIN ax ON ax.at = px.xx GROUP BY ALL), s AS (SELECT img, ay.n AS yy, xx, sum(v * w) * 0.5 AS v FROM a JOIN ay ON ay.at = a.yy GROUP BY ALL),
b AS (SELECT img, yy, cx.n AS xx, sum(v * w) AS v FROM s JOIN cx ON cx.at = s.xx GROUP BY ALL), u AS (SELECT img, cy.n AS yy, xx, sum(v * w) AS v FROM b JOIN cy ON cy.at = b.yy GROUP BY ALL)
SELECT img, yy, xx, round((px.v * 0.5 + u.v) / 2, 6) AS v FROM px JOIN u USING (img, yy, xx)""")
def multi_scale_smooth(spark, sf_dir):
    return rounded(I.multi_scale(pixels(spark, sf_dir), HEIGHT, WIDTH, [1, 1.5], 8, lambda rows: rows.withColumn("v", F.col("v") * 0.5)), 6, "v")


@query("augment_rotate", f"""WITH {PX}, d AS (SELECT DISTINCT img, radians({_DRAW.format(seed=5, epoch=2, n=61)} - 30) AS a, 1 + {_DRAW.format(seed=6, epoch=2, n=5)} / 10.0::DOUBLE AS z FROM px),
p AS (SELECT img, yy, xx, (cos(a) * (yy - 23.5::DOUBLE) - sin(a) * (xx - 31.5::DOUBLE)) / z + 23.5 AS sy, (sin(a) * (yy - 23.5::DOUBLE) + cos(a) * (xx - 31.5::DOUBLE)) / z + 31.5 AS sx FROM px JOIN d USING (img)),
q AS (SELECT img, yy, xx, floor(sy)::BIGINT + i AS y, floor(sx)::BIGINT + j AS x, (CASE i WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE j WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM p, range(2) r(i), range(2) t(j))
SELECT q.img, q.yy, q.xx, round(sum(w * coalesce(v, 0)), 6) AS v FROM q LEFT JOIN px ON px.img = q.img AND px.yy = q.y AND px.xx = q.x GROUP BY ALL""")
def augment_rotate(spark, sf_dir):
    """Images turned by -30 to 30 degrees and enlarged by 1 to 1.4, as drawn."""
    angle, scale = I.draw(5, 2, "img", 61) - 30, 1 + I.draw(6, 2, "img", 5) / 10
    return rounded(I.turned_by(pixels(spark, sf_dir), HEIGHT, WIDTH, angle, scale), 6, "v")


@query("sample_heights", f"""WITH {PX}, {_taps(24, 48, 'cubic', 'ty')}, {_taps(32, 64, 'cubic', 'tx')}, l AS (SELECT * FROM px WHERE yy < 24 AND xx < 32 AND img % 3 <> 0), h AS (SELECT img, yy, tx.n AS xx, sum(v * w) AS v FROM l JOIN tx ON tx.at = l.xx GROUP BY ALL),
z AS (SELECT img, ty.n AS yy, xx, sum(v * w) AS height FROM h JOIN ty ON ty.at = h.yy GROUP BY ALL) SELECT img, yy, xx, v, round(height, 6) AS height FROM px JOIN z USING (img, yy, xx)""")
def sample_heights(spark, sf_dir):
    """Images with a height layer of half their size, which every third image lacks."""
    px = pixels(spark, sf_dir)
    layer = px.where((F.col("yy") < 24) & (F.col("xx") < 32) & (F.col("img") % 3 != 0))
    return rounded(S.with_height(px, layer, (HEIGHT, WIDTH), (24, 32)), 6, "height")


@query("resumed_fields", f"WITH {PX} SELECT img, CASE WHEN img % 2 = 0 THEN 1 ELSE 2 END AS run, sum(v)::BIGINT AS total, count(*) AS n FROM px GROUP BY img")
def resumed_fields(spark, sf_dir):
    """Fields of half of the images, and then of all: the second run makes only the other half."""
    folder, ids, px = f"{shared_folder(spark)}/fields_{uuid.uuid4().hex}", images(spark, sf_dir), pixels(spark, sf_dir)
    make = lambda run: lambda some: px.join(some, "img").groupBy("img").agg(F.lit(run).alias("run"), F.sum("v").alias("total"), F.count("*").alias("n"))
    I.resumed(ids.where("img % 2 = 0"), folder, "sums", make(1), parts=2)
    return I.resumed(ids, folder, "sums", make(2), parts=2)


@query("super_tiles", f"WITH {PX} SELECT img, ((yy + 6) // 20)::INTEGER AS ty, ((xx + 8) // 20)::INTEGER AS tx, count(*) AS n, sum(v)::BIGINT AS total, max(yy - greatest(((yy + 6) // 20) * 20 - 6, 0))::BIGINT AS last_y, max(xx - greatest(((xx + 8) // 20) * 20 - 8, 0))::BIGINT AS last_x FROM px GROUP BY ALL")
def super_tiles(spark, sf_dir):
    sizes = images(spark, sf_dir).select("img", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"))
    rows = I.by_super_tile(pixels(spark, sf_dir), sizes, 20)
    return rows.groupBy("img", "ty", "tx").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("iy").alias("last_y"), F.max("ix").alias("last_x"))


_M = f"{_HALF} / 180"


@query("mercator_pixels", f"""WITH {PX}, r AS (SELECT s_suppkey::INTEGER AS img, (s_suppkey * 37 % 300 - 150)::DOUBLE AS x0, (s_suppkey * 17 % 120 - 59)::DOUBLE AS y0, 0.02::DOUBLE AS step FROM supplier),
b AS (SELECT *, floor((x0 * {_M} + {_HALF}) / (2 * {_HALF} / 128))::BIGINT AS tx0, floor(((x0 + 64 * step) * {_M} + {_HALF}) / (2 * {_HALF} / 128))::BIGINT AS tx1,
      floor((ln(tan((90 + y0 - 48 * step) * pi() / 360)) / pi() * {_HALF} + {_HALF}) / (2 * {_HALF} / 128))::BIGINT AS ty0, floor((ln(tan((90 + y0) * pi() / 360)) / pi() * {_HALF} + {_HALF}) / (2 * {_HALF} / 128))::BIGINT AS ty1 FROM r),
t AS (SELECT img, x0, y0, step, tx, ty, iy, ix, ((tx + (ix + 0.5::DOUBLE) / 64) * (2 * {_HALF} / 128) - {_HALF}) / ({_M}) AS lon, atan(exp(((ty + 1 - (iy + 0.5::DOUBLE) / 64) * 2 / 128 - 1) * pi())) * 360 / pi() - 90 AS lat
      FROM b, range(128) a(tx), range(128) c(ty), range(64) d(iy), range(64) e(ix) WHERE tx BETWEEN tx0 AND tx1 AND ty BETWEEN ty0 AND ty1),
s AS (SELECT img, tx, ty, iy, ix, (lon - x0) / step - 0.5 AS sx, (y0 - lat) / step - 0.5 AS sy FROM t), k AS (SELECT img, tx, ty, iy, ix, greatest(0, least(63, sx)) AS sx, greatest(0, least(47, sy)) AS sy FROM s WHERE sx >= -0.5 AND sx < 63.5 AND sy >= -0.5 AND sy < 47.5),
q AS (SELECT img, tx, ty, iy, ix, floor(sy)::BIGINT + i AS y, floor(sx)::BIGINT + j AS x, (CASE i WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE j WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM k, range(2) f(i), range(2) g(j))
SELECT q.img, tx, ty, iy, ix, round(sum(w * coalesce(v, 0)), 6) AS v FROM q LEFT JOIN px ON px.img = q.img AND px.yy = q.y AND px.xx = q.x WHERE w > 0 GROUP BY ALL""")
def mercator_pixels(spark, sf_dir):
    """Rasters in degrees as pixels of mercator tiles at zoom 7, a fourth of the usual size."""
    s = F.col("img")
    rasters = images(spark, sf_dir).select("img", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), (s * 37 % 300 - 150).cast("double").alias("x0"), (s * 17 % 120 - 59).cast("double").alias("y0"), F.lit(0.02).alias("step"))
    found = P.mercator_pixels(pixels(spark, sf_dir), rasters, 7, 64, project=lambda lat, lon: (lon, lat), unproject=lambda x, y: (y, x))
    return rounded(found, 6, "v")


def _written(spark, made, path, content):
    """The folder that now holds the files of made."""
    root = f"{shared_folder(spark)}/files_{uuid.uuid4().hex}"
    files.write(made.withColumn("path", path), root, content=content).agg(F.sum("size")).first()
    return root


_NUMBER = lambda i: F.regexp_extract("path", r"(\d+)/(\d+)_(\d+)\.\w+$", i)


@query("png_tiles", f"WITH {PX} SELECT img, yy, xx, [v, 255 - v, v * 2 % 256]::INTEGER[] AS colour FROM px")
def png_tiles(spark, sf_dir):
    """Rasters cut into tiles, written as PNG files and read back. A folder holds the tiles of 256 rasters, and a task lists and reads one."""
    v, number = F.col("v"), lambda i: F.regexp_extract("path", r"(\d+)_(\d+)_(\d+)\.png$", i)
    made = P.pixel_tiles(pixels(spark, sf_dir).select("img", "yy", "xx", v.alias("r"), (255 - v).alias("g"), (v * 2 % 256).alias("b")), ["r", "g", "b"], 20)
    root = _written(spark, made, F.format_string("%d/%d_%d_%d.png", F.floor(F.col("img") / 256), "img", "ty", "tx"), "png")
    tiles = files.files(spark, root).select(number(1).cast("int").alias("img"), number(2).cast("long").alias("ty"), number(3).cast("long").alias("tx"), "content")
    there = files.of_png(tiles, ["img", "ty", "tx"], "content").where(F.col("bands")[3] == 255)
    return there.select("img", (F.col("ty") * 20 + F.col("yy")).alias("yy"), (F.col("tx") * 20 + F.col("xx")).alias("xx"), F.slice("bands", 1, 3).alias("colour"))


@query("tiff_window", f"WITH {PX} SELECT img, yy, xx, v::DOUBLE AS v FROM px WHERE yy BETWEEN 10 AND 39 AND xx BETWEEN 20 AND 63")
def tiff_window(spark, sf_dir):
    """A window, cut at the edge, of rasters written as tiled and compressed files."""
    made = tiff.as_tiff(pixels(spark, sf_dir), ["img"], ["v"], deflate=True, tile=16, epsg=32631)
    found = tiff.pixels(spark, _written(spark, made, F.format_string("%d/0_0.tif", "img"), "tiff"), ((20, 10), (50, 30)))
    return found.select(_NUMBER(1).cast("int").alias("img"), "yy", "xx", F.col("bands")[0].alias("v"))


@query("raster_window", f"WITH {PX} SELECT img, yy, xx, v::DOUBLE AS v FROM px WHERE yy BETWEEN 10 AND 39 AND xx >= 20 AND v <> 7")
def raster_window(spark, sf_dir):
    """A window of rasters written as committed files and read by the data source, which takes the window from the filter; 7 is no data."""
    raster.register(spark)
    root = f"{shared_folder(spark)}/rasters_{uuid.uuid4().hex}"
    made = tiff.as_tiff(pixels(spark, sf_dir), ["img"], ["v"], deflate=True, tile=16)
    made.select(F.format_string("%d/0_0.tif", "img").alias("path"), F.col("tiff").alias("content")).write.format("raster_files").mode("append").save(root)
    found = spark.read.format("raster").option("nodata", "7").load(root).where("yy >= 10 and yy < 40 and xx >= 20 and valid")
    return found.select(_NUMBER(1).cast("int").alias("img"), "yy", "xx", F.col("bands")[0].alias("v"))
