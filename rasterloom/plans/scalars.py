"""Queries of scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import geo as G
from rasterloom.functions import schedule as S
from rasterloom.functions import text as X
from rasterloom.plans.registry import Registry, table
from rasterloom.sources.synthetic import PTS, points

query = Registry()
_HALF = "20037508.342789244::DOUBLE"
_MERC = f"m AS (SELECT c_custkey, lon * {_HALF} / 180 AS mx, ln(tan((90 + lat) * pi() / 360)) / pi() * {_HALF} AS my, lat, lon FROM pts)"
_Z = 10


def rounded(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("mercator_tile", f"WITH {PTS}, {_MERC} SELECT c_custkey, round(mx, 3) AS mx, round(my, 3) AS my, (ceil(round((mx + {_HALF}) / (2 * {_HALF} / 256 / 1024), 3) / 256) - 1)::BIGINT AS tx, (ceil((my + {_HALF}) / (2 * {_HALF} / 256 / 1024) / 256) - 1)::BIGINT AS ty FROM m")
def mercator_tile(spark, sf_dir):
    mx, my = G.mercator(F.col("lat"), F.col("lon"))
    df = points(spark, sf_dir).select("c_custkey", mx.alias("mx"), my.alias("my"))
    df = df.withColumns({"tx": G.tile_of(F.round(G.to_pixels(F.col("mx"), F.lit(_Z)), 3)), "ty": G.tile_of(G.to_pixels(F.col("my"), F.lit(_Z)))})
    return rounded(df, 3, "mx", "my")


@query("mercator_roundtrip", f"WITH {PTS} SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pts")
def mercator_roundtrip(spark, sf_dir):
    lat, lon = G.place(*G.mercator(F.col("lat"), F.col("lon")))
    return rounded(points(spark, sf_dir).select("c_custkey", lat.alias("lat"), lon.alias("lon")), 6, "lat", "lon")


@query("tile_bounds", f"WITH {PTS}, t AS (SELECT c_custkey, c_custkey % 1024 AS tx, (c_custkey * 7) % 1024 AS ty FROM pts), r AS (SELECT *, 2 * {_HALF} / 1024 AS s FROM t) SELECT c_custkey, round(tx * s - {_HALF}, 3) AS w, round(ty * s - {_HALF}, 3) AS s, round((tx + 1) * s - {_HALF}, 3) AS e, round((ty + 1) * s - {_HALF}, 3) AS n, round(atan(exp((ty * s / {_HALF} - 1) * pi())) * 360 / pi() - 90, 6) AS lat FROM r")
def tile_bounds(spark, sf_dir):
    df = points(spark, sf_dir).select("c_custkey", (F.col("c_custkey") % 1024).alias("tx"), ((F.col("c_custkey") * 7) % 1024).alias("ty"))
    w, s, e, n = G.tile_bounds(F.col("tx"), F.col("ty"), F.lit(_Z))
    lat = G.tile_places(F.col("tx"), F.col("ty"), F.lit(_Z))[0]
    return rounded(rounded(df.select("c_custkey", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"), lat.alias("lat")), 3, "w", "s", "e", "n"), 6, "lat")


@query("zoom_for_pixel", f"WITH z AS (SELECT i.range AS i, 2 * {_HALF} / 256 / pow(2, i.range) AS r FROM range(32) i), p AS (SELECT p_partkey, pow(10, p_size % 18 - 10) * 3 AS ps FROM part), b AS (SELECT p_partkey, min(i) AS i FROM p LEFT JOIN z ON ps > r GROUP BY p_partkey) SELECT p_partkey, CASE WHEN i IS NULL THEN NULL ELSE greatest(i - 1, 0) END::INTEGER AS zoom FROM b")
def zoom_for_pixel(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.zoom_for(F.pow(F.lit(10.0), F.col("p_size") % 18 - 10) * 3).cast("int").alias("zoom"))


_FLIP = "t AS (SELECT c_custkey, c_custkey % 64 AS tx, (c_custkey * 7) % 64 AS ty FROM customer)"


@query("google_flip", f"WITH {_FLIP} SELECT c_custkey, 63 - ty AS gy FROM t")
def google_flip(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", G.flipped((F.col("c_custkey") * 7) % 64, 6).alias("gy"))


@query("quadkey", f"WITH {_FLIP} SELECT c_custkey, array_to_string(list_transform(range(5, -1, -1), lambda i: ((tx >> i) & 1) + 2 * (((63 - ty) >> i) & 1)), '') AS key FROM t")
def quadkey(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", G.quadkey(F.col("c_custkey") % 64, (F.col("c_custkey") * 7) % 64, 6).alias("key"))


@query("geodetic_tile", f"WITH {PTS} SELECT c_custkey, (ceil((lon + 180) / (180.0::DOUBLE / 256 / 32) / 256) - 1)::BIGINT AS tx, (ceil((lat + 90) / (180.0::DOUBLE / 256 / 32) / 256) - 1)::BIGINT AS ty, (ceil((lon + 180) / (180.0::DOUBLE / 256 / 32) / 256) - 1) * 5.625 - 180 AS west FROM pts")
def geodetic_tile(spark, sf_dir):
    z = F.lit(5)
    tx, ty = G.geodetic_tile(F.col("lon"), F.col("lat"), z)
    return points(spark, sf_dir).select("c_custkey", tx.alias("tx"), ty.alias("ty"), G.geodetic_bounds(tx, ty, z)[0].alias("west"))


@query("raster_zoom", "SELECT p_partkey, greatest(ceil(log2(p_size * 300 / 256.0)), ceil(log2(p_size * 200 / 256.0)), 0)::INTEGER AS zoom FROM part")
def raster_zoom(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.raster_zoom(F.col("p_size") * 300, F.col("p_size") * 200).alias("zoom"))


@query("geo_window", f"WITH {PTS}, a AS (SELECT c_custkey, trunc((lon + 100) / 0.5 + 0.001)::INTEGER AS x, trunc((60 - lat) / 0.5 + 0.001)::INTEGER AS y, trunc(20 / 0.5 + 0.5)::INTEGER AS n FROM pts) SELECT c_custkey, greatest(x, 0) AS rx, greatest(-x, 0) AS wx, greatest(least(greatest(n - greatest(-x, 0), 0), 300 - greatest(x, 0)), 0) AS nx, greatest(y, 0) AS ry, greatest(-y, 0) AS wy, greatest(least(greatest(n - greatest(-y, 0), 0), 200 - greatest(y, 0)), 0) AS ny FROM a")
def geo_window(spark, sf_dir):
    lon, lat = F.col("lon"), F.col("lat")
    w = G.map_window(lon, lat, lon + 20, lat - 20, F.lit(-100.0), F.lit(60.0), 0.5, 300, 200)
    return points(spark, sf_dir).select("c_custkey", *(c.cast("int").alias(n) for n, c in w.items()))


@query("affine_inverse", f"WITH {PTS} SELECT c_custkey, trunc(((lon + 180) * -0.25 - (lat - 90) * 0.125) / -0.140625 + 0.5)::INTEGER AS px, trunc(((lat - 90) * 0.5 - (lon + 180) * 0.125) / -0.140625 + 0.5)::INTEGER AS py FROM pts")
def affine_inverse(spark, sf_dir):
    px, py = G.pixel_of(F.col("lon"), F.col("lat"), (-180.0, 0.5, 0.125, 90.0, 0.125, -0.25))
    return points(spark, sf_dir).select("c_custkey", px.alias("px"), py.alias("py"))


@query("contour_px", f"WITH {PTS} SELECT c_custkey, [trunc((lon + 180) * 100 / 360)::INTEGER + 5, trunc((lon + 181) * 100 / 360)::INTEGER + 5] AS xs, [trunc((90 - lat) * 50 / 180)::INTEGER + 7, trunc((91 - lat) * 50 / 180)::INTEGER + 7] AS ys FROM pts")
def contour_px(spark, sf_dir):
    lon, lat = F.col("lon"), F.col("lat")
    pts = F.array(F.struct(lon.alias("x"), lat.alias("y")), F.struct((lon + 1).alias("x"), (lat - 1).alias("y")))
    found = G.moved(G.outline_pixels(pts, (-180.0, -90.0, 180.0, 90.0), 101, 51), 5, 7)
    return points(spark, sf_dir).select("c_custkey", F.transform(found, lambda p: p["x"]).alias("xs"), F.transform(found, lambda p: p["y"]).alias("ys"))


@query("contour_rescale", f"WITH {PTS} SELECT c_custkey, trunc(lon * 0.4)::INTEGER AS x, trunc(lat * 0.4)::INTEGER AS y FROM pts")
def contour_rescale(spark, sf_dir):
    found = G.rescaled(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))), F.lit(0.4))
    return points(spark, sf_dir).select("c_custkey", found[0]["x"].alias("x"), found[0]["y"].alias("y"))


@query("world_clamp", f"WITH {PTS} SELECT c_custkey, greatest(-85.05112878, least(85.05112878, lat * 1.5)) AS lat, greatest(-180, least(180, lon * 1.5)) AS lon FROM pts")
def world_clamp(spark, sf_dir):
    lat, lon = G.world(F.col("lat") * 1.5, F.col("lon") * 1.5)
    return points(spark, sf_dir).select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query("transverse_roundtrip", f"WITH {PTS} SELECT c_custkey, round(lat, 6) AS lat, round(lon / 60, 6) AS lon FROM pts")
def transverse_roundtrip(spark, sf_dir):
    lat, lon = G.transverse_inverse(*G.transverse(F.col("lat"), F.col("lon") / 60, 1.0), 1.0)
    return rounded(points(spark, sf_dir).select("c_custkey", (lat + 0.0).alias("lat"), (lon + 0.0).alias("lon")), 6, "lat", "lon")


_E = "e AS (SELECT event_id, (event_id % 100)::INTEGER AS epoch FROM events)"


def _epochs(spark, sf_dir):
    """Every event with an epoch of its own."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).cast("int").alias("epoch"))



@query("lr_step", f"WITH {_E} SELECT event_id, epoch, round(0.01 * pow(0.25, floor((1 + epoch) / 10.0)), 9) AS lr FROM e")
def lr_step(spark, sf_dir):
    return rounded(_epochs(spark, sf_dir).withColumn("lr", S.step_decay(F.col("epoch"), 0.01, 0.25, 10)), 9, "lr")


@query("lr_poly", f"WITH {_E} SELECT event_id, epoch, round(0.01 * pow(1 - epoch / 100.0, 2), 9) AS lr FROM e")
def lr_poly(spark, sf_dir):
    return rounded(_epochs(spark, sf_dir).withColumn("lr", S.polynomial_decay(F.col("epoch"), 0.01, 100, 2.0)), 9, "lr")


@query("lr_cosine", f"WITH {_E} SELECT event_id, epoch, round(0.05 * (cos(pi() * (epoch % 20) / 20) + 1), 9) AS lr FROM e")
def lr_cosine(spark, sf_dir):
    return rounded(_epochs(spark, sf_dir).withColumn("lr", S.cosine_restarts(F.col("epoch"), 0.1, 100, 5)), 9, "lr")


@query("cycle_snapshots", f"WITH {_E} SELECT event_id, epoch, ((epoch + 1) // 20)::BIGINT AS snapshot FROM e WHERE epoch <> 0 AND (epoch + 1) % 20 = 0")
def cycle_snapshots(spark, sf_dir):
    return _epochs(spark, sf_dir).withColumn("snapshot", S.snapshot_after(F.col("epoch"), 100, 5)).where("snapshot is not null")


@query("dropout_scale", "SELECT p_partkey, round(CASE WHEN p_size > 25 THEN 1 - 0.8 / (p_size / 25.0) ELSE 0.2 * (p_size / 25.0) END, 9) AS rate FROM part")
def dropout_scale(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", S.scaled_dropout(F.lit(0.2), F.col("p_size") / 25.0).alias("rate")), 9, "rate")


@query("string_keys", "SELECT p_partkey, concat_ws('_', p_size, p_brand, printf('mppx%.2f', p_size / 4.0), 'wh' || p_size * 32, 'rgb' || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE '' END, (p_size % 4)::VARCHAR || 'cls', p_type) AS sig, concat_ws('-', p_partkey, p_size) AS box, CASE WHEN p_size % 3 = 0 THEN 'Accuracy' WHEN p_size % 3 = 1 THEN 'Loss' ELSE 'f1' END AS title FROM part")
def string_keys(spark, sf_dir):
    size = F.col("p_size")
    sig = X.signature(size, F.col("p_brand"), size / 4.0, size * 32, size % 2 == 0, size % 4, F.col("p_type"))
    name = F.when(size % 3 == 0, "acc").when(size % 3 == 1, "loss").otherwise("f1")
    return table(spark, sf_dir, "part").select("p_partkey", sig.alias("sig"), X.box_key(F.col("p_partkey"), size).alias("box"), X.metric_title(name).alias("title"))


@query("path_parts", "SELECT page_id, split_part(url, '/', -1) AS base, split_part(split_part(url, '/', -1), '.', 1) AS stem, regexp_extract(split_part(url, '/', -1), '(\\.[^.]*)$', 1) AS ext, replace(concat_ws('_', 'a.b', split_part(url, '/', 3)), '.', '_') AS project, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages")
def path_parts(spark, sf_dir):
    url = F.col("url")
    host = F.split(url, "/")[2]
    return table(spark, sf_dir, "pages").select("page_id", X.base_name(url).alias("base"), X.stem(url).alias("stem"), X.extension(url).alias("ext"), X.project_name(F.lit("a.b"), host).alias("project"), X.between(url, "//", "/").alias("host"))


@query("local_day", "SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, rtrim(event_type || '  ') AS kind FROM events")
def local_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.local_day(F.col("ts"), "+03:00").alias("day"), F.rtrim(F.concat("event_type", F.lit("  "))).alias("kind"))
