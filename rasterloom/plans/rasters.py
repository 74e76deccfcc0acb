"""Queries over tiles and neighbourhoods, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import stencils as N
from rasterloom.operators import tiling as T
from rasterloom.plans.registry import Registry, table
from rasterloom.sources.synthetic import HEIGHT, PX, SQUARE, WIDTH, pixels, squares

query = Registry()


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _images(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img"), (F.col("p_size") * 7 + 40).alias("height"), (F.col("p_size") * 5 + 60).alias("width"))


_AXES = "i AS (SELECT p_partkey AS img, p_size * 7 + 40 AS height, p_size * 5 + 60 AS width FROM part), a AS (SELECT *, greatest(1, ceil((height - 50) / 50.0) + 1)::INTEGER AS ny, greatest(1, ceil((width - 50) / 50.0) + 1)::INTEGER AS nx FROM i), t AS (SELECT img, height, width, y.range AS ty, x.range AS tx, (y.range * 50 - floor(((ny - 1) * 50 + 50 - height) / 2.0))::INTEGER AS y0, (x.range * 50 - floor(((nx - 1) * 50 + 50 - width) / 2.0))::INTEGER AS x0 FROM a, range(20) y, range(20) x WHERE y.range < ny AND x.range < nx)"


@query("tile_grid", f"WITH {_AXES} SELECT img, ty::INTEGER AS ty, tx::INTEGER AS tx, y0, x0 FROM t")
def tile_grid(spark, sf_dir):
    return T.tile_grid(_images(spark, sf_dir), 50, 50)


@query("supertile_clamp", f"WITH {_AXES} SELECT img, ty::INTEGER AS ty, tx::INTEGER AS tx, greatest(x0, 0) AS bx, greatest(y0, 0) AS by, least(x0 + 50, width) - greatest(x0, 0) AS bw, least(y0 + 50, height) - greatest(y0, 0) AS bh FROM t")
def supertile_clamp(spark, sf_dir):
    return T.clamped_boxes(_images(spark, sf_dir), 50)


@query("tile_cut", f"WITH {PX} SELECT img, ((yy + 1) // 50)::BIGINT AS ty, ((xx + 18) // 50)::BIGINT AS tx, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (((yy + 1) % 50) * 50 + (xx + 18) % 50))::BIGINT AS place FROM px GROUP BY ALL")
def tile_cut(spark, sf_dir):
    rows = T.cut(pixels(spark, sf_dir), HEIGHT, WIDTH, 50)
    return rows.groupBy("img", "ty", "tx").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("iy") * 50 + F.col("ix"))).alias("place"))


@query("tile_roundtrip", f"WITH {PX} SELECT img, yy, xx, v FROM px")
def tile_roundtrip(spark, sf_dir):
    return T.pixels_of(T.tiles_of(pixels(spark, sf_dir), HEIGHT, WIDTH, 50), HEIGHT, WIDTH, 50)


def _spline_sql(n):
    return f"b AS (SELECT range AS i, abs(2 * (range + 0.5) / {n} - 1) AS d FROM range({n})), c AS (SELECT i, CASE WHEN d <= 0.5 THEN 1 - 2 * d * d ELSE 2 * (1 - d) * (1 - d) END AS w FROM b), s AS (SELECT i, w / avg(w) OVER () AS w FROM c)"


_SPLINES = """p AS (SELECT p_partkey, p_size * 2 AS size, p_size % 3 = 0 AS first, p_size % 2 = 0 AS last FROM part),
d AS (SELECT *, unnest(range(size)) AS i FROM p), b AS (SELECT *, abs(2 * (i + 0.5) / size - 1) AS x FROM d), c AS (SELECT *, CASE WHEN x <= 0.5 THEN 1 - 2 * x * x ELSE 2 * (1 - x) * (1 - x) END AS r FROM b),
w AS (SELECT *, r / avg(r) OVER (PARTITION BY p_partkey) AS w FROM c)"""


@query("spline_window", f"WITH {_SPLINES} SELECT p_partkey, i, round(w, 9) AS w FROM w")
def spline_window(spark, sf_dir):
    """Windows twice as long as each part's size."""
    weights = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.spline_weights(F.col("p_size") * 2)).alias("i", "w"))
    return weights.select("p_partkey", F.col("i").cast("long").alias("i"), F.round("w", 9).alias("w"))


@query("edge_weight", f"WITH {_SPLINES}, h AS (SELECT p_partkey, w AS half FROM w WHERE i = size // 2) SELECT p_partkey, i, round(CASE WHEN (first AND i < size // 2) OR (last AND i >= size // 2) THEN half ELSE w END, 9) AS w FROM w JOIN h USING (p_partkey)")
def edge_weight(spark, sf_dir):
    size = F.col("p_size")
    weights = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.weights_at_edges(size * 2, size % 3 == 0, size % 2 == 0)).alias("i", "w"))
    return weights.select("p_partkey", F.col("i").cast("long").alias("i"), F.round("w", 9).alias("w"))


_WEIGHTS = f"{_spline_sql(16)}, wy AS (SELECT y.range - 8 + i AS yy, w FROM range(0, 56, 8) y, s WHERE y.range - 8 + i BETWEEN 0 AND 47), wx AS (SELECT x.range - 8 + i AS xx, w FROM range(0, 72, 8) x, s WHERE x.range - 8 + i BETWEEN 0 AND 63)"


@query("overlap_add", f"WITH {PX}, {_WEIGHTS} SELECT img, px.yy, px.xx, round(sum(v * wy.w * wx.w) / 4, 6) AS v FROM px JOIN wy ON wy.yy = px.yy JOIN wx ON wx.xx = px.xx GROUP BY ALL")
def overlap_add(spark, sf_dir):
    return rounded(T.blend(pixels(spark, sf_dir), HEIGHT, WIDTH, 16), "v")


@query("overlap_model", f"WITH {PX}, {_WEIGHTS} SELECT img, px.yy, px.xx, round(sum((v * 0.5 + 3) * wy.w * wx.w) / 4, 6) AS v FROM px JOIN wy ON wy.yy = px.yy JOIN wx ON wx.xx = px.xx GROUP BY ALL")
def overlap_model(spark, sf_dir):
    return rounded(T.blend(pixels(spark, sf_dir), HEIGHT, WIDTH, 16, model=lambda rows: rows.withColumn("v", F.col("v") * 0.5 + 3)), "v")


_INSIDE = f"""{_spline_sql(16)}, m AS (SELECT w AS mid FROM s WHERE i = 8), ys AS (SELECT range AS wy FROM range(0, 33, 8)), xs AS (SELECT range AS wx FROM range(0, 49, 8)),
wy AS (SELECT wy, wy + i AS yy, CASE WHEN (wy = 0 AND i < 8) OR (wy = 32 AND i >= 8) THEN mid ELSE w END AS w FROM ys, s, m), wx AS (SELECT wx, wx + i AS xx, CASE WHEN (wx = 0 AND i < 8) OR (wx = 48 AND i >= 8) THEN mid ELSE w END AS w FROM xs, s, m)"""


@query("overlap_inside", f"WITH {PX}, {_INSIDE} SELECT img, px.yy, px.xx, round(sum((v + (px.yy - wy.wy) * 2 - (px.xx - wx.wx)) * wy.w * wx.w) / sum(wy.w * wx.w), 6) AS v FROM px JOIN wy ON wy.yy = px.yy JOIN wx ON wx.xx = px.xx GROUP BY ALL")
def overlap_inside(spark, sf_dir):
    """Blended windows of a model that gives each place of a window another value."""
    model = lambda rows: rows.withColumn("v", F.col("v") + (F.col("yy") - F.col("wy")) * 2 - (F.col("xx") - F.col("wx")))
    return rounded(T.blend_inside(pixels(spark, sf_dir), HEIGHT, WIDTH, 16, model=model), "v")


@query("reflect_pad", f"WITH {PX} SELECT img, i.range - 5 AS place, xx, v FROM range(58) i JOIN px ON px.yy = CASE WHEN i.range - 5 < 0 THEN 5 - i.range WHEN i.range - 5 >= 48 THEN 94 - (i.range - 5) ELSE i.range - 5 END")
def reflect_pad(spark, sf_dir):
    places = spark.range(58).select((F.col("id") - 5).alias("place"), T.reflected(F.col("id") - 5, HEIGHT).alias("yy"))
    return places.join(pixels(spark, sf_dir), "yy").select("img", "place", "xx", "v")


@query("d4_mean", f"""WITH {SQUARE},
o AS (SELECT img, yy, xx, v, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS o FROM px),
p AS (SELECT img, o, yy, xx, CASE o % 4 WHEN 0 THEN yy WHEN 1 THEN 47 - xx WHEN 2 THEN 47 - yy ELSE xx END AS ty, v FROM o)
SELECT img, yy, xx, round(avg(v + ty), 6) AS v FROM p GROUP BY ALL""")
def d4_mean(spark, sf_dir):
    return rounded(T.orientation_mean(squares(spark, sf_dir), 48, "v", lambda rows: rows.withColumn("v", F.col("v") + F.col("yy"))), "v")


@query("shrink_average", f"WITH {PX} SELECT img, yy // 2 AS yy, xx // 2 AS xx, avg(v) AS v FROM px GROUP BY ALL")
def shrink_average(spark, sf_dir):
    return T.shrunk(pixels(spark, sf_dir), 2)


@query("overview", f"WITH {PX} " + " UNION ALL ".join(f"SELECT {z} AS z, img, yy // {1 << z} AS yy, xx // {1 << z} AS xx, round(avg(v), 6) AS v FROM px GROUP BY ALL" for z in range(4)))
def overview(spark, sf_dir):
    return rounded(T.pyramid(pixels(spark, sf_dir), 3), "v")


@query("overview_tiles", "WITH t AS (SELECT DISTINCT 6 AS z, c_custkey % 64 AS tx, (c_custkey * 7) % 64 AS ty FROM customer), a AS (SELECT z, tx, ty, 0 AS children FROM t), b AS (SELECT z - 1 AS z, tx // 2 AS tx, ty // 2 AS ty, count(*) AS children FROM t GROUP BY ALL), c AS (SELECT z - 1 AS z, tx // 2 AS tx, ty // 2 AS ty, count(*) AS children FROM b GROUP BY ALL) SELECT z, tx, ty, children::BIGINT AS children FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)")
def overview_tiles(spark, sf_dir):
    k = F.col("c_custkey")
    tiles = table(spark, sf_dir, "customer").select(F.lit(6).alias("z"), (k % 64).alias("tx"), ((k * 7) % 64).alias("ty"))
    return T.overview_tiles(tiles, 2)


@query("resample_bilinear", f"""WITH {PX},
ay AS (SELECT range AS n, (range + 0.5) * 48 / 36 - 0.5 AS c FROM range(36)), ax AS (SELECT range AS n, (range + 0.5) * 64 / 100 - 0.5 AS c FROM range(100)),
wy AS (SELECT n, greatest(0, least(47, floor(c)))::BIGINT AS at, 1 - (c - floor(c)) AS w FROM ay UNION ALL SELECT n, greatest(0, least(47, floor(c) + 1))::BIGINT, c - floor(c) FROM ay),
wx AS (SELECT n, greatest(0, least(63, floor(c)))::BIGINT AS at, 1 - (c - floor(c)) AS w FROM ax UNION ALL SELECT n, greatest(0, least(63, floor(c) + 1))::BIGINT, c - floor(c) FROM ax)
SELECT img, wy.n AS yy, wx.n AS xx, round(sum(v * wy.w * wx.w), 6) AS v FROM px JOIN wy ON wy.at = yy JOIN wx ON wx.at = xx GROUP BY ALL""")
def resample_bilinear(spark, sf_dir):
    return rounded(T.bilinear(pixels(spark, sf_dir), HEIGHT, WIDTH, 36, 100), "v")


def _taps(old, new, kernel, name):
    """SQL of the table of taps along an axis: n, at, w."""
    near = {
        "area": f"SELECT n, j, least(j + 1, (n + 1) * {old}.0::DOUBLE / {new}) - greatest(j, n * {old}.0::DOUBLE / {new}) AS w FROM (SELECT range AS n FROM range({new})), (SELECT range AS j FROM range({old})) WHERE least(j + 1, (n + 1) * {old}.0::DOUBLE / {new}) > greatest(j, n * {old}.0::DOUBLE / {new})",
        "cubic": "SELECT n, j, CASE WHEN d <= 1 THEN (1.25::DOUBLE * d - 2.25) * d * d + 1 ELSE ((-0.75::DOUBLE * d + 3.75) * d - 6) * d + 3 END AS w FROM (SELECT n, floor(c) + k AS j, abs(c - floor(c) - k) AS d FROM {c}, (SELECT unnest([-1, 0, 1, 2]) AS k))",
        "lanczos": "SELECT n, j, CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 4) / (pi() * d / 4) END AS w FROM (SELECT n, floor(c) + k AS j, abs(c - floor(c) - k) AS d FROM {c}, (SELECT unnest([-3, -2, -1, 0, 1, 2, 3, 4]) AS k))",
    }[kernel].replace("{c}", f"{name}c")
    return f"{name}c AS (SELECT range AS n, (range + 0.5::DOUBLE) * {old} / {new} - 0.5 AS c FROM range({new})), {name}r AS ({near}), {name} AS (SELECT n, greatest(0, least({old - 1}, j))::BIGINT AS at, w / sum(w) OVER (PARTITION BY n) AS w FROM {name}r)"


def _resample_sql(kernel, new_height, new_width):
    return f"WITH {PX}, {_taps(48, new_height, kernel, 'ty')}, {_taps(64, new_width, kernel, 'tx')}, h AS (SELECT img, yy, tx.n AS xx, sum(v * w) AS v FROM px JOIN tx ON tx.at = px.xx GROUP BY ALL) SELECT img, ty.n AS yy, xx, round(sum(v * w), 6) AS v FROM h JOIN ty ON ty.at = h.yy GROUP BY ALL"


@query("resample_area", _resample_sql("area", 35, 27))
def resample_area(spark, sf_dir):
    return rounded(T.resampled(pixels(spark, sf_dir), HEIGHT, WIDTH, 35, 27, "area"), "v")


@query("resample_cubic", _resample_sql("cubic", 60, 100))
def resample_cubic(spark, sf_dir):
    return rounded(T.resampled(pixels(spark, sf_dir), HEIGHT, WIDTH, 60, 100, "cubic"), "v")


@query("resample_lanczos", _resample_sql("lanczos", 36, 70))
def resample_lanczos(spark, sf_dir):
    return rounded(T.resampled(pixels(spark, sf_dir), HEIGHT, WIDTH, 36, 70, "lanczos"), "v")


@query("resample_nearest", f"WITH {PX} SELECT img, y.range AS yy, x.range AS xx, v FROM range(30) y, range(100) x JOIN px ON px.yy = (y.range * 48) // 30 AND px.xx = (x.range * 64) // 100")
def resample_nearest(spark, sf_dir):
    return T.nearest(pixels(spark, sf_dir), HEIGHT, WIDTH, 30, 100)


def _window(f, value, k, source, out):
    r = k // 2
    return f"SELECT *, {f}({value}) OVER (PARTITION BY img, yy ORDER BY xx RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {out}r FROM {source}", f"{f}({out}r) OVER (PARTITION BY img, xx ORDER BY yy RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {out}"


def _extreme_sql(f, k, out):
    rows, column = _window(f, "v", k, "px", out)
    return f"WITH {PX}, a AS ({rows}) SELECT img, yy, xx, {column} FROM a"


@query("erode", _extreme_sql("min", 3, "low"))
def erode(spark, sf_dir):
    return N.extreme(pixels(spark, sf_dir), "v", 3, False, "low").select("img", "yy", "xx", "low")


@query("dilate", _extreme_sql("max", 5, "high"))
def dilate(spark, sf_dir):
    return N.extreme(pixels(spark, sf_dir), "v", 5, True, "high").select("img", "yy", "xx", "high")


_OPEN = f"WITH {PX}, a AS (SELECT *, min(v) OVER (PARTITION BY img, yy ORDER BY xx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS r FROM px), b AS (SELECT *, min(r) OVER (PARTITION BY img, xx ORDER BY yy RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM a), c AS (SELECT *, max(e) OVER (PARTITION BY img, yy ORDER BY xx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS q FROM b) SELECT img, yy, xx, max(q) OVER (PARTITION BY img, xx ORDER BY yy RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS opened FROM c"


@query("opening", _OPEN)
def opening(spark, sf_dir):
    return N.opened(pixels(spark, sf_dir), "v", 3, "opened").select("img", "yy", "xx", "opened")


@query("nms", f"WITH {PX}, p AS (SELECT a.img, a.yy, a.xx, a.v, max(b.v) AS h, min(b.v) AS l FROM px a JOIN px b ON a.img = b.img AND b.yy BETWEEN a.yy - 2 AND a.yy + 2 AND b.xx BETWEEN a.xx - 2 AND a.xx + 2 GROUP BY ALL) SELECT img, yy, xx, v = h AND v - l > 20 AS peak FROM p")
def nms(spark, sf_dir):
    return N.peaks(pixels(spark, sf_dir), "v", 5, "peak", 20).select("img", "yy", "xx", "peak")


def _mirrored(weights, out, source="px", value="v", name="k"):
    """SQL of a 3 x 3 stencil on `source`, mirrored at the edges of 48 x 64 pixels: each pixel, and its copies just outside, add to what sees them."""
    rows = ", ".join(f"({dy}, {dx}, {w})" for (dy, dx), w in weights.items())
    places = lambda at, n: f"unnest(list_filter([{at}, CASE {at} WHEN 1 THEN -1 END, CASE {at} WHEN {n - 2} THEN {n} END], lambda p: p IS NOT NULL))"
    edge = f"{name}y AS (SELECT *, {places('yy', 48)} AS y FROM {source}), {name}x AS (SELECT *, {places('xx', 64)} AS x FROM {name}y)"
    sums = f"SELECT img, y - dy AS yy, x - dx AS xx, sum({value} * w) AS {out} FROM {name}x, {name}w WHERE y - dy BETWEEN 0 AND 47 AND x - dx BETWEEN 0 AND 63 GROUP BY ALL"
    return f"{name}w(dy, dx, w) AS (VALUES {rows}), {edge}, {name} AS ({sums})"


@query("laplacian", f"WITH {PX}, {_mirrored(N.LAPLACIAN, 'lap')} SELECT img, yy, xx, lap::DOUBLE AS lap FROM k")
def laplacian(spark, sf_dir):
    return N.laplacian(pixels(spark, sf_dir), "v")


@query("box_blur", f"WITH {PX}, {_mirrored({p: 1 for p in N.BOX}, 'b')} SELECT img, yy, xx, round(b / 9.0, 6) AS blur FROM k")
def box_blur(spark, sf_dir):
    return rounded(N.blurred(pixels(spark, sf_dir), "v"), "blur")


@query("zero_cross", f"WITH {PX}, {_mirrored(N.LAPLACIAN, 'lap')}, e AS (SELECT a.img, a.yy, a.xx, a.lap, max(b.lap) AS h, min(b.lap) AS l FROM k a JOIN k b ON a.img = b.img AND b.yy BETWEEN a.yy - 1 AND a.yy + 1 AND b.xx BETWEEN a.xx - 1 AND a.xx + 1 GROUP BY ALL) SELECT img, yy, xx, (lap > 0 AND l < 0) OR (lap < 0 AND h > 0) AS crossing FROM e")
def zero_cross(spark, sf_dir):
    return N.zero_crossing(pixels(spark, sf_dir), "v")


_GRAD = f"{_mirrored(N.SCHARR_X, 'g', name='sx')}, {_mirrored(N.SCHARR_Y, 'g', name='sy')}, g AS (SELECT img, yy, xx, floor(sx.g / 32)::BIGINT AS gx, floor(sy.g / 32)::BIGINT AS gy FROM sx JOIN sy USING (img, yy, xx))"


@query("scharr", f"WITH {PX}, {_GRAD} SELECT img, yy, xx, gx, gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM g")
def scharr(spark, sf_dir):
    return rounded(N.gradient(pixels(spark, sf_dir), "v"), "magnitude")


_RAW = f"{_mirrored(N.SCHARR_X, 'g', name='sx')}, {_mirrored(N.SCHARR_Y, 'g', name='sy')}"
_SIZE = "round_even(least(255.0, abs(sx.g)) * 0.5 + least(255.0, abs(sy.g)) * 0.5, 0)"


@query("gradient_8bit", f"WITH {PX}, {_RAW} SELECT img, yy, xx, {_SIZE}::DOUBLE AS g FROM sx JOIN sy USING (img, yy, xx)")
def gradient_8bit(spark, sf_dir):
    return N.gradient_8bit(pixels(spark, sf_dir), "v")


def _windows(name, source, outputs, carry=()):
    """SQL of 3 x 3 stencils on columns of `source` in one pass: neighbours by lag and lead, mirrored at the edges."""
    values = list(dict.fromkeys([v for v, _ in outputs.values()]))
    around = lambda c, w: [f"coalesce(lag({c}) OVER {w}, lead({c}) OVER {w})", c, f"coalesce(lead({c}) OVER {w}, lag({c}) OVER {w})"]
    row = ", ".join(f"{e} AS {v}_{i}" for v in values for i, e in enumerate(around(v, "r")))
    square = ", ".join(f"{e} AS {v}_{j}{i}" for v in values for i in range(3) for j, e in enumerate(around(f"{v}_{i}", "c")))
    sums = ", ".join(f"{' + '.join(f'{v}_{dy + 1}{dx + 1} * {w}' for (dy, dx), w in weights.items())} AS {out}" for out, (v, weights) in outputs.items())
    kept = "".join(f", {c}" for c in carry)
    return f"""{name}r AS (SELECT img, yy, xx{kept}, {row} FROM {source} WINDOW r AS (PARTITION BY img, yy ORDER BY xx)),
{name}c AS (SELECT img, yy, xx{kept}, {square} FROM {name}r WINDOW c AS (PARTITION BY img, xx ORDER BY yy)), {name} AS (SELECT img, yy, xx{kept}, {sums} FROM {name}c)"""


_ONES = {p: 1 for p in N.BOX}
_DIVERGES = {"dx": ("gx", N.SCHARR_X), "dy": ("gy", N.SCHARR_Y)}
_ROCK = f"""{_windows('s1', 'px', {'sx': ('v', N.SCHARR_X), 'sy': ('v', N.SCHARR_Y), 'b': ('v', _ONES)})}, s2 AS (SELECT img, yy, xx, floor(sx / 32)::BIGINT AS gx, floor(sy / 32)::BIGINT AS gy, b FROM s1),
{_windows('s3', 's2', _DIVERGES, ('gx', 'gy', 'b'))}"""


@query("rock_mask", f"WITH {PX}, {_ROCK} SELECT img, yy, xx, b / 9.0 > 100 AND sqrt(gx * gx + gy * gy) < 40 AND floor(dx / 32) * 0.5 + floor(dy / 32) * 0.5 < 5 AS rock FROM s3")
def rock_mask(spark, sf_dir):
    return N.rock_mask(pixels(spark, sf_dir), "v", 5.0, 40.0, 100.0)


#: 8-bit hills; the SQL rounds the same product of two tent functions.
_HILLS = "fld AS (SELECT s_suppkey::INTEGER AS img, y.range AS yy, x.range AS xx, ((8 - abs((y.range + s_suppkey) % 16 - 8)) * (10 - abs((x.range + 2 * s_suppkey) % 20 - 10)) * 3 * (s_suppkey % 2) + CASE WHEN s_suppkey % 2 = 0 AND (y.range + s_suppkey) % 16 < 9 AND (x.range + s_suppkey) % 20 < 13 THEN 200 + (y.range + x.range) % 5 ELSE 0 END)::INTEGER AS v FROM supplier, range(48) y, range(64) x)"


def hills(spark, sf_dir):
    """img, yy, xx, v: an 8-bit field for each supplier: hills of even slope, or blocks with steep edges."""
    s, y, x = F.col("img"), F.col("yy"), F.col("xx")
    even = (8 - F.abs((y + s) % 16 - 8)) * (10 - F.abs((x + 2 * s) % 20 - 10)) * 3 * (s % 2)
    steep = F.when((s % 2 == 0) & ((y + s) % 16 < 9) & ((x + s) % 20 < 13), 200 + (y + x) % 5).otherwise(0)
    return pixels(spark, sf_dir).select("img", "yy", "xx", (even + steep).cast("int").alias("v"))


_MASKS = f"""{_windows('bl', 'fld', {'b': ('v', _ONES)})}, b AS (SELECT img, yy, xx, floor(b / 9.0 + 0.5)::INTEGER AS v FROM bl),
{_windows('s1', 'b', {'sx': ('v', N.SCHARR_X), 'sy': ('v', N.SCHARR_Y)}, ('v',))}, s2 AS (SELECT img, yy, xx, v, floor(sx / 32)::BIGINT AS gx, floor(sy / 32)::BIGINT AS gy FROM s1),
{_windows('s3', 's2', _DIVERGES, ('v', 'gx', 'gy'))},
r AS (SELECT img, yy, xx, v AS c, floor(sqrt(gx * gx + gy * gy)) AS m, round_even(floor(dx / 32) * 0.5 + floor(dy / 32) * 0.5, 0) AS d FROM s3)"""


@query("rock_masks", f"WITH {_HILLS}, {_MASKS} SELECT img, yy, xx, d <= -0.255 AND c > 5.1 AND m < 2.55 AS little, m < 25.5 AND c > 63.75 AS big FROM r")
def rock_masks(spark, sf_dir):
    return N.rock_masks(hills(spark, sf_dir), "v")


_CORES = f"""{_mirrored(N.LAPLACIAN, 'lap', 'fld', name='k')}, {_mirrored(N.SCHARR_X, 'g', 'fld', name='sx')}, {_mirrored(N.SCHARR_Y, 'g', 'fld', name='sy')},
e AS (SELECT a.img, a.yy, a.xx, a.lap, max(b.lap) AS h, min(b.lap) AS l FROM k a JOIN k b ON a.img = b.img AND b.yy BETWEEN a.yy - 1 AND a.yy + 1 AND b.xx BETWEEN a.xx - 1 AND a.xx + 1 GROUP BY ALL),
hist AS (SELECT img, v, count(*) AS n FROM fld GROUP BY ALL),
tot AS (SELECT img, v, sum(n) OVER (PARTITION BY img ORDER BY v) AS n0, sum(n * v) OVER (PARTITION BY img ORDER BY v) AS s0, sum(n) OVER (PARTITION BY img) AS n1, sum(n * v) OVER (PARTITION BY img) AS s1 FROM hist),
cut AS (SELECT img, arg_max(v, (round(n0 / n1 * ((n1 - n0) / n1) * pow(s0 / n0 - (s1 - s0) / (n1 - n0), 2), 3), -v)) AS t FROM tot WHERE n1 > n0 GROUP BY img),
m AS (SELECT f.img, f.yy, f.xx, f.v, (f.v > coalesce(t, 0) AND f.v > 0 AND NOT (((lap > 0 AND l < 0) OR (lap < 0 AND h > 0)) AND {_SIZE} > 127))::INTEGER AS o FROM fld f JOIN e USING (img, yy, xx) JOIN sx USING (img, yy, xx) JOIN sy USING (img, yy, xx) LEFT JOIN cut ON cut.img = f.img),
q1 AS (SELECT *, min(o) OVER (PARTITION BY img, yy ORDER BY xx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM m), q2 AS (SELECT *, min(a) OVER (PARTITION BY img, xx ORDER BY yy RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b FROM q1),
q3 AS (SELECT *, max(b) OVER (PARTITION BY img, yy ORDER BY xx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM q2), q4 AS (SELECT *, max(c) OVER (PARTITION BY img, xx ORDER BY yy RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d FROM q3)"""


@query("rock_cores", f"WITH {_HILLS}, {_CORES} SELECT img, yy, xx, v, d > 0 AS core FROM q4")
def rock_cores(spark, sf_dir):
    return N.rock_cores(hills(spark, sf_dir), "v")
