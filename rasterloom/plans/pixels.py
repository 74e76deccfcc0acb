"""Queries over pixels, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import pixels as P
from rasterloom.plans.registry import Registry, table
from rasterloom.sources.synthetic import MASK, PX, masks, pixels

query = Registry()


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("quality_filter", f"WITH {MASK}, q AS (SELECT img, round(stddev_pop(v), 6) AS sd, round(avg((v <> 0)::INTEGER), 6) AS filled FROM px GROUP BY img), c AS (SELECT img, round(avg((mv <> 0)::INTEGER), 6) AS cover FROM mask GROUP BY img) SELECT img, sd, filled, cover FROM q JOIN c USING (img) WHERE sd > 0 AND filled >= 0.5 AND cover >= 0.3745")
def quality_filter(spark, sf_dir):
    return rounded(P.good_images([pixels(spark, sf_dir)], masks(spark, sf_dir), 0.5, 0.3745), "sd", "filled", "cover")


@query("class_balance", f"WITH {MASK}, k AS (SELECT img FROM mask GROUP BY img HAVING avg((mv <> 0)::INTEGER) >= 0.3), h AS (SELECT CASE WHEN mv = 0 THEN 2 ELSE 255 - mv END AS cls, count(*) AS n FROM mask WHERE img IN (SELECT img FROM k) GROUP BY 1) SELECT cls, n, round(n / sum(n) OVER () * 100, 6) AS share, round(min(n) OVER () / n, 6) AS weight FROM h")
def class_balance(spark, sf_dir):
    return rounded(P.class_balance(masks(spark, sf_dir), 2, 0.3), "share", "weight")


@query("class_freq_per_image", f"WITH {MASK}, o AS (SELECT img, mv, count(*) AS n FROM mask GROUP BY ALL) SELECT img, mv, n, (sum(n) OVER (PARTITION BY mv))::BIGINT AS n_all FROM o")
def class_freq_per_image(spark, sf_dir):
    return P.value_counts(masks(spark, sf_dir), "mv")


@query("onehot", f"WITH {MASK} SELECT img, sum((mv = 255)::INTEGER)::DOUBLE AS c0, sum((mv = 254)::INTEGER)::DOUBLE AS c1, sum((mv = 0)::INTEGER)::DOUBLE AS bg FROM mask GROUP BY img")
def onehot(spark, sf_dir):
    hot = masks(spark, sf_dir).select("img", P.one_hot(F.col("mv"), 2).alias("p"))
    return hot.groupBy("img").agg(*(F.sum(F.col("p")[i]).alias(n) for i, n in enumerate(("c0", "c1", "bg"))))


@query("regr_decode", f"WITH {PX} SELECT img, yy, xx, round(v / 255.0::DOUBLE, 6) AS p FROM px")
def regr_decode(spark, sf_dir):
    return rounded(pixels(spark, sf_dir).select("img", "yy", "xx", P.fraction(F.col("v")).alias("p")), "p")


@query("argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS cls FROM embeddings")
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", P.first_of_largest(F.col("embedding")).cast("bigint").alias("cls"))


@query("post_predict", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS at, 1::BIGINT AS n FROM embeddings")
def post_predict(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", P.decided(F.col("embedding"), 64).alias("d"))
    return d.select("vec_id", F.array_position("d", True).cast("bigint").alias("at"), F.size(F.filter("d", lambda x: x)).cast("bigint").alias("n"))


@query("threshold", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.1))::BIGINT AS n FROM embeddings")
def threshold(spark, sf_dir):
    on = P.over(F.col("embedding").cast("array<double>"), [0.1] * 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(on, F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("n"))


@query("clip", "SELECT event_id, least(1.0, greatest(0.0, value - 50)) AS p FROM events")
def clip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.within(F.col("value") - 50).alias("p"))


@query("band_project", f"WITH {PX} SELECT img, yy, xx, [(v + 2) % 256, (v + 1) % 256, v] AS bgr, [255 - v, 255 - (v + 1) % 256, 255 - (v + 2) % 256, 9] AS inv, [v, v, v] AS grey FROM px")
def band_project(spark, sf_dir):
    v = F.col("v")
    px = pixels(spark, sf_dir).withColumn("bands", F.array(v, (v + 1) % 256, (v + 2) % 256, F.lit(9).cast("long")))
    inverted = P.on_colours(F.col("bands"), lambda b: F.transform(b, lambda x: 255 - x))
    return px.select("img", "yy", "xx", P.colours(F.col("bands")).alias("bgr"), inverted.alias("inv"), P.repeated(v).alias("grey"))


@query("mean_field", f"WITH {PX} SELECT img, yy, xx, (v / 255.0 + (255 - v) / 510.0) / 2 AS p FROM px")
def mean_field(spark, sf_dir):
    px = pixels(spark, sf_dir)
    a, b = (px.select("img", "yy", "xx", p.alias("p")) for p in (F.col("v") / 255.0, (255 - F.col("v")) / 510.0))
    return P.mean_field([a, b], ["img", "yy", "xx"], "p")


@query("region_norm", f"WITH {PX}, t AS (SELECT *, max(v) OVER (PARTITION BY img, v // 32) AS top FROM px) SELECT img, yy, xx, round(v / top, 6) AS share FROM t")
def region_norm(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("label", F.floor(F.col("v") / 32))
    return rounded(P.region_share(px, ["img", "label"], "v").select("img", "yy", "xx", "share"), "share")


@query("percentile_stretch", f"WITH {PX}, e AS (SELECT img, quantile_cont(v, 0.02) AS l, quantile_cont(v, 0.98) AS h FROM px GROUP BY img) SELECT img, yy, xx, round(greatest(0, least(1, (v - l) / (h - l))), 6) AS stretched FROM px JOIN e USING (img)")
def percentile_stretch(spark, sf_dir):
    return rounded(P.percentile_stretch(pixels(spark, sf_dir), "v").select("img", "yy", "xx", "stretched"), "stretched")


@query("minmax_stretch", f"WITH {PX}, e AS (SELECT img, min(v) AS l, max(v) AS h FROM px GROUP BY img) SELECT img, yy, xx, ((v - l) * 255 // (h - l))::BIGINT AS stretched FROM px JOIN e USING (img)")
def minmax_stretch(spark, sf_dir):
    return P.range_stretch(pixels(spark, sf_dir), "v").select("img", "yy", "xx", F.col("stretched").cast("bigint").alias("stretched"))


@query("standardise", f"WITH {PX}, e AS (SELECT img, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY img) SELECT img, yy, xx, round(greatest(0, least(255, (v - m) / s * 33 + 136)), 6) AS standardised FROM px JOIN e USING (img)")
def standardise(spark, sf_dir):
    return rounded(P.standardised(pixels(spark, sf_dir), "v").select("img", "yy", "xx", "standardised"), "standardised")


_COLOUR = f"{PX}, c AS (SELECT img, yy, xx, v, CASE WHEN v % 5 = 0 THEN 0 ELSE v END AS r, CASE WHEN v % 5 = 0 THEN 0 ELSE 255 - v END AS g, CASE WHEN v % 5 = 0 THEN 0 ELSE v * 2 % 256 END AS b FROM px)"


def _colours(spark, sf_dir):
    """Coloured rasters, a fifth of them black."""
    v = F.col("v")
    lit = lambda c: F.when(v % 5 == 0, 0).otherwise(c)
    return pixels(spark, sf_dir).select("img", "yy", "xx", "v", lit(v).alias("r"), lit(255 - v).alias("g"), lit(v * 2 % 256).alias("b"))


@query("rock_bands", f"WITH {_COLOUR}, w AS (SELECT img, yy, xx, v, CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 127 ELSE greatest(r, g, b) END AS w FROM c), e AS (SELECT img, avg(w) AS m, stddev_pop(w) AS s FROM w GROUP BY img), z AS (SELECT img, yy, xx, v, floor(round(greatest(0, least(255, (w - m) / s * 33 + 136)), 6))::INTEGER AS z FROM w JOIN e USING (img)) SELECT img, yy, xx, [z, z, (v // 2)::INTEGER] AS bands FROM z")
def rock_bands(spark, sf_dir):
    return P.rock_bands(_colours(spark, sf_dir).withColumn("height", F.floor(F.col("v") / 2)))


_DARK = "floor(round((l * 0.5 + ({0} / 255.0::DOUBLE - l) * k) * 255, 6) + 0.5)::INTEGER"


@query("shadow_colour", f"""WITH {_COLOUR}, h AS (SELECT *, (greatest(r, g, b) + least(r, g, b)) / 510.0::DOUBLE AS l FROM c), k AS (SELECT *, CASE WHEN greatest(r, g, b) > least(r, g, b) THEN (1 - abs(l - 1)) / (1 - abs(2 * l - 1)) ELSE 0 END AS k FROM h)
SELECT img, yy, xx, CASE WHEN xx BETWEEN 5 AND 40 AND yy BETWEEN 5 AND xx THEN [{_DARK.format('r')}, {_DARK.format('g')}, {_DARK.format('b')}] ELSE [r::INTEGER, g::INTEGER, b::INTEGER] END AS colour FROM k""")
def shadow_colour(spark, sf_dir):
    found = P.shadowed_colours(_colours(spark, sf_dir), [(5, 5), (40, 5), (40, 40)])
    return found.select("img", "yy", "xx", F.array("r", "g", "b").alias("colour"))


@query("standard_bands", f"WITH {PX} SELECT img, yy, xx, round((v - 100) / 50.0, 6) AS b0, round((v - 110) / 60.0, 6) AS b1 FROM px")
def standard_bands(spark, sf_dir):
    z = P.standard_bands(F.array("v", "v"), [100.0, 110.0], [50.0, 60.0])
    return rounded(pixels(spark, sf_dir).select("img", "yy", "xx", z[0].alias("b0"), z[1].alias("b1")), "b0", "b1")


_OTSU = "h AS (SELECT img, v, count(*) AS n FROM px GROUP BY img, v), c AS (SELECT img, v, sum(n) OVER u AS n0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY img) AS n1, sum(n * v) OVER (PARTITION BY img) AS s1 FROM h WINDOW u AS (PARTITION BY img ORDER BY v)), s AS (SELECT img, v, round(n0 / n1 * ((n1 - n0) / n1) * pow(s0 / n0 - (s1 - s0) / (n1 - n0), 2), 3) AS score FROM c WHERE n1 > n0)"


@query("otsu", f"WITH {PX}, {_OTSU}, r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, v) AS k FROM s) SELECT img, v AS threshold FROM r WHERE k = 1")
def otsu(spark, sf_dir):
    return P.otsu(pixels(spark, sf_dir), "v")


@query("sanity_stats", f"WITH {PX} SELECT img, min(v) AS lowest, max(v) AS highest, count(*) AS n, max(yy) + 1 AS height, max(xx) + 1 AS width, round(avg((v <> 0)::INTEGER), 6) AS masked FROM px GROUP BY img")
def sanity_stats(spark, sf_dir):
    return rounded(P.extremes(pixels(spark, sf_dir), "v"), "masked")


_HSV = """
c AS (SELECT img, yy, xx, v / 255.0::DOUBLE AS r, ((v * 3 + 40) % 256) / 255.0::DOUBLE AS g, ((v * 5 + 90) % 256) / 255.0::DOUBLE AS b FROM px),
h AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS ch FROM c),
a AS (SELECT *, CASE WHEN ch = 0 THEN 0 WHEN mx = r THEN (g - b) / ch WHEN mx = g THEN (b - r) / ch + 2 ELSE (r - g) / ch + 4 END AS h0 FROM h),
s AS (SELECT *, ((floor(round((((h0 % 6) + 6) % 6) * 30, 6) + 0.5) + 20) % 180) / 30.0 AS hh, least(255, greatest(0, floor(round(CASE WHEN mx = 0 THEN 0 ELSE ch / mx END * 255, 6) + 0.5) + 30)) / 255.0 AS ss, least(255, greatest(0, floor(round(mx * 255, 6) + 0.5) - 10)) / 255.0 AS vv FROM a),
k AS (SELECT *, (hh + 5) % 6 AS k5, (hh + 3) % 6 AS k3, (hh + 1) % 6 AS k1 FROM s)
SELECT img, yy, xx, floor(round((vv - vv * ss * greatest(0, least(1, k5, 4 - k5))) * 255, 6) + 0.5)::INTEGER AS r, floor(round((vv - vv * ss * greatest(0, least(1, k3, 4 - k3))) * 255, 6) + 0.5)::INTEGER AS g,
       floor(round((vv - vv * ss * greatest(0, least(1, k1, 4 - k1))) * 255, 6) + 0.5)::INTEGER AS b FROM k"""


@query("hsv_shift", f"WITH {PX}, {_HSV}")
def hsv_shift(spark, sf_dir):
    v = F.col("v")
    px = pixels(spark, sf_dir).withColumn("c", P.hue_shift(v, (v * 3 + 40) % 256, (v * 5 + 90) % 256, 20, 30, -10))
    return px.select("img", "yy", "xx", *(F.col("c")[i].alias(n) for i, n in enumerate("rgb")))


@query("brightness", f"WITH {PX}, m AS (SELECT img, avg(v) AS m FROM px GROUP BY img) SELECT img, yy, xx, trunc(least(255, greatest(0, v * 1.25 + m * 0.5)))::INTEGER AS bright FROM px JOIN m USING (img)")
def brightness(spark, sf_dir):
    return P.brightened(pixels(spark, sf_dir), "v", 1.25, 0.5).select("img", "yy", "xx", "bright")


@query("brightness_by_max", f"WITH {PX} SELECT img, yy, xx, trunc(least(255, greatest(0, v * 0.75 + 51)))::INTEGER AS bright FROM px")
def brightness_by_max(spark, sf_dir):
    return P.brightened(pixels(spark, sf_dir), "v", 0.75, 0.2, False).select("img", "yy", "xx", "bright")


@query("gamma", f"WITH {PX} SELECT img, yy, xx, trunc(pow(v / 255.0::DOUBLE, 0.8) * 255.0)::INTEGER AS g FROM px")
def gamma(spark, sf_dir):
    return pixels(spark, sf_dir).select("img", "yy", "xx", P.gamma(F.col("v"), 0.8).alias("g"))


@query("lut_height", f"WITH {PX} SELECT img, yy, xx, CASE WHEN v <= 100 THEN round(v / 2.0, 6) WHEN v <= 200 THEN round(50 + (v - 100) / 2.0, 6) END AS pct FROM px")
def lut_height(spark, sf_dir):
    palette = spark.createDataFrame([(0.0, 0, 0, 0), (50.0, 100, 0, 0), (100.0, 200, 0, 0)], "pct double, r int, g int, b int")
    px = pixels(spark, sf_dir).select("img", "yy", "xx", F.col("v").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return rounded(P.height_lookup(px, palette).select("img", "yy", "xx", "pct"), "pct")


@query("pack_rgb", f"WITH {PX} SELECT img, yy, xx, v * 65536 + ((v * 3) % 256) * 256 + (v * 5) % 256 AS rgb, (v * 3) % 256 AS g FROM px")
def pack_rgb(spark, sf_dir):
    v = F.col("v")
    px = pixels(spark, sf_dir).withColumn("rgb", P.packed(v, (v * 3) % 256, (v * 5) % 256))
    return px.select("img", "yy", "xx", F.col("rgb").cast("bigint").alias("rgb"), P.unpacked(F.col("rgb"))[1].cast("bigint").alias("g"))


@query("mask_ops", f"WITH {PX} SELECT img, sum((v > 100 OR v % 2 = 0)::INTEGER)::BIGINT AS either, sum((v > 100 AND v % 2 = 0)::INTEGER)::BIGINT AS both, sum((v > 100 AND v % 2 <> 0)::INTEGER)::BIGINT AS less FROM px GROUP BY img")
def mask_ops(spark, sf_dir):
    a, b = F.col("v") > 100, F.col("v") % 2 == 0
    return pixels(spark, sf_dir).groupBy("img").agg(F.count_if(a | b).alias("either"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("less"))


@query("mask_bag_union", f"WITH {MASK} SELECT mv, count(*) AS n FROM (SELECT mv FROM mask UNION ALL SELECT mv FROM mask) GROUP BY mv")
def mask_bag_union(spark, sf_dir):
    m = masks(spark, sf_dir)
    return m.unionByName(m).groupBy("mv").agg(F.count("*").alias("n"))


@query("shadow", f"WITH {PX} SELECT img, yy, xx, CASE WHEN xx BETWEEN 5 AND 40 AND yy BETWEEN 5 AND xx THEN floor(v * 0.5)::BIGINT ELSE v END AS shaded FROM px")
def shadow(spark, sf_dir):
    rows = P.shadowed(pixels(spark, sf_dir), [(5, 5), (40, 5), (40, 40)])
    return rows.select("img", "yy", "xx", F.col("shaded").cast("bigint").alias("shaded"))
