"""Queries over annotations, regions, scores and documents in JSON, and their SQL."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from rasterloom.operators import annotations as A
from rasterloom.operators import jsondiff, metrics, tiled
from rasterloom.operators import regions as R
from rasterloom.plans.rasters import hills
from rasterloom.plans.registry import Registry, shared_folder, table
from rasterloom.sources import files
from rasterloom.sources.synthetic import PX, pixels
from rasterloom.streaming import extrema

query = Registry()
_CLASSES = ["a", "b"]


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _annotation_files(spark, sf_dir):
    """An annotation file for each supplier: a triangle whose class varies, and a box."""
    s = F.col("s_suppkey").cast("int")
    name = F.element_at(F.array(F.lit('"class": "a"'), F.lit('"class": "b"'), F.lit('"class": "z"'), F.lit("")), s % 4 + 1)
    x, y = s % 20, s % 10
    text = F.format_string(
        '{"k": {"filename": "img%d.png  ", "size": 1, "regions": [{"shape_attributes": {"name": "polygon", "all_points_x": [%d, %d, %d], "all_points_y": [%d, %d, %d]}, "region_attributes": {%s}}, '
        '{"shape_attributes": {"name": "rect", "x": 2, "y": 3, "width": %d, "height": 5}, "region_attributes": {"class": "b"}}], "file_attributes": {}}}',
        s, x, x + 10, x + 10, y, y, y + 10, name, s % 7 + 1,
    )
    return table(spark, sf_dir, "supplier").select(text.alias("value"))


_VIA = """s AS (SELECT s_suppkey AS s, 'img' || s_suppkey || '.png' AS filename, s_suppkey % 20 AS x, s_suppkey % 10 AS y, s_suppkey % 7 + 1 AS w, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS c FROM supplier),
r AS (SELECT filename, 0 AS seq, c AS cls, [x, x + 10, x + 10] AS xs, [y, y, y + 10] AS ys FROM s UNION ALL SELECT filename, 1, 1, [2, 2 + w, 2 + w, 2], [3, 3, 8, 8] FROM s)"""


@query("via_explode", f"WITH {_VIA} SELECT filename, seq, cls, len(xs)::INTEGER AS n FROM r")
def via_explode(spark, sf_dir):
    return A.items(_annotation_files(spark, sf_dir)).select("filename", "seq", A.region_class(F.col("attributes"), _CLASSES).alias("cls"), F.size(A.region_points(F.col("shape"))).alias("n"))


@query("via_points", f"WITH {_VIA} SELECT filename, seq, cls, xs, ys FROM r WHERE cls >= 0")
def via_points(spark, sf_dir):
    found = A.contours(_annotation_files(spark, sf_dir), _CLASSES)
    return found.select("filename", "seq", "cls", F.transform("points", lambda p: p["x"]).alias("xs"), F.transform("points", lambda p: p["y"]).alias("ys"))


@query("rasterise", f"WITH {_VIA}, g AS (SELECT s.*, y.range AS py, x.range AS px FROM s, range(16) y, range(24) x), m AS (SELECT filename, py, px, CASE WHEN px BETWEEN 2 AND 2 + w AND py BETWEEN 3 AND 8 THEN 1 WHEN c >= 0 AND px BETWEEN x AND x + 10 AND py >= y AND py - y <= px - x THEN c ELSE -1 END AS cls FROM g) SELECT filename, cls::INTEGER AS cls, count(*) AS n, sum(py * 100 + px)::BIGINT AS place FROM m WHERE cls >= 0 GROUP BY ALL")
def rasterise(spark, sf_dir):
    shapes = A.order_of_classes(A.contours(_annotation_files(spark, sf_dir), _CLASSES), ["filename"])
    return A.rasterise(shapes, 16, 24, ["filename"]).groupBy("filename", "cls").agg(F.count("*").alias("n"), F.sum(F.col("yy") * 100 + F.col("xx")).cast("bigint").alias("place"))


@query("contour_collect", f"WITH {_VIA} SELECT cls, count(*) AS contours, sum(len(xs))::BIGINT AS points FROM r WHERE cls >= 0 GROUP BY cls")
def contour_collect(spark, sf_dir):
    return A.gathered(A.thick_enough(A.contours(_annotation_files(spark, sf_dir), _CLASSES)))


@query("via_json", f"""WITH {_VIA}, j AS (SELECT filename, seq, '{{"shape_attributes":{{"name":"polygon","all_points_x":[' || array_to_string(xs, ',') || '],"all_points_y":[' || array_to_string(ys, ',') || ']}},"region_attributes":{{"class":"' || CASE cls WHEN 0 THEN 'a' ELSE 'b' END || '"}}}}' AS t FROM r WHERE cls >= 0)
SELECT filename, '{{"filename":"' || filename || '","size":-1,"regions":[' || string_agg(t, ',' ORDER BY seq) || ']}}' AS json FROM j GROUP BY filename""")
def via_json(spark, sf_dir):
    return A.via_json(A.contours(_annotation_files(spark, sf_dir), _CLASSES), _CLASSES)


@query("hierarchy_order", "WITH p AS (SELECT l_orderkey AS img, l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_linenumber // 2 END AS parent FROM lineitem), h AS (SELECT *, EXISTS (SELECT 1 FROM p q WHERE q.img = p.img AND q.parent = p.id) AS has_child FROM p WHERE parent IS NOT NULL) SELECT img, id, has_child, row_number() OVER (PARTITION BY img ORDER BY has_child, id)::INTEGER AS turn FROM h")
def hierarchy_order(spark, sf_dir):
    n = F.col("l_linenumber")
    shapes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img"), n.alias("id"), F.when(n > 1, F.floor(n / 2).cast("int")).alias("parent"))
    return A.inner_first(shapes).select("img", "id", "has_child", "turn")


_SET = PX + ", m AS (SELECT img, yy, xx, v < 96 AS s FROM px)"
#: Labels by runs of set pixels in a row, which are few: runs of neighbouring rows that touch pass on their labels.
_LABELS = """g AS (SELECT img, yy, xx, xx - row_number() OVER (PARTITION BY img, yy ORDER BY xx) AS k FROM m WHERE s),
u AS (SELECT img, yy, min(xx) AS a, max(xx) AS b FROM g GROUP BY img, yy, k),
r AS (SELECT img, yy, a, b, yy * 64 + a + 1 AS label FROM u UNION SELECT u.img, u.yy, u.a, u.b, r.label FROM r JOIN u ON u.img = r.img AND abs(u.yy - r.yy) = 1 AND u.a <= r.b + 1 AND r.a <= u.b + 1),
n AS (SELECT img, yy, a, b, min(label) AS label FROM r GROUP BY ALL),
l AS (SELECT m.img, m.yy, m.xx, n.label FROM m JOIN n ON n.img = m.img AND n.yy = m.yy AND m.xx BETWEEN n.a AND n.b)"""


def _set(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("s", F.col("v") < 96)


@query("components", f"WITH RECURSIVE {_SET}, {_LABELS} SELECT img, yy, xx, label FROM l")
def components(spark, sf_dir):
    return R.components(_set(spark, sf_dir), "s")


@query("components_tiled", f"WITH RECURSIVE {_SET}, {_LABELS} SELECT img, yy, xx, label FROM l")
def components_tiled(spark, sf_dir):
    return R.components_by_tile(_set(spark, sf_dir), "s", 20)


_DIST = "d AS (SELECT a.img, a.yy, a.xx, CASE WHEN a.s THEN min(1.3693 * least(abs(a.yy - b.yy), abs(a.xx - b.xx)) + 0.955 * (greatest(abs(a.yy - b.yy), abs(a.xx - b.xx)) - least(abs(a.yy - b.yy), abs(a.xx - b.xx)))) ELSE 0 END AS d FROM m a JOIN m b ON a.img = b.img AND NOT b.s GROUP BY a.img, a.yy, a.xx, a.s)"


@query("distance", f"WITH {_SET}, {_DIST} SELECT img, yy, xx, round(d, 6) AS d FROM d")
def distance(spark, sf_dir):
    return rounded(R.distances(_set(spark, sf_dir), "s"), "d")


@query("distance_tiled", f"WITH {_SET}, {_DIST} SELECT img, yy, xx, round(d, 6) AS d FROM d")
def distance_tiled(spark, sf_dir):
    return rounded(tiled.distances_by_tile(_set(spark, sf_dir), "s", 20), "d")


_SHARE = f"WITH RECURSIVE {_SET}, {_DIST}, {_LABELS}, t AS (SELECT d.*, l.label, max(d) OVER (PARTITION BY d.img, l.label) AS top FROM d LEFT JOIN l USING (img, yy, xx)) SELECT img, yy, xx, round(CASE WHEN label IS NULL THEN 0 ELSE d / top END, 6) AS share FROM t"


@query("mask_to_distance_tiled", _SHARE)
def mask_to_distance_tiled(spark, sf_dir):
    return rounded(tiled.mask_to_distance_by_tile(_set(spark, sf_dir), "s", 20), "share")


@query("mask_to_distance", _SHARE)
def mask_to_distance(spark, sf_dir):
    return rounded(R.mask_to_distance(_set(spark, sf_dir), "s"), "share")


def _marked(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("m", F.when((F.col("yy") % 12 == 6) & (F.col("xx") % 16 == 8), F.floor(F.col("yy") / 12) * 4 + F.floor(F.col("xx") / 16) + 1).otherwise(0))


@query("watershed")
def watershed(spark, sf_dir):
    return R.watershed(_marked(spark, sf_dir), "v", "m")


@query("watershed_tiled")
def watershed_tiled(spark, sf_dir):
    return tiled.watershed_by_tile(_marked(spark, sf_dir), "v", "m", 20)


#: Outlines by walking along the sides of set pixels, from the left of a region's first pixel until it is reached again.
_WALK = """e1 AS (SELECT img, yy, xx, s, coalesce(lag(s) OVER r, false) AS w, coalesce(lead(s) OVER r, false) AS e FROM m WINDOW r AS (PARTITION BY img, yy ORDER BY xx)),
e2 AS (SELECT img, yy, xx, s, [e, coalesce(lead(e) OVER c, false), coalesce(lead(s) OVER c, false), coalesce(lead(w) OVER c, false), w, coalesce(lag(w) OVER c, false), coalesce(lag(s) OVER c, false), coalesce(lag(e) OVER c, false)] AS nb FROM e1 WINDOW c AS (PARTITION BY img, xx ORDER BY yy)),
ways AS (SELECT [0, 1, 1, 1, 0, -1, -1, -1] AS wy, [1, 1, 0, -1, -1, -1, 0, 1] AS wx),
e3 AS (SELECT img, yy, xx, d, CASE WHEN nb[(d + 1) % 8 + 1] THEN (d + 1) % 8 WHEN nb[(d + 2) % 8 + 1] THEN (d + 2) % 8 END AS go, CASE WHEN nb[(d + 1) % 8 + 1] THEN (d + 6) % 8 WHEN nb[(d + 2) % 8 + 1] THEN d ELSE (d + 2) % 8 END AS nd
       FROM e2, (SELECT unnest([0, 2, 4, 6]) AS d) WHERE s AND NOT nb[d + 1]),
side AS MATERIALIZED (SELECT img, (yy * 64 + xx) * 8 + d AS here, ((yy + coalesce(wy[go + 1], 0)) * 64 + xx + coalesce(wx[go + 1], 0)) * 8 + nd AS next FROM e3, ways),
walk AS (SELECT DISTINCT img, label, 0 AS i, (label - 1) * 8 + 4 AS here FROM n UNION ALL SELECT walk.img, label, i + 1, side.next FROM walk JOIN side USING (img, here) WHERE side.next <> (label - 1) * 8 + 4),
v1 AS (SELECT img, label, i, here // 8 AS p, lag(here // 8) OVER (PARTITION BY img, label ORDER BY i) AS q FROM walk),
v2 AS (SELECT img, label, row_number() OVER (PARTITION BY img, label ORDER BY i) AS j, count(*) OVER (PARTITION BY img, label) AS k, p FROM v1 WHERE q IS NULL OR p <> q),
v3 AS (SELECT img, label, j, p % 64 AS x, p // 64 AS y FROM v2 WHERE NOT (j = k AND k > 1 AND p = label - 1)),
v4 AS (SELECT *, count(*) OVER z AS k, coalesce(lag(x) OVER o, last_value(x) OVER z) AS px, coalesce(lag(y) OVER o, last_value(y) OVER z) AS py, coalesce(lead(x) OVER o, first_value(x) OVER z) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER z) AS ny
       FROM v3 WINDOW o AS (PARTITION BY img, label ORDER BY j), z AS (PARTITION BY img, label ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
o AS (SELECT img, label AS contour, list(x::INTEGER ORDER BY j) AS xs, list(y::INTEGER ORDER BY j) AS ys FROM v4 WHERE k <= 2 OR x - px <> nx - x OR y - py <> ny - y GROUP BY ALL)"""
_CONTOURS = f"WITH RECURSIVE {_SET}, {_LABELS}, {_WALK} SELECT img, contour, xs, ys FROM o"


def _flat(shapes):
    return shapes.select("img", "contour", F.col("points.x").alias("xs"), F.col("points.y").alias("ys"))


@query("contours", _CONTOURS)
def contours(spark, sf_dir):
    return _flat(R.contours(_set(spark, sf_dir), "s"))


@query("contours_tiled", _CONTOURS)
def contours_tiled(spark, sf_dir):
    return _flat(tiled.contours_by_tile(_set(spark, sf_dir), "s", 20))


#: Outlines divided at their farthest points, over and over: i is the farthest point between a and b, d its distance.
_OFF = "CASE WHEN l > 0 THEN abs((x[b % n + 1] - x[a + 1]) * (y[j + 1] - y[a + 1]) - (y[b % n + 1] - y[a + 1]) * (x[j + 1] - x[a + 1])) / l ELSE sqrt(pow(x[j + 1] - x[a + 1], 2) + pow(y[j + 1] - y[a + 1], 2)) END"
_SPLIT = f"""f0 AS (SELECT img, contour, xs::DOUBLE[] AS x, ys::DOUBLE[] AS y, len(xs) AS n FROM o),
f1 AS (SELECT *, list_transform(range(n), lambda j: pow(x[j + 1] - x[1], 2) + pow(y[j + 1] - y[1], 2)) AS s FROM f0 WHERE n >= 4), f2 AS (SELECT *, list_position(s, list_max(s)) - 1 AS f FROM f1),
cut AS (SELECT img, contour, x, y, n, unnest([0, f]) AS a, unnest([f, n]) AS b FROM f2
        UNION ALL SELECT img, contour, x, y, n, unnest([a, k]) AS a, unnest([k, b]) AS b FROM (SELECT *, a + list_position(s, d) AS k FROM (SELECT *, list_max(s) AS d FROM (
            SELECT *, list_transform(range(a + 1, b), lambda j: {_OFF}) AS s FROM (SELECT *, sqrt(pow(x[b % n + 1] - x[a + 1], 2) + pow(y[b % n + 1] - y[a + 1], 2)) AS l FROM cut))) WHERE d > 1)),
ends AS (SELECT DISTINCT img, contour, a FROM cut)"""


@query("simplify", f"WITH RECURSIVE {_SET}, {_LABELS}, {_WALK}, {_SPLIT} SELECT img, contour, xs, ys FROM o WHERE len(xs) < 4 UNION ALL SELECT img, contour, list(xs[a + 1] ORDER BY a), list(ys[a + 1] ORDER BY a) FROM ends JOIN o USING (img, contour) GROUP BY ALL")
def simplify(spark, sf_dir):
    return _flat(R.simplify(tiled.contours_by_tile(_set(spark, sf_dir), "s", 20), 1.0))


@query("min_rectangle")
def min_rectangle(spark, sf_dir):
    return rounded(R.rectangles(R.contours(_set(spark, sf_dir), "s")).select("img", "contour", "cx", "cy", "min_d", "max_d"), "cx", "cy", "min_d", "max_d")


def _wave(step):
    return F.sin(F.col("yy") / step) * F.sin(F.col("xx") / step) * 0.5 + 0.5


def _field(spark, sf_dir, step):
    return pixels(spark, sf_dir).select("img", "yy", "xx", _wave(step).alias("p"))


@query("rock_instances")
def rock_instances(spark, sf_dir):
    return R.rock_instances(_field(spark, sf_dir, 3.0), "p", 5, 0.6)


@query("rock_two_scales")
def rock_two_scales(spark, sf_dir):
    fields = pixels(spark, sf_dir).select("img", "yy", "xx", *(_wave(step).alias(name) for name, step in (("fine", 3.0), ("coarse", 6.0))))
    return R.instances_of_scales(fields, "fine", "coarse", 5, 0.6, 9, 0.7)


def _chances(spark, sf_dir):
    return hills(spark, sf_dir).select("img", "yy", "xx", ((F.col("v") + 0.5) / 255).alias("p"))


@query("rock_production")
def rock_production(spark, sf_dir):
    return R.production_rocks(_chances(spark, sf_dir), "p")


@query("rock_production_tiled")
def rock_production_tiled(spark, sf_dir):
    return R.production_rocks(_chances(spark, sf_dir), "p", tile=20)


@query("rock_scales_tiled")
def rock_scales_tiled(spark, sf_dir):
    coarse = _field(spark, sf_dir, 6.0).withColumn("p", F.col("p") * 0.8)
    return R.two_scale_rocks(_chances(spark, sf_dir), coarse, "p", tile=20)


@query("rock_scales")
def rock_scales(spark, sf_dir):
    coarse = _field(spark, sf_dir, 6.0).withColumn("p", F.col("p") * 0.8)
    return R.two_scale_rocks(_chances(spark, sf_dir), coarse, "p")


@query("contour_tree")
def contour_tree(spark, sf_dir):
    """Inner borders of the inverse mask, leaves first, as the rocks' outlines are taken."""
    shapes = R.contour_tree(hills(spark, sf_dir).withColumn("s", F.col("v") > 60), "s", inverse=True)
    return A.inner_first(shapes).select("img", "id", "parent", "hole", "has_child", "turn", "points")


@query("contour_tree_tiled")
def contour_tree_tiled(spark, sf_dir):
    """What contour_tree gives, from tiles."""
    shapes = tiled.contour_tree_by_tile(hills(spark, sf_dir).withColumn("s", F.col("v") > 60), "s", 20, inverse=True)
    return A.inner_first(shapes).select("img", "id", "parent", "hole", "has_child", "turn", "points")


_CONF = "c AS (SELECT l_returnflag, sum((l_quantity > 25 AND l_discount > 0.05)::INTEGER) AS tp, sum((l_quantity > 25 AND l_discount <= 0.05)::INTEGER) AS fp, sum((l_quantity <= 25 AND l_discount > 0.05)::INTEGER) AS fn FROM lineitem GROUP BY 1)"


@query("metrics", f"WITH {_CONF} SELECT l_returnflag, round(tp / (tp + fp + fn), 6) AS iou, round(2 * tp / (2 * tp + fn + fp), 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2 FROM c")
def scores(spark, sf_dir):
    return rounded(metrics.scores(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_quantity") > 25, F.col("l_discount") > 0.05), "iou", "f1", "f2")


@query("metric_means", f"WITH {_CONF} SELECT round(avg(tp / (tp + fp + fn)), 6) AS iou, round(avg(2 * tp / (2 * tp + fn + fp)), 6) AS f1 FROM c")
def metric_means(spark, sf_dir):
    per = metrics.scores(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_quantity") > 25, F.col("l_discount") > 0.05)
    return rounded(metrics.dataset_means(per, ["iou", "f1"]), "iou", "f1")


@query("losses", "WITH a AS (SELECT l_linestatus, greatest(1e-7, least(1 - 1e-7, l_tax * 10)) AS p, (l_returnflag = 'R')::INTEGER AS y, CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 1.0 END AS w FROM lineitem), b AS (SELECT *, -(y * ln(p) + (1 - y) * ln(1 - p)) AS e, -(y * pow(1 - p, 2) * ln(p) + (1 - y) * pow(p, 2) * ln(1 - p)) AS f FROM a) SELECT l_linestatus, round(avg(e), 6) AS bce, round(sum(e * w) / sum(w), 6) AS weighted, round(avg(f), 6) AS focal, round(avg((p - y) * (p - y)), 6) AS mse, round(avg(abs(p - y)), 6) AS mae FROM b GROUP BY 1")
def losses(spark, sf_dir):
    hit = F.col("l_returnflag") == "R"
    found = metrics.losses(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_tax") * 10, hit.cast("int"), F.when(hit, 2.0).otherwise(1.0))
    return rounded(found, "bce", "weighted", "focal", "mse", "mae")


@query("running_extrema", "SELECT event_id, event_type, min(value) OVER w AS lowest, max(value) OVER w AS highest FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_extrema(spark, sf_dir):
    return metrics.running_extrema(table(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_id", "event_type", "lowest", "highest")


@query("accumulate", "WITH n AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 10 AS step FROM events) SELECT event_type, step, round(sum(value), 6) AS total FROM n GROUP BY ALL HAVING count(*) = 10")
def accumulate(spark, sf_dir):
    return rounded(metrics.accumulated(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 10), "total")


@query("running_extrema_stream", "SELECT event_type, min(value) AS lowest, max(value) AS highest, count(*) AS n FROM events GROUP BY 1")
def running_extrema_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")
    return extrema.run_once(extrema.extrema(stream, "event_type", "value"), f"{shared_folder(spark)}/extrema_{uuid.uuid4().hex}")


@query("json_diff", "WITH e AS (SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events) SELECT id, '/k' AS path, 'changed' AS change, k AS old_value, (k::INTEGER + 1)::VARCHAR AS new_value FROM e WHERE id % 3 = 1 UNION ALL SELECT id, '/k', 'removed', k, NULL FROM e WHERE id % 3 = 2 UNION ALL SELECT id, '/j', 'length', '1', '2' FROM e WHERE id % 3 = 2")
def json_diff(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    old = events.select("id", F.format_string('{"k": %d, "j": [1]}', "k").alias("text"))
    new = events.select("id", F.when(F.col("id") % 3 == 0, F.format_string('{"k": %d, "j": [1]}', "k")).when(F.col("id") % 3 == 1, F.format_string('{"k": %d, "j": [1]}', F.col("k") + 1)).otherwise(F.lit('{"j": [1, 5]}')).alias("text"))
    return jsondiff.difference(old, new, "id", "text")


@query("model_udf", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2 + 1)), 5) AS score FROM embeddings")
def model_udf(spark, sf_dir):
    """A model over batches of rows (M1): here a linear one."""

    def model(batches):
        for batch in batches:
            flat = batch.column(1).flatten().cast(pa.float64())
            scored = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, 64), pa.int32()), pc.add(pc.multiply(flat, 2.0), 1.0))
            sums = scored.values.to_numpy().reshape(-1, 64).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], ["vec_id", "score"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(model, "vec_id long, score double").withColumn("score", F.round("score", 5))


@query("gdalinfo", "SELECT s_suppkey AS path, s_suppkey + 0.5 AS ll_x, s_suppkey * 2 + 0.25 AS ll_y, s_suppkey + 100.5 AS ur_x, s_suppkey * 2 + 50.25 AS ur_y FROM supplier")
def gdalinfo(spark, sf_dir):
    s = F.col("s_suppkey")
    line = lambda name, x, y: F.format_string(name + "  ( %.2f, %.2f) (  1d 2' 3.0\"E)", x, y)
    lines = table(spark, sf_dir, "supplier").select(s.alias("path"), F.explode(F.array(F.lit("Size is 5, 5"), line("Lower Left", s + 0.5, s * 2 + 0.25), line("Upper Right", s + 100.5, s * 2 + 50.25))).alias("value"))
    return files.corners(lines).select("path", "ll_x", "ll_y", "ur_x", "ur_y")


@query("palette_text", "SELECT CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE (s_suppkey % 101)::DOUBLE END AS pct, (s_suppkey % 256)::INTEGER AS r, (s_suppkey * 3 % 256)::INTEGER AS g, (s_suppkey * 7 % 256)::INTEGER AS b FROM supplier WHERE s_suppkey % 5 <> 0")
def palette_text(spark, sf_dir):
    """A line a supplier, a fifth of them notes."""
    s = F.col("s_suppkey")
    first = F.when(s % 7 == 0, "nv").otherwise(F.format_string(" %d%%", s % 101))
    line = F.when(s % 5 == 0, F.format_string("# note %d", s)).otherwise(F.concat_ws("  ", first, s % 256, s * 3 % 256, s * 7 % 256, F.when(s % 2 == 0, "255")))
    return files.palette(table(spark, sf_dir, "supplier").select(line.alias("value")))
