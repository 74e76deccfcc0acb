"""Hand fixtures and invariants of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geo, schedule, text
from rasterloom.operators import annotations, jsondiff, metrics, regions, sampling, stencils, tiling
from rasterloom.sources import files, tiff


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("shape", "tile", "step", "rows", "columns"),
    [((48, 64), 50, 50, [-1], [-18, 32]), ((100, 120), 50, 50, [0, 50], [-15, 35, 85]), ((100, 101), 50, 50, [0, 50], [-24, 26, 76])],
)
def test_tile_grid(spark, shape, tile, step, rows, columns):
    assert tiling.axis_starts(shape[0], tile, step) == rows
    assert tiling.axis_starts(shape[1], tile, step) == columns
    images = spark.createDataFrame([(1, *shape)], "img int, height int, width int")
    found = tiling.tile_grid(images, tile, step).orderBy("ty", "tx").collect()
    assert [(r.y0, r.x0) for r in found] == [(y, x) for y in rows for x in columns]


def test_spline():
    w = tiling.spline(8)
    assert np.allclose(w, [0.0625, 0.5625, 1.4375, 1.9375, 1.9375, 1.4375, 0.5625, 0.0625])
    for n in (64, 128):
        w = tiling.spline(n)
        assert math.isclose(w.mean(), 1) and np.allclose(w[: n // 2] + w[n // 2 :], 2)


def test_blend_is_identity(spark):
    px = spark.range(24 * 32).select(F.lit(1).alias("img"), F.floor(F.col("id") / 32).alias("yy"), (F.col("id") % 32).alias("xx"), (F.col("id") * 7 % 256).alias("v"))
    found = {(r.yy, r.xx): r.v for r in tiling.blend(px, 24, 32, 16).collect()}
    assert all(abs(found[r.yy, r.xx] - r.v) < 1e-9 for r in px.collect())


def test_orientations_are_undone(spark):
    px = spark.range(25).select(F.lit(1).alias("img"), F.floor(F.col("id") / 5).alias("yy"), (F.col("id") % 5).alias("xx"), F.col("id").cast("double").alias("v"))
    found = {(r.yy, r.xx): r.v for r in tiling.orientation_mean(px, 5, "v", lambda rows: rows).collect()}
    assert all(found[r.yy, r.xx] == r.v for r in px.collect())


def test_tiles(spark):
    lat, lon = F.lit(51.5), F.lit(-0.12)
    mx, my = geo.mercator(lat, lon)
    z = F.lit(10)
    r = one(spark, geo.tile_of(geo.to_pixels(mx, z)).alias("x"), geo.tile_of(geo.to_pixels(my, z)).alias("y"), geo.flipped(F.lit(683), 10).alias("g"))
    assert (r.x, r.y, r.g) == (511, 683, 340)
    r = one(spark, *(geo.tile_of(F.lit(p)).alias(f"t{p}") for p in (0, 256, 257)))
    assert list(r) == [-1, 0, 1]
    r = one(spark, *(geo.zoom_for(F.lit(p)).alias(f"z{i}") for i, p in enumerate((1e6, 156543.1, 0.1, 1e-9))))
    assert list(r) == [0, 0, 20, None]
    r = one(spark, geo.quadkey(F.lit(3), F.lit(5), 3).alias("a"), geo.quadkey(F.lit(0), F.lit(0), 3).alias("b"))
    assert list(r) == ["031", "222"]


def test_outline_pixels(spark):
    points = F.array(F.struct(F.lit(5.0).alias("x"), F.lit(7.0).alias("y")))
    r = one(spark, geo.outline_pixels(points, (0.0, 0.0, 50.0, 25.0), 201, 101).alias("p"))
    assert (r.p[0].x, r.p[0].y) == (20, 72)


def test_transverse_mercator(spark):
    r = one(spark, *(c.alias(n) for c, n in zip(geo.transverse(F.lit(0.0), F.lit(3.0), 3.0), "xy", strict=True)))
    assert math.isclose(r.x, 500000) and abs(r.y) < 1e-6


def test_schedules(spark):
    e = F.lit
    r = one(
        spark, schedule.step_decay(e(8), 0.01, 0.25, 10).alias("a"), schedule.step_decay(e(9), 0.01, 0.25, 10).alias("b"), schedule.polynomial_decay(e(50), 0.01, 100).alias("c"),
        *(schedule.cosine_restarts(e(i), 0.1, 100, 5).alias(f"d{i}") for i in (0, 5, 10, 19, 20)), schedule.snapshot_after(e(19), 100, 5).alias("s"),
    )
    assert np.allclose(list(r), [0.01, 0.0025, 0.005, 0.1, 0.085355339, 0.05, 0.000615583, 0.1, 1])


def test_between(spark):
    assert one(spark, text.between(F.lit("a[b]c[d]"), "[", "]").alias("x")).x == "b"
    with pytest.raises(Exception, match="no value between"):
        one(spark, text.between(F.lit("ab"), "[", "]").alias("x"))


def test_split_sizes(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert sampling.split(rows, "k", 0.25, 1).where("part = 'test'").count() == 3
    assert [sampling.thin_out(rows, "k", r, 1).count() for r in (0.5, 1.0, 0.0)] == [5, 10, 10]
    a = sampling.split(rows.repartition(7), "k", 0.25, 1).orderBy("k").collect()
    assert a == sampling.split(rows.coalesce(1), "k", 0.25, 1).orderBy("k").collect()


def test_box_points(spark):
    shape = F.from_json(F.lit('{"name":"rect","x":2,"y":3,"width":4,"height":5}'), "name string, all_points_x array<int>, all_points_y array<int>, x int, y int, width int, height int")
    r = one(spark, annotations.region_points(shape).alias("p"))
    assert [(p.x, p.y) for p in r.p] == [(2, 3), (6, 3), (6, 8), (2, 8)]


def square(*boxes, n=12):
    a = np.zeros((n, n), bool)
    for y0, x0, y1, x1 in boxes:
        a[y0:y1, x0:x1] = True
    return a


def as_pixels(spark, a, name="s"):
    return spark.createDataFrame([(1, int(y), int(x), bool(v)) for (y, x), v in np.ndenumerate(a)], f"img int, yy long, xx long, {name} boolean")


def test_contours(spark):
    found = regions.contours(as_pixels(spark, square((1, 1, 4, 5), (6, 6, 9, 9))), "s").orderBy("contour").collect()
    assert [sorted((p.x, p.y) for p in r.points) for r in found] == [[(1, 1), (1, 3), (4, 1), (4, 3)], [(6, 6), (6, 8), (8, 6), (8, 8)]]
    assert regions.contours(as_pixels(spark, square()), "s").count() == 0
    assert regions.outline(square((2, 2, 3, 3)), 2, 2) == [(2, 2)]


def test_labels():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.random((9, 11)) < 0.45
        label = regions.label_array(a)
        seen = np.zeros_like(a)
        for y, x in np.argwhere(a):
            if seen[y, x]:
                continue
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                p, q = todo.pop()
                cells.append((p, q))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        b, c = p + dy, q + dx
                        if 0 <= b < 9 and 0 <= c < 11 and a[b, c] and not seen[b, c]:
                            seen[b, c] = True
                            todo.append((b, c))
            assert {int(label[c]) for c in cells} == {int(y * 11 + x + 1)}


def test_seams(spark):
    a = square((1, 1, 3, 11), (5, 2, 11, 4), (10, 8, 11, 11))
    whole = {(r.yy, r.xx): r.label for r in regions.components(as_pixels(spark, a), "s").collect()}
    tiles = np.zeros(a.shape, int)
    for y in range(0, 12, 6):
        for x in range(0, 12, 6):
            part = regions.label_array(a[y : y + 6, x : x + 6])
            local = np.arange(1, 37).reshape(6, 6)
            place = (local - 1) // 6 * 12 + (local - 1) % 6 + y * 12 + x + 1
            tiles[y : y + 6, x : x + 6] = np.where(part > 0, place.ravel()[np.maximum(part - 1, 0)], 0)
    labels = spark.createDataFrame([(1, int(y), int(x), int(tiles[y, x])) for y, x in np.argwhere(tiles)], "img int, yy long, xx long, label long")
    found = {(r.yy, r.xx): r.label for r in regions.joined_over_seams(labels, 6).collect()}
    assert found == whole


def test_long_chains(spark):
    """A path of 60 labels, in a mixed order, beside a star and a pair in another image."""
    order = np.random.default_rng(8).permutation(60) + 1
    edges = [(1, int(a), int(b)) for a, b in zip(order, order[1:], strict=False)] + [(1, 100, 100 + i) for i in range(1, 9)] + [(2, 5, 1), (2, 7, 7)]
    found = {(r.img, r.a): r.b for r in regions._stars(spark.createDataFrame(edges, "img int, a long, b long")).collect()}
    assert found == {(1, i): 1 for i in range(2, 61)} | {(1, 100 + i): 100 for i in range(1, 9)} | {(2, 5): 1}


def test_parts_of_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(["a", "a", "a", "b", None][rng.integers(5)], int(i), None if i % 11 == 0 else float(rng.integers(100))) for i in rng.permutation(300)]
    df = spark.createDataFrame(rows, "g string, n long, v double")
    groups = {g: sorted((r for r in rows if r[0] == g), key=lambda r: r[1]) for g in {r[0] for r in rows}}
    want = {}
    for rs in groups.values():
        for i, r in enumerate(rs):
            seen = [x[2] for x in rs[: i + 1] if x[2] is not None]
            want[r[1]] = (min(seen, default=None), max(seen, default=None))
    for parts in (1, 7):
        assert {r.n: (r.lowest, r.highest) for r in metrics.running_extrema(df, "g", "n", "v", parts).collect()} == want
        sums = {(r.g, r.step): r.total for r in metrics.accumulated(df, "g", "n", "v", 4, parts).collect()}
        assert sums == {(g, i // 4): sum(x[2] or 0 for x in rs[i : i + 4]) for g, rs in groups.items() for i in range(0, len(rs) - 3, 4)}
    assert metrics.running_extrema(df.limit(0), "g", "n", "v").count() == metrics.accumulated(df.limit(0), "g", "n", "v", 4).count() == 0


def test_watershed():
    value = np.zeros((5, 9))
    value[:, 4] = 5
    markers = np.zeros((5, 9), int)
    markers[2, 1], markers[2, 7] = 1, 2
    basin = regions.flood(value, markers)
    assert set(np.unique(basin[:, :4])) == {1} and set(np.unique(basin[:, 5:])) == {2} and -1 in basin[:, 4]


def test_rectangle_and_simplify():
    assert np.allclose(regions.least_rectangle([(0, 0), (4, 0), (4, 2), (0, 2), (2, 1)]), (2, 1, 2, 4))
    assert np.allclose(regions.least_rectangle([(0, 0), (2, 2), (3, 1), (1, -1)]), (1.5, 0.5, math.sqrt(2), 2 * math.sqrt(2)))
    assert regions.simplified([(0, 0), (5, 1), (10, 0), (10, 10), (0, 10)], 3) == [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_stencil_mirrors(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 255, (5, 6))
    px = spark.createDataFrame([(1, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(a)], "img int, yy long, xx long, v long")
    wide = np.pad(a, 1, mode="reflect")
    want = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * a
    found = {(r.yy, r.xx): r.lap for r in stencils.laplacian(px, "v").collect()}
    assert all(found[y, x] == want[y, x] for y, x in np.ndindex(a.shape))


def test_json_difference(spark):
    frame = lambda t: spark.createDataFrame([(1, t)], "id int, text string")
    diff = lambda a, b: {(r.path, r.change, r.old_value, r.new_value) for r in jsondiff.difference(frame(a), frame(b), "id", "text").collect()}
    assert diff('{"x":1,"y":[1,2]}', '{"x":2,"y":[1,2],"z":3}') == {("/x", "changed", "1", "2"), ("/z", "added", None, "3")}
    assert diff("[1,2]", "[1]") == {("", "length", "2", "1")}
    assert diff('{"a":1}', '{"a":1}') == set()
    assert diff('{"a":{"b":[{"c":"x]{"},[]]}}', '{"a":{"b":[{"c":"y"},[]]},"d":{}}') == {("/a/b/#0/c", "changed", "x]{", "y"), ("/d", "added", None, "{}")}
    assert diff('{"a":[1,[2,3]],"b":null,"c":"q\\"[["}', '{"a":[1,[2]],"b":false,"c":"q\\"[["}') == {("/a/#1", "length", "2", "1"), ("/b", "changed", "null", "false")}
    deep = "[" * 30 + "1" + "]" * 30
    assert diff(deep, deep.replace("1", "2")) == {("/#0" * 30, "changed", "1", "2")} and diff("5", '"5"') == set()


def test_tiff(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {"a.tif": rng.integers(0, 255, (7, 5, 3), dtype=np.uint8), "b.tif": rng.integers(0, 255, (4, 6, 1), dtype=np.uint8)}
    for name, image in images.items():
        (tmp_path / name).write_bytes(tiff.encoded(image, 0.5, (100.0, 200.0)))
        assert np.array_equal(tiff.array((tmp_path / name).read_bytes()), image)
    found = tiff.descriptions(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.height, r.width, r.bands, r.origin_x, r.origin_y, r.mppx) for r in found] == [(7, 5, 3, 100.0, 200.0, 0.5), (4, 6, 1, 100.0, 200.0, 0.5)]
    cells = tiff.pixels(spark, str(tmp_path), ((1, 2), (3, 4))).where("path like '%a.tif'").collect()
    assert {(r.yy, r.xx): r.bands for r in cells} == {(y, x): images["a.tif"][y, x].tolist() for y in range(2, 6) for x in range(1, 4)}


def test_listing(spark, tmp_path):
    for name in ("c1/p1/a.png", "c1/p1/b.PNG", "c2/p9/c.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    found = files.listing(spark, str(tmp_path))
    assert sorted((r.group, r.folder, r.name) for r in found.collect()) == [("c1", "p1", "a.png"), ("c2", "p9", "c.png")]
    assert files.first_file(found).first().path.endswith("c1/p1/a.png")


def test_map_files(spark):
    lines = spark.createDataFrame([('{"ODMCenter": [1.5, 2.5], "PROJ4": "+proj=utm"}',)], "value string")
    assert tuple(files.map_data(lines).first()) == (1.5, 2.5, "+proj=utm")
    lines = spark.createDataFrame([('{"contours": [{"pts_m": [[1.0, 2.0], [3.0, 4.0]]}]}',)], "value string")
    assert [(p.x, p.y) for p in files.legacy_outlines(lines).first().points] == [(1.0, 2.0), (3.0, 4.0)]


def test_shapefile(spark, tmp_path):
    import struct

    from rasterloom.sources import shapefile

    def record(n, body):
        return struct.pack(">2i", n, len(body) // 2) + body

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    hole = [(1.0, 0.5), (2.0, 0.5), (2.0, 1.0), (1.0, 0.5)]
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 4, 3, 2, 8, 0, 4) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record(1, polygon) + record(2, struct.pack("<i", 0)))
    field = b"class".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, 2, 65, 6) + field + b"\r" + b" rock  none ")
    found = shapefile.features(spark, str(tmp_path)).collect()
    assert [(r.seq, r.attributes, [(p.x, p.y) for p in r.points]) for r in found] == [(0, {"class": "rock"}, ring)]


def test_augmentation_repeats(spark):
    from rasterloom.operators import inference

    px = spark.range(3 * 16).select((F.col("id") % 3).cast("int").alias("img"), F.floor(F.col("id") / 12).alias("yy"), (F.floor(F.col("id") / 3) % 4).alias("xx"), F.col("id").alias("v"))
    a = inference.turned(px, 4, 1, 0).orderBy("v").collect()
    assert a == inference.turned(px.repartition(5), 4, 1, 0).orderBy("v").collect()
    assert len({(r.img, r.yy, r.xx) for r in a}) == 48


def test_manifest(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "name string, n int")
    assert [r.value for r in files.manifest(rows, ["name", "n"]).collect()] == ["a,1", "b"]


def test_events_by_window(spark, tmp_path):
    from rasterloom.streaming import extrema

    spark.sql("select timestamp '2024-01-01 00:00:10' as ts, 'a' as m, 3d as v union all select timestamp '2024-01-01 00:03:00', 'a', 1d union all select timestamp '2024-01-01 00:30:00', 'b', 9d").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, m string, v double").parquet(f"{tmp_path}/in")
    found = extrema.run_once(extrema.by_window(stream, "ts", "1 minute", "5 minutes", "m", "v"), f"{tmp_path}/windows", "append")
    assert [(r.m, r.lowest, r.highest, r.n) for r in found.collect()] == [("a", 1.0, 3.0, 2)]


def test_wide_stencil(spark):
    """Stencils of reach 1 and 2 against sums over a mirrored array."""
    import numpy as np

    from rasterloom.operators import stencils as N

    rng = np.random.default_rng(5)
    images = {k: rng.integers(0, 50, size) for k, size in enumerate(((6, 5), (3, 3), (4, 7)))}
    df = spark.createDataFrame([(k, y, x, int(v)) for k, a in images.items() for (y, x), v in np.ndenumerate(a)], "img int, yy long, xx long, v long")
    for reach in (1, 2):
        weights = {(y, x): float(rng.integers(-4, 5)) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1)}
        found = {(r.img, r.yy, r.xx): (r.a, r.b) for r in N.stencils(df, {"a": ("v", weights), "b": ("v", N.SCHARR_X)}).collect()}
        for k, a in images.items():
            wide = np.pad(a, 2, mode="reflect")
            for (y, x), _ in np.ndenumerate(a):
                sums = [sum(w * wide[y + 2 + dy, x + 2 + dx] for (dy, dx), w in ws.items()) for ws in (weights, N.SCHARR_X)]
                assert np.allclose(found[k, y, x], sums)


def test_depth_of_json(spark):
    import json

    def hand(x):
        return 1 + max((hand(y) for y in (x.values() if isinstance(x, dict) else x)), default=0) if isinstance(x, (dict, list)) else 0

    docs = [{"a": 'q"[[{', "b\\": ["\\", {"c\"]": []}]}, [], 5, "x[", {"k\\\"": {"[": "]"}}, [[[["\\\\\"["]]]], {"a": {}, "b": [[]]}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    found = spark.createDataFrame(rows, "id int, t string").select("id", jsondiff.depth(F.col("t")).alias("d")).collect()
    assert {r.id: r.d for r in found} == {i: hand(d) for i, d in enumerate(docs)}
    assert jsondiff.flattened(spark.createDataFrame(rows, "id int, t string"), "id", "t").where("kind = 'open'").count() == 0


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "decimal(20,2)", "double", "long"])
def test_histories_by_any_order(spark, kind):
    """Parts of a history by strings, days, times and numbers: each row's extrema so far, and full sums in turn."""
    rng = np.random.default_rng(7)
    rows = [(i % 3 if i % 2 else 0, i, int(rng.integers(0, 1000))) for i in rng.permutation(400).tolist()]
    n = F.col("n")
    made = {"string": F.lpad(n.cast("string"), 5, "0"), "date": F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")), "timestamp": F.timestamp_seconds(n * 1000), "timestamp_ntz": F.timestamp_seconds(n * 1000).cast("timestamp_ntz")}
    df = spark.createDataFrame(rows, "g long, n long, v long").withColumn("o", made.get(kind, n.cast(kind))).repartition(4)
    want, seen = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        low, high = seen.get(g, (v, v))
        seen[g] = want[i] = (min(low, v), max(high, v))
    found = metrics.running_extrema(df, "g", "o", "v", 9)
    assert {r.n: (r.lowest, r.highest) for r in found.collect()} == want
    assert metrics._in_parts(df, "o", 9).select("_part").distinct().count() == 9
    sums = {(r.g, r.step): r.total for r in metrics.accumulated(df, "g", "o", "v", 10, 9).collect()}
    for g in range(3):
        own = [v for h, _, v in sorted(rows, key=lambda r: r[1]) if h == g]
        assert all(sums[g, s] == sum(own[s * 10 : s * 10 + 10]) for s in range(len(own) // 10))
