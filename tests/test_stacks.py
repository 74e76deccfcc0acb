"""Whole images many at a time: against one image at a time, and that nothing of the rock queries is shuffled to meet."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom import catalog
from rasterloom.operators import regions, stacks, tiled
from test_dealing import many, plan_of  # noqa: F401


def frame(images):
    """The rows of images as by_images hands them on, from arrays of v and k."""
    columns = {c: [] for c in ("img", "yy", "xx", "v", "k", "_n")}
    for i, (v, k) in enumerate(images):
        y, x = np.indices(v.shape)
        for c, a in zip(columns, (np.full(v.size, i), y, x, v, k, np.arange(v.size) + 1), strict=True):
            columns[c].append(a.ravel())
    return pa.table({c: np.concatenate(a) for c, a in columns.items()})


@pytest.mark.parametrize("values", [4, 300, 100_000, None])
def test_floods(values):
    """Images of any sizes side by side, among them such of one line, and few of a size (flooded one by one)."""
    rng = np.random.default_rng(values or 1)
    sizes = [(9, 11)] * 60 + [tuple(rng.integers(1, 14, 2)) for _ in range(120)] + [(40, 50)] * 3
    made = [(rng.random(s) if values is None else rng.integers(0, values, s), np.where(rng.random(s) < 0.1, rng.integers(1, 5, s), 0)) for s in sizes]
    stack = stacks.Stack(frame(made))
    v, k = (stack.array(stack.table.column(c).to_numpy()) for c in "vk")
    alike = lambda found, f: np.array_equal(found, np.concatenate([f(*m).ravel() for m in made]))
    assert alike(stack.flooded(v, k), regions.flood) and alike(stack.labels(k > 0), lambda _, k: regions.label_array(k > 0))
    wanted = rng.random(len(v)) < 0.2
    assert np.array_equal(stack.flooded(v, k, wanted=wanted)[wanted], stack.flooded(v, k)[wanted])
    assert values is None or alike(stack.flooded(v, k, difference=True), regions.flood_by_difference)


@pytest.mark.parametrize("name", "rock_two_scales rock_instances rock_scales rock_production rock_scales_tiled rock_production_tiled mask_to_distance_tiled".split())
def test_no_pixels_are_shuffled(spark, many, name):  # noqa: F811
    lines = [line for line in plan_of(catalog.QUERIES[name](spark, many)).split("\n") if "Exchange hashpartitioning" in line]
    assert lines and all("REPARTITION_BY_NUM" in line for line in lines)


def test_instances_of_scales(spark):
    """Both scales in one pass give what the rocks of each give when they are merged; null is no rock."""
    rng = np.random.default_rng(8)
    at = [(i, y, x) for i in range(40) for y in range(13) for x in range(11 if i % 2 else 9)]
    number = lambda: None if rng.random() < 0.02 else float(np.round(rng.random(), 1))
    px = spark.createDataFrame([(*a, number(), number()) for a in at], "img int, yy long, xx long, f double, c double").cache()
    one = regions.instances_of_scales(px, "f", "c", 3, 0.5, 5, 0.4).collect()
    two = regions.merged_scales(regions.rock_instances(px.select("img", "yy", "xx", F.col("f").alias("p")), "p", 3, 0.5), regions.rock_instances(px.select("img", "yy", "xx", F.col("c").alias("p")), "p", 5, 0.4)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and min(r.rock for r in one) < 0 < max(r.rock for r in one) and len(one) == len(at)


def test_masks_and_cores_of_stencils(spark):
    """The same as by windows, on images of one line and of one column too."""
    from rasterloom.operators import stencils
    from rasterloom.operators.pixels import otsu

    rng = np.random.default_rng(9)
    sizes = [(12, 9), (1, 7), (8, 1), (1, 1), (2, 2), (15, 6)]
    made = [(np.where(rng.random(s) < 0.5, rng.integers(0, 256, s), 200), np.zeros(s, int)) for s in sizes]
    px = spark.createDataFrame(frame(made).select(["img", "yy", "xx", "v"]).to_pandas()).withColumn("img", F.col("img").cast("int")).cache()
    stack = stacks.Stack(frame(made))
    v = stack.array(stack.table.column("v").to_numpy())
    cut = {r.img: r.threshold for r in otsu(px, "v").collect()}
    core = stacks.cores(stack, v, np.array([cut.get(i, 0) for i in range(len(sizes))]))
    little, big = stacks.masks(stack, v)
    at = {(int(i), int(y), int(x)): n for n, (i, y, x) in enumerate(zip(stack.of, stack.y, stack.x, strict=True))}
    found = stencils.rock_cores(px, "v").collect()
    assert len(found) == len(at) and all(r.core == core[at[r.img, r.yy, r.xx]] for r in found) and core.any()
    assert all((r.little, r.big) == (little[n], big[n]) for r in stencils.rock_masks(px, "v").collect() for n in [at[r.img, r.yy, r.xx]])


@pytest.fixture(scope="module")
def odd(spark):
    """Images of several sizes, with probabilities at two scales and a mask."""
    rng = np.random.default_rng(12)
    rows = []
    for i, (h, w) in enumerate([(11, 13), (24, 9), (3, 3), (1, 6), (30, 31), (7, 2)]):
        y, x = np.indices((h, w))
        p = np.clip(np.sin(y / 2.5 + i) * np.sin(x / 2.0) + rng.random((h, w)) * 0.2, 0, 1)
        rows += [(i, int(a), int(b), float(p[a, b]), float(np.sin(a / 4) * np.sin(b / 4) ** 2), bool(p[a, b] > 0.2)) for a, b in zip(y.ravel(), x.ravel(), strict=True)]
    return spark.createDataFrame(rows, "img int, yy long, xx long, p double, q double, m boolean").cache()


def taken(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


BY_TILE = {
    "rock_scales_tiled": lambda px: regions.two_scale_rocks(px.select("img", "yy", "xx", "p"), px.select("img", "yy", "xx", F.abs("q").alias("p")), "p", tile=4),
    "rock_production_tiled": lambda px: regions.production_rocks(px.select("img", "yy", "xx", "p"), "p", tile=4),
    "mask_to_distance_tiled": lambda px: tiled.mask_to_distance_by_tile(px, "m", 5).withColumn("share", F.round("share", 9)),
}


@pytest.mark.parametrize("name", BY_TILE)
def test_images_of_all_sizes_by_tile(spark, odd, monkeypatch, name):
    """Tiles give what whole images give, and so does a table of which some images go one way and some the other."""
    whole = taken(BY_TILE[name](odd))
    assert len(whole) == odd.count()
    for most in (0, 150):
        monkeypatch.setattr(tiled, "WHOLE", most)
        assert taken(BY_TILE[name](odd)) == whole


@pytest.mark.parametrize("by", ["level", "difference"])
@pytest.mark.parametrize(("lines", "rim"), [(False, False), (True, True)])
def test_forest(spark, by, lines, rim):
    """The forest of whole images is that of tiles, with gaps where there is no rim; unmarked ones stay 0."""
    rng = np.random.default_rng(13)
    rows = [(i, y, x, int(rng.integers(0, 6)), int(rng.integers(1, 4)) if i != 3 and rng.random() < 0.1 else 0) for i, (h, w) in enumerate([(9, 8), (1, 12), (13, 5), (6, 6)]) for y in range(h) for x in range(w) if rim or (y, x) == (h - 1, w - 1) or rng.random() < 0.9]
    px = spark.createDataFrame(rows, "img int, yy long, xx long, v long, k long").cache()
    one = stacks.by_images(px, lambda s: {"basin": tiled.forest(s, s.column("v", np.int64, 0), s.column("k", np.int64, 0), by, lines, rim)}, "img int, yy long, xx long, basin long")
    assert taken(one) == taken(tiled.watershed_by_tile(px, "v", "k", 3, by=by, lines=lines, rim=rim))


def test_few_pixels_of_a_large_image(spark):
    """Rows far apart don't make an array of all that lies between."""
    px = spark.createDataFrame([(1, 0, 0), (1, 1 << 20, 1 << 20), (2, 0, 0)], "img int, yy long, xx long")
    found = tiled.by_size(px, lambda df: df.withColumn("way", F.lit("whole")), lambda df: df.withColumn("way", F.lit("tiles"))).collect()
    assert {(r.img, r.way) for r in found} == {(1, "tiles"), (2, "whole")}
