"""Steps over pixels: sorts, window functions and draws that plans hold no more than once, and odd images."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rasterloom import catalog
from rasterloom.operators import sampling as S
from rasterloom.operators import stencils as N
from rasterloom.sources.synthetic import DEALT
from test_dealing import many, plan_of  # noqa: F401


def test_heights_are_not_shuffled(spark, many):  # noqa: F811
    plan = plan_of(catalog.QUERIES["sample_heights"](spark, many))
    assert all("REPARTITION_BY_NUM" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line) and "Join" not in re.sub("BroadcastHashJoin|BroadcastNestedLoopJoin|CartesianProduct", "", plan)


def test_heights_of_odd_images(spark):
    """Other columns stay, in their order; heights that are null are heights; pixels without a place meet nothing; copies of a pixel stay."""
    images = spark.createDataFrame([(1, 0, 0, "a", 5), (1, 0, 1, "b", 6), (1, 0, 1, "c", 7), (2, 0, 0, "d", 8), (None, 0, 0, "e", 9)], "img int, yy long, xx long, name string, v long")
    heights = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, 2.5), (3, 0, 0, 1.0), (None, 0, 0, 1.0)], "img int, yy long, xx long, v double")
    found = S.with_height(images, heights, (1, 2), (1, 2))
    assert found.columns == ["img", "yy", "xx", "name", "v", "height"]
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, "a", 5, None), (1, 0, 1, "b", 6, 2.5), (1, 0, 1, "c", 7, 2.5)]


@pytest.mark.parametrize("name", "multi_scale overlap_inside band_project augment_crop rock_masks rock_cores".split())
def test_no_pixels_are_shuffled(spark, many, name):  # noqa: F811
    lines = [line for line in plan_of(catalog.QUERIES[name](spark, many)).split("\n") if "Exchange hashpartitioning" in line]
    assert lines and all("REPARTITION_BY_NUM" in line for line in lines)


@pytest.mark.parametrize("name", "resample_bilinear multi_scale overlap_model resample_area overlap_inside band_project".split())
def test_tasks_grow_with_images(spark, many, tmp_path, name):  # noqa: F811
    """A task has the pixels of some DEALT images, however many there are, from the first step to the last."""
    spark.range(6000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    tasks = [catalog.QUERIES[name](spark, folder).rdd.getNumPartitions() for folder in (many, str(tmp_path))]
    assert tasks == [-(-n // DEALT) for n in (3000, 6000)]


@pytest.mark.parametrize(("name", "most"), [("rock_masks", 4), ("rock_mask", 3), ("opening", 3), ("nms", 2), ("zero_cross", 3), ("rock_cores", 6)])
def test_sorts(spark, many, name, most):  # noqa: F811
    """A step begins with the line that the one before ended with; rock_cores has a sort for its histogram beside."""
    assert plan_of(catalog.QUERIES[name](spark, many)).count("Sort [") <= most


@pytest.mark.parametrize("name", ["rock_masks", "rock_cores", "scharr", "nms"])
def test_window_functions_are_taken_once(spark, many, name):  # noqa: F811
    lines = [line for line in plan_of(catalog.QUERIES[name](spark, many)).split("\n") if re.match(r"[\s:+-]*Window \[", line)]
    taken = [re.findall(r"(?:lag|lead)\([^)]*\)", line) for line in lines]
    assert any(taken) and all(len(x) == len(set(x)) for x in taken)


@pytest.mark.parametrize(("name", "most"), [("augment_crop", 2), ("augment_turn", 1)])
def test_draws_are_made_once(spark, many, name, most):  # noqa: F811
    assert plan_of(catalog.QUERIES[name](spark, many)).count("md5(") <= most


@pytest.mark.parametrize("k", [1, 3, 5, 7])
def test_extremes_of_images_with_gaps(spark, k):
    rng = random.Random(k)
    cells = {(i, y, x): rng.choice([None, *range(50)]) for i in range(2) for y in range(9) for x in range(8) if rng.random() < 0.6}
    px = spark.createDataFrame([(*at, v) for at, v in cells.items()], "img int, yy long, xx long, v int")
    for lines in (N.ROWS, N.COLUMNS):
        # a row's extreme is known only where the row has a pixel, so both passes go over pixels that are there
        def one(values, line, by, f):
            near = lambda a: [v for b, v in values.items() if v is not None and b[0] == a[0] and b[line] == a[line] and abs(b[by] - a[by]) <= k // 2]  # noqa: E731, B023
            return {a: f(near(a), default=None) for a in values}

        line, by = (1, 2) if lines == N.ROWS else (2, 1)
        high, low = (one(one(cells, line, by, f), by, line, f) for f in (max, min))
        found = N.extremes(px, {"h": ("v", True), "l": ("v", False)}, k, lines).collect()
        assert {(r.img, r.yy, r.xx): (r.h, r.l) for r in found} == {a: (high[a], low[a]) for a in cells}


def test_stencils_begin_with_either_line(spark):
    rng = random.Random(3)
    px = spark.createDataFrame([(i, y, x, rng.random()) for i, h, w in ((0, 7, 5), (1, 1, 4), (2, 3, 1)) for y in range(h) for x in range(w)], "img int, yy long, xx long, v double")
    outputs = {"b": ("v", N.BOX), "x": ("v", N.SCHARR_X), "y": ("v", N.SCHARR_Y), "same": ("v", N.SELF)}
    rows, columns = ({(r.img, r.yy, r.xx): (r.b, r.x, r.y, r.same) for r in N.stencils(px, outputs, lines).collect()} for lines in (N.ROWS, N.COLUMNS))
    assert rows == columns and len(rows) == px.count()
    assert N.stencils(px.withColumn("w", F.col("v") * 2), {"same": ("w", N.SELF)}).agg(F.sum("same")).first()[0] == pytest.approx(2 * px.agg(F.sum("v")).first()[0])
