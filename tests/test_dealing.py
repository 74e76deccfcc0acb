"""How pixels are dealt over tasks, and that plans of them broadcast and shuffle nothing that grows with the tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom import catalog
from rasterloom.operators.staging import by_groups, written
from rasterloom.sources import synthetic


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with 3,000 suppliers in one file."""
    folder = str(tmp_path_factory.mktemp("many"))
    spark.range(3000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return folder


def test_images_are_dealt(spark, many):
    dealt = synthetic.images(spark, many).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 3000 // synthetic.DEALT and sum(n for _, n in dealt) == 3000 and max(n for _, n in dealt) < 2 * synthetic.DEALT
    assert synthetic.pixels(spark, many).where("img in (0, 2999)").count() == 2 * synthetic.HEIGHT * synthetic.WIDTH


@pytest.mark.parametrize("name", "brightness minmax_stretch percentile_stretch standardise rock_bands region_norm height_fallback prepared_samples rock_cores augment_rotate mask_to_distance".split())
def test_no_pixels_are_broadcast(spark, many, name):
    assert "BroadcastHashJoin" not in plan_of(catalog.QUERIES[name](spark, many))


@pytest.mark.parametrize("name", "brightness minmax_stretch percentile_stretch standardise rock_bands resample_cubic resample_lanczos resample_area resample_bilinear overlap_model shrink_average".split())
def test_no_pixels_are_shuffled(spark, many, name):
    lines = [line for line in plan_of(catalog.QUERIES[name](spark, many)).split("\n") if "Exchange hashpartitioning" in line]
    assert lines and all("REPARTITION_BY_NUM" in line for line in lines)


def test_tables_between_rounds_are_not_broadcast(spark):
    """Files of a table that repeats itself are a small part of its rows."""
    table = written(spark.range(1000).select("id", F.lit(7).alias("v")))
    assert "BroadcastHashJoin" not in plan_of(table.where("v = 7").join(table.groupBy("id").count(), "id"))


def test_groups_are_whole(spark):
    """Python gets many groups at once, and each one whole."""

    def counted(table):
        starts = np.flatnonzero(table.column("_n").to_numpy() == 1)
        sizes = np.diff(np.append(starts, table.num_rows))
        yield pa.table({"g": table.column("g").take(pa.array(starts)), "n": sizes, "together": np.full(len(sizes), len(sizes))})

    rows = spark.range(40_000).select((F.col("id") % 301).alias("g"), F.col("id").alias("v")).repartition(7)
    found = by_groups(rows, ["g"], ["v"], counted, "g long, n long, together long", least=1000).collect()
    assert sorted((r.g, r.n) for r in found) == [(g, 40_000 // 301 + (g < 40_000 % 301)) for g in range(301)]
    assert max(r.together for r in found) > 3


@pytest.mark.parametrize("name", ["augment_rotate", "mask_to_distance"])
def test_rows_by_image_stay(spark, many, name):
    lines = [line for line in plan_of(catalog.QUERIES[name](spark, many)).split("\n") if "Exchange hashpartitioning" in line]
    assert lines and all("REPARTITION_BY_NUM" in line for line in lines)
