"""Which samples there are, and which of them are taken: joins of layers, splits, rankings, batches.

Choices that look random follow a hash of a seed and the key, so they repeat and don't depend on partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_every_layer(layers: list[DataFrame], key: str) -> DataFrame:
    """Keys of the first layer that every other layer has too."""
    first, *others = layers
    return reduce(lambda df, other: df.join(other.select(key).distinct(), key, "left_semi"), others, first.select(key))


def in_all_of(catalog: DataFrame, key: str, layer: str, count: int) -> DataFrame:
    """The same from one table of (key, layer): a single aggregation in place of count - 1 joins."""
    return catalog.groupBy(key).agg(F.count_distinct(layer).alias("_n")).where(F.col("_n") == count).select(key)


def complete_samples(images: DataFrame, heights: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """Samples with all layers."""
    return images.join(heights, key).join(masks, key)


def with_optional(images: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All images, with what the other layer has of them."""
    return images.join(other, key, "left")


def allowed(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on the list."""
    return rows.join(names.select(key).distinct(), key, "left_semi")


def existing_pairs(left: DataFrame, right: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of customers and projects that the catalog has (J4): the catalog names the pairs, so none are made up first."""
    return catalog.select(*keys).distinct().join(left, keys[0], "left_semi").join(right, keys[1], "left_semi")


def not_done(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(key), key, "left_anti")


def order_of(seed: int, *keys: str) -> Column:
    """A repeatable random order: the MD5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def _numbered(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds _n, the place of each row in the order of order_of, and _all, how many rows there are.

    Places are summed up in two steps: rows are counted within the 4096 parts of the hash range, and numbered within
    their part, so no single task orders all rows.
    """
    hashed = rows.withColumn("_h", order_of(seed, key)).withColumn("_part", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_part").agg(F.count("*").alias("_c"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select("_part", (F.sum("_c").over(running) - F.col("_c")).alias("_base"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
    return hashed.withColumn("_own", own).join(F.broadcast(counts), "_part").withColumn("_n", F.col("_base") + F.col("_own")).drop("_part", "_own", "_base", "_h")  # 4096 rows


def split(rows: DataFrame, key: str, test_share: float, seed: int) -> DataFrame:
    """Adds part: ceil(test_share * n) rows are 'test', the others 'train' (O2)."""
    return _numbered(rows, key, seed).withColumn("part", F.when(F.col("_n") <= F.ceil(F.lit(test_share) * F.col("_all")), "test").otherwise("train")).drop("_n", "_all")


def thin_out(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """The first floor(n * ratio) rows of the shuffled table; all of them unless 0 < ratio < 1 (O3)."""
    if not 0 < ratio < 1:
        return rows
    return _numbered(rows, key, seed).where(F.col("_n") <= F.floor(F.col("_all") * F.lit(ratio))).drop("_n", "_all")


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(order_of(seed, key), key).limit(n)


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Adds place, the row's turn in an epoch, from 0."""
    return _numbered(rows, key, seed + 1_000_003 * epoch).withColumn("place", F.col("_n") - 1).drop("_n", "_all")


def batches(rows: DataFrame, key: str, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """Adds batch, from 0; the rows of a last, partial batch are dropped."""
    numbered = _numbered(rows, key, seed + 1_000_003 * epoch)
    return numbered.where(F.col("_n") <= F.floor(F.col("_all") / size) * size).withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n", "_all")


def worst_first(rows: DataFrame, metric: str, key: str, n: int, higher_is_worse: bool = False) -> DataFrame:
    """The n worst rows by a metric, ties by key."""
    return rows.orderBy(F.col(metric).desc() if higher_is_worse else F.col(metric).asc(), key).limit(n)


def best_by(rows: DataFrame, group: str, order: str, metric: str, highest: bool = True) -> DataFrame:
    """Of each group the first row by order that has the best metric."""
    best = F.min(F.struct((-F.col(metric) if highest else F.col(metric)).alias("m"), F.col(order).alias("o")))
    return rows.groupBy(group).agg(best.alias("b")).select(group, F.col("b.o").alias(order), (-F.col("b.m") if highest else F.col("b.m")).alias(metric))


def nearest(value: Column, choices: list[int]) -> Column:
    """The choice nearest to value, the earlier one of two alike."""
    found = F.lit(None).cast("struct<d:double,i:int,c:int>")
    options = F.array(*(F.struct(F.abs(value - c).cast("double").alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(choices)))
    return F.when(value.isNull(), found["c"]).otherwise(F.array_min(options)["c"])


def at_scale(rows: DataFrame, group: str, scale: str, order: str, value: str, full: bool = True) -> DataFrame:
    """Of each group the first value whose scale is 1 (or isn't)."""
    chosen = rows.where(F.col(scale) == 1.0 if full else F.col(scale) != 1.0)
    return chosen.groupBy(group).agg(F.min_by(value, order).alias(value))


def with_height(images: DataFrame, heights: DataFrame, shape: tuple[int, int], height_shape: tuple[int, int], value: str = "v") -> DataFrame:
    """images and the height layer's value at each of their pixels as height (S4); a layer of another shape is brought to the images' by cubic taps.
    Images without such a layer are left out, as samples have to be complete.

    Pixels and heights meet in windows by image and place, so nothing is shuffled where both lie by image already; a join by pixel would shuffle both.
    """
    from rasterloom.operators.tiling import resampled

    layer = heights.select("img", "yy", "xx", F.col(value).cast("double").alias("height"))
    if shape != height_shape:
        layer = resampled(layer, *height_shape, *shape, "cubic", "height")
    asks = images.withColumns({"height": F.lit(None).cast("double"), "_has": F.lit(None).cast("boolean"), "_asks": F.lit(True)})
    rows = asks.unionByName(layer.withColumn("_has", F.lit(True)), allowMissingColumns=True)
    at = Window.partitionBy("img", "yy", "xx")
    rows = rows.withColumns({"height": F.max("height").over(at), "_has": F.max("_has").over(at)}).where("_asks and _has and img is not null and yy is not null and xx is not null")
    return rows.select("img", "yy", "xx", *(c for c in images.columns if c not in ("img", "yy", "xx")), "height")
