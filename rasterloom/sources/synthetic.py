"""Rasters and coordinates that follow from the driver's tables by formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT, WIDTH = 48, 64
#: Images in a task, which are some 800,000 pixels.
DEALT = 256


def grid(images: DataFrame, height: int, width: int) -> DataFrame:
    """A row for each pixel of every image: the columns of images, yy and xx.

    Products with two short ranges, since Spark counts their rows when it plans; exploded arrays count as one row an image, and joins would then
    broadcast all pixels.
    """
    to = lambda n, at: F.broadcast(images.sparkSession.range(n).select(F.col("id").alias(at)))
    return images.crossJoin(to(height, "yy")).crossJoin(to(width, "xx"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img: a row for each raster.

    Rows are few and short, so a file of them is one partition, but pixels are made from them: they are dealt by image over as many tasks as
    their number asks for. Grouping, windows and joins by image and more then find an image's pixels together and shuffle none.
    """
    found = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("img"))
    return found.repartition(max(spark.sparkContext.defaultParallelism, -(-found.count() // DEALT)), "img")


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, yy, xx, v: a raster of HEIGHT by HEIGHT for each supplier."""
    return grid(images(spark, sf_dir), HEIGHT, HEIGHT).withColumn("v", (F.col("xx") * 7 + F.col("yy") * 13 + F.col("img") * 31) % 256)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, yy, xx, v: an 8-bit raster for each supplier, so that pixels grow with the tables."""
    return grid(images(spark, sf_dir), HEIGHT, WIDTH).withColumn("v", (F.col("xx") * 7 + F.col("yy") * 13 + F.col("img") * 31) % 256)


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, yy, xx, mv: class k is stored as 255 - k, background as 0."""
    return pixels(spark, sf_dir).select("img", "yy", "xx", F.when(F.col("v") < 64, 255).when(F.col("v") < 96, 254).otherwise(0).alias("mv"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, lon, lat."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, ((k * 37) % 360 - 180 + F.lit(0.5)).alias("lon"), ((k * 17) % 160 - 80 + F.lit(0.25)).alias("lat"))


#: The same relations for the oracle.
PX = "px AS (SELECT s_suppkey::INTEGER AS img, y.range AS yy, x.range AS xx, (x.range * 7 + y.range * 13 + s_suppkey * 31) % 256 AS v FROM supplier, range(48) y, range(64) x)"
SQUARE = PX.replace("range(64)", "range(48)")
MASK = PX + ", mask AS (SELECT img, yy, xx, CASE WHEN v < 64 THEN 255 WHEN v < 96 THEN 254 ELSE 0 END AS mv FROM px)"
PTS = "pts AS (SELECT c_custkey, (c_custkey * 37) % 360 - 180 + 0.5::DOUBLE AS lon, (c_custkey * 17) % 160 - 80 + 0.25::DOUBLE AS lat FROM customer)"
