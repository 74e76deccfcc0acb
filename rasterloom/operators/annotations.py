"""Polygon annotations: reading, classing, rasterising and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An annotation file: items by name, each with regions of points or boxes and with free attributes.
VIA = (
    "map<string, struct<filename:string, size:bigint, regions:array<struct<shape_attributes:struct<name:string, all_points_x:array<int>, all_points_y:array<int>, x:int, y:int, width:int, height:int>, "
    "region_attributes:map<string,string>>>, file_attributes:map<string,string>>>"
)


def items(files: DataFrame, text: str = "value") -> DataFrame:
    """filename (without trailing white space), seq and the fields of every region of whole annotation files."""
    found = files.select(F.explode(F.map_values(F.from_json(F.col(text), VIA))).alias("item"))
    rows = found.select(F.rtrim("item.filename").alias("filename"), F.posexplode_outer("item.regions").alias("seq", "region"))
    return rows.select("filename", "seq", F.col("region.shape_attributes").alias("shape"), F.col("region.region_attributes").alias("attributes"))


def region_class(attributes: Column, classes: list[str]) -> Column:
    """The number of a region's class: 0 if it names none, -1 if it names an unknown one."""
    name = F.element_at(attributes, "class")
    return F.when(name.isNull(), 0).otherwise(F.array_position(F.array(*map(F.lit, classes)), name).cast("int") - 1)


def region_points(shape: Column) -> Column:
    """The points of a polygon, or the four corners of a box; null where neither is whole."""
    polygon = F.transform(F.arrays_zip(shape["all_points_x"], shape["all_points_y"]), lambda p: F.struct(p["all_points_x"].alias("x"), p["all_points_y"].alias("y")))
    x, y, w, h = (shape[n] for n in ("x", "y", "width", "height"))
    corners = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))))
    boxed = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    return F.when(shape["all_points_x"].isNotNull() & shape["all_points_y"].isNotNull(), polygon).when(boxed, corners)


def has_keys(wanted: Column, keys: Column) -> Column:
    """Whether keys hold all that is wanted."""
    return F.size(F.array_except(wanted, keys)) == 0


def contours(files: DataFrame, classes: list[str], text: str = "value") -> DataFrame:
    """filename, seq, cls, points of the regions of known classes."""
    rows = items(files, text).select("filename", "seq", region_class(F.col("attributes"), classes).alias("cls"), region_points(F.col("shape")).alias("points"))
    return rows.where((F.col("cls") >= 0) & F.col("points").isNotNull())


def _crosses(x: Column, y: Column, ax, ay, bx, by) -> tuple[Column, Column]:
    """Whether a ray from (x, y) crosses an edge, and whether the point is on it; whole numbers only."""
    side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    up, down = (ay <= y) & (by > y), (by <= y) & (ay > y)
    on = (side == 0) & (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))
    return (up & (side > 0)) | (down & (side < 0)), on


def inside(x: Column, y: Column, polygon: list[tuple[int, int]]) -> Column:
    """Whether a pixel is in a polygon by the even-odd rule; pixels on its border are."""
    odd, border = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        hit, on = _crosses(x, y, F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by))
        odd, border = odd != hit, border | on
    return odd | border


def _ceil_div(a: Column, b: Column) -> Column:
    """a / b upwards, in whole numbers; b > 0."""
    return -((-a - F.pmod(-a, b)) / b).cast("long")


def runs(shapes: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """keys, seq, cls, yy, x0 and x1: polygons as runs of pixels along lines, as rasterise fills them; runs of one polygon may meet.

    Every edge gives each line that it passes where it crosses it. Sorted, these are the ends of the runs inside; what lies right on the
    border makes runs of its own. So a polygon costs the heights of its edges and no test of pixels. All in whole numbers.
    """
    n = F.size("points")
    following = F.concat(F.slice("points", 2, F.greatest(n, F.lit(1))), F.slice("points", 1, 1))
    edges = F.zip_with("points", following, lambda a, b: F.struct(*(p[c].cast("long").alias(f"{p_}{c}") for p, p_ in ((a, "a"), (b, "b")) for c in "xy")))
    rows = shapes.where(n > 0).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select(*keys, "seq", "cls", "_id", F.explode(edges).alias("_e"))
    down = F.col("_e.ay") <= F.col("_e.by")
    pick = lambda c, low: F.when(down, F.col(f"_e.{'a' if low else 'b'}{c}")).otherwise(F.col(f"_e.{'b' if low else 'a'}{c}"))
    rows = rows.select(*keys, "seq", "cls", "_id", pick("x", True).alias("ax"), pick("y", True).alias("ay"), pick("x", False).alias("bx"), pick("y", False).alias("by"))
    rows = rows.where((F.col("by") >= 0) & (F.col("ay") < height))
    first, last = F.greatest(F.lit(0).cast("long"), "ay"), F.least(F.lit(height - 1).cast("long"), "by")
    rows = rows.withColumn("yy", F.explode(F.sequence(first, last)))
    over, high = (F.col("bx") - F.col("ax")) * (F.col("yy") - F.col("ay")), F.col("by") - F.col("ay")
    flat = high == 0
    at = F.when(~flat, F.col("ax") + _ceil_div(over, F.when(flat, F.lit(1)).otherwise(high)))
    on = F.when(flat, F.struct(F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"))).when(F.pmod(over, F.when(flat, F.lit(1)).otherwise(high)) == 0, F.struct(at.alias("x0"), at.alias("x1")))
    lines = rows.select(*keys, "seq", "cls", "_id", "yy", F.when(~flat & (F.col("yy") < F.col("by")), at).alias("_at"), on.alias("_on"))
    given = [F.first(c).alias(c) for c in [*keys, "seq", "cls"]]
    ends = lines.groupBy("_id", "yy").agg(*given, F.array_sort(F.collect_list("_at")).alias("_c"), F.collect_set("_on").alias("_b"))
    inside = F.transform(F.filter(F.transform("_c", lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["i"] % 2 == 0), lambda x: F.struct(x["c"].alias("x0"), (F.element_at("_c", (x["i"] + 2).cast("int")) - 1).alias("x1")))
    found = ends.select(*keys, "seq", "cls", "yy", F.explode(F.concat(inside, "_b")).alias("_r")).select(*keys, "seq", "cls", "yy", F.greatest(F.lit(0).cast("long"), "_r.x0").alias("x0"), F.least(F.lit(width - 1).cast("long"), "_r.x1").alias("x1"))
    return found.where(F.col("x0") <= F.col("x1"))


def rasterise(shapes: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """keys, yy, xx and cls: the pixels of polygons (columns keys, seq, cls, points), the last one where several meet.

    Pixels are inside by the even-odd rule, and on the border. They come from runs along lines, and combine by pixel before the shuffle.
    """
    hit = runs(shapes, height, width, keys).withColumn("xx", F.explode(F.sequence("x0", "x1")))
    return hit.groupBy(*keys, "yy", "xx").agg(F.max_by("cls", "seq").alias("cls"))


def order_of_classes(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers seq anew: classes in the order in which they first appear, polygons of a class in their own order."""
    first = F.min("seq").over(Window.partitionBy(*keys, "cls"))
    return shapes.withColumn("_f", first).withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("_f", "seq"))).drop("_f")


def thick_enough(shapes: DataFrame, least: int = 3) -> DataFrame:
    """Contours of at least three points."""
    return shapes.where(F.size("points") >= least)


def inner_first(shapes: DataFrame) -> DataFrame:
    """shapes: img, id, parent. Those that have a parent, with has_child and their turn: leaves before the rest."""
    parents = shapes.select("img", F.col("parent").alias("id")).where("parent is not null").distinct().withColumn("has_child", F.lit(True))
    rows = shapes.where("parent is not null").join(parents, ["img", "id"], "left").withColumn("has_child", F.coalesce("has_child", F.lit(False)))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("img").orderBy("has_child", "id")))


def gathered(shapes: DataFrame) -> DataFrame:
    """cls and how many contours and points a class has over all boxes."""
    return shapes.groupBy("cls").agg(F.count("*").alias("contours"), F.sum(F.size("points")).alias("points"))


def via_json(shapes: DataFrame, classes: list[str]) -> DataFrame:
    """filename and the annotation file item of its contours as JSON, in their order."""
    names = F.array(*map(F.lit, classes))
    one = F.struct(
        F.struct(F.lit("polygon").alias("name"), F.transform("points", lambda p: p["x"]).alias("all_points_x"), F.transform("points", lambda p: p["y"]).alias("all_points_y")).alias("shape_attributes"),
        F.struct(F.element_at(names, F.col("cls") + 1).alias("class")).alias("region_attributes"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("r")))), lambda x: x["r"])
    return shapes.groupBy("filename").agg(ordered.alias("regions")).select("filename", F.to_json(F.struct("filename", F.lit(-1).alias("size"), "regions")).alias("json"))
