"""Operators on rasters as relations of pixels (img, yy, xx, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_of(value: Column, classes: int) -> Column:
    """The class of a stored mask value; background is the last, after at least one other (A3)."""
    return F.when(value == 0, F.lit(max(2, classes + 1) - 1)).otherwise(F.lit(255) - value)


def one_hot(value: Column, classes: int, background: bool = True) -> Column:
    """A number for each class, 1 where the mask has it; background is what no class has."""
    found = [(value == 255 - k).cast("double") for k in range(classes)]
    rest = F.lit(1.0)
    for x in found:
        rest = rest - x
    return F.array(*found, *[rest] * background)


def fraction(value: Column) -> Column:
    """An 8-bit value as a part of 1 (P5)."""
    return value / 255.0


def first_of_largest(p: Column) -> Column:
    """The class with the highest probability, the first of ties; null where there is none."""
    return F.array_position(p, F.array_max(p)) - 1


def decided(p: Column, channels: int) -> Column:
    """Several channels: which is the first of the largest. One: whether it is over a half."""
    if channels == 1:
        return F.transform(p, lambda x: x > 0.5)
    best = first_of_largest(p)
    return F.transform(p, lambda x, i: i == best)


def over(p: Column, thresholds: list[float]) -> Column:
    """1 where a channel is over its threshold, else 0."""
    return F.zip_with(p, F.array(*map(F.lit, thresholds)), lambda x, t: (x > t).cast("double"))


def within(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x, no lower than low and no higher than high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def colours(bands: Column) -> Column:
    """The first three bands in reverse order; an alpha band goes."""
    return F.reverse(F.slice(bands, 1, 3))


def on_colours(bands: Column, f) -> Column:
    """f on the first three bands, others as they are; fewer than three bands stay."""
    return F.when(F.size(bands) < 3, bands).otherwise(F.concat(f(F.slice(bands, 1, 3)), F.slice(bands, 4, 1 << 20)))


def repeated(v: Column, times: int = 3) -> Column:
    """One value as several bands."""
    return F.array(*[v] * times)


def image_quality(px: DataFrame, value: str = "v") -> DataFrame:
    """img, sd (population), filled (share that isn't 0): one aggregation with map-side sums (A1, A2)."""
    return px.groupBy("img").agg(F.stddev_pop(value).alias("sd"), (F.count_if(F.col(value) != 0) / F.count("*")).alias("filled"))


def good_images(layers: list[DataFrame], mask: DataFrame, least_data: float, least_mask: float) -> DataFrame:
    """Images of which some layer isn't constant and some layer is full enough, with a mask that covers enough."""
    every = None
    for px in layers:
        q = image_quality(px)
        every = q if every is None else every.union(q)
    kept = every.groupBy("img").agg(F.max("sd").alias("sd"), F.max("filled").alias("filled")).where((F.col("sd") > 0) & (F.col("filled") >= least_data))
    cover = mask.groupBy("img").agg((F.count_if(F.col("mv") != 0) / F.count("*")).alias("cover")).where(F.col("cover") >= least_mask)
    return kept.join(cover, "img")


def class_histogram(mask: DataFrame, classes: int) -> DataFrame:
    """cls, n over all masks (A3)."""
    return mask.groupBy(class_of(F.col("mv"), classes).alias("cls")).agg(F.count("*").alias("n"))


def class_balance(mask: DataFrame, classes: int, least_mask: float = 0.0) -> DataFrame:
    """cls, n, share in per cent and weight (least n / n; null where a class is empty) over masks that cover enough
    (P3, A3, A4, A5). A row a class is left when the window runs."""
    if least_mask > 0:
        cover = mask.groupBy("img").agg((F.count_if(F.col("mv") != 0) / F.count("*")).alias("_c")).where(F.col("_c") >= least_mask)
        mask = mask.join(cover.select("img"), "img", "left_semi")
    known = mask.sparkSession.range(classes + 1).select(F.col("id").cast("int").alias("cls"))
    counts = known.join(class_histogram(mask, classes), "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))
    everything = Window.partitionBy()
    low = F.min("n").over(everything)
    return counts.select("cls", "n", (F.col("n") / F.sum("n").over(everything) * 100).alias("share"), F.when(low > 0, low / F.col("n")).alias("weight"))


def value_counts(px: DataFrame, value: str) -> DataFrame:
    """img, value, n, and how often the value occurs in all images."""
    own = px.groupBy("img", value).agg(F.count("*").alias("n"))
    every = own.groupBy(value).agg(F.sum("n").alias("n_all"))
    return own.join(every, value).select("img", value, "n", "n_all")


def mean_field(fields: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The mean of several fields at each place (A7); a single one is returned as it is."""
    if len(fields) == 1:
        return fields[0]
    every = fields[0]
    for f in fields[1:]:
        every = every.unionByName(f)
    return every.groupBy(*keys).agg(F.avg(value).alias(value))


def region_share(px: DataFrame, label: list[str], value: str) -> DataFrame:
    """Adds share: value over the highest of its region."""
    top = px.groupBy(*label).agg(F.max(value).alias("_top"))
    return px.join(top, label).withColumn("share", F.when(F.col("_top") != 0, F.col(value) / F.col("_top"))).drop("_top")


def percentile_stretch(px: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds stretched: each image's value between its percentiles, within 0 and 1."""
    edge = px.groupBy("img").agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_e"))
    span = F.col("_e")[1] - F.col("_e")[0]
    return px.join(edge, "img").withColumn("stretched", F.when(span > 0, within((F.col(value) - F.col("_e")[0]) / span)).otherwise(F.lit(0.0))).drop("_e")


def range_stretch(px: DataFrame, value: str) -> DataFrame:
    """Adds stretched: each image's value between its lowest (0) and highest (255), as a whole number."""
    edge = px.groupBy("img").agg(F.min(value).alias("_l"), F.max(value).alias("_h"))
    span = F.col("_h") - F.col("_l")
    return px.join(edge, "img").withColumn("stretched", F.when(span > 0, F.floor((F.col(value) - F.col("_l")) * 255 / span)).otherwise(0)).drop("_l", "_h")


def standardised(px: DataFrame, value: str, sd: float = 33.0, mean: float = 136.0) -> DataFrame:
    """Adds standardised: each image's value moved to a mean and standard deviation, within 0 and 255."""
    own = px.groupBy("img").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    moved = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s") * sd + mean).otherwise(F.lit(mean))
    return px.join(own, "img").withColumn("standardised", within(moved, 0.0, 255.0)).drop("_m", "_s")


def otsu(px: DataFrame, value: str) -> DataFrame:
    """img and threshold: the value that divides the histogram with the largest variance between both sides, the lowest
    of ties (A15). Windows run over at most 256 rows an image."""
    h = px.groupBy("img", value).agg(F.count("*").alias("n"))
    up = Window.partitionBy("img").orderBy(value)
    every = Window.partitionBy("img")
    h = h.select("img", F.col(value).alias("t"), F.sum("n").over(up).alias("n0"), F.sum(F.col("n") * F.col(value)).over(up).alias("s0"), F.sum("n").over(every).alias("n1"), F.sum(F.col("n") * F.col(value)).over(every).alias("s1"))
    other = F.col("n1") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s1") - F.col("s0")) / other
    score = F.round(F.col("n0") / F.col("n1") * (other / F.col("n1")) * gap * gap, 3)
    return h.where(other > 0).groupBy("img").agg(F.max_by("t", F.struct(score.alias("s"), (-F.col("t")).alias("t"))).alias("threshold"))


def extremes(px: DataFrame, value: str) -> DataFrame:
    """img, lowest, highest, n, height, width and masked, the share that isn't 0."""
    return px.groupBy("img").agg(
        F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count("*").alias("n"), (F.max("yy") + 1).alias("height"), (F.max("xx") + 1).alias("width"), (F.count_if(F.col(value) != 0) / F.count("*")).alias("masked")
    )


def hue_shift(r: Column, g: Column, b: Column, dh: int, ds: int, dv: int) -> Column:
    """An 8-bit colour with its hue (of 180 steps) turned and saturation and value raised, each kept in range."""
    whole = lambda x: F.floor(F.round(x, 6) + 0.5)  # noqa: E731  a half is a half, whatever the last digits
    r, g, b = (x.cast("double") / 255 for x in (r, g, b))
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    c = v - low
    h = F.when(c == 0, F.lit(0.0)).when(v == r, (g - b) / c).when(v == g, (b - r) / c + 2).otherwise((r - g) / c + 4)
    h = F.pmod(whole(F.pmod(h, F.lit(6.0)) * 30) + dh, F.lit(180)) / 30.0
    s = within(whole(F.when(v == 0, F.lit(0.0)).otherwise(c / v) * 255) + ds, 0, 255) / 255.0
    v = within(whole(v * 255) + dv, 0, 255) / 255.0

    def channel(n: float) -> Column:
        k = F.pmod(h + n, F.lit(6.0))
        x = v - v * s * within(F.least(k, 4 - k), 0.0, 1.0)
        return whole(x * 255).cast("int")

    return F.array(channel(5), channel(3), channel(1))


def brightened(px: DataFrame, value: str, alpha: float, beta: float, by_mean: bool = True) -> DataFrame:
    """Adds bright: alpha * value + beta * the image's mean (or 255), within 0 and 255, cut to a whole number."""
    if by_mean:
        px = px.join(px.groupBy("img").agg(F.avg(value).alias("_m")), "img")
        add = F.col("_m") * beta
    else:
        add = F.lit(255.0 * beta)
    return px.withColumn("bright", within(F.col(value) * F.lit(alpha) + add, 0, 255).cast("int")).drop("_m")


def gamma(value: Column, power: float) -> Column:
    """An 8-bit value by a power law, cut to a whole number."""
    return (F.pow(value / 255.0, F.lit(power)) * 255.0).cast("int")


def shadowed(px: DataFrame, polygon: list[tuple[int, int]], value: str = "v") -> DataFrame:
    """Adds shaded: half the lightness inside a polygon."""
    from rasterloom.operators.annotations import inside

    return px.withColumn("shaded", F.when(inside(F.col("xx"), F.col("yy"), polygon), F.floor(F.col(value) * 0.5)).otherwise(F.col(value)))


def shaded_colour(r: Column, g: Column, b: Column, share: float = 0.5) -> Column:
    """An 8-bit colour with its lightness (of hue, lightness and saturation) times share, hue and saturation kept."""
    r, g, b = (x.cast("double") / 255 for x in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light = (high + low) / 2
    new = light * share
    # saturation is the spread over the widest that the lightness allows
    spread = F.when(high > low, (1 - F.abs(2 * new - 1)) / (1 - F.abs(2 * light - 1))).otherwise(F.lit(0.0))
    return F.array(*(F.floor(F.round((new + (x - light) * spread) * 255, 6) + 0.5).cast("int") for x in (r, g, b)))


def shadowed_colours(px: DataFrame, polygon: list[tuple[int, int]], names: tuple[str, str, str] = ("r", "g", "b"), share: float = 0.5) -> DataFrame:
    """px with the colours inside a polygon at a share of their lightness."""
    from rasterloom.operators.annotations import inside

    rows = px.withColumn("_c", F.when(inside(F.col("xx"), F.col("yy"), polygon), shaded_colour(*(F.col(n) for n in names), share)).otherwise(F.array(*(F.col(n).cast("int") for n in names))))
    return rows.withColumns({n: F.col("_c")[i] for i, n in enumerate(names)}).drop("_c")


def rock_bands(px: DataFrame, height: str = "height", sd: float = 33.0, mean: float = 136.0) -> DataFrame:
    """img, yy, xx and bands: value, value again and height (F16). Black pixels are grey (127) first; the value, the highest channel of r, g, b, is
    moved to a mean and standard deviation over its image, and cut to a whole number."""
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    rows = px.withColumn("_v", F.when(black, F.lit(127)).otherwise(F.greatest("r", "g", "b")))
    value = F.floor(F.round("standardised", 6)).cast("int")
    return standardised(rows, "_v", sd, mean).select("img", "yy", "xx", F.array(value, value, F.col(height).cast("int")).alias("bands"))


def standard_bands(bands: Column, means: list[float], sds: list[float]) -> Column:
    """(x - mean) / sd, band by band."""
    pairs = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(means, sds, strict=True)))
    return F.zip_with(bands, pairs, lambda x, p: (x - p["m"]) / p["s"])


def height_lookup(px: DataFrame, palette: DataFrame) -> DataFrame:
    """palette: pct, r, g, b in the order of pct. Adds pct to px with r, g, b.

    Colours between neighbouring palette rows are interpolated along the channel that changes most. The dense table of
    packed colours has at most 256 rows a pair of palette rows, so it is broadcast. Colours that aren't in it have null.
    """
    order = Window.orderBy("pct")  # a palette has some ten rows
    names = ("r", "g", "b")
    pairs = palette.select("pct", *names, F.lead("pct").over(order).alias("pct2"), *(F.lead(c).over(order).alias(f"{c}2") for c in names)).where("pct2 is not null")
    steps = F.greatest(*(F.abs(F.col(f"{c}2") - F.col(c)) for c in names), F.lit(1))
    at = pairs.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), steps)))
    part = F.col("_i") / F.col("_n")
    mixed = [F.round(F.col(c) + (F.col(f"{c}2") - F.col(c)) * part).cast("int") for c in names]
    lut = at.select(packed(*mixed).alias("_rgb"), (F.col("pct") + (F.col("pct2") - F.col("pct")) * part).alias("pct")).groupBy("_rgb").agg(F.min("pct").alias("pct"))
    return px.withColumn("_rgb", packed(F.col("r"), F.col("g"), F.col("b"))).join(F.broadcast(lut), "_rgb", "left").drop("_rgb")


def packed(r: Column, g: Column, b: Column) -> Column:
    """Three 8-bit channels in one number."""
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpacked(rgb: Column) -> Column:
    """The channels of a packed colour."""
    return F.array(*(F.shiftright(rgb, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)))
