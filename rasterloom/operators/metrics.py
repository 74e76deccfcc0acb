"""Scores, losses and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows whose order says where the parts of a history begin.
SAMPLE = 4096


def confusion(rows: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """keys, tp, fp, fn: one aggregation with map-side sums."""
    count = lambda c: F.count_if(c)
    return rows.groupBy(*keys).agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & actual).alias("fn"))


def f_score(beta: float) -> Column:
    b = beta * beta
    hit = F.col("tp") * (1 + b)
    return hit / F.nullif(hit + F.col("fn") * b + F.col("fp"), F.lit(0.0))


def scores(rows: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """keys, iou, f1, f2 (A18); null where nothing is predicted or there."""
    c = confusion(rows, keys, predicted, actual)
    return c.select(*keys, (F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("iou"), f_score(1).alias("f1"), f_score(2).alias("f2"))


def losses(rows: DataFrame, keys: list[str], p: Column, y: Column, weight: Column | float = 1.0, gamma: float = 2.0) -> DataFrame:
    """keys, bce, weighted, focal, mse, mae (A19); probabilities are kept 1e-7 away from 0 and 1."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    w = weight if isinstance(weight, Column) else F.lit(weight)
    bce = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    focal = -(y * F.pow(1 - p, F.lit(gamma)) * F.log(p) + (1 - y) * F.pow(p, F.lit(gamma)) * F.log(1 - p))
    gap = p - y
    return rows.groupBy(*keys).agg(F.avg(bce).alias("bce"), (F.sum(bce * w) / F.sum(w)).alias("weighted"), F.avg(focal).alias("focal"), F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"))


def dataset_means(per_image: DataFrame, metrics: list[str]) -> DataFrame:
    """The mean of each metric over images."""
    return per_image.agg(*(F.avg(m).alias(m) for m in metrics))


def _in_parts(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """Adds _part, which rises with the order, of any type that sorts: rows of a group are counted and summed part by part, so that no task
    holds a whole group. Edges are taken from SAMPLE rows by a hash, and these values come to the driver; results don't depend on where they lie."""
    if parts < 2:
        return rows.withColumn("_part", F.lit(0))
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    some = rows.where(F.col(order).isNotNull()).select(order, F.xxhash64(*plain).alias("_h")).orderBy("_h").limit(SAMPLE).collect()
    values = sorted({r[0] for r in some if r[0] == r[0]})
    edges = sorted({values[i * len(values) // parts] for i in range(1, parts)}) if len(values) > 1 else []
    return rows.withColumn("_part", F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(order))), F.lit(0)) if edges else F.lit(0))


def running_extrema(log: DataFrame, group: str, order: str, value: str, parts: int = 64) -> DataFrame:
    """Adds lowest and highest of the rows so far in a group.

    Parts of a group run side by side and take over what the parts before hold. Rows alike in order are taken in any order; all rows of one order are one part.
    """
    rows = _in_parts(log, order, parts)
    keys = [group, "_part"]
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    own = rows.groupBy(*keys).agg(F.min(value).alias("_l"), F.max(value).alias("_h")).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.min("_l").over(before).alias("_l"), F.max("_h").over(before).alias("_h"))
    found = rows.withColumns({"lowest": F.min(value).over(so_far), "highest": F.max(value).over(so_far)})
    joined = found.join(own, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")), "left")
    return joined.withColumns({"lowest": F.least("lowest", "_l"), "highest": F.greatest("highest", "_h")}).drop("_part", "_g", "_p", "_l", "_h")


def accumulated(rows: DataFrame, group: str, order: str, value: str, every: int, parts: int = 64) -> DataFrame:
    """Sums of `every` rows in turn (X3): group, step, total; a sum that isn't full isn't given. Rows are numbered part by part."""
    rows = _in_parts(rows, order, parts)
    keys = [group, "_part"]
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    base = rows.groupBy(*keys).agg(F.count("*").alias("_c")).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    numbered = own.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("step", F.floor((F.col("_base") + F.col("_own")) / every))
    return numbered.groupBy(group, "step").agg(F.sum(value).alias("total"), F.count("*").alias("_n")).where(F.col("_n") == every).drop("_n")
