"""Mixing sources to target weights by nested histograms of a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import WORD, materialise

#: Three levels of 4096 hash buckets tell apart 2 ** 36 documents of a source; what still shares a bucket shares its words.
LEVELS, BITS = 3, 12
#: Parts into which the join dealt by source splits each source.
SALTS = 32


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: source, source_size, one row for each source. Adds target.

    The share of all sizes is dealt by weight; a source that would get more than cap times its size stops there and the
    rest is dealt anew. Written as one water level: sources fill up in the order of cap * size / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.lit(0)
    for i, x in enumerate(weights):
        w = F.when((F.col("_rank") - 1) % len(weights) == i, F.lit(x)).otherwise(w)
    ranked = sizes.withColumn("_rank", F.row_number().over(order)).withColumn("_w", w)
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_full", F.col("_cap") / F.col("_w"))
    fill = Window.orderBy("_full", "_rank")
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.lit(float(share)) * F.col("_total") - F.col("_before")) / F.col("_left"))
        .withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_rank", "_level"))).over(everything)["_level"])
    )
    return ranked.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_w") * F.col("_water")), "_cap").alias("target"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, cap=2.0, carry=()) -> DataFrame:
    """How many words a mix takes of every document.

    Returns id_col, source, size, source_size, target, taken and the columns named in carry. size is the number of words
    (null text: 0). A source's target is taken as whole passes over all its documents; of the last, partial pass it
    takes the documents whose hash lies below a threshold, and from the one at the threshold as many words as are missing,
    so a source's taken words are its target rounded down. No document gives more than ceil(cap) times its size.

    The threshold is found by summing words in 4096 hash buckets a source, then in 4096 parts of the bucket in which the
    budget ends, and so on. Documents that share a whole hash (rows with one id) share the missing words in proportion.
    Null sources form a source of their own, last in order; null ids hash as an empty text. Sources without words have
    target 0. An empty table gives an empty result. Clashing column names in docs aren't read.
    """
    hash_hex = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, LEVELS * BITS // 4)
    light = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), F.conv(hash_hex, 16, 10).cast("long").alias("_h"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)),
    )
    light = materialise(light)
    sizes = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = materialise(sizes.withColumn("_whole", whole).withColumn("_rest", F.floor("target") - F.col("_whole") * F.col("source_size")).withColumn("_at", F.lit(0).cast("long")))

    inside = light.select("source", "_h", "size")
    edge = plan.select("source", "_at", "_rest", F.lit(0).cast("long").alias("_leaf"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        part = F.shiftright("_h", shift)
        if level > 1:
            inside = inside.withColumn("_up", F.shiftright("_h", shift + BITS)).alias("i").join(edge.select("source", F.col("_at").alias("_up")).alias("e"), F.col("i.source").eqNullSafe(F.col("e.source")) & (F.col("i._up") == F.col("e._up"))).select("i.source", "i._h", "i.size")
        sums = inside.groupBy("source", part.alias("_part")).agg(F.sum("size").alias("_sum"))
        along = Window.partitionBy("source").orderBy("_part")
        sums = sums.withColumn("_cum", F.sum("_sum").over(along)).alias("s")
        edge = (
            sums.join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")))
            .where("s._cum > e._rest")
            .groupBy("s.source")
            .agg(F.min(F.struct("_part", "_sum", "_cum", "_rest")).alias("m"))
            .select("source", F.col("m._part").alias("_at"), (F.col("m._rest") - (F.col("m._cum") - F.col("m._sum"))).alias("_rest"), F.col("m._sum").alias("_leaf"))
        )
        edge = materialise(edge)

    p, e, d = plan.alias("p"), edge.alias("e"), light.withColumn("_salt", F.pmod("_h", F.lit(SALTS))).alias("d")
    rule = p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.source", "p.source_size", "p.target", "p._whole", "e._at", "e._rest", "e._leaf")
    rule = rule.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("r")
    extra = F.when(F.col("d._h") < F.col("r._at"), F.col("d.size")).when(F.col("d._h") == F.col("r._at"), F.expr("(r._rest * d.size) div r._leaf")).otherwise(F.lit(0))
    return d.join(rule, F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d._salt") == F.col("r._salt"))).select(
        F.col("d._id").alias(id_col), "d.source", "d.size", "r.source_size", "r.target", (F.col("r._whole") * F.col("d.size") + extra).cast("long").alias("taken"),
        *(F.col(f"d._c{i}").alias(c) for i, c in enumerate(carry)),
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM s),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY full_at, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, k LIMIT 1)), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS passes FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.passes, (floor(p.target) - p.passes * p.source_size)::BIGINT AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h)::BIGINT AS cum, sum(d.size) OVER (PARTITION BY d.source, d.h)::BIGINT AS tied
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (passes * size + CASE WHEN cum <= rest THEN size WHEN cum - tied < rest THEN ((rest - (cum - tied)) * size) // tied ELSE 0 END)::BIGINT AS taken
FROM c
"""
