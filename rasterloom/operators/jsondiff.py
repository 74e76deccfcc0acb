"""Structural comparison of JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(text: Column) -> Column:
    """How many objects and lists lie in one another in a document: its brackets outside of strings, counted up and down."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("{", "["), 1).otherwise(0)).alias("most"))
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), none, step, lambda s: s["most"])


def _opened() -> Column:
    """What a row becomes one level deeper: an object's values, a list and its elements, or the row itself."""
    row = lambda path, kind, value, v: F.struct(path.alias("path"), F.lit(kind).alias("kind"), value.alias("value"), v.alias("v"))
    none, path, v = F.lit(None).cast("string"), F.col("path"), F.col("v")
    values, elements = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
    fields = F.transform(F.map_entries(values), lambda e: row(F.concat(path, F.lit("/"), e["key"]), "open", none, e["value"]))
    own = row(path, "list", F.size(elements).cast("string"), F.lit(None).cast("variant"))
    parts = F.concat(F.array(own), F.transform(elements, lambda x, i: row(F.concat(path, F.lit("/#"), i.cast("string")), "open", none, x)))
    leaf = row(path, "leaf", F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null")), F.lit(None).cast("variant"))
    same = F.struct("path", "kind", "value", "v")
    return F.when(F.col("kind") != "open", F.array(same)).when(F.size(values) > 0, fields).when(elements.isNotNull(), parts).otherwise(F.array(leaf))


def flattened(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, kind, value: a row a leaf or list (F48). Objects are opened by key, lists by #place, with a list's length under its own path.

    Documents are opened level by level, as many times as the deepest one needs, which is counted first: one row becomes many in the same
    task, and nothing is shuffled. Values are those of Spark's variants: strings as they are, numbers without trailing zeros. Null documents
    have no rows; of keys that an object repeats, and of texts that aren't JSON, Spark's own errors tell.
    """
    given = docs.where(F.col(text).isNotNull())
    levels = (given.agg(F.max(depth(F.col(text)))).first()[0] or 0) + 1
    rows = given.select(F.col(key).alias("_key"), F.lit("").alias("path"), F.lit("open").alias("kind"), F.lit(None).cast("string").alias("value"), F.parse_json(F.col(text)).alias("v"))
    for _ in range(levels):
        rows = rows.select("_key", F.inline(_opened()))
    return rows.select(F.col("_key").alias(key), "path", "kind", "value")


def difference(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, change ('changed', 'added', 'removed', 'length'), old_value, new_value (F48, U5): a full outer join of paths.

    What lies under a list of another length isn't listed, the list itself is.
    """
    a, b = flattened(old, key, text), flattened(new, key, text)
    rows = a.select(key, "path", F.col("kind").alias("_k1"), F.col("value").alias("old_value")).join(b.select(key, "path", F.col("kind").alias("_k2"), F.col("value").alias("new_value")), [key, "path"], "full")
    differs = ~(F.col("_k1").eqNullSafe(F.col("_k2")) & F.col("old_value").eqNullSafe(F.col("new_value")))
    change = F.when(F.col("_k1").isNull(), "added").when(F.col("_k2").isNull(), "removed").when((F.col("_k1") == "list") & (F.col("_k2") == "list"), "length").otherwise("changed")
    found = rows.where(differs).select(key, "path", change.alias("change"), "old_value", "new_value")
    lists = found.where("change = 'length'").select(F.col(key).alias("_key"), F.col("path").alias("_list"))
    under = (F.col(key) == F.col("_key")) & F.col("path").startswith(F.concat("_list", F.lit("/#")))
    return found.join(lists, under, "left_anti")
