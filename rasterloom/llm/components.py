"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise

#: Edges a task joins up at once before it passes on a spanning forest of them.
LOCAL_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the nodes of these edges that aren't smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def joined():
        a, b = stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > LOCAL_EDGES:
            out = joined()
            if out.num_rows > n // 2:
                yield out
                held, n = [], 0
            else:
                held, n = [(out.column(0).to_numpy(), out.column(1).to_numpy())], out.num_rows
    if n:
        yield joined()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (longs, not null). Returns node, component (the smallest node reachable) for every node but
    those that are the smallest of their component.

    Each task first replaces its edges by a spanning forest. Then large-star and small-star rounds hang every node under
    the smallest neighbour until nothing moves; each round's table is written to the shared folder. Only two numbers a
    round come to the driver.
    """
    now = materialise(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(low.select("a", F.col("m").alias("b")).union(hung).distinct())
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are still moving after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
