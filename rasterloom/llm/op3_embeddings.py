"""Near-duplicate embeddings by tiled comparison along principal axes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import groups, materialise
from rasterloom.llm.components import components, stars

#: Vectors of a block at least and at most (blocks grow with the root of their number), bytes of one at most, and vectors of a
#: side of the tiles compared at once.
BLOCK, MOST_BLOCK, BLOCK_BYTES, TILE = 8192, 65_536, 64_000_000, 1024
#: Numbers of a piece of the matrix of moments.
SLAB = 1 << 17
#: Leading axes after which a tile is judged by its bounds; the remaining ones follow.
STEPS = (12, 32)
#: Leading axes whose ranges say that two blocks have no pair in reach.
BOX = 8
#: Rounding allowed for before the exact cosine.
SLACK = 1e-6


def usable(column: str):
    """Whether a column of arrays holds a vector that has a direction: no nulls, all finite, not all zero."""
    c = F.col(column).cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision and safe from over- and underflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            x = _unit(_matrix(batch.filter(pa.array(dims == dim)).column("v"), dim))
            sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, s in sums.items():
        for slab, at in enumerate(range(0, dim * dim, SLAB)):
            yield _slab(dim, slab, s.ravel()[at : at + SLAB])


def _slab(dim: int, slab: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([slab], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["dim", "slab", "data"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for dim, slab, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[dim, slab] = sums.get((dim, slab), 0) + np.frombuffer(data)
    for (dim, slab), values in sums.items():
        yield _slab(dim, slab, values)


def axes_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """Of each number of dimensions, the axes as columns, the one along which most lies first. dim * dim sums come to the driver,
    as binary pieces that tasks have added up."""
    kind = "dim int, slab int, data binary"
    pieces = classes.select("dim", "v").mapInArrow(_moments, kind).repartition("dim", "slab").mapInArrow(_added, kind).orderBy("dim", "slab").collect()
    found: dict[int, list] = {}
    for r in pieces:
        found.setdefault(r.dim, []).append(np.frombuffer(r.data))
    return {dim: np.linalg.eigh(np.concatenate(s).reshape(dim, dim))[1][:, ::-1].copy() for dim, s in found.items()}


def _first_axis(axes: dict[int, np.ndarray]):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            first = np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                first[dims == dim] = _unit(_matrix(batch.filter(pa.array(dims == dim)).column("v"), dim)) @ axes[dim][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "first"])

    return fn


def _blocks(axes: dict[int, np.ndarray], most: int, kind: str):
    """Rows in order of dim and place along the first axis: packed blocks with the ranges of their leading axes. kind: the
    numbers' type, as exact as the input's."""

    def pack(dim: int, rows: pa.Table) -> pa.RecordBatch:
        vectors = _matrix(rows.column("v").combine_chunks(), dim)
        along = _unit(vectors) @ axes[dim][:, : min(BOX, dim)]
        values = [uuid.uuid4().hex, dim, along.min(0).tolist(), along.max(0).tolist(), rows.column("id").to_numpy().tobytes(), rows.column("n").to_numpy().tobytes(), vectors.astype(kind).tobytes()]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], ["block", "dim", "low", "high", "ids", "ns", "vectors"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "dim"):
            dim = rows.column("dim")[0].as_py()
            size = max(1, min(most, BLOCK_BYTES // (8 * dim)))
            for at in range(0, rows.num_rows, size):
                yield pack(dim, rows.slice(at, size))

    return fn


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the pairs whose cosine is at least threshold; same: a is b, each pair once.

    Products along the leading axes are added up first. What the remaining axes can add is at most the product of the
    lengths that both vectors have there, so a tile none of whose pairs can reach the threshold is left at once, and
    once few pairs are left only those are carried on.
    """
    a, b = _unit(a), _unit(b)
    ra, rb = a @ axes, b @ axes
    steps = [k for k in STEPS if k < a.shape[1]] + [a.shape[1]]
    rest = lambda r, k: np.sqrt((r[:, k:] ** 2).sum(1))
    found_a, found_b = [], []
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            x, y = ra[i : i + TILE], rb[j : j + TILE]
            total, done, left = 0, 0, None
            for k in steps:
                total = total + x[:, done:k] @ y[:, done:k].T
                done = k
                reach = total + np.outer(rest(x, k), rest(y, k)) if k < a.shape[1] else total
                left = np.flatnonzero(reach.ravel() >= threshold - SLACK)
                if len(left) < reach.size // 64:
                    break
            p, q = np.divmod(left, len(y))
            p, q = p + i, q + j
            if same:
                p, q = p[q > p], q[q > p]
            for s in range(0, len(p), 200_000):
                u, v = p[s : s + 200_000], q[s : s + 200_000]
                good = np.einsum("ij,ij->i", a[u], b[v]) >= threshold
                found_a.append(u[good])
                found_b.append(v[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _compare(axes: dict[int, np.ndarray], threshold: float, kind: str):
    """The one or two blocks of a pair: of each class with links, how many and the smallest class that they chain to."""

    def fn(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        sides = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ns"], np.int64), np.frombuffer(r["vectors"], kind).astype(np.float64).reshape(-1, dim)) for r in table.select(["ids", "ns", "vectors"]).to_pylist()]
        (ia, na, va), (ib, nb, vb) = sides[0], sides[-1]
        p, q = linked(va, vb, axes[dim], threshold, len(sides) == 1)
        ends, links = np.concatenate([ia[p], ib[q]]), np.concatenate([nb[q], na[p]])
        ids, back = np.unique(ends, return_inverse=True)
        node, root = stars(ia[p], ib[q])
        roots = ids.copy()
        roots[np.searchsorted(ids, node)] = root
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(np.bincount(back, links, minlength=len(ids)).astype(np.int64)), pa.array(roots, pa.int64())], ["id", "links", "root"])

    return fn


def near_duplicates(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", threshold: float = 0.9) -> DataFrame:
    """id, n_links, component_id and kept of every row of vectors.

    Rows link if their cosine, in double precision, is at least threshold; n_links counts the other rows linked,
    component_id is the smallest id reachable, kept whether that is the row's own.

    Equal vectors are one class and are compared once. Classes are put in order along the first principal axis and cut
    into blocks; blocks whose leading axes lie too far apart are never paired. Every other pair of blocks is compared in
    tiles, and gives each vector's count and one edge a vector, never its pairs. All pairs of blocks in reach are compared, so the
    work grows with the square of what lies together; copies add nothing to it.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. A null id links with nothing and isn't kept. Rows that repeat an id are one point of the graph with the links
    of all, each row having n_links of its own vector. Empty tables give empty results; other columns aren't read.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), usable(vector_col).alias("ok"))
    good = F.col("ok") & F.col("id").isNotNull()
    # a class goes by a number of its own, since several classes may have one smallest id; writing it fixes the number
    numbered = rows.where(good).groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("id"), "low", "n", "v", F.size("v").alias("dim"))
    classes = materialise(numbered)
    axes = axes_of(classes)
    total = classes.count()
    most = min(MOST_BLOCK, max(BLOCK, int(8 * total**0.5)))
    n = max(1, -(-total // most))
    placed = classes.select("id", "n", "v", "dim").mapInArrow(_first_axis(axes), "id long, n long, v array<double>, dim int, first double")
    ordered = placed.repartitionByRange(n, "dim", "first", "id").sortWithinPartitions("dim", "first", "id").coalesce(n)
    blocks = materialise(ordered.mapInArrow(_blocks(axes, most, kind), "block string, dim int, low array<double>, high array<double>, ids binary, ns binary, vectors binary"))

    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    box = blocks.select("block", "dim", "low", "high")
    place = lambda x: F.floor(x / reach).cast("int")
    left = box.withColumn("bin", F.explode(F.sequence(place(F.col("low")[0]), place(F.col("high")[0])))).alias("l")
    right = box.withColumn("bin", F.explode(F.sequence(place(F.col("low")[0] - reach), place(F.col("high")[0] + reach)))).alias("r")
    gap = F.zip_with(F.zip_with("r.low", "l.high", lambda x, y: x - y), F.zip_with("l.low", "r.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= reach * reach
    pairs = left.join(right, (F.col("l.dim") == F.col("r.dim")) & (F.col("l.bin") == F.col("r.bin")) & (F.col("l.block") <= F.col("r.block"))).where(near)
    pairs = pairs.select(F.col("l.block").alias("a"), F.col("r.block").alias("b")).distinct()
    sides = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("block"), F.concat_ws("-", "a", "b").alias("pair"))
    tiles = sides.join(blocks.select("block", "dim", "ids", "ns", "vectors"), "block")
    found = materialise(tiles.groupBy("pair").applyInArrow(_compare(axes, threshold, kind), "id long, links long, root long"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # ids with different vectors tie those vectors' classes together
    vector = F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"))
    several = rows.where(good).groupBy("id").agg(F.min(vector).alias("a"), F.max(vector).alias("b")).where("a <> b").select("id")
    tied = rows.where(good).join(several, "id").select("id", "v").join(classes.select("v", F.col("id").alias("class")), "v").select("id", "class")
    ties = tied.join(tied.groupBy("id").agg(F.min("class").alias("first")), "id").select(F.col("class").alias("a"), F.col("first").alias("b"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(ties)).withColumnRenamed("node", "id")
    grouped = classes.select("id", "low", "n", "v").join(links, "id", "left").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("least"))
    named = grouped.join(lowest, "component").select("v", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    # usable rows have their class by its vector; the others stand alone
    linked_rows = rows.where(good).join(named, "v").select("id", F.col("links").cast("long").alias("n_links"), F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
    return linked_rows.union(rows.where(~good).select("id", F.lit(0).cast("long"), "id", F.col("id").isNotNull()))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id
"""
