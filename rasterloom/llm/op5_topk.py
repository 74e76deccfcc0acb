"""Exact top-k search by accumulating one term's postings after another."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import give_back, groups, materialise, shared_folder

#: Candidates of a block, queries of a block, and queries whose scores are held at once.
CANDIDATES, QUERIES, AT_ONCE = 4096, 1024, 32
#: Bytes of a block as 64-bit numbers; queries, and their bytes, that are broadcast at once, which bounds what a driver and a worker hold.
BLOCK_BYTES, GROUP, GROUP_BYTES = 8_000_000, 32_768, 64_000_000
#: Blocks of candidates after which a task merges what they gave.
MERGE = 16


def _packed(most: int):
    """Rows in the order of dim, as blocks of ids and whole numbers."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "dim"):
            dim = rows.column("dim")[0].as_py()
            size = max(1, min(most, BLOCK_BYTES // (8 * dim)))
            for at in range(0, rows.num_rows, size):
                some = rows.slice(at, size)
                values = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                small = np.abs(values).max(initial=0) < 2**15
                block = [dim, int(small), some.column("id").to_numpy().tobytes(), values.astype(np.int16 if small else np.int64).tobytes()]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(block, kinds, strict=True)], ["dim", "small", "ids", "vals"])

    return fn


_BLOCK = "dim int, small int, ids binary, vals binary"


def _opened(r) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vals"], np.int16 if r["small"] else np.int64).reshape(-1, r["dim"])


def _in_groups(blocks: Iterator) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Query blocks in groups of a bounded size."""
    held, rows, size = [], 0, 0
    for r in blocks:
        ids, values = _opened(r)
        if held and (rows + len(ids) > GROUP or size + values.size * 8 > GROUP_BYTES):
            yield held
            held, rows, size = [], 0, 0
        held.append((r["dim"], ids, values))
        rows, size = rows + len(ids), size + values.size * 8
    if held:
        yield held


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's id, score) of each query's k best, ties to smaller ids; its own id takes no part.

    Each term scatters its postings (the candidates that have it, and their weights), times each query's weight, into
    the queries' rows of scores. Afterwards a selection by partition gives the k-th score, and only what reaches it is ordered.
    """
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.int32 if most < 2**31 - 1 else np.int64
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    postings = []
    for t in range(candidates.shape[1]):
        at = np.flatnonzero(candidates[:, t])
        postings.append((slice(None) if len(at) == len(ids) else at, np.ascontiguousarray(candidates[at, t])))
    lowest = np.iinfo(np.int64).min
    out = []
    for s in range(0, len(queries), AT_ONCE):
        some = queries[s : s + AT_ONCE]
        scores = np.zeros((len(some), len(ids)), kind)
        for t, (at, weight) in enumerate(postings):
            asked = np.flatnonzero(some[:, t])
            if not len(asked) or not len(weight):
                continue
            add = some[asked, t][:, None] * weight
            if isinstance(at, slice) and len(asked) == len(some):
                scores += add
            elif isinstance(at, slice):
                scores[asked] += add
            else:
                scores[np.ix_(asked, at)] += add
        scores = scores.astype(np.int64)
        scores[query_ids[s : s + AT_ONCE, None] == ids[None, :]] = lowest
        if len(ids) > k:
            edge = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            edge = np.full(len(some), lowest)
        row, at = np.nonzero((scores >= edge[:, None]) & (scores > lowest))
        score = scores[row, at]
        order = np.lexsort((ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        out.append((row[keep] + s, ids[at[keep]], score[keep]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def _merged(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row among several lists of (row, id, score)."""
    row, ids, score = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((ids, -score, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[order][keep], score[order][keep]


def _search(shared, k: int):
    """Each task's k best candidates of every query, merged block by block."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        found: list[list] = [[] for _ in queries]
        for batch in batches:
            for r in batch.to_pylist():
                ids, values = _opened(r)
                for held, (dim, asked, vectors) in zip(found, queries, strict=True):
                    if dim != r["dim"]:
                        continue
                    held.append(best(asked, vectors, ids, values, k))
                    if len(held) > MERGE:
                        held[:] = [_merged(held, k)]
        for at, (held, (_, asked, _)) in enumerate(zip(found, queries, strict=True)):
            if held:
                row, ids, score = _merged(held, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), at)), pa.array(row), pa.array(asked[row]), pa.array(ids), pa.array(score)], ["q", "row", "query_id", "id", "score"])
        give_back()

    return fn


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, id_col="vec_id", vector_col="embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), id and score: for each row of queries the k candidates with the highest inner product of
    floor(scale * x), over all candidates with as many components, in whole numbers. Candidates with the query's id take no part.

    Candidates are packed into blocks once. Queries go by groups of blocks of a bounded size: a group is broadcast, every task scatters its
    candidates' postings into the scores of that group's queries and keeps k of each, and what the tasks kept is merged. So candidates
    are read once a group and never shuffled, and the driver holds one group at a time.

    Vectors that are null, or hold null or non-finite components, take no part; null ids neither. Zero vectors do. Rows
    that repeat a query's id are queries of their own, rows that repeat a candidate's are candidates of their own. Scores
    are exact as long as they are below 2 ** 63. Empty tables give empty results; other columns aren't read.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        numbers = F.transform(v, lambda x: F.floor(F.lit(scale) * x).cast("long"))
        return df.where(F.coalesce((F.size(v) > 0) & ~bad, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), numbers.alias("v"), F.size(v).alias("dim"))

    spark = queries.sparkSession
    sc = spark.sparkContext
    pack = lambda df, most: materialise(whole(df).sortWithinPartitions("dim").mapInArrow(_packed(most), _BLOCK))
    asked, blocks = pack(queries, QUERIES), pack(candidates, CANDIDATES).coalesce(2 * sc.defaultParallelism)
    path, schema = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet", "query_id long, rank int, id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for group in _in_groups(r.asDict() for r in asked.toLocalIterator()):
        shared = sc.broadcast(group)
        found = blocks.mapInArrow(_search(shared, k), "q long, row long, query_id long, id long, score long")
        order = Window.partitionBy("q", "row").orderBy(F.col("score").desc(), "id")
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score").write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
