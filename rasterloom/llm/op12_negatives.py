"""Hard negatives by blocked dense products of broadcast anchors with candidates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import give_back, groups, materialise, shared_folder

#: Rows, and bytes as doubles, of a block; anchors multiplied at once.
BLOCK, BLOCK_BYTES, AT_ONCE = 4096, 8_000_000, 256
#: Anchors, and their bytes as doubles, that are broadcast at once. This bounds what a driver and a worker hold, whatever the number of anchors.
GROUP, GROUP_BYTES = 32_768, 64_000_000
#: The score of no row.
NONE = -(2**63 - 1)

_BLOCK = "dim int, ids binary, labels binary, vals binary, small boolean"


def _packed(most: int):
    """Rows in the order of dim, as blocks of ids, labels and whole numbers."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "dim"):
            dim = rows.column("dim")[0].as_py()
            size = max(1, min(most, BLOCK_BYTES // (8 * dim)))
            for at in range(0, rows.num_rows, size):
                some = rows.slice(at, size)
                values = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                small = bool(np.abs(values).max(initial=0) < 2**15)
                block = [dim, some.column("id").to_numpy().tobytes(), some.column("label").to_numpy().tobytes(), values.astype(np.int16 if small else np.int64).tobytes(), small]
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(block, kinds, strict=True)], ["dim", "ids", "labels", "vals", "small"])

    return fn


def _opened(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a block."""
    values = np.frombuffer(r["vals"], np.int16 if r["small"] else np.int64).reshape(-1, r["dim"])
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), values


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers: in doubles where every sum is below 2 ** 53 and so exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """Of each of n rows the k highest scores so far and their ids; ties to smaller ids. Merging is the same in any order."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """scores and fits: a line for each of rows, a column for each of ids; only scores that fit count."""
        k, had = self.k, self.scores[rows]
        fits = fits & (scores >= had[:, -1:])
        n = np.count_nonzero(fits)
        if not n:
            return
        if n > 8 * k * len(rows) and len(ids) > k:
            low = np.where(fits, scores, scores.dtype.type(NONE))
            fits = fits & (scores >= np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k][:, None])
        r, c = np.nonzero(fits)
        line = np.concatenate([np.repeat(np.arange(len(rows)), k), r])
        score = np.concatenate([had.ravel(), scores[r, c].astype(np.int64)])
        name = np.concatenate([self.ids[rows].ravel(), ids[c]])
        order = np.lexsort((name, -score, line))
        line = line[order]
        first = order[np.arange(len(line)) - np.searchsorted(line, line) < k].reshape(len(rows), k)
        self.scores[rows], self.ids[rows] = score[first], name[first]


def _positives(shared, k: int):
    """Each task's k best rows of each anchor's label, merged block by block."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = [Best(len(a["ids"]), k) for a in anchors]
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, values = _opened(r)
                for a, held in zip(anchors, best, strict=True):
                    if a["dim"] != r["dim"]:
                        continue
                    for s in range(0, len(a["ids"]), AT_ONCE):
                        rows = slice(s, s + AT_ONCE)
                        fits = (a["labels"][rows, None] == labels) & (a["ids"][rows, None] != ids)
                        held.add(np.arange(s, min(s + AT_ONCE, len(a["ids"]))), products(a["vals"][rows], values), fits, ids)
        for at, held in enumerate(best):
            line, place = np.nonzero(held.scores > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(line), at)), pa.array(line), pa.array(held.scores[line, place]), pa.array(held.ids[line, place])], ["block", "line", "score", "id"])
        give_back()

    return fn


def _negatives(shared, found, k: int, least: Fraction, most: Fraction):
    """Each task's k best rows of other labels in the window of each anchor and positive."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, positives = shared.value, found.value
        best = [[Best(len(a["ids"]), k) for _ in range(scores.shape[1])] for a, (scores, _) in zip(anchors, positives, strict=True)]
        windows = []  # of whole numbers: at least `least`, at most `most` times the positive's score
        for scores, _ in positives:
            there = scores > NONE
            s = np.where(there, scores, 0)
            windows.append((np.where(there, -((-least.numerator * s) // least.denominator), 1), np.where(there, (most.numerator * s) // most.denominator, 0)))
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, values = _opened(r)
                for a, held, (low, high) in zip(anchors, best, windows, strict=True):
                    if a["dim"] != r["dim"]:
                        continue
                    for s in range(0, len(a["ids"]), AT_ONCE):
                        rows = slice(s, s + AT_ONCE)
                        scores = products(a["vals"][rows], values)
                        others = a["labels"][rows, None] != labels
                        for p, one in enumerate(held):
                            one.add(np.arange(s, s + len(scores)), scores, others & (scores >= low[rows, p : p + 1]) & (scores <= high[rows, p : p + 1]), ids)
        for at, (a, held, (scores, names)) in enumerate(zip(anchors, best, positives, strict=True)):
            for p, one in enumerate(held):
                line, place = np.nonzero(one.scores > NONE)
                columns = [np.full(len(line), at), line, np.full(len(line), p), a["ids"][line], names[line, p], scores[line, p], one.ids[line, place], one.scores[line, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "line", "p", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
        give_back()

    return fn


def _in_groups(blocks: Iterator) -> Iterator[list[dict]]:
    """Anchor blocks in groups of a bounded size."""
    held, rows, size = [], 0, 0
    for r in blocks:
        ids, labels, values = _opened(r)
        if held and (rows + len(ids) > GROUP or size + values.size * 8 > GROUP_BYTES):
            yield held
            held, rows, size = [], 0, 0
        held.append({"dim": r["dim"], "ids": ids, "labels": labels, "vals": values})
        rows, size = rows + len(ids), size + values.size * 8
    if held:
        yield held


def hard_negatives(
    anchors: DataFrame, rows: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", positives: int = 5, negatives: int = 5, least: float = 0.8, most: float = 1.0, scale: float = 256.0
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Vectors become floor(scale * x) and a score is the inner product, in whole numbers. An anchor's positives are its best `positives`
    rows of the same label. For each, the best `negatives` rows of other labels whose score is from least to most times the
    positive's are ranked. Higher scores come first, ties by smaller id.

    Rows are packed into blocks once. Anchors go by groups of bounded size: a group is broadcast, every task multiplies its
    candidate blocks with it and keeps the best of each anchor, and what the tasks kept is merged. A second pass over the blocks, with
    the positives broadcast too, does the same within the windows. Candidates are never shuffled; the driver holds one
    group at a time.

    Rows with a null id or label, or a vector that is null, empty or holds null or non-finite components, take no part. Vectors of
    different lengths have no score. Rows with the anchor's id are none of its positives; otherwise rows that repeat an id are rows
    of their own, as anchors too. Negative scores have empty windows if least < most. Scores are exact below 2 ** 63. Empty tables give
    empty results; other columns aren't read.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        good = F.coalesce((F.size(v) > 0) & ~bad, F.lit(False)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
        numbers = F.transform(v, lambda x: F.floor(F.lit(scale) * x).cast("long"))
        return df.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), numbers.alias("v"), F.size(v).alias("dim"))

    spark = anchors.sparkSession
    sc = spark.sparkContext
    share = lambda x: Fraction(x).limit_denominator(10**6)
    pack = lambda df, most: materialise(whole(df).sortWithinPartitions("dim").mapInArrow(_packed(most), _BLOCK))
    asked, blocks = pack(anchors, BLOCK), pack(rows, BLOCK).coalesce(2 * sc.defaultParallelism)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for group in _in_groups(r.asDict() for r in asked.toLocalIterator()):
        shared = sc.broadcast(group)
        near = blocks.mapInArrow(_positives(shared, positives), "block long, line long, score long, id long")
        order = Window.partitionBy("block", "line").orderBy(F.col("score").desc(), "id")
        top = near.withColumn("p", F.row_number().over(order) - 1).where(F.col("p") < positives).select("block", "line", "p", "score", "id").toArrow()
        found = [(np.full((len(g["ids"]), positives), NONE), np.zeros((len(g["ids"]), positives), np.int64)) for g in group]
        block, line, p, score, name = (top.column(c).to_numpy() for c in ("block", "line", "p", "score", "id"))
        for i, (scores, names) in enumerate(found):
            of = block == i
            scores[line[of], p[of]], names[line[of], p[of]] = score[of], name[of]
        known = sc.broadcast(found)
        kinds = "block long, line long, p long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
        far = blocks.mapInArrow(_negatives(shared, known, negatives, share(least), share(most)), kinds)
        order = Window.partitionBy("block", "line", "p").orderBy(F.col("negative_score").desc(), "negative_id")
        ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        shared.destroy()
        known.destroy()
    return spark.read.schema(schema).parquet(path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors.where("vec_id % 100 = 0"), vectors)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND len(a.e) = len(c.e)),
p AS (SELECT a, c AS p, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS k FROM s WHERE same AND a <> c),
n AS (SELECT p.a, p.p, p.score AS ps, s.c, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.c) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND p.k <= 5 AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5
"""
