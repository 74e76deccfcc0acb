"""A factorisation machine that scores texts for quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import give_back, slices, string_bytes, text_batches, word_bounds, word_hashes

#: Hashed words; the structure statistics have numbers above.
WORDS = 1 << 17
#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 8_000
FACTORS = 8
EPOCHS = 12
#: Bytes of text handled at once within a task.
AT_ONCE = 500_000

#: What is counted of a text's bytes: a share of all its bytes each.
_CLASSES = (
    frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset(b"abcdefghijklmnopqrstuvwxyz"), frozenset(b"0123456789"), frozenset(b".,;:"), frozenset(b"!?"),
    frozenset(b"$%&*#@^~=+"), frozenset(b"|<>{}[]\\/_"), frozenset(b"\"'()-"), frozenset(b"\n"), frozenset(b" \t\r\x0b\x0c"), frozenset(range(128, 256)),
)
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _i
#: Statistics: the classes' shares, and how many words, how long, how many different, how many lines, how repeated.
STATISTICS = len(_CLASSES) + 1 + 8


def _logarithm(x: np.ndarray) -> np.ndarray:
    return np.log1p(x) / 10


def features(raw: np.ndarray, offsets: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the rows' sparse features, sorted by row and feature.

    A hashed word has the square root of its share of the row's words, so a row's squares sum to 1; statistics follow.
    metadata: the row's stated number of characters, or -1.
    """
    n = len(offsets) - 1
    starts, ends, counts = word_bounds(raw, offsets)
    row = np.repeat(np.arange(n), counts)
    bucket = (word_hashes(raw, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    key, times = np.unique(row * WORDS + bucket, return_counts=True)
    word_row, word = key // WORDS, key % WORDS
    value = np.sqrt(times / np.maximum(counts, 1)[word_row])

    size = np.diff(offsets)
    byte_row = np.repeat(np.arange(n), size)
    k = len(_CLASSES) + 1
    shares = np.bincount(byte_row * k + _CLASS_OF[raw], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
    words = np.maximum(counts, 1)
    different = np.bincount(word_row, minlength=n)
    letters = np.bincount(row, ends - starts, minlength=n)
    spread = np.bincount(row, (ends - starts) ** 2, minlength=n) / words - (letters / words) ** 2
    top = np.zeros(n)
    np.maximum.at(top, word_row, times / words[word_row])
    lines = np.bincount(byte_row[raw == 10], minlength=n) + 1
    more = np.stack([_logarithm(counts), letters / words / 10, np.sqrt(np.maximum(spread, 0)) / 10, different / words, top, _logarithm(words / lines), _logarithm(np.maximum(metadata, 0)), (metadata < 0) * 1.0], 1)
    dense = np.minimum(np.concatenate([shares, more], 1), 5)
    rows = np.concatenate([word_row, np.repeat(np.arange(n), STATISTICS)])
    names = np.concatenate([word, np.tile(WORDS + np.arange(STATISTICS), n)])
    values = np.concatenate([value, dense.ravel()])
    order = np.argsort(rows, kind="stable")
    return rows[order], names[order], values[order]


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    scale: np.ndarray

    def raw(self, row: np.ndarray, name: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """w0 + sum of w x + half of the sum over factors of (sum v x) squared less the sum of (v x) squared."""
        value = value * self.scale[name]
        linear = np.bincount(row, self.weight[name] * value, minlength=n)
        pairs = np.zeros(n)
        for f in range(self.factor.shape[1]):
            vx = self.factor[name, f] * value
            pairs += np.bincount(row, vx, minlength=n) ** 2 - np.bincount(row, vx * vx, minlength=n)
        return self.bias + linear + pairs / 2

    def score(self, row, name, value, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(row, name, value, n), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, factors=FACTORS, epochs=EPOCHS, batch=128, rate=0.03, decay=1e-5, seed=7) -> Model:
    """Adagrad on the logistic loss, both labels weighing alike. rows: (features, values) of each labelled text.

    Without rows, or with one label only, the model answers with the labels' mean (0.5 without any).
    """
    rng = np.random.default_rng(seed)
    size = WORDS + STATISTICS
    scale = np.ones(size)
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.02, (size, factors)), scale)
    mean = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < mean < 1:
        model.bias = float(np.clip((mean - 0.5) * 8, -4, 4))
        model.factor[:] = 0
        return model
    stats = np.array([v[-STATISTICS:] for _, v in rows])
    scale[WORDS:] = 1 / np.maximum(stats.std(0) * 3, 0.02)
    weigh = np.where(labels == 1, 0.5 / mean, 0.5 / (1 - mean))
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            m = len(some)
            name = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some]) * scale[name]
            row = np.repeat(np.arange(m), [len(rows[i][0]) for i in some])
            vx = model.factor[name] * value[:, None]
            sums = np.stack([np.bincount(row, vx[:, f], minlength=m) for f in range(factors)], 1)
            squares = np.bincount(row, (vx * vx).sum(1), minlength=m)
            out = model.bias + np.bincount(row, model.weight[name] * value, minlength=m) + ((sums**2).sum(1) - squares) / 2
            slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[some]) * weigh[some] / m
            step = slope.sum()
            g0 += step**2
            model.bias -= rate * step / np.sqrt(g0)
            used, back = np.unique(name, return_inverse=True)
            each = slope[row] * value
            dw = np.bincount(back, each, minlength=len(used)) + decay * model.weight[used]
            gw[used] += dw**2
            model.weight[used] -= rate * dw / np.sqrt(gw[used])
            inner = each[:, None] * (sums[row] - vx)
            dv = np.stack([np.bincount(back, inner[:, f], minlength=len(used)) for f in range(factors)], 1) + decay * model.factor[used]
            gv[used] += dv**2
            model.factor[used] -= rate * dv / np.sqrt(gv[used])
    return model


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text, n_chars: to label, features, values."""
    for batch in batches:
        raw, offsets = string_bytes(batch.column(1))
        stated = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets, AT_ONCE):
            row, name, value = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], stated[a:b])
            ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(name, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value, pa.float32()))], ["label", "features", "values"]
            )


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", size_col="n_chars", label_col="quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most fit_rows labelled documents, the first by a hash of their ids, and of those only ids whose
    crc32 (of the id as text) modulo 5 isn't 0. Only these rows' features, not their texts, come to the driver.

    Null ids, null labels and labels other than 0 and 1 take no part; an id labelled more than once has its smallest label.
    """
    text_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.min("label").alias("label"))
    first = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # fit_rows bounds what is broadcast
    size = F.col(size_col).cast("long") if size_col in docs.columns else F.lit(None).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), size.alias("n_chars"))
    sample = texts.join(F.broadcast(first), "id").select("id", "label", "text", "n_chars")
    found = sample.select("label", "text", "n_chars").mapInArrow(_sparse, "label int, features array<int>, values array<float>")
    table = found.orderBy(F.xxhash64("features", "values")).limit(fit_rows).toArrow().combine_chunks()
    lists = [pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], pa.list_(pa.float32())) for c in ("features", "values")]
    cuts = np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))[:-1]
    names, values = (np.split(x.flatten().to_numpy(zero_copy_only=False), cuts) if table.num_rows else [] for x in lists)
    rows = list(zip(names, values, strict=True))
    return fit(rows, table.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model, *, text_col="text", size_col="n_chars", keys: list[str], out: str = "score") -> DataFrame:
    """keys (columns of docs) and the score, under the name `out`, of every row, from its whole text and stated size alone.

    Null texts score as empty ones; empty texts have statistics of 0 only. Tables without size_col count as having no
    stated size. Repeated rows score alike; empty tables give empty results.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast((model.bias, model.weight.astype(np.float32), model.factor.astype(np.float32), model.scale))  # WORDS * (FACTORS + 1) numbers, whatever the input

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            raw, offsets = string_bytes(batch.column(text))
            stated = batch.column("_size").fill_null(-1).to_numpy(zero_copy_only=False)
            found = [np.zeros(0)]
            for a, b in slices(offsets, AT_ONCE):
                found.append(own.score(*features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], stated[a:b]), b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.concatenate(found))], [f"_k{i}" for i in range(len(keys))] + ["_score"])
            give_back()

    size = F.col(size_col).cast("long") if size_col in docs.columns else F.lit(None).cast("long")
    text = f"_k{keys.index(text_col)}" if text_col in keys else "_text"
    named = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = docs.select(*named, *[F.col(text_col).cast("string").alias("_text")] * (text_col not in keys), size.alias("_size"))
    scored = rows.mapInArrow(each, T.StructType([*rows.schema.fields[: len(keys)], T.StructField("_score", T.DoubleType())]))
    return scored.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.col("_score").alias(out))


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, train(docs, labels), keys=["doc_id"])
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0  # null ids are held out of nothing
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
