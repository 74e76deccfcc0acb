"""Exact duplicates by Grace hash partitioning: spilled records, buckets that fit a table, whole contents compared."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import give_back, materialise, partitions, slices, string_bytes, text_batches

#: Different text, and rows, that a task takes in before it spills what it has as records.
CHUNK_BYTES, CHUNK_ROWS = 8_000_000, 500_000
#: Text of a bucket that a table takes at once; fuller ones are partitioned again.
BUCKET_BYTES = 16_000_000
#: Records that a part of an overfull bucket holds at least, so that copies of one very long text meet.
LEAST_MEET = 8
#: Levels of partitioning; after the last one tables take what is left, however much.
LEVELS = 10
#: Bytes of an Arrow batch that a task gives back.
_OUT = 2_000_000
_BLANKS = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))
_RUNS = re.compile(rb"  +")


def normalised(text: bytes) -> bytes:
    """The text with every run of the six ASCII white-space characters as one space."""
    text = text.translate(_BLANKS)
    return _RUNS.sub(b" ", text) if b"  " in text else text


class Texts:
    """Different texts by open addressing. A slot holds a text's number. Where a slot is taken, the hash and then all bytes are
    compared, and if they differ the next slot is tried."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.texts, self.bytes = [-1] * 256, [], [], 0

    def place(self, h: int, text: bytes) -> int:
        """The number of text, which is taken in if it is new."""
        slots, last = self.slots, len(self.slots) - 1
        i = h & last
        while (j := slots[i]) >= 0:
            if self.hashes[j] == h and self.texts[j] == text:
                return j
            i = (i + 1) & last
        slots[i] = j = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text)
        if 2 * len(self.texts) > last:
            self._widen()
        return j

    def _widen(self) -> None:
        self.slots = slots = [-1] * (4 * len(self.slots))
        last = len(slots) - 1
        for j, h in enumerate(self.hashes):
            i = h & last
            while slots[i] >= 0:
                i = (i + 1) & last
            slots[i] = j


def text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _records(chunk_bytes: int):
    """Rows (id, text, carried columns) as records: one for each different text of a chunk, with the rows that have it, smallest id first."""

    def spilled(first: int, table: Texts, held: list[pa.RecordBatch], of: list[int]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, none = rows.column(0).fill_null(0).to_numpy(), rows.column(0).is_null().to_numpy()
        of = np.asarray(of)
        order = np.lexsort((ids, none, of))
        entries = pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns], fields=list(rows.schema)).take(pa.array(order))
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(table.texts)))])
        size = np.array([len(t) for t in table.texts])
        for a, b in slices(np.concatenate([[0], np.cumsum(size)]), _OUT):
            lists = pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), entries.slice(ends[a], ends[b] - ends[a]))
            hashes = np.array(table.hashes[a:b], np.uint64).view(np.int64)
            low = entries.take(pa.array(ends[a:b])).field(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(a, b) + first), pa.array(hashes), pa.array(size[a:b]), pa.array(table.texts[a:b], pa.binary()), low, pa.array(np.diff(ends[a : b + 1])), lists],
                ["rec", "hash", "size", "text", "low", "n", "entries"],
            )

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        table, held, of = Texts(), [], []
        for batch in batches:
            raw, offsets = string_bytes(batch.column(1))
            raw, offsets = raw.tobytes(), offsets.tolist()
            for a, b in zip(offsets, offsets[1:], strict=False):
                text = normalised(raw[a:b])
                of.append(table.place(text_hash(text), text))
            held.append(batch.drop_columns(["text"]).take(pa.array(np.arange(batch.num_rows))))  # a copy: else the batch's texts stay
            if table.bytes > chunk_bytes or len(of) > CHUNK_ROWS:
                yield from spilled(first, table, held, of)
                first += len(table.texts)
                table, held, of = Texts(), [], []
        if of:
            yield from spilled(first, table, held, of)
        give_back()

    return fn


def _met(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[Texts, list[tuple]]]:
    """Records in the order of key: for each key its table, and (number in the table, rec, low, n) of its records."""
    now, table, members = None, Texts(), []
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
        values = zip(batch.column("rec").to_pylist(), batch.column("low").to_pylist(), batch.column("n").to_pylist(), batch.column("hash").to_pylist(), batch.column("text"), strict=True)
        for k, (rec, low, n, h, text) in zip(keys, values, strict=True):
            if k != now:
                if members:
                    yield table, members
                now, table, members = k, Texts(), []
            members.append((table.place(h & 0xFFFFFFFFFFFFFFFF, text.as_py()), rec, low, n))
    if members:
        yield table, members


def _leaders(members: list[tuple]) -> dict[int, list]:
    """Of each text its first record (smallest id, null last, then smallest number), that id, and how many rows have it."""
    best: dict[int, list] = {}
    for j, rec, low, n in members:
        held = best.get(j)
        if held is None:
            best[j] = [rec, low, n]
            continue
        held[2] += n
        if (low is None, low or 0, rec) < (held[1] is None, held[1] or 0, held[0]):
            held[:2] = rec, low
    return best


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each record of a bucket the group's first record, its id, its size and the digest of its text."""
    for table, members in _met(batches, ["bucket"]):
        best, digest = _leaders(members), [hashlib.sha256(t).hexdigest() for t in table.texts]
        for at in range(0, len(members), 50_000):
            some = members[at : at + 50_000]
            columns = [[m[1] for m in some], *([best[m[0]][i] for m in some] for i in range(3)), [digest[m[0]] for m in some]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rec", "keep_rec", "keep_id", "group_size", "sha"])
    give_back()


_PART = "rec long, hash long, size long, text binary, low long, n long, bucket long, hands long"


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of parts of overfull buckets, those with one text as one record: hands is the record that a record hands over to, itself if it stays."""
    names = ["rec", "hash", "size", "text", "low", "n", "bucket", "hands"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for table, members in _met(batches, ["bucket", "part"]):
        best, rows, held = _leaders(members), [], 0
        for j, rec, _, _ in members:
            lead, low, n = best[j]
            stays = rec == lead
            rows.append((rec, table.hashes[j] - (table.hashes[j] >> 63 << 64), len(table.texts[j]), table.texts[j] if stays else None, low, n, 0, lead))
            held += len(table.texts[j]) if stays else 40
            if held > _OUT:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


def _in_order(df: DataFrame, n: int, *key: str) -> DataFrame:
    return df.repartition(n, *key).sortWithinPartitions(*key)


def exact_groups(docs: DataFrame, *, id_col="doc_id", text_col="text", carry: list[str] = (), chunk_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row of docs, and its columns named in carry.

    Texts are equal if all their bytes are, once runs of ASCII white space are one space. Of equal texts the row with the smallest id
    is kept; keep_id is its id, group_size the number of rows.

    1. Each task spills records: one for each different text of a chunk, with that chunk's rows. Hot texts shrink here.
    2. Records are dealt by hash into buckets of some BUCKET_BYTES / 2, by the bytes counted. Buckets found to hold more are
       spilled again: their records pass tables in parts of a size, so copies become one, and then part by another hash; so on, until
       each bucket fits. Only whether any is overfull comes to the driver.
    3. A bucket's records pass an open-addressing table that compares whole contents.
    4. Rows meet their group by the number of their record, which few rows share.

    Null texts are empty, and empty texts are equal. Null ids come last; a group of null ids alone has a null keep_id, and keeps one row.
    Of rows that repeat the smallest id one is kept. Very long texts are records alone. Empty tables give empty results; columns that
    aren't named aren't read, and may have any names.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kinds = [T.StructField("id", T.LongType())] + [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    entry = T.StructType(kinds)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("rec", "hash", "size")] + [T.StructField("text", T.BinaryType()), T.StructField("low", T.LongType()), T.StructField("n", T.LongType()), T.StructField("entries", T.ArrayType(entry))])
    records = materialise(rows.mapInArrow(_records(chunk_bytes or CHUNK_BYTES), schema))

    most = bucket_bytes or BUCKET_BYTES
    total = records.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-2 * total // most))
    todo = records.drop("entries").withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(n)))
    fitting, handed = [], []
    for level in range(1, LEVELS + 1):
        sizes = todo.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("count"), (F.min("hash") == F.max("hash")).alias("one"))
        over = sizes.where((F.col("bytes") > most) & (F.col("count") > 1) & ~(F.col("one") & (F.col("count") <= LEAST_MEET)))
        over = materialise(over.select("bucket", F.greatest(F.lit(2), F.least(F.ceil(2 * F.col("bytes") / most), F.ceil(F.col("count") / LEAST_MEET))).alias("fan")))
        if level == LEVELS or over.isEmpty():
            break
        fitting.append(todo.join(over, "bucket", "left_anti"))
        split = todo.join(over, "bucket").withColumn("part", F.pmod(F.xxhash64("rec"), "fan"))
        passed = materialise(_in_order(split, partitions(spark), "bucket", "part").drop("fan").mapInArrow(_parted, _PART))
        handed.append(passed.where("hands <> rec").select("rec", F.col("hands").alias("to")))
        todo = passed.where("hands = rec").drop("hands", "bucket").withColumn("bucket", F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(n)))
    found = None
    for part in [*fitting, todo]:
        one = _in_order(part.select("bucket", "rec", "low", "n", "hash", "text"), max(n, partitions(spark)), "bucket").mapInArrow(_grouped, "rec long, keep_rec long, keep_id long, group_size long, sha string")
        found = one if found is None else found.union(one)
    for link in reversed(handed):
        found = materialise(found)
        found = found.union(link.join(found.withColumnRenamed("rec", "to"), "to").select("rec", "keep_rec", "keep_id", "group_size", "sha"))
    each = records.select("rec", F.posexplode("entries").alias("at", "e"))
    kept = (F.col("rec") == F.col("keep_rec")) & (F.col("at") == 0)
    return each.join(found, "rec").select(F.col("e.id").alias("id"), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), *(F.col(f"e.c{i}").alias(c) for i, c in enumerate(carry)))


def deduplicated(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs that exact_groups keeps, as they were."""
    whole = docs.select(F.col(id_col), F.col(text_col), F.struct(*docs.columns).alias("__row"))
    return exact_groups(whole, id_col=id_col, text_col=text_col, carry=["__row"]).where("kept").select("__row.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""
