"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import give_back, materialise, own_names, text_batches
from rasterloom.llm.components import components, stars

#: Up to so many distinct fingerprints that share a segment are compared with one another directly.
DIRECT = 1024
#: Probes compared at once.
SLICE = 4096
_SEED = 42


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        some = hashes[at : at + 65536]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """docs: key (id, h), text. Returns id, text_hash and fp (the fingerprint's 64 bits as a long); null, empty and
    blank texts have 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint_of(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            key = batch.column(0)
            yield pa.RecordBatch.from_arrays([key.field(0), key.field(1), pa.array(fp.view(np.int64), pa.int64())], ["id", "text_hash", "fp"])
            give_back()

    return docs.select("key", F.col("text").cast("string").alias("text")).mapInArrow(each, "id long, text_hash long, fp long")


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    found = [np.nonzero(np.bitwise_count(a.view(np.uint64)[:, None] ^ b[s : s + SLICE].view(np.uint64)[None, :]) <= distance) for s in range(0, len(b), SLICE)]
    x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] + i * SLICE for i, f in enumerate(found)])
    return a[x], b[y]


def _verify(distance: int):
    """Rows in the order of key, and of a key those of the table first: key, fp, probe (whether fp came with a changed segment).

    Of a key only the table's fingerprints, at most DIRECT, are held while its probes pass by.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros(0, np.int64)  # the table's fingerprints of the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, probe = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held_key == key[0]:
                key, fp, probe = np.concatenate([np.full(len(held), held_key), key]), np.concatenate([held, fp]), np.concatenate([np.zeros(len(held), bool), probe])
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([cuts, [len(key)]]))
            two = cuts[n == 2]
            close = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= distance
            a, b = [fp[two[close]]], [fp[two[close] + 1]]
            for at, m in zip(cuts[n > 2].tolist(), n[n > 2].tolist(), strict=True):
                some, changed = fp[at : at + m], probe[at : at + m]
                table, asked = some[~changed], some[changed]
                if len(table):
                    pairs = [_near(table, other, distance) for other in (table, asked) if len(other)]
                    x, y = stars(*(np.concatenate([p[i] for p in pairs]) for i in (0, 1)))
                    a.append(x)
                    b.append(y)
            held_key, last = key[-1], cuts[-1]
            held = fp[last:][~probe[last:]]
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp, without repeats. Edges a, b that connect exactly the fingerprints which chains of pairs at 2 or
    fewer differing bits connect.

    Of two such fingerprints either the upper halves differ in at most one bit or the lower halves are equal (two
    differing bits can't both fall into each half). So the table holds each fingerprint under its upper and its lower
    half, and each is asked for under the 32 upper halves one bit away; what meets there is compared over all 64 bits.
    Halves that over DIRECT fingerprints share are compared no pair by pair: there the other half is looked up in the
    same way, under its own neighbours, and a fingerprint links to the smallest it meets.
    """
    fp = F.col("fp")
    upper = F.shiftrightunsigned(fp, 32)
    lower = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    # a key is the half with the number of the segment above it
    flips = F.array(*(F.struct(F.lit(True).alias("probe"), upper.bitwiseXOR(F.lit(1 << i)).alias("key")) for i in range(32)))
    own = F.array(F.struct(F.lit(False).alias("probe"), upper.alias("key")), F.struct(F.lit(False).alias("probe"), lower.bitwiseOR(F.lit(1 << 33)).alias("key")))
    rows = distinct.select("fp", F.explode(F.concat(own, flips)).alias("x")).select("x.key", "fp", "x.probe")
    table = distinct.select("fp", F.explode(own).alias("x")).select("x.key", "fp")
    crowded = materialise(table.groupBy("key").count().where(F.col("count") > DIRECT).select("key"))
    few = rows.join(table.select("key").distinct(), "key", "left_semi").join(crowded, "key", "left_anti")
    direct = few.repartition("key").sortWithinPartitions("key", "probe").mapInArrow(_verify(2), "a long, b long")

    # In a crowded half, table members are linked if their other halves are at most 2 bits apart, so have a common
    # neighbour at 1 or 0 bits; one that came with one changed bit, if its other half is at most 1 bit from a member's.
    many = rows.join(crowded, "key").withColumn("other", F.when(F.col("key").bitwiseAND(F.lit(1 << 33)) != 0, upper).otherwise(lower))
    around = F.array(F.col("other"), *(F.col("other").bitwiseXOR(F.lit(1 << i)) for i in range(32)))
    inside = many.where("not probe").select("key", "fp", F.explode(around).alias("spot"))
    hubs = inside.groupBy("key", "spot").agg(F.min("fp").alias("b"))
    within = inside.join(hubs, ["key", "spot"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    held = many.where("not probe").select("key", F.col("other").alias("spot"), F.col("fp").alias("b"))
    across = many.where("probe").select("key", "fp", F.explode(around).alias("spot")).join(held, ["key", "spot"]).select(F.col("fp").alias("a"), "b")
    return direct.union(within).union(across)


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = 3) -> DataFrame:
    """id, text_hash, fp and component_id (the smallest id reachable over links of 2 or fewer differing bits, itself
    included) of every row.

    Documents with one fingerprint are one class and are looked up once, so no pairs of copies arise. Null, empty and
    blank texts have fingerprint 0 and link like any others. Rows that repeat an id are rows of their own. A null id
    never names a group unless no other id is in it; it gets the group's id. Empty tables give empty results; other
    columns of docs, whatever their names, aren't read.
    """
    return _grouped(docs, id_col=id_col, text_col=text_col, shingle=shingle).select("id", "text_hash", "fp", "component_id")


def _grouped(docs: DataFrame, *, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """near_duplicates with one more column, root: the component itself, by its smallest fingerprint. Several components
    have one component_id if they share their smallest id, or hold null ids only."""
    text_batches(docs.sparkSession)
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    prints = materialise(fingerprints(docs.select(F.struct(F.col(id_col).cast("long").alias("id"), text_hash.alias("h")).alias("key"), F.col(text_col).alias("text")), shingle=shingle))
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("low")))
    joined = components(links(classes.select("fp")))
    named = classes.join(joined, classes.fp == joined.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(named.join(lowest, "root").select("fp", "component_id", "root"))
    return prints.join(named, "fp").select("id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs that stay: of each near-duplicate group the row with the smallest id.

    Rows without an id come after all others. If rows repeat that id, the one with the smallest hash of its text stays,
    and one of rows that have both in common. Groups of unrelated texts stay apart, whatever ids they share or lack.
    """
    groups = _grouped(docs, id_col=id_col, text_col=text_col)
    names = own_names(docs, "no_id", "own_id", "text_hash")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "text_hash"))
    best = groups.groupBy("root").agg(first.alias("m")).select(*(F.col(f"m.{c}").alias(n) for c, n in zip(("none", "id", "text_hash"), names, strict=True)))
    own = (F.col(f"`{id_col}`").isNull(), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)), F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    keyed = docs.withColumns(dict(zip(names, own, strict=True)))
    return keyed.join(best, names, "left_semi").dropDuplicates(names).drop(*names)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
