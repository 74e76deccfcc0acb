"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Where intermediate tables go on one machine if the session names no shared folder.
OWN_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints. Where none is set, a local one on one machine, and an error on a cluster, whose executors
    have no folder in common."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (found or OWN_FOLDER).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What Spark's setting for bytes in an Arrow batch is by default, and what texts and pages go to Python in.
_DEFAULT_BATCH, TEXT_BATCH = 64 << 20, 4 << 20


def text_batches(spark: SparkSession) -> None:
    """From now on tables of texts go to Python in batches of TEXT_BATCH bytes in this session, unless it has a size of its
    own: with the default, each task holds 64 MB several times over in both processes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, f"{_DEFAULT_BATCH}b") == f"{_DEFAULT_BATCH}b":
        spark.conf.set(key, f"{TEXT_BATCH}b")


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns to add to df: those wanted, lengthened until no column of df has one, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system, so that what one stage took doesn't stay with the worker during the next."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(fn):
    """fn, a function of one table or of two, after which freed memory is returned."""

    def one(table):
        try:
            return fn(table)
        finally:
            give_back()

    def two(table, other):
        try:
            return fn(table, other)
        finally:
            give_back()

    return one if fn.__code__.co_argcount == 1 else two


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the n + 1 offsets of its rows in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of every row."""
    inside = ~_SPACE[raw]
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before &= ~breaks[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after &= ~breaks[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_RATE = np.uint64(0x9E3779B97F4A7C15 | 5)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(rate: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """rate ** i and its inverse, modulo 2 ** 64, for i below n at least."""
    have = _powers.get(rate)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(rate, -1, 1 << 64)
        both = []
        for r in (rate, inverse):
            a = np.full(size, r, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _powers[rate] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes, by differences of one running polynomial."""
    up, down = powers(int(_RATE), len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, rate: int) -> np.ndarray:
    """The hash of every run of `width` words, by the word it starts at."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(rate, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    n = len(words) - width + 1
    return mix64((total[width:] - total[:n]) * down[:n])


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches in the order of key, as one table for each key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
