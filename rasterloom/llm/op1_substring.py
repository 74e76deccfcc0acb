"""Removal of passages that repeat word for word, found by fixed-block anchors."""

from __future__ import annotations

import pickle
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.llm.common import partitions, slices, string_bytes, tidy, window_hashes, word_bounds, word_hashes

#: Words of text hashed at once within a task, in bytes.
AT_ONCE = 500_000
#: Bytes of text in a chunk, at least and at most. Chunks grow with the root of all text up to the most, since a row travels for each
#: chunk and bucket that have anything in common: so rows stay few and full, and a task's memory is bounded by the most.
LEAST_CHUNK, MOST_CHUNK = 4_000_000, 128_000_000
#: Odd rates of the running polynomials over words.
_RATES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def sizes(total: int, partitions: int) -> tuple[int, int]:
    """How many chunks of documents and buckets of hashes: by bytes of text, but enough for all partitions where there is
    little text."""
    chunk = min(MOST_CHUNK, max(LEAST_CHUNK, int((4000 * total) ** 0.5)))
    chunks, buckets = -(-total // chunk), -(-total // (2 * chunk))
    return max(1, chunks, min(partitions, total >> 18)), max(1, buckets, min(partitions, total >> 18))


def _pack(a: np.ndarray) -> bytes:
    """Sorted whole numbers, byte plane by byte plane, compressed."""
    planes = np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


class _Chunk:
    """The words of the documents of one chunk, in a fixed order of rows."""

    def __init__(self, table: pa.Table):
        order = table.select(["kd", "kh"]).append_column("at", pa.array(np.arange(table.num_rows)))
        self.table = table.take(order.sort_by([("kd", "ascending"), ("kh", "ascending")]).column("at"))
        hashes, counts = [], []
        text = self.table.column("text").combine_chunks()
        raw, offsets = string_bytes(text if isinstance(text, pa.Array) else pa.array([], pa.string()))
        for a, b in slices(offsets, AT_ONCE):
            part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, n = word_bounds(part, own)
            hashes.append(word_hashes(part, starts, ends))
            counts.append(n)
        self.words = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        self.counts = np.concatenate(counts or [np.zeros(0, np.int64)])
        self.first = np.cumsum(self.counts) - self.counts

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every word, its number in its document and the words from it to the document's end."""
        n = np.repeat(self.counts, self.counts)
        at = np.arange(len(self.words)) - np.repeat(self.first, self.counts)
        return at, n - at


def _in_buckets(value: np.ndarray, buckets: int, *more: np.ndarray):
    """value's rows by bucket and value: order, sorted bucket numbers, and the places where each present bucket begins."""
    bucket = (value >> np.uint64(40)) % np.uint64(buckets)
    order = np.lexsort((*more, value, bucket))
    sorted_buckets = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order, sorted_buckets, cuts


_SENT = "bucket long, chunk long, kind int, own binary, low binary"
_FIELDS = ["bucket", "chunk", "kind", "own", "low"]


def _sent(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_FIELDS)


def _blocks(chunk: _Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every run of width words inside a document, where it starts, and whether it is a reference block."""
    at, left = chunk.place()
    all_hashes = window_hashes(chunk.words, width, _RATES[0])
    inside = np.flatnonzero(left[: len(all_hashes)] >= width)
    return all_hashes[inside], inside, at[inside] % width == 0, at


def _anchors(width: int, buckets: int):
    """For each chunk and bucket: the reference blocks' hashes, and those of all other runs that no block of the chunk has."""

    def fn(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        chunk = _Chunk(table)
        hashes, _, is_block, _ = _blocks(chunk, width)
        rows: dict[int, list] = {}
        low = np.uint64(0xFFFFFFFF)
        for kind, some in ((0, hashes[is_block]), (1, hashes[~is_block])):
            some = np.unique(some)
            order, bucket, cuts = _in_buckets(some, buckets)
            some = (some[order] & low).astype(np.uint32)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(some)], strict=False):
                rows.setdefault(int(bucket[a]), [None, None])[kind] = _pack(np.unique(some[a:b]))
        return _sent([(b, number, 0, own, other) for b, (own, other) in rows.items()])

    return fn


def _met(table: pa.Table) -> pa.Table:
    """Of each chunk's reference blocks in this bucket: whether another chunk has that hash at all."""
    chunks = table.column("chunk").to_numpy()
    own = [(_unpack(x, np.uint32) if x is not None else np.zeros(0, np.uint32)) for x in table.column("own").to_pylist()]
    known, times = np.unique(np.concatenate(own), return_counts=True)
    seen = times > 1
    for x, mine in zip(table.column("low"), own, strict=True):
        if not len(known) or not x.is_valid:
            continue
        probe = np.setdiff1d(_unpack(x.as_py(), np.uint32), mine, assume_unique=True)  # its own blocks are flagged in the chunk itself
        at = np.minimum(np.searchsorted(known, probe), len(known) - 1)
        seen[at[known[at] == probe]] = True
    bucket = table.column("bucket")[0].as_py()
    bits = [seen[np.searchsorted(known, x)] for x in own]
    return _sent([(bucket, int(c), 0, np.packbits(x).tobytes(), None) for c, x in zip(chunks, bits, strict=True) if x.any()])


def _candidates(chunk: _Chunk, width: int, least: int, buckets: int, flags: dict[int, bytes]):
    """Starts, hashes and second hashes of the runs of `least` words that hold a reference block found elsewhere too."""
    hashes, starts, is_block, at = _blocks(chunk, width)
    blocks, where = hashes[is_block], starts[is_block]
    bucket = ((blocks >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    low = (blocks & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    found = np.zeros(len(blocks), bool)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):
        mine = order[a:b]
        known = np.unique(low[mine])
        bits = flags.get(int(bucket[mine[0]]))
        if bits is not None:
            seen = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(known)).astype(bool)
            found[mine] = seen[np.searchsorted(known, low[mine])]
    # what the chunk itself repeats is known without the others
    values, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
    found |= times[back][is_block] > 1
    reach = np.zeros(len(chunk.words) + 1, np.int64)
    place = where[found]
    np.add.at(reach, np.maximum(place - (least - width), place - at[place]), 1)
    np.add.at(reach, place + 1, -1)
    _, left = chunk.place()
    one = window_hashes(chunk.words, least, _RATES[1])
    starts = np.flatnonzero((np.cumsum(reach[:-1]) > 0)[: len(one)] & (left[: len(one)] >= least))
    return starts, one[starts], (window_hashes(chunk.words, least, _RATES[2])[starts] >> np.uint64(32)).astype(np.uint32)


def _distinct(one: np.ndarray, two: np.ndarray, buckets: int):
    """The different windows, by bucket: values, second values, where buckets begin, times each occurs, and of each window its place."""
    order, bucket, cuts = _in_buckets(one, buckets, two)
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    place = np.empty(len(a), np.int64)
    place[order] = group
    keep = np.flatnonzero(new)
    bucket = bucket[keep]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keep) else np.zeros(0, np.int64)
    return a[keep], b[keep], bucket, cuts, np.bincount(group, minlength=len(keep)), place


def _flags(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: own for b, k, own in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("own").to_pylist(), strict=True) if k == kind}


def _extended(width: int, least: int, buckets: int):
    """For each chunk and bucket: the windows around hits. The chunk's flags travel along under a bucket of their own."""

    def fn(table: pa.Table, met: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent([])
        number = table.column("chunk")[0].as_py()
        flags = _flags(met, 0)
        _, one, two = _candidates(_Chunk(table), width, least, buckets, flags)
        a, b, bucket, cuts, _, _ = _distinct(one, two, buckets)
        rows = [(-1 - number, number, 0, pickle.dumps(flags), None)]
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=False):
            rows.append((int(bucket[s]), number, 1, _pack(a[s:e]), b[s:e].tobytes()))
        return _sent(rows)

    return fn


def _confirmed(table: pa.Table) -> pa.Table:
    """Of each chunk's windows in this bucket: whether another chunk has the same."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    one = [_unpack(x, np.uint64) for x in table.column("own").to_pylist()]
    two = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
    a, b = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((b, a))
    same = np.zeros(len(a) + 1, bool)
    same[1:-1] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    seen = np.empty(len(a), bool)
    seen[order] = same[1:] | same[:-1]
    ends = np.cumsum([len(x) for x in one])
    bucket = table.column("bucket")[0].as_py()
    bits = [seen[e - len(x) : e] for x, e in zip(one, ends.tolist(), strict=True)]
    return _sent([(bucket, c, 1, np.packbits(x).tobytes(), None) for c, x in zip(table.column("chunk").to_pylist(), bits, strict=True) if x.any()])


def _cut(width: int, least: int, buckets: int, schema: pa.Schema, carried: int, as_it_was: bool):
    """The documents without the words of confirmed windows."""

    def fn(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        chunk = _Chunk(table)
        starts, one, two = _candidates(chunk, width, least, buckets, next((pickle.loads(x) for x in _flags(answers, 0).values()), {}))
        a, _, bucket, cuts, times, place = _distinct(one, two, buckets)
        seen, yes = times > 1, _flags(answers, 1)
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=False):
            if (bits := yes.get(int(bucket[s]))) is not None:
                seen[s:e] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool)
        cover = np.zeros(len(chunk.words) + 1, np.int64)
        hit = starts[seen[place]]
        cover[hit] += 1
        np.add.at(cover, hit + least, -1)
        keep = np.cumsum(cover[:-1]) == 0
        texts, removed = [], []
        for text, first, n in zip(chunk.table.column("text"), chunk.first.tolist(), chunk.counts.tolist(), strict=True):
            mine = keep[first : first + n]
            gone = n - int(mine.sum())
            removed.append(gone)
            if as_it_was and not gone:
                texts.append(text.as_py())
                continue
            words = (text.as_py() or "").encode().split()
            texts.append(b" ".join(compress(words, mine.tolist()) if gone else words).decode())
        t = chunk.table
        return pa.Table.from_arrays([t.column("kd"), t.column("no_id"), t.column("kh"), pa.array(chunk.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), *t.columns[5 : 5 + carried]], schema=schema)

    return fn


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", least: int = 35, carry=(), as_it_was: bool = False) -> DataFrame:
    """id, text_hash, n_words, n_removed, kept (the words left, joined by one space) and the columns named in carry of
    every row of docs. as_it_was: a text that loses nothing keeps its white space.

    A word goes if a window of `least` words that covers it starts at another place too, in the same or another
    document; windows are judged on the input. Every such window holds a whole block of (least + 1) // 2 words that
    starts at a multiple of that length. So:

    1. Documents are dealt into chunks by a hash, as many as the bytes of all texts ask for. Each chunk sends the hashes of its blocks, and those of its rolling
       windows of a block's length, to hash buckets; each different hash goes once from a chunk.
    2. A bucket answers each chunk with one bit a block: found at another place or not.
    3. Around the blocks found, chunks send 96-bit hashes of the windows of `least` words (the hits extended to both
       sides) to buckets, which answer whether another chunk has them. The union of those windows are the maximal repeats.
    4. Each chunk removes the words.

    What comes back is in the order of what was sent, so no positions travel. A passage in a third of all documents
    costs one hash a chunk, not a row for each occurrence or pair. Windows equal in 96 bits are taken as equal.

    Null and empty texts have no words. Rows that repeat an id, or rows alike in all, are places of their own. Texts
    shorter than `least` words lose nothing. Empty tables give empty results; other columns aren't read.
    """
    spark = docs.sparkSession
    width = (least + 1) // 2
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    chunks, buckets = sizes(total, partitions(spark))
    kd, kh = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(
        kd.alias("kd"), F.col(id_col).isNull().alias("no_id"), kh.alias("kh"), F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(kd, kh), F.lit(chunks)).alias("chunk"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)),
    )
    sent = rows.groupBy("chunk").applyInArrow(tidy(_anchors(width, buckets)), _SENT)
    met = sent.groupBy("bucket").applyInArrow(tidy(_met), _SENT)
    windows = rows.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(tidy(_extended(width, least, buckets)), _SENT)
    answers = windows.groupBy("bucket").applyInArrow(tidy(_confirmed), _SENT)
    base = [("id", T.LongType()), ("no_id", T.BooleanType()), ("text_hash", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())]
    result = T.StructType([T.StructField(n, t) for n, t in base] + [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)])
    schema = to_arrow_schema(result)
    cut = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(_cut(width, least, buckets, schema, len(carry), as_it_was)), result)
    found = [F.when(~F.col("no_id"), F.col("id")).alias("id"), "text_hash", "n_words", "n_removed", "kept"]
    return cut.select(*found, *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(ws[i:i + 34], ' '))) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
