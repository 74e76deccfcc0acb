"""Token ids in compressed binary files: writing them in order of documents, and reading them back."""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm import rangecoder
from rasterloom.llm.common import give_back, partitions, shared_folder, slices, string_bytes, text_batches
from rasterloom.llm.op2_bpe import tokenizer

#: A frame is closed when it holds so many ids or its texts so many bytes; one longer document has a frame of its own.
FRAME_IDS, FRAME_BYTES = 8_000_000, 32_000_000
#: Bytes of text whose distinct words are encoded together.
TEXT_BYTES = 16_000_000
#: A frame's blocks hold this many ids, fewer in small frames so that enough of them are coded side by side.
LONGEST, SHORTEST, ABREAST = 2048, 256, 2048
#: A worker keeps the ids of words that it has encoded, until they are so many or have so many bytes; then it begins anew.
KNOWN_WORDS, KNOWN_BYTES = 2_000_000, 32_000_000
_MAGIC = b"RLT2"
# White space other than blanks and line feeds, as a class of code points.
_OTHER_SPACE = r"\x{9}\x{b}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Other white space, or blanks and line feeds next to one another or at an end: such texts are encoded whole.
_UNEVEN = rf"[{_OTHER_SPACE}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Distinct words encoded in one string.
_TOGETHER = 4096


@functools.cache
def _begins(path: str) -> np.ndarray:
    """Of each id, whether its piece begins with a blank or line feed, as byte-level vocabularies write them."""
    t = tokenizer(path)
    return np.array([(t.id_to_token(i) or "")[:1] in ("Ġ", "Ċ") for i in range(max(t.get_vocab(True).values()) + 1)])


class _Known:
    """The ids of words, each with the blank or line feed before it, as this worker has encoded them so far."""

    def __init__(self, path: str):
        self.path = path
        self.words, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words: all different. All ids known, and of each word where its own begin in them and how many they are."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        if len(self.words) + len(new) > KNOWN_WORDS or self.words.nbytes + new.nbytes > KNOWN_BYTES:
            self.__init__(self.path)
            at, new = pa.nulls(len(words), pa.int32()), words
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        ids, sizes = [self.ids], [self.sizes]
        begins = _begins(self.path)
        for a in range(0, len(new), _TOGETHER):
            some = new.slice(a, _TOGETHER).to_pylist()
            text = "".join([w if w[:1] == "\n" else f" {w}" for w in some])
            x = np.array(tokenizer(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(begins[x])
            if len(cuts) != len(some) or cuts[0]:
                raise ValueError("this tokenizer file doesn't keep blanks at the beginning of words")
            ids.append(x)
            sizes.append(np.diff([*cuts, len(x)]))
        self.words = pa.concat_arrays([self.words, new])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        return self.ids, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]


_known = functools.lru_cache(1)(_Known)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and how many each has; as the tokenizer encodes whole texts without adding
    special tokens. Null is empty.

    Byte-level vocabularies that split before each blank and line feed between words allow a text to be encoded word by
    word. So texts' distinct words that this worker hasn't met before, each with the blank or line feed before it, are
    encoded in long strings; the pieces that begin with a blank or line feed show where the words begin. A text's first word
    has nothing before it and is encoded alone, and texts with other white space are encoded whole.
    """
    t = tokenizer(path)

    def encoded(some: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for at in range(0, len(some), 2000) for e in t.encode_batch_fast(some[at : at + 2000], add_special_tokens=False)]

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False).astype(bool)
    even = ~whole & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    parts = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(even)), "\n", " \n"), " ")
    ends = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    table = parts.flatten().dictionary_encode()
    run, words = table.indices.to_numpy(zero_copy_only=False).astype(np.int64), table.dictionary
    flat, first, size = _known(path).look_up(words)
    heads, back = np.unique(run[ends[:-1]], return_inverse=True)
    run[ends[:-1]] = len(words) + back
    alone = encoded(words.take(pa.array(heads)).to_pylist()) + encoded(texts.filter(pa.array(whole)).to_pylist())
    own_size = np.array([len(x) for x in alone], np.int64)
    first = np.concatenate([first, len(flat) + np.cumsum(own_size) - own_size])
    flat, size = np.concatenate([flat, *alone]).astype(np.int32), np.concatenate([size, own_size])

    # texts as numbers of words: those cut into words, and those that stand for themselves
    count = whole.astype(np.int64)
    count[even] = np.diff(ends)
    bounds = np.concatenate([[0], np.cumsum(count)])
    every = np.empty(bounds[-1], np.int64)
    own = np.zeros(len(every), bool)
    own[bounds[:-1][whole]] = True
    every[~own] = run
    every[own] = len(words) + len(heads) + np.arange(whole.sum())
    stops = np.concatenate([[0], np.cumsum(size[every])])
    kind = np.int32 if max(stops[-1], len(flat)) < 2**31 else np.int64
    out = flat[np.arange(stops[-1], dtype=kind) + np.repeat((first[every] - stops[:-1]).astype(kind), size[every])]
    return out, np.diff(stops[bounds])


def frame_of(doc_ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Magic, header (checksummed and deflated: ids of documents, which of them are missing, lengths, block sizes, frequencies of
    ids), blocks."""
    length = int(np.clip(-(-len(ids) // ABREAST), SHORTEST, LONGEST))
    known = rangecoder.Frame.of(ids)
    blocks = rangecoder.encode(ids, length, known)
    head = np.concatenate([np.array([len(doc_ids), len(blocks)], "<i8"), doc_ids.astype("<i8"), missing.astype("<i8"), lengths.astype("<i8"), np.array([len(b) for b in blocks], "<i8")]).tobytes()
    packed = zlib.compress(head + known.to_bytes(), 6)
    return b"".join([_MAGIC, len(packed).to_bytes(8, "little"), zlib.crc32(packed).to_bytes(4, "little"), packed, *blocks])


def parts_of(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids, which are missing, lengths, and all ids of a frame; ValueError where a checksum is wrong."""
    n = int.from_bytes(frame[4:12], "little")
    packed = frame[16 : 16 + n]
    if frame[:4] != _MAGIC or zlib.crc32(packed).to_bytes(4, "little") != frame[12:16]:
        raise ValueError("not a frame of token ids, or a damaged one")
    data = zlib.decompress(packed)
    docs, blocks = np.frombuffer(data, "<i8", 2).tolist()
    head = np.frombuffer(data, "<i8", 3 * docs + blocks, 16)
    known = rangecoder.Frame.from_bytes(data[16 + head.nbytes :])
    doc_ids, missing, lengths, sizes = np.split(head, np.cumsum([docs, docs, docs]))
    ends = 16 + n + np.cumsum(sizes)
    if len(sizes) != blocks or len(frame) != (ends[-1] if blocks else 16 + n):
        raise ValueError("a frame of token ids has a wrong length")
    ids = rangecoder.decode([frame[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], known)
    return doc_ids, missing, lengths, ids


def _frames(path: str, end_id: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, frame = TaskContext.get().partitionId(), 0
        waiting: list[tuple] = []  # rows whose texts are still to be encoded
        held: list[tuple] = []
        unread = size = total = 0

        def encode() -> int:
            docs, missing = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            ids, lengths = token_ids(pa.concat_arrays([w[2] for w in waiting]), path)
            held.append((docs, missing, np.insert(ids, np.cumsum(lengths), end_id), lengths + 1))
            waiting.clear()
            give_back()
            return len(held[-1][2])

        def out() -> pa.RecordBatch:
            docs, missing, ids, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            data = frame_of(docs, missing, lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((shard, pa.int32()), (frame, pa.int32()), (len(docs), pa.int64()), (int(lengths.sum()), pa.int64()), (data, pa.binary()))], ["shard", "frame", "docs", "tokens", "data"])

        for batch in batches:
            texts = batch.column(2).cast(pa.large_string())
            _, offsets = string_bytes(texts)
            for a, b in slices(offsets, TEXT_BYTES):
                some = batch.slice(a, b - a)
                waiting.append((some.column(0).to_numpy(), some.column(1).to_numpy(zero_copy_only=False).astype(np.int64), texts.slice(a, b - a)))
                unread += int(offsets[b] - offsets[a])
                if unread >= TEXT_BYTES:
                    size, total, unread = size + encode(), total + unread, 0
                if size >= FRAME_IDS or total >= FRAME_BYTES:
                    yield out()
                    size, total, frame = 0, 0, frame + 1
        if waiting:
            encode()
        if held:
            yield out()

    return fn


def write(docs: DataFrame, path: str, tokenizer_file: str, *, id_col="doc_id", text_col="text", end_id: int = 0) -> None:
    """Encode every row's whole text, add end_id, and write the ids in ascending order of id_col into the folder `path`.

    Rows are dealt by range of id, so files follow one another in that order; a task writes frames of whole documents,
    which it takes in batches. A frame is one binary value of a Parquet file, since that is what Spark writes to any file system
    from all executors. In a frame the ids are cut into blocks that are coded and checksummed each by itself.

    Null ids come first. Rows that repeat an id stand next to one another in the order of a hash of their texts. Null and
    empty texts have the end id alone. An empty table leaves a readable folder without frames. Other columns aren't read.
    """
    text_batches(docs.sparkSession)
    h = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("missing"), F.col(text_col).cast("string").alias("text"), h.alias("h"))
    first = F.col("missing").desc()
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), first, "id", "h").sortWithinPartitions(first, "id", "h").select("id", "missing", "text")
    ordered.mapInArrow(_frames(tokenizer_file, end_id), "shard int, frame int, docs long, tokens long, data binary").write.parquet(path)


def _documents(with_ids: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, frame, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs, missing, lengths, ids = parts_of(data)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(docs)
                columns = [pa.array(np.full(n, shard), pa.int32()), pa.array(np.full(n, frame), pa.int32()), pa.array(docs, pa.int64(), mask=missing.astype(bool)), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                names = ["shard", "frame", "id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                out = pa.RecordBatch.from_arrays(columns, names)
                for at in range(0, n, 1000):
                    yield out.slice(at, 1000)

    return fn


def read(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """id, start (the ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document of
    the files. Checksums are verified; a damaged block fails the query."""
    frames = spark.read.parquet(path)
    sizes = frames.select("shard", "frame", "tokens")
    shards = sizes.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    earlier = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    shards = shards.select("shard", earlier.alias("base"))
    own = F.coalesce(F.sum("tokens").over(Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("shard", "frame", own.alias("own")).join(shards, "shard").select("shard", "frame", (F.col("own") + F.col("base")).alias("base"))
    kind = "shard int, frame int, id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    documents = frames.select("shard", "frame", "data").mapInArrow(_documents(ids), kind)
    return documents.join(places, ["shard", "frame"]).select("id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path, ids=False).withColumnRenamed("id", "doc_id")
