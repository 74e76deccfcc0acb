"""BPE encoding through a table of distinct words, and decoding through the table of pieces."""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm.common import give_back, partitions, slices, string_bytes, text_batches

#: Bytes of text whose words share one table of distinct words.
CHUNK_BYTES = 14_000_000
#: Words whose ids are put together at once.
AT_ONCE = 150_000
#: Groups of distinct words for each shuffle partition.
BUCKETS = 2


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores already
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def pieces(path: str) -> tuple[pa.Array, bool]:
    """The piece of every id, in the order of ids: as many as the vocabulary file has; and whether the file has a decoder."""
    t = tokenizer(path)
    return pa.array([t.id_to_token(i) for i in range(max(t.get_vocab(True).values()) + 1)], pa.string()), t.decoder is not None


def _released(fn):
    """fn, after which the worker doesn't keep the tokenizer."""

    def of(*tables: pa.Table) -> pa.Table:
        try:
            return fn(*tables)
        finally:
            tokenizer.cache_clear()
            give_back()

    return (lambda table: of(table)) if fn.__code__.co_argcount == 1 else (lambda table, other: of(table, other))


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbers(a: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32, by byte planes, compressed."""
    return _zip(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers_of(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_ROW = "chunk string, kind int, bucket long, at binary, data binary"
_SCHEMA = pa.schema([("chunk", pa.string()), ("kind", pa.int32()), ("bucket", pa.int64()), ("at", pa.binary()), ("data", pa.binary())])
#: Kinds of rows: distinct words of a chunk in one bucket, a chunk's documents as numbers of its distinct words, ids of words.
_WORDS, _TEXTS, _IDS = 0, 1, 2


def _rows(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)]


def _split(buckets: int, chunk_bytes: int):
    def chunk(ids: np.ndarray, none: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        table: defaultdict[bytes, int] = defaultdict(count().__next__)
        raw, offsets = string_bytes(texts)
        data, numbers, sizes = raw.tobytes(), [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = data[a:b].split()
            numbers.append(np.fromiter(map(table.__getitem__, words), np.uint32, len(words)))
            sizes.append(len(words))
        at = np.concatenate([*numbers, np.zeros(0, np.uint32)])
        words = list(table)
        # frequent words get small numbers
        by_use = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by_use] = np.arange(len(words), dtype=np.uint32)
        words = [words[i] for i in by_use.tolist()]
        head = _zip(ids.tobytes() + none.tobytes())
        name = hashlib.blake2b(data, key=hashlib.blake2b(head).digest(), digest_size=16).hexdigest()
        rows = [(name, _TEXTS, -1, head, _numbers(np.concatenate([np.array(sizes, np.uint32), rank[at]])))]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])).tolist() if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
            mine = order[a:b]
            rows.append((name, _WORDS, int(bucket[mine[0]]), _numbers(np.diff(mine, prepend=0)), _zip(b"\n".join(map(words.__getitem__, mine.tolist())))))
        return pa.RecordBatch.from_arrays(_rows(rows), schema=_SCHEMA)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            texts = pa.concat_arrays([t for _, _, t in held])
            return chunk(np.concatenate([i for i, _, _ in held]), np.concatenate([n for _, n, _ in held]), texts)

        for batch in batches:
            ids, none, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            _, offsets = string_bytes(texts)
            for a, b in slices(offsets, chunk_bytes):
                held.append((ids[a:b], none[a:b], texts[a:b].cast(pa.large_string())))
                size += int(offsets[b] - offsets[a])
                if size >= chunk_bytes:
                    yield out()
                    held, size = [], 0
                    give_back()
        if held:
            yield out()

    return fn


def _only_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In Python so that no filter moves below the exchange, which both readers of the chunks then share."""
    for batch in batches:
        yield batch.filter(pc.equal(batch.column("kind"), _WORDS))


def _encode(path: str):
    """Each different word of a bucket is encoded once; every chunk gets the ids of its words, in its order."""

    def fn(table: pa.Table) -> pa.Table:
        place: defaultdict[bytes, int] = defaultdict(count().__next__)
        lists = []
        for x in table.column("data"):
            words = _unzip(x.as_py()).split(b"\n")
            lists.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
        new, own = list(place), []
        place.clear()
        for a in range(0, len(new), 4_000):
            own += [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast([w.decode() for w in new[a : a + 4_000]], add_special_tokens=False)]
        size = np.fromiter(map(len, own), np.int64, len(own))
        every, first = np.concatenate([*own, np.zeros(0, np.uint32)]), np.cumsum(size) - size
        del new, own
        rows = []
        for chunk, bucket, at, words in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), table.column("at").to_pylist(), lists, strict=True):
            sizes = size[words]
            ends = np.cumsum(sizes)
            flat = every[np.arange(sizes.sum()) + np.repeat(first[words] - ends + sizes, sizes)]
            rows.append((chunk, _IDS, bucket, at, _numbers(np.concatenate([sizes.astype(np.uint32), flat]))))
        return pa.Table.from_arrays(_rows(rows), schema=_SCHEMA)

    return fn


def texts_of(ids: pa.ListArray, path: str) -> pa.Array:
    """The text of each list of ids: pieces are taken from the vocabulary by number."""
    known, has_decoder = pieces(path)
    if has_decoder:
        return pa.array([None if x is None else tokenizer(path).decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.string())
    found = known.take(ids.flatten())
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())])
    return pc.if_else(ids.is_valid(), pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), " "), None)


def _assemble(path: str, decoded: bool):
    """Each document's ids, from its words' numbers and their ids."""
    fields = [("id", pa.int64()), ("no_id", pa.bool_()), ("ids", pa.list_(pa.int32()))] + [("text", pa.string())] * decoded
    schema = pa.schema(fields)

    def fn(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [(np.cumsum(_numbers_of(at)), _numbers_of(data)) for at, data in zip(answers.column("at").to_pylist(), answers.column("data").to_pylist(), strict=True)]
        n = 1 + max((int(at[-1]) for at, _ in parts), default=-1)
        sizes, begins, flat, base = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        for at, data in parts:
            own = data[: len(at)]
            sizes[at] = own
            begins[at] = base + np.cumsum(own) - own
            flat.append(data[len(at) :].astype(np.int32))
            base += len(flat[-1])
        flat = np.concatenate([*flat, np.zeros(0, np.int32)])
        out = []
        for kind, head, data in zip(texts.column("kind").to_pylist(), texts.column("at").to_pylist(), texts.column("data").to_pylist(), strict=True):
            if kind != _TEXTS:
                continue
            head, data = _unzip(head), _numbers_of(data)
            docs = len(head) // 9
            ids, none = np.frombuffer(head[: 8 * docs], np.int64), np.frombuffer(head[8 * docs :], bool)
            words, at = np.concatenate([[0], np.cumsum(data[:docs])]), data[docs:]
            if len(at) and int(at.max()) >= n:
                raise RuntimeError("ids of some words are missing")
            for a, b in slices(words, AT_ONCE):
                own = at[words[a] : words[b]]
                ends = np.concatenate([[0], np.cumsum(sizes[own])])
                found = pa.array(flat[np.arange(ends[-1]) + np.repeat(begins[own] - ends[:-1], sizes[own])])
                lists = pa.ListArray.from_arrays(pa.array(ends[words[a : b + 1] - words[a]], pa.int32()), found)
                out.append(pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(none[a:b]), lists] + [texts_of(lists, path)] * decoded, schema=schema))
        return pa.Table.from_batches(out, schema)

    return fn


def encode(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text", decoded: bool = False, chunk_bytes: int | None = None) -> DataFrame:
    """id and ids (array<int>) of every row of docs, and if decoded the text that decode() gives of the ids, as the tokenizer file at `path` encodes its whole text without
    adding special tokens.

    Holds for tokenizers that drop white space and never join two words, so that a text's ids are those of its
    white-space words in turn; special tokens written in a text are found inside words just so. Tasks split texts,
    number each chunk's distinct words and send documents as those numbers; each distinct word is encoded once in its
    hash bucket, and its ids join the chunks' numbers again by position. A frequent word travels once a chunk. chunk_bytes:
    text of a chunk, if not CHUNK_BYTES; smaller chunks take less memory and send more words.

    The file is read on every executor at the same path. Null and empty texts have no ids. Repeated rows and ids stay
    rows of their own, null ids stay null; empty tables give empty results; other columns aren't read.
    """
    text_batches(docs.sparkSession)
    n = BUCKETS * partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).cast("string").alias("text"))
    chunks = rows.mapInArrow(_split(n, chunk_bytes or CHUNK_BYTES), _ROW).repartition("chunk")
    answers = chunks.mapInArrow(_only_words, _ROW).groupBy("bucket").applyInArrow(_released(_encode(path)), _ROW)
    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_released(_assemble(path, decoded)), "id long, no_id boolean, ids array<int>" + ", text string" * decoded)
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "ids", *["text"] * decoded)


def decode(path: str):
    """A column function: the text of an array of ids, special tokens included. Null gives null, no ids give ''.

    Ids join the pieces of the vocabulary by number, pieces are put together as the file's decoder says; without one
    they are joined by a space.
    """

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return texts_of(ids, path)

    return text


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the text they decode to."""
    path = word_file()
    found = encode(docs, path, decoded=True)
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
