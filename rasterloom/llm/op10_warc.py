"""WARC archives: writing captures as records, and reading records back as captures."""

from __future__ import annotations

import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.components import components
from rasterloom.llm.common import materialise, shared_folder, text_batches

#: A volume is closed when it holds so many bytes; one larger record has a volume of its own.
VOLUME_BYTES = 32_000_000
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
# Names of the WARC 1.1 format.
_VERSION = "WARC/1.1"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
#: How volumes written here name themselves; in them, and in no others, URIs are percent-encoded once more.
_SOFTWARE = "rasterloom"
_MAIN = ("response", "revisit")


def _record(kind: str, name: str, headers: list[tuple[str, str]], body: bytes, media: str, date: str) -> bytes:
    """One record, as a gzip member of its own, so that a reader can begin at any record."""
    lines = [_VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers), f"Content-Type: {media}", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + _END + body + _END, 6, mtime=0)


def _fields(facts: dict) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in facts.items()).encode()


def _header(value: str) -> str:
    """A header's value: percent-encoded where a byte would end or blur it."""
    return "".join(c if c > " " and c not in "%<>\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _plain(value: str) -> str:
    """What _header was given."""
    return urllib.parse.unquote(value, errors="strict")


def _named(digest: str) -> str:
    """The identifier of a record that others refer to, which follows from its page's id and payload."""
    return f"urn:uuid:{uuid.UUID(digest)}"


def _volumes(date: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        new = lambda: f"urn:uuid:{uuid.uuid4()}"

        def out() -> pa.RecordBatch:
            about = _record("warcinfo", new(), [], _fields({"software": _SOFTWARE, "format": "WARC File Format 1.1"}), "application/warc-fields", date)
            return pa.RecordBatch.from_arrays([pa.array([b"".join([about, *held])], pa.binary())], ["value"])

        for batch in batches:
            for page_id, url, page, first, sole, name, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target, page = "urn:none:" if url is None else _header(url), (page or "").encode()
                own, host = new(), target.split("/")[2] if target.count("/") > 1 else ""
                payload = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
                facts = {"page-id": "" if page_id is None else page_id, "payload-bytes": len(page), "has-url": int(url is not None)}
                if first is None or first == page_id:
                    own = _named(name) if sole else own
                    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page)}".encode() + _END + page
                    held.append(_record("response", own, payload, body, "application/http;msgtype=response", date))
                else:
                    # where several rows are that page, no single record is meant, and the metadata alone names the page
                    refers = [("WARC-Refers-To", f"<{_named(name)}>")] if sole else []
                    facts["refers-to-page"] = first
                    held.append(_record("revisit", own, [*payload, ("WARC-Profile", _REVISIT_PROFILE), *refers], b"HTTP/1.1 200 OK" + _END, "application/http;msgtype=response", date))
                with_capture = [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{own}>")]
                held.append(_record("request", new(), with_capture, f"GET {target} HTTP/1.1\r\nHost: {host}".encode() + _END, "application/http;msgtype=request", date))
                held.append(_record("metadata", new(), with_capture, _fields(facts), "application/warc-fields", date))
                size += sum(map(len, held[-3:]))
                if size >= VOLUME_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return fn


def write(pages: DataFrame, path: str, *, id_col="page_id", url_col="url", html_col="html", date: str = "2020-01-01T00:00:00Z") -> None:
    """Write a request, a response or revisit, and a metadata record for every row of pages into WARC volumes in the folder
    `path`, through Spark's own text writer, so any file system that Spark writes will do. A volume begins with a warcinfo record, and
    each record is a gzip member of its own; the writer ends a volume by one zero byte, which gzip readers take as padding.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least LEAST_REVISIT bytes, those with the
    smallest id are responses and the others revisits of that id; shorter ones and those without an id are all responses. A revisit
    refers to its response by record id. If several rows have that smallest id, it refers to none, and its metadata to the page.
    Ids of equal payloads meet as digests, the smallest first within each task, so a payload that a third of all pages share costs
    no more than any other. The html itself moves once, dealt by row.
    """
    text_batches(pages.sparkSession)
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    digest = F.sha2(page, 256)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), page.alias("html"), digest.alias("digest"))
    marked = rows.select("page_id", "digest").where((F.octet_length("html") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = marked.groupBy("digest").agg(F.min(F.struct("page_id", "n")).alias("m"), F.max("page_id").alias("last")).where("m.page_id <> last")
    first = first.select("digest", F.col("m.page_id").alias("first"), (F.col("m.n") == 1).alias("sole"), F.md5(F.concat_ws("|", "m.page_id", "digest").cast("binary")).alias("name"))
    # (id, digest) of responses that are referred to and of revisits: the pages join them by id too, which spreads the copies of one payload
    roles = marked.join(first, "digest").select("page_id", "digest", "first", "sole", "name")
    joined = rows.join(roles, ["page_id", "digest"], "left").select("page_id", "url", "html", "first", "sole", "name", "digest")
    volumes = joined.mapInArrow(_volumes(date), "value binary").select(F.col("value").cast("string"))  # the bytes as they are
    volumes.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").mode("overwrite").text(path)


_CAPTURE = "no long, record_id string, concurrent_to array<string>, kind string, target string, refers_to string, line string, facts map<string,string>, payload binary, payload_bytes long, payload_digest string"


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case, all values of each) and body of each record of an archive, read one after another."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.strip(b"\0"):
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record doesn't begin where the one before it ends")
        headers: dict[str, list[str]] = {}
        key = None
        while (line := stream.readline()).rstrip(b"\r\n"):
            text = line.decode(errors="replace").rstrip("\r\n")
            if text[0] in " \t" and key:  # a header goes on
                headers[key][-1] += " " + text.strip()
            else:
                key, _, value = text.partition(":")
                key = key.strip().lower()
                headers.setdefault(key, []).append(value.strip())
        size = int(headers["content-length"][0])
        body = stream.read(size)
        if len(body) != size or stream.readline().strip():
            raise ValueError("a WARC record's length is wrong")
        yield headers, body


def unchunked(body: bytes) -> bytes | None:
    """A body sent in chunks, as one; None if it isn't in chunks from its beginning to its end."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end > at else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


def entity(message: bytes) -> tuple[bytes, list[bytes]]:
    """The payload of an HTTP message, and the forms of it that a digest may have been taken of: as it stands, without chunks, and
    decompressed. Where a header names a coding that the body doesn't have, as many archives do, the body stays as it is."""
    head, found, body = message.partition(_END)
    if not found:
        return b"", [b""]
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]))
    forms = [body]
    if b"chunked" in fields.get(b"transfer-encoding", b"") and (whole := unchunked(body)) is not None:
        forms.append(whole)
    if (coding := fields.get(b"content-encoding")) in (b"gzip", b"x-gzip", b"deflate"):
        for bits in (47,) if coding != b"deflate" else (15, -15):
            try:
                forms.append(zlib.decompressobj(bits).decompress(forms[-1]))
                break
            except zlib.error:
                continue
    return forms[-1], forms


def _parse(keep_payload: bool):
    names = [f.split()[0] for f in _CAPTURE.split(", ")]
    types = [pa.int64(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 33
        for batch in batches:
            for content in batch.column(0):
                data = io.BytesIO(content.as_py())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=data)) if data.getvalue()[:2] == b"\x1f\x8b" else data  # all members, one after another
                rows, size, own = [], 0, False
                for headers, body in records(stream):
                    header = lambda k, headers=headers: headers.get(k, [""])[0]
                    kind, payload, digest, line, facts = header("warc-type").lower(), None, None, None, None
                    stated = header("warc-payload-digest")
                    if kind == "warcinfo":
                        own = f"software: {_SOFTWARE}\r\n".encode() in body
                    if kind == "response":
                        payload, forms = entity(body)
                        digest = hashlib.sha256(payload).hexdigest()
                        if stated.startswith("sha256:") and stated[7:].lower() not in {digest, *(hashlib.sha256(f).hexdigest() for f in forms[:-1])} and len(stated) == 71:
                            raise ValueError("a payload doesn't have its digest")
                    elif kind == "revisit":
                        digest = stated.removeprefix("sha256:") or None
                    elif kind == "metadata":
                        facts = [tuple(x.split(": ", 1)) for x in body.decode(errors="replace").split("\r\n") if ": " in x]
                        facts = list(dict(facts).items())
                    elif kind == "request":
                        line = body.split(b"\r\n", 1)[0].decode(errors="replace")
                    else:
                        continue
                    target = header("warc-target-uri")
                    target = _plain(target) if own else target[1:-1] if target[:1] + target[-1:] == "<>" else target
                    bare = lambda x: x.strip().removeprefix("<").removesuffix(">")
                    to = sorted({bare(x) for x in headers.get("warc-concurrent-to", []) if bare(x)})
                    rows.append((no, bare(header("warc-record-id")), to, kind, target, header("warc-refers-to") or None, line, facts, payload if keep_payload else None, None if payload is None else len(payload), digest))
                    no += 1
                    size += len(body) if keep_payload else 500
                    if len(rows) >= 1000 or size > 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return fn


def _captures(found: DataFrame) -> DataFrame:
    """record_id and capture_id of requests and metadata: the response or revisit that they name or that names them, or else one that
    a chain of concurrent records of any length leads to."""
    main, rest = found.where(F.col("kind").isin(*_MAIN)), found.where(~F.col("kind").isin(*_MAIN))
    links = found.select("record_id", F.explode("concurrent_to").alias("to"))
    ids = main.select(F.col("record_id").alias("capture_id"))
    named = links.join(ids, F.col("to") == F.col("capture_id")).select("record_id", "capture_id")
    naming = links.join(ids, F.col("record_id") == F.col("capture_id")).select(F.col("to").alias("record_id"), "capture_id")
    direct = named.union(naming).distinct()
    lost = rest.select("record_id").join(direct, "record_id", "left_anti")
    if lost.isEmpty():
        return direct
    numbers = found.groupBy("record_id").agg(F.min("no").alias("no"), F.max(F.col("kind").isin(*_MAIN)).alias("main"))
    edges = links.join(numbers.select("record_id", F.col("no").alias("a")), "record_id").join(numbers.select(F.col("record_id").alias("to"), F.col("no").alias("b")), "to").select("a", "b")
    group = components(edges).withColumnsRenamed({"node": "no", "component": "group"})
    placed = materialise(numbers.join(group, "no", "left").select("record_id", "main", F.coalesce("group", "no").alias("group")))
    heads = placed.where("main").groupBy("group").agg(F.min("record_id").alias("capture_id"))
    return direct.union(placed.join(lost, "record_id", "left_semi").join(heads, "group").select("record_id", "capture_id"))


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One nested row for each capture in the archives under `path`: capture_id, url, request, response and metadata.

    Archives may be plain, gzipped as a whole or record by record. Records are found by their stated lengths, one after another; lengths,
    and payload digests in hexadecimal SHA-256, are verified. Names of headers may be in any case. URIs are given as they stand, but for volumes of
    write(), whose encoding is undone. Payloads are given without chunks and decompressed, where they are in gzip or deflate. A volume is one
    value of the binary reader, 2 GB at most, and read by one task; those written here have VOLUME_BYTES or one record.

    Requests and metadata belong to the response or revisit that one of their WARC-Concurrent-To lines names, or whose own lines name them; these
    are joins by identifiers, which few records share. Those for which that fails are sought through chains of concurrent records, and belong to
    the first response of such a chain by identifier. A capture without a request or metadata has nulls there; records that lead to no capture of the
    archives, and all of other types (resource, conversion, continuation), are left out. An empty folder gives an empty table.
    """
    # lines are never split: a volume is one value of the binary reader
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("content")
    found = materialise(files.mapInArrow(_parse(False), _CAPTURE).drop("payload"))
    main = F.col("kind").isin(*_MAIN)
    rest = found.where(~main).join(_captures(found.select("no", "record_id", "concurrent_to", "kind")), "record_id").select("capture_id", "record_id", "kind", "line", "facts")
    whole = files.mapInArrow(_parse(True), _CAPTURE) if payloads else found.withColumn("payload", F.lit(None).cast("binary"))
    responses = whole.where(main).select(F.col("record_id").alias("capture_id"), F.struct("kind", "target", "refers_to", "payload", "payload_bytes", "payload_digest").alias("response"))
    asked = F.max(F.when(F.col("kind") == "request", F.struct("record_id", "line")))
    fact = lambda k: F.element_at("facts", k)
    facts = F.max(F.when(F.col("kind") == "metadata", F.struct("record_id", fact("page-id").alias("page_id"), fact("payload-bytes").alias("payload_bytes"), fact("has-url").alias("has_url"), fact("refers-to-page").alias("refers_to_page"))))
    beside = rest.groupBy("capture_id").agg(asked.alias("request"), facts.alias("metadata"))
    grouped = responses.groupBy("capture_id").agg(F.max("response").alias("response")).join(beside, "capture_id", "left")
    return grouped.select("capture_id", F.when(F.coalesce(F.col("metadata.has_url"), F.lit("1")) != "0", F.col("response.target")).alias("url"), "request", "response", "metadata")


def op10_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = read(spark, path, payloads=False).select(
        "capture_id", F.when(F.col("metadata.page_id") != "", F.col("metadata.page_id").cast("long")).alias("page_id"), F.coalesce("response.payload_bytes", F.col("metadata.payload_bytes").cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.regexp_extract("response.refers_to", "<(.*)>", 1).alias("refers"), F.col("metadata.refers_to_page").cast("long").alias("page"),
    )
    # the record that a revisit refers to, by its identifier
    meant = found.where("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("meant"))
    return found.join(meant, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.coalesce("meant", "page")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
