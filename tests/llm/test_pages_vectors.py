"""Operators on pages and vectors against brute force, and on odd rows."""

import gzip
import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import op3_embeddings, op5_topk, op7_html, op10_warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p><p>no";</script></head><body>
<header>Site</header><nav><ul><li><a href=/>Home</a><li>More</ul></nav><div class="cookie-notice">Cookies!</div><!-- <p>gone</p> -->
<article class=post><h1>A &amp; B</h1><p>First <b>bold</b>&nbsp;text<br>next<p>Second &lt;tag&gt; &#233;<aside>Read on</aside><div class="ad-box"><p>Buy</p></div>
<form><input name=q>Search</form><section id="comments"><article>Nice!</article></section></article><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_blocks():
    texts, kinds = op7_html.blocks(PAGE)
    assert " ".join(t for t, k in zip(texts, kinds) if k == 2) == "A & B First bold text next Second <tag> é"
    assert op7_html.blocks("") == ([], []) and op7_html.blocks("plain  text")[0] == ["plain text"]
    assert op7_html.blocks("a < b and <p unfinished")[0] == ["a < b and"]
    layout = "<div class='has-sidebar no-ads'><div class='page-banner'>Sale<main>Text <span class='share-links'>Share</span></main></div></div>"
    assert [t for t, k in zip(*op7_html.blocks(layout)) if k == 2] == ["Text"]
    assert op7_html.blocks("<p>it's <b title='a>b'>x</b>")[0] == ["it's x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
def test_shared(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    kept = [x for x, f in zip(a, op7_html.shared(a, b)) if f]
    it = iter(b)
    assert len(kept) == table[-1, -1] and all(any(x == y for y in it) for x in kept)


def test_differencing(spark):
    """Without an article element, what the nearest page has too goes."""
    page = lambda body: f"<body><div>Menu</div><div>{body}</div><div>Imprint</div></body>"
    data = [(1, "http://h.org/a/1", page("one")), (2, "http://h.org/a/2", page("two")), (3, "http://h.org/z", "<div>Menu</div>"), (4, "http://solo.org/", page("four")), (5, None, None), (6, "http://c.org/1", page("same")), (7, "http://c.org/2", page("same"))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("k", "hashes", "kinds", "host", "path", "other")})
    found = {r.page_id: r.text for r in op7_html.main_text(pages).collect()}
    assert found == {1: "one", 2: "two", 3: "Menu", 4: "Menu four Imprint", 5: "", 6: "Menu same Imprint", 7: "Menu same Imprint"}


def test_differencing_beside_an_article(spark):
    """Unmarked blocks outside the article stay unless the nearest page has them too; a copy of the article tells nothing."""
    page = lambda head, body: f"<body><div>Menu</div><div>{head}</div><article><p>{body}</p><p>{body} more</p></article><nav>Nav {body}</nav><div>Imprint</div></body>"
    data = [(1, "http://h.org/a/1", page("Head one", "one")), (2, "http://h.org/a/2", page("Head two", "two")), (3, "http://c.org/1", page("Head", "same")), (4, "http://c.org/2", page("Head", "same")), (5, "http://solo.org/", page("Head five", "five"))]
    found = {r.page_id: r.text for r in op7_html.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    copy = "Menu Head same same more Imprint"
    assert found == {1: "Head one one one more", 2: "Head two two two more", 3: copy, 4: copy, 5: "Menu Head five five five more Imprint"}


def test_names_in_an_article():
    """Names that only hold a mark leave it to the neighbours; outside of articles, and where all words are marks or neutral, they don't."""
    page = "<article><p class='share-price'>a</p><p class='notice-of-motion'>b</p><div class='related-work'><p>c</div><section id=discussion><p>d</section><div class='ad-box'>e</div><div id='comments'>f</div><p>g</article><div class='share-price'>h</div>"
    assert op7_html.blocks(page) == (list("abcdefgh"), [1, 1, 1, 1, 0, 0, 2, 0])


def text_by_hand(data):
    """The whole query, page by page: data are (page_id, url, html) of different rows, each a page of its own."""
    parts = lambda u: ((m := re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)([^?#]*)", u or "")) and (m[1].lower(), m[2])) or ("", "")
    order = sorted(range(len(data)), key=lambda i: parts(data[i][1]))
    out = {}
    for at, i in enumerate(order):
        host, path = parts(data[i][1])
        texts, kinds = op7_html.blocks(data[i][2] or "")
        near = []
        for gap in (-2, -1, 1, 2):
            if 0 <= at + gap < len(order) and parts(data[order[at + gap]][1])[0] == host:
                near.append((-len(os.path.commonprefix([path, parts(data[order[at + gap]][1])[1]])), abs(gap), gap, order[at + gap]))
        votes, counted = [0] * len(texts), 0
        for *_, j in sorted(near)[:3]:
            common = op7_html.shared(list(map(hash, texts)), list(map(hash, op7_html.blocks(data[j][2] or "")[0])))
            article = [c for c, k in zip(common, kinds) if k == 2]
            if 2 * sum(article) <= len(article):
                counted, votes = counted + 1, [v + c for v, c in zip(votes, common)]
        kept = [t for t, k, v in zip(texts, kinds, votes) if k == 2 or k == 1 and not (counted and 2 * v >= counted)]
        out[data[i][0]] = " ".join(kept or [t for t, k in zip(texts, kinds) if k == 1])
    return out


@pytest.mark.parametrize("spread", [1, 9])
def test_whole_extraction(spark, monkeypatch, spread):
    """Pages of several hosts, on which differencing decides in and beside articles, against a plain version."""
    monkeypatch.setattr(op7_html, "partitions", lambda s: spread)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefg", k=6))
    data = []
    for host in ("a.org", "b.org", "B.org", "c.org"):
        menu, teaser, legal = ([word() for _ in range(n)] for n in (5, 3, 2))
        for i in range(rng.choice([1, 2, 14])):
            own = [word() for _ in range(4)] if i % 5 else ["copied"] * 4
            head = "".join(f"<div>{m}</div>" for m in (menu if i % 4 else menu[:2]))
            side = "".join(f"<div class='related-work'>{t}</div>" for t in (teaser if i % 3 else [word()]))
            tail = "".join(f"<span class='share-price'>{t}</span><br>" for t in rng.sample(legal, 1))
            body = f"<p>{own[0]}<p>{own[1]}{side}<p>{own[2]}{tail}<p>{own[3]}"
            data.append((len(data), f"http://{host}/{rng.choice(['x', 'y/z', ''])}/{len(data)}?q={i}", f"<body>{head}<article>{body}</article><div>{legal[0]}</div>" if i % 7 else f"<body>{head}<div>{own[0]}</div>"))
    data += [(len(data), None, None), (len(data) + 1, "no url", "<p>plain")]
    want = text_by_hand(data)
    found = {r.page_id: r.text for r in op7_html.main_text(spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)).collect()}
    assert found == want
    everything = {i: " ".join(t for t, k in zip(*op7_html.blocks(h or "")) if k) for i, _, h in data}
    assert sum(found[i] != everything[i] for i in found) > 10  # what differencing changes


def test_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a", PAGE)] * 3 + [(None, "http://h.org/b", PAGE)], "page_id long, url string, html string")
    assert [r.text for r in op7_html.main_text(pages).collect()] == ["A & B First bold text next Second <tag> é"] * 4
    assert op7_html.main_text(pages.limit(0)).count() == 0


def test_very_long_page(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", "".join(f"<p>line {j % 50} {i if j % 7 == 0 else ''}" for j in range(6000))) for i in range(2)], "page_id long, url string, html string")
    assert op7_html.main_text(pages).count() == 2


def test_warc(spark, tmp_path):
    long, short = "<p>" + "é%\r\n\r\nWARC/1.1\r\n" * 20, "<p>short"
    data = [(3, "http://a.org/x y", long), (1, "http://a.org/%20", long), (2, None, long), (4, "u", short), (5, "u", short), (6, "u\r\nWARC-Type: x", None), (None, "http://n.org", long), (1, "http://b.org", long), (7, "v", "x" * 200), (7, "v", "x" * 200), (8, "w", "y" * 99), (9, "w", "y" * 99)]
    data += [(i, f"http://m.org/{k}", "z" * 300) for i, k in ((21, 0), (20, 1), (22, 2))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("digest", "first", "kind", "target", "headers", "value")}).repartition(3)
    op10_warc.write(pages, f"file://{tmp_path}/w")
    found = op10_warc.read(spark, f"file://{tmp_path}/w").collect()
    number = lambda r: int(r.metadata.page_id) if r.metadata.page_id else None
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(((number(r), r.url, r.response.payload_digest) for r in found), key=repr) == sorted(((i, u, sha(t)) for i, u, t in data), key=repr)
    kinds = sorted(((number(r), r.response.kind, r.response.refers_to, r.metadata.refers_to_page) for r in found), key=repr)
    lead = [f"<{r.capture_id}>" for r in found if r.url == "http://m.org/1"]
    want = [(1, "response", None, None)] * 2 + [(2, "revisit", None, "1"), (3, "revisit", None, "1")] + [(i, "response", None, None) for i in (4, 5, 6, 7, 7, 8, 9, None, 20)] + [(i, "revisit", *lead, "20") for i in (21, 22)]
    assert len(lead) == 1 and kinds == sorted(want, key=repr)
    texts = {sha(t): (t or "").encode() for _, _, t in data}
    assert all(bytes(r.response.payload) == texts[r.response.payload_digest] for r in found if r.response.kind == "response")
    assert all(r.request.line.startswith("GET ") and int(r.metadata.payload_bytes) == len(texts[r.response.payload_digest]) for r in found)


@pytest.mark.parametrize("packed", ["plain", "whole", "records"])
def test_warc_of_others(spark, tmp_path, packed):
    """An archive as other tools write it: with warcinfo, other record types and headers that go on over lines."""
    def record(kind, name, body, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", *more, f"Content-Length: {len(body)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    all_records = [
        record("warcinfo", "0", b"software: other\r\n"), record("request", "1", b"GET /a HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:uuid:2>", "WARC-Target-URI: http://a/"),
        record("response", "2", http + b"<p>one", "WARC-Target-URI: http://a/", "X-Long: begins", "  and goes on", "WARC-Payload-Digest: sha1:ABC"), record("resource", "3", b"x", "WARC-Target-URI: http://r/"),
        record("response", "4", http, "WARC-Target-URI:http://b/"), record("revisit", "5", b"", "WARC-Target-URI: http://c/", "WARC-Refers-To: <urn:uuid:2>"),
    ]
    data = {"plain": b"".join(all_records), "whole": gzip.compress(b"".join(all_records)), "records": b"".join(map(gzip.compress, all_records))}[packed]
    (tmp_path / "crawl-1.warc.gz").write_bytes(data)
    found = {r.capture_id[-1]: r for r in op10_warc.read(spark, f"file://{tmp_path}").collect()}
    assert {k: (r.url, r.response.kind, r.response.payload and bytes(r.response.payload)) for k, r in found.items()} == {"2": ("http://a/", "response", b"<p>one"), "4": ("http://b/", "response", b""), "5": ("http://c/", "revisit", None)}
    assert found["2"].request.line == "GET /a HTTP/1.1" and found["4"].request is None and found["5"].response.refers_to == "<urn:uuid:2>"


def test_warc_by_crawlers(spark, tmp_path):
    """Chains of concurrent records, several of them in one record, names in any case, URIs as they stand, chunks and compression."""
    def record(kind, name, body, *more):
        head = ["WARC/1.0", f"warc-type: {kind}", f"Warc-Record-Id: <{name}>", *more, f"content-length: {len(body)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    http = lambda body, *lines: "\r\n".join(["HTTP/1.1 200 OK", *lines]).encode() + b"\r\n\r\n" + body
    to = lambda *names: [f"WARC-Concurrent-To: <{n}>" for n in names]
    chunks = b"5\r\nhello\r\n7;x=y\r\n, world\r\n0\r\n\r\n"
    first = [
        record("request", "r1", b"GET /1 HTTP/1.1\r\n\r\n"), record("response", "p1", http(chunks, "Transfer-Encoding: chunked"), *to("r1"), "WARC-Target-URI: http://x.org/a%2"), record("metadata", "m1", b"page-id: 1\r\n", *to("r1")),
        record("request", "r2", b"GET /2 HTTP/1.1\r\n\r\n", *to("nowhere", "p2")), record("response", "p2", http(gzip.compress(b"packed"), "Content-Encoding: gzip"), "WARC-Target-URI: http://x.org/%20%FF%zz"), record("metadata", "m9", b"page-id: 9\r\n", *to("nowhere")),
        record("response", "p3", http(b"not in chunks", "Transfer-Encoding: chunked", "Content-Encoding: gzip"), "WARC-Target-URI: <http://x.org/3>"), record("conversion", "c1", b"text", *to("p3")),
    ]
    second = [record("metadata", "m2", b"page-id: 2\r\n", *to("r2")), record("metadata", "m3", b"page-id: 3\r\n", *to("q3")), record("request", "q3", b"GET /3 HTTP/1.1\r\n\r\n", *to("s3")), record("metadata", "s3", b"via: q\r\n", *to("p3"))]
    (tmp_path / "a.warc").write_bytes(b"".join(first))
    (tmp_path / "b.warc").write_bytes(b"".join(second))
    found = {r.capture_id: r for r in op10_warc.read(spark, f"file://{tmp_path}").collect()}
    got = {k: (r.url, bytes(r.response.payload), r.request and r.request.line, r.metadata and r.metadata.page_id) for k, r in found.items()}
    assert got["p1"] == ("http://x.org/a%2", b"hello, world", "GET /1 HTTP/1.1", "1")
    assert got["p2"] == ("http://x.org/%20%FF%zz", b"packed", "GET /2 HTTP/1.1", "2")
    assert got["p3"][:3] == ("http://x.org/3", b"not in chunks", "GET /3 HTTP/1.1") and set(got) == {"p1", "p2", "p3"}
    bare = {r.capture_id: r.response.payload_bytes for r in op10_warc.read(spark, f"file://{tmp_path}", payloads=False).collect()}
    assert bare == {"p1": 12, "p2": 6, "p3": 13}


def test_chunks():
    assert op10_warc.unchunked(b"0\r\n\r\n") == b"" and op10_warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc"
    for broken in (b"", b"abc", b"3\r\nab", b"3\r\nabcd\r\n0\r\n", b"-1\r\n\r\n", b"zz\r\n"):
        assert op10_warc.unchunked(broken) is None


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    op10_warc.write(pages, f"file://{tmp_path}/w")
    assert op10_warc.read(spark, f"file://{tmp_path}/w").count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    data = [(i, (centres[i % 6] + rng.normal(size=16) * 0.15 * (i % 4)).astype(float).tolist()) for i in range(120)]
    data += [(200, data[0][1]), (201, data[0][1]), (202, [x * 3 for x in data[1][1]]), (203, [0.0] * 16), (204, None), (205, [1.0, None] + [0.0] * 14), (206, [float("nan")] * 16), (207, [float("inf")] * 16), (208, [1.0, 2.0]), (209, [2.0, 4.0]), (210, []), (None, data[0][1]), (3, data[3][1])]
    return data


def frame(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit("x") for c in ("id", "v", "n", "dim", "ok", "key", "links", "component", "block", "small", "q", "salt")}).repartition(4)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [7, 4096])
def test_near_duplicates(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(op3_embeddings, "BLOCK", block)
    monkeypatch.setattr(op3_embeddings, "TILE", 5)
    good = [(i, np.array(v)) for i, v in vectors if i is not None and sound(v) and any(v)]
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9 - 1e-12
    link = [[cos(a, b) for _, b in good] for _, a in good]
    root = {i: i for i, _ in good}
    find = lambda x: x if root[x] == x else find(root[x])
    for p, (i, _) in enumerate(good):
        for q, (j, _) in enumerate(good):
            if link[p][q]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [(i, sum(link[p]) - 1, find(i), find(i) == i) for p, (i, _) in enumerate(good)]
    want += [(i, 0, i, i is not None) for i, v in vectors if i is None or not sound(v) or not any(v)]
    found = op3_embeddings.near_duplicates(frame(spark, vectors))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_ids_with_several_vectors(spark):
    """Each row's links are those of its own vector; an id's vectors are one point, so what either links with is one component."""
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.02]), (9, [-1.0, 0.0]), (8, [-1.0, 0.001]), (9, [-1.0, 0.0]), (7, [0.0, -1.0])]
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False), (9, 2, 8, False), (8, 2, 8, True), (9, 2, 8, False), (7, 0, 7, True)]
    for kind in ("double", "float"):
        found = op3_embeddings.near_duplicates(spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>"))
        assert sorted(map(tuple, found.collect())) == sorted(want)
    apart = [(5, [1.0, 0.0]), (6, [0.0, 1.0]), (5, [-1.0, 0.0]), (2, [-1.0, 0.01])]  # 5 has a vector near 2 and one near nothing
    found = op3_embeddings.near_duplicates(spark.createDataFrame(apart, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, found.collect())) == [(2, 1, 2, True), (5, 0, 2, False), (5, 1, 2, False), (6, 0, 6, True)]


def test_tiles_bound_nothing_away():
    rng = np.random.default_rng(0)
    for spread in (0.05, 0.3, 1.0):
        a = rng.normal(size=(1, 64)) + rng.normal(size=(300, 64)) * spread
        axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
        p, q = op3_embeddings.linked(a, a, axes, 0.9, True)
        u = a / np.linalg.norm(a, axis=1)[:, None]
        want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i < j}
        assert set(zip(p.tolist(), q.tolist())) == want


@pytest.mark.parametrize("block", [5, 4096])
def test_top_k(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(op5_topk, "CANDIDATES", block)
    monkeypatch.setattr(op5_topk, "QUERIES", 4)
    monkeypatch.setattr(op5_topk, "GROUP", 6)
    df = frame(spark, vectors)
    whole = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in vectors if i is not None and sound(v)]
    want = []
    for i, a in whole:
        if i % 10:
            continue
        scored = sorted((-int(a @ b), j) for j, b in whole if j != i and len(a) == len(b))
        want += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:5], 1)]
    found = op5_topk.top_k(df.where("vec_id % 10 = 0"), df, 5)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_top_k_large_values():
    q, c = np.array([[2**31, 3], [0, 0]]), np.array([[2**31, 1], [5, 0], [-(2**31), 7]])
    row, ids, score = op5_topk.best(np.array([9, 8]), q, np.array([4, 2, 9]), c, 2)
    assert list(zip(row, ids, score)) == [(0, 4, 2**62 + 3), (0, 2, 5 * 2**31), (1, 2, 0), (1, 4, 0)]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert op3_embeddings.near_duplicates(none).count() == 0
    assert op5_topk.top_k(none, none, 5).count() == 0
