"""Main text of web pages, by differencing pages with their nearest URL."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, partitions, text_batches

# Elements and words of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math object select button".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_ITEMS = frozenset("li dd dt td th tr option".split())
_LISTS = frozenset("ul ol dl table menu".split())
_HOLDERS = frozenset("article main section div td li body".split())
_MAIN = frozenset(["article", "main"])
_OTHER = frozenset("nav footer aside form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words in a class or id that mark what isn't part of an article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar comment comments disqus discussion replies share sharing social related recommended widget pagination pager toolbar skip".split()
)
#: Words that stand beside those without changing what they say.
_NEUTRAL = frozenset("area bar block body box button buttons container content float group inner item items label links list listing outer panel post posts row section slot top bottom unit wrap wrapper".split())
#: Marks that articles have sections of, too.
_EITHER = frozenset("consent discussion navigation notice notices promotion recommended related replies".split())
#: What follows these says how a page is laid out, not what an element is.
_ABOUT = ("has-", "no-", "with-", "without-")
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")


def _aside(name: str, attributes: str, in_main: bool) -> int:
    """2 if an element stands beside the article, 1 if that is in doubt, else 0.

    Outside an article one word of a class or id is enough. Inside, all of its words have to be marks or neutral; other names that
    hold a mark (share-price, related-work), and marks that are sections of articles too, leave it in doubt.
    """
    if name in _OTHER or name == "header" and not in_main:
        return 2
    doubt = 0
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
            return 2
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for token in value.split():
                own = [] if token.startswith(_ABOUT) else _PART.findall(token)
                marks = [p for p in own if p in _MARKS or p == "header" and not in_main]
                if not marks:
                    continue
                if not in_main or all(p in marks or p in _NEUTRAL for p in own) and not all(p in _EITHER for p in marks):
                    return 2
                doubt = 1
    return doubt


def blocks(page: str) -> tuple[list[str], list[int]]:
    """The text blocks of a page in order, and of each 2 if it stands in an article, 0 if beside it, else 1; in an article, 1 if that is in doubt."""
    texts: list[str] = []
    kinds: list[int] = []
    text: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, kind inside, articles around
    kind, mains, at = 1, 0, 0

    def end() -> None:
        if text:
            found = " ".join("".join(text).split())
            if found:
                texts.append(found)
                kinds.append(kind)
            text.clear()

    def leave(i: int) -> None:
        nonlocal kind, mains
        del stack[i:]
        outer, mains = stack[-1][1:] if stack else (1, 0)
        if outer != kind:
            end()
        kind = outer

    def inner(name: str, stop: frozenset | tuple) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                return i
            if stack[i][0] in stop:
                return None
        return None

    while (m := _PIECE.search(page, at)) is not None:
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in _BLOCKS:
            end()
        if closing:
            i = inner(name, ())
            if i is not None:
                leave(i)
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            if not attributes.endswith("/"):
                close = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if name in _ITEMS:
            i = inner(name, _LISTS)
        else:
            i = inner("p", _HOLDERS) if name in _BLOCKS else None
        if i is not None:  # an item ends the item before it, a block the paragraph around it
            leave(i)
        if attributes.endswith("/") and name not in _BLOCKS:
            continue
        beside = _aside(name, attributes, mains > 0)
        if kind == 0 and name != "main" or beside == 2 or name == "head":
            inside = 0
        elif mains and (beside or kind == 1):
            inside = 1
        else:
            inside = 2 if mains or name in _MAIN or "main" in re.findall(r"role\s*=\s*[\"']?(\w+)", attributes) else 1
        mains += inside == 2 and (name in _MAIN or not mains)
        if inside != kind:
            end()
        kind = inside
        stack.append((name, kind, mains))
    text.append(html.unescape(_UNFINISHED.sub("", page[at:])))
    end()
    return texts, kinds


def shared(a: list[int], b: list[int]) -> list[bool]:
    """Of each line of a: whether it belongs to the longest common subsequence of a and b.

    Rows of the table are kept as the bits of one whole number each, so a page of n lines costs n operations on numbers
    of as many bits as the other page has lines.
    """
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    state, rows = every, []
    for x in a:
        hit = state & where.get(x, 0)
        state = ((state + hit) | (state - hit)) & every
        rows.append(state)
    found = [False] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                found[i] = True
                j -= 1
    return found


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed pages: hashes of all blocks; the text where the page itself decides, else its blocks and their kinds."""
    for batch in batches:
        hashes, texts, kinds, decided = [], [], [], []
        for page in batch.column(3).to_pylist():
            own, kind = blocks(page or "")
            hashes.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t in own])
            open_ = 1 in kind
            decided.append(None if open_ else " ".join(t for t, k in zip(own, kind, strict=True) if k == 2))
            texts.append([t if k else None for t, k in zip(own, kind, strict=True)] if open_ else None)
            kinds.append(kind if open_ else None)
        columns = [pa.array(hashes, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32())), pa.array(decided, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], ["k", "page_id", "url", "hashes", "texts", "kinds", "text"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their partition and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "part", "at"])
        at += n


def _alike(x: str, y: str) -> int:
    n = min(len(x), len(y))
    return next((i for i in range(n) if x[i] != y[i]), n)


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much of the path both pages of a pair begin with."""
    for batch in batches:
        alike = [_alike(a, b) for a, b in zip(batch.column("path").to_pylist(), batch.column("other_path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("other"), batch.column("gap"), pa.array(alike, pa.int32())], ["k", "other", "gap", "alike"])


def _without_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for hashes, texts, kinds, others in zip(*(batch.column(c).to_pylist() for c in ("hashes", "texts", "kinds", "others")), strict=True):
            votes, counted = [0] * len(hashes), 0
            for other in others or []:
                common = shared(hashes, other)
                article = [c for k, c in zip(kinds, common, strict=True) if k == 2]
                if 2 * sum(article) > len(article):  # the neighbour has this article too, so what both have may be part of it
                    continue
                counted += 1
                votes = [v + c for v, c in zip(votes, common, strict=True)]
            furniture = [counted > 0 and 2 * v >= counted for v in votes]
            kept = [t for t, k, c in zip(texts, kinds, furniture, strict=True) if k == 2 or k == 1 and not c]
            if not kept:  # nothing tells this page from its neighbours
                kept = [t for t, k in zip(texts, kinds, strict=True) if k == 1]
            out.append(" ".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


#: Neighbours that a page is compared with, of those so many places before and after it in the order of paths.
NEAREST, PLACES = 3, 2


def main_text(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url and text (the main text) of every row of pages.

    Pages are put in order of host and path, and each is paired with the NEAREST of its neighbours by the beginning of their paths. The text
    blocks of both are aligned by their longest common subsequence; a block that at least half of the neighbours share is deleted. Two
    guards make the result right where differencing alone isn't: blocks that stand in an article or main element without a mark
    stay, though the neighbours have them; and blocks that the page itself marks as menu, header, footer, sidebar, notice, advert,
    form or comment go, though no neighbour has them. Differencing decides on the rest: what is outside of articles and unmarked, and what in an
    article has a name that may be such a mark. Neighbours that have most of the page's article are copies of it and have no vote. A page
    of which nothing would be left, or that has no neighbour with a vote, keeps all that isn't marked.

    Pages are parsed once. Those that decide all by themselves are done then; of the others the blocks move, and of their neighbours hashes. Order is
    dealt by range of host, path and row, so a host with a third of all pages is split, and places are counted over the ranges. Null or
    empty html gives an empty text; a null url is a host of its own. Repeated rows are one page among the neighbours and are each given; empty tables
    give empty results; other columns aren't read.
    """
    spark = pages.sparkSession
    text_batches(spark)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    k = F.xxhash64(F.col(id_col).cast("long"), url, F.col(html_col).cast("string"))
    rows = pages.select(k.alias("k"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    lines = materialise(rows.mapInArrow(_lines, "k long, page_id long, url string, hashes array<long>, texts array<string>, kinds array<int>, text string"))
    done, left = lines.where("text is not null").select("page_id", "url", "text"), lines.where("text is null")
    if left.isEmpty():
        return done
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    places = lines.select(host.alias("host"), path.alias("path"), "k").distinct()
    order = ["host", "path", "k"]
    placed = materialise(places.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_numbered, "host string, path string, k long, part long, at long"))
    sizes, before = sorted(placed.groupBy("part").count().collect()), 0  # a row a partition
    starts = []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    placed = placed.join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part").select("host", "path", "k", (F.col("start") + F.col("at")).alias("place"))
    asked = placed.join(left.select("k").distinct(), "k", "left_semi").withColumn("gap", F.explode(F.array(*(F.lit(g) for g in range(-PLACES, PLACES + 1) if g))))
    asked = asked.withColumn("place", F.col("place") + F.col("gap"))
    others = placed.select("host", "place", F.col("path").alias("other_path"), F.col("k").alias("other"))
    pairs = asked.join(others, ["host", "place"]).select("k", "path", "other", "other_path", "gap").mapInArrow(_likeness, "k long, other long, gap int, alike int")
    best = Window.partitionBy("k").orderBy(F.col("alike").desc(), F.abs("gap"), "gap")
    pairs = pairs.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= NEAREST).select("k", "other")
    known = lines.select(F.col("k").alias("other"), "hashes").groupBy("other").agg(F.first("hashes").alias("hashes"))
    known = pairs.join(known, "other").groupBy("k").agg(F.collect_list("hashes").alias("others"))  # NEAREST at most
    both = left.join(known, "k", "left").select("page_id", "url", "hashes", "texts", "kinds", "others")
    return done.union(both.mapInArrow(_without_shared, "page_id long, url string, text string"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
