"""Regions of images of any size, tile by tile: distances, watershed, outlines.

A task holds some tiles at a time, each with a line of pixels around it. What crosses a seam goes from tile to tile in rounds, or is put together on a
graph of the seams alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.regions import _stars, components_by_tile
from rasterloom.operators.stacks import Stack
from rasterloom.operators.staging import by_groups, written

_TILE = ["img", "ty", "tx"]
#: Images of no more places than these are worked on whole where that takes fewer steps: a task holds as many pixels anyway.
WHOLE = 1 << 20


def by_size(px: DataFrame, whole: Callable[..., DataFrame], parts: Callable[..., DataFrame], *others: DataFrame) -> DataFrame:
    """whole of the images that a task can hold, and parts of the larger ones, which go tile by tile, and of those with few pixels for their size.
    Both give the same rows. others are split as px is, and handed on.

    An image that lies in one task has no seams to shuffle; nothing is shuffled here either if px lies by image. To the driver comes whether there are larger ones.
    """
    cells = (F.max("yy") + 1) * (F.max("xx") + 1)
    large = px.groupBy("img").agg(cells.alias("_cells"), F.count("*").alias("_n")).where((F.col("_cells") > WHOLE) | (F.col("_cells") > 16 * F.col("_n"))).select("img")
    if large.isEmpty():
        return whole(px, *others)
    large = written(large)
    small = whole(*(df.join(large, "img", "left_anti") for df in (px, *others)))
    return small.unionByName(parts(*(df.join(large, "img", "left_semi") for df in (px, *others))))


def _seen(px: DataFrame, tile: int, *columns: str) -> DataFrame:
    """Every pixel in its own tile, and at a seam in the tiles beyond it too: img, ty, tx, yy, xx, own and the columns."""

    def tiles(at: str) -> Column:
        here, place = F.floor(F.col(at) / tile), F.pmod(F.col(at), F.lit(tile))
        if tile == 1:
            return F.array(here, here - 1, here + 1)
        return F.when(place == 0, F.array(here, here - 1)).when(place == tile - 1, F.array(here, here + 1)).otherwise(F.array(here))

    rows = px.select("img", "yy", "xx", *columns, F.explode(tiles("yy")).alias("ty")).withColumn("tx", F.explode(tiles("xx")))
    own = (F.col("ty") == F.floor(F.col("yy") / tile)) & (F.col("tx") == F.floor(F.col("xx") / tile))
    return rows.select(*_TILE, "yy", "xx", own.alias("own"), *columns)


class _Stack:
    """Rows of whole tiles as arrays, one tile below the other, each with a line of pixels around: `there` is where a pixel is known, `own` where it is
    the tile's. What doesn't go further than one pixel from an own one never meets another tile."""

    def __init__(self, table: pa.Table) -> None:
        self.table, own = table, table.column("own").to_numpy(zero_copy_only=False)
        y, x, n = (table.column(c).to_numpy() for c in ("yy", "xx", "_n"))
        starts, many = np.flatnonzero(n == 1), np.iinfo(np.int64).max // 2
        least = lambda at: np.minimum.reduceat(np.where(own, at, many), starts)
        y0, x0, y1, x1 = least(y), least(x), -least(-y), -least(-x)
        has = y0 < many
        high, wide = np.where(has, y1 - y0 + 3, 0), np.where(has, x1 - x0 + 3, 0)
        top = np.cumsum(high) - high
        self.empty, self.shape = not has.any(), (int(high.sum()), int(wide.max()))
        tile, of = np.cumsum(n == 1) - 1, np.repeat(np.arange(len(starts)), high)
        y, x = y - np.where(has, y0 - 1, 0)[tile], x - np.where(has, x0 - 1, 0)[tile]
        self._near = (y >= 0) & (y < high[tile]) & (x >= 0) & (x < wide[tile])  # a tile of one line sees more than its neighbours
        self._y, self._x = (y + top[tile])[self._near], x[self._near]
        #: The image of each line, and what its places begin at.
        self.img, self._y0, self._x0 = table.column("img").to_numpy()[starts][of], (y0 - 1 - top)[of], (x0 - 1)[of]
        self.there, self.own = self.array(np.ones(len(own), bool), False), self.array(own, False)

    def array(self, values: np.ndarray, other) -> np.ndarray:
        out = np.full(self.shape, other, values.dtype)
        out[self._y, self._x] = values[self._near]
        return out

    def column(self, name: str, other=0) -> np.ndarray:
        return self.array(self.table.column(name).to_numpy(zero_copy_only=False), other)

    def place(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in their images pixels of the arrays are."""
        return y + self._y0[y], x + self._x0[y]


def _stacked(rows: DataFrame, tile: int, f, schema: str) -> DataFrame:
    """f, which gives a table, over stacks of the tiles of rows as _seen gives them. A stack has some four million pixels or is one tile."""
    most = max(1, (1 << 22) // (tile + 2) ** 2)

    def some(table: pa.Table):
        starts = np.flatnonzero(table.column("_n").to_numpy() == 1)[::most].tolist()
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            stack = _Stack(table.slice(a, b - a))
            if not stack.empty and (found := f(stack)).num_rows:
                yield found

    return by_groups(rows, _TILE, ["yy", "xx"], some, schema)


# ---- distances ----

#: Ten-thousandths of a step straight and aslant, and of what is out of reach.
_STRAIGHT, _ASLANT, _FAR = 9550, 13693, 1 << 60
_SIDES = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def swept(d: np.ndarray) -> np.ndarray:
    """The least sum of a pixel's number and the way from it, by one sweep down and one up over whole lines; exact, in whole numbers. The last two axes are
    those of an image; others before them number images of one size."""
    d, way = np.moveaxis(d, -2, 0).copy(), _STRAIGHT * np.arange(d.shape[-1])

    def line(y: int, before: int | None, right: bool) -> None:
        now = d[y]
        if before is not None:
            other = d[before]
            now = np.minimum(now, other + _STRAIGHT)
            now[..., 1:] = np.minimum(now[..., 1:], other[..., :-1] + _ASLANT)
            now[..., :-1] = np.minimum(now[..., :-1], other[..., 1:] + _ASLANT)
        if right:
            now = np.minimum.accumulate(now - way, axis=-1) + way
        else:
            now = (np.minimum.accumulate((now + way)[..., ::-1], axis=-1) - way[::-1])[..., ::-1]
        d[y] = now

    for y in range(len(d)):
        line(y, y - 1 if y else None, True)
    for y in reversed(range(len(d))):
        line(y, y + 1 if y + 1 < len(d) else None, False)
    return np.moveaxis(np.minimum(d, _FAR), 0, -2)


def swept_masks(mask: np.ndarray, starts: np.ndarray, y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The distances within whole rectangles of pixels, one for each start, in ten-thousandths. Those of one size are swept together."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(y))))
    y, x = y - np.minimum.reduceat(y, starts)[of], x - np.minimum.reduceat(x, starts)[of]
    size = np.stack([np.maximum.reduceat(y, starts), np.maximum.reduceat(x, starts)], 1) + 1
    out: list = [None] * len(starts)
    for h, w in np.unique(size, axis=0).tolist():
        alike = (size == (h, w)).all(1)
        place, rows = np.cumsum(alike) - 1, alike[of]
        d = np.zeros((int(alike.sum()), h, w), np.int64)
        d[place[of[rows]], y[rows], x[rows]] = np.where(mask[rows], _FAR, 0)
        for i, found in zip(np.flatnonzero(alike).tolist(), swept(d), strict=True):
            out[i] = found
    return out


def _strip(d: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """What a tile shows its neighbour in a direction."""
    cut = lambda s: slice(None) if s == 0 else slice(-1, None) if s > 0 else slice(0, 1)
    return d[cut(dy), cut(dx)].ravel()


_STATE = "img int, ty long, tx long, y long, x long, h int, w int, d binary, told boolean"


def _states(rows: list[tuple]) -> pa.Table:
    """rows: img, ty, tx, y, x, distances and told."""
    img, ty, tx, y, x, d, told = zip(*rows, strict=True)
    columns = [img, ty, tx, y, x, [v.shape[0] for v in d], [v.shape[1] for v in d], [v.astype(np.int64).tobytes() for v in d], told]
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    return pa.Table.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _STATE.split(", ")])


def _told(batches):
    """What tiles whose border fell tell their neighbours: one row a side."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            d = np.frombuffer(r["d"], np.int64).reshape(r["h"], r["w"])
            for side, (dy, dx) in enumerate(_SIDES):
                if ((v := _strip(d, dy, dx)) < _FAR).any():
                    rows.append((r["img"], r["ty"] + dy, r["tx"] + dx, side, v.tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*_TILE, "side", "strip"])


def _heard(batches):
    """Tiles with what their neighbours told: those that fall anywhere, with whether their border did."""
    line = lambda s: slice(1, -1) if s == 0 else slice(0, 1) if s > 0 else slice(-1, None)
    for batch in batches:
        rows, fell = batch.to_pylist(), []
        for h, w in {(r["h"], r["w"]) for r in rows}:
            alike = [r for r in rows if (r["h"], r["w"]) == (h, w)]
            d = np.stack([np.frombuffer(r["d"], np.int64).reshape(h, w) for r in alike])
            wide = np.pad(d, ((0, 0), (1, 1), (1, 1)), constant_values=_FAR)
            for i, r in enumerate(alike):
                for told in r["all"]:
                    dy, dx = _SIDES[told["side"]]  # told downwards comes from above, and so on
                    wide[i][line(dy), line(dx)] = np.frombuffer(told["strip"], np.int64).reshape(wide[i][line(dy), line(dx)].shape)
            new = np.minimum(d, swept(wide)[:, 1:-1, 1:-1])
            for i in np.flatnonzero((new < d).any((1, 2))).tolist():
                r, border = alike[i], any((_strip(new[i], *s) < _strip(d[i], *s)).any() for s in _SIDES)
                fell.append((r["img"], r["ty"], r["tx"], r["y"], r["x"], new[i], border))
        if fell:
            yield from _states(fell).to_batches()


def distances_by_tile(px: DataFrame, mask: str, tile: int) -> DataFrame:
    """What regions.distances gives, for images of any size (N9). px: img, yy, xx and mask, a whole rectangle an image.

    Each tile is swept alone first. Then, in rounds, the tiles whose border fell tell it their neighbours, which are swept again, and no
    other tile is touched. There are as many rounds as the longest way crosses tiles.
    """

    def alone(table: pa.Table):
        img, ty, tx, y, x, n = (table.column(c).to_numpy() for c in (*_TILE, "yy", "xx", "_n"))
        starts = np.flatnonzero(n == 1)
        found = swept_masks(table.column("_m").to_numpy(zero_copy_only=False), starts, y, x)
        low = lambda at: np.minimum.reduceat(at, starts).tolist()
        yield _states([(*tile, d, True) for *tile, d in zip(img[starts].tolist(), ty[starts].tolist(), tx[starts].tolist(), low(y), low(x), found, strict=True)])

    cut = px.select("img", F.floor(F.col("yy") / tile).alias("ty"), F.floor(F.col("xx") / tile).alias("tx"), "yy", "xx", F.coalesce(F.col(mask).cast("boolean"), F.lit(False)).alias("_m"))
    known = written(by_groups(cut, _TILE, ["yy", "xx"], alone, _STATE)).withColumn("round", F.lit(0))
    latest = lambda df: df.groupBy(*_TILE).agg(*(F.max_by(c, "round").alias(c) for c in ("y", "x", "h", "w", "d")))
    news, n = known, 0
    while not (told := news.where("told")).isEmpty():
        n += 1
        heard = told.select("img", "ty", "tx", "h", "w", "d").mapInArrow(_told, "img int, ty long, tx long, side int, strip binary")
        heard = written(heard.groupBy(*_TILE).agg(F.collect_list(F.struct("side", "strip")).alias("all")))  # at most eight
        news = written(latest(known.join(heard.select(*_TILE), _TILE)).join(heard, _TILE).mapInArrow(_heard, _STATE)).withColumn("round", F.lit(n))
        known = known.unionByName(news)

    def pixels(batches):
        for batch in batches:
            rows = batch.to_pylist()
            while rows:
                ends = np.cumsum([r["h"] * r["w"] for r in rows])
                some = rows[: 1 + int(np.searchsorted(ends, 1 << 18))]
                rows = rows[len(some) :]
                at = [np.divmod(np.arange(r["h"] * r["w"]), r["w"]) for r in some]
                d = np.concatenate([np.frombuffer(r["d"], np.int64) for r in some])
                img = np.repeat(np.array([r["img"] for r in some], np.int32), [r["h"] * r["w"] for r in some])
                y, x = (np.concatenate([p[i] + r[c] for p, r in zip(at, some, strict=True)]) for i, c in enumerate("yx"))
                yield pa.RecordBatch.from_arrays([pa.array(img), pa.array(y), pa.array(x), pa.array(np.where(d >= _FAR, np.inf, d / 10_000))], ["img", "yy", "xx", "d"])

    return latest(known).mapInArrow(pixels, "img int, yy long, xx long, d double")


def mask_to_distance_by_tile(px: DataFrame, mask: str, tile: int) -> DataFrame:
    """What regions.mask_to_distance gives, for images of any size (R9). Those that a task can hold are worked on whole."""
    from rasterloom.operators.regions import mask_to_distance

    return by_size(px.select("img", "yy", "xx", mask), lambda df: mask_to_distance(df, mask), lambda df: _shares(df, mask, tile))


def _shares(px: DataFrame, mask: str, tile: int) -> DataFrame:
    rows = distances_by_tile(px, mask, tile).join(components_by_tile(px, mask, tile), ["img", "yy", "xx"], "left")
    top = rows.where("label is not null").groupBy("img", "label").agg(F.max("d").alias("top"))
    return rows.join(top, ["img", "label"], "left").select("img", "yy", "xx", F.when(F.col("top") > 0, F.col("d") / F.col("top")).otherwise(0.0).alias("share"))


# ---- watershed ----


def _number(y, x):
    """A pixel's number in its image: in reading order, whatever the image's size."""
    return (y << 31) + x


def _passes(value: np.ndarray, by: str, y: np.ndarray, x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    a, b = value[y, x], value[y + dy, x + dx]
    return np.abs(a - b) if by == "difference" else np.maximum(a, b)


def _taken(ends: np.ndarray, rooted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each pixel's part, when every part without a root has taken its least pass, over and over; one whose least pass leads outside (an end of -1) waits.
    ends: both ends of the passes, which come in order. Returns the passes' parts too, and whether they lead to another one."""
    n = len(rooted)
    part, waits, outside = np.arange(n), np.zeros(n, bool), (ends < 0).any(0)
    while True:
        a, b = (np.where(e >= 0, part[e], -1) for e in ends)
        live = a != b
        least = np.full(n, ends.shape[1])
        for e in (a, b):
            of = live & (e >= 0)
            np.minimum.at(least, e[of], np.flatnonzero(of))
        asks = np.flatnonzero((least < ends.shape[1]) & ~rooted & ~waits)
        if not len(asks):
            return part, a, b, live
        chosen = least[asks]
        waits[asks[outside[chosen]]] = True
        goes = ~outside[chosen]
        asks, chosen = asks[goes], chosen[goes]
        to = np.where(a[chosen] == asks, b[chosen], a[chosen])
        up = np.arange(n)
        up[asks] = to
        mutual = (up[up] == np.arange(n)) & (np.arange(n) < up)
        up[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(far := up[up], up):
            up = far
        part = up[part]


def forest(stack: Stack, value: np.ndarray, marker: np.ndarray, by: str, lines: bool = False, rim: bool = False) -> np.ndarray:
    """What watershed_by_tile gives for whole images, which have no seams. Pixels without a row are in no basin, and no basin passes them."""
    there = stack.array(np.ones(len(stack.place), bool), False)
    frame = (stack.y == 0) | (stack.x == 0) | (stack.y == stack.high[stack.of] - 1) | (stack.x == stack.wide[stack.of] - 1)
    if rim:
        there &= ~frame
    far = stack.wide[stack.of]
    across = np.flatnonzero(there & (stack.x < far - 1))
    down = np.flatnonzero(there & (stack.y < stack.high[stack.of] - 1))
    across, down = across[there[across + 1]], down[there[down + far[down]]]
    ends = np.stack([np.append(across, down), np.append(across + 1, down + far[down])])
    a, b = value[ends]
    name = np.append(across * 2, down * 2 + 1)  # reading order in an image, across before down
    order = np.lexsort((name, np.abs(a - b) if by == "difference" else np.maximum(a, b)))
    part = _taken(ends[:, order], there & (marker > 0))[0]
    held = np.zeros(len(marker), np.int64)
    rooted = np.flatnonzero(there & (marker > 0))
    held[part[rooted]] = marker[rooted]
    basin = held[part]
    if lines:
        beside = np.zeros(len(basin), bool)
        for near, cells, step in ((stack.x > 0, -1, 0), (stack.x < far - 1, 1, 0), (stack.y > 0, 0, -1), (stack.y < stack.high[stack.of] - 1, 0, 1)):
            here = np.flatnonzero(near)
            other = basin[here + cells + step * far[here]]
            beside[here] |= (other > 0) & (other < basin[here])
        basin = np.where(beside & (marker == 0), -1, basin)
    return np.where(frame, -1, basin) if rim else basin


def grown(stack: _Stack, value: np.ndarray, marker: np.ndarray, by: str) -> tuple[np.ndarray, tuple]:
    """The parts of tiles that each one can tell alone, and the passes between them.

    Every part takes the least of all passes out of it, over and over; a part with a marker takes none, one whose least pass leads out
    of the tile has to wait. Returns each own pixel's part (-marker, or its first pixel's number plus 1) and the passes that are left: two
    ends' parts (for the one beyond a seam 0), weight, number and image.
    """
    there, own = stack.there, stack.own
    nodes = np.full(stack.shape, -1)
    ys, xs = np.nonzero(own)
    n = len(ys)
    nodes[ys, xs] = np.arange(n)
    ends, weights, names, imgs = [], [], [], []
    for way, (dy, dx) in enumerate(((0, 1), (1, 0))):
        y, x = np.nonzero(there[: there.shape[0] - dy, : there.shape[1] - dx] & there[dy:, dx:] & (own[: there.shape[0] - dy, : there.shape[1] - dx] | own[dy:, dx:]))
        ends.append(np.stack([nodes[y, x], nodes[y + dy, x + dx]]))
        weights.append(_passes(value, by, y, x, dy, dx))
        names.append(_number(*stack.place(y, x)) * 2 + way)
        imgs.append(stack.img[y])
    ends, weights, names, imgs = np.concatenate(ends, 1), np.concatenate(weights), np.concatenate(names), np.concatenate(imgs)
    order = np.lexsort((names, weights))
    ends, weights, names, imgs = ends[:, order], weights[order], names[order], imgs[order]
    rooted = marker[ys, xs] > 0
    part, a, b, live = _taken(ends, rooted)
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, part, _number(*stack.place(ys, xs)) + 1)
    held = np.zeros(n, np.int64)
    held[np.flatnonzero(rooted)] = marker[ys, xs][rooted]
    name = np.where(held[part] > 0, -held[part], first[part])
    left = live & ~((a >= 0) & (b >= 0) & (held[a] > 0) & (held[b] > 0))
    ends = [np.where(e[left] >= 0, name[ends_[left]], 0) for e, ends_ in ((a, ends[0]), (b, ends[1]))]
    return name, (*ends, weights[left], names[left], imgs[left])


def _least(edges: DataFrame) -> DataFrame:
    """The least pass of each pair of parts."""
    at = F.struct("w", "name")
    one = edges.where(F.col("a") != F.col("b")).where((F.col("a") > 0) | (F.col("b") > 0)).select("img", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), at.alias("_p"))
    return one.groupBy("img", "a", "b").agg(F.min("_p").alias("_p")).select("img", "a", "b", "_p.w", "_p.name")


def _joined(edges: DataFrame) -> DataFrame:
    """img, part and root of all parts at the passes: the marker (negative) that each belongs to in the least spanning forest, or for parts that no marker
    reaches their smallest one.

    In rounds: every part without a marker takes its least pass, chains of parts become one by doubling steps, and the passes between
    what is left go on. The number of parts halves at least.
    """
    edges = written(_least(edges))
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("img", F.col("b").alias("a"), F.col("a").alias("b"), "w", "name")).where("a > 0")
        up = both.groupBy("img", "a").agg(F.min_by("b", F.struct("w", "name")).alias("up"))
        back = up.select("img", F.col("a").alias("up"), F.col("up").alias("_back"))
        up = written(up.join(back, ["img", "up"], "left").select("img", "a", F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("up")), F.col("a")).otherwise(F.col("up")).alias("up")))
        while True:
            far = written(up.join(up.select("img", F.col("a").alias("up"), F.col("up").alias("_far")), ["img", "up"], "left").select("img", "a", F.coalesce("_far", "up").alias("up"), (F.col("_far") != F.col("up")).alias("_moved")))
            up = far.select("img", "a", "up")
            if far.where("_moved").isEmpty():
                break
        of = lambda c, out, up=up: up.select("img", F.col("a").alias(c), F.col("up").alias(out))
        roots = up.withColumnRenamed("a", "part") if roots is None else roots.join(of("root", "_up"), ["img", "root"], "left").select("img", "part", F.coalesce("_up", "root").alias("root"))
        roots = written(roots.toDF("img", "part", "root"))
        moved = edges.join(of("a", "_a"), ["img", "a"], "left").join(of("b", "_b"), ["img", "b"], "left")
        edges = written(_least(moved.select("img", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w", "name")))
    return roots


def watershed_by_tile(px: DataFrame, value: str, marker: str, tile: int, *, by: str = "level", lines: bool = False, rim: bool = False) -> DataFrame:
    """img, yy, xx and basin: each pixel's marker number in the least spanning forest of the passes to its four neighbours (R5); 0 where
    no marker reaches. Markers are whole numbers from 1, values whole numbers or broken ones.

    A pass weighs the higher of its two pixels (by="level") or their difference (by="difference"). Equal ones come in reading order of their
    upper or left pixel, across before down, so the forest is one and the same for all sizes of tiles. This is what a flood from the markers
    gives that takes passes in that order. lines: unmarked pixels beside a basin of a smaller number are -1. rim: the outermost
    pixels of an image are -1, and no basin passes them.

    A tile finds what parts it can alone. The parts left, of which there are no more than pixels along seams, and the least passes between
    them are joined in rounds. Pixels of an image don't have to be a whole rectangle, unless rim.
    """
    rows = px.select("img", "yy", "xx", F.col(value).alias("_v"), F.coalesce(F.col(marker).cast("long"), F.lit(0)).alias("_k"))
    if rim:
        size = rows.groupBy("img").agg(F.max("yy").alias("_h"), F.max("xx").alias("_w"))  # a row an image
        inside = (F.col("yy") > 0) & (F.col("yy") < F.col("_h")) & (F.col("xx") > 0) & (F.col("xx") < F.col("_w"))
        framed = rows.join(size, "img").withColumn("_in", inside).drop("_h", "_w")
        rows, frame = framed.where("_in").drop("_in"), framed.where(~F.col("_in"))

    whole = dict(px.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    kind = "long" if whole else "double"
    rows = rows.withColumn("_v", F.col("_v").cast(kind))

    def one(stack: _Stack) -> pa.Table:
        schema = pa.schema([("img", pa.int32()), ("yy", pa.int64()), ("xx", pa.int64()), ("k", pa.int64()), ("part", pa.int64()), ("b", pa.int64()), ("w", pa.int64() if whole else pa.float64()), ("name", pa.int64())])
        marker = stack.column("_k")
        name, (a, b, w, names, imgs) = grown(stack, stack.column("_v"), marker, by)
        ys, xs = np.nonzero(stack.own)
        n, m = len(ys), len(a)
        none = lambda k, t: pa.nulls(k, t)
        pixels = [pa.array(stack.img[ys], pa.int32()), *map(pa.array, stack.place(ys, xs)), pa.array(marker[ys, xs]), pa.array(name), none(n, pa.int64()), none(n, schema.field("w").type), none(n, pa.int64())]
        passes = [pa.array(imgs, pa.int32()), *[none(m, pa.int64())] * 3, pa.array(a), pa.array(b), pa.array(w, schema.field("w").type), pa.array(names)]
        return pa.concat_tables([pa.Table.from_arrays(pixels, schema=schema), pa.Table.from_arrays(passes, schema=schema)])

    found = written(_stacked(_seen(rows, tile, "_v", "_k"), tile, one, f"img int, yy long, xx long, k long, part long, b long, w {kind}, name long"))
    passes = found.where("name is not null").select("img", F.col("part").alias("a"), "b", "w", "name")
    # a pass over a seam is known from both sides, from each with its own part alone
    inner = passes.where((F.col("a") != 0) & (F.col("b") != 0))
    seams = passes.where((F.col("a") == 0) | (F.col("b") == 0)).withColumn("own", F.when(F.col("a") == 0, F.col("b")).otherwise(F.col("a")))
    seams = seams.groupBy("img", "name").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.first("w").alias("w")).select("img", "a", "b", "w", "name")
    roots = _joined(inner.union(seams))
    pixels = found.where("name is null").select("img", "yy", "xx", "k", "part")
    if roots is not None:
        pixels = pixels.join(roots, ["img", "part"], "left").select("img", "yy", "xx", "k", F.coalesce("root", "part").alias("part"))
    basins = pixels.select("img", "yy", "xx", "k", F.when(F.col("part") < 0, -F.col("part")).otherwise(F.lit(0)).alias("basin"))
    if rim:
        basins = basins.union(frame.select("img", "yy", "xx", F.lit(0).cast("long"), F.lit(-1).cast("long")))
    if lines:
        basins = _with_lines(basins)
    return basins.select("img", "yy", "xx", "basin")


def _with_lines(basins: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    beside = F.lit(False)
    for line, along in (("yy", "xx"), ("xx", "yy")):
        w = Window.partitionBy("img", line).orderBy(along)
        for step in (F.lag, F.lead):
            other = F.when(F.abs(step(along).over(w) - F.col(along)) == 1, step("basin").over(w))
            beside = beside | F.coalesce((other > 0) & (other < F.col("basin")), F.lit(False))
    return basins.withColumn("_line", beside).withColumn("basin", F.when((F.col("k") == 0) & F.col("_line"), F.lit(-1).cast("long")).otherwise(F.col("basin"))).drop("_line")


# ---- outlines ----

#: The eight steps from a pixel, clockwise from the right; its sides are those with even numbers.
_WAYS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def _ranked(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each one's chain and its place in it, by doubling. following: the next one's place or -1; rings are cut at their lowest."""
    n = len(following)
    before = np.full(n, -1)
    has = np.flatnonzero(following >= 0)
    before[following[has]] = has
    jump, low = np.where(before >= 0, before, np.arange(n)), np.arange(n)
    steps = max(1, int(n).bit_length())
    for _ in range(steps):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    ring = before[jump] >= 0
    before[ring & (low == np.arange(n))] = -1
    jump, place = np.where(before >= 0, before, np.arange(n)), (before >= 0).astype(np.int64)
    for _ in range(steps):
        place, jump = place + place[jump], jump[jump]
    return jump, place


def _side(y, x, side):
    """The number of a pixel's side (0 to 3 for right, below, left, above)."""
    return (_number(y + 1, x + 1) << 2) | side


def _sides(stack: _Stack, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sides of the tiles' set pixels beside unset ones, and each one's next along its border, which regions connected by eight neighbours keep
    on the right. Sides are numbered by their places in the stack."""
    wide = np.pad(mask, 1)
    here, following = [], []
    y0, x0 = np.nonzero(stack.own & mask)
    for side in range(4):
        way = 2 * side
        at = lambda k, y, x: wide[y + 1 + _WAYS[k % 8][0], x + 1 + _WAYS[k % 8][1]]
        edge = ~at(way, y0, x0)
        y, x = y0[edge], x0[edge]
        aslant, straight = at(way + 1, y, x), at(way + 2, y, x)
        go = [np.where(aslant, _WAYS[(way + 1) % 8][i], np.where(straight, _WAYS[(way + 2) % 8][i], 0)) for i in (0, 1)]
        new = np.where(aslant, (side - 1) % 4, np.where(straight, side, (side + 1) % 4))
        here.append(_side(y, x, side))
        following.append(_side(y + go[0], x + go[1], new))
    return np.concatenate(here), np.concatenate(following)


def _parted(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The y, x and side of numbers that _side gives."""
    pixel = sides >> 2
    return (pixel >> 31) - 1, (pixel & ((1 << 31) - 1)) - 1, sides & 3


def _pieces(stack: _Stack) -> pa.Table:
    """The borders of tiles in pieces: each from where it comes in (or a ring's lowest side) to where it leaves."""
    here, following = _sides(stack, stack.column("_m", False))
    order = np.argsort(here)
    here, following = here[order], following[order]
    place = np.clip(np.searchsorted(here, following), 0, len(here) - 1)
    head, rank = _ranked(np.where(here[place] == following, place, -1))
    order = np.lexsort((rank, head))
    starts = np.flatnonzero(np.append(True, head[order][1:] != head[order][:-1])[: len(order)])
    ends = np.append(starts[1:], len(order))[: len(starts)]

    def named(sides: np.ndarray) -> np.ndarray:
        y, x, side = _parted(sides)
        return _side(*stack.place(y, x), side)

    img, own = stack.img[_parted(here[order[starts]])[0]], named(here[order])
    sides = [own[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.Table.from_arrays([pa.array(img, pa.int32()), pa.array(own[starts]), pa.array(named(following[order[ends - 1]])), pa.array(sides, pa.binary())], ["img", "first", "next", "sides"])


def outline_of(sides: np.ndarray) -> tuple[int, int, int, int, bool, list[dict]]:
    """A ring of sides in order: its first pixel (a hole's first pixel inside) as y, x, the pixel to its left, whether it is a hole, and its points
    from there, without those along straight lines."""
    y, x, side = _parted(sides)
    steps = np.array(_WAYS)[::2][side]
    by, bx = y + steps[:, 0], x + steps[:, 1]
    first, beside = int(np.lexsort((x, y))[0]), int(np.lexsort((bx, by))[0])
    hole = bool((by[beside], bx[beside]) > (y[first], x[first]))
    top = (int(by[beside]), int(bx[beside])) if hole else (int(y[first]), int(x[first]))
    start = int(np.flatnonzero(sides == (_side(top[0], top[1] - 1, 0) if hole else _side(*top, 2)))[0])
    points = np.stack([np.roll(x, -start), np.roll(y, -start)], 1)
    new = (points != np.roll(points, 1, 0)).any(1)
    kept = points[new] if new.any() else points[:1]
    if not new[0] and new.any():
        kept = np.roll(kept, 1, 0)  # the first pixel's visit began before the start
    if len(kept) > 2:
        step = kept - np.roll(kept, 1, 0)
        kept = kept[(step != np.roll(step, -1, 0)).any(1)]
    return (*top, top[1] - 1, hole, [{"x": int(a), "y": int(b)} for a, b in kept])


_RING = "img int, y long, x long, hole boolean, points array<struct<x:int,y:int>>"


def rings(px: DataFrame, mask: str, tile: int) -> DataFrame:
    """img, y, x (the first pixel of a region, or of a hole), hole and points of all borders of a mask, 8-connected regions and 4-connected holes.

    Tiles give their borders in pieces, as each side of a pixel knows the next one from the pixels around. Pieces are joined over the
    seams to rings, and a ring's pieces are put in order together: what one task holds is one outline.
    """
    rows = px.select("img", "yy", "xx", F.coalesce(F.col(mask).cast("boolean"), F.lit(False)).alias("_m"))

    pieces = written(_stacked(_seen(rows, tile, "_m"), tile, _pieces, "img int, first long, next long, sides binary"))
    root = _stars(pieces.where("first <> next").select("img", F.col("first").alias("a"), F.col("next").alias("b"))).select("img", F.col("a").alias("first"), F.col("b").alias("root"))
    named = pieces.join(root, ["img", "first"], "left").withColumn("root", F.coalesce("root", "first"))

    def ordered(part: dict) -> np.ndarray:
        at, sides = min(part), []
        for _ in range(len(part)):
            at, s = part[at]
            sides.append(np.frombuffer(s, np.int64))
        return np.concatenate(sides)

    def some(table: pa.Table):
        img, first, following, sides = (table.column(c).to_pylist() for c in ("img", "first", "next", "sides"))
        starts = np.flatnonzero(table.column("_n").to_numpy() == 1).tolist()
        found = [(img[a], *outline_of(ordered({first[i]: (following[i], sides[i]) for i in range(a, b)}))) for a, b in zip(starts, [*starts[1:], len(img)], strict=True)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), None, pa.bool_(), pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))]
        yield pa.Table.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds) if k], ["img", "y", "x", "hole", "points"])

    return by_groups(named.select("img", "root", "first", "next", "sides"), ["img", "root"], ["first"], some, _RING, least=1 << 10)


def contour_tree_by_tile(px: DataFrame, mask: str, tile: int, inverse: bool = False, least_points: int = 3) -> DataFrame:
    """What regions.contour_tree gives, for images of any size (R2, tree mode): img, id, parent, hole and points."""
    rows = px.select("img", "yy", "xx", (F.coalesce(F.col(mask).cast("boolean"), F.lit(False)) != F.lit(inverse)).alias("_m")).withColumn("_n", ~F.col("_m"))
    found = written(rings(rows, "_m", tile))
    size = rows.groupBy("img").agg((F.max("yy") + 1).alias("_h"), (F.max("xx") + 1).alias("_w"))  # a row an image
    fore = components_by_tile(rows, "_m", tile)
    rear = written(components_by_tile(rows, "_n", tile, straight=True))
    edge = (F.col("yy") == 0) | (F.col("xx") == 0) | (F.col("yy") == F.col("_h") - 1) | (F.col("xx") == F.col("_w") - 1)
    outside = rear.join(size, "img").where(edge).select("img", "label").distinct().withColumn("_out", F.lit(True))
    holes = rear.join(outside, ["img", "label"], "left").where("_out is null").select("img", "yy", "xx", "label")
    # a hole's parent is the region left of its first pixel, a region's the hole there, if it is one
    beside = fore.unionByName(holes).select("img", F.col("yy").alias("y"), (F.col("xx") + 1).alias("x"), F.col("label").alias("parent"))
    tree = found.join(size, "img").join(beside, ["img", "y", "x"], "left")
    return tree.where(F.size("points") >= least_points).select("img", (F.col("y") * F.col("_w") + F.col("x") + 1).alias("id"), "parent", "hole", "points")


def contours_by_tile(px: DataFrame, mask: str, tile: int) -> DataFrame:
    """What regions.contours gives, for images of any size (R2): img, contour and points of the outer borders."""
    size = px.groupBy("img").agg((F.max("xx") + 1).alias("_w"))  # a row an image
    return rings(px, mask, tile).where(~F.col("hole")).join(size, "img").select("img", (F.col("y") * F.col("_w") + F.col("x") + 1).alias("contour"), "points")
