"""Many whole images as one array: neighbourhoods, labels and floods of all of them at once.

A task's images lie in it one after another, each line by line, so a step over arrays is a step of every image, and Python is as busy with one image as
with some hundreds. Images may differ in size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


class Stack:
    """The images of a table's rows, which come sorted by img, yy and xx with _n, a row's place in its image, from 1.

    A cell is a place of the array, `place` the cell of each row; pixels without a row are 0 or what else `array` is told.
    """

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        y, x, n = (table.column(c).to_numpy() for c in ("yy", "xx", "_n"))
        self.starts = np.flatnonzero(n == 1)
        self.high, self.wide = (np.maximum.reduceat(at, self.starts).astype(np.int64) + 1 for at in (y, x))
        cells, row = self.high * self.wide, np.cumsum(n == 1) - 1
        self.begin = np.cumsum(cells) - cells
        self.place = self.begin[row] + y * self.wide[row] + x
        #: The image of each cell, and where it is in it.
        self.of = np.repeat(np.arange(len(cells)), cells)
        self.y, self.x = np.divmod(np.arange(len(self.of)) - self.begin[self.of], self.wide[self.of])
        self._mirrored: dict = {}

    def array(self, values: np.ndarray, other=0) -> np.ndarray:
        out = np.full(len(self.of), other, values.dtype)
        out[self.place] = values
        return out

    def column(self, name: str, kind, null, other=0) -> np.ndarray:
        """A column of numbers as an array, with what stands for nulls and for pixels without a row."""
        values = self.table.column(name)
        return self.array(values.cast(pa.from_numpy_dtype(kind)).fill_null(pa.scalar(null, pa.from_numpy_dtype(kind))).to_numpy(), other)

    def _beside(self, step: int, down: bool) -> np.ndarray:
        """The cell of each one's neighbour along an axis, mirrored at the edge; -1 in images of one line."""
        if (step, down) not in self._mirrored:
            at, size, far = (self.y, self.high, self.wide[self.of]) if down else (self.x, self.wide, 1)
            last = size[self.of] - 1
            to = np.where((at + step < 0) | (at + step > last), at - step, at + step)
            self._mirrored[step, down] = np.where(last > 0, np.arange(len(at)) + (to - at) * far, -1)
        return self._mirrored[step, down]

    def weighted(self, values: np.ndarray, weights: dict[tuple[int, int], float]) -> np.ndarray:
        """The sum of each pixel's 3 x 3 neighbours by their weights, added in their order as stencils.stencils adds them."""
        step = lambda a, s, down: a if s == 0 else np.append(a, 0.0)[self._beside(s, down)]
        values = values.astype(np.float64)
        lines = {dy: step(values, dy, True) for dy in {dy for dy, _ in weights}}
        total = np.zeros(len(values))
        for (dy, dx), w in weights.items():
            total = total + step(lines[dy], dx, False) * float(w)
        return total

    def extreme(self, values: np.ndarray, radius: int, highest: bool) -> np.ndarray:
        """The highest or lowest value of the pixels of the image within a square."""
        best = np.maximum if highest else np.minimum
        for at, size, far in ((self.x, self.wide, 1), (self.y, self.high, self.wide[self.of])):
            here, last, found = np.arange(len(at)), size[self.of] - 1, values
            for step in (s for s in range(-radius, radius + 1) if s):
                found = best(found, values[here + (np.clip(at + step, 0, last) - at) * far])
            values = found
        return values

    def labels(self, mask: np.ndarray) -> np.ndarray:
        """Of each set pixel the number (1 + its place in the image) of the first one in its region of eight neighbours, 0 elsewhere."""
        from rasterloom.operators.regions import _firsts

        cells = np.flatnonzero(mask)
        out = np.zeros(len(mask), np.int64)
        first = cells[_firsts(self.of[cells], self.y[cells], self.x[cells])]
        out[cells] = first - self.begin[self.of[first]] + 1
        return out

    def flooded(self, value: np.ndarray, marker: np.ndarray, difference: bool = False, wanted: np.ndarray | None = None) -> np.ndarray:
        """What regions.flood, or by difference regions.flood_by_difference, gives for each image. wanted: the pixels that are asked for; an image's flood by
        level may end when all of them are reached, as what is reached doesn't change."""
        from rasterloom.operators import regions

        out = np.zeros(len(marker), np.int64)
        sizes = self.high * self.wide
        for some in _alike(sizes):
            cells = np.concatenate([np.arange(self.begin[i], self.begin[i] + sizes[i]) for i in some])
            if len(some) < _ALONE:
                one = regions.flood_by_difference if difference else regions.flood
                shapes, ends = [(int(self.high[i]), int(self.wide[i])) for i in some], np.cumsum(sizes[some])[:-1]
                parts = zip(np.split(value[cells], ends), np.split(marker[cells], ends), shapes, strict=True)
                out[cells] = np.concatenate([one(v.reshape(s), k.reshape(s)).ravel() for v, k, s in parts])
            else:
                given = value[cells], marker[cells], self.high[some], self.wide[some]
                out[cells] = _by_difference(*given) if difference else _by_level(*given, None if wanted is None else wanted[cells])
        return out


#: Fewer images than these are flooded one by one; and as many pixels are flooded together.
_ALONE, _TOGETHER = 32, 1 << 21


def _alike(sizes: np.ndarray) -> list[np.ndarray]:
    """The images in lots of such as take about as many steps, which go side by side."""
    order, lots, a = np.argsort(sizes, kind="stable"), [], 0
    sizes = sizes[order]
    while a < len(order):
        b = int(np.searchsorted(sizes, 2 * sizes[a], "right"))
        b = min(b, a + max(1, _TOGETHER // int(sizes[b - 1])))
        lots.append(order[a:b])
        a = b
    return lots


class _Queues:
    """A queue for each image, of cells by rank and, among those of one rank, in the order of their coming. A cell comes once.

    Words of 64 bits tell which ranks wait, and words over them which words aren't empty.
    """

    def __init__(self, images: int, ranks: int, cells: int) -> None:
        self.ranks = ranks
        self.head, self.tail, self.next = np.full(images * ranks, -1), np.full(images * ranks, -1), np.full(cells, -1)
        self.words: list[tuple[np.ndarray, int]] = []
        while not self.words or ranks > 1:
            ranks = -(-ranks // 64)
            self.words.append((np.zeros(images * ranks, np.uint64), ranks))

    def push(self, image: np.ndarray, rank: np.ndarray, cell: np.ndarray) -> None:
        key = image * self.ranks + rank
        order = np.argsort(key, kind="stable")
        key, cell = key[order], cell[order]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        later = np.flatnonzero(~first)
        self.next[cell[later - 1]] = cell[later]
        starts = np.flatnonzero(first)
        key, lead, last = key[starts], cell[starts], cell[np.append(starts[1:], len(cell))[: len(starts)] - 1]
        busy = self.head[key] >= 0
        self.next[self.tail[key[busy]]] = lead[busy]
        self.tail[key] = last
        key = key[~busy]
        self.head[key] = lead[~busy]
        image, at = np.divmod(key, self.ranks)
        for words, n in self.words:
            np.bitwise_or.at(words, image * n + (at >> 6), np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
            at = at >> 6

    def pop(self, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next cell of each of some images, which all have one, and its rank."""
        at = np.zeros(len(image), np.int64)
        for words, n in reversed(self.words):
            word = words[image * n + at]
            at = at * 64 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1))  # the lowest bit that is set
        key = image * self.ranks + at
        cell = self.head[key]
        self.head[key] = after = self.next[cell]
        gone = after < 0
        image, left = image[gone], at[gone]
        for words, n in self.words:
            word = image * n + (left >> 6)
            words[word] &= ~np.left_shift(np.uint64(1), (left & 63).astype(np.uint64))
            gone = words[word] == 0
            image, left = image[gone], left[gone] >> 6
        return cell, at

    def waiting(self, image: np.ndarray) -> np.ndarray:
        return image[self.words[-1][0][image] != 0]


def _ranks(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each value's rank among the different ones of its image, from 0; of is sorted or not."""
    order = np.lexsort((values, of))
    o, v = of[order], values[order]
    fresh = np.append(True, o[1:] != o[:-1])[: len(o)]
    new = np.cumsum(fresh | np.append(True, v[1:] != v[:-1])[: len(o)]) - 1
    out = np.empty(len(o), np.int64)
    out[order] = new - np.repeat(new[fresh], np.diff(np.append(np.flatnonzero(fresh), len(o))))
    return out


def _spots(high: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The image of each cell, and whether it is at the edge, and each image's steps left, right, up and down."""
    cells = high * wide
    of = np.repeat(np.arange(len(cells)), cells)
    y, x = np.divmod(np.arange(len(of)) - (np.cumsum(cells) - cells)[of], wide[of])
    edge = (y == 0) | (x == 0) | (y == high[of] - 1) | (x == wide[of] - 1)
    one = np.ones(len(wide), np.int64)
    return of, edge, np.stack([-one, one, -wide, wide], 1)


def _by_level(value: np.ndarray, marker: np.ndarray, high: np.ndarray, wide: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    of, edge, steps = _spots(high + 2, wide + 2)
    inside = np.flatnonzero(~edge)
    out, rank = np.full(len(of), -2), np.zeros(len(of), np.int64)
    out[inside], rank[inside] = marker, _ranks(of[inside], value)
    asked = np.zeros(len(of), bool)
    asked[inside] = True if wanted is None else wanted
    left = np.bincount(of[asked & (out == 0)], minlength=len(high))
    steps = steps[:, [1, 3, 0, 2]]
    queues = _Queues(len(high), int(rank.max()) + 1, len(of))
    cell = np.flatnonzero(out > 0)
    queues.push(of[cell], rank[cell], cell)
    live = queues.waiting(np.flatnonzero(left > 0))
    while len(live):
        cell, level = queues.pop(live)
        near = cell[:, None] + steps[live]
        row, side = np.nonzero(out[near] == 0)
        to, own, image = near[row, side], out[cell[row]], live[row]
        around = out[to[:, None] + steps[image]]
        meets = ((around > 0) & (around != own[:, None])).any(1)
        out[to] = np.where(meets, -1, own)
        np.subtract.at(left, image, asked[to])
        goes = ~meets
        to = to[goes]
        queues.push(image[goes], np.maximum(level[row[goes]], rank[to]), to)
        live = queues.waiting(live[left[live] > 0])
    return out[inside]


def _by_difference(value: np.ndarray, marker: np.ndarray, high: np.ndarray, wide: np.ndarray) -> np.ndarray:
    of, edge, steps = _spots(high, wide)
    out = np.where(edge, -1, marker.astype(np.int64))
    value, far = value.astype(np.int64), wide[of]
    beyond = lambda to: np.minimum(to, len(of) - 1)  # noqa: E731  past the edge nothing is asked for
    here = np.arange(len(of))
    gaps = np.concatenate([np.abs(value - value[beyond(here + 1)]), np.abs(value - value[beyond(here + far)])])
    rank = gaps if gaps.max() < 1 << 12 else _ranks(np.concatenate([of, of]), gaps)
    between = lambda a, b, side: rank[np.minimum(a, b) + np.where(side < 2, 0, len(of))]
    queues = _Queues(len(high), int(rank.max()) + 1, len(of))
    waits = np.zeros(len(of), bool)
    cell = np.flatnonzero(out == 0)
    near = cell[:, None] + steps[of[cell]]
    most = np.iinfo(np.int64).max
    least = np.where(out[near] > 0, between(cell[:, None], near, np.arange(4)), most).min(1, initial=most)
    cell, least = cell[least < most], least[least < most]
    waits[cell] = True
    queues.push(of[cell], least, cell)
    live = queues.waiting(np.arange(len(high)))
    while len(live):
        cell, _ = queues.pop(live)
        near = cell[:, None] + steps[live]
        around = out[near]
        high_one = around.max(1)
        same = high_one == np.where(around > 0, around, most).min(1)
        out[cell] = np.where(same, high_one, -1)
        row, side = np.nonzero(same[:, None] & (around == 0) & ~waits[near])
        to = near[row, side]
        waits[to] = True
        queues.push(live[row], between(cell[row], to, side), to)
        live = queues.waiting(live)
    return out


def cores(stack: Stack, field: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """stencils.rock_cores of 8-bit fields, whose Otsu thresholds are given image by image."""
    from rasterloom.operators.stencils import LAPLACIAN, SCHARR_X, SCHARR_Y

    lap, gx, gy = (stack.weighted(field, w) for w in (LAPLACIAN, SCHARR_X, SCHARR_Y))
    crosses = ((lap > 0) & (stack.extreme(lap, 1, False) < 0)) | ((lap < 0) & (stack.extreme(lap, 1, True) > 0))
    steep = np.rint(np.minimum(255.0, np.abs(gx)) * 0.5 + np.minimum(255.0, np.abs(gy)) * 0.5) > 127
    kept = (field > threshold[stack.of]) & (field > 0) & ~(crosses & steep)
    return stack.extreme(stack.extreme(kept, 1, False), 1, True)


def rim(stack: Stack, core: np.ndarray) -> np.ndarray:
    """Whether a pixel lies right outside of a core."""
    from rasterloom.operators.stencils import LAPLACIAN

    lap = stack.weighted(core * 255, LAPLACIAN)
    return (stack.extreme(lap, 1, False) < 0) & (lap > 0)


def masks(stack: Stack, field: np.ndarray, glue: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Both masks of stencils.rock_masks: little and big."""
    from rasterloom.operators.stencils import BOX, SCHARR_X, SCHARR_Y

    blur = np.floor(stack.weighted(field, BOX) + 0.5)
    gx, gy = (np.floor(stack.weighted(blur, w) / 32) for w in (SCHARR_X, SCHARR_Y))
    steep = np.floor(np.sqrt(gx * gx + gy * gy))
    flow = np.rint(np.floor(stack.weighted(gx, SCHARR_X) / 32) * 0.5 + np.floor(stack.weighted(gy, SCHARR_Y) / 32) * 0.5)
    return (flow <= -0.001 * 255) & (blur > 0.02 * 255) & (steep < 0.01 * 255), (steep < 0.1 * 255) & (blur > glue * 255)


def by_images(rows, f: Callable[[Stack], dict[str, np.ndarray]], schema: str, *kept: str):
    """img, yy, xx, the columns to be kept and those that f gives for the cells of a stack: a row for each row. An image has to fit into a task's memory."""
    from rasterloom.operators.staging import by_groups

    def some(table: pa.Table):
        stack = Stack(table)
        found = f(stack)
        columns = {c: table.column(c) for c in ("img", "yy", "xx", *kept)} | {c: pa.array(v[stack.place]) for c, v in found.items()}
        yield pa.table(columns)

    kinds = {"img": "int", "yy": "bigint", "xx": "bigint"}
    rows = rows.withColumns({c: rows[c].cast(k) for c, k in kinds.items() if dict(rows.dtypes)[c] != k})
    return by_groups(rows, ["img"], ["yy", "xx"], some, schema, least=1 << 20)
