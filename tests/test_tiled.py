"""Regions tile by tile against whole images, for several sizes of tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import catalog
from rasterloom.operators import regions, tiled
from rasterloom.sources.synthetic import HEIGHT, WIDTH
from test_rocks import cores, images, laplacian, lowest
from test_rocks import masks as rock_masks
from test_whole import labels_by_hand

SIZES = [4, 64]


def frame(spark, images, **columns):
    """Pixels of images (by number) with further arrays as columns."""
    rows = []
    for img, shape in images.items():
        for y in range(shape[0]):
            for x in range(shape[1]):
                rows.append((img, y, x, *(c[img][y, x].item() for c in columns.values())))
    return spark.createDataFrame(rows, ["img", "yy", "xx", *columns]).withColumn("img", F.col("img").cast("int")).repartition(4)


def arrays(df, value, shapes):
    out = {k: np.full(s, -99.0) for k, s in shapes.items()}
    n = 0
    for r in df.collect():
        out[r.img][r.yy, r.xx] = r[value]
        n += 1
    assert n == sum(a * b for a, b in shapes.values())
    return out


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(11)
    found = {1: rng.random((17, 23)) < 0.55, 2: np.ones((9, 9), bool), 3: np.zeros((4, 5), bool), 4: rng.random((1, 14)) < 0.7, 5: np.ones((20, 21), bool)}
    found[5][10, 3] = False
    spiral = np.zeros((19, 19), bool)  # a chain through many tiles
    for k in range(0, 9, 2):
        spiral[k, k : 19 - k] = spiral[18 - k, k : 19 - k] = spiral[k : 19 - k, k] = spiral[k : 19 - k, 18 - k] = True
        spiral[k + 1, k] = False
        spiral[k + 2, k + 1] = True
    found[6] = spiral
    rings = np.zeros((16, 16), bool)
    rings[1:15, 1:15] = True
    rings[3:13, 3:13] = False
    rings[5:11, 5:11] = True
    rings[7:9, 7:9] = False
    found[7] = rings
    return found


@pytest.mark.parametrize("tile", SIZES)
def test_distances(spark, masks, tile):
    shapes = {k: m.shape for k, m in masks.items()}
    found = arrays(tiled.distances_by_tile(frame(spark, shapes, m=masks), "m", tile), "d", shapes)
    for k, m in masks.items():
        want = regions.distance_array(m)
        assert np.allclose(found[k], want, atol=1e-9) or np.array_equal(found[k], want), k


def forest(value, marker, by):
    """Kruskal on the whole image: passes in order, two marked parts never joined."""
    h, w = value.shape
    passes = []
    for y in range(h):
        for x in range(w):
            for way, (dy, dx) in enumerate(((0, 1), (1, 0))):
                if y + dy < h and x + dx < w:
                    a, b = value[y, x], value[y + dy, x + dx]
                    passes.append((abs(a - b) if by == "difference" else max(a, b), y, x, way, (y, x), (y + dy, x + dx)))
    root = {(y, x): (y, x) for y in range(h) for x in range(w)}
    held = {p: int(marker[p]) for p in root}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for *_, a, b in sorted(passes):
        a, b = find(a), find(b)
        if a != b and not (held[a] and held[b]):
            root[a] = b
            held[b] = held[a] or held[b]
    return np.array([[held[find((y, x))] for x in range(w)] for y in range(h)])


@pytest.fixture(scope="module")
def hilly():
    rng = np.random.default_rng(12)
    values, markers = {}, {}
    for k, (shape, high, share) in enumerate([((13, 18), 4, 0.04), ((20, 11), 1000, 0.03), ((7, 7), 1, 0.1), ((16, 16), 50, 0.01), ((5, 30), 3, 0.0), ((1, 9), 5, 0.2)], 1):
        values[k] = rng.integers(0, high, shape)
        markers[k] = np.where(rng.random(shape) < share, rng.integers(1, 6, shape), 0)
    return values, markers


@pytest.mark.parametrize("tile", SIZES)
@pytest.mark.parametrize("by", ["level", "difference"])
def test_watershed(spark, hilly, tile, by):
    values, markers = hilly
    shapes = {k: v.shape for k, v in values.items()}
    found = arrays(tiled.watershed_by_tile(frame(spark, shapes, v=values, k=markers), "v", "k", tile, by=by), "basin", shapes)
    for k in values:
        assert np.array_equal(found[k], forest(values[k], markers[k], by)), k


def test_watershed_is_a_flood(spark):
    """Without equal passes the basins are those of a flood that always takes the lowest pass next."""
    import heapq

    rng = np.random.default_rng(13)
    value = rng.permutation(14 * 15).reshape(14, 15) * 1.0
    marker = np.zeros(value.shape, int)
    marker[2, 3], marker[10, 11], marker[12, 1] = 1, 2, 3
    want, heap = marker.copy(), []

    def offer(y, x):
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            a, b = y + dy, x + dx
            if 0 <= a < 14 and 0 <= b < 15 and not want[a, b]:
                lower = min((y, x), (a, b))
                heapq.heappush(heap, (max(value[y, x], value[a, b]), *lower, int(dy != 0), a, b, want[y, x]))

    for y, x in np.argwhere(marker):
        offer(y, x)
    while heap:
        *_, y, x, k = heapq.heappop(heap)
        if not want[y, x]:
            want[y, x] = k
            offer(y, x)
    found = arrays(tiled.watershed_by_tile(frame(spark, {1: value.shape}, v={1: value}, k={1: marker}), "v", "k", 4), "basin", {1: value.shape})
    assert np.array_equal(found[1], want)


def test_lines_and_rim(spark, hilly):
    values, markers = hilly
    shapes = {k: v.shape for k, v in values.items() if min(v.shape) > 4}
    found = arrays(tiled.watershed_by_tile(frame(spark, shapes, v=values, k=markers), "v", "k", 5, by="difference", lines=True, rim=True), "basin", shapes)
    for k in shapes:
        inner = (slice(1, -1), slice(1, -1))
        plain = forest(values[k][inner], markers[k][inner], "difference")
        want = np.full(shapes[k], -1)
        want[inner] = plain
        wide = np.pad(plain, 1)
        for y, x in np.argwhere(markers[k][inner] == 0):
            beside = [wide[y + 1 + a, x + 1 + b] for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            if any(0 < b < plain[y, x] for b in beside):
                want[y + 1, x + 1] = -1
        assert np.array_equal(found[k], want), k


@pytest.mark.parametrize("tile", SIZES)
@pytest.mark.parametrize("inverse", [False, True])
def test_contour_tree(spark, masks, tile, inverse):
    rng = np.random.default_rng(14)
    many = masks | {10 + i: rng.random((11, 13)) < s for i, s in enumerate((0.3, 0.6, 0.8))}
    px, least = frame(spark, {k: m.shape for k, m in many.items()}, m=many).cache(), 1 if tile < 9 else 3
    plain = lambda df: sorted((r.img, r.id, r.parent or 0, r.hole, [tuple(p) for p in r.points]) for r in df.collect())
    assert plain(tiled.contour_tree_by_tile(px, "m", tile, inverse, least)) == plain(regions.contour_tree(px, "m", inverse, least))


def test_contours(spark, masks):
    px = frame(spark, {k: m.shape for k, m in masks.items()}, m=masks)
    plain = lambda df: sorted((r.img, r.contour, [tuple(p) for p in r.points]) for r in df.collect())
    assert plain(tiled.contours_by_tile(px, "m", 4)) == plain(regions.contours(px, "m"))


def test_share_of_distance(spark, masks):
    px = frame(spark, {k: masks[k].shape for k in (1, 5)}, m=masks)
    plain = lambda df: sorted((r.img, r.yy, r.xx, round(r.share, 9)) for r in df.collect())
    assert plain(tiled.mask_to_distance_by_tile(px, "m", 7)) == plain(regions.mask_to_distance(px, "m"))


def whole(spark, sf_dir, name, *values):
    """The arrays of a query's columns, and that it returns every pixel."""
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    found = {}
    for r in rows:
        for v in values:
            found.setdefault(r.img, {v: np.zeros((HEIGHT, WIDTH), int) for v in values})[v][r.yy, r.xx] = r[v]
    assert len(rows) == len({(r.img, r.yy, r.xx) for r in rows}) == len(found) * HEIGHT * WIDTH
    return found


def test_watershed_query(spark, sf_dir):
    found = whole(spark, sf_dir, "watershed_tiled", "basin")
    y, x = np.indices((HEIGHT, WIDTH))
    marker = np.where((y % 12 == 6) & (x % 16 == 8), y // 12 * 4 + x // 16 + 1, 0)
    assert len(found) > 1
    for img, got in found.items():
        assert np.array_equal(got["basin"], forest((x * 7 + y * 13 + img * 31) % 256, marker, "level")), img


def test_rock_queries(spark, sf_dir):
    """The rocks from tiles: the flood's own markers grown as a forest, with lines and rim."""
    from rasterloom.plans.objects import _field
    from rasterloom.plans.rasters import hills

    fields = images(hills(spark, sf_dir), "v")
    coarse = images(_field(spark, sf_dir, 6.0), "p")
    production, scales = whole(spark, sf_dir, "rock_production_tiled", "basin"), whole(spark, sf_dir, "rock_scales_tiled", "rock")

    def basins(value, marker):
        inner = (slice(1, -1), slice(1, -1))
        plain = forest(value[inner], marker[inner], "difference")
        wide, out = np.pad(plain, 1), np.full(value.shape, -1)
        beside = np.stack([wide[1:-1, 2:], wide[1:-1, :-2], wide[2:, 1:-1], wide[:-2, 1:-1]])
        line = (marker[inner] == 0) & ((beside > 0) & (beside < plain)).any(0)
        out[inner] = np.where(line, -1, plain)
        return out

    for img, v in fields.items():
        core, lap = cores(v), laplacian(cores(v) * 255)
        marker = np.where(core, labels_by_hand(core) + 1, np.where((lowest(lap) < 0) & (lap > 0), 0, 1))
        assert np.array_equal(production[img]["basin"], basins(v, marker)), img
        c = np.floor(coarse[img] * 0.8 * 255).astype(int)
        (little, big), (_, other) = rock_masks(v), rock_masks(c)
        core, possible = (little & (c <= 5.1)) | big | other, (v > 12.75) | (c > 12.75)
        marker = np.where(core, labels_by_hand(core) + 1, np.where(possible, 0, 1))
        assert np.array_equal(scales[img]["rock"], basins(possible * 255, marker) > 1), img


def test_contour_queries(spark, sf_dir):
    plain = lambda name: sorted(repr(r.asDict(True)) for r in catalog.QUERIES[name](spark, sf_dir).collect())
    assert plain("contour_tree_tiled") == plain("contour_tree") and plain("contours_tiled") == plain("contours")


def test_nothing(spark):
    px = spark.createDataFrame([], "img int, yy long, xx long, m boolean, v int, k int")
    assert tiled.distances_by_tile(px, "m", 4).count() == tiled.watershed_by_tile(px, "v", "k", 4).count() == tiled.contour_tree_by_tile(px, "m", 4).count() == 0
